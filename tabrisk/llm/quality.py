"""Document quality from a linear-chain conditional random field over lines.

Every line of a document is labelled good or bad.  The features of a line are
its character make-up, word repetition and length, and those of the line
before and after it; a two-state chain ties neighbouring labels together.
Forward-backward gives the marginal of every line, their mean weighted by line
length is the document's share of good text, and a logistic curve fitted on
the same training documents turns the share into a probability.

The chain is fitted on the driver by gradient ascent, from the line features of
a bounded sample of labelled documents (``sample``, half of each class, drawn
in the order of a hash of the identifier, of at most ``sample_bytes`` each and
``sample_lines`` together, which bounds what the driver holds); the lines of a
training document carry its label.  Labels, language, source and identifiers are never features.

Scoring is vectorised over the documents of a batch: the recursion walks line
numbers, all documents that still have such a line at once.

Defined results: NULL and empty texts are one empty line and get a score like
any other; without labelled documents of both classes every score is 0.5; rows
keep NULL identifiers and repetitions; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabrisk.llm.pieces import cut_pieces, text_slices
from tabrisk.llm.shared import labelled_sample

SAMPLE = 3000       # labelled documents used to fit, both classes together
SAMPLE_BYTES = 8 << 20  # a longer single text is not drawn into the sample
SAMPLE_LINES = 400_000  # lines of the sample; a text with a twentieth of them is not drawn
STEPS = 150
PENALTY = 1e-4
SLICE = 2 << 20

_PUNCTUATION = [i for i in range(33, 127) if not chr(i).isalnum()]
_KIND = np.zeros(256, np.int64)          # 0 other, 1 upper, 2 lower, 3 digit, 4 space, 5 not ASCII, 6.. marks
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[[32, 9, 11, 12, 13]], _KIND[128:] = 4, 5
for _n, _c in enumerate(_PUNCTUATION):
    _KIND[_c] = 6 + _n
_KINDS = 6 + len(_PUNCTUATION)
OWN = _KINDS + 9                         # features of one line
FEATURES = 1 + 3 * OWN


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, line length in bytes, first line of each text and the end)."""
    pieces = cut_pieces(texts)
    data, bounds = pieces.data, pieces.bounds
    newline = np.flatnonzero(data == 10)
    # a text has one line more than newlines; the newline ends its line
    per_text = np.searchsorted(newline, bounds[1:]) - np.searchsorted(newline, bounds[:-1]) + 1
    first = np.concatenate([[0], np.cumsum(per_text)])
    lines = int(first[-1])
    text_of = np.repeat(np.arange(len(texts)), per_text)
    number = np.arange(lines) - first[text_of]
    before = np.searchsorted(newline, bounds[:-1])
    begin = np.where(number == 0, bounds[text_of],
                     newline[np.minimum(before[text_of] + number - 1, max(len(newline) - 1, 0))] + 1
                     if len(newline) else bounds[text_of])
    stop = np.append(begin[1:], bounds[-1])
    size = stop - begin                                   # with the newline
    line_of = np.repeat(np.arange(lines), size)
    kinds = np.bincount(line_of * _KINDS + _KIND[data], minlength=lines * _KINDS).reshape(lines, _KINDS)
    kinds[:, 0] = 0                                       # newlines and control characters
    total = np.maximum(kinds.sum(1), 1).astype(float)
    own = np.zeros((lines, OWN), np.float32)
    own[:, :_KINDS] = np.sqrt(kinds / total[:, None])
    letters = np.maximum(kinds[:, 1] + kinds[:, 2], 1)
    own[:, 1] = kinds[:, 1] / letters
    own[:, _KINDS] = np.log1p(size) / 8
    own[:, _KINDS + 1] = kinds[:, 6:].sum(1) / total      # all marks
    # words: adjacent repeats, distinct share, mean length
    piece_line = np.searchsorted(begin, pieces.start, "right") - 1
    words = np.bincount(piece_line, minlength=lines)
    some = np.maximum(words, 1)
    same = (pieces.index[1:] == pieces.index[:-1]) & (piece_line[1:] == piece_line[:-1])
    own[:, _KINDS + 2] = np.bincount(piece_line[1:][same], minlength=lines) / some
    pair = np.unique(piece_line.astype(np.int64) * (len(pieces.words) + 1) + pieces.index)
    own[:, _KINDS + 3] = 1 - np.bincount(pair // (len(pieces.words) + 1), minlength=lines) / some
    own[:, _KINDS + 4] = np.minimum(np.bincount(piece_line, weights=pieces.length, minlength=lines) / some, 40) / 10
    own[:, _KINDS + 5] = np.log1p(words) / 5
    # lines that the same text has more than once
    mix = (pieces.index.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mix ^= mix >> np.uint64(29)
    place = np.arange(len(piece_line)) - np.searchsorted(piece_line, piece_line)
    mix = mix * (2 * place.astype(np.uint64) + np.uint64(0xBF58476D1CE4E5B9))
    running = np.concatenate([[np.uint64(0)], np.cumsum(mix, dtype=np.uint64)])
    cuts = np.searchsorted(piece_line, np.arange(lines + 1))
    print_of = running[cuts[1:]] - running[cuts[:-1]]
    order = np.lexsort((print_of, text_of))
    again = np.zeros(lines, bool)
    equal = (print_of[order][1:] == print_of[order][:-1]) & (text_of[order][1:] == text_of[order][:-1])
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    own[:, _KINDS + 6] = again & (words > 2)
    own[:, _KINDS + 7] = size == 0
    own[:, _KINDS + 8] = own[:, _KINDS + 2] > 0.3
    out = np.zeros((lines, FEATURES), np.float32)
    out[:, 0] = 1
    out[:, 1:1 + OWN] = own
    out[1:, 1 + OWN:1 + 2 * OWN] = own[:-1] * (number[1:, None] > 0)
    last = np.append(number[1:] == 0, True)
    out[:-1, 1 + 2 * OWN:] = own[1:] * ~last[:-1, None]
    return out, size, first


def _walk(first: np.ndarray):
    """Line numbers in step: (texts by number of lines, indices of step t)."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    count, start = count[order], first[:-1][order]
    alive = np.searchsorted(-count, -np.arange(1, (count[0] if len(count) else 0) + 1), "right")
    return start, alive


def forward_backward(emit: np.ndarray, first: np.ndarray, change: np.ndarray, begin: float):
    """Log-odds that a line is good; and the pieces the gradient needs.

    ``emit``: log-odds of a line on its own; ``change[i, j]``: score of label
    ``j`` after ``i`` (1 good); ``begin``: log-odds of the first label.
    """
    start, alive = _walk(first)
    ahead, behind = emit.astype(float).copy(), np.zeros(len(emit))
    t = change
    for step, n in enumerate(alive):
        at = start[:n] + step
        if step == 0:
            ahead[at] += begin
        else:
            prev = ahead[at - 1]
            ahead[at] += np.logaddexp(prev + t[1, 1], t[0, 1]) - np.logaddexp(prev + t[1, 0], t[0, 0])
    for step in range(len(alive) - 2, -1, -1):
        at = start[:alive[step + 1]] + step
        nxt = emit[at + 1] + behind[at + 1]
        behind[at] = np.logaddexp(nxt + t[1, 1], t[1, 0]) - np.logaddexp(nxt + t[0, 1], t[0, 0])
    return ahead, behind


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class QualityModel:
    weights: np.ndarray
    change: np.ndarray
    begin: float
    slope: float = 1.0
    shift: float = 0.0

    def share(self, features: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of each text."""
        emit = features @ self.weights
        ahead, behind = forward_backward(emit, first, self.change, self.begin)
        weight = size + 1.0
        good = np.add.reduceat(_sigmoid(ahead + behind) * weight, first[:-1]) if len(first) > 1 else np.zeros(0)
        return good / (np.add.reduceat(weight, first[:-1]) if len(first) > 1 else 1)

    def score(self, features, size, first) -> np.ndarray:
        return _sigmoid(self.slope * (self.share(features, size, first) - 0.5) + self.shift)


def fit_chain(features: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray,
              steps: int = STEPS, penalty: float = PENALTY) -> QualityModel:
    """Gradient ascent (Adam) on the conditional likelihood; a document counts once however long."""
    count = np.diff(first)
    y = np.repeat(label, count).astype(float)
    weight = np.repeat(1.0 / count, count) / len(label)
    inside = np.ones(len(y), bool)
    inside[first[:-1]] = False
    at = np.flatnonzero(inside)
    theta = np.zeros(features.shape[1] + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, t, begin = theta[:-5], theta[-5:-1].reshape(2, 2), theta[-1]
        emit = features @ w.astype(np.float32)
        ahead, behind = forward_backward(emit, first, t, begin)
        p = _sigmoid(ahead + behind)
        grad = np.zeros_like(theta)
        grad[:-5] = features.T @ ((y - p) * weight).astype(np.float32)
        if len(at):
            nxt = (emit + behind)[at]
            logits = np.stack([np.full(len(at), t[0, 0]), nxt + t[0, 1],
                               ahead[at - 1] + t[1, 0], ahead[at - 1] + nxt + t[1, 1]], 1)
            expect = np.exp(logits - logits.max(1, keepdims=True))
            expect /= expect.sum(1, keepdims=True)
            seen = np.stack([(1 - y[at - 1]) * (1 - y[at]), (1 - y[at - 1]) * y[at],
                             y[at - 1] * (1 - y[at]), y[at - 1] * y[at]], 1)
            grad[-5:-1] = ((seen - expect) * weight[at, None]).sum(0)
        grad[-1] = ((y - p) * weight)[first[:-1]].sum()
        grad -= penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        theta += 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    model = QualityModel(theta[:-5].astype(np.float32), theta[-5:-1].reshape(2, 2), float(theta[-1]))
    share = model.share(features, size, first) - 0.5
    a, b = 4.0, 0.0
    for _ in range(100):  # logistic curve by damped Newton steps
        p = _sigmoid(a * share + b)
        g = np.array([((label - p) * share).mean() - 1e-3 * a, (label - p).mean()])
        r = p * (1 - p)
        h = np.array([[(r * share * share).mean() + 1e-3, (r * share).mean()], [(r * share).mean(), r.mean() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + step[0], b + step[1]
    model.slope, model.shift = float(max(a, 0.1)), float(b)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES,
                sample_lines: int = SAMPLE_LINES) -> QualityModel | None:
    """Fit on the documents that ``labels`` marks 1 (good) or 0 (bad); None unless both classes occur."""
    marked = labels.where(F.col(label_col).isin(0, 1))
    picked = labelled_sample(docs, marked, id_col, text_col, label_col, sample // 2, sample_bytes)
    lines = F.length("_text") - F.length(F.replace("_text", F.lit("\n"))) + 1
    so_far = Window.partitionBy("_y").orderBy(F.xxhash64("_key"), "_key")  # at most sample / 2 rows a class
    picked = (picked.withColumn("_lines", lines).where(F.col("_lines") <= sample_lines // 20)
              .withColumn("_sum", F.sum("_lines").over(so_far)).where(F.col("_sum") <= sample_lines // 2))

    def features(batches):
        for batch in batches:
            for part in text_slices(batch, "_text", SLICE):
                x, size, first = line_features(part.column("_text"))
                yield pa.RecordBatch.from_arrays([
                    part.column("_y"), part.column("_key"), pa.array(np.diff(first)),
                    pa.array([x[a:b].astype(np.float16).tobytes() for a, b in zip(first, first[1:])], pa.binary()),
                    pa.array([size[a:b].astype(np.int64).tobytes() for a, b in zip(first, first[1:])], pa.binary())],
                    ["y", "hash", "n", "x", "size"])

    got = picked.select(F.col("_y").cast("int"), F.col("_key").cast("string"), "_text").mapInArrow(
        features, "y int, hash string, n bigint, x binary, size binary").collect()  # at most ``sample`` rows
    got = sorted(got, key=lambda r: (r["y"], r["hash"]))
    label = np.array([r["y"] for r in got])
    if not len(got) or label.min() == label.max():
        return None
    x = np.concatenate([np.frombuffer(r["x"], np.float16).reshape(-1, FEATURES) for r in got]).astype(np.float32)
    size = np.concatenate([np.frombuffer(r["size"], np.int64) for r in got])
    return fit_chain(x, size, np.concatenate([[0], np.cumsum([r["n"] for r in got])]), label)


def score_quality(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, score`` of every row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def score(batches):
        for batch in batches:
            for part in text_slices(batch, "_text", SLICE):
                got = (np.full(part.num_rows, 0.5) if model is None
                       else model.score(*line_features(part.column("_text"))))
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(got)], ["_id", "score"])

    schema = rows.select("_id").schema.add("score", "double")
    return rows.mapInArrow(score, schema).withColumnRenamed("_id", id_col)
