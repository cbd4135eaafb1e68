"""Mixing documents to target domain weights with soft membership.

1. A softmax classifier over hashed word presences is fitted on a bounded
   sample of the labelled table and gives every document a posterior ``p`` over
   the domains; a document belongs to each domain with that share.
2. With ``t`` a document's tokens and ``T`` the wanted tokens per domain, the
   document rates ``r >= 0`` minimise ::

       1/2 sum_k (sum_d r_d t_d p_dk - T_k)^2 / (N q_k)  +  ridge/2 sum_d t_d (r_d - 1)^2

   (``N`` all tokens, ``q_k`` the domain's share now) by projected gradient steps
   ``r <- max(0, y - gradient(y) / L)`` with momentum (``y`` extrapolates the last
   two rates), restarted when it points uphill.  The gradient of a document is
   ``g . p_d + ridge (y_d - 1)`` with one number ``g_k`` a domain, the domain's
   miss over ``q_k``; in the metric of the tokens ``L = 1 + ridge``.  A step is one
   sum over the table: tasks replay the steps so far on their documents from the
   numbers ``g``, so rates are not stored between steps.  Steps end when the
   projected gradient is below a tolerance; its size is returned as ``residual``.
3. The rate becomes a number of copies by ``floor(rate + u)`` with ``u`` a hash
   of identifier and text, so expected totals are kept and a retried task draws
   alike.

Tokens are white-space-separated words.  Defined results: NULL text is empty
and has no tokens (its rate is the one its posterior gives); without labelled
rows every document belongs to every domain equally; a domain that no document
belongs to cannot reach a target above 0 and stays empty; repeated rows count
each, and NULL identifiers are rows like any other (rows of one identifier and
text get one number of copies); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabrisk.llm.pieces import cut_pieces, give_back, text_slices
from tabrisk.llm.shared import cut, labelled_sample

SAMPLE = 4000          # labelled documents used to fit, all domains together
SAMPLE_BYTES = 4 << 20  # a longer single text is not drawn into the sample
BUCKETS = 1 << 15      # hashed words
FIT_STEPS = 60
STEPS = 800            # sums over the table at most
TOLERANCE = 1e-6       # of the projected gradient, a document's mean by tokens
RIDGE = 1e-3
ROWS_PER_TASK = 250_000  # documents one task takes a step for
SLICE = 1 << 19


def word_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hashed word) pairs, each once, sorted by text; and words per text."""
    import pandas as pd

    pieces = cut_pieces(texts, lower=True)
    bucket = pd.util.hash_array(np.array(pieces.words.to_pylist(), object)) % BUCKETS if len(pieces.words) else np.zeros(0)
    counts = np.diff(pieces.first)
    owner = np.repeat(np.arange(len(texts)), counts)
    pair = np.unique(owner * BUCKETS + bucket.astype(np.int64)[pieces.index])
    return pair // BUCKETS, pair % BUCKETS, counts


class DomainModel:
    """Softmax over unit-length word presence vectors."""

    def __init__(self, domains: Sequence[str], weights: np.ndarray, bias: np.ndarray):
        self.domains, self.weights, self.bias = list(domains), weights, bias

    def posterior(self, doc: np.ndarray, word: np.ndarray, texts: int) -> np.ndarray:
        size = np.bincount(doc, minlength=texts)
        out = np.stack([np.bincount(doc, self.weights[word, k], texts) for k in range(len(self.domains))], 1)
        out = out / np.sqrt(np.maximum(size, 1))[:, None] + self.bias
        out = np.exp(out - out.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)


def _fit(doc, word, label, domains, steps: int = FIT_STEPS) -> DomainModel:
    n, k = len(label), len(domains)
    hot = np.eye(k)[label]
    value = 1 / np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1))[doc]
    # start from the log odds of the words, then gradient steps (Adam)
    seen = np.stack([np.bincount(word, hot[doc, j], BUCKETS) for j in range(k)], 1) + 0.5
    share = seen / (hot.sum(0) + 1)
    weights = np.log(share) - np.log(share).mean(1, keepdims=True)
    weights[seen.sum(1) <= 0.5 * k] = 0
    bias = np.zeros(k)
    theta = np.vstack([weights, bias])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        model = DomainModel(domains, theta[:-1], theta[-1])
        error = (hot - model.posterior(doc, word, n)) / n
        grad = np.empty_like(theta)
        for j in range(k):
            grad[:-1, j] = np.bincount(word, error[doc, j] * value, BUCKETS)
        grad[-1] = error.sum(0)
        grad -= 1e-6 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        theta = theta + 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7)
    return DomainModel(domains, theta[:-1].astype(np.float32), theta[-1])


def fit_domains(docs: DataFrame, labels: DataFrame, domains: Sequence[str], id_col: str = "doc_id",
                text_col: str = "text", domain_col: str = "domain", sample: int = SAMPLE,
                sample_bytes: int = SAMPLE_BYTES) -> DomainModel | None:
    """Fit on the documents that ``labels`` puts in one of ``domains``; at most ``sample`` of them,
    shared out over the domains, none longer than ``sample_bytes``."""
    domains = list(domains)
    picked = labelled_sample(docs, labels.where(F.col(domain_col).isin(domains)), id_col, text_col, domain_col,
                             sample // len(domains), sample_bytes)

    def sets(batches):
        for batch in batches:
            for part in text_slices(batch, "_text", SLICE):
                doc, word, _ = word_sets(part.column("_text"))
                cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([
                    part.column("_y"), part.column("_key"),
                    pa.array([word[a:b].astype(np.uint16).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
                    ["d", "hash", "words"])

    got = picked.select("_y", F.col("_key").cast("string"), "_text").mapInArrow(
        sets, "d string, hash string, words binary").collect()  # at most ``sample`` rows
    got = sorted(got, key=lambda r: (r["d"], r["hash"]))
    if not got:
        return None
    words = [np.frombuffer(r["words"], np.uint16).astype(np.int64) for r in got]
    doc = np.repeat(np.arange(len(got)), [len(w) for w in words])
    return _fit(doc, np.concatenate(words), np.array([domains.index(r["d"]) for r in got]), domains)


def memberships(docs: DataFrame, model: DomainModel | None, domains: Sequence[str], id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``<id>, n_tokens, p0 .. pk-1, _u`` of every row."""
    domains = list(domains)
    names = [f"p{i}" for i in range(len(domains))]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"),
                       _uniform(id_col, text_col).alias("_u"))

    def member(batches):
        for batch in batches:
            for part in text_slices(batch, "_text", SLICE):
                doc, word, counts = word_sets(part.column("_text"))
                p = (np.full((part.num_rows, len(domains)), 1 / len(domains)) if model is None
                     else model.posterior(doc, word, part.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(counts.astype(np.int64)), *[pa.array(p[:, i]) for i in range(len(domains))],
                     part.column("_u")], ["_id", "n_tokens", *names, "_u"])
        give_back()

    schema = rows.select("_id").schema.add("n_tokens", "long")
    for name in names:
        schema = schema.add(name, "double")
    return rows.mapInArrow(member, schema.add("_u", "double")).withColumnRenamed("_id", id_col)


def _uniform(id_col: str, text_col: str) -> Column:
    bits = F.xxhash64(F.lit("copies"), F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")))
    return F.shiftrightunsigned(bits, 12) / F.lit(float(1 << 52))


def _replay(p: np.ndarray, moves: Sequence[tuple], ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rates before the last step, point it was taken from, rates after it)."""
    before = here = now = np.ones(len(p))
    for g, momentum in moves:
        here = now + momentum * (now - before)
        before, now = now, np.maximum(0.0, here - (p @ g + ridge * (here - 1)) / (1 + ridge))
    return before, here, now


def fit_rates(members: DataFrame, targets: Sequence[float], ridge: float = RIDGE, steps: int = STEPS,
              tolerance: float = TOLERANCE) -> DataFrame:
    """Append ``rate`` and ``residual``: ``targets`` are wanted tokens per domain, as multiples of
    all tokens now."""
    names = [f"p{i}" for i in range(len(targets))]
    table = cut(members)
    rows, total, *now = table.agg(F.count(F.lit(1)), F.sum("n_tokens"), *[F.sum(F.col("n_tokens") * F.col(p)) for p in names]).first()
    if not total:
        return table.withColumns({"rate": F.lit(1.0), "residual": F.lit(0.0)})
    # a domain that no document belongs to has no say
    some = [i for i, x in enumerate(now) if x]
    share = np.array([now[i] / total for i in some])
    scale = np.maximum(share, 1e-9)
    wanted = np.array([targets[i] for i in some], float)

    def columns(batch):
        return np.stack([batch.column(names[i]).to_numpy(zero_copy_only=False) for i in some], 1)

    def sums(moves):
        """Of one step: domain totals after it, its mean length, whether momentum points uphill."""
        def part(batches):
            got = np.zeros(len(some) + 2)
            for batch in batches:
                if batch.num_rows:
                    p, weight = columns(batch), batch.column("n_tokens").to_numpy() / total
                    before, here, now = _replay(p, moves, ridge)
                    got += [*((weight * now) @ p), weight @ np.abs(now - here), weight @ ((here - now) * (now - before))]
            yield pa.RecordBatch.from_arrays([pa.array([got.tolist()], pa.list_(pa.float64()))], ["s"])

        rows = narrow.mapInArrow(part, "s array<double>")
        return np.array(rows.agg(*[F.sum(F.col("s")[i]) for i in range(len(some) + 2)]).first())

    # read by every step: few columns, in tasks that are worth their start
    narrow = cut(table.select("n_tokens", *names).coalesce(-(-rows // ROWS_PER_TASK)))
    moves: list[tuple] = []
    before = here = share        # domain totals at all rates 1
    speed, residual = 1.0, np.inf
    for _ in range(steps):
        faster = (1 + (1 + 4 * speed ** 2) ** 0.5) / 2
        momentum = (speed - 1) / faster if moves else 0.0
        point = here + momentum * (here - before)
        moves.append(((point - wanted) / scale, momentum))
        *after, length, uphill = sums(moves)
        before, here, speed = here, np.array(after), 1.0 if uphill > 0 else faster
        residual = length * (1 + ridge)
        if residual < tolerance:
            break

    def rated(batches):
        for batch in batches:
            yield batch.append_column("rate", pa.array(_replay(columns(batch), moves, ridge)[2]))

    return table.mapInArrow(rated, T.StructType([*table.schema.fields, T.StructField("rate", T.DoubleType())])).withColumn("residual", F.lit(float(residual)))


def mix(docs: DataFrame, labels: DataFrame, weights: Mapping[str, float], size: float | None = 1.0,
        id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> DataFrame:
    """``<id>, n_tokens, p_<domain>.., rate, copies, residual`` of every row.

    ``labels`` names the domain of some documents; ``weights`` are the target shares; the mixture holds ``size`` times the
    tokens of ``docs``.
    """
    domains = list(weights)
    model = fit_domains(docs, labels, domains, id_col, text_col, domain_col)
    members = memberships(docs, model, domains, id_col, text_col)
    scale = size / sum(weights.values())
    rated = fit_rates(members, [weights[d] * scale for d in domains])
    return rated.select(
        id_col, "n_tokens", *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)], "rate",
        F.floor(F.col("rate") + F.col("_u")).cast("bigint").alias("copies"), "residual", "_u")


def apply_copies(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` decided."""
    decided = mixed.groupBy(F.col(id_col).alias("_d_id"), F.col("_u").alias("_d_u")).agg(F.max("copies").alias("_d_n"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"),
                       _uniform(id_col, text_col).alias("_u"))
    joined = rows.join(decided, F.col("_id").eqNullSafe(F.col("_d_id")) & (F.col("_u") == F.col("_d_u")))
    return joined.where(F.col("_d_n") > 0).select(
        F.explode(F.array_repeat("_row", F.col("_d_n").cast("int"))).alias("_row")).select("_row.*")


def quality_domains(labels: DataFrame) -> Column:
    """Domain of a row of ``labels``: low (quality 0), toxic, else clean; NULL without labels."""
    return (F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic")
            .when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean"))
