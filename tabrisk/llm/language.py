"""Language identification with a string kernel.

A text is the set of the letter 1-, 2- and 3-grams it contains (case folded,
anything between letters is one boundary symbol): the blended-spectrum presence
kernel ``k(x, z) = |x n z| / sqrt(|x| |z|)`` over the grams that occur in the
landmarks.  The kernel matrix of all texts is never formed: ``landmarks`` texts
give Nystroem features and one-versus-rest kernel ridge regression is solved in
that space on the driver, from a bounded sample of labelled texts.  The fitted
model is one gram-by-landmark 0/1 matrix and one landmark-by-language weight
matrix; a block of texts is scored with two matrix products.

The only inputs of a prediction are the letters of the text.  The sample is
``sample`` texts at most, shared out evenly over the languages and drawn in
the order of a hash of the text; everything else runs over whole texts.

Defined results: a text that is NULL or has no letter gets ``und`` with score
0; without any labelled text every document does; ties go to the language that
sorts first; rows keep NULL identifiers and repetitions; very long texts are
scored whole, one at a time; other columns are not read, and columns that have
the prediction's names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabrisk.llm.pieces import cut_buffer, give_back, text_slices

SAMPLE = 1600      # labelled texts used to fit, all languages together
LANDMARKS = 128
RIDGE = 1e-3
SHARPNESS = 4.0    # of the softmax over the regression outputs
BITS = 7           # of a letter's code; 0 is the boundary
BLOCK = 256        # texts scored by one matrix product
SLICE = 1 << 20    # text bytes scored at once
PART = 1 << 18     # text bytes turned into grams at once; a worker needs some hundred bytes for each
UNDETERMINED = "und"

_codes: np.ndarray | None = None


def _letter_codes() -> np.ndarray:
    """Code of every code point: a-z get 1-26, other letters share 27-127 by code
    point, anything else is 0."""
    global _codes
    if _codes is None:
        codes = np.zeros(0x110000, np.uint8)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = ord(c.lower()[0])
                codes[cp] = low - 96 if 97 <= low <= 122 else 27 + low % 101
        _codes = codes
    return _codes


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, gram number, texts with a letter) of a batch; grams repeat."""
    data, bounds = cut_buffer(texts)
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
    code = _letter_codes()[chars].astype(np.int32)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    # a boundary after every text, runs of boundaries are one
    code = np.insert(code, ends[1:], 0)
    owner = np.insert(owner, ends[1:], np.arange(len(texts)))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (owner[1:] != owner[:-1])
    code, owner = code[keep], owner[keep]
    two = (code[:-1] << BITS | code[1:]) + (1 << BITS)
    three = (code[:-2] << 2 * BITS | code[1:-1] << BITS | code[2:]) + (1 << BITS) + (1 << 2 * BITS)
    ok2, ok3 = owner[:-1] == owner[1:], owner[:-2] == owner[2:]
    letters = code > 0
    has = np.zeros(len(texts), bool)
    has[owner[letters]] = True
    return (np.concatenate([owner[letters], owner[:-1][ok2], owner[:-2][ok3]]),
            np.concatenate([code[letters], two[ok2], three[ok3]]), has)


GRAMS = (1 << BITS) + (1 << 2 * BITS) + (1 << 3 * BITS)


@dataclass
class LanguageModel:
    languages: list[str]
    vocabulary: np.ndarray   # gram numbers
    landmark: np.ndarray     # grams x landmarks, 0/1 scaled by 1/sqrt(|z|)
    weights: np.ndarray      # landmarks x languages
    bias: np.ndarray

    @staticmethod
    def blank() -> "LanguageModel":
        """Knows no gram: every text with a letter gets the one nameless language."""
        one = np.zeros((1, 1), np.float32)
        return LanguageModel([""], np.zeros(0, np.int64), one[:0], one, one[0])

    def outputs(self, present: np.ndarray) -> np.ndarray:
        """Regression outputs of texts given as rows of gram presences."""
        size = np.sqrt(np.maximum(present.sum(1, keepdims=True), 1))
        return (present @ self.landmark / size) @ self.weights + self.bias

    def predict(self, texts: pa.Array, lookup: np.ndarray) -> tuple[list[str], np.ndarray]:
        has = np.zeros(len(texts), bool)
        best = np.zeros(len(texts), np.int64)
        score = np.zeros(len(texts))
        for begin in range(0, len(texts), BLOCK):
            end = min(begin + BLOCK, len(texts))
            present = np.zeros((end - begin, len(self.vocabulary)), np.float32)
            row = 0
            for part in text_slices(pa.RecordBatch.from_arrays([texts.slice(begin, BLOCK)], ["_text"]), "_text", PART):
                doc, gram, lettered = grams(part.column("_text"))
                at = lookup[gram]
                present[doc[at >= 0] + row, at[at >= 0]] = 1
                has[begin + row:begin + row + part.num_rows] = lettered
                row += part.num_rows
            out = self.outputs(present) * SHARPNESS
            out = np.exp(out - out.max(1, keepdims=True))
            best[begin:end] = out.argmax(1)
            score[begin:end] = out.max(1) / out.sum(1)
        names = [self.languages[i] if ok else UNDETERMINED for i, ok in zip(best, has)]
        return names, np.where(has, score, 0.0)


def _sample(docs: DataFrame, lang_col: str, text_col: str, where: Column, sample: int) -> DataFrame:
    """At most ``sample`` labelled texts as gram sets, spread over the languages."""
    named = docs.where(where & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"),
        F.xxhash64(text_col).alias("_hash"))
    languages = named.select("_lang").distinct().count()
    each = max(1, sample // max(1, languages))
    # drawn twice: the first of a language in each of 64 parts of its hashes, then the first of those
    order = Window.partitionBy("_lang", "_part").orderBy("_hash")
    drawn = (named.select("_lang", "_hash").distinct().withColumn("_part", F.pmod("_hash", F.lit(64)))
             .withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= each).drop("_part"))
    order = Window.partitionBy("_lang").orderBy("_hash")      # at most 64 * each rows a language
    drawn = drawn.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= each).orderBy("_rank", "_lang").limit(sample)

    def sets(batches):
        for batch in batches:
            for part in text_slices(batch, "_text", PART):
                doc, gram, _ = grams(part.column("_text"))
                own = np.unique(doc.astype(np.int64) * GRAMS + gram)
                cuts = np.searchsorted(own, np.arange(part.num_rows + 1) * GRAMS)
                yield pa.RecordBatch.from_arrays([
                    part.column("_lang"), part.column("_rank"),
                    pa.array([(own[a:b] % GRAMS).astype(np.int32) for a, b in zip(cuts, cuts[1:])],
                             pa.list_(pa.int32()))], ["lang", "rank", "grams"])

    # at most ``sample`` keys: a proven bound; a text with many copies is one row
    picked = named.join(F.broadcast(drawn.select("_lang", "_hash", "_rank")), ["_lang", "_hash"])
    once = picked.groupBy("_lang", "_rank").agg(F.min("_text").alias("_text"))
    return once.mapInArrow(sets, "lang string, rank int, grams array<int>")


def fit_language(docs: DataFrame, where: Column, lang_col: str = "lang", text_col: str = "text",
                 sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel | None:
    """Fit on the rows of ``docs`` that satisfy ``where``; None without any label."""
    rows = _sample(docs, lang_col, text_col, where, sample).collect()  # at most ``sample`` rows
    rows = sorted((r for r in rows if r["grams"]), key=lambda r: (r["rank"], r["lang"]))
    if not rows:
        return None
    sets = [np.array(r["grams"], np.int64) for r in rows]
    names = sorted({r["lang"] for r in rows})
    m = min(landmarks, len(rows))
    vocabulary = np.unique(np.concatenate(sets[:m]))  # the first ranks of every language
    present = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, own in enumerate(sets):
        present[i, np.searchsorted(vocabulary, own[np.isin(own, vocabulary)])] = 1
    unit = present / np.sqrt(np.maximum(present.sum(1, keepdims=True), 1))
    kernel = (unit @ unit[:m].T).astype(float)
    values, vectors = np.linalg.eigh(kernel[:m])
    good = values > 1e-8 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ whiten
    target = np.array([[1.0 if r["lang"] == n else -1.0 for n in names] for r in rows])
    mean_x, mean_y = features.mean(0), target.mean(0)
    x = features - mean_x
    solved = np.linalg.solve(x.T @ x + ridge * len(rows) * np.eye(x.shape[1]), x.T @ (target - mean_y))
    weights = (whiten @ solved).astype(np.float32)
    return LanguageModel(names, vocabulary, np.ascontiguousarray(unit[:m].T), weights,
                         (mean_y - mean_x @ solved).astype(np.float32))


def _predicted(docs: DataFrame, model: LanguageModel | None, text_col: str) -> DataFrame:
    """``_row`` (the whole row), ``_lang, _score``.  A text that is a string column goes
    to the workers once, inside its row."""
    inside = docs.columns.index(text_col) if dict(docs.dtypes).get(text_col) == "string" else None
    beside = [F.col(text_col).cast("string").alias("_text")] if inside is None else []
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *beside)

    def predict(batches):
        if model is not None:
            lookup = np.full(GRAMS, -1, np.int32)
            lookup[model.vocabulary] = np.arange(len(model.vocabulary))
        for batch in batches:
            if inside is not None:
                row = batch.column("_row")
                batch = pa.RecordBatch.from_arrays([row, row.field(inside)], ["_row", "_text"])
            for part in text_slices(batch, "_text", SLICE):
                if model is None:
                    names, score = [UNDETERMINED] * part.num_rows, np.zeros(part.num_rows)
                else:
                    names, score = model.predict(part.column("_text"), lookup)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), pa.array(names, pa.string()), pa.array(score)],
                    ["_row", "_lang", "_score"])
        give_back()

    schema = rows.select("_row").schema.add("_lang", "string").add("_score", "double")
    return rows.mapInArrow(predict, schema)


def predict_language(docs: DataFrame, model: LanguageModel | None, text_col: str = "text",
                     lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """All columns of ``docs`` with the prediction appended; columns that have its names are replaced."""
    others = [F.col(f"_row.`{c}`") for c in docs.columns if c not in (lang_name, score_name)]
    return _predicted(docs, model, text_col).select(
        *others, F.col("_lang").alias(lang_name), F.col("_score").alias(score_name))


def keep_identified(docs: DataFrame, where: Column) -> DataFrame:
    """The rows whose language is recognised, with it in ``lang`` where that was NULL:
    all that have a letter, however short; without any labelled text too, but then
    none gets a language."""
    model = fit_language(docs, where)
    if model is None:
        return _predicted(docs, LanguageModel.blank(), "text").where(F.col("_score") > 0).select("_row.*")
    rows = _predicted(docs, model, "text").where(F.col("_lang") != UNDETERMINED)
    named = F.col("_row").withField("lang", F.coalesce(F.col("_row.lang"), F.col("_lang")))
    return rows.select(named.alias("_row")).select("_row.*")
