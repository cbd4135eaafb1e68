"""Near-duplicate embeddings by iterative quantisation.

1. A rotation is learnt from a bounded sample (principal axes, then alternating
   between signs and the orthogonal Procrustes solution), so that the signs of
   the rotated vectors are balanced bits.  The vectors are not centred first:
   planes through the origin are what makes a bit's chance to differ depend on
   the angle alone, and a cluster that dominates the sample would otherwise
   take the centre and get random codes.  More bits than dimensions come from
   further rotations with other starts.
2. The code is cut into tables of ``width`` bits each; two vectors meet if they
   agree in all bits of one table (any two codes whose distance is less than
   the number of tables do).  ``width`` follows the size of the largest label,
   so buckets stay small, and the number of tables follows from it so that a
   pair at the threshold is found with probability ``1 - miss`` (bits differ
   independently with probability angle/pi, what sign codes give; learnt
   rotations do better).
3. Vectors that meet are compared in double precision with the original
   vectors, a matrix product for each bucket.

Equal vectors are one entry with a number of copies.  A bucket is split into
chunks, and pairs of chunks are separate tasks, so a label or a cluster with a
third of all vectors is worked on by many.  A pair that meets in several tables
counts in the first.  What leaves a bucket is a count per vector and the links
of a spanning forest, never the pairs.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite
components, and vectors without a label, link with nothing (not even with
copies); vectors of different lengths are never compared; a NULL identifier
takes part but names a component only if all its members' are NULL; repeated
rows are vectors like any other; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrisk.llm.components import connected_components
from tabrisk.llm.shared import cut

THRESHOLD = 0.93
SAMPLE = 5000      # vectors the rotations are learnt from
MISS = 0.005       # chance that a pair at the threshold shares no table
FILL = 64          # entries aimed at in a bucket
CHUNK = 512        # entries of one chunk of a bucket
ITERATIONS = 30


def learn_rotations(sample: np.ndarray, bits: int, seed: int = 0) -> np.ndarray:
    """dimension x bits, by iterative quantisation on the principal axes."""
    x = sample
    _, axes = np.linalg.eigh(x.T @ x + 1e-9 * np.eye(x.shape[1]))
    axes = axes[:, ::-1]
    x = x @ axes
    rng = np.random.default_rng(seed)
    made = []
    while sum(r.shape[1] for r in made) < bits:
        turn = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
        for _ in range(ITERATIONS if len(x) else 0):
            u, _, v = np.linalg.svd(np.where(x @ turn >= 0, 1.0, -1.0).T @ x)
            turn = (u @ v).T
        made.append(axes @ turn)
    return np.concatenate(made, 1)[:, :bits]


def tables_for(largest: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(width, tables) for a largest label of so many distinct vectors."""
    width = min(30, max(4, math.ceil(math.log2(max(1, largest) / FILL)) if largest > FILL else 4))
    meet = (1 - math.acos(threshold) / math.pi) ** width
    return width, math.ceil(math.log(miss) / math.log(1 - meet))


def _usable(column: str):
    v = F.col(column)
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda e: e != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    peak = np.abs(x).max(1, keepdims=True) if x.size else 1.0
    x = x / peak  # no overflow or underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _bucket_keys(entries: DataFrame, turn: np.ndarray, width: int, tables: int) -> DataFrame:
    """``entry, label, vec`` -> a row for each table: ``table, bucket`` and the vector with its keys."""
    def hashed(batches):
        power = 1 << np.arange(width)
        for batch in batches:
            x = _unit(_matrix(batch.column("vec")))
            keys = ((x @ turn) >= 0).reshape(len(x), tables, width) @ power
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(keys.astype(np.int32)), pa.list_(pa.int32()))],
                [*batch.schema.names, "keys"])

    text = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema)
    coded = entries.mapInArrow(hashed, text + ", keys array<int>")
    return coded.select("*", F.posexplode("keys").alias("table", "bucket"))


def _forest(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what ``hit`` (left x right) connects: (node, smallest)."""
    label_l, label_r = left.copy(), right.copy()
    rows, cols = np.nonzero(hit)
    while len(rows):
        low = np.minimum(label_l[rows], label_r[cols])
        new_l, new_r = label_l.copy(), label_r.copy()
        np.minimum.at(new_l, rows, low)
        np.minimum.at(new_r, cols, low)
        if (new_l == label_l).all() and (new_r == label_r).all():
            break
        label_l, label_r = new_l, new_r
    node = np.concatenate([left, right])
    label = np.concatenate([label_l, label_r])
    keep = node != label
    pairs = np.unique(np.stack([node[keep], label[keep]], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _compare(threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        """One pair of chunks of one bucket (or one chunk with itself)."""
        number = table.column("table")[0].as_py()
        one = table.column("chunk").to_numpy()
        entry = table.column("entry").to_numpy()
        copies = table.column("copies").to_numpy().astype(np.int64)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        x = _unit(_matrix(table.column("vec")))
        keys = np.array(table.column("keys").to_pylist(), np.int32)
        a, b = np.flatnonzero(one == i), np.flatnonzero(one == j)
        hit = x[a] @ x[b].T >= threshold
        for t in range(number):  # met in an earlier table: counted there
            hit &= keys[a, t][:, None] != keys[b, t][None, :]
        if i == j:
            np.fill_diagonal(hit, False)
        count = np.zeros(len(entry), np.int64)
        count[a] += hit @ copies[b]
        if i != j:
            count[b] += hit.T @ copies[a]
        node, low = _forest(hit, entry[a], entry[b])
        some = np.flatnonzero(count)
        return pa.table({"entry": pa.array(np.concatenate([entry[some], node]), pa.int64()),
                         "linked": pa.array(np.concatenate([np.full(len(some), -1), low]), pa.int64()),
                         "n": pa.array(np.concatenate([count[some], np.zeros(len(node), np.int64)]), pa.int64())})

    return compare


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label", sample: int = SAMPLE,
                    miss: float = MISS, chunk: int = CHUNK) -> DataFrame:
    """``<id>, n_links, component_id, kept`` of every row."""
    spark = vectors.sparkSession
    usable = _usable("vec") & F.col("label").isNotNull()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                          F.col(vector_col).alias("vec")).select(
        "id", "label", F.when(usable, F.transform("vec", lambda e: e.cast("double") + F.lit(0.0))).alias("vec"))
    # equal vectors of a label are one entry (the digest of the components tells them apart)
    rows = rows.withColumn("code", F.when(F.col("vec").isNotNull(), F.sha2(F.concat_ws(
        "|", F.col("label").cast("string"), F.transform("vec", lambda e: e.cast("string"))), 256)))
    classes = cut(rows.where(F.col("vec").isNotNull()).groupBy("code").agg(
        F.first("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"),
        F.min("id").alias("least")).withColumn("entry", F.monotonically_increasing_id()))
    sizes = classes.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()  # distinct lengths
    found = None
    for row in sizes:
        same = classes.where(F.size("vec") == row["d"])
        largest = same.groupBy("label").count().agg(F.max("count")).first()[0]
        width, tables = tables_for(largest, threshold, miss)
        drawn = same.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(sample).toArrow()
        turn = learn_rotations(_unit(_matrix(drawn.column("vec"))), width * tables)
        coded = cut(_bucket_keys(same.select("entry", "label", "copies", "vec"), turn, width, tables))
        place = ["label", "table", "bucket"]
        often = coded.groupBy(*place).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1).select(
            *place, F.ceil(F.col("k") / chunk).cast("int").alias("parts"))
        met = coded.join(often, place).withColumn("chunk", F.pmod(F.xxhash64("entry"), F.col("parts")).cast("int"))
        # a chunk meets itself and every other chunk of its bucket
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
        pairs = met.select("*", other).select(
            *place, "entry", "copies", "vec", "keys", "chunk",
            F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
        part = pairs.groupBy(*place, "i", "j").applyInArrow(_compare(threshold), "entry bigint, linked bigint, n bigint")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "entry bigint, linked bigint, n bigint")
    found = cut(found)
    counts = found.groupBy("entry").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where(F.col("linked") >= 0).select(
        F.col("entry").alias("a"), F.col("linked").alias("b")))
    entries = (classes.select("entry", "code", "copies", "least")
               .join(counts, "entry", "left").join(parts.withColumnRenamed("node", "entry"), "entry", "left")
               .withColumn("component", F.coalesce("component", "entry")))
    names = entries.groupBy("component").agg(F.min("least").alias("component_id"))
    entries = entries.join(names, "component").select(
        F.col("code").alias("_code"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    joined = rows.select("id", "code").join(entries, F.col("code") == F.col("_code"), "left")
    component = F.when(F.col("_code").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                         component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
