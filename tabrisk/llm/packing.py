"""Best-fit packing by a grouping genetic algorithm with islands.

A solution of a packing problem is a grouping of items into bins.  Crossover
works on whole bins: some well-filled bins of one parent are injected into the
other, every bin of the receiver that shares an item with them is removed, and
the displaced items are put back by best fit (largest first, into the fullest
bin that still takes them).  Mutation dissolves the emptiest bins the same
way.  Fitness is the mean squared fill.

On Spark the items are dealt to shards of bounded size by a hash; every shard
is evolved on several islands, one task each, from different seeds.  After a
round each island keeps its elites and sends its best to the next island of
the shard, as a row; the next round starts from both.  The best solution of a
shard is then taken.  Bins that a shard could not fill are dissolved and
packed again together with those of other shards, level by level, until what
is left fits one shard.  If the lengths do not allow fuller bins, a level
changes little; the bins are then accepted, and only those at most half full
are packed on, as whole items.  No level has larger shards than the first.

Defined results: items of full capacity or more than it are the caller's to
cut (:func:`document_pieces` does); items of length 0 take no room and go to
any bin; ties are broken by the item number; an empty table packs into no bin.
:func:`pack_documents` gives every row its own items, so repeated rows are packed
as often as they occur and NULL identifiers are kept; NULL texts are empty; a very
long text is encoded whole and cut into full pieces; other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabrisk.llm.pieces import give_back, text_slices
from tabrisk.llm.shared import cut
from tabrisk.llm.tokens import encoder

SLICE = 1 << 19      # text bytes encoded at once
SHARD_ITEMS = 4000   # items of one shard (one island's problem)
ISLANDS = 2
ROUNDS = 2
CHILDREN = 16        # crossovers of an island in one round
ELITES = 3
LOW_FILL = 0.98      # bins below this are packed again with other shards'
FEWER_ITEMS = 0.75   # a level that leaves more of its items than this ...
FEWER_BINS = 0.99    # ... and more of the bins they were in than this ends the levels


def _best_fit(lengths: np.ndarray, items: np.ndarray, fills: list[int], assign: np.ndarray, capacity: int) -> None:
    """Put ``items`` (in this order) into ``fills``/``assign`` by best fit."""
    room = sorted((capacity - f, b) for b, f in enumerate(fills) if f < capacity)
    for i in items.tolist():
        need = int(lengths[i])
        at = bisect.bisect_left(room, (need, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(fills)
            fills.append(0)
        fills[b] += need
        assign[i] = b
        if left > need:
            bisect.insort(room, (left - need, b))


def _renumber(assign: np.ndarray) -> np.ndarray:
    return np.unique(assign, return_inverse=True)[1].astype(np.int32)


def fitness(lengths: np.ndarray, assign: np.ndarray, capacity: int) -> float:
    """Mean squared fill of the bins (higher is better, 1 is perfect)."""
    fills = np.bincount(assign, weights=lengths)
    return float(np.mean((fills / capacity) ** 2)) if len(fills) else 1.0


def _largest_first(lengths: np.ndarray, items: np.ndarray, rng=None, noise: float = 0.0) -> np.ndarray:
    size = lengths[items].astype(float)
    if noise:
        size = size * (1 + noise * rng.standard_normal(len(items)))
    return items[np.argsort(-size, kind="stable")]


def greedy(lengths: np.ndarray, capacity: int, rng=None, noise: float = 0.0) -> np.ndarray:
    assign = np.full(len(lengths), -1, np.int32)
    _best_fit(lengths, _largest_first(lengths, np.arange(len(lengths)), rng, noise), [], assign, capacity)
    return assign


def crossover(lengths: np.ndarray, taker: np.ndarray, giver: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Inject whole well-filled bins of ``giver`` into ``taker``."""
    fills = np.bincount(giver, weights=lengths)
    well = np.flatnonzero(fills >= np.quantile(fills, 0.5))
    chosen = rng.choice(well, max(1, len(well) // 8), replace=False)
    is_chosen = np.zeros(len(fills), bool)
    is_chosen[chosen] = True
    injected = is_chosen[giver]
    hit = np.zeros(int(taker.max()) + 1, bool)
    hit[taker[injected]] = True
    fill_taker = np.bincount(taker, weights=lengths, minlength=len(hit))
    low = np.argsort(fill_taker)[:2 + rng.integers(4)]  # mutation: the emptiest bins go too
    hit[low] = True
    displaced = np.flatnonzero(hit[taker] & ~injected)
    child = np.where(injected, giver + len(hit), taker)
    child[displaced] = -1
    kept = np.flatnonzero(child >= 0)
    out = np.full(len(lengths), -1, np.int32)
    out[kept] = _renumber(child[kept])
    fills = np.bincount(out[kept], weights=lengths[kept]).astype(np.int64).tolist()
    _best_fit(lengths, _largest_first(lengths, displaced, rng, 0.05), fills, out, capacity)
    return out


def evolve(lengths: np.ndarray, capacity: int, seeds: list[np.ndarray], rng, children: int = CHILDREN,
           elites: int = ELITES) -> list[np.ndarray]:
    """Best solutions of one island, best first."""
    if not len(lengths):
        return [np.zeros(0, np.int32)]
    population = [*seeds]
    if not population:
        population.append(greedy(lengths, capacity))
    while len(population) < elites + 1:
        population.append(greedy(lengths, capacity, rng, 0.1))
    scored = sorted(((-fitness(lengths, a, capacity), i, a) for i, a in enumerate(population)), key=lambda x: x[:2])
    least = -(-int(lengths.sum()) // capacity)
    for n in range(children):
        if int(scored[0][2].max()) + 1 <= least:
            break
        a, b = rng.choice(len(scored), 2, replace=False)
        child = crossover(lengths, scored[a][2], scored[b][2], capacity, rng)
        scored.append((-fitness(lengths, child, capacity), len(population) + n, child))
        scored.sort(key=lambda x: x[:2])
        scored = scored[:2 * elites]
    return [a for _, _, a in scored[:elites]]


def _seed(*parts) -> np.random.Generator:
    return np.random.default_rng([int(p) & 0x7FFFFFFF for p in parts])


def _evolve_shards(items: DataFrame, capacity: int, islands: int, rounds: int, seed: int) -> DataFrame:
    """``item, length, _shard, _bin, _at, _fill, _first`` for ``item, length, _shard``; one row of a bin is ``_first``."""
    schema = "_shard bigint, _island int, _rank int, _score double, _assign binary"
    dealt = items.withColumn("_island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    elites = items.sparkSession.createDataFrame([], schema)

    def island_round(number: int):
        def island(key, own, arrived):
            lengths = own.sort_values("item")["length"].to_numpy(np.int64)
            start = [np.frombuffer(a, np.int32) for a in arrived.sort_values(["_score", "_rank"])["_assign"]]
            best = evolve(lengths, capacity, start, _seed(seed, key[0], key[1], number))
            return pd.DataFrame({"_shard": key[0], "_island": key[1], "_rank": range(len(best)),
                                 "_score": [-fitness(lengths, a, capacity) for a in best],
                                 "_assign": [a.astype(np.int32).tobytes() for a in best]})

        return island

    for number in range(rounds):
        move = F.when(F.col("_rank") == 0, F.array(F.col("_island"), (F.col("_island") + 1) % islands)).otherwise(
            F.array(F.col("_island")))
        arrived = elites.withColumn("_island", F.explode(F.array_distinct(move)))
        elites = (dealt.groupBy("_shard", "_island").cogroup(arrived.groupBy("_shard", "_island"))
                  .applyInPandas(island_round(number), schema))
    best = elites.where(F.col("_rank") == 0).groupBy("_shard").agg(
        F.min_by(F.struct("_assign"), F.struct("_score", "_island")).alias("_best")).select("_shard", "_best._assign")

    def place(key, own, best):
        own = own.sort_values("item").reset_index(drop=True)
        own["_bin"] = np.frombuffer(best["_assign"].iloc[0], np.int32).astype(np.int64)
        own["_at"] = own.groupby("_bin")["length"].cumsum() - own["length"]
        own["_fill"] = own.groupby("_bin")["length"].transform("sum")
        own["_first"] = ~own["_bin"].duplicated()
        return own[["item", "length", "_shard", "_bin", "_at", "_fill", "_first"]]

    return (items.groupBy("_shard").cogroup(best.groupBy("_shard")).applyInPandas(
        place, "item bigint, length bigint, _shard bigint, _bin bigint, _at bigint, _fill bigint, _first boolean"))


def pack(items: DataFrame, capacity: int, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS,
         rounds: int = ROUNDS, seed: int = 0, level: int = 0) -> DataFrame:
    """``item, length`` (unique items, lengths up to ``capacity``) -> ``item,
    sequence_id, offset``; offsets of a sequence are gapless from 0.  Sequences
    are numbered from ``level`` on."""
    todo = items.select(F.col("item").cast("bigint").alias("item"), F.col("length").cast("bigint").alias("length"))
    out = "item", "sequence_id", F.col("_at").alias("offset")
    low, half = F.col("_fill") < LOW_FILL * capacity, 2 * F.col("_fill") <= capacity
    done, left, bins = None, todo.count(), None
    while True:
        shards = max(1, -(-left // shard_items))
        dealt = todo.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + level), "item"), F.lit(shards)))
        placed = cut(_evolve_shards(dealt, capacity, islands, rounds, seed + level))
        placed = placed.withColumn("sequence_id", F.lit(level << 56) + F.shiftleft("_shard", 20) + F.col("_bin"))
        level += 1
        first, before = F.col("_first"), left
        left, used, low_bins, half_bins = placed.agg(
            F.count_if(low), F.count_if(first), F.count_if(first & low), F.count_if(first & half)).first()
        # a level goes on with a quarter fewer items, or with a hundredth fewer bins than best fit's
        # few per cent above the bound, so the number of levels is bounded by the logarithm of the items
        ends = bins is not None and left > FEWER_ITEMS * before and used > FEWER_BINS * bins
        if shards == 1 or not left:
            full = placed.select(*out)
        elif not ends:
            full = placed.where(~low).select(*out)
        elif half_bins > 1 and 2 * half_bins <= before:
            # best fit leaves about one such bin a shard; they go on as items
            whole = pack(placed.where(half & first).select(F.col("sequence_id").alias("item"), F.col("_fill").alias("length")),
                         capacity, shard_items, islands, rounds, seed, level)
            moved = placed.where(half).select("item", F.col("sequence_id").alias("_from"), "_at").join(
                whole.withColumnRenamed("item", "_from"), "_from")
            full = placed.where(~half).select(*out).unionByName(
                moved.select("item", "sequence_id", (F.col("offset") + F.col("_at")).alias("offset")))
        else:
            full = placed.select(*out)
        done = full if done is None else done.unionByName(full)
        if shards == 1 or not left or ends:
            return done
        todo, bins = placed.where(low).select("item", "length"), low_bins


def document_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``item, doc_id, piece, start, length, ids_crc32``: every document's ids
    (with the end id) cut into pieces of ``capacity``, the last may be shorter.
    NULL text is empty; ``item`` numbers the pieces of the table."""

    def pieces(batches):
        from pyspark import TaskContext

        item = TaskContext.get().partitionId() << 40
        enc = encoder(vocabulary)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for part in text_slices(batch, "_text", SLICE):
                ids, bounds = enc.encode(part.column("_text"))
                rows = []
                for key, a, b in zip(part.column("_id").to_pylist(), bounds[:-1], bounds[1:]):
                    own = np.concatenate([ids[a:b], end]).astype("<u4")
                    for n, at in enumerate(range(0, len(own), capacity)):
                        cut_out = own[at:at + capacity]
                        rows.append((item, key, n, at, len(cut_out), zlib.crc32(cut_out.tobytes())))
                        item += 1
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["item", "doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(pieces, "item bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per piece of a document, with the sequence and the place it goes to."""
    pieces = cut(document_pieces(docs, vocabulary, end_id, capacity, id_col, text_col))
    whole = pieces.where(F.col("length") == capacity).select(
        "*", (F.lit(-1) - F.col("item")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    partial = pieces.where(F.col("length") < capacity)
    packed = partial.join(pack(partial.select("item", "length"), capacity), "item").select(*whole.columns)
    return whole.unionByName(packed).drop("item")
