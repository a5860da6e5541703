"""Problem 3: the k most similar vectors of every vector.

Multiprobe p-stable hashing: the projections of a unit vector on random Gaussian
directions are cut into cells of one width; the cells of ``functions`` directions
make a bucket of a table. A query visits its own bucket and those next to it, in
the order of their estimated chance of holding a near vector (cells whose border
is closest first). Candidates of all tables are merged; a 128-bit sign sketch
carried in the rows drops the far ones before any vector is fetched, and what is
left is ranked by the exact distance.

The number of directions follows the logarithm of the number of vectors, so a
bucket holds about as many strangers at every size. Buckets that are crowded all the
same are taken out of the index, and their vectors are compared in full: with one another
and with all that would have visited such a bucket, block by block as in the all-pairs
scan, of which a task keeps the k + 1 best of each vector. Equal vectors are one entry of
the index and are expanded at the end, k + 1 to a class.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.blocks import BLOCK_ROWS, block_pairs, matrix, pack
from ..workspace import Workspace

#: Chance that two unrelated unit vectors share a cell of WIDTH, as -log.
_STRANGER = 0.594
WIDTH = 2.4
TABLES = 14
PROBES = 18
#: Vectors of a bucket beyond which its vectors are compared in full.
BUCKET_LIMIT = 4000
#: Rows of a block multiplied at once.
STRIP_ROWS = 256
#: Differing bits of 128 up to which a candidate is kept; at cosine 0.85 the mean is 22.6, the deviation 4.3.
SKETCH_BITS = 41


def probe_order(functions: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of border ranks in the order of their expected squared distance.

    Rank r < functions stands for the r-th closest border, the mirrored rank for
    the far border of the same cell, so a set may hold only one of the two.
    """
    m = functions
    r = np.arange(1, 2 * m + 1)
    near = r * (r + 1) / (4 * (m + 1) * (m + 2))
    far = 1 - (2 * m + 1 - r) / (m + 1) + (2 * m + 1 - r) * (2 * m + 2 - r) / (4 * (m + 1) * (m + 2))
    cost = np.where(r <= m, near, far)
    heap, out = [(float(cost[0]), (0,))], []
    while heap and len(out) < probes:
        c, chosen = heapq.heappop(heap)
        if all(2 * m - 1 - x not in chosen for x in chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (c - cost[last] + cost[last + 1], chosen[:-1] + (last + 1,)))
            heapq.heappush(heap, (c + cost[last + 1], chosen + (last + 1,)))
    return out


def _bucket_keys(unit: np.ndarray, functions: int, tables: int, probes: int, width: float, seed: int) -> np.ndarray:
    """Bucket keys, one row a vector: of each table the own bucket, then the probes."""
    sets = probe_order(functions, probes)
    out = np.empty((len(unit), tables, len(sets) + 1), np.int64)
    for t in range(tables):
        rng = np.random.default_rng((seed, unit.shape[1], t))
        along = rng.standard_normal((unit.shape[1], functions))
        shift = rng.random(functions) * width
        factor = rng.integers(1, 2**62, functions) * 2 + 1
        place = (unit @ along + shift) / width
        cell = np.floor(place)
        inside = place - cell
        own = (cell.astype(np.int64) * factor).sum(axis=1) + rng.integers(1, 2**62)
        ranked = np.argsort(np.concatenate((inside, 1 - inside), axis=1), axis=1)
        out[:, t, 0] = own
        for p, chosen in enumerate(sets, 1):
            key = own.copy()
            for x in chosen:
                border = ranked[:, x]
                key += np.where(border < functions, -1, 1) * factor[border % functions]
            out[:, t, p] = key
    return out


def _sketch(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    along = np.random.default_rng((seed, unit.shape[1], 1 << 20)).standard_normal((unit.shape[1], 128))
    bits = np.packbits(unit @ along > 0, axis=1).view(np.int64)
    return bits[:, 0], bits[:, 1]


def _hash_rows(functions: int, tables: int, probes: int, width: float, seed: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, ends = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            for dim in np.unique(ends):
                rows = np.flatnonzero(ends == dim)
                begin = np.concatenate(([0], np.cumsum(ends)))[rows]
                unit = flat[begin[:, None] + np.arange(dim)]
                for at in range(0, len(rows), 2000):
                    part, u = rows[at : at + 2000], unit[at : at + 2000]
                    keys = _bucket_keys(u, functions, tables, probes, width, seed)
                    salt = batch.column(1).take(pa.array(part)).to_numpy()
                    keys = (keys ^ salt[:, None, None]).reshape(len(part), -1)
                    s1, s2 = _sketch(u, seed)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(part)),
                            pa.array(s1),
                            pa.array(s2),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel())),
                        ],
                        names=["vid", "s1", "s2", "keys"],
                    )

    return hashed


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is of length ``dim``, without NULL or NaN elements and not all zero; cast to double."""
    v = vectors.select("model_id", "item_id", "dim", F.col("vector").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(
        F.col("model_id").isNotNull() & F.col("item_id").isNotNull() & F.col("vector").isNotNull()
        & (F.size("vector") == F.col("dim")) & (F.col("dim") > 0) & finite & F.exists("vector", lambda x: x != 0)
    ).select("model_id", "item_id", "vector")


class _Best:
    """The ``keep`` most similar vectors of each row of a matrix; of equal cosines (6 places) the lower rank is better."""

    def __init__(self, x: np.ndarray, vid: np.ndarray, keep: int, least: float):
        self.x, self.vid, self.keep, self.least = x, vid, keep, least
        self.cosine = np.full((len(x), keep), -np.inf)
        self.rank = np.full((len(x), keep), np.iinfo(np.int64).max)
        self.other = np.zeros((len(x), keep), np.int64)

    def add(self, y: np.ndarray, vid: np.ndarray, rank: np.ndarray) -> None:
        right, keep = np.ascontiguousarray(y.T), self.keep
        for at in range(0, len(self.x), STRIP_ROWS):
            part = self.x[at : at + STRIP_ROWS] @ right
            # a value that rounds to the least one, or to the last one kept, isn't lower by more than this
            cut = np.maximum(self.least, self.cosine[at : at + STRIP_ROWS, -1]) - 1e-6
            some = np.flatnonzero(part >= cut[:, None])
            if len(some) > 8 * (keep + 1) * len(part) and len(y) > keep + 1:
                # one more than are kept, since the vector itself may be among them
                cut = np.maximum(cut, np.partition(part, -(keep + 1), axis=1)[:, -(keep + 1)] - 2e-6)
                some = np.flatnonzero(part >= cut[:, None])
            p, q = np.divmod(some, len(y))
            cosine, p = np.round(part.ravel()[some], 6), p + at
            last, first = self.cosine[p, -1], self.rank[p, -1]
            better = (cosine >= self.least) & (self.vid[p] != vid[q]) & ((cosine > last) | ((cosine == last) & (rank[q] < first)))
            self._merge(p[better], cosine[better], rank[q[better]], vid[q[better]])

    def _merge(self, p: np.ndarray, cosine: np.ndarray, rank: np.ndarray, other: np.ndarray) -> None:
        rows = np.unique(p)
        p = np.concatenate((np.repeat(rows, self.keep), p))
        cosine, rank, other = (np.concatenate((old[rows].ravel(), new)) for old, new in ((self.cosine, cosine), (self.rank, rank), (self.other, other)))
        order = np.lexsort((rank, -cosine, p))
        begin = np.searchsorted(p[order], rows)
        best = order[begin[:, None] + np.arange(self.keep)]
        self.cosine[rows], self.rank[rows], self.other[rows] = cosine[best], rank[best], other[best]

    def rows(self) -> pa.RecordBatch:
        p, k = np.nonzero(self.cosine > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.vid[p]), pa.array(self.other[p, k]), pa.array(self.cosine[p, k])], names=["va", "vb", "cosine"])


def _best_of_blocks(keep: int, least: float):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, None
        for batch in batches:
            dim, block, vid, units, vid_r, rank_r, units_r = batch.columns
            for r in range(batch.num_rows):
                d = dim[r].as_py()
                # a task gets all partners of a block one after another
                if block[r] != at:
                    if now:
                        yield now.rows()
                    now, at = _Best(matrix(units[r], d), vid[r].values.to_numpy(), keep, least), block[r]
                now.add(matrix(units_r[r], d), vid_r[r].values.to_numpy(), rank_r[r].values.to_numpy())
        if now:
            yield now.rows()

    return best


def _compare_crowded(
    work: Workspace, classes: DataFrame, members: DataFrame, index: DataFrame, query: DataFrame, limit: int, keep: int, min_cosine: float, block_rows: int,
) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame | None]:
    """Query and index rows that are still to be joined, and ``(va, vb, cosine)`` of the vectors in or visiting those.

    A vector in a crowded bucket is compared with all in crowded buckets and all that
    visit one, a vector that only visits with all in crowded buckets, so no pair that
    such a bucket would have given is left out. Of each vector the ``keep`` most
    similar come out, more than once if several tasks found them.
    """
    crowded = work.stage(index.groupBy("key").count().where(F.col("count") > limit).select("key"), "crowded")
    if not crowded.limit(1).count():
        return [(query, index)], None
    inside = index.join(crowded, "key", "left_semi").select(F.col("vb").alias("vid"), F.lit(True).alias("crowd"))
    visiting = query.join(crowded, "key", "left_semi").select(F.col("va").alias("vid"), F.lit(False).alias("crowd"))
    chosen = inside.union(visiting).groupBy("vid").agg(F.max("crowd").alias("crowd"))
    # ids that grow with the order of the smallest item ids, which decide between equal cosines
    ranks = members.groupBy("vid").agg(F.min("item_id").alias("head")).join(chosen, "vid").orderBy("head").select("vid", "crowd", F.monotonically_increasing_id().alias("rank"))
    ranks = work.stage(ranks, "ranks")
    blocks = pack(work, classes.select("vid", "model_id", "unit").join(ranks, "vid"), ["model_id", "crowd"], ["vid", "rank"], block_rows)
    pairs = block_pairs(blocks, both=True).where(F.col("crowd") | F.col("crowd_r")).select("dim", "block", "vid", "units", "vid_r", "rank_r", "units_r")
    found = pairs.mapInArrow(_best_of_blocks(keep, min_cosine), "va long, vb long, cosine double")
    found = work.stage(found, "found")
    # what was compared in full isn't looked for again in calm buckets: 2 is in a crowded bucket, 1 visits one, 0 neither
    role = F.coalesce(F.when(F.col("crowd"), 2).otherwise(F.when(~F.col("crowd"), 1)), F.lit(0))
    calm = lambda df, v: df.join(crowded, "key", "left_anti").join(ranks.select(F.col("vid").alias(v), "crowd"), v, "left").withColumn("role", role).drop("crowd")
    query, index = calm(query, "va"), calm(index, "vb")
    rest = [(query.where(f"role = {a}").drop("role"), index.where(f"role <= {b}").drop("role")) for a, b in ((0, 2), (1, 1), (2, 0))]
    return rest, found


def similar_pairs(
    vectors: DataFrame, k: int = 5, min_cosine: float = 0.85, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH,
    functions: int | None = None, bucket_limit: int = BUCKET_LIMIT, seed: int = 7, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(model_id, item_id_a, item_id_b)``, a < b: one is among the k most similar of the other, at ``min_cosine`` or more.

    Only vectors of one ``model_id`` are compared. Unusable vectors (NULL, NaN, zero,
    other length than ``dim``) take no part, repeated rows count once; of several
    vectors of one item and model one is taken, always the same. Cosines are rounded
    to 6 decimals, ties go to the smaller item id. Other columns are ignored.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "neighbours")
    rows = usable_vectors(vectors)
    keyed = rows.select("model_id", "item_id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(11), "vector").alias("h2"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    classes = keyed.groupBy("model_id", "h1", "h2").agg(F.first("vector").alias("vector"))
    classes = classes.withColumn("norm", norm).select(
        F.monotonically_increasing_id().alias("vid"), "model_id", "h1", "h2",
        F.transform("vector", lambda x: x / F.col("norm")).alias("unit"),
    )
    classes = work.stage(classes, "classes")
    members = (
        keyed.groupBy("model_id", "item_id").agg(F.min(F.struct("h1", "h2")).alias("c"))
        .join(classes.select("vid", "model_id", "h1", "h2"), (F.col("c.h1") == F.col("h1")) & (F.col("c.h2") == F.col("h2")) & (classes["model_id"] == keyed["model_id"]))
        .select(keyed["model_id"], "item_id", "vid")
    )
    members = work.stage(members, "members")

    most = classes.groupBy("model_id").count().agg(F.max("count")).first()[0] or 1
    functions = functions or max(6, round(math.log(max(most, 3) / 3) / _STRANGER))
    hashed = classes.select("vid", F.xxhash64("model_id").alias("salt"), "unit").mapInArrow(
        _hash_rows(functions, tables, probes, width, seed), "vid long, s1 long, s2 long, keys array<long>"
    )
    hashed = work.stage(hashed, "hashed")
    step = len(probe_order(functions, probes)) + 1
    own = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.element_at("keys", t * step + 1))
    index = hashed.select(F.posexplode(own).alias("t", "key"), F.col("vid").alias("vb"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    query = hashed.select(F.posexplode("keys").alias("at", "key"), F.col("vid").alias("va"), F.col("s1").alias("a1"), F.col("s2").alias("a2"))
    query = query.select(F.floor(F.col("at") / step).cast("int").alias("t"), "key", "va", "a1", "a2")
    rest, full = _compare_crowded(work, classes, members, index, query, bucket_limit, k + 1, min_cosine, block_rows)
    apart = F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")))
    close = (
        reduce(DataFrame.unionByName, [q.drop("t").join(i.drop("t"), "key") for q, i in rest]).where((F.col("va") != F.col("vb")) & (apart <= SKETCH_BITS))
        .select(F.least("va", "vb").alias("va"), F.greatest("va", "vb").alias("vb"))
        .distinct()
    )
    dot = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = (
        close.join(classes.select(F.col("vid").alias("va"), F.col("unit").alias("ua"), F.col("model_id").alias("ma")), "va")
        .join(classes.select(F.col("vid").alias("vb"), F.col("unit").alias("ub"), F.col("model_id").alias("mb")), "vb")
        .where((F.col("ma") == F.col("mb")) & (F.size("ua") == F.size("ub")))
        .select("va", "vb", F.round(dot, 6).alias("cosine"))
        .where(F.col("cosine") >= min_cosine)
    )
    scored = work.stage(scored, "scored")

    # the k + 1 smallest ids stand for a class: no item needs more of it
    heads = members.withColumn("r", F.row_number().over(Window.partitionBy("vid").orderBy("item_id"))).where(F.col("r") <= k + 1).select("vid", "item_id")
    directed = scored.unionByName(scored.select(F.col("vb").alias("va"), F.col("va").alias("vb"), "cosine"))
    if full is not None:
        directed = directed.unionByName(full).groupBy("va", "vb").agg(F.max("cosine").alias("cosine"))
    itself = heads.groupBy("vid").count().where("count > 1").select(F.col("vid").alias("va"), F.col("vid").alias("vb"), F.lit(1.0).alias("cosine"))
    order = (F.col("cosine").desc(), F.col("other"))
    best = (
        directed.unionByName(itself)
        .join(heads.select(F.col("vid").alias("vb"), F.col("item_id").alias("other")), "vb")
        .withColumn("r", F.row_number().over(Window.partitionBy("va").orderBy(*order)))
        .where(F.col("r") <= k + 1)
        .select(F.col("va").alias("vid"), "other", "cosine")
    )
    return (
        members.join(best, "vid").where(F.col("item_id") != F.col("other"))
        .withColumn("r", F.row_number().over(Window.partitionBy("model_id", "item_id").orderBy(*order)))
        .where(F.col("r") <= k)
        .select("model_id", F.least("item_id", "other").alias("item_id_a"), F.greatest("item_id", "other").alias("item_id_b"))
        .distinct()
    )
