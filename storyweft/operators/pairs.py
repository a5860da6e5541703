"""Exhaustive pair scoring.

``score_pairs`` compares every pair in blocks: the vectors are packed into blocks of
bounded size, and each pair of blocks is two matrices that BLAS multiplies. The product
is one of single precision, which only drops what is below the threshold by more than its
error; the rest is scored in double. No side is broadcast or shuffled for the pairs and
no pair below the threshold leaves a task, so neither the memory of a task nor the disk
depends on the number of pairs compared.
``score_pairs_sql`` is the same as one join, for small inputs and as a check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..workspace import Workspace
from .blocks import BLOCK_ROWS, block_pairs, matrix, pack
from .ranking import numbered

#: Rows of a block multiplied at once, and pairs scored at once.
STRIP_ROWS, STRIP_PAIRS = 512, 1 << 16


def majority_dim(vectors: DataFrame) -> DataFrame:
    """``(model_id, dim)``: the most frequent length of each model; of equals the larger."""
    sizes = vectors.where(F.col("vector").isNotNull()).groupBy("model_id", F.size("vector").alias("dim")).count()
    return sizes.groupBy("model_id").agg(F.max_by("dim", F.struct("count", "dim")).alias("dim"))


def comparable(vectors: DataFrame) -> DataFrame:
    """``(model_id, item_id, unit)``: one vector of an item and model, of the model's usual length, as a unit vector.

    NULL vectors and those with NULL or NaN elements are left out.
    """
    clean = vectors.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)))
    usual = clean.join(majority_dim(clean), "model_id").where(F.size("vector") == F.col("dim")) if "dim" not in clean.columns else clean.drop("dim").join(majority_dim(clean), "model_id").where(F.size("vector") == F.col("dim"))
    one = usual.groupBy("model_id", "item_id").agg(F.min("vector").alias("vector"))
    return one.select("model_id", "item_id", V.unit(F.col("vector").cast("array<double>")).alias("unit"))


def _near(x: np.ndarray, y: np.ndarray, same: bool, floor: float, nan: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``x`` and ``y`` and score of the pairs of unit vectors scoring ``floor`` or more; of ``same`` blocks each pair once."""
    # more than what single precision and the rounding of the score can take away
    low = np.float32(floor - 1e-6 - (x.shape[1] + 8) * 2.0**-22)
    left, right = x.astype(np.float32), np.ascontiguousarray(y.astype(np.float32).T)
    for at in range(0, len(x), STRIP_ROWS):
        part = left[at : at + STRIP_ROWS] @ right
        some = np.flatnonzero(~(part < low) if nan else part >= low)
        for k in range(0, len(some), STRIP_PAIRS):
            p, q = np.divmod(some[k : k + STRIP_PAIRS], len(y))
            p += at
            if same:
                p, q = p[p < q], q[p < q]
            score = np.round(np.einsum("ij,ij->i", x[p], y[q]), 6)
            keep = ~(score < floor) if nan else score >= floor
            if keep.any():
                yield p[keep], q[keep], score[keep]


def score_pairs(rows: DataFrame, floor: float, block_rows: int = BLOCK_ROWS, nan: bool = False) -> DataFrame:
    """``(model_id, a, b, score)``, a < b, of all pairs of one model scoring ``floor`` or more (6 places).

    With ``nan`` also those that have no score, as of vectors with infinite elements: SQL takes NaN for more than any number.
    """
    blocks = pack(Workspace(rows.sparkSession, "pairs"), rows, ["model_id"], ["item_id"], block_rows)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, dim, block, ids, units, block_r, ids_r, units_r = batch.columns
            for r in range(batch.num_rows):
                d, one, two = dim[r].as_py(), ids[r].values, ids_r[r].values
                for p, q, score in _near(matrix(units[r], d), matrix(units_r[r], d), block[r] == block_r[r], floor, nan):
                    a, b = one.take(pa.array(p)), two.take(pa.array(q))
                    first = pc.less(a, b)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([model[r].as_py()] * len(p), pa.string()), pc.if_else(first, a, b), pc.if_else(first, b, a), pa.array(score)], names=["model_id", "a", "b", "score"]
                    )

    kind = rows.schema["item_id"].dataType.simpleString()
    paired = block_pairs(blocks).select("model_id", "dim", "block", "item_id", "units", "block_r", "item_id_r", "units_r")
    return paired.mapInArrow(multiply, f"model_id string, a {kind}, b {kind}, score double")


def score_pairs_sql(rows: DataFrame, floor: float) -> DataFrame:
    """``score_pairs`` as an expression over a join within each model."""
    a, b = rows.alias("x"), rows.alias("y")
    joined = a.join(b, (F.col("x.model_id") == F.col("y.model_id")) & (F.col("x.item_id") < F.col("y.item_id")))
    score = F.round(V.dot(F.col("x.unit"), F.col("y.unit")), 6)
    return joined.select("x.model_id", F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b"), score.alias("score")).where(F.col("score") >= floor)


def route(pairs: DataFrame, tau_low: float, tau_high: float, floor: float) -> DataFrame:
    """Pairs with three flags: linked, borderline, and sample, which overlaps the other two."""
    s = F.col("score")
    return pairs.withColumns({"linked": s >= tau_high, "borderline": (s >= tau_low) & (s < tau_high), "sample": s >= floor})


def with_items(pairs: DataFrame, items: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with the given columns of both items, as ``a_<column>`` and ``b_<column>``."""
    side = lambda k: items.select(F.col("id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in columns])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def rank_pairs(pairs: DataFrame, by: str = "outlet_a") -> DataFrame:
    """Rank of each pair of a group by descending score, then by its ids."""
    return numbered(pairs.withColumn("_tie", F.concat("a", F.lit(" "), "b")), by, "score", "_tie", "rank").drop("_tie")
