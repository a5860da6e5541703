"""Vectors packed into blocks, and every pair of blocks as one row.

A block is one row: the ids of up to ``block_rows`` vectors and their matrix as bytes.
The blocks are a stage in the shared folder, written once; a pair of blocks is a row of
their Cartesian product, whose tasks read the stage again. So no vector is shuffled or
copied to disk a second time, however many vectors there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..workspace import Workspace

#: Vectors of a block: 4 MB of 64 doubles.
BLOCK_ROWS = 8192
#: Blocks' worth of vectors that a task that packs holds at most.
OPEN_BLOCKS = 4


def _packer(keys: int, block_rows: int, schema: pa.Schema):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting, rows = {}, 0

        def blocks(of, least):
            nonlocal number, rows
            parts, n = waiting[of]
            ids = [pa.concat_arrays(c) for c in zip(*(p[0] for p in parts))]
            units = np.concatenate([p[1] for p in parts])
            at = 0
            while n - at >= least and at < n:
                units_ = np.ascontiguousarray(units[at : at + block_rows])
                lists = [pa.ListArray.from_arrays(pa.array([0, len(units_)], pa.int32()), c.slice(at, len(units_))) for c in ids]
                values = [*[pa.array([k]) for k in of], pa.array([number]), *lists, pa.array([units_.tobytes()])]
                yield pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, schema)], schema=schema)
                number, at, rows = number + 1, at + len(units_), rows - len(units_)
            waiting[of] = ([([c.slice(at) for c in ids], units[at:])], n - at)
            if at == n:
                del waiting[of]

        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat, ends = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            begin = np.concatenate(([0], np.cumsum(ends)))
            of = list(zip(*(batch.column(k).to_pylist() for k in range(keys)), ends.tolist()))
            groups: dict[tuple, list[int]] = {}
            for i, g in enumerate(of):
                groups.setdefault(g, []).append(i)
            for g, places in groups.items():
                here = np.array(places)
                ids = [batch.column(k).take(pa.array(here)) for k in range(keys, batch.num_columns - 1)]
                parts, n = waiting.get(g, ([], 0))
                waiting[g] = (parts + [(ids, flat[begin[here][:, None] + np.arange(g[-1])])], n + len(here))
                rows += len(here)
                if waiting[g][1] >= block_rows:
                    yield from blocks(g, block_rows)
            if rows > OPEN_BLOCKS * block_rows:
                for g in list(waiting):
                    yield from blocks(g, 1)
        for g in list(waiting):
            yield from blocks(g, 1)

    return packed


def pack(work: Workspace, rows: DataFrame, keys: list[str], ids: list[str], block_rows: int) -> DataFrame:
    """Stage of blocks of ``rows`` (``keys``, ``ids``, and an array of doubles ``unit``).

    Columns: the keys, ``dim``, ``block`` (a number of its own), an array for each of ``ids``, and ``units``.
    The vectors of a block have the same keys and length; blocks are of one partition, so none is shuffled.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    fields = [T.StructField(k, kinds[k]) for k in keys] + [T.StructField("dim", T.IntegerType()), T.StructField("block", T.LongType())]
    fields += [T.StructField(i, T.ArrayType(kinds[i])) for i in ids] + [T.StructField("units", T.BinaryType())]
    shape = T.StructType(fields)
    return work.stage(rows.select(*keys, *ids, "unit").mapInArrow(_packer(len(keys), block_rows, to_arrow_schema(shape)), shape), "blocks")


def block_pairs(blocks: DataFrame, both: bool = False) -> DataFrame:
    """Pairs of blocks of one model and length, the columns of the second with ``_r``; once each, or with ``both`` in either order too.

    Which order a pair has is drawn from its numbers, so the tasks of the product have alike work.
    """
    right = blocks.select([F.col(c).alias(f"{c}_r") for c in blocks.columns])
    alike = (F.col("model_id") == F.col("model_id_r")) & (F.col("dim") == F.col("dim_r"))
    if not both:
        drawn = F.pmod(F.xxhash64(F.least("block", "block_r"), F.greatest("block", "block_r")), F.lit(2)) == 0
        alike = alike & ((F.col("block") == F.col("block_r")) | ((F.col("block") < F.col("block_r")) == drawn))
    # never a broadcast: neither side has a bound
    return blocks.join(right.hint("shuffle_replicate_nl"), alike)


def matrix(units: pa.Scalar, dim: int) -> np.ndarray:
    return np.frombuffer(units.as_buffer(), np.float64).reshape(-1, dim)
