"""Problem 8: long stretches that stand verbatim in more than one text.

Spans slide over the sentence borders of every text: half the asked length is
hashed forwards from each border, and backwards where the sentence before it is
that long. A stretch of the asked length with a border inside holds one of the
two whole, at the same place in every text it occurs in; inside a sentence
longer than the stretch the smallest hash of each window takes the border's
part. So no shared stretch is missed, which runs of whole sentences can't
promise: 200 characters often hold no whole sentence.

The hashes are joined globally. Around the spans found in two texts the windows
of full length are compared, one span's occurrences at a time and never pair by
pair; spans that very many texts share are first reduced to their distinct
surroundings, then counted window by window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_32 = np.uint64(32)
#: Characters worked on at a time in a worker.
CHUNK = 1_000_000
#: Occurrences of a span up to which one task compares their windows.
GROUP_LIMIT = 20_000

#: Signs that end a sentence before white space or a closing sign, and those that end it alone.
_ENDS, _AFTER, _ENDS_ALONE = ".!?", " \t\r\n\"'<\\”’)", "。！？"


def _table() -> np.ndarray:
    flags = np.zeros(65536, np.uint8)
    for signs, bit in ((_ENDS, 1), (_AFTER, 2), (_ENDS_ALONE, 4), ("\n", 8)):
        flags[[ord(c) for c in signs]] |= bit
    return flags


_FLAGS = _table()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(0x51ED2701)) * _MIX
    x ^= x >> _32
    x *= _MIX
    x ^= x >> _32
    return x


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 2**64))


def rolling(values: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of every run of ``length`` values, by doubling."""
    if len(values) < length:
        return np.zeros(0, np.uint64)
    part, size, out, done = values, 1, None, 0
    while True:
        if length & size:
            if out is None:
                out, done = part, size
            else:
                m = len(values) - done - size + 1
                out = out[:m] * _power(size) + part[done : done + m]
                done += size
        if size * 2 > length:
            return out
        m = len(values) - 2 * size + 1
        part = part[:m] * _power(size) + part[size : size + m]
        size *= 2


def _borders(codes: np.ndarray) -> np.ndarray:
    """Positions at which a sentence begins, judged by the two characters around each."""
    flags = _FLAGS[np.minimum(codes, 65535)]
    prev, nxt = flags[:-1], flags[1:]
    stop = ((prev & 1) > 0) & ((nxt & 2) > 0) | ((prev & 4) > 0) | (((prev & 8) > 0) & ((nxt & 8) == 0))
    return np.flatnonzero(stop) + 1


def span_starts(codes: np.ndarray, ends: np.ndarray, hashes: np.ndarray, half: int) -> np.ndarray:
    """Starts of the spans of ``half`` characters, over texts laid end to end; ``ends`` are their ends."""
    full = 2 * half
    begins = np.concatenate(([0], ends[:-1]))
    edges = np.unique(np.concatenate((_borders(codes), begins, ends)))
    owner = np.searchsorted(ends, edges, side="right")
    inner = edges[(edges < len(codes)) & ~np.isin(edges, begins)]
    inner_end = ends[np.searchsorted(ends, inner, side="right")]
    heads = inner[inner + half <= inner_end]
    gap_before = inner - edges[np.searchsorted(edges, inner) - 1]
    tails = inner[gap_before >= half] - half
    found = [heads, tails]
    del owner
    lengths = np.diff(edges)
    for k in np.flatnonzero(lengths >= full):
        a, b = edges[k], edges[k + 1]
        runs = np.lib.stride_tricks.sliding_window_view(hashes[a : b - half + 1], half + 1)
        for at in range(0, len(runs), 20_000):
            block = runs[at : at + 20_000]
            found.append(a + at + np.arange(len(block)) + block.argmin(axis=1))
    starts = np.unique(np.concatenate(found))
    end_of = ends[np.searchsorted(ends, starts, side="right")]
    size_of = end_of - begins[np.searchsorted(ends, starts, side="right")]
    return starts[size_of >= full]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK characters together."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _scan_spans(half: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts):
                part = [t or "" for t in texts[a:b]]
                codes = _codes("".join(part))
                ends = np.cumsum([len(t) for t in part], dtype=np.int64)
                filled = np.flatnonzero(np.diff(ends, prepend=0) > 0)
                if not len(filled):
                    continue
                ends = ends[filled]
                hashes = rolling(_mixed(codes), half)
                starts = span_starts(codes, ends, hashes, half)
                k = np.searchsorted(ends, starts, side="right")
                begins = np.concatenate(([0], ends[:-1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[starts].view(np.int64)), batch.column(0).take(pa.array(filled[k] + a)), pa.array((starts - begins[k]).astype(np.int32))],
                    names=["h", "doc_id", "pos"],
                )

    return scan


def _cut_around(half: int):
    """Text around each span of a document, as far as a window that holds the span can reach."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, h, hot, start, around = [], [], [], [], []
            for i, (text, spans) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for s in spans:
                    low = max(0, s["pos"] - half)
                    take.append(i)
                    h.append(s["h"])
                    hot.append(s["hot"])
                    start.append(low)
                    around.append(text[low : s["pos"] + 2 * half])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(hot, pa.bool_()), batch.column(0).take(pa.array(take, pa.int64())), pa.array(start, pa.int32()), pa.array(around, pa.string())],
                names=["h", "hot", "doc_id", "start", "around"],
            )

    return cut


def _windows(h: np.ndarray, around: list[str], full: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of ``full`` characters in the surroundings: its row, its offset, its hash mixed with the span's."""
    codes = _codes("".join(around))
    sizes = np.array([len(t) for t in around], np.int64)
    ends = np.cumsum(sizes)
    counts = np.maximum(sizes - full + 1, 0)
    row = np.repeat(np.arange(len(around)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    hashes = rolling(_mixed(codes), full)
    w = hashes[(ends - sizes)[row] + offset] if len(row) else np.zeros(0, np.uint64)
    return row, offset, (w ^ (h[row] * _MIX)) * _MIX


def _compare_groups(full: int):
    """Rows sorted by span: windows that occur in two documents, as ranges of characters."""

    def flush(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(tables).combine_chunks()
        h = t.column(0).to_numpy().view(np.uint64)
        start = t.column(2).to_numpy()
        ids = t.column(1).combine_chunks()
        doc = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        row, offset, w = _windows(h, t.column(3).to_pylist(), full)
        order = np.lexsort((doc[row], w))
        ws, ds = w[order], doc[row][order]
        new = np.flatnonzero(np.concatenate(([True], ws[1:] != ws[:-1]))) if len(ws) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(ws)) - 1
        group = np.repeat(np.arange(len(new)), last - new + 1)
        shared = np.zeros(len(ws), bool)
        shared[order] = (ds[new] != ds[last])[group] if len(ws) else False
        row, offset = row[shared], offset[shared]
        # windows of one row that touch become one range
        first = np.concatenate(([True], (row[1:] != row[:-1]) | (offset[1:] > offset[:-1] + full))) if len(row) else np.zeros(0, bool)
        at = np.flatnonzero(first)
        to = np.append(at[1:], len(row)) - 1 if len(at) else at
        r = row[at]
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(r)), pa.array((start[r] + offset[at]).astype(np.int64)), pa.array((start[r] + offset[to] + full).astype(np.int64))],
            names=["doc_id", "span_start", "span_end"],
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, 8192)
                at += part.num_rows
                if rows >= 8192:
                    # the held rows may go once the span they end with is complete
                    h, end = part.column(0).to_numpy(), held[-1].column(0)[-1].as_py()
                    same = int(np.searchsorted(h != end, True)) if (h != end).any() else len(h)
                    if same:
                        held.append(part.slice(0, same))
                    if same < len(h):
                        yield flush(held)
                        held, rows = [part.slice(same)], len(h) - same
                        continue
                    rows += same
                    continue
                held.append(part)
                rows += part.num_rows
        if held:
            yield flush(held)

    return compare


def _list_windows(full: int):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            row, offset, w = _windows(h, batch.column(3).to_pylist(), full)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(w.view(np.int64)), batch.column(1).take(take), pa.array(batch.column(2).to_numpy()[row] + offset.astype(np.int32))],
                names=["w", "doc_id", "start"],
            )

    return listed


def shared_spans(docs: DataFrame, min_chars: int = 200, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``(doc_id, span_start, span_end)``: the maximal runs of shared characters of each text.

    A character is shared when a stretch of ``min_chars`` code points around it also
    stands in the text of another ``doc_id``. ``min_chars`` is even. NULL, empty and
    shorter texts, and rows with a NULL ``doc_id``, have no rows. Repeated rows of one
    ``doc_id`` with the same text are one text. Other columns are ignored.
    """
    if min_chars % 2 or min_chars < 4:
        raise ValueError("min_chars must be even and at least 4")
    half = min_chars // 2
    spark = docs.sparkSession
    work = Workspace(spark, "spans")
    texts = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars)).select("doc_id", "text")
    kind = texts.schema["doc_id"].dataType.simpleString()

    spans = work.stage(texts.mapInArrow(_scan_spans(half), f"h long, doc_id {kind}, pos int"), "spans")
    repeated = (
        spans.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
        .where(F.col("lo") != F.col("hi"))
        .select("h", (F.col("n") > group_limit).alias("hot"))
    )
    # spans of repeated rows of one id would only be compared with themselves
    places = work.stage(spans.join(repeated, "h").distinct(), "places")
    work.drop(spans)
    by_doc = places.groupBy("doc_id").agg(F.collect_list(F.struct("h", "hot", "pos")).alias("spans"))
    around = (
        texts.join(by_doc, "doc_id").select("doc_id", "text", "spans")
        .mapInArrow(_cut_around(half), f"h long, hot boolean, doc_id {kind}, start int, around string")
    )
    is_hot = places.where("hot").limit(1).count() > 0
    if is_hot:
        around = work.stage(around, "around")
    ranged = f"doc_id {kind}, span_start long, span_end long"
    few = around.where(~F.col("hot")).select("h", "doc_id", "start", "around")
    ranges = few.repartition("h").sortWithinPartitions("h").mapInArrow(_compare_groups(min_chars), ranged)
    if is_hot:
        ranges = ranges.unionByName(_hot_ranges(around.where("hot"), min_chars, kind))
    return merge_ranges(ranges)


def _hot_ranges(around: DataFrame, full: int, kind: str) -> DataFrame:
    """The ranges at spans that very many texts share, without gathering a span's occurrences."""
    rows = around.select("h", "doc_id", "start", "around").withColumn("key", F.md5("around"))
    kinds = rows.groupBy("h", "key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min_by("around", "doc_id").alias("text"))
    same = kinds.where(F.col("lo") != F.col("hi")).select("h", "key")
    whole = rows.join(same, ["h", "key"], "left_semi").where(F.length("around") >= full).select(
        "doc_id", F.col("start").cast("long").alias("span_start"), (F.col("start") + F.length("around")).cast("long").alias("span_end")
    )
    alone = rows.join(same, ["h", "key"], "left_anti").select("h", "doc_id", "start", "around")
    # one copy of each repeated surrounding, under both of its outer ids, stands for all of them
    stand_in = kinds.where(F.col("lo") != F.col("hi")).select(
        "h", F.explode(F.array("lo", "hi")).alias("doc_id"), F.lit(-1).alias("start"), F.col("text").alias("around")
    )
    shape = f"w long, doc_id {kind}, start int"
    lone = alone.mapInArrow(_list_windows(full), shape)
    copies = stand_in.select("h", "doc_id", "start", "around").mapInArrow(_list_windows(full), shape)
    seen = lone.unionByName(copies).groupBy("w").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    twice = seen.where(F.col("lo") != F.col("hi")).select("w")
    part = lone.join(twice, "w", "left_semi").select(
        "doc_id", F.col("start").cast("long").alias("span_start"), (F.col("start") + full).cast("long").alias("span_end")
    )
    return whole.unionByName(part)


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Union of the ranges of each ``doc_id``; ranges that touch become one. A list is bounded by its text."""
    listed = ranges.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("span_start", "span_end"))).alias("r"))
    # each range with the furthest end before it: a gap there begins a new run
    kind = "array<struct<span_start:bigint,span_end:bigint>>"
    folded = F.aggregate(
        "r",
        F.array().cast(kind),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["span_start"] <= F.element_at(acc, -1)["span_end"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["span_start"].alias("span_start"), F.greatest(F.element_at(acc, -1)["span_end"], x["span_end"]).alias("span_end"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return listed.select("doc_id", F.explode(folded).alias("s")).select("doc_id", "s.span_start", "s.span_end")
