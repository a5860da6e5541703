"""Problem 7: evaluation passages inside training text.

Spaced seeds: masks of fixed positions are laid on every window of words; some
positions are ignored, so a window whose words differ only there still gives the
same hash. The hashes of the evaluation side and of the corpus are joined and
every hit is verified word by word, with as many substitutions as are allowed.

Neither side comes to the driver. The hashes of the evaluation side are summed up
in a bit table of fixed size, which goes to the workers with the scan; the corpus is
read once, and only windows that the table lets through leave the scan. These meet
the hashes of the evaluation side in a join that Spark plans by their true sizes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Maximal runs of letters and digits.
WORDS = re.compile(r"[^\W_]+")
#: Bits of the table of seeds: 32 MB, and one window in a thousand passes by chance with five million words.
FILTER_BITS = 1 << 28
#: Distinct pieces of text kept in a worker.
PIECE_LIMIT = 400_000
#: Texts hashed at a time in a worker.
TEXTS = 256


def seed_masks(span: int, substitutions: int) -> tuple[str, ...]:
    """Masks over ``span`` words that together find every window with so many words substituted; 0 is an ignored place.

    The places are dealt to groups, four or more; as many words spoil as many groups at
    most, and each choice of so many groups is ignored by one mask. Without substitutions
    any one mask finds all.
    """
    if not substitutions:
        return ("".join("0" if i % 4 == 1 else "1" for i in range(span)),)
    groups = min(span, max(4, substitutions + 2))
    if substitutions >= groups:
        raise ValueError("as many substitutions as words")
    return tuple("".join("0" if i % groups in gone else "1" for i in range(span)) for gone in combinations(range(groups), substitutions))


class _Pieces(dict):
    """Stretch without blanks -> 64-bit hashes of its words."""

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple([xxhash.xxh64_intdigest(w.lower().encode("utf-8", "surrogatepass")) for w in WORDS.findall(piece)])
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def _weights(mask: str) -> np.ndarray:
    """An odd 64-bit factor for each position that the mask keeps, 0 for the others."""
    rng = np.random.default_rng(int(mask, 2))
    w = rng.integers(1, 2**63, len(mask), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.where(np.frombuffer(mask.encode(), np.uint8) == 49, w, np.uint64(0))


def _windows(ids: np.ndarray, breaks: np.ndarray, span: int) -> np.ndarray:
    """Starts of the windows of ``span`` words that lie within one text; breaks are the texts' ends."""
    starts = np.arange(max(0, len(ids) - span + 1))
    end_of = np.searchsorted(breaks, starts, side="right")
    return starts[starts + span <= breaks[end_of]] if len(starts) else starts


def _seeds(ids: np.ndarray, at: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each window under the mask."""
    total = np.zeros(len(at), np.uint64)
    for k, w in enumerate(_weights(mask)):
        if w:
            total += ids[at + k] * w
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def _places(seeds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a seed in the bit table."""
    size = np.uint64(bits)
    return seeds % size, (seeds >> np.uint64(20)) * np.uint64(0x9E3779B97F4A7C15) % size


def _scan(span: int, masks: tuple[str, ...], bits: int | None, table):
    """Windows of ``(id, text)`` rows as ``(id, mask, seed, window)``; with a ``table`` only those that it lets through."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = table.value if table is not None else None
        pieces = _Pieces()
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXTS):
                part = batch.slice(begin, TEXTS)
                if len(pieces) > PIECE_LIMIT:
                    pieces.clear()
                get = pieces.__getitem__
                split = [list(map(get, (t or "").split(" "))) for t in part.column(1).to_pylist()]
                ends = np.cumsum([sum(map(len, p)) for p in split], dtype=np.int64)
                ids = np.fromiter(chain.from_iterable(chain.from_iterable(split)), np.uint64)
                at = _windows(ids, ends, span)
                for m, mask in enumerate(masks):
                    seeds, left = _seeds(ids, at, mask), at
                    if words is not None:
                        one, two = _places(seeds, bits)
                        hit = np.flatnonzero((words[one >> np.uint64(6)] >> (one & np.uint64(63))) & np.uint64(1))
                        two = two[hit]
                        hit = hit[((words[two >> np.uint64(6)] >> (two & np.uint64(63))) & np.uint64(1)).astype(bool)]
                        seeds, left = seeds[hit], at[hit]
                    win = ids[left[:, None] + np.arange(span)] if len(left) else np.zeros((0, span), np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(np.searchsorted(ends, left, side="right"))),
                            pa.array(np.full(len(left), m, np.int32)),
                            pa.array(seeds.view(np.int64)),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(left) + 1, dtype=np.int32) * span), pa.array(win.ravel().view(np.int64))),
                        ],
                        names=["id", "mask", "seed", "window"],
                    )

    return scan


def _bit_table(seeds: DataFrame, bits: int) -> np.ndarray:
    """The bit table of all seeds, as words of 64; at most ``bits`` / 64 rows come to the driver, whatever the number of seeds."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.concatenate(_places(batch.column(0).to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((both >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (both & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    rows = seeds.mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(-(-bits // 64), np.uint64)
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return table


def leaked_passages(docs: DataFrame, golden: DataFrame, min_words: int = 13, max_substitutions: int = 0, masks: tuple[str, ...] | None = None, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``(doc_id, golden_id)``, distinct: a run of ``min_words`` words of the passage stands in the document.

    Words are maximal runs of letters and digits in lower case. With
    ``max_substitutions`` above 0 that many words of the run may differ; the masks find
    all such runs. NULL and short texts match nothing; an empty table on either side
    gives no rows; repeated rows and other columns make no difference. A small table of
    ``filter_bits`` lets more windows through and changes nothing else.
    """
    masks = masks or seed_masks(min_words, max_substitutions)
    spark = docs.sparkSession
    side = lambda df, key: df.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(key, "text")
    shape = lambda df, key: f"id {df.schema[key].dataType.simpleString()}, mask int, seed long, window array<long>"
    passages = side(golden, "golden_id").mapInArrow(_scan(min_words, masks, None, None), shape(golden, "golden_id"))
    passages = passages.select(F.col("id").alias("golden_id"), "mask", "seed", F.col("window").alias("passage")).distinct()
    table = spark.sparkContext.broadcast(_bit_table(passages.select("seed"), filter_bits))
    windows = side(docs, "doc_id").mapInArrow(_scan(min_words, masks, filter_bits, table), shape(docs, "doc_id"))
    differ = F.size(F.filter(F.zip_with("window", "passage", lambda x, y: x != y), lambda d: d))
    hits = windows.join(passages, ["mask", "seed"]).where(differ <= max_substitutions)
    return hits.select(F.col("id").alias("doc_id"), "golden_id").distinct()
