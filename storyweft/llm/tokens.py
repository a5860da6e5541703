"""Problem 6: token ids of a byte-level BPE vocabulary.

The merges are compiled into a finite-state transducer over bytes that is
determinised while it runs. A state is the stretch of input that is not settled
yet, with the token that ends at each of its positions; reading a byte gives the
next state and the tokens that no further input can change. The lookahead is
bounded by the longest token. Transitions are kept, so each is worked out once
in a Python worker.

Which token ends at a position follows from two facts about BPE: every prefix of
the input has one last token, and two tokens are neighbours in an encoding just
when the merges of the joined pair never cross their border.

Decoding is a second transducer: its state is the unfinished UTF-8 sequence.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Folder of the public vocabularies.
TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the split of a text before the merges, as published with byte_bpe_50k.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most entries of a worker's tables of words and transitions; beyond it they start anew.
TABLE_LIMIT = 400_000
#: Longest stretch whose ids are kept.
KEPT_LENGTH = 64


class MergeTransducer:
    """Byte-level BPE as a lazily determinised transducer."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        # what can still grow into a token
        self.prefixes = {b""} | {t[:i] for t in ranks for i in range(1, len(t))}
        self._merged: dict[int, tuple[bytes, bytes] | None] = {}
        self._neighbours: dict[tuple[int, int], bool] = {}
        self._moves: dict[tuple[tuple, int], tuple[tuple, tuple[int, ...]]] = {}
        self.start = (b"", (), -1)

    def _parts(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The pair that the last merge of ``token`` joined; None for a single byte."""
        rank = self.ranks[token]
        if rank not in self._merged:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best = min(
                    ((self.ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.ranks),
                )
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._merged[rank] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._merged[rank]

    def neighbours(self, left: int, right: int) -> bool:
        """Whether the two tokens stand side by side in an encoding.

        The merges inside both run in order of rank. The border stays unless a
        piece that ends at it and one that begins at it join before either is
        complete.
        """
        key = (left, right)
        known = self._neighbours.get(key)
        if known is None:
            known = self._neighbours[key] = self._border_stays(self.bytes_of[left], self.bytes_of[right])
        return known

    def _border_stays(self, a: bytes, b: bytes) -> bool:
        ranks = self.ranks
        # pieces at the border, outermost merge first, each with the rank at which it becomes the next larger one
        lefts, rights = [(a, None)], [(b, None)]
        while (p := self._parts(lefts[-1][0])) is not None:
            lefts.append((p[1], ranks[lefts[-1][0]]))
        while (p := self._parts(rights[-1][0])) is not None:
            rights.append((p[0], ranks[rights[-1][0]]))
        i, j = len(lefts) - 1, len(rights) - 1
        while True:
            grow_l, grow_r = lefts[i][1], rights[j][1]
            cross = ranks.get(lefts[i][0] + rights[j][0])
            # of equal ranks the merge further left goes first
            if cross is not None and (grow_l is None or cross < grow_l) and (grow_r is None or cross <= grow_r):
                return False
            if grow_l is None and grow_r is None:
                return True
            if grow_r is None or (grow_l is not None and grow_l <= grow_r):
                i -= 1
            else:
                j -= 1

    def step(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """Next state and the tokens settled by reading ``byte``.

        A state is ``(open bytes, last token at each position of them, token before them)``.
        """
        key = (state, byte)
        move = self._moves.get(key)
        if move is None:
            if len(self._moves) > TABLE_LIMIT:
                self._moves.clear()
            move = self._moves[key] = self._work_out(state, byte)
        return move

    def _work_out(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        text, lasts, before = state
        text += bytes((byte,))
        n = len(text)
        for start in range(n):
            token = self.ranks.get(text[start:])
            if token is None:
                continue
            left = lasts[start - 1] if start else before
            if left < 0 or self.neighbours(left, token):
                lasts += (token,)
                break
        else:
            raise ValueError("no token ends here: the vocabulary lacks a byte")
        # positions where a token may still begin; the encodings that pass through them agree up to a common point
        live = [i for i in range(n + 1) if text[i:] in self.prefixes]
        paths = [self._borders(lasts, i) for i in live]
        common = paths[0]
        for path in paths[1:]:
            common = common & path
        settled = max(common)
        if not settled:
            return (text, lasts, before), ()
        out, at = [], settled
        while at:
            out.append(lasts[at - 1])
            at -= len(self.bytes_of[lasts[at - 1]])
        out.reverse()
        return (text[settled:], lasts[settled:], out[-1]), tuple(out)

    def _borders(self, lasts: tuple, at: int) -> set[int]:
        """Token borders of the encoding of the open bytes up to ``at``."""
        found = {at}
        while at:
            at -= len(self.bytes_of[lasts[at - 1]])
            found.add(at)
        return found

    def flush(self, state: tuple) -> tuple[int, ...]:
        """The tokens that the end of the input settles."""
        text, lasts, _ = state
        out, at = [], len(text)
        while at:
            out.append(lasts[at - 1])
            at -= len(self.bytes_of[lasts[at - 1]])
        return tuple(reversed(out))

    def run(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        state, out = self.start, []
        for byte in piece:
            state, settled = self.step(state, byte)
            out.extend(settled)
        return (*out, *self.flush(state))


class Encoder:
    """Texts to ids: split, then the transducer, with a table of the words met before."""

    def __init__(self, ranks: dict[bytes, int], split: str = SPLIT):
        self.machine = MergeTransducer(ranks)
        self._split = regex.compile(split).findall
        self._words = _Words(self._piece_ids)

    def _piece_ids(self, piece: str) -> tuple[int, ...]:
        out: list[int] = []
        for part in self._split(piece):
            out.extend(self.machine.run(part.encode("utf-8", "surrogatepass")))
        return tuple(out)

    def extend(self, out: array, text: str) -> None:
        """Append the ids of ``text``.

        A blank with no white space on either side always begins a new piece of
        the split, so the text may be cut there and each stretch looked up.
        """
        words = self._words
        if len(words) > TABLE_LIMIT:
            words.clear()
        parts = text.split(" ")
        grow = out.extend
        stretch = parts[0]
        if all(parts[1:]) and not any(map(str.isspace, _edges(parts))):
            grow(words[stretch])
            for p in parts[1:]:
                grow(words[" " + p])
            return
        for p in parts[1:]:
            if stretch and p and not p[0].isspace() and not stretch[-1].isspace():
                grow(words[stretch])
                stretch = " " + p
            else:
                stretch += " " + p
        grow(words[stretch])


def _edges(parts: list[str]) -> str:
    """First and last characters of the parts."""
    return "".join([p[0] + p[-1] for p in parts if p])


class _Words(dict):
    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self._make(piece)
        if len(piece) <= KEPT_LENGTH:
            self[piece] = ids
        return ids


class Utf8Reader:
    """Ids to text; the state is the unfinished UTF-8 sequence, transitions are kept."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {v: k for k, v in ranks.items()}
        self._moves: dict[tuple[bytes, int], tuple[bytes, str]] = {}

    def step(self, pending: bytes, token: int) -> tuple[bytes, str]:
        key = (pending, token)
        move = self._moves.get(key)
        if move is None:
            if len(self._moves) > TABLE_LIMIT:
                self._moves.clear()
            move = self._moves[key] = self._work_out(pending + self.bytes_of[token])
        return move

    @staticmethod
    def _work_out(data: bytes) -> tuple[bytes, str]:
        # an unfinished sequence is at most three bytes: a lead byte and what follows it
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 == 0x80:
                continue
            need = 2 if b & 0xE0 == 0xC0 else 3 if b & 0xF0 == 0xE0 else 4 if b & 0xF8 == 0xF0 else 1
            if need > back:
                return data[-back:], data[:-back].decode("utf-8", "replace")
            break
        return b"", data.decode("utf-8", "replace")

    def read(self, ids) -> str:
        pending, out = b"", []
        for token in ids:
            pending, text = self.step(pending, token)
            out.append(text)
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out)


def load_ranks(path: str) -> bytes:
    """Rank file as bytes. A vocabulary is of fixed size (under 1 MB), so it may be broadcast."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(n) for t, n in map(bytes.split, raw.splitlines()) if t}


_cache: dict[tuple[str, int], object] = {}


def _cached(kind, raw: bytes):
    """One machine a worker process, kept between tasks."""
    key = (kind.__name__, hash(raw))
    if key not in _cache:
        _cache[key] = kind(parse_ranks(raw))
    return _cache[key]


def encode_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
) -> DataFrame:
    """``(id_col, ids array<int>)``, one row per input row.

    The text is encoded exactly as stored, without special tokens. NULL and empty
    texts give an empty list. Order, duplicates and NULL ids of rows are kept; other
    columns are ignored. No row needs another, so nothing is shuffled.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(load_ranks(vocabulary))
    rows = docs.select(id_col, text_col)
    id_type = rows.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _cached(Encoder, shipped.value)
        for batch in batches:
            ids, ends = array("i"), array("i", [0])
            for text in batch.column(1).to_pylist():
                if text:
                    encoder.extend(ids, text)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    return rows.mapInArrow(encode, f"`{id_col}` {id_type}, ids array<int>")


def decode_ids(
    encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
) -> DataFrame:
    """``(id_col, text)``; a NULL or empty list gives an empty text."""
    spark = encoded.sparkSession
    shipped = spark.sparkContext.broadcast(load_ranks(vocabulary))
    rows = encoded.select(id_col, ids_col)
    id_type = rows.schema[id_col].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _cached(Utf8Reader, shipped.value)
        for batch in batches:
            texts = [reader.read(ids) if ids else "" for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return rows.mapInArrow(decode, f"`{id_col}` {id_type}, text string")
