"""Problem 2: new batches against everything accepted before.

The history is kept as two bucketed, sorted tables in a named folder, and can be
opened again by any later session:

* ``known``, by hash: the name of the article in its address, and the normalised
  content with its text; each once, with the batch and row that brought it first.
* ``pieces``, by hash (a frequent one in several parts): the paragraphs of every distinct content. A feed entry is a
  title and a few sentences, so its paragraphs are short: a text is cut before words
  that its own words determine, wherever they stand, into stretches of about four
  words, and an edit spoils only the stretches it touches.

A batch is hashed once. A bucket-local semi-join with ``known`` gives addresses and
full copies; one with ``pieces`` gives the share of each remaining record that is
known, its coverage. Records covered far enough are compared, by edit distance, with
the contents that share a piece with them and came earlier. Which pieces are looked up follows from
the coverage asked for: a content that covers a record to that share has one of its
rarest pieces, so the frequent ones need not be followed, and nothing is lost. The
hashes of a batch that are new are appended before it is checked, each with the row
that brought it, so a batch repeats itself no differently than it repeats the
history. Neither table is shuffled, and texts are read only for the comparison.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..workspace import Workspace, shared_root
from .lookalikes import as_latin, fold

#: Differing characters that are small edits: of a title, with the share of those of a lede.
#: A title that hardly differs allows more in the lede than one that differs in words.
EDITS = ((14, 0.35), (30, 0.2))
#: Share of a record's words that must stand in known pieces, and in pieces shared with one content, to be compared.
COVERAGE = 0.25
#: Records of fewer words are known by their single words too: one edit may spoil all the pieces of a short text.
SHORT_WORDS = 16
#: Buckets that the contents of one piece are spread over.
SPREAD = 4
#: Appends after which the tables are rewritten with one file a bucket.
COMPACT_AFTER = 64
#: What the columns and hashes of a stored history mean; another one can't be gone on with.
FORMAT = 2
#: Letters of scripts written without blanks; each is a word of its own in the pieces.
#: Here and in the next pattern a range comes first that most characters are outside of, so that few are looked up in the others.
_UNSPACED = r"([\x{E00}-\x{10FFFF}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]])"
#: Characters without width, combining, full-width, ligatures, and letters with Latin look-alikes.
_ODD = r"[\x{AD}\x{100}-\x{FFFF}&&[\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{300}-\x{36F}\x{FF01}-\x{FF60}\x{FB00}-\x{FB06}\x{370}-\x{3FF}\x{400}-\x{52F}]]"

#: What stands between two words, in lower case, unless it is a single blank.
_BETWEEN = r"[^ a-z0-9\p{L}\p{M}\p{N}][^a-z0-9\p{L}\p{M}\p{N}]*+| [^a-z0-9\p{L}\p{M}\p{N}]++"

#: A character that ``_worded`` leaves as it is: not of ASCII or Latin-1, and no dash, quotation mark or other general punctuation.
_WIDE = r"[^\x{0}-\x{AC}\x{AE}-\x{FF}\x{2010}-\x{2027}\x{2030}-\x{205E}]"
#: Bytes as words have them: small letters, digits and whatever isn't ASCII; all else is a blank.
_IN_WORDS = np.array([ord(chr(b).lower()) if chr(b).isalnum() else ord(" ") for b in range(128)] + list(range(128, 256)), np.uint8)
#: Second bytes of the characters from U+80 to U+BF that stand in words.
_LATIN_1 = np.isin(np.arange(256), [b for b in range(0x80, 0xC0) if unicodedata.category(chr(b))[0] in "LMN"])


def with_article_name(rows: DataFrame, outlet: str, url: str) -> DataFrame:
    """``rows`` with ``name``: what an address names at its outlet, a number, a dated title or a code; else its path.

    Scheme, host, port, fragment, session, case, doubled and closing slashes, AMP and
    index forms, and all of the query but an article number are left out. NULL and
    blank addresses give NULL. Each step is a column of its own, so it is worked out once.
    """
    u = F.btrim(url)
    r = rows.withColumn("_u", F.substring_index(F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?(.*)$", 1), "#", 1))
    r = r.withColumn("_u", F.lower(F.when(F.contains("_u", F.lit("%")), F.coalesce(F.try_url_decode("_u"), "_u")).otherwise(F.col("_u"))))
    r = r.withColumn("_asked", F.when(F.contains("_u", F.lit("?")), F.regexp_extract("_u", r"[?&;](?:id|article|article_id|story|p)=(\d+)(?:[&;]|$)", 1)).otherwise(""))
    # what only few addresses have is looked for first, so that most pass without a pattern
    has = lambda c, what: F.contains(c, F.lit(what))
    path = F.rtrim(F.substring_index("_u", "?", 1), F.lit("/"))
    path = F.when(has(path, ";"), F.regexp_replace(path, r";[^/]*", "")).otherwise(path)
    r = r.withColumn("_path", F.when(F.col("_asked") == "", path))
    rare = has("_path", "//") | has("_path", "/amp") | has("_path", "/index.") | has("_path", "/print")
    r = r.withColumn("_path", F.when(rare, F.regexp_replace(F.regexp_replace("_path", r"/{2,}", "/"), r"(/(index\.[a-z]+|amp|print))?/*$", "")).otherwise(F.col("_path")))
    r = r.withColumn("_dated", F.regexp_extract("_path", r"/(\d{4}/\d{1,2}/\d{1,2}/[^/]+)", 1))
    rest = F.col("_dated") == ""
    r = r.withColumn("_number", F.when(rest, F.regexp_extract("_path", r"/(\d{5,})(?:/|$)", 1)))
    r = r.withColumn("_code", F.when(rest & (F.col("_number") == ""), F.regexp_extract("_path", r"/([0-9a-z]*\d[0-9a-z]*)$", 1)))
    name = (
        F.when(F.col("_asked") != "", F.concat(F.lit("n"), "_asked"))
        .when(F.col("_dated") != "", F.concat(F.lit("d"), F.regexp_replace("_dated", r"\.(html?|php|aspx?)$", "")))
        .when(F.col("_number") != "", F.concat(F.lit("n"), "_number"))
        .when(F.length("_code") >= 6, F.concat(F.lit("c"), "_code"))
        .otherwise(F.concat(F.lit("p"), "_path"))
    )
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#:]*)", 1)), r"^(www|m|amp)\.", "")
    place = F.when(F.col(outlet).isNotNull(), F.col(outlet)).otherwise(host)
    return r.withColumn("name", F.when(u != "", F.concat_ws("|", place, name))).drop("_u", "_asked", "_path", "_dated", "_number", "_code")


def _plain(rows: DataFrame, texts: dict[str, str], looks: bool = True) -> DataFrame:
    """``rows`` with the words of texts, by column, in lower case with single blanks; NULL is empty."""
    same = {c: F.col(t) for c, t in texts.items()}
    if looks:
        # characters that only look different are no edits; few texts have any, and these are a column of their own
        odd = lambda t: (F.octet_length(t) != F.length(t)) & F.col(t).rlike(_ODD)
        rows = rows.withColumns({f"_odd_{c}": F.when(odd(t), F.col(t)) for c, t in texts.items()})
        rows = rows.withColumns({f"_odd_{c}": as_latin(fold(F.col(f"_odd_{c}"))) for c in texts})
        same = {c: F.coalesce(f"_odd_{c}", t) for c, t in texts.items()}
    return rows.withColumns({c: F.btrim(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), _BETWEEN, " ")) for c, t in same.items()}).drop(*[f"_odd_{c}" for c in texts])


def _split(text: Column) -> Column:
    return F.when(text != "", F.split(text, " ")).otherwise(F.array().cast("array<string>"))


def _spaced(text: str) -> Column:
    unspaced = (F.octet_length(text) != F.length(text)) & F.col(text).rlike(_UNSPACED)
    return F.when(unspaced, F.btrim(F.regexp_replace(F.regexp_replace(text, _UNSPACED, " $1 "), " +", " "))).otherwise(F.col(text))


@F.arrow_udf(ArrayType(StringType()))
def _cut(texts: pa.Array) -> pa.Array:
    """Texts (words with single blanks) cut into pieces; one begins at the first word and at each marked word behind an unmarked one.

    A word is marked if its length and the code point of its first character add up to an odd number.
    """
    texts = texts.fill_null("").cast(pa.string())
    _, where, chars = texts.buffers()
    ends = np.frombuffer(where, np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(chars or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    first = np.zeros(len(data), bool)
    first[ends[:-1][ends[1:] > ends[:-1]]] = True
    blank = data == ord(" ")
    start = np.flatnonzero(first | np.concatenate([[False], blank[:-1]])[: len(data)])
    stop = np.append(start[1:] - blank[start[1:] - 1], len(data))[: len(start)]
    # bytes that begin a character; the last byte of a character is as odd as its code point
    begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    lead = data[start]
    last = start + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    mark = (data[last] + begun[stop] - begun[start]) % 2 == 1
    border = first[start]
    border[1:] |= mark[1:] & ~mark[:-1]
    cut = start[border]
    # the blank before a piece goes, so that one piece ends where the next begins
    gone = cut[~first[cut]] - 1
    kept = np.ones(len(data), bool)
    kept[gone] = False
    at = np.append(cut, len(data)) - np.searchsorted(gone, np.append(cut, len(data)))
    pieces = pa.StringArray.from_buffers(len(cut), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data[kept]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(cut, ends).astype(np.int32)), pieces)


@F.arrow_udf(StructType([StructField("words", StringType()), StructField("pieces", ArrayType(StringType()))]))
def _worded(texts: pa.Array) -> pa.Array:
    """The words of texts in lower case with single blanks, and these cut into pieces.

    Characters of ``_WIDE`` are left as they are, so texts with any are to be given as ``_plain`` has them, which are not changed.
    """
    texts = texts.fill_null("").cast(pa.string())
    _, where, chars = texts.buffers()
    ends = np.frombuffer(where, np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    data = _IN_WORDS[np.frombuffer(chars or b"", np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    lead = np.flatnonzero(data >= 0xC2)
    by = {b: lead[data[lead] == b] for b in (0xC2, 0xC3, 0xE2)}
    # U+C0 to U+DE are the capitals of U+E0 to U+FE, but for two signs
    second = data[by[0xC3] + 1]
    signs = (second == 0x97) | (second == 0xB7)
    data[by[0xC3] + 1] = np.where(second <= 0x9E, second + 0x20, second)
    # U+2010 to U+2027 and U+2030 to U+205E
    second, third = data[by[0xE2] + 1], data[by[0xE2] + 2]
    marks = (second == 0x80) & ((third >= 0x90) & (third <= 0xA7) | (third >= 0xB0)) | (second == 0x81) & (third <= 0x9E)
    for at, size in ((by[0xC3][signs], 2), (by[0xC2][~_LATIN_1[data[by[0xC2] + 1]]], 2), (by[0xE2][marks], 3)):
        for k in range(size):
            data[at + k] = ord(" ")
    kept = data != ord(" ")
    # of several blanks the last one stays, and none at the end of a text
    inner = np.append(kept[1:], False)[: len(data)]
    inner[ends[1:][ends[1:] > 0] - 1] = False
    kept = kept | inner
    data, ends = data[kept], np.concatenate([[0], np.cumsum(kept)])[ends]
    # nor at its beginning
    begin = ends[:-1][ends[1:] > ends[:-1]]
    begin = begin[data[begin] == ord(" ")]
    data, ends = np.delete(data, begin), ends - np.searchsorted(begin, ends)
    words = pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
    return pa.StructArray.from_arrays([words, _cut.func(words)], ["words", "pieces"])


def _hashed(kind: str, pieces: Column) -> Column:
    """``(h, w)`` of each distinct piece: hash with outlet and kind of text, and number of words."""
    blanks = lambda p: F.octet_length(p) - F.octet_length(F.replace(p, F.lit(" "), F.lit("")))
    return F.transform(F.array_distinct(pieces), lambda p: F.struct(F.xxhash64(F.lit(kind), "outlet", p).alias("h"), (blanks(p) + 1).alias("w")))


def with_pieces(rows: DataFrame, looks: bool = True) -> DataFrame:
    """``rows`` (``outlet``, ``title``, ``lede``) with ``plain_t``, ``plain_l`` and ``pieces``, the distinct ``(h, w)`` of both texts.

    With ``looks`` characters that look alike are alike. NULL texts are empty; a record
    without words has no pieces.
    """
    # most texts go without patterns; the others are columns of their own
    wide = {"_wt": "title", "_wl": "lede"}
    r = rows.withColumns({w: F.when((F.octet_length(t) != F.length(t)) & F.col(t).rlike(_WIDE), F.col(t)) for w, t in wide.items()})
    r = _plain(r, {"_pt": "_wt", "_pl": "_wl"}, looks)
    r = r.withColumns({x: F.when(F.col(w).isNotNull(), _spaced(p)).otherwise(F.col(wide[w])) for x, w, p in (("_xt", "_wt", "_pt"), ("_xl", "_wl", "_pl"))})
    r = r.withColumns({"_ct": _worded("_xt"), "_cl": _worded("_xl")})
    r = r.withColumns({"_t": F.col("_ct.words"), "_l": F.col("_cl.words")})
    r = r.withColumns({x: F.when(F.col(w).isNotNull(), F.col(p)).otherwise(F.col(c)) for x, w, p, c in (("plain_t", "_wt", "_pt", "_t"), ("plain_l", "_wl", "_pl", "_l"))})
    none = F.array().cast("array<struct<h:bigint,w:int>>")
    words_of = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + (F.col(c) != "").cast("int")
    words = F.when(words_of("_t") + words_of("_l") < SHORT_WORDS, F.concat(_hashed("title word", _split(F.col("_t"))), _hashed("lede word", _split(F.col("_l"))))).otherwise(none)
    return r.withColumn("pieces", F.concat(_hashed("title", F.col("_ct.pieces")), _hashed("lede", F.col("_cl.pieces")), words)).drop("_t", "_l", "_ct", "_cl", "_xt", "_xl", "_pt", "_pl", *wide)


def _records(rows: DataFrame, url: str) -> DataFrame:
    """Hashes and normalised text of each row; its columns ``batch_no``, ``row`` and ``linked`` are kept."""
    r = with_article_name(rows, "outlet", url).select("batch_no", "row", (F.btrim(url) != "").alias("linked"), "outlet", "name", "title", "lede")
    return with_pieces(r).select(
        "batch_no", "row", "linked",
        F.when(F.col("name").isNotNull(), F.xxhash64(F.lit("name"), "name")).alias("name_hash"),
        F.when((F.col("plain_t") != "") | (F.col("plain_l") != ""), F.xxhash64(F.lit("content"), "outlet", "plain_t", "plain_l")).alias("content"),
        F.col("plain_t").alias("title"), F.col("plain_l").alias("lede"), "pieces",
    )


def _same_text(a: str, b: str) -> Column:
    """Title and lede equal up to small edits, by their shares; by the title where either text is too short to tell."""
    size = lambda x, c: F.length(f"{x}.{c}")
    longest = F.greatest(size(a, "lede"), size(b, "lede"))
    titles = F.levenshtein(f"{a}.title", f"{b}.title", max(t for t, _ in EDITS))
    least = F.floor(longest * max(s for _, s in EDITS)).cast("int")
    # no more edits than allowed are counted; -1 stands for more
    ledes = F.call_function("levenshtein", F.col(f"{a}.lede"), F.col(f"{b}.lede"), least)
    near = F.abs(size(a, "lede") - size(b, "lede")) <= least
    small = lambda n, m: reduce(lambda x, y: x | y, [(n <= t) & (m <= longest * s) for t, s in EDITS])
    words = lambda c: F.size(F.split(c, " "))
    bare = F.least(*[words(f"{x}.{c}") for x in (a, b) for c in ("title", "lede")]) < 3
    few = lambda n: (n <= EDITS[0][0]) & (n <= F.greatest(size(a, "title"), size(b, "title")) * EDITS[1][1])
    # in a lambda a distance is a value: each is worked out once, that of the ledes only if the titles allow it
    return near & F.exists(F.array(titles), lambda n: (n >= 0) & (~bare | few(n)) & F.exists(F.array(ledes), lambda m: (m >= 0) & small(n, m)))


def _part(h: str, content: str, spread: int) -> Column:
    """Key of the part of a piece that a content lies in, from the piece's hash; and the hash from the key."""
    return F.col(h).bitwiseXOR(F.pmod(content, F.lit(spread)))


def _postings(records: DataFrame, spread: int) -> DataFrame:
    """``(k, c)`` of the pieces of records."""
    return records.where(F.col("content").isNotNull()).select(F.explode("pieces.h").alias("h"), F.col("content").alias("c")).select(_part("h", "c", spread).alias("k"), "c")


def _over(hashes: DataFrame, spread: int) -> DataFrame:
    """Each row, by its ``h``, once for every part ``k`` that the contents of a piece are spread over."""
    return hashes.withColumn("k", F.explode(F.array(*[F.col("h").bitwiseXOR(F.lit(i).cast("long")) for i in range(spread)])))


class ArticleHistory:
    """Known articles, kept in a folder; batches are checked and appended in turn.

    ``folder`` is opened if it holds a history and made otherwise; without one a new
    folder in the shared folder is taken. A batch that is given again, as after a
    crash, gets the same answers and adds nothing: what is stored carries the batch and
    row it came from, and only what came earlier counts as known. ``buckets`` is fixed
    when the history is made; take one for about 64 MB of its final size.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None, spread: int = SPREAD):
        self.spark = spark
        self.folder = (folder or f"{shared_root(spark)}/history-{uuid.uuid4().hex[:12]}").rstrip("/")
        stored = self._read_state()
        if stored and stored.get("format") != FORMAT:
            raise ValueError(f"the history in {self.folder} has another format than {FORMAT}; make it anew from its articles")
        self.state = stored or {"format": FORMAT, "buckets": buckets or max(8, spark.sparkContext.defaultParallelism), "spread": spread, "appends": 0, "generation": 0}
        self.work = Workspace(spark, "history")
        self.tables: dict[str, str] = {}
        if not stored:
            self._write_state()
        self._define()

    # -- what is stored

    def _path(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read_state(self) -> dict | None:
        """The newest complete state; a state is written whole under a name of its own, never changed."""
        root, fs = self._path("state")
        names = sorted(str(f.getPath().getName()) for f in fs.listStatus(root)) if fs.exists(root) else []
        done = [n for n in names if n.endswith(".json")]
        if not done:
            return None
        text = self.spark.read.text(f"{self.folder}/state/{done[-1]}", wholetext=True).first()[0]
        return json.loads(text)

    def _write_state(self) -> None:
        self.state["version"] = self.state.get("version", 0) + 1
        name = f"state/{self.state['version']:09d}"
        part, fs = self._path(name + ".part")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        fs.rename(part, self._path(name + ".json")[0])

    _SHAPES = {"known": ("h BIGINT, batch INT, row BIGINT, title STRING, lede STRING", ["h"]), "pieces": ("k BIGINT, c BIGINT", ["k"])}

    def _define(self) -> None:
        """Names in the session's catalog for what lies in the folder; dropping them leaves the files."""
        self.close()
        for kind, (shape, keys) in self._SHAPES.items():
            name = f"articles_{kind}_{uuid.uuid4().hex[:12]}"
            by = ", ".join(keys)
            self.spark.sql(f"CREATE TABLE {name} ({shape}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.state['buckets']} BUCKETS LOCATION '{self._data(kind)}'")
            self.tables[kind] = name

    def _data(self, kind: str) -> str:
        return f"{self.folder}/{kind}-{self.state['generation']}"

    def _add(self, kind: str, rows: DataFrame) -> None:
        shape, keys = self._SHAPES[kind]
        columns = [c.split(" ")[0] for c in shape.split(", ")]
        # one file a bucket and append; each row once
        rows = rows.select(columns).repartition(self.state["buckets"], *keys).dropDuplicates(columns if kind == "pieces" else keys)
        rows.write.mode("append").format("parquet").bucketBy(self.state["buckets"], *keys).sortBy(*keys).option("path", self._data(kind)).saveAsTable(self.tables[kind])

    def known(self) -> DataFrame:
        return self.spark.table(self.tables["known"])

    def pieces(self) -> DataFrame:
        return self.spark.table(self.tables["pieces"])

    def close(self) -> None:
        """Forget the names of the tables; the history stays in its folder."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = {}

    def compact(self) -> None:
        """Rewrite both tables with one file a bucket, beside the old ones, and switch to them."""
        old = {kind: (self.spark.table(name), self._data(kind)) for kind, name in self.tables.items()}
        names, self.tables = list(self.tables.values()), {}
        self.state = {**self.state, "generation": self.state["generation"] + 1, "appends": 0}
        for kind in old:
            # what an interrupted rewrite has left
            self.work.remove(self._data(kind))
        self._define()
        for kind, (rows, _) in old.items():
            self._add(kind, rows)
        self._write_state()
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for _, path in old.values():
            self.work.remove(path)

    # -- a batch

    def _append(self, records: DataFrame, batch: int) -> None:
        """Add the hashes of a stage of records of one batch that aren't known.

        The batch is dealt to the buckets once; finding what is new and writing it need
        no further shuffle, and the tables are read where they lie, without texts.
        """
        none = F.lit(None).cast("string")
        key = lambda h, title, lede: F.struct(F.col(h).alias("h"), title.alias("title"), lede.alias("lede"))
        both = F.array(key("name_hash", none, none), key("content", F.col("title"), F.col("lede")))
        rows = records.select("batch_no", "row", F.explode(both).alias("k")).where("k.h IS NOT NULL").select("batch_no", "row", "k.*").repartition(self.state["buckets"], "h")
        first = rows.groupBy("h").agg(F.min(F.struct("batch_no", "row", "title", "lede")).alias("x")).select("h", F.col("x.batch_no").alias("batch"), "x.row", "x.title", "x.lede")
        met = self.known().select("h").join(rows.select("h").distinct().hint("shuffle_hash"), "h", "left_semi")
        self._add("known", first.join(met, "h", "left_anti"))
        brought = records.where(F.col("content").isNotNull()).select("batch_no", F.col("row").alias("_row"), "content", "pieces")
        # the batch is named, so that files of other batches are passed over
        stored = self.known().where(F.col("batch") == batch).select(F.col("h").alias("content"), "batch", "row")
        # ranges, since more join keys than the buckets' would have the table shuffled
        same = F.col("batch").between(F.col("batch_no"), F.col("batch_no")) & F.col("row").between(F.col("_row"), F.col("_row"))
        self._add("pieces", _postings(stored.join(brought.hint("shuffle_hash"), "content").where(same), self.state["spread"]))

    def _exact(self, records: DataFrame) -> DataFrame:
        """``row`` of the records whose address or content came earlier."""
        each = records.select("batch_no", "row", F.explode(F.array_compact(F.array("name_hash", "content"))).alias("h"))
        earlier = (F.col("batch") < F.col("batch_no")) | ((F.col("batch") == F.col("batch_no")) & (F.col("first") < F.col("row")))
        known = self.known().select("h", "batch", F.col("row").alias("first"))
        return known.join(each.hint("shuffle_hash"), "h").where(earlier).select("row").distinct()

    def met(self, records: DataFrame) -> DataFrame:
        """``k, c, h`` of the stored pieces that any of the records has, each once."""
        asked = _over(records.select(F.explode("pieces.h").alias("h")).distinct(), self.state["spread"]).select("k")
        return self.pieces().join(asked.hint("shuffle_hash"), "k", "left_semi").withColumn("h", _part("k", "c", self.state["spread"]))

    def covered(self, records: DataFrame, met: DataFrame) -> DataFrame:
        """``row, content, total, h, w, many`` of the pieces of appended records; ``met`` are the stored ones.

        ``many`` counts the other contents of a piece, those of the whole batch among them;
        ``total`` is the number of words of all pieces of the record.
        """
        one = records.select("row", "content", F.expr("aggregate(pieces, 0, (s, p) -> s + p.w)").alias("total"), F.explode("pieces").alias("p")).select("row", "content", "total", "p.h", "p.w")
        # a frequent piece is one row of either side
        return one.join(met.groupBy("h").agg((F.count(F.lit(1)) - 1).alias("many")), "h")

    def _near(self, records: DataFrame, met: DataFrame) -> DataFrame:
        """``row`` of the records that are, up to small edits, a content that came earlier."""
        pieces = self.covered(records, met).where("many > 0")
        # of each record the known words from a piece on, the rarest piece first: while they reach the share asked for
        rest = Window.partitionBy("row").orderBy(F.col("many").desc(), "h").rowsBetween(Window.unboundedPreceding, 0)
        chosen = pieces.withColumn("rest", F.sum("w").over(rest)).where(F.col("rest") >= F.col("total") * COVERAGE).select("row", "content", "h")
        stored = met.select("k", "c").join(_over(chosen, self.state["spread"]).hint("shuffle_hash"), "k")
        pairs = stored.where(F.col("c") != F.col("content")).select("row", F.col("c").alias("other")).distinct()
        asked = pairs.join(records.select("batch_no", "row", "title", "lede"), "row").hint("shuffle_hash")
        texts = self.known().where(F.col("title").isNotNull()).select(F.col("h").alias("other"), "batch", F.col("row").alias("first"), "title", "lede")
        earlier = (F.col("b.batch") < F.col("a.batch_no")) | ((F.col("b.batch") == F.col("a.batch_no")) & (F.col("b.first") < F.col("a.row")))
        return texts.alias("b").join(asked.alias("a"), "other").where(earlier & _same_text("a", "b")).select("a.row").distinct()

    def take(self, records: DataFrame, batch: int, found: str | None = None) -> None:
        """Append a stage of records of one batch, and write the ``row`` of those that repeat what came earlier to ``found``.

        Without ``found`` the records are only appended. A batch that was appended before
        is only checked.
        """
        if batch > self.state.get("done", -1):
            self._append(records, batch)
            self.state["done"], self.state["appends"] = batch, self.state["appends"] + 1
            self._write_state()
            if self.state["appends"] >= COMPACT_AFTER:
                self.compact()
        if found:
            linked = records.where("linked")
            exact = self._exact(linked)
            exact = self.work.stage(exact, "exact")
            rest = linked.join(exact, "row", "left_anti")
            # the history is gone through once; what it shares with the batch is counted first and followed then
            met = self.work.stage(self.met(rest), "met")
            exact.unionByName(self._near(rest, met)).write.mode("overwrite").parquet(found)
            self.work.drop(exact, met)


def item_records(items: DataFrame) -> DataFrame:
    """The records of stored articles, as batch 0."""
    return _records(items.select(F.lit(0).alias("batch_no"), F.monotonically_increasing_id().alias("row"), "outlet", "url", "title", "lede"), "url")


def entry_records(incoming: DataFrame) -> DataFrame:
    """The records of feed entries with an id and a batch number."""
    rows = incoming.where(F.col("entry_id").isNotNull() & F.col("batch_no").isNotNull())
    return _records(rows.select(F.col("batch_no").cast("int"), F.col("entry_id").cast("long").alias("row"), "outlet", "link", "title", "lede"), "link")


def check_entries(history: ArticleHistory, incoming: DataFrame) -> DataFrame:
    """``(entry_id)`` of the entries that bring an article again, batch by batch; the history is what the folder holds, and grows.

    Entries without a link are never returned but are known to later ones by their
    content. Rows with a NULL ``entry_id`` or ``batch_no`` are left out. Batches are
    numbered from 1; what is in the history under a smaller number is older.
    """
    spark, work = history.spark, history.work
    kind = incoming.schema["entry_id"].dataType.simpleString()
    batches = [r[0] for r in incoming.where("entry_id IS NOT NULL AND batch_no IS NOT NULL").select(F.col("batch_no").cast("int")).distinct().orderBy("batch_no").collect()]
    if not batches:
        return spark.createDataFrame([], f"entry_id {kind}")
    found = f"{work.root}/found"
    records = work.stage(entry_records(incoming), "incoming", by=["batch_no"])
    for b in batches:
        history.take(records.where(F.col("batch_no") == b), b, f"{found}/batch={b}")
    work.drop(records)
    return spark.read.schema("row long").parquet(*[f"{found}/batch={b}" for b in batches]).select(F.col("row").cast(kind).alias("entry_id")).distinct()


def repeated_entries(items: DataFrame, incoming: DataFrame, folder: str | None = None, buckets: int | None = None) -> DataFrame:
    """``(entry_id)`` of incoming entries that bring an article again, batch by batch.

    Known are the items, entries of smaller batches, and entries of the same batch
    with a smaller id. NULL titles and ledes count as empty; records without a title
    and lede are compared by address only. Extra columns are ignored; empty tables are
    allowed. With ``folder`` the history is kept there, and ``check_entries`` goes on
    from it without the items; otherwise it lies in the shared folder.
    """
    history = ArticleHistory(items.sparkSession, folder, buckets)
    try:
        old = history.work.stage(item_records(items), "items")
        history.take(old, 0)
        history.work.drop(old)
        return check_entries(history, incoming)
    finally:
        history.close()


def entry_coverage(items: DataFrame, incoming: DataFrame, looks: bool = True) -> DataFrame:
    """``(entry_id, words, covered)``: words of each entry with any, and those in pieces of an item or of an entry of a smaller batch.

    One pass without a stored history, for reports. A piece in several places of an
    entry counts once. Words of short texts count as pieces too (``SHORT_WORDS``).
    """
    work = Workspace(items.sparkSession, "coverage")
    # written first: a filter on the pieces would be pushed below them and cut the texts anew for every word
    pieces = lambda df, *keys: work.stage(with_pieces(df.select(*keys, "outlet", "title", "lede"), looks).select(*keys, "pieces"), "pieces")
    cut = lambda df, *keys: pieces(df, *keys).select(*keys, F.explode("pieces").alias("p")).select(*keys, "p.h", "p.w")
    mine = cut(incoming.where("entry_id IS NOT NULL AND batch_no IS NOT NULL"), "entry_id", "batch_no")
    first = mine.groupBy("h").agg(F.min("batch_no").alias("first"))
    old = cut(items).select("h").distinct().withColumn("old", F.lit(True))
    known = F.col("old").isNotNull() | (F.col("first") < F.col("batch_no"))
    return mine.join(first, "h").join(old, "h", "left").groupBy("entry_id").agg(F.sum("w").alias("words"), F.sum(F.when(known, F.col("w")).otherwise(0)).alias("covered"))
