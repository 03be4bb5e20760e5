"""Evaluation items whose passages appear in documents."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.llm.pieces import byte_ranges, own_bounds
from chalkline.plans.session import materialise

#: Units (words, or letters and digits) of a shingle, and the odd multiplier of all hashes.
WORDS_PER_SHINGLE, CHARS_PER_SHINGLE = 5, 8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Windows of an item that travel together, and shingles of items looked up in one reading of the documents (8 bytes each).
CHUNK, MOST_SHARED = 4096, 1_000_000
#: Bits of the table that a hash must hit before it is looked up.
_SIEVE_BITS = 22

_folding: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """For each code point: its one-character folding, 0 for a separator, 1 for an invisible one, 2 where a string must be folded whole."""
    if not _folding:
        table = np.zeros(0x110000, np.uint32)
        for cp in [*range(0xD800), *range(0xE000, 0x20000)]:
            ch = chr(cp)
            kind = unicodedata.category(ch)
            f = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", ch).casefold())
            if kind == "Cf" or "VARIATION SELECTOR" in unicodedata.name(ch, ""):
                table[cp] = 1
            elif kind[0] == "M":
                table[cp] = 2
            elif len(f) == 1:
                table[cp] = ord(f) if f.isalnum() else 0
            else:
                table[cp] = 2 if any(c.isalnum() for c in f) else 0
        table[0x20000:0x32000] = np.arange(0x20000, 0x32000)
        _folding.append(table)
    return _folding[0]


def fold(text: str) -> np.ndarray:
    """Code points of ``text`` without case, width and invisible characters; separators are 0."""
    table = _fold_table()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    f = table[np.minimum(code, 0x10FFFF)]
    if (f == 2).any():
        kept = "".join(c for c in text if table[ord(c)] != 1)
        whole = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", kept).casefold())
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = table[np.minimum(code, 0x10FFFF)]
        # a mark that has not been composed is no letter and ends a word
        return np.where(letters > 2, code, 0)
    return f[f != 1]


def _rolling(units: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` units."""
    if len(units) < n:
        return np.zeros(0, np.uint64)
    h = units[: len(units) - n + 1].copy()
    for i in range(1, n):
        h *= _MULTIPLIER
        h += units[i : len(units) - n + 1 + i]
    h ^= h >> np.uint64(31)
    return h * _MULTIPLIER


def word_units(folded: np.ndarray) -> np.ndarray:
    """A hash for each maximal run of letters and digits."""
    inside = folded != 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    # two sums of mixed letters and places within the word; sums wrap, which is what is wanted
    c = folded.astype(np.uint64)
    lead = start if start[0] == 0 else np.concatenate([[0], start])
    place = (np.arange(len(c)) - np.repeat(lead, np.diff(np.append(lead, len(c))))).astype(np.uint64)
    x = (c + (place << np.uint64(21))) * _MULTIPLIER
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x[~inside] = 0
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return total[end] - total[start]


def char_units(folded: np.ndarray) -> np.ndarray:
    return folded[folded != 0].astype(np.uint64)


def units_of(text: str, words: bool) -> np.ndarray:
    f = fold(text)
    return word_units(f) if words else char_units(f)


def _chunks(span: dict[bool, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingles of each item in rows of CHUNK windows: item number, words, place of the first, hashes."""
        for batch in batches:
            out: list[tuple] = []
            for no, words, text in zip(*(batch.column(n).to_pylist() for n in ("no", "words", "text"))):
                h = _rolling(units_of(text, words), WORDS_PER_SHINGLE if words else CHARS_PER_SHINGLE).view(np.int64)
                for first in range(0, len(h) - span[words] + 1, CHUNK):
                    out.append((no, words, first, h[first : first + CHUNK + span[words] - 1]))
            no, words, first, h = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(no, pa.int64()), pa.array(words, pa.bool_()), pa.array(first, pa.int64()), pa.array(h, pa.list_(pa.int64()))],
                ["no", "words", "first", "h"],
            )

    return run


def _sieve(hashes: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << _SIEVE_BITS, bool)
    table[(hashes.view(np.uint64) >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)] = True
    return table


def _hits(shared, size: int, halo: int, span: dict[bool, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per range and kind with shingles of items: the units it owns, the shingles' places and their numbers."""
        wanted = [(words, n, keys, _sieve(keys)) for words, n, keys in shared.value if len(keys)]
        for batch in batches:
            row, out = [], []
            for k, (b, pos, begin, total) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("b", "pos", "begin", "total")))):
                own, text = None, b
                if total > size:
                    first, end = own_bounds(b, pos, begin, total, size, halo)
                    own, text = b[first:end], b[first : end + halo]
                f = fold(text.decode("utf-8", "ignore"))
                mine = f if own is None else fold(own.decode("utf-8", "ignore"))
                for words, n, keys, sieve in wanted:
                    units = word_units if words else char_units
                    h = _rolling(units(f), n)
                    count = len(h) if own is None else len(units(mine))
                    h = h[: count + span[words] - 1]
                    spot = np.flatnonzero(sieve[(h >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)])
                    if len(spot):
                        found = h[spot].view(np.int64)
                        of = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                        same = keys[of] == found
                        spot, of = spot[same], of[same]
                    if len(spot):
                        row.append(k)
                        out.append((words, count, spot.astype(np.int32).tobytes(), of.astype(np.int32).tobytes()))
            if out:
                words, count, at, of = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(row)), pa.array(words, pa.bool_()), pa.array(count, pa.int64()), pa.array(at, pa.binary()), pa.array(of, pa.binary())],
                    ["doc", "words", "own", "at", "of"],
                )

    return run


def _counts(sizes: dict[bool, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often a task has met each shingle: one row per shingle and task."""
        often = {w: np.zeros(n, np.int64) for w, n in sizes.items()}
        for batch in batches:
            for words, of in zip(batch.column("words").to_pylist(), batch.column("of").to_pylist()):
                often[words] += np.bincount(np.frombuffer(of, np.int32), minlength=sizes[words])
        for words, n in often.items():
            of = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), words)), pa.array(of, pa.int64()), pa.array(n[of], pa.int64())], ["words", "of", "n"])

    return run


def _prefixes(chunks: list[tuple[int, int, np.ndarray]], often: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Every window of the chunks (item, first place, shingle numbers) by its rarest shingle, the first of equals.

    A shingle that no document has rules out the windows that hold it. Arrays in order of the rarest
    shingle: its number, its place in the window, the item, the window's start, and where its
    shingles begin in the chunks laid end to end; and these.
    """
    every, at = [np.zeros((0, 5), np.int64)], 0
    for no, first, seq in chunks:
        view = np.lib.stride_tricks.sliding_window_view(often[seq], span)
        rarest = view.argmin(1)
        start = np.arange(len(view))
        rows = np.stack([seq[start + rarest], rarest, np.full(len(view), no), first + start, at + start], 1)
        every.append(rows[view.min(1) > 0])
        at += len(seq)
    rows = np.concatenate(every)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    laid = np.concatenate([seq for _, _, seq in chunks]) if chunks else np.zeros(0, np.int32)
    return (*(np.ascontiguousarray(rows[:, k]) for k in range(5)), laid.astype(np.int32))


def _verified(shared, span: dict[bool, int], block: int = 100_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc, no, start): windows of items all of whose shingles stand in the document at their places."""
        tables = shared.value
        for batch in batches:
            row, item, begins = [], [], []
            for k, (words, own, at, of) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("words", "own", "at", "of")))):
                key, shift, no, start, offset, laid = tables[words]
                at, of, n = np.frombuffer(at, np.int32), np.frombuffer(of, np.int32), span[words]
                lo, hi = np.searchsorted(key, of, "left"), np.searchsorted(key, of, "right")
                ends = np.cumsum(hi - lo)
                seen = []
                # the pairs of a hit and a window with that prefix, in blocks
                for begin in range(0, int(ends[-1]), block):
                    pair = np.arange(begin, min(begin + block, int(ends[-1])))
                    i = np.searchsorted(ends, pair, "right")
                    w = lo[i] + pair - (ends[i] - (hi - lo)[i])
                    i = i - shift[w]  # where the window's first shingle must stand
                    ok = (i >= 0) & (i + n <= len(at))
                    i, w = i[ok], w[ok]
                    ok = (at[i] < own) & (at[i + n - 1] - at[i] == n - 1)
                    i, w = i[ok], w[ok]
                    same = np.ones(len(i), bool)
                    for j in range(n):
                        same &= of[i + j] == laid[offset[w] + j]
                    seen.append(w[same])
                if seen:
                    w = np.unique(np.concatenate(seen))
                    row.append(np.full(len(w), k))
                    item.append(no[w])
                    begins.append(start[w])
            if row:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(pa.array(np.concatenate(row))), pa.array(np.concatenate(item)), pa.array(np.concatenate(begins))], ["doc", "no", "start"]
                )

    return run


def find_leaks(
    documents: DataFrame,
    doc: str,
    doc_text: str,
    items: DataFrame,
    item: str,
    item_text: str,
    words: str,
    least_words: int = 12,
    least_chars: int = 24,
    range_bytes: int = 1 << 20,
    halo_bytes: int = 8192,
    most_shared: int = MOST_SHARED,
) -> DataFrame:
    """``(doc, item, n_units)``: each pair where the document contains a passage of the item.

    A passage is ``least_words`` consecutive words of an item whose column ``words`` is
    true, or ``least_chars`` consecutive letters and digits of one where it is false;
    n_units is how many windows of that length, with a start of their own, are contained.
    Case, width, invisible characters, punctuation, spacing and line breaks don't count. Null ids or
    texts are left out, a null ``words`` counts as false, items shorter than a passage
    match nothing. Repeated rows of documents or items count once; an id with several texts has the passages of
    each of them, and none across two. Whole texts are read, of any length: one over
    ``range_bytes`` as ranges, spread over the tasks, each with a halo that must hold a passage; runs of white space
    and punctuation are made one space there first, so that they take no room in it.

    A set join with a prefix filter: every window of an item is the set of its shingles; a document that
    contains it has them all, so in particular the rarest. The documents are read once, and the places of shingles
    that some item has are kept, a row a document. They are counted, partial in the tasks, which orders the shingles by
    rarity. Each window is then looked up by its rarest shingle alone (its prefix), whose place bounds where the window
    must start, and all its shingles are verified at their places, in the task that holds the document: no pair of
    document and shingle is shuffled, so a shingle that half the documents have is no hot key. Shingles are compared as 64-bit hashes.

    Items travel to the tasks by broadcast, bounded by ``most_shared`` shingles; items with more are searched in parts
    of that size, each with a reading of its own, whose broadcasts are released when its matches are written.
    """
    spark = documents.sparkSession
    span = {True: least_words - WORDS_PER_SHINGLE + 1, False: least_chars - CHARS_PER_SHINGLE + 1}
    length = {True: WORDS_PER_SHINGLE, False: CHARS_PER_SHINGLE}
    if min(span.values()) < 1:
        raise ValueError(f"a passage must have at least {WORDS_PER_SHINGLE} words or {CHARS_PER_SHINGLE} letters")
    texts = items.select(
        F.col(item).alias("item"), F.coalesce(F.col(words), F.lit(False)).alias("words"), F.col(item_text).alias("text")
    ).where("item is not null and text is not null").distinct()
    numbered = materialise(texts.withColumn("no", F.monotonically_increasing_id()))
    schema = T.StructType().add("no", T.LongType()).add("words", T.BooleanType()).add("first", T.LongType()).add("h", T.ArrayType(T.LongType()))
    chunks = materialise(numbered.select("no", "words", "text").mapInArrow(_chunks(span), schema))
    whole = documents.where(F.col(doc).isNotNull() & F.col(doc_text).isNotNull())
    plain = F.regexp_replace(F.regexp_replace(F.col(doc_text), r"\p{Cf}+", ""), r"[\s\p{Z}\p{P}\p{Cc}]{2,}", " ")
    long = F.octet_length(F.col(doc_text)) > range_bytes
    # inside, a text is known by its id and its hash, so that texts of one id stay apart
    named = whole.select(F.struct(F.col(doc).alias("id"), F.xxhash64(F.col(doc_text)).alias("of")).alias("id"), F.when(long, plain).otherwise(F.col(doc_text)).alias("t"))
    docs = byte_ranges(named, range_bytes, halo_bytes)
    doc_type = docs.schema["id"].dataType
    hit_schema = T.StructType().add("doc", doc_type).add("words", T.BooleanType()).add("own", T.LongType()).add("at", T.BinaryType()).add("of", T.BinaryType())
    total = chunks.agg(F.sum(F.size("h"))).first()[0] or 0
    parts = max(1, -(-total // most_shared))
    found = None
    for part in range(parts):
        mine = chunks.where(F.pmod(F.xxhash64("no", "first"), F.lit(parts)) == part).toArrow()  # about most_shared shingles
        rows = list(zip(*(mine[n].to_pylist() for n in ("no", "words", "first")), (np.asarray(h.values) for h in mine["h"])))
        keys = {w: np.unique(np.concatenate([np.zeros(0, np.int64), *(h for _, x, _, h in rows if x == w)])) for w in span}
        shared = spark.sparkContext.broadcast([(w, length[w], keys[w]) for w in span])
        hits = materialise(docs.mapInArrow(_hits(shared, range_bytes, halo_bytes, span), hit_schema))
        shared.unpersist()
        met = hits.select("words", "of").mapInArrow(_counts({w: len(k) for w, k in keys.items()}), "words boolean, of long, n long")
        often = {w: np.zeros(len(k), np.int64) for w, k in keys.items()}
        for x in met.groupBy("words", "of").agg(F.sum("n").alias("n")).toArrow().to_batches():  # at most a row a shingle of the part
            w, of, n = (x.column(c).to_numpy(zero_copy_only=False) for c in ("words", "of", "n"))
            for kind in span:
                often[kind][of[w == kind]] = n[w == kind]
        tables = spark.sparkContext.broadcast(
            {w: _prefixes([(no, first, np.searchsorted(keys[w], h)) for no, x, first, h in rows if x == w], often[w], span[w]) for w in span}
        )
        one = materialise(hits.mapInArrow(_verified(tables, span), T.StructType().add("doc", doc_type).add("no", T.LongType()).add("start", T.LongType())))
        tables.unpersist()
        found = one if found is None else found.unionByName(one)
    distinct = found.select(F.col("doc.id").alias("_doc"), "no", "start").distinct()
    return distinct.groupBy("_doc", "no").agg(F.count("*").alias("n")).join(numbered.select("no", "item"), "no").groupBy(
        F.col("_doc").alias(doc), F.col("item").alias(item)
    ).agg(F.sum("n").alias("n_units"))
