"""Texts cut into pieces of at most so many tokens, at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.llm.tokens import DEFAULT_TOKENIZER, LARGE, Counter, counter, share
from chalkline.plans.session import materialise

RANGE_BYTES, HALO_BYTES = 65_536, 8_192
#: A cut is sought within this many tokens before the place of a full piece.
SLACK = 160
#: Tokens that a cut inside a chunk may add.
GUARD = 16
#: One candidate is kept per so many tokens.
GRAIN = 32

_SAFE = re.compile(r"(?<=\S)(?=\s)|(?<=[，。！？；：、])(?=[^\W_])")


def _char_start(b: bytes, at: int) -> int:
    while 0 < at < len(b) and b[at] & 0xC0 == 0x80:
        at += 1
    return at


def safe_cut(b: bytes, at: int, until: int) -> int:
    """The first place from ``at`` on, before ``until``, where text may be cut without changing its tokens.

    Both neighbours of a range boundary look at the same bytes, so they agree. Where
    there is none (no space or CJK punctuation in a whole halo), the boundary itself.
    """
    start = _char_start(b, at)
    if start == 0 or start >= len(b):
        return start
    before = start - 1
    while before > 0 and b[before] & 0xC0 == 0x80:
        before -= 1
    s = b[before:until].decode("utf-8", "ignore")
    m = _SAFE.search(s, 1)
    return before + len(s[: m.start()].encode()) if m else start


def own_bounds(b: bytes, pos: int, begin: int, total: int, size: int, halo_size: int) -> tuple[int, int]:
    """Where in its bytes the part lies that a range owns: from its first safe cut to that of the next range."""
    if total <= size:
        return 0, len(b)
    first = safe_cut(b, pos - begin, pos - begin + halo_size) if pos else 0
    return first, len(b) if pos + size >= total else safe_cut(b, pos + size - begin, pos + size - begin + halo_size)


def _range_row(
    c: Counter, b: bytes, pos: int, begin: int, total: int, limit: int, overlap: int, count_all: bool, size: int, halo_size: int
) -> tuple:
    """Characters, tokens and cut candidates of the part of a text that a range owns."""
    first, end = own_bounds(b, pos, begin, total, size, halo_size)
    own, halo = b[first:end], b[safe_cut(b, 1, halo_size) if begin else 0 : first]
    text = own.decode("utf-8", "replace")
    none: list = []
    if total <= limit:  # no token is shorter than a byte
        return len(text), int(c.chunks(text)[1].sum()) if count_all else 0, none, none, none, none, none
    chars, tokens, strength = c.chunks(text)
    n_chars, n_tokens = int(chars.sum()), int(tokens.sum())
    if total <= size and n_tokens <= limit:
        return n_chars, n_tokens, none, none, none, none, none
    h_chars, h_tokens, _ = c.chunks(halo.decode("utf-8", "replace"))
    at_chr = np.concatenate([[0], np.cumsum(np.concatenate([h_chars, chars]))]) - int(h_chars.sum())
    at_tok = np.concatenate([[0], np.cumsum(np.concatenate([h_tokens, tokens]))]) - int(h_tokens.sum())
    ends = np.arange(len(h_chars) + 1, len(at_chr))
    # the most natural, then latest, end in each grain
    grain = at_tok[ends] // GRAIN
    order = np.lexsort((ends, strength, grain))
    keep = np.sort(order[np.append(np.flatnonzero(np.diff(grain[order])), len(order) - 1)]) if len(order) else order
    cut = ends[keep]
    back = np.maximum(np.searchsorted(at_tok, at_tok[cut] - overlap, "right") - 1, 0)
    return n_chars, n_tokens, at_tok[cut].tolist(), at_chr[cut].tolist(), strength[keep].tolist(), at_tok[back].tolist(), at_chr[back].tolist()


def _ranges(path: str, keep_text: bool, *settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            parts = list(zip(*(batch.column(n).to_pylist() for n in ("b", "pos", "begin", "total"))))
            rows = [_range_row(c, *x, *settings) for x in parts]
            names = ("n_chars", "n_tokens", "tok", "chr", "strength", "o_tok", "o_chr")
            kinds = (pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 5)
            cols = list(zip(*rows)) or [()] * 7
            out = [batch.column("id"), batch.column("pos"), batch.column("total"), *(pa.array(v, k) for v, k in zip(cols, kinds))]
            if keep_text:
                size, halo = settings[-2:]
                own = [x[0][slice(*own_bounds(*x, size, halo))].decode("utf-8", "replace") if r[1] or x[3] > size else None for x, r in zip(parts, rows)]
                out, names = [*out, pa.array(own, pa.string())], (*names, "own")
            yield pa.RecordBatch.from_arrays(out, ["id", "pos", "total", *names])

    return run


def byte_ranges(texts: DataFrame, size: int, halo: int) -> DataFrame:
    """``(id, pos, total, begin, b)`` of texts (id, t): ranges of ``size`` bytes with ``halo`` bytes on both sides.

    A text of one range stays in the task that read it. The ranges of a longer one are
    spread over all tasks by a shuffle, so that a giant text is no single task; only those are shuffled.
    """
    total = F.octet_length("t")
    zero = F.lit(0)
    short = texts.where(total <= size).select("id", zero.alias("pos"), total.alias("total"), zero.alias("begin"), F.encode("t", "UTF-8").alias("b"))
    pos = F.explode(F.sequence(zero, F.col("total") - 1, F.lit(size))).alias("pos")
    begin = F.greatest(F.col("pos") - halo, zero)
    part = F.substring(F.col("b"), begin + 1, F.col("pos") - begin + size + halo)
    long = texts.where(total > size).select("id", total.alias("total"), F.encode("t", "UTF-8").alias("b")).select("id", "total", "b", pos)
    # a stated number: counting tokens costs far more than the bytes by which small partitions would be put together
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = long.select("id", "pos", "total", begin.alias("begin"), part.alias("b")).repartition(n, "id", "pos")
    return short.unionByName(spread)


def cut_pieces(
    texts: DataFrame,
    record: str,
    text: str,
    limit: int,
    overlap: int = 0,
    tokenizer: str = DEFAULT_TOKENIZER,
    whole: bool = False,
    range_bytes: int = RANGE_BYTES,
    halo_bytes: int = HALO_BYTES,
    with_text: bool = False,
) -> DataFrame:
    """``(record, piece_no, start_char, end_char, n_tokens)`` of each text over ``limit`` tokens.

    Pieces follow each other from number 0 and cover the text; consecutive ones share
    ``overlap`` tokens, or a little more so that a piece starts at a word (at the text's
    start where it has fewer). A piece ends at the most natural boundary (paragraph,
    line, sentence, clause, word) in the last SLACK tokens before its place is full, the
    latest of equals; in a word only where the word alone is longer. No piece exceeds
    ``limit``. Offsets count code points. With ``whole`` texts within the limit come too,
    as one piece. With ``with_text`` each piece also has its text. Null texts and ids are left out, an
    empty text has 0 tokens and, with ``whole``, one empty piece. Ids should be unique; rows that share one are undefined.

    A text is read as ranges of ``range_bytes`` with a halo on both sides, which are spread over
    the tasks, so no worker holds or counts a whole large text; range totals are added up by a prefix sum
    over one slim row a range, which places every candidate boundary in the whole text. The cut at the k-th
    place depends on the boundaries near it alone, not on the cut before, so a giant text's cuts are found in
    parallel. A piece's text is put together from the ranges that it touches.
    """
    room = limit - SLACK - GUARD - (overlap + LARGE if overlap else 0)
    if room < SLACK:
        raise ValueError(f"a limit of {limit} with an overlap of {overlap} leaves no room")
    share(texts.sparkSession, tokenizer)
    docs = texts.select(F.col(record).alias("id"), F.col(text).alias("t")).where("id is not null and t is not null")
    if not whole:
        docs = docs.where(F.octet_length("t") > limit)  # no token is shorter than a byte
    ranges = byte_ranges(docs, range_bytes, halo_bytes)
    longs = T.ArrayType(T.LongType())
    schema = T.StructType().add("id", docs.schema["id"].dataType).add("pos", T.IntegerType()).add("total", T.IntegerType())
    for n, k in (("n_chars", T.LongType()), ("n_tokens", T.LongType()), *((n, longs) for n in ("tok", "chr", "strength", "o_tok", "o_chr"))):
        schema = schema.add(n, k)
    if with_text:
        schema = schema.add("own", T.StringType())
    counted = ranges.mapInArrow(_ranges(tokenizer, with_text, limit, overlap, whole, range_bytes, halo_bytes), schema)
    one = F.col("total") <= range_bytes
    if not whole:
        counted = counted.where(~one | (F.size("tok") > 0) | (F.col("n_tokens") > limit))

    counted = materialise(counted)  # read more than once below; tokens are counted once

    w = Window.partitionBy("id").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    doc = Window.partitionBy("id")
    zero = F.lit(0).cast("bigint")
    sums = counted.where(~one).select("id", "pos", "n_tokens", "n_chars").withColumns({
        "tok0": F.coalesce(F.sum("n_tokens").over(before), zero), "chr0": F.coalesce(F.sum("n_chars").over(before), zero),
        "all_tok": F.sum("n_tokens").over(doc), "all_chr": F.sum("n_chars").over(doc),
    }).drop("n_tokens", "n_chars")
    alone = counted.where(one).withColumns({"tok0": zero, "chr0": zero, "all_tok": F.col("n_tokens"), "all_chr": F.col("n_chars")})
    placed = alone.unionByName(counted.where(~one).join(sums, ["id", "pos"]))
    large = placed.where(F.col("all_tok") > limit)
    cand = F.explode(F.arrays_zip("tok", "chr", "strength", "o_tok", "o_chr")).alias("c")
    candidates = large.select("id", "all_tok", "all_chr", "tok0", "chr0", cand).select(
        "id", "all_tok", "all_chr", (F.col("tok0") + F.col("c.tok")).alias("tok"), (F.col("chr0") + F.col("c.chr")).alias("chr"),
        "c.strength", (F.col("tok0") + F.col("c.o_tok")).alias("o_tok"), (F.col("chr0") + F.col("c.o_chr")).alias("o_chr"),
    )
    place = F.ceil(F.col("tok") / room).cast("bigint")
    cuts = (
        candidates.withColumn("place", place)
        .where((F.col("tok") > F.col("place") * room - SLACK) & (F.col("tok") > 0) & (F.col("tok") < F.col("all_tok")))
        .groupBy("id", "place")
        .agg(F.max(F.struct("strength", "tok", "chr", "o_tok", "o_chr")).alias("c"), F.first("all_tok").alias("all_tok"), F.first("all_chr").alias("all_chr"))
        .select("id", "place", "all_tok", "all_chr", "c.tok", "c.chr", "c.o_tok", "c.o_chr")
    )
    v = Window.partitionBy("id").orderBy("place")
    # the last cut isn't needed where the piece before it reaches the end
    start_tok, start_chr = F.coalesce(F.lag("o_tok").over(v), zero), F.coalesce(F.lag("o_chr").over(v), zero)
    cuts = cuts.withColumns({"from_tok": start_tok, "from_chr": start_chr, "is_last": F.lead("place").over(v).isNull()})
    needless = F.col("is_last") & (F.col("all_tok") - F.col("from_tok") <= limit)
    inner = cuts.select(
        "id", "place", F.col("from_chr").alias("start_char"),
        F.when(needless, F.col("all_chr")).otherwise(F.col("chr")).alias("end_char"),
        (F.when(needless, F.col("all_tok")).otherwise(F.col("tok")) - F.col("from_tok")).alias("n_tokens"),
    )
    tail = cuts.where(F.col("is_last") & ~needless).select(
        "id", (F.col("place") + 1).alias("place"), F.col("o_chr").alias("start_char"), F.col("all_chr").alias("end_char"),
        (F.col("all_tok") - F.col("o_tok")).alias("n_tokens"),
    )
    pieces = inner.unionByName(tail)
    numbered = pieces.select("id", (F.row_number().over(v) - 1).alias("piece_no"), "start_char", "end_char", "n_tokens")
    if whole:
        small = placed.where((F.col("all_tok") <= limit) & (F.col("pos") == 0)).select(
            "id", F.lit(0).alias("piece_no"), zero.alias("start_char"), F.col("all_chr").alias("end_char"), F.col("all_tok").alias("n_tokens")
        )
        numbered = numbered.unionByName(small)
    if with_text:
        numbered = _texts(numbered, placed.select("id", "pos", "chr0", "n_chars", "own"), range_bytes)
    return numbered.withColumnRenamed("id", record)


def _texts(pieces: DataFrame, ranges: DataFrame, size: int) -> DataFrame:
    """The pieces with column text, joined from the parts of the ranges (id, pos, chr0, n_chars, own) they touch.

    Pieces and ranges meet in blocks of ``size`` characters, of which either touches a few, so neither
    a whole text nor all pieces of one come to one task; each pair is kept in the block where it begins.
    """
    block = lambda c: F.floor(c / size)
    a, b = F.col("start_char"), F.greatest(F.col("end_char") - 1, F.col("start_char"))
    p = pieces.withColumn("_b", F.explode(F.sequence(block(a), block(b))))
    c, d = F.col("chr0"), F.greatest(F.col("chr0") + F.col("n_chars") - 1, F.col("chr0"))
    r = ranges.withColumn("_b", F.explode(F.sequence(block(c), block(d))))
    lo, hi = F.greatest("start_char", "chr0"), F.least(F.col("end_char"), F.col("chr0") + F.col("n_chars"))
    met = p.join(r, ["id", "_b"]).where(((lo < hi) | (F.col("n_tokens") == 0)) & (block(lo) == F.col("_b")))
    part = F.substring("own", (lo - F.col("chr0") + 1).cast("int"), (hi - lo).cast("int"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", part.alias("t")))), lambda x: x["t"]), "")
    return met.groupBy("id", "piece_no", "start_char", "end_char", "n_tokens").agg(joined.alias("text"))
