"""Repairing text recognised from scanned pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.plans.session import materialise

# What a recogniser reads (second) in place of what is printed (first).
CONFUSIONS = (
    ("e", "c"), ("c", "e"), ("m", "rn"), ("rn", "m"), ("w", "vv"), ("d", "cl"), ("cl", "d"), ("li", "h"), ("h", "li"),
    ("o", "0"), ("l", "1"), ("i", "1"), ("t", "1"), ("i", "!"), ("l", "!"), ("s", "5"), ("g", "9"), ("q", "9"), ("b", "6"),
    ("g", "6"), ("b", "8"), ("z", "2"), ("a", "4"), ("a", "@"), ("s", "$"), ("e", "3"), ("t", "7"), ("l", "|"), ("i", "|"),
    ("i", "l"), ("l", "i"), ("u", "v"), ("v", "u"), ("n", "ri"), ("u", "ii"), ("c", "("), ("t", "+"),
)
#: A variant must be this many times as frequent, and occur this often, to correct a word.
RATIO, LEAST = 10, 5
#: Han characters: so many corrections make a known confusion, which then needs so many times the count.
LEARNED, SURE = 3, 3
#: Share of a recording's pages that carry a running line.
RUNNING_SHARE = 0.25

_FULL = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
_HALF = "".join(chr(0x21 + i) for i in range(94)) + " "
_PAGE = (
    r"(?i)^[^\p{L}\p{N}]*(?:(?:page|p\.?|第)\s*[0-9lio]{1,4}|(?=[lio]*[0-9])[0-9lio]{1,4}|[lio]{1,2})"
    r"\s*页?\s*(?:(?:/|of)\s*[0-9lio]{1,4})?\s*[^\p{L}\p{N}]*$"
)
_HYPHEN = r"[-‐‑¬­–]\s*$"
_HAN = r"[\x{3400}-\x{9FFF}]"
_SENTENCE_END = r"[.。!！?？,，;；:：]$"
#: A line shorter than this share of its page's widest is no wrapped one.
SHORT = 0.6
#: Bits of a character in a trigram's number.
BITS = 21
#: A recording's running lines are joined in so many copies, so that its pages spread over as many tasks.
SALT = 16


def _width(c: Column) -> Column:
    return F.trim(F.translate(c, _FULL, _HALF))


def page_lines(pages: DataFrame, record: str, recording: str, text: str) -> DataFrame:
    """One row a page: id, rec and ``l``, its lines that aren't blank as (no, raw, norm)."""
    lines = F.split(F.col(text), r"\r\n|\n|\r")
    rows = pages.select(F.col(record).alias("id"), F.col(recording).alias("rec"), lines.alias("l")).where("id is not null and l is not null")
    each = F.transform("l", lambda x, i: F.struct((i + 1).alias("no"), x.alias("raw"), _width(x).alias("norm")))
    return rows.select("id", "rec", F.filter(each, lambda x: x["raw"].rlike(r"[^\s\p{Z}\p{C}]")).alias("l"))


def _edge_kinds(pages: DataFrame) -> DataFrame:
    """Pages of :func:`page_lines` as (id, edge, body): the page numbers and running lines (no, kind), and the other lines."""
    numbered = lambda x, i: ((i == 0) | (i == F.size("l") - 1)) & x["norm"].rlike(_PAGE)
    base = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x["norm"]), r"[^\p{L}\p{N}]+", ""), r"[0-9]+$", "")
    rows = pages.withColumn("number", F.filter("l", numbered)).withColumn("b", F.filter("l", lambda x, i: ~numbered(x, i)))
    rows = materialise(rows.select("id", "rec", F.transform("number", lambda x: x["no"]).alias("number"), "b", F.transform("b", base).alias("base")))
    m = F.size("base")
    far = F.array_max(F.slice("base", 2, F.greatest(m - 2, F.lit(0))))
    edge = lambda k, up, down: F.struct(k.alias("k"), F.get("base", k).alias("base"), up.alias("up"), down.alias("down"))
    none = F.lit(None).cast("string")
    ends = F.array(edge(F.lit(0), none, F.get("base", F.lit(1))), F.when(m > 1, edge(m - 1, F.get("base", m - 2), none)))
    edges = rows.where("size(base) > 0").select("rec", far.alias("far"), F.explode(F.filter(ends, lambda x: x.isNotNull())).alias("e")).select("rec", "far", "e.*")
    edges = edges.where("length(base) >= 3 and rec is not null")
    # a page shown again is no second page: its other lines are the same but for a misread one
    beside = F.array(*(F.struct(F.lit(n).alias("side"), x.alias("text")) for n, x in enumerate(
        (F.coalesce("down", F.lit("")), F.coalesce("up", F.lit("")), F.coalesce("far", "down", "up", F.lit("")))
    )))
    seen = edges.select("rec", "base", F.explode(beside).alias("x")).distinct().groupBy("rec", "base").agg(*(F.count_if(F.col("x.side") == n).alias(f"s{n}") for n in range(3)))
    seen = seen.select("rec", "base", F.least(F.greatest("s0", "s1"), "s2").alias("times")).where("times >= 2")
    n_pages = rows.where("size(base) > 0").select("rec", F.coalesce(far, F.lit(""))).distinct().groupBy("rec").agg(F.count("*").alias("pages"))
    # no more than two lines a page have a share, so a recording has only a few running lines
    running = seen.join(n_pages, "rec").where(F.col("times") >= RUNNING_SHARE * F.col("pages")).groupBy("rec").agg(F.collect_set("base").alias("runs"))
    copies = running.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(copies, ["rec", "salt"], "left")
    near = lambda c: F.exists(F.coalesce("runs", F.array().cast("array<string>")), lambda r: F.levenshtein(c, r) <= F.greatest(F.lit(1), F.floor(F.length(r) * 0.2)))
    runs = lambda x, i: ((i == 0) | (i == m - 1)) & (F.length(F.get("base", i)) >= 3) & near(F.get("base", i))
    kinds = lambda c, kind: F.transform(c, lambda n: F.struct(n.alias("no"), F.lit(kind).alias("kind")))
    headers = F.transform(F.filter("b", runs), lambda x: x["no"])
    marked = salted.withColumn("header", headers)
    return marked.select("id", F.concat(kinds("number", "page_number"), kinds("header", "header")).alias("edge"), F.filter("b", lambda x: ~F.array_contains("header", x["no"])).alias("body"))


def _anagram(c: Column) -> Column:
    """The same for any order of the same letters; differences tell which letters were swapped."""
    return F.aggregate(F.split(c, ""), F.lit(0).cast("bigint"), lambda a, x: a + F.when(x == "", F.lit(0)).otherwise(F.pmod(F.xxhash64(x), F.lit(2**31 - 1))))


def word_corrections(words: DataFrame, known: DataFrame) -> DataFrame:
    """``(w, v)``: for words ``(w, n)`` the most frequent of the ``known`` words ``(w, n)`` that one confusion turns into w.

    Joined by anagram hash: a confusion adds a fixed difference to a word's hash, so
    each rare word looks up the hashes that its possible confusions lead to.
    """
    spark = words.sparkSession
    pairs = spark.createDataFrame(list(CONFUSIONS), "was string, seen string")
    pairs = pairs.withColumn("delta", _anagram(F.col("was")) - _anagram(F.col("seen")))
    frequent = known.where((F.col("n") >= LEAST) & F.col("w").rlike(r"^\p{L}[\p{L}'-]+$")).select(
        F.col("w").alias("v"), F.col("n").alias("vn"), _anagram(F.col("w")).alias("h")
    )
    # the letters and pairs of letters of a word, to meet those of the fixed list
    at = F.sequence(F.lit(1), F.length("w"))
    held = F.explode(F.array_distinct(F.concat(F.transform(at, lambda k: F.substr("w", k, F.lit(1))), F.transform(at, lambda k: F.substr("w", k, F.lit(2)))))).alias("seen")
    looked = (
        words.where("w <> ''").select("w", "n", _anagram(F.col("w")).alias("a"), held)
        .join(F.broadcast(pairs), "seen")
        .withColumn("h", F.col("a") + F.col("delta"))
        .join(frequent, "h")
        .where(F.col("vn") >= RATIO * F.greatest("n", F.lit(1)))
    )
    size = F.length("seen")
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(F.length("w") - size + 1, F.lit(1))),
        lambda k: (F.substr("w", k, size) == F.col("seen"))
        & (F.concat(F.substr("w", F.lit(1), k - 1), F.col("was"), F.substr("w", k + size)) == F.col("v")),
    )
    return looked.where(swapped).groupBy("w").agg(F.max_by("v", F.struct("vn", "v")).alias("v"))


def _gram_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trigrams of each text as numbers, three characters of BITS bits each; 0 where fewer than two are Han or a break lies between."""
    for batch in batches:
        parts = [t.split("\n") for t in batch.column("s").to_pylist()]
        codes = np.frombuffer("".join(x for t in parts for x in t).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        part = np.repeat(np.arange(sum(map(len, parts))), [len(x) for t in parts for x in t])
        ends = np.cumsum([sum(map(len, t)) for t in parts])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        han = ((codes >= 0x3400) & (codes <= 0x9FFF)).astype(np.int8)
        g = np.zeros(len(codes), np.int64)
        g[:-2] = (codes[:-2] << 2 * BITS) | (codes[1:-1] << BITS) | codes[2:]
        g[:-2][(han[:-2] + han[1:-1] + han[2:] < 2) | (part[:-2] != part[2:])] = 0
        # a text's last two places begin no trigram
        sizes = np.maximum(ends - starts - 2, 0)
        keep = np.arange(len(codes)) < np.repeat(starts + sizes, ends - starts)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("t"), pa.ListArray.from_arrays(offsets, pa.array(g[keep]))], ["t", "g"])


def _letter(g: Column, k: int) -> Column:
    return F.shiftright(g, BITS * (3 - k)).bitwiseAND(F.lit((1 << BITS) - 1))


def _gram_hash(g: Column) -> Column:
    """The anagram hash of a trigram's number: the same for any order of its characters."""
    return sum((_letter_hash(_letter(g, k)) for k in (2, 3)), _letter_hash(_letter(g, 1)))


def _letter_hash(code: Column) -> Column:
    return F.pmod(F.xxhash64(code), F.lit(2**31 - 1))


def _han_misreads(pages: DataFrame) -> DataFrame:
    """``(id, line_no, at, c)``: the character at code point ``at`` of a line should be ``c``; ``pages`` has (id, body).

    Han text has no spaces, so its words are the trigrams. A rare trigram and one RATIO times as
    frequent that differs in one character differ in their anagram hash by what sets the two characters apart,
    whatever the rest. A character is corrected where two of the trigrams that cover it each have one that frequent with the
    same other character; the differences met LEARNED times that way are the confusions of this scanner. Every
    trigram that holds a confusion's character then looks up, by its hash and the difference, the trigram that it may have been,
    and the character is also corrected where one of these has SURE times the count and none that covers it speaks against it.
    Trigrams go over line ends, but not from a title or caption to what follows.
    Counts are over distinct pages, so that a page shown again doesn't make its faults frequent.
    """
    strip = lambda x: F.regexp_replace(x["raw"], r"[\s\p{Z}]+$|^[\s\p{Z}]+", "")
    lead = lambda x: F.length(x["raw"]) - F.length(F.regexp_replace(x["raw"], r"^[\s\p{Z}]+", ""))
    lines = F.transform(F.filter("body", lambda x: x["raw"].rlike(_HAN)), lambda x: F.struct(x["no"].alias("no"), strip(x).alias("t"), lead(x).alias("lead")))
    own = pages.select("id", lines.alias("l")).where("size(l) > 0").withColumn("widest", F.array_max(F.transform("l", lambda x: F.length(x["t"]))))
    # a title, and a short line without an end in the midst of others, stand alone; what is around them goes on over them
    alone = lambda x, i: ~x["t"].rlike(_SENTENCE_END) & ((i == 0) | ((F.length(x["t"]) < SHORT * F.col("widest")) & (i < F.size("l") - 1)))
    running, apart = F.filter("l", lambda x, i: ~alone(x, i)), F.filter("l", alone)
    own = own.select("id", running.alias("l"), apart.alias("apart"))
    texts_of = lambda c: F.transform(c, lambda x: x["t"])
    s = F.array_join(F.concat(F.array(F.array_join(texts_of("l"), "")), texts_of("apart")), "\n")
    own = own.select("id", F.concat("l", "apart").alias("l"), s.alias("s")).withColumn("t", F.struct(F.xxhash64("s").alias("x"), F.hash("s").alias("y")))
    own = materialise(own)
    # every distinct text once, known by two hashes
    texts = own.groupBy("t").agg(F.first("s").alias("s"))
    grams = materialise(texts.mapInArrow(_gram_codes, T.StructType().add("t", own.schema["t"].dataType).add("g", T.ArrayType(T.LongType()))))
    counts = materialise(grams.select(F.explode("g").alias("g")).where("g <> 0").groupBy("g").agg(F.count("*").alias("n")))
    hole = lambda k: F.col("g").bitwiseAND(F.lit(~(((1 << BITS) - 1) << BITS * (3 - k))))
    forms = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), _letter(F.col("g"), k).alias("c"), hole(k).alias("m")) for k in (1, 2, 3)))).alias("x")
    masked = counts.select("g", "n", forms).select("g", "n", "x.*").where(F.col("c").between(0x3400, 0x9FFF))
    best = masked.groupBy("k", "m").agg(F.max(F.struct("n", "c")).alias("b"))
    votes = materialise(
        masked.join(best, ["k", "m"])
        .where((F.col("b.c") != F.col("c")) & (F.col("b.n") >= LEAST) & (F.col("b.n") >= RATIO * F.col("n")))
        .select("g", "k", F.col("c").alias("was"), F.col("b.c").alias("to"), F.col("b.n").alias("n"))
    )
    placed = grams.select("t", F.posexplode("g").alias("p", "g")).where("g <> 0")
    met = lambda marks: placed.join(marks, "g").withColumn("p", F.col("p") + F.col("k"))
    cast = materialise(
        met(votes).groupBy("t", "p", "was", "to").agg(F.count("*").alias("votes"), F.sum("n").alias("n")).where("votes >= 2")
        .groupBy("t", "p").agg(F.max_by(F.struct("was", "to"), F.struct("votes", "n", "to")).alias("x")).select("t", "p", "x.*")
    )
    delta = _letter_hash(F.col("to")) - _letter_hash(F.col("was"))
    learned = cast.groupBy(delta.alias("delta"), "was", "to").agg(F.count("*").alias("times")).where(F.col("times") >= LEARNED)
    hashed = counts.withColumn("h", _gram_hash(F.col("g")))
    put = lambda k: F.when(F.col("k") == k, hole(k).bitwiseOR(F.shiftleft("to", BITS * (3 - k))))
    tried = (
        masked.join(learned.select(F.col("was").alias("c"), "to", "delta"), "c")
        .select("g", "k", "to", "n", F.coalesce(*map(put, (1, 2, 3))).alias("other"), (_gram_hash(F.col("g")) + F.col("delta")).alias("h"))
    )
    weighed = tried.join(hashed.select(F.col("g").alias("other"), F.col("n").alias("m"), "h"), ["h", "other"], "left").select(
        "g", "k", "to", ((F.col("m") >= SURE * F.col("n")) & (F.col("m") >= SURE)).cast("int").alias("pro"),
        (F.col("n") > F.greatest(F.coalesce("m", F.lit(0)), F.lit(1))).cast("int").alias("con"),
    )
    single = (
        met(materialise(weighed)).groupBy("t", "p", "to").agg(F.sum("pro").alias("pro"), F.sum("con").alias("con")).where("pro > 0 and con = 0")
        .groupBy("t", "p").agg(F.max_by("to", F.struct("pro", "to")).alias("to"))
    )
    cast = cast.select("t", "p", "to").unionByName(single.join(cast, ["t", "p"], "left_anti"))
    ends = F.transform("l", lambda x, i: F.struct(
        x["no"].alias("no"), x["lead"].alias("lead"),
        F.aggregate(F.slice("l", 1, i), F.lit(0), lambda a, y: a + F.length(y["t"])).alias("before"), F.length(x["t"]).alias("n"),
    ))
    here = F.filter("e", lambda x: (F.col("p") > x["before"]) & (F.col("p") <= x["before"] + x["n"]))[0]
    place = own.select("id", "t", "l").join(cast, "t").select("id", "p", "to", ends.alias("e")).select("id", "p", "to", here.alias("e"))
    letter = F.decode(F.unhex(F.lpad(F.hex("to"), 4, "0")), "UTF-16BE")
    return place.select("id", F.col("e.no").alias("line_no"), (F.col("p") - F.col("e.before") + F.col("e.lead")).alias("at"), letter.alias("c"))


def _word(token: Column) -> Column:
    """A token without the punctuation around it, in lower case."""
    return F.lower(F.regexp_replace(token, r"^[^\p{L}\p{N}!|$@(+]+|[^\p{L}\p{N}]+$", ""))


def repair(pages: DataFrame, record: str, recording: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Found faults ``(record, line_no, kind)`` and repaired pages ``(record, text)``.

    Kinds: 'page_number' a first or last line with nothing but the page's number; 'header' a
    line at the edge of a page that runs through RUNNING_SHARE of the recording's pages, but for a
    tenth or so of its letters; 'hyphen' a line ending in a word broken across lines whose
    whole form has no hyphen, judged by how often the whole and the hyphenated form occur
    elsewhere; 'misread' a line with a word, or part of a broken one, that a ranked correction
    changes. The repaired text has neither running lines nor page numbers, broken words whole, words
    corrected, and its lines joined into paragraphs; a title line and text after a blank line start one.
    Lines count from 1. Pages with a null id or text are left out, an empty page gives an
    empty text, a page without recording has no header. Repeated ids are undefined.
    """
    kept = materialise(_edge_kinds(page_lines(pages, record, recording, text)))
    w = Window.partitionBy("id").orderBy("line_no")
    # the rest of a broken word stands in the next line, or behind one line that came between
    begins = kept.withColumn("br", F.transform("body", lambda x, i: x["norm"].rlike(r"\p{L}" + _HYPHEN) & (i < F.size("body") - 1)))
    at = lambda c, i: F.get(c, F.when(i >= 0, i))
    line = lambda x, i: F.struct(
        x["no"].alias("line_no"), x["raw"].alias("raw"), x["norm"].alias("norm"), F.get("br", i).alias("broken"),
        F.when(at("br", i - 1), 1).when(at("br", i - 2), 2).otherwise(0).alias("after"),
        F.array(*(F.element_at(F.split(F.get("body", i + k)["norm"], r"\s+"), 1) for k in (1, 2))).alias("next"),
        F.array(*(F.get("body", i + k)["no"] for k in (1, 2))).alias("next_no"),
    )
    cut = begins.select("id", F.explode(F.transform("body", line)).alias("x")).select("id", "x.*")
    cut = materialise(cut)
    tokens = cut.select(
        "id", "line_no", "broken", "after", F.posexplode(F.split("norm", r"\s+")).alias("i", "token"),
        F.size(F.split("norm", r"\s+")).alias("of"),
    ).where(~F.col("token").rlike(_HAN) & F.col("token").rlike(r"\p{L}"))
    words = (
        tokens.where(~(F.col("broken") & (F.col("i") == F.col("of") - 1)) & ~((F.col("after") == 1) & (F.col("i") == 0)))
        .withColumn("w", _word("token"))
        .where("length(w) >= 2")
    )
    # what may be the rest of a broken word is checked, but isn't counted as a word
    sure = F.when((F.col("after") == 0) | (F.col("i") > 0), 1).otherwise(0)
    seen = materialise(words.groupBy("w").agg(F.sum(sure).alias("n")))
    known = seen.where("n > 0")

    # broken words, whole and with their hyphen
    left = F.regexp_replace(F.element_at(F.split("norm", r"\s+"), -1), _HYPHEN, "")
    halves = cut.where("broken").select(
        "id", "line_no", F.lower(F.regexp_replace(left, r"^[^\p{L}\p{N}!|$@]+", "")).alias("a"), "next_no", F.posexplode("next").alias("skip", "b")
    ).withColumn("b", _word(F.col("b"))).where("b is not null")
    halves = halves.withColumn("joined", F.concat("a", "b")).withColumn("hyphened", F.concat_ws("-", "a", "b"))
    forms = halves.select(F.explode(F.array("joined", "hyphened")).alias("w")).distinct()
    frequency = forms.join(known, "w", "left").select("w", F.coalesce("n", F.lit(0)).alias("n"))
    fixes = materialise(word_corrections(seen.unionByName(frequency.join(seen, "w", "left_anti")), known))
    judged = frequency.join(fixes, "w", "left").join(known.select(F.col("w").alias("v"), F.col("n").alias("vn")), "v", "left")
    strength = judged.select("w", "v", F.greatest("n", F.coalesce("vn", F.lit(0))).alias("f"))
    one = strength.select(F.col("w").alias("joined"), F.col("v").alias("v_joined"), F.col("f").alias("f_joined"))
    two = strength.select(F.col("w").alias("hyphened"), F.col("v").alias("v_hyphened"), F.col("f").alias("f_hyphened"))
    alone = known.select(F.col("w").alias("a"), F.col("n").alias("n_a"))
    other = known.select(F.col("w").alias("b"), F.col("n").alias("n_b"))
    decided = (
        halves.join(one, "joined").join(two, "hyphened").join(alone, "a", "left").join(other, "b", "left")
        .withColumn(
            "is_whole",
            F.when(F.col("f_joined") != F.col("f_hyphened"), F.col("f_joined") > F.col("f_hyphened"))
            .otherwise(F.col("n_a").isNull() | F.col("n_b").isNull()),
        )
        .withColumn("v", F.when(F.col("is_whole"), F.col("v_joined")).otherwise(F.col("v_hyphened")))
        .withColumn("f", F.greatest("f_joined", "f_hyphened"))
        .groupBy("id", "line_no")
        .agg(F.max_by(F.struct("is_whole", "a", "b", "v", "skip", "next_no"), F.struct("f", -F.col("skip"))).alias("x"))
        .select("id", "line_no", "x.*")
    )
    decided = materialise(decided)
    # the corrected whole is divided where its ends equal the halves'
    prefix = F.coalesce(F.expr("array_max(filter(sequence(0, least(length(a), length(v))), k -> substring(a, 1, k) = substring(v, 1, k)))"), F.lit(0))
    in_left = F.col("v").isNotNull() & (prefix < F.length("a"))
    in_right = F.col("v").isNotNull() & ~in_left
    split_misread = decided.select(
        "id", F.explode(F.array(F.when(in_left, F.col("line_no")), F.when(in_right, F.get("next_no", F.col("skip"))))).alias("line_no")
    ).where("line_no is not null")
    fixed_words = words.join(fixes, "w").select("id", "line_no", "i", "w", "v")
    han = materialise(_han_misreads(kept))
    found = (
        kept.select("id", F.explode("edge").alias("e")).select("id", F.col("e.no").alias("line_no"), "e.kind")
        .unionByName(decided.where("is_whole").select("id", "line_no", F.lit("hyphen").alias("kind")))
        .unionByName(
            split_misread.unionByName(fixed_words.select("id", "line_no")).unionByName(han.select("id", "line_no"))
            .distinct().withColumn("kind", F.lit("misread"))
        )
    )

    # the repaired text: each line's tokens with their corrections, then lines into paragraphs
    by_line = fixed_words.groupBy("id", "line_no").agg(F.map_from_entries(F.collect_set(F.struct("w", "v"))).alias("fix"))
    by_char = han.groupBy("id", "line_no").agg(F.map_from_entries(F.collect_list(F.struct("at", "c"))).alias("chars"))
    ends = decided.select("id", "line_no", "is_whole")
    none_c, none_w = F.create_map().cast("map<int,string>"), F.create_map().cast("map<string,string>")
    dressed = (
        cut.join(by_line, ["id", "line_no"], "left").join(by_char, ["id", "line_no"], "left").join(ends, ["id", "line_no"], "left")
        .withColumn("t", F.when(F.col("chars").isNull(), F.col("raw")).otherwise(F.array_join(F.transform(F.split("raw", ""), lambda c, i: F.coalesce(F.try_element_at(F.coalesce("chars", none_c), i + 1), c)), "")))
        .withColumn("t", F.when(F.col("fix").isNull(), F.col("t")).otherwise(F.array_join(F.transform(F.split("t", r"\s+"), lambda x: _replaced(x, F.try_element_at(F.coalesce("fix", none_w), _word(x)))), " ")))
        .withColumn("t", F.regexp_replace("t", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
        .withColumn("t", F.when(F.col("is_whole"), F.regexp_replace("t", _HYPHEN, "")).otherwise(F.col("t")))
    )
    title = (F.row_number().over(w) == 1) & ~F.col("t").rlike(r"[.。!！?？,，;；:：]$") & ~F.coalesce("broken", F.lit(False))
    gap = F.col("line_no") - F.lag("line_no").over(w) > 1
    glued = F.coalesce(F.lag("broken").over(w), F.lit(False)) | (F.lag("t").over(w).rlike(_HAN + r"$|[，。；：、？！）”》]$") & F.col("t").rlike("^" + _HAN + r"|^[，。；：、？！（“《0-9]"))
    marked = dressed.withColumn("title", title)
    marked = marked.withColumn(
        "sep", F.when(F.lag("title").over(w) | F.coalesce(gap & F.lag("t").over(w).rlike(r"[.。!！?？]$"), F.lit(False)), "\n\n").when(F.row_number().over(w) == 1, "").when(glued, "").otherwise(" ")
    )
    texts = marked.groupBy("id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "sep", "t"))), lambda x: F.concat(x["sep"], x["t"])), "").alias("text")
    )
    everything = pages.select(F.col(record).alias("id")).where(F.col(record).isNotNull() & F.col(text).isNotNull())
    repaired = everything.join(texts, "id", "left").select(F.col("id").alias(record), F.coalesce("text", F.lit("")).alias("text"))
    return found.withColumnRenamed("id", record), repaired


def _replaced(token: Column, v: Column) -> Column:
    """A token with its word exchanged for ``v``, punctuation and a capital kept."""
    lead = F.regexp_extract(token, r"^([^\p{L}\p{N}!|$@(+]*)", 1)
    tail = F.regexp_extract(token, r"([^\p{L}\p{N}]*)$", 1)
    cased = F.when(F.regexp_replace(token, r"^[^\p{L}\p{N}]+", "").rlike(r"^\p{Lu}"), F.initcap(v)).otherwise(v)
    return F.coalesce(F.concat(lead, cased, tail), token)
