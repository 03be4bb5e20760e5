"""Words of texts without spaces: a dictionary from the corpus and forward maximum matching."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions import config as C
from chalkline.plans.session import materialise, shuffled

HAN = r"[\x{4e00}-\x{9fff}]"
LONGEST = 6


def pieces(text: Column) -> Column:
    """Runs of Han characters and runs of other letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.regexp_replace(text, f"({HAN}+)", " $1 "), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def han_runs(texts: DataFrame, text: str) -> DataFrame:
    """``(run, n)``: the distinct runs of Han characters of the texts and how often each occurs."""
    p = texts.select(F.explode(pieces(F.col(text))).alias("run")).where(F.col("run").rlike(f"^{HAN}"))
    return p.groupBy("run").agg(F.count("*").alias("n"))


def _grams(runs: DataFrame, least: int, most: int, *keep: str) -> DataFrame:
    """``(keep, g, before, after)``: the n-grams of each run, with the characters around them ('' at an edge)."""
    at = runs.select("run", *keep, F.explode(F.sequence(F.lit(1), F.length("run"))).alias("_p"))
    n = F.explode(F.sequence(F.lit(least), F.least(F.lit(most), F.length("run") - F.col("_p") + 1)))
    spans = at.where(F.col("_p") + least - 1 <= F.length("run")).select("run", *keep, "_p", n.alias("_n"))
    around = lambda at: F.when(at >= 1, F.substr("run", F.greatest(at, F.lit(1)), F.lit(1))).otherwise("")
    return spans.select(*keep, F.substr("run", F.col("_p"), F.col("_n")).alias("g"), around(F.col("_p") - 1).alias("before"), F.substr("run", F.col("_p") + F.col("_n"), F.lit(1)).alias("after"))


def corpus_words(runs: DataFrame, least: int = 5, cohesion: float = 20.0, freedom: int = 3, loose: Iterable[str] = C.STOP_WORDS) -> DataFrame:
    """``(w)``: the Han n-grams of two to LONGEST characters that ``runs`` (run, n) support as words.

    A word occurs ``least`` times, each of its divisions in two occurs ``cohesion`` times as often
    as its parts would by chance, ``freedom`` different characters (or an edge) stand before
    it and as many behind, and it neither begins nor ends with a stop word of one character. Counts are
    over all runs, partial before the shuffle, one row a distinct n-gram after it.
    """
    singles = [w for w in loose if len(w) == 1]
    grams = _grams(runs, 1, LONGEST, "n").groupBy("g", "before", "after").agg(F.sum("n").alias("n"))
    counts = grams.groupBy("g").agg(
        F.sum("n").alias("c"), F.size(F.collect_set("before")).alias("l"), F.size(F.collect_set("after")).alias("r")
    )
    # rare n-grams are neither words nor parts of any
    counts = materialise(counts.where(F.col("c") >= least))
    total = runs.agg(F.sum(F.length("run") * F.col("n")).alias("total"))
    w = counts.where((F.length("g") >= 2) & (F.col("l") >= freedom) & (F.col("r") >= freedom))
    w = w.where(~F.substring("g", 1, 1).isin(*singles) & ~F.expr("right(g, 1)").isin(*singles))
    cut = F.explode(F.sequence(F.lit(1), F.length("g") - 1)).alias("_k")
    parts = w.select("g", "c", cut).select("g", "c", F.substr("g", F.lit(1), F.col("_k")).alias("a"), F.substr("g", F.col("_k") + 1).alias("b"))
    a, b = (counts.select(F.col("g").alias(x), F.col("c").alias(f"c_{x}")) for x in "ab")
    tied = parts.join(shuffled(a), "a").join(shuffled(b), "b").join(F.broadcast(total), how="cross")  # one row
    worst = tied.groupBy("g").agg(F.min(F.col("c") * F.col("total") / (F.col("c_a") * F.col("c_b"))).alias("_x"))
    return worst.where(F.col("_x") >= cohesion).select(F.col("g").alias("w"))


def fixed_words(*lists: Iterable[str]) -> list[str]:
    """The Han words of two and more characters of the lists, each once, in order of letters."""
    return sorted({w for x in lists for w in x if len(w) >= 2 and all("一" <= c <= "鿿" for c in w)})


def patterns(runs: DataFrame, words: DataFrame) -> DataFrame:
    """``(run, _pattern)``: the words (w) that occur in each run (run), the longest first, as alternatives.

    Words are joined to a run by its n-grams, so the dictionary is never sent to every task. Runs without a word are left out.
    """
    own = _grams(runs.select("run", F.col("run").alias("_r")), 2, LONGEST, "_r").select(F.col("_r").alias("run"), F.col("g").alias("w"))
    ranked = F.sort_array(F.collect_set(F.struct((-F.length("w")).alias("n"), "w")))
    return own.join(shuffled(words.distinct()), "w").groupBy("run").agg(F.array_join(F.transform(ranked, lambda x: x["w"]), "|").alias("_pattern"))


def segmented(runs: DataFrame, words: DataFrame) -> DataFrame:
    """``(run, tokens)``: each run of ``runs`` (run) by forward maximum matching over ``words`` (w).

    From left to right the longest word that starts at a place is taken; a character at
    which none starts is a token of its own and left out. The match is a pattern of the run's words, the
    longest first. Words over LONGEST characters are not found.
    """
    return patterns(runs, words).select("run", F.regexp_extract_all("run", F.col("_pattern"), F.lit(0)).alias("tokens"))


def dictionary(runs: DataFrame) -> DataFrame:
    """``(w)``: domain terms, stop words and those the corpus supports."""
    listed = fixed_words(C.TERMS, C.STOP_WORDS, C.KEYWORD_BLACKLIST)
    fixed = runs.sparkSession.createDataFrame([(w,) for w in listed], "w string")
    return fixed.unionByName(corpus_words(runs)).distinct()


def tokenised(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``(keys, token, c)``: how often each token occurs in each text, Han runs by the :func:`dictionary` of all texts.

    Rows of equal keys are one text. Null and empty texts have no tokens.
    """
    p = texts.select(*keys, F.explode(pieces(F.col(text))).alias("run")).groupBy(*keys, "run").agg(F.count("*").alias("c"))
    p = materialise(p)  # read three times
    han = F.col("run").rlike(f"^{HAN}")
    runs = p.where(han).groupBy("run").agg(F.sum("c").alias("n"))
    cut = segmented(runs, dictionary(runs))
    # a run that many texts share is split over tasks by the join's skew handling; it has one row on the other side
    words = p.where(han).join(shuffled(cut), "run").select(*keys, F.explode("tokens").alias("token"), "c")
    both = words.unionByName(p.where(~han).select(*keys, F.col("run").alias("token"), "c"))
    return both.groupBy(*keys, "token").agg(F.sum("c").alias("c"))

