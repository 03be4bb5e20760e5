"""Han characters in the other script and in Latin letters, by the transliteration rules of the ICU library that Spark ships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Conversions by mode; the tables are made from ICU's rules, one entry a character.
MODES = {"t2s": "Traditional-Simplified", "s2t": "Simplified-Traditional"}
_HAN = [*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000), *range(0xF900, 0xFB00)]
_made: dict[str, list[str]] = {}


def _each(spark: SparkSession, rules: str) -> list[str] | None:
    """What ICU makes of every Han character; None where the library is missing."""
    if rules not in _made:
        try:
            icu = spark._jvm.com.ibm.icu.text.Transliterator.getInstance(rules)
        except TypeError:
            return None
        _made[rules] = icu.transliterate("\n".join(map(chr, _HAN))).split("\n")
    return _made[rules]


def script_table(spark: SparkSession, mode: str) -> tuple[str, str, str]:
    """``(status, characters, their forms in the other script)``; status is ok, disabled, missing or invalid_mode."""
    if mode.strip().lower() in ("", "none", "off", "false"):
        return "disabled", "", ""
    if mode not in MODES:
        return "invalid_mode", "", ""
    made = _each(spark, MODES[mode])
    if made is None:
        return "missing", "", ""
    pairs = [(chr(c), x) for c, x in zip(_HAN, made) if len(x) == 1 and x != chr(c)]
    return "ok", "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def convert_script(text: Column, table: tuple[str, str, str]) -> Column:
    """``text`` in the other script, character by character."""
    return F.translate(text, table[1], table[2]) if table[0] == "ok" else text


def romanisation(spark: SparkSession) -> DataFrame:
    """``(ch, py)``: the syllable of each Han character without its tone; one row a character, so a bounded table."""
    made = _each(spark, "Han-Latin; Latin-ASCII; Lower") or []
    rows = [(chr(c), x.strip()) for c, x in zip(_HAN, made) if x.strip() and x != chr(c)]
    return spark.createDataFrame(rows, "ch string, py string")


def romanised(words: DataFrame, word: str) -> DataFrame:
    """``(word, py)`` of the distinct words: their syllables with a space between; characters without one are left out."""
    w = words.select(F.col(word)).where(F.col(word) != "").distinct()
    each = w.select(word, F.posexplode(F.split(word, "")).alias("_i", "ch")).join(F.broadcast(romanisation(words.sparkSession)), "ch")
    py = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "py"))), lambda x: x["py"]), " ")
    return each.groupBy(word).agg(py.alias("py"))
