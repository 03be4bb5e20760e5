"""Column expressions on text and time, with the spaces and letters of all scripts."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chalkline.functions import config as C

_FULL = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
_HALF = "".join(chr(0x21 + i) for i in range(94)) + " "


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_text(c: Column, replacements: dict[str, str] = C.REPLACEMENTS) -> Column:
    """Replacements, the longest first, then single spaces."""
    ordered = sorted(replacements.items(), key=lambda x: (-len(x[0]), x[0]))
    return squeeze(reduce(lambda a, kv: F.replace(a, F.lit(kv[0]), F.lit(kv[1])), ordered, F.coalesce(c, F.lit(""))))


def any_of(c: Column, cues: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(x) for x in cues), F.lit(False))


def hits(c: Column, cues: Iterable[str]) -> Column:
    """How many of the cues occur."""
    return reduce(lambda a, b: a + b, (c.contains(x).cast("int") for x in cues), F.lit(0))


def occurrences(c: Column, cue: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(cue), F.lit("")))) / len(cue)).cast("int")


def is_valid_token(t: Column, stop: Iterable[str] = (*C.STOP_WORDS, *C.KEYWORD_BLACKLIST)) -> Column:
    return (F.length(t) > 1) & ~t.rlike(r"^\p{Nd}+$") & ~t.isin(*stop) & t.rlike(r"[\p{L}\p{N}]")


def is_cjk(t: Column) -> Column:
    return t.rlike(r"^[\x{4e00}-\x{9fff}]+$")


def speaker_role(c: Column) -> Column:
    """教师, 学生 or 未知 for a label in any case, width or spacing."""
    n = F.lower(F.regexp_replace(F.translate(c, _FULL, _HALF), r"(?U)[\s:]+", ""))
    return F.when(n.isin(*C.TEACHER_NAMES), C.TEACHER).when(n.isin(*C.STUDENT_NAMES), C.STUDENT).otherwise(C.UNKNOWN)


def silence_probability(nsp: Column) -> Column:
    """Missing and exactly 0 both count as certain silence."""
    return F.when(F.coalesce(F.nanvl(nsp, F.lit(0.0)), F.lit(0.0)) == 0, 1.0).otherwise(nsp)


def keeps_speech(nsp: Column, text: Column, cfg: C.Config = C.CONFIG) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    return (silence_probability(nsp) <= cfg.no_speech) | ((t != "") & (F.length(t) > cfg.short_text))


def teacher_talk_score(text: Column) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    packed = F.regexp_replace(t, r"(?U)\s+", "")
    fillers = reduce(lambda a, b: a + b, (occurrences(packed, x) for x in C.FILLER_CUES))
    repeats = hits(packed, [x * 2 for x in C.FILLER_CUES])
    questions = occurrences(t, "？") + occurrences(t, "?")
    score = (
        hits(t, C.TEACHER_CUES) - hits(t, C.STUDENT_CUES) - questions * 0.25 + F.least(F.length(packed) / 35.0, F.lit(1.6))
        + F.least(fillers, F.lit(5)) * 0.2 + F.least(repeats, F.lit(3)) * 0.35
    )
    return F.when(t == "", -0.2).otherwise(score)


def parse_seconds(c: Column) -> Column:
    """Seconds of 'H:MM:SS' or of a number; null for anything else."""
    s = strip(c)
    p = F.split(s, ":")
    hms = p[0].cast("double") * 3600 + F.get(p, F.lit(1)).cast("double") * 60 + F.get(p, F.lit(2)).cast("double")
    return F.when(s.rlike(r"^[0-9]+:[0-5][0-9]:[0-5][0-9]$"), hms).otherwise(s.try_cast("double"))


def hms(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def hms_range(start: Column, end: Column) -> tuple[Column, Column]:
    """Start rounded down and end rounded up, swapped if reversed."""
    return hms(F.floor(F.least(start, end))), hms(F.ceil(F.greatest(start, end)))


def clean_title(title: Column, number: Column) -> Column:
    """Without 'knowledge point n' in front; what remains, else the title, else a numbered name."""
    raw = strip(F.coalesce(title, F.lit("")))
    bare = strip(F.regexp_replace(raw, r"^\s*知识点\s*[0-9]+\s*[-_—:：]?\s*", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), F.nullif(raw, F.lit("")), F.concat(F.lit("片段"), (number + 1).cast("string")), F.lit("未命名片段"))


def file_name(title: Column, longest: int = 80) -> Column:
    return strip(F.substring(F.regexp_replace(title, r'[<>:"/\\|?*\x00-\x1f]', "_"), 1, longest))


def word_set(text: Column) -> Column:
    """Single Han characters and runs of ASCII letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\x{4e00}-\x{9fff}]|[a-z0-9_]+)"), F.lit(1)))


def jaccard(x: Column, y: Column) -> Column:
    """Shared part of two word sets; two empty ones are alike."""
    shared = F.size(F.array_intersect(x, y))
    return F.when(F.size(x) + F.size(y) == 0, 1.0).otherwise(shared / F.greatest(F.size(x) + F.size(y) - shared, F.lit(1)))


def boundary_score(silent: Column, slide: Column, confidence: Column) -> Column:
    return F.when(silent, 1.5).otherwise(0.0) + F.when(slide, 1.0).otherwise(0.0) + F.greatest(F.lit(0.0), 1.0 - confidence) * 0.5
