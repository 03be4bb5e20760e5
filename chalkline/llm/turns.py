"""Speech transcripts as clean speaker turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.labels import label_roles
from chalkline.plans.scan import sharded_scan
from chalkline.plans.session import materialise

# How time marks, brackets, labels and fillers are written.
# Each begins with the characters that it may begin with, so that other places are passed over at once.
_SPACE, _WORD = r"[\s\p{Z}]", r"[\p{L}\p{N}_'-]"
_CLOCK = r"\p{Nd}{1,2}:\p{Nd}{2}:\p{Nd}{2}[.,]\p{Nd}{1,3}"
_TIME = (
    rf"(?=[\[【（(<\p{{Nd}}])(?:[\[【（(<]{_SPACE}*\p{{Nd}}{{1,2}}:\p{{Nd}}{{2}}(?::\p{{Nd}}{{2}})?(?:[.,]\p{{Nd}}{{1,3}})?{_SPACE}*[\]】）)>]{_SPACE}*"
    rf"|{_CLOCK}{_SPACE}*-->{_SPACE}*(?:{_CLOCK}{_SPACE}*)?)"
)
_BRACKETS = r"(?=[\[【（(〔<*♪])(?:\[([^\[\]]{1,40})\]|【([^【】]{1,40})】|（([^（）]{1,40})）|\(([^()]{1,40})\)|〔([^〔〕]{1,40})〕|<([^<>]{1,40})>|\*([^*]{1,40})\*|♪+[^♪]{0,80}♪+|♪)"
#: A label before a colon, an angle or a spaced dash, at the start or after a space.
_LABEL = rf"(?:(?<={_SPACE})|^)(\p{{L}}+)(?:{_SPACE}*[:：]{_SPACE}*|>{_SPACE}+|{_SPACE}+-{_SPACE}+)"
_ASCII_FILLER = rf"(?=[uehmaoUEHMAO])(?<!{_WORD})(?i:u+h+m*|u+m+|e+r+m?|h+m+|m+h+m+|a+h+|o+h+)(?!{_WORD})(?:\.{{3}}|…+|,)?{_SPACE}*"
#: Fillers that follow one another go at once.
_HAN_FILLER = rf"(?=[嗯呃啊额唔哦])(?:(?<=[\s\p{{Z}}，。、；：？！,.!?…])|^)(?:(?:[嗯呃]+(?:……|…|[，,、])?|[啊额唔哦]+(?:(?:……|…|[，,、])|(?=[\s\p{{Z}}。？！!?.]|$))){_SPACE}*)+"
_EDGE = r"^[\s\p{Z}，。、；,;…]+|[\s\p{Z}]+$"
#: Marks that no text holds: the begin of a part, the end of a bracket's and of a label's words.
_PART, _BRACKET_END, _LABEL_END = "\u0001", "\u0003", "\u0002"
#: A transcript's roles are joined in so many copies, so that its rows spread over as many tasks.
SALT = 16


def strip_noise(text: Column) -> Column:
    """Words alone: no filler, doubled space or leading punctuation."""
    s = F.regexp_replace(F.regexp_replace(text, _ASCII_FILLER, " "), _HAN_FILLER, " ")
    return F.regexp_replace(F.regexp_replace(s, _SPACE + "+", " "), _EDGE, "")


def split_labels(text: Column) -> Column:
    """Parts ``(bracket, label, text)`` in order: time marks go, brackets and labels begin a part.

    The first part has neither; of the others one is '' and the other a candidate for a label.
    Only candidates that resolve to a role start a part of their own in the end.
    """
    own = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{_PART}{_BRACKET_END}{_LABEL_END}]", " ")
    words = "".join(f"${k}" for k in range(1, 8))
    marked = F.regexp_replace(F.regexp_replace(own, _TIME, " "), f"{_BRACKETS}|{_LABEL}", f"{_PART}{words}{_BRACKET_END}$8{_LABEL_END}")

    def part(p: Column, i: Column) -> Column:
        bare = i == 0
        return F.struct(
            F.when(bare, "").otherwise(F.substring_index(p, _BRACKET_END, 1)).alias("bracket"),
            F.when(bare, "").otherwise(F.substring_index(F.substring_index(p, _LABEL_END, 1), _BRACKET_END, -1)).alias("label"),
            F.when(bare, p).otherwise(F.substring_index(p, _LABEL_END, -1)).alias("text"),
        )

    return F.transform(F.split(marked, _PART), part)


def clean_parts(parts: Column, roles: Column) -> Column:
    """Parts ``(role, words)`` of :func:`split_labels`, ``roles`` a map of label to role, each cleaned; wordless ones go.

    A bracket without a role goes, a label without one is put back into the text; what they
    began belongs to the part before.
    """
    def text(p: Column, i: Column) -> Column:
        role = F.coalesce(F.try_element_at(roles, p["label"]), F.try_element_at(roles, p["bracket"]))
        begun = F.concat(F.lit(_PART), role, F.lit(_LABEL_END), p["text"])
        put_back = F.when(p["label"] != "", F.concat(F.lit(" "), p["label"], F.lit(": "), p["text"])).otherwise(F.concat(F.lit(" "), p["text"]))
        return F.when(i == 0, p["text"]).otherwise(F.coalesce(begun, put_back))

    joined = F.split(F.array_join(F.transform(parts, text), ""), _PART)
    cleaned = F.transform(joined, lambda x, i: F.struct(
        F.when(i > 0, F.substring_index(x, _LABEL_END, 1)).alias("role"), strip_noise(F.when(i > 0, F.substring_index(x, _LABEL_END, -1)).otherwise(x)).alias("words")
    ))
    return F.filter(cleaned, lambda c: c["words"].rlike(r"[\p{L}\p{N}]"))


def speaker_turns(
    segments: DataFrame,
    transcript: str,
    segment: str,
    start: str,
    end: str,
    text: str,
    speaker: str,
    pause_s: float = 60.0,
    shard_s: float = 3600.0,
) -> DataFrame:
    """``(transcript, turn_no, role, first_seg, last_seg, start_s, end_s, text)``.

    Segments go by start, then id. Time marks, sound annotations and fillers are
    removed; a part without any word left is skipped, whatever its label. A label in
    the text goes before the speaker column, and a later label in one text starts a new
    part. Labels are resolved per transcript (:func:`labels.label_roles`); a part
    without a known role belongs to the turn in progress, and is left out where no role
    has been heard yet. A turn ends at a change of role or when more than ``pause_s``
    pass between the latest end so far and the next start. A missing end counts as the
    start; rows without transcript, id or (finite) start are ignored; repeats of an id
    count as often as they come. Empty in, empty out.

    The role and the latest end carry over as sharded scans, so a transcript of any
    length is spread over its hours.
    """
    a, b = F.col(start).cast("double"), F.col(end).cast("double")
    finite = lambda c: F.when(F.abs(c) < 1e12, c)
    rows = segments.select(
        F.col(transcript).alias("k"), F.col(segment).alias("id"), finite(a).alias("a"),
        F.greatest(finite(a), F.coalesce(finite(b), finite(a))).alias("b"),
        F.coalesce(F.col(speaker), F.lit("")).alias("by"), split_labels(F.col(text)).alias("parts"),
    ).where("k is not null and id is not null and a is not null")
    rows = materialise(rows)  # the texts are taken apart once
    named = F.concat(F.array("by"), F.transform("parts", lambda p: F.when(p["label"] != "", p["label"]).otherwise(p["bracket"])))
    said = rows.select("k", F.explode(F.array_distinct(named)).alias("label")).where("label <> ''").distinct()
    roles = label_roles(said, "k", "label").groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("label", "role"))).alias("roles"))
    copies = roles.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"))
    known = salted.join(copies, ["k", "salt"], "left").withColumn("roles", F.coalesce("roles", F.create_map().cast("map<string,string>")))
    parts = (
        known.select("k", "id", "a", "b", F.try_element_at("roles", F.col("by")).alias("col_role"), F.posexplode(clean_parts(F.col("parts"), F.col("roles"))).alias("no", "c"))
        .select(
            "k", "id", "a", "b", "no", F.col("c.words").alias("words"),
            F.coalesce("c.role", F.when(F.col("no") == 0, F.col("col_role"))).alias("role"),
            F.floor(F.col("a") / shard_s).alias("shard"),
        )
    )
    parts = materialise(parts)  # the scans below read it several times
    order = ["a", "id", "no"]
    seen = sharded_scan(
        parts, ["k"], "shard", order, {"was": ("before", F.col("role")), "reach": ("max_before", F.col("b"))}
    )
    now = F.coalesce("role", "was")
    new = F.col("was").isNull() | (now != F.col("was")) | (F.round((F.col("a") - F.col("reach")) * 1000) > round(pause_s * 1000))
    marked = seen.where(now.isNotNull()).withColumn("now", now).withColumn("new", new.cast("int"))
    numbered = sharded_scan(marked, ["k"], "shard", order, {"turn": ("sum", F.col("new"))})
    piece = F.struct("a", "id", "no", "words")
    return numbered.groupBy(F.col("k").alias(transcript), F.col("turn").cast("bigint").alias("turn_no")).agg(
        F.first("now").alias("role"),
        F.min(F.struct("a", "id"))["id"].alias("first_seg"),
        F.max(F.struct("a", "id"))["id"].alias("last_seg"),
        F.min("a").alias("start_s"),
        F.max("b").alias("end_s"),
        F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["words"]), " ").alias("text"),
    )
