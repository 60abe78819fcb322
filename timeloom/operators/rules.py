"""Text rules for script lines, as arrays of notes in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.functions import constants as C
from timeloom.functions import text as t

from . import sequences as seq

#: Fixed values: "one of the" and up to four words, up to a word that goes on, a mark or the end; the words are the group.
ONE_OF = r"(?i)\bone of (?:the|my|our|your|its)\s+((?:[a-z-]+\s+){0,3}?[a-z-]+)(?:\s+(?:i|i'm|we|you|that|which|in|for|to|on|and|is)\b|[.,!?]|$)"


def notes(text: Column, budget: Column | None = None, names: dict[str, str] | None = None, phrases: list[str] = C.FILLER_PHRASES) -> Column:
    """Distinct notes on a line; null where nothing applies does not occur, an empty array does. A line without text has none.

    ``names`` maps lower-case spellings to the spelling that a coined name has to have. The squashed line and its lower-case
    form are made once, as elements of an array that the rules are a function of.
    """
    forms = F.array(F.struct(t.squash(text).alias("line"), F.lower(t.squash(text)).alias("lower")))
    return F.get(F.transform(forms, lambda f: _notes(text, f["line"], f["lower"], budget, names or {}, phrases)), F.lit(0))


def _notes(text: Column, line: Column, lower: Column, budget: Column | None, names: dict[str, str], phrases: list[str]) -> Column:
    found = []
    for wrong, right in names.items():
        found.append(F.when(F.array_contains(F.transform(t.script_tokens(text), F.lower), wrong) & ~text.contains(right), F.lit(f"name:{right}")))
    found.append(F.when(line.contains("word ") & line.rlike(r"\bword (document|doc|file|format)"), F.lit("word-format")))
    for phrase in phrases:
        found.append(F.when(lower.contains(phrase) & lower.rlike(rf"\b{phrase}\b"), F.lit(f"filler:{phrase}")))
    found.append(F.when(line.contains(".") & line.rlike(r"[A-Za-z]\.\s+[a-z]"), F.lit("stop-inside")))
    found.append(F.when(line.rlike(r"^\p{Ll}"), F.lit("lower-start")))
    found.append(F.when(line.contains(",") & line.rlike(r"^\W*\w+,\s*\w+,") & line.rlike(r",\s*\w+,\s"), F.lit("comma-pair")))
    last = F.regexp_extract(F.regexp_extract(lower, ONE_OF, 1), "([a-z-]+)$", 1)
    # the regular expressions run only where the words are, and once
    plural = F.when(lower.contains("one of "), F.get(F.filter(F.array(last), lambda w: (w != "") & ~w.isin(C.SCRIPT_STOP_WORDS) & ~F.endswith(w, F.lit("s"))), F.lit(0)))
    found.append(F.when(plural.isNotNull(), F.lit("singular")))
    found.append(F.when(text.rlike(r"\s{2,}"), F.lit("double-space")))
    if budget is not None:
        found.append(F.when(F.size(t.script_tokens(line)) > budget, F.lit("too-long")))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.array(*found))))


def judged(replies: DataFrame, key: list[str]) -> DataFrame:
    """(key, kind, why, detail) of replies (key, now, said, got, edited, cap, budget) that propose a line, one row each.

    ``kind`` is drop, spruce (a light touch on an edited line) or polish; ``rejected`` with a reason in ``why``: lowercase,
    mid-sentence, number (one that was never said, in ``detail``), rewritten (an edited line by more than three words or to a
    ratio below 0.6, in ``detail`` as thousandths), swapped (``old>new`` in ``detail``), long, or short; and null where nothing is
    proposed: no reply, DROP of an edited line, or the line as it is. Only edited lines that nothing else
    decides are aligned with their replies. Null texts are empty.
    """
    text = {c: F.coalesce(c, F.lit("")) for c in ("now", "said")}
    new = t.for_speech(F.col("got"))
    rows = replies.select(*key, *[x.alias(c) for c, x in text.items()], "got", "edited", "cap", "budget", new.alias("new"))
    tokens = {"before": t.script_tokens(F.col("now")), "after": t.script_tokens(F.col("new")), "heard": t.script_tokens(F.col("said"))}
    rows = rows.withColumns({c: F.transform(x, F.lower) for c, x in tokens.items()})
    spoken = F.lower(F.concat("now", F.lit(" "), "said"))
    unsaid = F.get(F.filter(F.regexp_extract_all("new", F.lit("([0-9]+)"), 1), lambda n: ~seq.number_said(n, spoken)), F.lit(0))
    rows = rows.withColumn("unsaid", unsaid)
    many, few = F.size("after"), F.size("before")
    nothing = F.col("got").isNull() | (F.col("new") == "") | (t.squash(F.col("new")) == t.squash(F.col("now")))
    is_drop = F.regexp_replace(F.upper(F.trim("got")), "\\.+$", "") == "DROP"
    first = (
        F.when(is_drop, F.when(~F.col("edited"), "drop").otherwise("none"))
        .when(nothing, "none")
        .when(F.col("new").rlike("^\\p{Ll}"), "lowercase")
        .when(F.rtrim("new").rlike("[,;:]$"), "mid-sentence")
        .when(F.col("unsaid").isNotNull(), "number")
        .when(F.col("edited"), F.when(many > few + 3, "rewritten"))
        .when((many > few) & (many > F.least(F.col("cap") + 2, "budget")), "long")
        .when(many < 2, "short")
        .otherwise("polish")
    )
    rows = seq.settled(rows.withColumn("why", first))
    pairs = rows.where("edited AND (why IS NULL OR why = 'rewritten')").select(*key, "before", "after", "heard")
    blocks = seq.settled(seq.matching_blocks(pairs, key, "before", "after"))
    alike = seq.ratios(pairs, key, "before", "after", blocks).select(*key, "matched", (F.size("before") + F.size("after")).alias("both"))
    operations = seq.edit_operations(pairs, key, blocks, "before", "after")
    swaps = seq.swapped_words(pairs, key, operations, "heard", "before", "after").select(*key, F.col("old").alias("old_word"), F.col("new").alias("new_word"))
    rows = rows.join(alike, key, "left").join(swaps, key, "left")
    # ratio below 0.6, in whole numbers
    why = F.coalesce("why", F.when((F.col("both") > 0) & (20 * F.col("matched") < 6 * F.col("both")), "rewritten").when(F.col("new_word").isNotNull(), "swapped").otherwise("spruce"))
    rows = rows.withColumn("why", why)
    ratio = F.when(F.col("both") == 0, 1000).otherwise(F.floor(2000 * F.col("matched") / F.col("both")))
    detail = F.when(F.col("why") == "number", F.col("unsaid")).when(F.col("why") == "rewritten", ratio.cast("string")).when(F.col("why") == "swapped", F.concat("old_word", F.lit(">"), "new_word"))
    kinds = F.col("why").isin("drop", "spruce", "polish")
    kind = F.when(kinds, F.col("why")).when(F.col("why") != "none", "rejected")
    return rows.select(*key, kind.alias("kind"), F.when(~kinds & (F.col("why") != "none"), F.col("why")).alias("why"), detail.alias("detail"))


def clean_verdict(before: Column, after: Column, low: float = 0.55, high: float = 1.6) -> Column:
    share = t.word_count(after) / F.greatest(t.word_count(before), F.lit(1))
    return F.when(F.trim(after) == "", "rejected").when(~share.between(low, high), "rejected").when(after == before, "kept").otherwise("changed")


def stumbled(words: DataFrame, spans: DataFrame, slack: float = 1.3, near: int = 10) -> DataFrame:
    """Spans (rec, id, a, b, script) with the words heard inside and whether they are too many for the script's."""
    from .intervals import _bucketed

    width = 60_000
    x = _bucketed(spans, F.col("a") - near, F.col("b") + near, width).alias("x")
    y = words.select("rec", "start_ms", "end_ms").withColumn("bucket", F.floor(F.col("start_ms") / width)).alias("y")
    inside = (F.col("x.rec") == F.col("y.rec")) & (F.col("x.bucket") == F.col("y.bucket")) & (F.col("y.start_ms") >= F.col("x.a") - near) & (F.col("y.end_ms") <= F.col("x.b") + near)
    heard = x.join(y, inside).groupBy("x.rec", "x.id").agg(F.count(F.lit(1)).alias("heard"))
    rows = spans.join(heard, ["rec", "id"], "left").withColumn("heard", F.coalesce("heard", F.lit(0)))
    return rows.withColumn("stumbled", F.col("heard") > slack * t.word_count(F.col("script")))
