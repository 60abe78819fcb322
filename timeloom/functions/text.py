"""Column functions over tokens and script text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CONTRACTIONS, SUFFIXES


def norm(token: Column) -> Column:
    """Lower case, only a-z, 0-9 and apostrophes."""
    return F.regexp_replace(F.lower(token), "[^a-z0-9']+", "")


def repeat_key(token: Column) -> Column:
    """``norm`` without one contraction ending, where two characters remain."""
    return without_contraction(norm(token))


def without_contraction(token: Column) -> Column:
    return F.when(F.contains(token, F.lit("'")), F.regexp_replace(token, f"(?<=..)({'|'.join(CONTRACTIONS)})$", "")).otherwise(token)


def stems(token: Column) -> Column:
    """The token and what is left of it without each suffix, where three characters remain."""
    found = [token]
    for suffix, instead in SUFFIXES:
        fits = F.endswith(token, F.lit(suffix)) & (F.length(token) - len(suffix) >= 3)
        found.append(F.when(fits, F.concat(F.substring(token, F.lit(1), F.length(token) - len(suffix)), F.lit(instead))))
    return F.array_distinct(F.array_compact(F.array(*found)))


def variant_of(a: Column, b: Column) -> Column:
    """Whether one is the other with a plural or tense ending."""

    def longer(x: Column, y: Column) -> Column:
        return F.startswith(x, y) & F.substring(x, F.length(y) + 1, F.length(x)).isin("", "s", "es", "'s", "ed", "d", "ing")

    return longer(a, b) | longer(b, a)


def take_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.lower(text), "-'", ""), F.lit("([a-z0-9]+)"), 1)


def script_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([A-Za-z0-9']+)"), 1)


def align_key(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), "[^a-z0-9]+", "")


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \t\n\r]+", " "))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^ \t\n\r]+")).cast("long")


def sentences(text: Column, least_words: int = 1) -> Column:
    """Sentences that end in . ! or ? before white space, with at least so many words."""
    parts = F.split(squash(text), "(?<=[.!?]) ")
    return F.filter(parts, lambda s: (s != "") & (word_count(s) >= least_words))


def statement_end(text: Column) -> Column:
    return F.rtrim(text).rlike("[.!]$")


def for_speech(text: Column) -> Column:
    """Punctuation that reads well aloud: dashes become commas, quotes go, spacing is tidied."""
    out = F.regexp_replace(text, "[—–]", ", ")
    out = F.regexp_replace(out, "…|\\.\\.\\.", ".")
    out = F.regexp_replace(out, "[‘’]", "'")
    out = F.regexp_replace(out, '[“”"]', "")
    out = F.regexp_replace(out, " - ", ", ")
    out = F.regexp_replace(out, "[ \t\n\r]+", " ")
    out = F.regexp_replace(out, " +([,.!?])", "$1")
    return F.trim(F.regexp_replace(out, ", *,", ","))


def numbered_replies(reply: Column) -> Column:
    """Map from number to text of lines such as ``3. text`` or ``3) text``; the last of one number counts."""
    lines = F.filter(F.split(reply, "\n"), lambda s: s.rlike("^[ \t]*\\d{1,9}[.)]"))
    number = lambda s: F.regexp_extract(s, "^[ \t]*(\\d{1,9})[.)]", 1).cast("int")
    body = lambda s: F.regexp_replace(F.trim(F.regexp_replace(s, "^[ \t]*\\d{1,9}[.)]", "")), '^"|"$', "")
    return F.aggregate(lines, F.create_map().cast("map<int,string>"), lambda m, s: F.map_concat(F.map_filter(m, lambda k, _: k != number(s)), F.create_map(number(s), body(s))))


def content_words(text: Column, stop: list[str]) -> Column:
    """Distinct lower-cased script tokens of more than three characters that are no stop word."""
    return F.array_distinct(F.filter(F.transform(script_tokens(text), F.lower), lambda w: (F.length(w) > 3) & ~w.isin(stop)))


def wrap(text: Column, width: int = 42) -> Column:
    """Rows of at most ``width`` characters, filled word by word; a longer word stands alone."""
    tokens = F.filter(F.split(text, "[ \t\n\r]+"), lambda w: w != "")

    def add(rows: Column, word: Column) -> Column:
        last = F.element_at(rows, -1)
        joined = F.concat(last, F.lit(" "), word)
        fits = (F.size(rows) > 0) & (F.length(F.concat(F.try_element_at(rows, F.lit(-1)), F.lit(" "), word)) <= width)
        return F.when(F.size(rows) == 0, F.array(word)).when(fits, F.concat(F.slice(rows, 1, F.size(rows) - 1), F.array(joined))).otherwise(F.concat(rows, F.array(word)))

    return F.aggregate(tokens, F.array().cast("array<string>"), add)


def prompt(terms: Column, preamble: str, most: int = 700) -> Column:
    return F.substring(F.concat(F.lit(preamble), F.array_join(terms, ", ")), 1, most)


def block_label(line_id: Column) -> Column:
    """``s031a`` is spoken as ``31a``."""
    return F.concat(F.regexp_extract(line_id, "^s0*(\\d+)", 1), F.regexp_extract(line_id, "([a-z]?)$", 1))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "^.*[/\\\\]", ""), "[^A-Za-z0-9._-]+", "_")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
