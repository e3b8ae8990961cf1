"""Text expressions: answers, entities, questions.  All are plain Columns and stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers in order of priority.
ANSWER_MARKERS = ("Final Answer:", "Final Answer", "Answer:", "Conclusion:", "Answer")
WORD = r"[\p{L}\p{N}_]+"


def normalize_answer(x: Column) -> Column:
    """Lower case, join ranges, then drop punctuation and articles, and single spaces."""
    y = F.lower(x)
    for old, new in ((" until ", "-"), (" to ", "-"), (" and ", ", ")):
        y = F.replace(y, F.lit(old), F.lit(new))
    y = F.regexp_replace(F.trim(y), r"[!-/:-@\[-`{-~]", "")
    y = F.regexp_replace(y, r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(y, r"\s+", " "))


def extract_final_answer(x: Column) -> Column:
    """What follows the last mention of the first marker present: its first line, without a final period."""
    y = F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))
    out = y
    for marker in reversed(ANSWER_MARKERS):
        out = F.when(F.contains(F.lower(y), F.lit(marker.lower())), F.regexp_replace(y, f"(?is)^.*{marker}", "")).otherwise(out)
    line = F.regexp_extract(F.trim(F.regexp_replace(out, r"^\s+", "")), r"^([^\n]*)", 1)
    return F.trim(F.replace(F.regexp_replace(F.trim(line), r"\.$", ""), F.lit("`"), F.lit("")))


def contain_match(pred: Column, gold: Column) -> Column:
    """Normalised containment; yes, no and noanswer must be equal."""
    p, g = normalize_answer(pred), normalize_answer(gold)
    return F.when(g.isin("yes", "no", "noanswer"), p == g).otherwise(F.contains(p, g)).cast("int")


#: Titles and suffixes that are no part of a name when they follow a space.
TITLES = ("Jr", "Sr", "Dr", "Prof", "King", "Sultan", "President", "Queen", "Princess")


def clean_entity(x: Column) -> Column:
    """A name without titles (in any case), marks and white space, lower case; empty for null."""
    trimmed = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", "")
    untitled = F.regexp_replace(trimmed, rf"(?iU)\s+({'|'.join(TITLES)})\b\.?", "")
    return F.lower(F.regexp_replace(untitled, "[^A-Za-z0-9]", ""))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(f"({WORD})"))


#: Words that say nothing about what a question describes.
STOP_WORDS = (
    "what", "which", "who", "where", "when", "how", "is", "are", "was", "were",
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "with", "by", "about",
    "this", "that", "these", "those", "does", "did", "can", "could",
)


def purify_query(x: Column, stopwords: tuple[str, ...] = STOP_WORDS) -> Column:
    """Quoted parts; else capitalised or longer words that are no stop words; else the whole query."""
    quoted = F.regexp_extract_all(x, F.lit('"([^"]*)"'))
    kept = F.filter(F.split(F.trim(x), r"\s+"), lambda w: w.rlike(r"^\p{Lu}") | (~F.lower(w).isin(*stopwords) & (F.length(w) > 2)))
    return F.when(F.size(quoted) > 0, F.array_join(quoted, " ")).when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(x)


def count_of(x: Column, part: str) -> Column:
    """Non-overlapping occurrences."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))) / len(part)).cast("long")


def prefixed(title: Column, text: Column) -> Column:
    return F.concat(title, F.lit(" information: "), text)


#: Spellings of the generations a name may end in, first to fifth.  The spellings and which of them mean the
#: same are fixed values; the number of a generation is its place here, and only equality of numbers counts.
GENERATIONS = (("sr", "senior", "i", "1st"), ("jr", "junior", "ii", "2nd"), ("iii", "3rd"), ("iv", "4th"), ("v", "5th"))


def generation(x: Column) -> Column:
    """The generation that a name ends in, with or without a period; null without one."""
    name = F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))
    number = F.lit(None).cast("int")
    for place, spellings in enumerate(GENERATIONS, 1):
        number = F.when(name.rlike(rf"\b({'|'.join(spellings)})\.?$"), place).otherwise(number)
    return number


def enriched_name(name: Column, synonyms: Column, most: int = 10) -> Column:
    """``name, synonyms: a, b`` with the first synonyms other than the name itself; the bare name without any."""
    own = F.trim(name)
    others = F.filter(F.coalesce(synonyms, F.array().cast("array<string>")), lambda s: s.isNotNull() & (s != "") & (F.trim(s) != own))
    return F.when(F.size(others) > 0, F.concat(own, F.lit(", synonyms: "), F.array_join(F.slice(others, 1, most), ", "))).otherwise(own)


def rich_input(name: Column, joined: Column) -> Column:
    """``Entity: name. synonyms: a | b``."""
    return F.concat(F.lit("Entity: "), name, F.lit(". synonyms: "), joined)


def numeric_parts(x: Column) -> Column:
    """The comma-separated parts of a text that are numbers."""
    return F.filter(F.transform(F.split(x, ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d+$"))


def selected_indices(reply: Column, size: Column) -> Column:
    """The numbers in a reply that are indices below ``size``, in its order."""
    found = F.transform(F.regexp_extract_all(reply, F.lit(r"(\d+)")), lambda d: d.try_cast("int"))
    return F.filter(found, lambda i: i.isNotNull() & (i < size))


def after_marker(reply: Column) -> Column:
    """What follows the last ``Final Answer:``, or the whole reply."""
    return F.trim(F.substring_index(reply, "Final Answer:", -1))


def one_line(x: Column) -> Column:
    return F.translate(x, "\r\n", "  ")
