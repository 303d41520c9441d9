"""Text expressions: all of them plain Catalyst, none a Python function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and letters of the cleaning steps.
URL = r"(?U)(http[s]?://\S+|www\.\S+)"
EMOTICON = r"[:;=][-~]?[)D]"
OTHER_THAN_LETTERS = r"(?U)[^a-záéíóúñü\s]"
SHORT_WORD = 2
# Verbs dropped besides the lexicon's stop words, and the parts of speech dropped.
EXTRA_STOP_LEMMAS = ("ser", "estar", "haber", "poder", "hacer", "decir", "tener", "dar")
DROPPED_POS = ("AUX", "DET", "PRON", "ADP", "CCONJ")


#: URLs and other characters in one pass: URLs start with a letter, so no other character ever takes a part of one,
#: and what EMOTICON finds in lower case are other characters
REMOVED = f"{URL}|[^a-záéíóúñü\\s]"


def cleaned(text: Column) -> Column:
    """Lower case; without URLs, emoticons, other characters than letters, and words of one or two letters; null gives ''."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), REMOVED, "")
    return F.array_join(F.regexp_extract_all(kept, F.lit(rf"[a-záéíóúñü]{{{SHORT_WORD + 1},}}"), F.lit(0)), " ")


def is_blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def terms(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case tokens of two word characters or more, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    if not stop_words:
        return found
    return F.filter(found, lambda w: ~w.isin(*stop_words))


def told(text: Column, stop_words: list[str] | None = None) -> Column:
    """``terms`` joined by blanks, '' if there are none; null where the text itself is blank."""
    return F.when(~is_blank(text), F.array_join(terms(text, stop_words), " "))


def told_terms(line: Column) -> Column:
    """The terms of a line of ``told``; none of null."""
    return F.filter(F.split(F.coalesce(line, F.lit("")), " "), lambda w: w != "")


#: stands before what CSV readers lose: itself, NUL, and a value that is empty and not null
ESCAPE = "\x1b"
EMPTY = f"{ESCAPE}n"


def escaped(text: Column) -> Column:
    """A value for a CSV file: '' (which would be read as null) becomes EMPTY, NUL an escape and "0", an escape one and "e"; all others stay."""
    told = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}e")), F.lit("\x00"), F.lit(f"{ESCAPE}0"))
    return F.when(text == "", EMPTY).otherwise(told)


def unescaped(text: Column) -> Column:
    """What ``escaped`` was given; null stays null."""
    told = F.replace(F.replace(text, F.lit(f"{ESCAPE}0"), F.lit("\x00")), F.lit(f"{ESCAPE}e"), F.lit(ESCAPE))
    return F.when(text == EMPTY, "").otherwise(told)


def iso_seconds(duration: Column) -> Column:
    """Whole seconds of an ISO-8601 duration (days to seconds); null stays null."""
    date, time = F.split_part(duration, F.lit("T"), F.lit(1)), F.split_part(duration, F.lit("T"), F.lit(2))
    part = lambda source, unit: F.coalesce(F.regexp_extract(source, rf"(\d+){unit}", 1).try_cast("long"), F.lit(0))
    return F.when(duration.isNotNull(), part(date, "D") * 86400 + part(time, "H") * 3600 + part(time, "M") * 60 + part(time, "S"))


def transcript_text(snippets: Column) -> Column:
    """Each snippet's text followed by '. '; double blanks made single, once."""
    joined = F.concat(F.array_join(F.transform(snippets, lambda s: s["text"]), ". "), F.lit(". "))
    return F.replace(F.when(F.size(snippets) > 0, joined).otherwise(""), F.lit("  "), F.lit(" "))


def requested_tokens(message: Column) -> Column:
    """The number in 'Requested N.' of a rate-limit message, else 0."""
    return F.coalesce(F.regexp_extract(message, r"Requested (\d+)\.", 1).try_cast("int"), F.lit(0))
