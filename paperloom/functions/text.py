"""Tokenizers, stopword filters and cleaners as Column expressions.

Null text behaves as empty text in every function here unless the docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words the search tokenizer drops. Entries with an apostrophe are
# left out, since a token never holds one.
SEARCH_STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before "
    "being below between both but by cannot could did do does doing down during each few for "
    "from further had has have having he her here hers herself him himself his how i if in "
    "into is it its itself me more most my myself no nor not of off on once only or other "
    "ought our ours ourselves out over own same she should so some such than that the their "
    "theirs them themselves then there these they this those through to too under until up "
    "very was we were what when where which while who whom why with would you your yours "
    "yourself yourselves"
).split()

# The words the association trainer drops.
TRAINER_STOPWORDS = (
    "the of and in to a is for with that on as are by at an be this which from or it can have "
    "has but not we image data using"
).split()

# C white space, spelled out: Java's \s and RE2's \s differ in the vertical tab.
C_SPACE = r"[ \t\n\x0B\f\r]+"


def tokens(text: Column) -> Column:
    """Lower-cased maximal runs of ASCII letters and digits, in order, with repeats.

    Extraction precedes lower-casing, so no non-ASCII character can turn into a letter.
    Null gives an empty array.
    """
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9]+)"), F.lit(1))
    return F.transform(found, F.lower)


def content_tokens(text: Column) -> Column:
    """``tokens`` without the search stopwords."""
    return F.filter(tokens(text), lambda w: ~w.isin(*SEARCH_STOPWORDS))


def trainer_tokens(text: Column) -> Column:
    """White-space pieces with everything but ASCII letters and digits deleted, lower-cased.

    ``state-of-the-art`` is one token here; pieces that become empty are kept as ''.
    """
    pieces = F.split(F.coalesce(text, F.lit("")), C_SPACE)
    return F.transform(pieces, lambda w: F.lower(F.regexp_replace(w, "[^A-Za-z0-9]", "")))


def trainer_content(text: Column) -> Column:
    """``trainer_tokens`` longer than two characters and not in the trainer's stopwords."""
    return F.filter(
        trainer_tokens(text), lambda w: (F.length(w) > 2) & ~w.isin(*TRAINER_STOPWORDS)
    )


def clean_line(text: Column) -> Column:
    """Null becomes ''; each newline, tab and carriage return becomes a space."""
    return F.translate(F.coalesce(text, F.lit("")), "\n\t\r", "   ")


def clean_metadata(text: Column) -> Column:
    """Null or '' becomes ``Unknown``; pipe to dash, newline and tab to space, carriage
    return deleted, outer spaces trimmed."""
    cleaned = F.trim(F.translate(text, "|\n\t\r", "-  "))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("Unknown")).otherwise(cleaned)


def clean_upload(text: Column) -> Column:
    """Newline to space and pipe to dash; null stays null."""
    return F.translate(text, "\n|", " -")


def content_line(*fields: Column) -> Column:
    """The cleaned fields joined by one space each; empty fields keep their space."""
    return F.concat_ws(" ", *[clean_line(f) for f in fields])


def first_line_title(text: Column) -> Column:
    """First line, trimmed, first 60 characters; '' if there is none."""
    return F.substring(F.trim(F.split_part(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(1))), 1, 60)
