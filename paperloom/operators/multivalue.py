r"""Problem 3: several values packed in one field, split to one row per value.

Quoted spans are cut out first and stand as indexed placeholders while the rest is split,
then come back through an array lookup. Everything is a chain of JVM expressions on one
row, so there is no shuffle and no skew. Placeholders use three private-use characters;
where a text already holds one, it is escaped first and unescaped last, so no text can
collide with a placeholder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, ESCAPE, COMMA = "\ue000", "\ue001", "\ue002", "\ue003"
RESERVED = (ESCAPE, OPEN, CLOSE, COMMA)

# A quoted span begins where a value can begin and ends where a value can end; an
# apostrophe between letters is neither. Every loop over a group is possessive: Java runs
# such loops without recursion, and none of them could match by giving a character back.
# No scan passes the next opening mark, so an unclosed quote costs one scan to there.
_BEFORE, _AFTER = r"(?<![^\s,;|/\[({:])", r"(?![^\s,;|/\])}:])"
QUOTED = "|".join(
    _BEFORE + span + _AFTER
    for span in (
        r'"[^"]*+(?:""[^"]*+)*+"', r"'[^'\n]*+(?:(?<=\p{L})'(?=\p{L})[^'\n]*+)*+'",
        r"\u201c[^\u201c\u201d]*+\u201d", r"\u00ab[^\u00ab\u00bb]*+\u00bb")
)
_SPAN = f"{OPEN}([0-9]+){CLOSE}"

_PARTICLE = r"(?:van|von|der|den|de|del|della|di|da|dos|das|du|la|le|el|al|bin|ibn|ter|ten|zu|zur)"
_UPPER_PARTICLE = _PARTICLE.upper()
_FAMILY = rf"(?:(?:{_PARTICLE} +(?=\p{{L}}))*+|(?:{_UPPER_PARTICLE} +(?=\p{{L}}))*+)\p{{L}}[\p{{L}}\p{{M}}'\u2019-]++"
_INITIAL = r"\p{L}\.?(?:[ -]?\p{L}\.)*+"
_GIVEN = rf"(?:{_INITIAL}|\p{{L}}[\p{{L}}\p{{M}}'\u2019-]++)(?: +{_INITIAL}(?!\p{{L}}))*+(?: +{_PARTICLE}(?!\p{{L}}))*+"
_SUFFIX = r"(?:(?i:jr|sr)\b\.?|(?:II|III|IV)\b)"
_GROUP = r"(?i:\b(?:collaboration|collab\.?|coll\.?|consortium|group|team))"


def _sub(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, pattern, to)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _where(text: Column, sign: str, change: Callable[[Column], Column]) -> Column:
    """``change(text)`` for texts that hold ``sign``, which all it could change hold; the cheap
    test spares the others."""
    return _let(text, lambda t: F.when(t.contains(sign), change(t)).otherwise(t))


def _escape(text: Column) -> Column:
    def escaped(t: Column) -> Column:
        for i, c in enumerate(RESERVED):
            t = F.replace(t, F.lit(c), F.lit(f"{ESCAPE}{i}"))
        return t

    return _let(text, lambda t: F.when(t.rlike(f"[{''.join(RESERVED)}]"), escaped(t)).otherwise(t))


def _unescape(text: Column) -> Column:
    for i, c in reversed(list(enumerate(RESERVED))):
        text = F.replace(text, F.lit(f"{ESCAPE}{i}"), F.lit(c))
    return text


def _prepared(text: Column) -> Column:
    """A line that begins with blanks continues the line before; runs of blanks are one;
    reserved characters are escaped. Null is empty."""
    joined = _where(F.coalesce(text, F.lit("")), "\n", lambda t: _sub(t, r"\r?\n[ \t]+", " "))
    blank = r"[^\S\r\n]{2,}+|[\x0B\f\t]"
    return _escape(_let(joined, lambda t: F.when(t.rlike(blank), _sub(t, blank, " ")).otherwise(t)))


def _quoted(text: Column) -> Column:
    return text.rlike("[\"'\u201c\u00ab]")


def _spans(text: Column) -> Column:
    """Array of the quoted spans."""
    return F.when(_quoted(text), F.regexp_extract_all(text, F.lit(f"({QUOTED})"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _masked(text: Column, around: str) -> Column:
    """The text with each quoted span replaced by its indexed placeholder."""
    held = lambda parts: F.array_join(F.transform(parts, lambda p, i: F.when(
        i < F.size(parts) - 1, F.concat(p, F.lit(around + OPEN), i.cast("string"), F.lit(CLOSE + around))).otherwise(p)), "")
    return F.when(_quoted(text), _let(F.split(text, QUOTED, -1), held)).otherwise(text)


_OUTER = r"""[\s,;:|/&\u00b7\u2022"'\u201c\u201d\u00ab\u00bb\[\](){}<>]"""


def _trimmed(value: Column) -> Column:
    """No outer quotes, brackets or separators; runs of white space are one space."""
    value = _sub(value, r"[\s\u00a0\u200b\ufeff]+", " ")
    return _sub(value, rf"^{_OUTER}++|(?<!{_OUTER}){_OUTER}++$", "")


def _restored(pieces: Column, spans: Column) -> Column:
    """Placeholders become their spans, values are trimmed, empty ones are dropped."""

    def span(piece: Column) -> Column:
        return F.replace(F.get(spans, F.regexp_extract(piece, _SPAN, 1).try_cast("int")), F.lit('""'), F.lit('"'))

    def one(piece: Column) -> Column:
        whole = F.when(piece.contains(OPEN), span(piece)).otherwise(F.replace(piece, F.lit(COMMA), F.lit(",")))
        return _trimmed(_where(whole, ESCAPE, _unescape))

    return F.filter(F.transform(pieces, one), lambda v: v != "")


def split_codes(text: Column) -> Column:
    """Array of the values of a code field: separated by white space, commas, semicolons,
    bars or slashes, perhaps in brackets; only quoted values hold any of these."""

    def codes(t: Column) -> Column:
        pieces = F.split(_masked(t, " "), r"[\s\u00a0,;|\[\]{}()]+")
        return _restored(F.filter(pieces, lambda p: ~F.lower(p).isin("/", "&", "+", "and", "\u00b7")), _spans(t))

    return _let(_prepared(text), codes)


def split_names(text: Column) -> Column:
    """Array of the names of an author field.

    Separators are line ends, semicolons, bars, spaced slashes, dots in the middle, ``and``,
    ``&``, the colon after a group's name, and commas, except the comma of a name written
    family first (a lone family name, perhaps with particles, before a given name or
    initials) and the one before a suffix. Parenthesized markers are dropped.
    """
    first = rf"(?m)(^|,)(\s*{_FAMILY}(?:{COMMA} {_SUFFIX})?)\s*,\s*(?={_GIVEN}\s*(?:,|{COMMA}|$))(\S[^,\n]*)"

    def names(t: Column) -> Column:
        bare = _masked(t, "\n")
        bare = _where(bare, "(", lambda x: _sub(_sub(x, r"\([^()]*\)", " "), r"\([^()]*\)", " "))  # markers in markers
        bare = _where(bare, ":", lambda x: _sub(x, rf"({_GROUP})\s*:", "$1\n"))
        bare = _sub(bare, r"(?i)(?<![\s,])[\s,]++(?:and|&)(?=\s)|^\s*(?:and|&)\s|\bet al\b\.?", "\n")
        bare = _sub(bare, r"\s*[;|\u00b7\u2022]\s*|\s+/\s+|\s*[\r\n]\s*", "\n")
        bare = _where(bare, ",", lambda x: _sub(_sub(
            x, rf"(?<!\s)\s*+,\s*(?={_SUFFIX}\s*(?:,|\n|$))", f"{COMMA} "), first, f"$1$2{COMMA} $3"))
        kept = _restored(F.split(bare, r"[,\n]"), _spans(t))
        unmarked = F.transform(kept, lambda v: F.when(v.contains("("), _trimmed(_sub(v, r"\([^()]*\)", " "))).otherwise(v))
        return F.filter(unmarked, lambda v: v != "")

    return _let(_prepared(text), names)


def values(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(key, field, pos, value): one row per value of each field.

    ``fields`` maps a column to ``names`` or ``codes``. ``pos`` counts from 1 in order of
    writing; repeated values stay; null, empty and blank fields give no row. Very long
    fields are one row's work. Other columns are ignored, whatever their names.
    """
    how = {"names": split_names, "codes": split_codes}
    packed = F.array(*[
        F.struct(F.lit(c).alias("field"), how[k](F.col(f"`{c}`")).alias("v")) for c, k in fields.items()])
    return (
        df.select(F.col(key), F.explode(packed).alias("p"))
        .select(key, F.col("p.field").alias("field"), F.posexplode("p.v").alias("i", "value"))
        .select(key, "field", (F.col("i") + 1).cast("long").alias("pos"), "value")
    )
