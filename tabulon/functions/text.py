"""Text column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Code points of the characters that Python's str.strip() removes.
WHITESPACE = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))

# Cell texts that stand for a missing value, compared after strip and lower-case.
MISSING_TOKENS = ("", "na", "n/a", "null", "none", "nan", "-", "--", "?")

# Words left out when sentences are compared.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "to", "of", "in", "on", "for", "with", "as", "by", "at",
    "from", "into", "over", "is", "are", "was", "were", "be", "been", "being", "it", "this",
    "that", "these", "those", "most", "some", "few", "many", "typically", "usually", "often",
)

# Unit of a column by a part of its name, first match wins.
NAME_UNITS = (
    ("s", ("_sec", "seconds", "sek")),
    ("min", ("_min", "minutes")),
    ("h", ("_hour", "_hrs", "stunden", "hours", "_h")),
    ("%", ("percent", "pct", "%", "_rate", "quote")),
    ("€", ("eur", "euro", "revenue", "umsatz", "price")),
)

# Unit named by a word of a description, first match wins.
DESCRIPTION_UNITS = (
    ("days", ("day", "tage")),
    ("hours", ("hour", "stunden")),
    ("minutes", ("minute", "min")),
    ("seconds", ("second", "sek")),
)


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim of every whitespace character, not only blanks."""
    return F.btrim(col_of(c), F.lit(WHITESPACE))


def squeezed(c: Column | str) -> Column:
    """The parts between whitespace of any kind, joined by single blanks."""
    blanks = F.translate(col_of(c), WHITESPACE, " " * len(WHITESPACE))
    return F.array_join(F.filter(F.split(blanks, " "), lambda part: part != ""), " ")


def normal(c: Column | str) -> Column:
    """Strip and lower-case."""
    return F.lower(strip(c))


def as_label(c: Column | str, missing: str = "(missing)") -> Column:
    """A stripped text label with null spelled out."""
    return F.coalesce(strip(col_of(c).cast("string")), F.lit(missing))


def short_label(c: Column | str, width: int = 20) -> Column:
    """At most ``width`` characters, then a marker."""
    text = strip(col_of(c).cast("string"))
    return F.when(F.length(text) <= width, text).otherwise(
        F.concat(F.substring(text, 1, width), F.lit(" [...]"))
    )


def driver_label(feature: Column | str, value: Column | str, n: Column | str) -> Column:
    """``feature=value (n=…)``."""
    return F.concat(
        col_of(feature), F.lit("="), F.coalesce(col_of(value).cast("string"), F.lit("(missing)")),
        F.lit(" (n="), col_of(n).cast("bigint").cast("string"), F.lit(")"),
    )


def fixed(c: Column | str, digits: int, signed: bool = False) -> Column:
    """A fixed number of decimals, halves to even; ``signed`` writes the plus."""
    x = col_of(c).cast("double")
    text = F.translate(F.format_number(F.abs(x), digits), ",", "")
    plus = F.lit("+") if signed else F.lit("")
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(plus), text)


def signed_percent_points(c: Column | str) -> Column:
    """``+1.2pp``."""
    return F.concat(fixed(c, 1, signed=True), F.lit("pp"))


def short_number(c: Column | str) -> Column:
    """Thousands and two decimals from 1000, two decimals from 10, else four without zeros."""
    x = col_of(c).cast("double")
    small = F.regexp_replace(fixed(x, 4), r"\.?0+$", "")
    return (
        F.when(x.isNull() | F.isnan(x), F.lit("—"))
        .when(F.abs(x) >= 1000, F.format_number(x, 2))
        .when(F.abs(x) >= 10, fixed(x, 2))
        .otherwise(small)
    )


def sorted_names(c: Column | str) -> Column:
    """Comma list to a sorted list of trimmed, lower-cased, non-empty names."""
    parts = F.transform(F.split(F.lower(col_of(c)), ","), lambda x: squeezed(x))
    return F.array_sort(F.filter(parts, lambda x: x != ""))


def humanize(c: Column | str) -> Column:
    """Underscores to blanks, first letter upper-case."""
    text = strip(F.regexp_replace(strip(c), "_", " "))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def unit_from_name(c: Column | str) -> Column:
    """Unit guessed from a column name, null when nothing fits."""
    name = F.lower(col_of(c))
    out = F.lit(None).cast("string")
    for unit, parts in reversed(NAME_UNITS):
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.contains(name, F.lit(part))
        out = F.when(hit, F.lit(unit)).otherwise(out)
    return out


def _brackets(text: Column) -> tuple[Column, Column]:
    """What stands before the first opening bracket, and the pieces that begin behind each of them."""
    pieces = F.split(text, "\\(")
    return pieces[0], F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))


def _unit_remark(piece: Column) -> Column:
    """Of a piece behind a bracket that reads ``in something)`` the something in lower case, else null."""
    said = F.lower(squeezed(F.substring_index(piece, ")", 1)))
    return F.when(F.contains(piece, F.lit(")")) & F.startswith(said, F.lit("in ")), F.substr(said, F.lit(4)))


def unit_from_description(c: Column | str) -> Column:
    """The unit of a remark such as ``(in days)``, in letters; else the unit of a word inside the description."""
    text = col_of(c)
    _, pieces = _brackets(text)
    remarks = F.filter(F.transform(pieces, _unit_remark), lambda unit: F.length(F.translate(unit, "abcdefghijklmnopqrstuvwxyz ", "")) == 0)
    out = F.lit(None).cast("string")
    for unit, parts in reversed(DESCRIPTION_UNITS):
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.contains(F.lower(text), F.lit(part))
        out = F.when(hit, F.lit(unit)).otherwise(out)
    return F.coalesce(F.get(remarks, F.lit(0)), out)


def label_from_description(c: Column | str) -> Column:
    """The description without its unit remarks; if it then ends in a bracket, only what stands before the first one."""
    head, pieces = _brackets(col_of(c))
    behind = lambda piece: F.substr(piece, F.locate(")", piece) + 1)
    kept = F.transform(pieces, lambda piece: F.when(_unit_remark(piece).isNotNull(), behind(piece)).otherwise(F.concat(F.lit("("), piece)))
    text = strip(F.concat(head, F.array_join(kept, "")))
    opens = F.locate("(", text)
    closed = F.endswith(text, F.lit(")")) & (opens > 0) & (F.length(text) - opens > 1)
    label = F.when(closed, strip(F.substr(text, F.lit(1), opens - 1))).otherwise(text)
    return F.when(label != "", label)


def words(c: Column | str) -> Column:
    """K2: lower-case word tokens; a token with underscores is followed by its parts."""
    text = F.lower(F.coalesce(col_of(c), F.lit("")))
    text = F.translate(text, chr(0xFFFE) + chr(0xFFFD), "  ")
    text = F.translate(text, chr(0xAD), "")
    text = F.regexp_replace(text, r"[\-/]", " ")
    tokens = F.regexp_extract_all(text, F.lit("([a-z0-9_äöüß]+)"), 1)
    with_parts = F.transform(
        tokens,
        lambda t: F.when(
            F.contains(t, F.lit("_")),
            F.concat(F.array(t), F.filter(F.split(t, "_"), lambda p: p != "")),
        ).otherwise(F.array(t)),
    )
    return F.flatten(with_parts)


def name_words(c: Column | str) -> Column:
    """Tokens of a column name or a short description: the parts and their letter and digit runs."""
    parts = F.filter(F.split(normal(c), r"[_\-\s]+"), lambda p: p != "")
    runs = F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(r"([a-z]+|\d+)"), 1)))
    return F.array_distinct(F.concat(parts, runs))


def _numbers_marked(c: Column | str) -> Column:
    """Lower case, with ``#`` for each number: decimal digits of any script, with sign and fraction if they are there."""
    return F.regexp_replace(F.lower(col_of(c)), r"[+-]?\p{Nd}+(?:[.]\p{Nd}+)?", "#")


def number_free(c: Column | str) -> Column:
    """K6: lower-case, numbers as ``#``, single blanks for whitespace of any kind."""
    return squeezed(_numbers_marked(c))


def content_words(c: Column | str) -> Column:
    """K6: distinct runs of Latin letters and number marks, longer than two, without stop words."""
    runs = F.array_distinct(F.split(_numbers_marked(c), "[^a-z#]+"))
    return F.filter(F.array_except(runs, F.array(*[F.lit(w) for w in STOP_WORDS])), lambda run: F.length(run) > 2)


def is_garbled(c: Column | str, share: float = 0.02, min_chars: int = 20) -> Column:
    """K8: long text with too many control characters."""
    text = col_of(c)
    bad = F.length(F.regexp_replace(text, "[^\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", ""))
    n = F.length(text)
    return (n > min_chars) & (F.try_divide(bad.cast("double"), n.cast("double")) > share)
