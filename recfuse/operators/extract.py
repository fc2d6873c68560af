"""Field extraction from free text: dates, masses, vehicles, status, titles. Built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recfuse import constants as C
from recfuse.functions import text as X
from recfuse.functions.pin import let

FLAGS = "(?iU)"
# A number with or without thousands separators, before its unit.
NUMBER = r"(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"


def mass_kg(c: Column | str, unitless_is_kg: bool = False) -> Column:
    """Mass in kg from text: kilograms anywhere in the text first, then tonnes."""
    text = X.col(c)

    def amount(pattern: str) -> Column:
        found = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
        return F.replace(found, F.lit(","), F.lit("")).try_cast("double")

    parsed = F.coalesce(amount(rf"(?i){NUMBER}\s*kg"), amount(rf"(?i){NUMBER}\s*t") * F.lit(1000.0))
    return F.coalesce(parsed, amount(rf"^\s*{NUMBER}\s*$")) if unitless_is_kg else parsed


def first_date(c: Column | str, extended: bool = False, bounded: bool = True) -> Column:
    """First valid ISO date in a text; with ``extended`` also month names and slashes."""
    text = X.col(c)
    b = r"\b" if bounded else ""

    def scan(pattern: str, formats: list[str]) -> Column:
        parsed = lambda s: F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats])
        hits = F.regexp_extract_all(text, F.lit(f"{b}{pattern}{b}"), F.lit(1))
        return F.try_element_at(F.array_compact(F.transform(hits, parsed)), F.lit(1))

    iso = scan(C.ISO_DATE, ["yyyy-MM-dd"])
    if not extended:
        return iso
    return F.coalesce(
        iso,
        scan(C.MONTH_FIRST_DATE, ["MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy"]),
        scan(C.DAY_FIRST_DATE, ["d MMMM yyyy", "d MMM yyyy"]),
        scan(C.SLASHED_DATE, ["M/d/yyyy"]),
    )


def vehicle(c: Column | str, kind: str) -> Column:
    return X.first_match(c, C.VEHICLE_PATTERNS[kind], flags=FLAGS)


def canonical_vehicle(c: Column | str) -> Column:
    name = X.strip(c)
    out = name
    for pattern, canonical in reversed(C.VEHICLE_CANONICAL):
        out = F.when(F.rlike(name, F.lit(FLAGS + pattern)), F.lit(canonical)).otherwise(out)
    return out


def status_from_date(date: Column, as_of: Column) -> Column:
    return F.when(date.isNull() | (date > as_of), "upcoming").otherwise("success")


def status(c: Column | str, kind: str, date: Column, as_of: Column) -> Column:
    """First vocabulary group with a word in the text decides; otherwise the date does.

    Order matters: "unsuccessful" contains "success" and so counts as a success, as ever.
    """

    def decide(lowered: Column) -> Column:
        out = status_from_date(date, as_of)
        for value, group in reversed(C.STATUS_WORDS[kind]):
            out = F.when(X.contains_any(lowered, group, lowered=True), F.lit(value)).otherwise(out)
        return out

    return let(F.lower(X.col(c)), decide)


def clean_title(c: Column | str) -> Column:
    """News title without agency prefix and suffix; null if generic and short, or too short."""
    t = F.regexp_replace(X.col(c), r"(?i)^(NASA|Press Release|News):\s*", "")
    t = F.regexp_replace(t, r"(?i)\s*-\s*NASA$", "")
    generic = lambda s: X.contains_any(s, C.GENERIC_TITLE_TERMS) & (F.length(s) < 30)
    return let(t, lambda s: F.when(~generic(s) & (F.length(s) > 5), X.strip(s)))


def cell_text(c: Column | str) -> Column:
    """Table cell text without [n] marks; null when at most one character is left."""
    unmarked = lambda s: F.when(s.contains("["), F.regexp_replace(s, r"\[\d+\]", "")).otherwise(s)
    return let(X.strip(X.collapse_spaces(let(X.col(c), unmarked))), lambda s: F.when(F.length(s) > 1, s))


def absolute(url: Column, base: Column) -> Column:
    """Resolve a root-relative reference against a site."""
    return (
        F.when(url.startswith("//"), F.concat(F.substring_index(base, "//", 1), url))
        .when(url.startswith("/"), F.concat(base, url))
        .otherwise(url)
    )


def site_of(url: Column | str) -> Column:
    return F.regexp_extract(X.col(url), r"^([a-zA-Z]+://[^/?#]+)", 1)


def lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), X.strip), lambda s: s != "")


def middle_lines(c: Column) -> Column:
    """Details fallback: a long text without its first and last line."""
    ls = lines(c)
    body = F.array_join(F.slice(ls, F.lit(2), F.greatest(F.size(ls) - 2, F.lit(0))), " ")
    return F.when((F.length(c) > 100) & (F.size(ls) > 2) & (F.length(body) > 20), F.substring(body, 1, 500))


def first_sentences(c: Column) -> Column:
    """Details fallback: the first three sentences of a long text."""
    parts = F.split(c, r"\. ")
    body = F.array_join(F.slice(parts, 1, 3), ". ")
    return F.when((F.length(c) > 100) & (F.size(parts) > 1) & (F.length(body) > 50), F.substring(body, 1, 500))


def indicator_count(c: Column) -> Column:
    def count(lowered: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.contains(lowered, F.lit(w)).cast("int") for w in C.TABLE_INDICATORS])

    return let(F.lower(c), count)


def header_role(c: Column) -> Column:
    """Column role of a header text; null when no role's word occurs."""

    def choose(lowered: Column) -> Column:
        out = F.lit(None).cast("string")
        for role, role_words in reversed(C.HEADER_ROLES):
            out = F.when(X.contains_any(lowered, role_words, lowered=True), F.lit(role)).otherwise(out)
        return out

    return let(F.lower(c), choose)


def instant_attr(c: Column) -> Column:
    """Value of a time element's machine-readable attribute."""
    return F.nullif(c, F.lit("")).try_cast("timestamp")


def labelled(c: Column, labels: list[str]) -> Column:
    """Value after the first label of an ordered list that occurs in the text."""
    return X.strip(X.first_match(c, [rf"{label}:\s*([^\n]+)" for label in labels], flags=FLAGS))

