"""Text expressions: normalisers, slugs, word-set similarity. Built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recfuse import constants as C
from recfuse.functions.pin import let

# Character classes equal to the Unicode word and whitespace classes the rules were written for;
# Java's own \w and \s are ASCII-only and its (?U) forms include combining marks.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.trim(col(c), F.lit(SPACE_CHARS))


def collapse_spaces(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"[{SPACE}]+", " ")


def null_if_blank(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def is_blank(c: Column | str) -> Column:
    """True for null and for text of whitespace only; never null."""
    return F.coalesce(strip(c) == "", F.lit(True))


def slug(name: Column | str) -> Column:
    kept = F.regexp_replace(F.lower(col(name)), f"[^{WORD}{SPACE}-]", "")
    return F.trim(F.regexp_replace(kept, f"[-{SPACE}]+", "-"), F.lit("-"))


def page_slug(name: Column | str, prefix: str = "mission") -> Column:
    """Slug for extracted names: folds underscores too; a hash stands in when nothing is left."""
    kept = F.regexp_replace(F.lower(col(name)), f"[^{WORD}{SPACE}-]", "")
    folded = F.trim(F.regexp_replace(kept, f"[{SPACE}_-]+", "-"), F.lit("-"))
    fallback = F.concat(F.lit(f"{prefix}-"), F.pmod(F.xxhash64(col(name)), F.lit(10000)).cast("string"))
    return F.when(folded != "", folded).otherwise(fallback)


def comparable(c: Column | str) -> Column:
    """Form in which conflict detection compares text."""
    lowered = collapse_spaces(F.lower(col(c)))
    return strip(F.regexp_replace(lowered, f"[^{WORD}{SPACE}]", ""))


def dedup_name(c: Column | str) -> Column:
    """Form in which duplicate search compares names."""
    s = F.regexp_replace(F.lower(col(c)), rf"^(spacex[{SPACE}]+|mission[{SPACE}]+)", "")
    s = F.regexp_replace(s, rf"[{SPACE}]+(mission|launch)$", "")
    s = F.regexp_replace(s, f"[^{WORD}{SPACE}]", " ")
    return strip(collapse_spaces(s))


def union_name(c: Column | str) -> Column:
    """Form in which the multi-source union compares names."""
    s = strip(collapse_spaces(F.lower(col(c))))
    for noise in ("mission", "launch"):
        s = strip(F.replace(s, F.lit(noise), F.lit("")))
    return s


def words(c: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(col(c), f"[{SPACE}]+"), lambda w: w != ""))


def either_contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Common words over the size of the larger set; null when both sets are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.greatest(F.size(a), F.size(b)))


def names_similar(na: Column, nb: Column, wa: Column, wb: Column, threshold: float = C.NAME_OVERLAP) -> Column:
    """Equal, contained, or enough common words. Arguments are normalised names and their words."""
    enough = (F.size(wa) > 0) & (F.size(wb) > 0) & (overlap_ratio(wa, wb) >= threshold)
    return (na == nb) | either_contains(na, nb) | F.coalesce(enough, F.lit(False))


def jaccard(a: Column, b: Column) -> Column:
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    )


def contains_any(c: Column | str, keywords: list[str], lowered: bool = False) -> Column:
    """Any keyword occurs in the text, which may be given ``lowered`` already."""
    text = col(c) if lowered else F.lower(col(c))
    if len(keywords) > 4:
        # Many keywords: one alternation keeps it a single scan of the text.
        quoted = "|".join(r"\Q" + k + r"\E" for k in keywords)
        return F.coalesce(F.rlike(text, F.lit(quoted)), F.lit(False))

    def any_in(t: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(t, F.lit(k)) for k in keywords])

    return F.coalesce(any_in(text) if lowered else let(text, any_in), F.lit(False))


def first_match(c: Column | str, patterns: list[str], group: int = 1, flags: str = "(?i)") -> Column:
    """First pattern of an ordered list that matches wins; its match is returned as written."""
    text = col(c)
    found = [
        F.when(F.rlike(text, F.lit(flags + p)), F.regexp_extract(text, flags + p, group)) for p in patterns
    ]
    return F.coalesce(*found)


def title_label(c: Column | str) -> Column:
    """in_flight -> In Flight."""
    return F.initcap(F.replace(col(c), F.lit("_"), F.lit(" ")))


def redact(m: Column, depth: int = 1) -> Column:
    """Hide map values whose key looks sensitive; ``depth`` is the declared nesting of maps."""
    pattern = "|".join(C.SENSITIVE_KEY_PARTS)

    def hide(k: Column, v: Column) -> Column:
        if depth == 1:
            return F.when(F.rlike(F.lower(k), F.lit(pattern)), F.lit(C.REDACTED)).otherwise(v)
        # A nested map keeps its type: a sensitive key hides every value below it.
        return F.when(
            F.rlike(F.lower(k), F.lit(pattern)), F.transform_values(v, lambda _k, _v: F.lit(C.REDACTED))
        ).otherwise(redact(v, depth - 1))

    return F.transform_values(m, hide)


def route_template(path: Column | str) -> Column:
    """Request path without query, with identifiers replaced by their placeholder."""
    p = F.substring_index(col(path), "?", 1)
    detail = p.startswith("/api/launches/") & (F.size(F.split(p, "/")) > 3)
    return (
        F.when(detail, F.lit("/api/launches/{slug}"))
        .when(
            p.startswith("/api/admin/conflicts/") & p.endswith("/resolve"),
            F.lit("/api/admin/conflicts/{id}/resolve"),
        )
        .when(p.startswith("/api/admin/refresh/status/"), F.lit("/api/admin/refresh/status/{task_id}"))
        .otherwise(p)
    )


def client_id(api_key: Column, authorization: Column, real_ip: Column, forwarded_for: Column, host: Column) -> Column:
    given = lambda c: F.nullif(c, F.lit(""))
    token = F.when(authorization.startswith("Bearer "), F.substring(authorization, 8, 8))
    ip = F.coalesce(given(real_ip), strip(F.substring_index(given(forwarded_for), ",", 1)), given(host), F.lit("unknown"))
    return F.coalesce(
        F.concat(F.lit("api_key:"), F.substring(given(api_key), 1, 8), F.lit("...")),
        F.concat(F.lit("jwt:"), token, F.lit("...")),
        F.concat(F.lit("ip:"), ip),
    )


def is_noise(exception: Column | str, message: Column | str) -> Column:
    return F.coalesce(col(exception).isin(C.NOISE_EXCEPTIONS), F.lit(False)) | contains_any(message, C.NOISE_WORDS)
