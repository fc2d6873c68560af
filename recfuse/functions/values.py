"""Typed-value expressions: coercion, comparison arithmetic, text forms of values, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recfuse import constants as C
from recfuse.functions.text import col, strip

NUMERAL = r"^[\s]*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[\s]*$"
# Accepted text forms of an instant with the shape each must have; a missing zone means UTC. The
# shape is tested first because a failed parse costs an exception per row.
_DAY, _CLOCK = r"\d{4}-\d{1,2}-\d{1,2}", r"\d{1,2}:\d{1,2}:\d{1,2}"
TIMESTAMP_FORMATS = [
    ("yyyy-M-d'T'H:m:sXXX", rf"^{_DAY}T{_CLOCK}(Z|[+-]\d\d:\d\d)$"),
    ("yyyy-M-d'T'H:m:sXX", rf"^{_DAY}T{_CLOCK}[+-]\d{{4}}$"),
    ("yyyy-M-d H:m:s", rf"^{_DAY} {_CLOCK}$"),
    ("yyyy-M-d", rf"^{_DAY}$"),
]
_MONTH = r"[A-Z][a-z]{3,}"
EXTENDED_DATE_FORMATS = [
    ("MMMM d, yyyy", rf"^{_MONTH} \d{{1,2}}, \d{{4}}$"),
    ("MMMM d yyyy", rf"^{_MONTH} \d{{1,2}} \d{{4}}$"),
    ("MMM d, yyyy", r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"),
    ("d MMMM yyyy", rf"^\d{{1,2}} {_MONTH} \d{{4}}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
]


def to_number(c: Column | str) -> Column:
    """Number or null; text that is not a plain numeral becomes null."""
    text = col(c).cast("string")
    return F.when(F.rlike(text, F.lit(NUMERAL)), F.trim(text).try_cast("double"))


def to_instant(c: Column | str, formats: list[tuple[str, str]] | None = None) -> Column:
    """Timestamp from text in one of a few fixed formats, else null."""
    text = col(c)
    return F.coalesce(
        *[
            F.when(F.rlike(text, F.lit(shape)), F.try_to_timestamp(text, F.lit(fmt)))
            for fmt, shape in (formats or TIMESTAMP_FORMATS)
        ]
    )


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch, for TIMESTAMP and TIMESTAMP_NTZ alike (session zone UTC)."""
    return F.unix_micros(col(c).cast("timestamp"))


def seconds_apart(a: Column, b: Column) -> Column:
    return F.abs(micros(a) - micros(b)) / F.lit(1e6)


def differ_by_mean(a: Column, b: Column, percent: float) -> Column:
    """Difference above ``percent`` of the mean size of both numbers."""
    mean = (F.abs(a) + F.abs(b)) / F.lit(2.0)
    return F.coalesce(F.try_divide(F.abs(a - b), mean) * F.lit(100.0) > percent, F.lit(False))


def differ_by_max(a: Column, b: Column, share: float) -> Column:
    """Difference above ``share`` of the larger number."""
    return F.coalesce(F.try_divide(F.abs(a - b), F.greatest(F.abs(a), F.abs(b))) > share, F.lit(False))


def number_similarity(a: Column, b: Column) -> Column:
    rel = F.try_divide(F.abs(a - b), F.greatest(F.abs(a), F.abs(b)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.coalesce(rel, F.lit(0.0))))


def status_class(c: Column | str) -> Column:
    """Canonical status of a spelling, or the lowered spelling itself if it is in no class."""
    s = F.lower(strip(c))
    mapping = F.create_map(*[F.lit(x) for k, v in C.STATUS_CLASSES.items() for w in v for x in (w, k)])
    return F.coalesce(F.try_element_at(mapping, s), s)


def clean_status(c: Column | str) -> Column:
    s = F.lower(strip(c))
    mapping = F.create_map(*[F.lit(x) for k, v in C.STATUS_SYNONYMS.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(mapping, s), s)


def number_text(c: Column) -> Column:
    """Shortest decimal text of a double, without exponent between 1e-4 and 1e16."""
    plain = c.cast("double").cast("string")
    a = F.abs(c)
    wide = F.regexp_replace(plain.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    wide = F.when(wide.endswith("."), F.concat(wide, F.lit("0"))).otherwise(wide)
    return F.when(plain.contains("E") & (a >= 1e-4) & (a < 1e16), F.coalesce(wide, plain)).otherwise(plain)


def instant_text(c: Column, separator: str = "T", zone: str = "+00:00") -> Column:
    """ISO text of an instant; the fraction appears only when there is one."""
    ts = c.cast("timestamp")
    quoted = f"yyyy-MM-dd'{separator}'HH:mm:ss"
    fraction = F.when(F.pmod(micros(ts), F.lit(1_000_000)) != 0, F.date_format(ts, ".SSSSSS")).otherwise("")
    return F.concat(F.date_format(ts, quoted), fraction, F.lit(zone))


def age_hours(ts: Column, as_of: Column) -> Column:
    return (micros(as_of) - micros(ts)) / F.lit(3_600_000_000.0)


def relative_age(ts: Column, as_of: Column) -> Column:
    minutes = F.floor((micros(as_of) - micros(ts)) / F.lit(60_000_000))
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)

    def phrase(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))

    return (
        F.when(days > 0, phrase(days, "day"))
        .when(hours > 0, phrase(hours, "hour"))
        .when(minutes > 0, phrase(minutes, "minute"))
        .otherwise("Just now")
    )


def staleness(ts: Column, as_of: Column, stale_s: int = 300, max_age_s: int = 86400) -> Column:
    age = micros(as_of) - micros(ts)
    return (
        F.when(age > max_age_s * 1_000_000, "expired").when(age > stale_s * 1_000_000, "stale").otherwise("fresh")
    )


def date_label(ts: Column, fmt: str = "MMM d, yyyy") -> Column:
    return F.coalesce(F.date_format(ts, fmt), F.lit("TBD"))


def ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b)
