"""Records from extracted document text: sections, labelled values, mentions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recfuse import constants as C
from recfuse.functions import text as X
from recfuse.functions.pin import let, unless_empty
from recfuse.operators import extract as E
from recfuse.operators.rank import first_per_key

PAGE_MARK = r"\n?--- Page \d+ ---\n"
FIELDS = ["slug", "mission_name", "launch_date", "vehicle_type", "payload_mass", "orbit", "status", "details"]


def document_pages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, page_no, text) of a document text with page marks."""
    parts = F.filter(F.split(text, PAGE_MARK), lambda p: ~X.is_blank(p))
    return docs.select(doc_id, F.posexplode(parts).alias("page_no", "text"))


def section_texts(text: Column, min_chars: int = C.SECTION_MIN_CHARS) -> Column:
    """Split by each kind of header line in turn; short sections are dropped."""

    def cut(parts: Column, header: str) -> Column:
        return F.flatten(F.transform(parts, lambda s: F.split(s, rf"(?i)\n\s*{header}\s*\n")))

    parts = reduce(cut, C.SECTION_HEADERS, F.array(text))
    return F.filter(F.transform(parts, X.strip), lambda s: F.length(s) > min_chars)


def sections(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = C.SECTION_MIN_CHARS) -> DataFrame:
    return docs.select(doc_id, F.posexplode(section_texts(F.col(text), min_chars)).alias("section_no", "section"))


def labelled_values(text: Column, labels: dict[str, list[str]]) -> Column:
    """Struct of the labelled values of a text; null if there is none at all."""
    found = {name: F.nullif(E.labelled(text, patterns), F.lit("")) for name, patterns in labels.items()}
    everything = F.struct(*[c.alias(n) for n, c in found.items()])
    return F.when(F.coalesce(*found.values()).isNotNull(), everything)


def _assemble(info: Column, names: Sequence[str], origin: Column, as_of: Column, canonical: bool, extended: bool) -> Column:
    """Record struct from labelled values; null without a name."""
    get = lambda n: info[n] if n in names else F.lit(None).cast("string")
    date = E.first_date(X.collapse_spaces(get("launch_date")), extended, bounded=False)
    rest = [n for n in names if n not in ("mission_name", "launch_date", "vehicle", "mass")]
    shown = F.array_join(
        F.array_compact(
            F.array(*[F.when(get(n).isNotNull(), F.concat(F.lit(f"{n.replace('_', ' ').title()}: "), get(n))) for n in rest])
        ),
        "; ",
    )
    return F.when(
        get("mission_name").isNotNull(),
        F.struct(
            X.page_slug(get("mission_name"), "pdf-mission").alias("slug"),
            get("mission_name").alias("mission_name"),
            date.alias("launch_date"),
            (E.canonical_vehicle(get("vehicle")) if canonical else get("vehicle")).alias("vehicle_type"),
            E.mass_kg(get("mass")).alias("payload_mass"),
            get("orbit").alias("orbit"),
            F.when(date < as_of, "success").otherwise("upcoming").alias("status"),
            F.substring(F.when(shown != "", shown).otherwise(F.concat(F.lit("Extracted from PDF: "), origin)), 1, 500).alias("details"),
        ),
    )


def mention_names(text: Column, patterns: Sequence[str]) -> Column:
    """Distinct mentions, in order of pattern and then of place."""
    hits = F.concat(*[F.regexp_extract_all(text, F.lit(E.FLAGS + p), F.lit(1)) for p in patterns])
    return F.array_distinct(F.transform(hits, X.strip))


def mentions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", patterns: Sequence[str] | None = None) -> DataFrame:
    """Rows (doc_id, position, mission_name, slug), one per distinct mention in a document."""
    names = mention_names(F.col(text), C.MISSION_PATTERNS["mention"] if patterns is None else patterns)
    return docs.select(doc_id, F.posexplode(names).alias("position", "mission_name")).withColumn(
        "slug", X.page_slug("mission_name", "pdf-mission")
    )


FORMATS = ("press_kit", "overview", "technical", "mention")


def document_records(
    docs: DataFrame,
    as_of: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    extended_dates: bool = False,
    formats: Sequence[str] = FORMATS,
) -> DataFrame:
    """Records of a document by the first of ``formats`` that yields any, unique by slug in it.

    Formats: press-kit sections, mission overview, technical sheet, plain mentions.
    """
    t, origin = F.col("_text"), F.col(doc_id).cast("string")

    def from_labels(source: Column, labels: dict[str, list[str]], canonical: bool) -> Column:
        return let(
            labelled_values(source, labels),
            lambda info: _assemble(info, list(labels), origin, as_of, canonical, extended_dates),
        )

    def from_mention(name: Column) -> Column:
        return F.struct(
            X.page_slug(name, "pdf-mission").alias("slug"),
            name.alias("mission_name"),
            F.lit(None).cast("timestamp").alias("launch_date"),
            F.lit(None).cast("string").alias("vehicle_type"),
            F.lit(None).cast("double").alias("payload_mass"),
            F.lit(None).cast("string").alias("orbit"),
            F.lit("upcoming").alias("status"),
            F.concat(F.lit("Extracted from PDF: "), origin).alias("details"),
        )

    rows_by = {
        "press_kit": F.array_compact(F.transform(section_texts(t), lambda s: from_labels(s, C.SECTION_LABELS, True))),
        "overview": F.array_compact(F.array(from_labels(t, C.OVERVIEW_LABELS, False))),
        "technical": F.array_compact(F.array(from_labels(t, C.TECHNICAL_LABELS, False))),
        "mention": F.transform(mention_names(t, C.MISSION_PATTERNS["mention"]), from_mention),
    }
    def tagged(name: str) -> Column:
        return unless_empty(F.transform(rows_by[name], lambda r: F.struct(F.lit(name).alias("format"), r.alias("record"))))

    # The formats are tried in turn: a later one is evaluated only if the earlier ones found nothing.
    rows = docs.select(doc_id, F.col(text).alias("_text")).select(
        doc_id, F.posexplode(F.coalesce(*[tagged(f) for f in formats])).alias("position", "_r")
    )
    flat = rows.select(doc_id, F.col("_r.format").alias("format"), "position", *[F.col(f"_r.record.{f}").alias(f) for f in FIELDS])
    return first_per_key(flat, [doc_id, "slug"], [F.col("position")])
