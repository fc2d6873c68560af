"""Record schemas and the profile that makes every operator generic over column names."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from recfuse import constants as C

LAUNCH_FIELDS = [
    "slug", "mission_name", "launch_date", "vehicle_type", "payload_mass", "orbit", "status",
    "details", "mission_patch_url", "webcast_url",
]
SOURCE_FIELDS = ["source_name", "source_url", "scraped_at", "data_quality_score"]


def _struct(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in pairs])


LAUNCH = _struct(
    ("slug", T.StringType()),
    ("mission_name", T.StringType()),
    ("launch_date", T.TimestampType()),
    ("vehicle_type", T.StringType()),
    ("payload_mass", T.DoubleType()),
    ("orbit", T.StringType()),
    ("status", T.StringType()),
    ("details", T.StringType()),
    ("mission_patch_url", T.StringType()),
    ("webcast_url", T.StringType()),
)
SOURCE = _struct(
    ("source_name", T.StringType()),
    ("source_url", T.StringType()),
    ("scraped_at", T.TimestampType()),
    ("data_quality_score", T.DoubleType()),
)
CONFLICT = _struct(
    ("field_name", T.StringType()),
    ("source1_value", T.StringType()),
    ("source2_value", T.StringType()),
    ("confidence_score", T.DoubleType()),
    ("resolved", T.BooleanType()),
)
# Raw claims arrive as text only; typing happens in the cleaning step, never by inference.
RAW = T.StructType(
    [
        T.StructField("raw", _struct(*[(n, T.StringType()) for n in LAUNCH_FIELDS])),
        T.StructField("source", _struct(*[(n, T.StringType()) for n in SOURCE_FIELDS])),
        T.StructField("ingest_seq", T.LongType()),
    ]
)
# Types at rest, matching the curated tables' column definitions.
LAUNCHES_TABLE = T.StructType(
    [T.StructField("id", T.LongType())]
    + [
        T.StructField(f.name, T.DecimalType(10, 2) if f.name == "payload_mass" else f.dataType)
        for f in LAUNCH.fields
    ]
    + [T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType())]
)
SOURCES_TABLE = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("launch_id", T.LongType())]
    + [
        T.StructField(f.name, T.DecimalType(3, 2) if f.name == "data_quality_score" else f.dataType)
        for f in SOURCE.fields
    ]
)
CONFLICTS_TABLE = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("launch_id", T.LongType())]
    + [
        T.StructField(f.name, T.DecimalType(3, 2) if f.name == "confidence_score" else f.dataType)
        for f in CONFLICT.fields
    ]
    + [T.StructField("created_at", T.TimestampType()), T.StructField("resolved_at", T.TimestampType())]
)

# How a field's values are compared: by instant, by relative size, as fuzzy text, as a status
# class, or as exact trimmed text.
DATE, NUMBER, TEXT, STATUS, EXACT = "date", "number", "text", "status", "exact"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    weight: float = 0.5


@dataclass(frozen=True)
class RecordProfile:
    """Names the columns an operator works on.

    ``seq`` is the ingest order (last sort key everywhere). Its first column must be an integer:
    the skew-safe ranking cuts hot groups into ranges of it.
    """

    key: str
    source: str
    quality: str
    seq: tuple[str, ...]
    fields: tuple[Field, ...]
    priority: str | None = None
    date: str | None = None
    longest_text: str | None = None
    key_fields: tuple[str, ...] = tuple(C.KEY_FIELDS)
    base_fields: tuple[str, ...] = tuple(C.BASE_CONFLICT_FIELDS)
    completeness: dict[str, float] = field(default_factory=lambda: dict(C.COMPLETENESS_WEIGHTS), hash=False)

    @property
    def field_names(self) -> list[str]:
        return [f.name for f in self.fields]


_LAUNCH_KINDS = {
    "mission_name": TEXT,
    "launch_date": DATE,
    "status": STATUS,
    "vehicle_type": TEXT,
    "payload_mass": NUMBER,
    "orbit": TEXT,
    "details": EXACT,
    "mission_patch_url": EXACT,
    "webcast_url": EXACT,
}

LAUNCH_PROFILE = RecordProfile(
    key="slug",
    source="source_name",
    quality="data_quality_score",
    seq=("ingest_seq",),
    fields=tuple(Field(n, _LAUNCH_KINDS[n], w) for n, w in C.FIELD_WEIGHTS.items()),
    date="launch_date",
    longest_text="details",
)
