"""Read queries over the curated tables: lookups, filters, search, top-k, pages, nested details."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recfuse.operators.rank import spread_row_number

SORTABLE = ("launch_date", "mission_name", "status")
MAX_LIMIT = 100
#: Children in an array.
PAGE = 1000


def hours_before(as_of: Column, hours: int) -> Column:
    return as_of - F.expr(f"INTERVAL {hours} HOURS")


def days_before(as_of: Column, days: int) -> Column:
    return hours_before(as_of, 24 * days)


def _newest(c: str) -> Column:
    return F.col(c).desc_nulls_first()


def lookup(df: DataFrame, column: str, value: object) -> DataFrame:
    """First row with this value, by id."""
    return df.filter(F.col(column) == F.lit(value)).orderBy("id").limit(1)


def multi_get(
    df: DataFrame,
    filters: dict[str, object] | None = None,
    order_by: str | None = None,
    skip: int = 0,
    limit: int = 100,
) -> DataFrame:
    """Equality filters, one sort field, offset and limit; fields the table lacks are ignored."""
    order = [F.col(order_by).asc_nulls_last()] if order_by in df.columns else []
    return _equal(df, filters).orderBy(*order, "id").offset(skip).limit(limit)


def _equal(df: DataFrame, filters: dict[str, object] | None) -> DataFrame:
    conds = [F.col(c) == F.lit(v) for c, v in (filters or {}).items() if c in df.columns]
    return df.filter(reduce(lambda a, b: a & b, conds)) if conds else df


def count_where(df: DataFrame, filters: dict[str, object] | None = None) -> DataFrame:
    return _equal(df, filters).agg(F.count("*").alias("n"))


def upcoming(df: DataFrame, as_of: Column, limit: int = 50) -> DataFrame:
    hit = (F.col("status") == "upcoming") & (F.col("launch_date") >= as_of)
    return df.filter(hit).orderBy("launch_date", "id").limit(limit)


def historical(
    df: DataFrame,
    as_of: Column,
    status: str | None = None,
    vehicle: str | None = None,
    skip: int = 0,
    limit: int = 50,
) -> DataFrame:
    past = _equal(
        df.filter(F.col("launch_date") < as_of),
        {c: v for c, v in (("status", status), ("vehicle_type", vehicle)) if v},
    )
    return past.orderBy(_newest("launch_date"), "id").offset(skip).limit(limit)


def matches(term: str, escape: bool = False) -> Column:
    """Case-insensitive substring of name or details. % and _ in the term are wildcards unless escaped."""
    if escape:
        for ch in ("\\", "%", "_"):
            term = term.replace(ch, "\\" + ch)
    pattern = f"%{term}%"
    return F.col("mission_name").ilike(pattern) | F.col("details").ilike(pattern)


def search(
    df: DataFrame, term: str, status: str | None = None, skip: int = 0, limit: int = 50, escape: bool = False
) -> DataFrame:
    found = _equal(df.filter(matches(term, escape)), {"status": status} if status else None)
    return found.orderBy(_newest("launch_date"), "id").offset(skip).limit(limit)


def in_date_range(df: DataFrame, start: Column, end: Column) -> DataFrame:
    return df.filter(F.col("launch_date").between(start, end)).orderBy("launch_date", "id")


@dataclass(frozen=True)
class ListParams:
    status: str | None = None
    vehicle_type: str | None = None
    search: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    sort_by: str = "launch_date"
    sort_order: str = "desc"
    skip: int = 0
    limit: int = 50


def list_filter(df: DataFrame, p: ListParams) -> DataFrame:
    out = _equal(df, {c: v for c, v in (("status", p.status), ("vehicle_type", p.vehicle_type)) if v})
    if p.search:
        out = out.filter(matches(p.search))
    if p.date_from:
        out = out.filter(F.col("launch_date") >= F.lit(p.date_from).cast("timestamp"))
    if p.date_to:
        out = out.filter(F.col("launch_date") <= F.lit(p.date_to).cast("timestamp"))
    return out


def list_page(df: DataFrame, p: ListParams) -> DataFrame:
    """One page of the filtered list. Null dates sort as the database sorts them."""
    if p.sort_by not in SORTABLE:
        raise ValueError(f"sort_by must be one of {SORTABLE}")
    if p.skip < 0 or not 1 <= p.limit <= MAX_LIMIT:
        raise ValueError(f"skip must not be negative and limit must be 1 to {MAX_LIMIT}")
    c = F.col(p.sort_by)
    order = c.desc_nulls_first() if p.sort_order == "desc" else c.asc_nulls_last()
    return list_filter(df, p).orderBy(order, "id").offset(p.skip).limit(p.limit)


def page_meta(df: DataFrame, p: ListParams) -> DataFrame:
    """Exact totals and page numbers of a list query."""
    total = F.col("total")
    pages = F.ceil(total / F.lit(p.limit))
    page = F.lit(p.skip // p.limit + 1)
    return (
        list_filter(df, p)
        .agg(F.count("*").alias("total"))
        .select(
            "total",
            page.alias("page"),
            F.lit(p.limit).alias("per_page"),
            pages.cast("bigint").alias("total_pages"),
            (page < pages).alias("has_next"),
            (page > 1).alias("has_prev"),
        )
    )


def child_pages(children: DataFrame, fk: str, out: str, size: int = PAGE) -> DataFrame:
    """Children per parent as arrays of ``size`` or fewer, by child id: rows (fk, page, out).

    Children are numbered within their parent by ranges of the id, so no task numbers all children
    of one parent; the page is the number over ``size``. ``children`` has an integer ``id``.
    """
    fields = [c for c in children.columns if c != fk]
    numbered = spread_row_number(children, [fk], [], ["id"], "_number")
    page = F.floor((F.col("_number") - 1) / F.lit(size)).cast("int").alias("page")
    return numbered.groupBy(fk, page).agg(F.sort_array(F.collect_list(F.struct("id", *[c for c in fields if c != "id"]))).alias(out))


def nest(parents: DataFrame, children: dict[str, DataFrame], fk: str, size: int = PAGE) -> DataFrame:
    """Parents with pages of their children: a row for each parent and ``page``, an array per kind.

    Every parent has page 0, and as many as its longest list of children needs; a cursor is
    (parent, page). Kinds are nested on their own, so they never multiply each other; an array is
    empty where its kind has no more children. The shape is the same for parents of any size.
    """
    pages = None
    for out, rows in children.items():
        own = child_pages(rows, fk, out, size)
        pages = own if pages is None else pages.join(own, [fk, "page"], "full_outer")
    if pages is None:
        return parents.withColumn("page", F.lit(0))
    # Page 0 is there for parents whose first page no kind fills.
    placed = parents.join(pages.withColumnRenamed(fk, "_fk"), F.col("id") == F.col("_fk"), "left").drop("_fk")
    arrays = {out: F.coalesce(F.col(out), F.array().cast(pages.schema[out].dataType)) for out in children}
    return placed.withColumns({"page": F.coalesce("page", F.lit(0)), **arrays})


def with_children(launches: DataFrame, sources: DataFrame, conflicts: DataFrame, size: int = PAGE) -> DataFrame:
    """Launches with pages of both child lists."""
    return nest(launches, {"sources": sources, "conflicts": conflicts}, "launch_id", size)


def detail(launches: DataFrame, sources: DataFrame, slug: str) -> DataFrame:
    """One launch by slug with its sources. The filter reaches both scans before the join."""
    one = launches.filter(F.col("slug") == slug)
    theirs = sources.join(one.select(F.col("id").alias("launch_id")), "launch_id", "left_semi")
    return nest(one, {"sources": theirs}, "launch_id")


def sources_of(sources: DataFrame, launch_id: int) -> DataFrame:
    return sources.filter(F.col("launch_id") == launch_id).orderBy(
        _newest("data_quality_score"), _newest("scraped_at"), "id"
    )


def sources_by_name(sources: DataFrame, name: str, limit: int = 100) -> DataFrame:
    return sources.filter(F.col("source_name") == name).orderBy(_newest("scraped_at"), "id").limit(limit)


def recent_sources(sources: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return sources.filter(F.col("scraped_at") >= hours_before(as_of, hours)).orderBy(_newest("scraped_at"), "id")


def with_launch(children: DataFrame, launches: DataFrame, how: str = "left") -> DataFrame:
    """Child rows with slug and name of their launch."""
    parent = launches.select(F.col("id").alias("launch_id"), "slug", "mission_name")
    return children.join(parent, "launch_id", how)


def stale_sources(sources: DataFrame, launches: DataFrame, as_of: Column, hours: int = 48) -> DataFrame:
    old = sources.filter(F.col("scraped_at") < hours_before(as_of, hours))
    return with_launch(old, launches).orderBy("scraped_at", "id")


def conflicts_of(conflicts: DataFrame, launch_id: int, resolved: bool | None = None) -> DataFrame:
    return _resolved(conflicts.filter(F.col("launch_id") == launch_id), resolved).orderBy(_newest("created_at"), "id")


def _resolved(conflicts: DataFrame, resolved: bool | None) -> DataFrame:
    return conflicts if resolved is None else conflicts.filter(F.col("resolved") == F.lit(resolved))


def unresolved(conflicts: DataFrame, limit: int = 100) -> DataFrame:
    return _resolved(conflicts, False).orderBy(_newest("created_at"), "id").limit(limit)


def conflicts_by_field(conflicts: DataFrame, launches: DataFrame, field_name: str, resolved: bool | None = None) -> DataFrame:
    found = _resolved(conflicts.filter(F.col("field_name") == field_name), resolved)
    return with_launch(found, launches).orderBy(_newest("created_at"), "id")


def high_confidence(
    conflicts: DataFrame, launches: DataFrame, minimum: float = 0.8, resolved: bool | None = None
) -> DataFrame:
    found = _resolved(conflicts.filter(F.col("confidence_score") >= minimum), resolved)
    return with_launch(found, launches).orderBy(_newest("confidence_score"), "id")


def review_list(conflicts: DataFrame, launches: DataFrame, resolved: bool = False) -> DataFrame:
    rows = with_launch(_resolved(conflicts, resolved), launches)
    return rows.withColumn("confidence_score", F.coalesce(F.col("confidence_score").cast("double"), F.lit(0.0)))


def recent_launches(launches: DataFrame, as_of: Column, days: int = 30, limit: int = 20) -> DataFrame:
    return (
        launches.filter(F.col("launch_date") > days_before(as_of, days)).orderBy(_newest("launch_date"), "id").limit(limit)
    )


def vehicle_types(launches: DataFrame) -> DataFrame:
    return launches.select("vehicle_type").filter(F.col("vehicle_type") != "").distinct().orderBy("vehicle_type")


def with_open_conflicts(launches: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Launches that have an unresolved conflict, each once."""
    return launches.join(
        _resolved(conflicts, False).select("launch_id"), F.col("id") == F.col("launch_id"), "left_semi"
    )
