"""Records from web pages: cards, news items, tables, lists.

Works on the element arrays of ``recfuse.sources.html``. What becomes a row of its own, a card or a
table row, takes along its own subtree, not the page.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recfuse import constants as C
from recfuse.functions import text as X
from recfuse.functions.pin import let, pin
from recfuse.operators import extract as E
from recfuse.operators.rank import first_per_key
from recfuse.sources import html as H

Selector = Callable[[Column], Column]
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def elements(pages: DataFrame, *selectors: Selector) -> DataFrame:
    """Rows (page_id, url, n, tag, href, text) of the elements any selector accepts."""
    hit = lambda e: F.exists(F.array(*[s(e) for s in selectors]), lambda b: b)
    return pages.select("page_id", "url", "text", F.explode(F.filter("els", hit)).alias("e")).select(
        "page_id", "url", F.col("e.n").alias("n"), F.col("e.tag").alias("tag"), F.col("e.href").alias("href"),
        H.text_of(F.col("e")).alias("text"),
    )


def first_non_empty(choices: Sequence[Selector]) -> tuple[Column, Column]:
    """Ordinal and elements of the first selector that finds anything on the page."""
    found = [F.filter("els", s) for s in choices]
    ordinal, chosen = F.lit(None).cast("int"), F.filter("els", lambda e: F.lit(False))
    for i in reversed(range(len(found))):
        some = F.size(found[i]) > 0
        ordinal = F.when(some, F.lit(i)).otherwise(ordinal)
        chosen = F.when(some, found[i]).otherwise(chosen)
    return ordinal, chosen


def _cards(strategies: Sequence[Callable[[], Column]]) -> Column:
    """All strategies' elements in order, each with its strategy ordinal."""

    def numbered(found: Column, ordinal: int) -> Column:
        return F.transform(found, lambda e: F.struct(F.lit(ordinal).alias("strategy"), e.alias("e")))

    return F.concat(*[numbered(s(), i) for i, s in enumerate(strategies)])


def _looks_like_card(e: Column) -> Column:
    return X.contains_any(H.raw_of(e), C.CARD_KEYWORDS)


def _grid_items() -> Column:
    grid = lambda e: H.class_has("grid")(e) | H.class_has("container")(e)
    items = lambda g: F.filter(H.children(g), lambda c: H.tagged("div", "article", "section")(c) & _looks_like_card(c))
    return F.flatten(F.transform(F.filter("els", grid), items))


CARD_STRATEGIES: list[Callable[[], Column]] = [
    lambda: F.filter("els", lambda e: F.coalesce(F.rlike(e["testid"], F.lit("launch|mission")), F.lit(False))),
    lambda: F.filter("els", H.class_is("launch-card")),
    lambda: F.filter("els", H.class_has("launch")),
    lambda: F.filter("els", H.class_has("mission")),
    lambda: F.filter("els", H.class_has("Launch")),
    lambda: F.filter("els", H.class_has("Mission")),
    lambda: F.filter("els", lambda e: H.tagged("article")(e) & _looks_like_card(e)),
    _grid_items,
]


def _first_text(found: Column, longer_than: int) -> Column:
    texts = F.filter(F.transform(found, lambda e: H.text_of(e, H.root())), lambda t: F.length(t) > longer_than)
    return H.first(texts)


def _select_one_text(scope: Column, selector: Selector, longer_than: int) -> Column:
    """Text of the first match of a selector, if long enough; later matches do not count."""
    found = H.text_of(H.first(F.filter(scope, selector)), H.root())
    return let(found, lambda t: F.when(F.length(t) > longer_than, t))


def _first_line(c: Column) -> Column:
    return let(H.first(E.lines(c)), lambda line: F.when(F.length(line).between(5, 100), line))


def _time_or_text(scope: Column, text: Column, extended: bool) -> Column:
    time = H.first(F.filter(scope, H.tagged("time")))
    return F.coalesce(E.instant_attr(time["time"]), E.first_date(text, extended))


def _patch(scope: Column, site: Column) -> Column:
    def choose(images: Column) -> Column:
        urls = F.filter(F.transform(images, lambda i: E.absolute(i["src"], site)), lambda u: F.coalesce(u != "", F.lit(False)))
        likely = H.first(F.filter(urls, lambda u: X.contains_any(u, C.IMAGE_KEYWORDS)))
        return F.coalesce(likely, F.when(F.size(images) == 1, H.first(urls)))

    return let(F.filter(scope, H.tagged("img")), choose)


def _webcast(scope: Column, site: Column) -> Column:
    links = F.filter(scope, lambda a: H.tagged("a")(a) & F.coalesce(a["href"] != "", F.lit(False)))
    hosts = "|".join(h.replace(".", r"\.") for h in C.VIDEO_HOSTS)
    by_text = lambda a: X.contains_any(H.raw_of(a, H.root()), C.WEBCAST_KEYWORDS)
    hit = H.first(F.filter(links, lambda a: by_text(a) | F.rlike(a["href"], F.lit(hosts))))
    return let(hit, lambda a: F.when(by_text(a), E.absolute(a["href"], site)).otherwise(a["href"]))


def _record(df: DataFrame, fields: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    """Evaluate the name first, then the other fields for rows that have one; the date once, as the status asks for it too."""
    named = pin(df, "mission_name", fields["mission_name"]).filter(F.col("mission_name").isNotNull())
    named = pin(named, "launch_date", fields["launch_date"])
    for name, c in fields.items():
        named = named if name in ("mission_name", "launch_date") else named.withColumn(name, c)
    return named.select(*keep)


RECORD = [
    "page_id", "url", "slug", "mission_name", "launch_date", "vehicle_type", "payload_mass", "orbit", "status", "details",
    "mission_patch_url", "webcast_url", "strategy", "position",
]


def card_records(pages: DataFrame, as_of: Column, extended_dates: bool = False) -> DataFrame:
    """Cards found by any strategy; the first card of each slug on a page is kept."""
    own = lambda c: F.struct(c["strategy"].alias("strategy"), c["e"]["n"].alias("position"), H.subtree(c["e"]).alias("page"))
    cards = pages.select("page_id", "url", F.explode(F.transform(_cards(CARD_STRATEGIES), own)).alias("c"))
    cards = cards.select("page_id", "url", "c.strategy", "c.position", "c.page.*")
    e, t = H.root(), F.col("card_text")
    scope = H.inside(e, e)
    site = E.site_of("url")
    name = F.coalesce(
        _first_text(F.filter(scope, H.tagged(*HEADINGS)), 3),
        *[_select_one_text(scope, H.class_has(p), 3) for p in ("title", "name", "mission", "heading")],
        X.strip(X.first_match(t, C.MISSION_PATTERNS["card"], flags=E.FLAGS)),
        _first_line(t),
    )
    details = F.coalesce(
        *[
            F.substring(_select_one_text(scope, s, 20), 1, 500)
            for s in (H.class_has("description"), H.class_has("detail"), H.class_has("summary"), H.tagged("p"))
        ],
        E.middle_lines(t),
    )
    found = pin(cards, "card_text", H.text_of(e, e)).filter(F.length("card_text") >= 10)
    rows = _record(
        found,
        {
            "mission_name": name,
            "slug": X.page_slug("mission_name"),
            "launch_date": _time_or_text(scope, t, extended_dates),
            "vehicle_type": E.vehicle(t, "card"),
            "payload_mass": F.lit(None).cast("double"),
            "orbit": F.lit(None).cast("string"),
            "status": E.status(t, "card", F.col("launch_date"), as_of),
            "details": details,
            "mission_patch_url": _patch(scope, site),
            "webcast_url": _webcast(scope, site),
            "strategy": F.col("strategy"),
            "position": F.col("position"),
        },
        RECORD,
    )
    return first_per_key(rows, ["page_id", "slug"], [F.col("strategy"), F.col("position")])


SEARCH_SELECTORS: list[Selector] = [
    H.class_is("search-result"), H.class_is("result-item"), H.class_has("search"), H.tagged("article"), H.class_is("news-item"),
]
NEWS_SELECTORS: list[Selector] = [
    H.tagged("article"), H.class_is("news-item"), H.class_is("press-release"), H.class_has("news"), H.class_has("release"),
]


def news_records(
    pages: DataFrame, as_of: Column, extended_dates: bool = False, keywords: Sequence[str] = tuple(C.NEWS_RECORD_KEYWORDS),
    mention_keywords: Sequence[str] = tuple(C.NEWS_MENTION_KEYWORDS),
) -> DataFrame:
    """Records from search and news pages that concern the subject named by the keywords."""
    is_search = F.contains("url", F.lit("search"))
    so, se = first_non_empty(SEARCH_SELECTORS)
    no, ne = first_non_empty(NEWS_SELECTORS)
    mentioned = F.filter(ne, lambda e: X.contains_any(H.raw_of(e), list(mention_keywords)))
    own = lambda e: F.struct(e["n"].alias("position"), H.subtree(e).alias("page"))
    items = pages.select(
        "page_id", "url",
        F.when(is_search, so).otherwise(no).alias("strategy"),
        F.explode(F.transform(F.when(is_search, se).otherwise(mentioned), own)).alias("i"),
    ).select("page_id", "url", "strategy", "i.position", "i.page.*")
    e, t = H.root(), F.col("item_text")
    scope = H.inside(e, e)
    titles = lambda found: H.first(
        F.filter(
            F.transform(F.filter(F.transform(found, lambda d: H.text_of(d, e)), lambda s: F.length(s) > 5), E.clean_title),
            lambda s: F.coalesce(s != "", F.lit(False)),
        )
    )
    title_link = lambda a: H.tagged("a")(a) & F.coalesce(F.rlike(a["cls"], F.lit("title|headline")), F.lit(False))
    name = F.coalesce(
        titles(F.filter(scope, H.tagged(*HEADINGS))),
        titles(F.filter(scope, title_link)),
        X.strip(X.first_match(t, C.MISSION_PATTERNS["news"], flags=E.FLAGS)),
    )
    details = F.coalesce(F.substring(_first_text(F.filter(scope, H.tagged("p")), 50), 1, 500), E.first_sentences(t))
    found = pin(items, "item_text", H.text_of(e, e)).filter(F.length("item_text") >= 20)
    rows = _record(
        found,
        {
            "mission_name": name,
            "slug": X.page_slug("mission_name", "nasa-mission"),
            "launch_date": _time_or_text(scope, t, extended_dates),
            "vehicle_type": E.vehicle(t, "news"),
            "payload_mass": F.lit(None).cast("double"),
            "orbit": F.lit(None).cast("string"),
            "status": E.status(t, "news", F.col("launch_date"), as_of),
            "details": details,
            "mission_patch_url": F.lit(None).cast("string"),
            "webcast_url": F.lit(None).cast("string"),
            "position": F.col("position"),
        },
        RECORD,
    )
    about = F.concat("mission_name", F.lit(" "), F.coalesce("details", F.lit("")))
    return rows.filter(X.contains_any(about, list(keywords)))


TABLES, LISTS = 0, 1


def _tables() -> Column:
    """Record-like tables of a page, each with its own subtree."""
    is_table = lambda e: H.tagged("table")(e) & (H.class_is("wikitable")(e) | H.class_is("sortable")(e))
    own = lambda e, i: F.struct(F.lit(TABLES).alias("kind"), i.alias("no"), H.subtree(e).alias("page"))
    return F.transform(F.filter("els", is_table), own)


def _items(keywords: Sequence[str]) -> Column:
    """Items of the lists that mention a keyword; of an item, only its text counts."""
    lists = F.filter("els", lambda e: H.tagged("ul", "ol")(e) & X.contains_any(H.raw_of(e), list(keywords)))
    items = F.flatten(F.transform(lists, lambda e: F.filter(H.inside(e), H.tagged("li"))))
    text = lambda e: F.struct(F.lit("").alias("raw"), H.text_of(e).alias("text"), F.slice("els", 1, 0).alias("els"))
    return F.transform(items, lambda e: F.struct(F.lit(LISTS).alias("kind"), e["n"].alias("no"), text(e).alias("page")))


def _rows(pages: DataFrame, *scopes: Column) -> DataFrame:
    """Rows of the tables and lists: (page_id, url, kind, no, row_no, roles, cells, item_text); a list item is one row."""
    listed = F.col("kind") == LISTS
    found = pages.select("page_id", "url", F.explode(F.concat(*scopes)).alias("s")).select("page_id", "url", "s.kind", "s.no", "s.page.*")
    t = H.root()
    item = (F.length("text") >= 20) & ~F.col("text").startswith(":")
    likely = found.filter(F.when(listed, item).otherwise(E.indicator_count(F.col("raw")) >= 3))
    likely = likely.withColumn("trs", F.filter(H.inside(t, t), H.tagged("tr")))
    cells = lambda r, *tags: F.filter(H.inside(r, t), H.tagged(*tags))
    headed = likely.withColumn("heads", F.transform(cells(H.first(F.col("trs")), "th", "td"), lambda h: E.header_role(H.text_of(h, t))))
    named = F.filter(
        F.transform("heads", lambda role, i: F.struct(role.alias("role"), i.alias("at"))), lambda s: s["role"].isNotNull()
    )
    # Keep the last position of each role before building the map.
    last_of = lambda all_, s: ~F.exists(all_, lambda o: (o["role"] == s["role"]) & (o["at"] > s["at"]))
    roled = headed.withColumn("named", named).withColumn(
        "roles", F.map_from_entries(F.filter("named", lambda s: last_of(F.col("named"), s)))
    )
    below = F.slice("trs", F.lit(2), F.greatest(F.size("trs") - 1, F.lit(0)))
    own = lambda r: F.struct(H.text_of(r, t).alias("text"), r["s0"].alias("s0"), cells(r, "td", "th").alias("els"))
    one = F.array(F.struct(F.col("text"), F.lit(0).alias("s0"), F.col("els")))
    rows = roled.filter(listed | (F.size("named") > 0)).select(
        "page_id", "url", "kind", "no", "roles", F.posexplode(F.when(listed, one).otherwise(F.transform(below, own))).alias("row_no", "r")
    )
    rows = rows.select("page_id", "url", "kind", "no", "roles", "row_no", "r.*")
    texts = F.transform("els", lambda c: E.cell_text(F.substring("text", c["s0"] - F.col("s0") + 1, c["sn"])))
    return (
        pin(rows, "cells", texts)
        .filter(listed | (F.size("cells") >= F.array_max(F.map_values("roles")) + 1))
        .select("page_id", "url", "kind", "no", "row_no", "roles", "cells", F.col("text").alias("item_text"))
    )


def table_rows(pages: DataFrame) -> DataFrame:
    """Rows of record-like tables: (page_id, url, table_no, row_no, cells, roles).

    ``roles`` maps a column role to its position; the later of two columns with one role wins.
    Rows with fewer cells than the last role's column are dropped.
    """
    return _rows(pages, _tables()).select("page_id", "url", F.col("no").alias("table_no"), "row_no", "roles", "cells")


def _table_fields(as_of: Column, extended_dates: bool) -> dict[str, Column]:
    def cell(role: str) -> Column:
        at = F.try_element_at("roles", F.lit(role))
        return F.when(at.isNotNull(), F.get("cells", at))

    has_outcome = F.map_contains_key("roles", F.lit("outcome"))
    date = E.first_date(cell("date"), extended_dates, bounded=False)
    outcome = cell("outcome")
    state = F.when(outcome.isNull(), E.status_from_date(F.col("launch_date"), as_of)).otherwise(
        E.status(outcome, "table", F.col("launch_date"), as_of)
    )
    return {
        "mission_name": cell("mission"),
        "slug": X.page_slug("mission_name", "wiki-mission"),
        "launch_date": date,
        "vehicle_type": cell("vehicle"),
        "payload_mass": E.mass_kg(cell("mass"), unitless_is_kg=True),
        "orbit": cell("orbit"),
        "status": F.when(has_outcome, state).otherwise("upcoming"),
        "details": cell("payload"),
        "mission_patch_url": F.lit(None).cast("string"),
        "webcast_url": F.lit(None).cast("string"),
        "strategy": F.col("no"),
        "position": F.col("row_no"),
    }


def _list_fields(as_of: Column, extended_dates: bool) -> dict[str, Column]:
    t = F.col("item_text")
    return {
        "mission_name": X.strip(F.substring_index(t, ":", 1)),
        "slug": X.page_slug("mission_name", "wiki-mission"),
        "launch_date": E.first_date(t, extended_dates, bounded=False),
        "vehicle_type": E.vehicle(t, "list"),
        "payload_mass": F.lit(None).cast("double"),
        "orbit": F.lit(None).cast("string"),
        "status": E.status(t, "list", F.col("launch_date"), as_of),
        "details": F.when(F.length(t) > 50, F.substring(t, 1, 500)),
        "mission_patch_url": F.lit(None).cast("string"),
        "webcast_url": F.lit(None).cast("string"),
        "strategy": F.lit(0),
        "position": F.col("no"),
    }


def table_records(pages: DataFrame, as_of: Column, extended_dates: bool = False) -> DataFrame:
    return _record(_rows(pages, _tables()), _table_fields(as_of, extended_dates), RECORD)


def list_records(pages: DataFrame, as_of: Column, keywords: Sequence[str] = tuple(C.LIST_KEYWORDS), extended_dates: bool = False) -> DataFrame:
    """Records from items of lists that mention a keyword; the name is the text before the colon."""
    return _record(_rows(pages, _items(keywords)), _list_fields(as_of, extended_dates), RECORD)


def wiki_records(pages: DataFrame, as_of: Column, extended_dates: bool = False) -> DataFrame:
    """Table and list records of a page, read once; the first of each slug is kept, tables before lists."""
    rows = _rows(pages, _tables(), _items(C.LIST_KEYWORDS))
    table, listed = _table_fields(as_of, extended_dates), _list_fields(as_of, extended_dates)
    either = {name: F.when(F.col("kind") == TABLES, c).otherwise(listed[name]) for name, c in table.items()}
    both = _record(rows, either, [*RECORD, "kind"])
    return first_per_key(both, ["page_id", "slug"], [F.col("kind"), F.col("strategy"), F.col("position")]).drop("kind")
