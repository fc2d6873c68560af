"""Registered queries: extraction from pages and from text derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recfuse.operators import documents as DO
from recfuse.operators import extract as E
from recfuse.operators import pages as PG
from recfuse.registry.base import query, spread, table
from recfuse.registry.serving import AS_OF, T
from recfuse.sources import html as H


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _pages(spark, sf):
    return H.parse_pages(spread(table(spark, sf, "pages")))


def _plain(html: str) -> str:
    """SQL for the text of a fragment: tags out with the space around them, entities decoded."""
    bare = rf"trim(regexp_replace({html}, '\s*<[^>]*>\s*', '', 'g'))"
    for entity, char in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        bare = f"replace({bare}, '{entity}', '{char}')"
    return bare


@query(
    "page_list_items",
    "S3 X1 X7",
    f"""WITH i AS (SELECT page_id, unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) AS h FROM pages)
    SELECT page_id, t AS text, count(*) AS n FROM (SELECT page_id, {_plain('h')} AS t FROM i) GROUP BY ALL""",
)
def page_list_items(spark, sf):
    items = PG.elements(_pages(spark, sf), H.tagged("li"))
    return items.groupBy("page_id", "text").agg(F.count("*").alias("n"))


@query(
    "page_titles",
    "X9 X10",
    rf"""WITH h AS (SELECT page_id, {_plain("regexp_extract(html, '<h1>(.*?)</h1>', 1)")} AS t FROM pages),
      c AS (SELECT page_id, regexp_replace(regexp_replace(t, '^(NASA|Press Release|News):\s*', '', 'i'), '\s*-\s*NASA$', '', 'i') AS t FROM h WHERE length(t) > 5)
    SELECT page_id, trim(t) AS title FROM c WHERE length(t) > 5
        AND NOT (length(t) < 30 AND regexp_matches(lower(t), 'nasa|press release|news|update|statement'))""",
)
def page_titles(spark, sf):
    heads = PG.elements(_pages(spark, sf), H.tagged("h1")).filter(F.length("text") > 5)
    return heads.select("page_id", E.clean_title("text").alias("title")).filter("title IS NOT NULL")


@query(
    "page_links",
    "X17",
    """WITH a AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) AS site,
        unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages)
    SELECT page_id, CASE WHEN h LIKE '/%' THEN site || h ELSE h END AS link, count(*) AS n FROM a GROUP BY ALL""",
)
def page_links(spark, sf):
    links = PG.elements(_pages(spark, sf), H.tagged("a")).filter("href IS NOT NULL")
    link = E.absolute(F.col("href"), E.site_of("url"))
    return links.groupBy("page_id", link.alias("link")).agg(F.count("*").alias("n"))


@query(
    "page_strategy",
    "S3 X2",
    """SELECT page_id, CASE WHEN contains(url, 'search') THEN 3 ELSE 0 END AS strategy,
        len(regexp_extract_all(html, '<article>')) AS items FROM pages""",
)
def page_strategy(spark, sf):
    pages = _pages(spark, sf)
    is_search = F.contains("url", F.lit("search"))
    (so, se), (no, ne) = PG.first_non_empty(PG.SEARCH_SELECTORS), PG.first_non_empty(PG.NEWS_SELECTORS)
    return pages.select(
        "page_id", F.when(is_search, so).otherwise(no).alias("strategy"),
        F.size(F.when(is_search, se).otherwise(ne)).cast("bigint").alias("items"),
    )


@query(
    "news_page_records",
    "X2 X9 X10 X14 X16 X18",
    rf"""WITH a AS (SELECT page_id, url, {_plain("regexp_extract(html, '(?s)<article>(.*)</article>', 1)")} AS t,
          {_plain("regexp_extract(html, '<h1>(.*?)</h1>', 1)")} AS h FROM pages),
      c AS (SELECT *, trim(regexp_replace(regexp_replace(h, '^(NASA|Press Release|News):\s*', '', 'i'), '\s*-\s*NASA$', '', 'i')) AS name
          FROM a WHERE length(t) >= 20 AND length(h) > 5)
    SELECT page_id, name AS mission_name, CASE WHEN regexp_matches(lower(t), 'successful|success|completed|landed') THEN 'success'
        WHEN regexp_matches(lower(t), 'failed|failure|unsuccessful|lost') THEN 'failure'
        WHEN regexp_matches(lower(t), 'abort|cancelled|scrub|delayed') THEN 'aborted' ELSE 'upcoming' END AS status
    FROM c WHERE length(name) > 5 AND NOT (length(name) < 30 AND regexp_matches(lower(name), 'nasa|press release|news|update|statement'))
        AND regexp_matches(lower(t), 'the|der|les|que') AND regexp_matches(lower(name), 'a|e')""",
)
def news_page_records(spark, sf):
    found = PG.news_records(_pages(spark, sf), _as_of(), keywords=["a", "e"], mention_keywords=["the", "der", "les", "que"])
    # The name alone decides relevance here, as in the SQL.
    return found.filter(F.lower("mission_name").rlike("a|e")).select("page_id", "mission_name", "status")


# Pages built from orders: one record card, one record table, or one text sheet per order.
_CARD = """concat('<div><article class="launch-card"><h2>Order ', o_orderkey, '</h2>',
    CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('<time datetime="', date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss'Z'"), '">day</time>') END,
    '<p class="vehicle">', CASE o_orderkey % 3 WHEN 0 THEN 'FALCON  9' WHEN 1 THEN 'Falcon Heavy' ELSE 'Barge' END, '</p>',
    '<p class="description">Customer ', o_custkey, ' ordered &amp; waits for goods worth ', CAST(o_totalprice AS STRING), '</p>',
    '<img src="/img/', o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '-patch' ELSE '' END, '.png">',
    CASE WHEN o_orderkey % 5 = 0 THEN '<img src="/img/other.png">' ELSE '' END,
    '<a href="/w/', o_orderkey, '">', CASE WHEN o_orderkey % 2 = 0 THEN 'Watch' ELSE 'More' END, '</a>',
    '<a href="https://youtu.be/', o_orderkey, '">video</a><span>', CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'Planned' ELSE '' END,
    '</span></article></div>')"""


@query(
    "order_card_records",
    "X1 X2 X3 X11 X12 X14 X16 X17",
    f"""WITH o AS (SELECT *, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS d FROM orders)
    SELECT o_orderkey AS page_id, 'order-' || o_orderkey AS slug, 'Order ' || o_orderkey AS mission_name, d AS launch_date,
      CASE o_orderkey % 3 WHEN 0 THEN 'FALCON  9' WHEN 1 THEN 'Falcon Heavy' END AS vehicle_type,
      CASE WHEN o_orderstatus = 'F' THEN 'failure' WHEN o_orderstatus = 'O' THEN 'upcoming'
        WHEN d IS NULL OR d > {T} THEN 'upcoming' ELSE 'success' END AS status,
      'Customer ' || o_custkey || ' ordered & waits for goods worth ' || o_totalprice AS details,
      CASE WHEN o_orderkey % 2 = 0 THEN 'https://site.example/img/' || o_orderkey || '-patch.png'
        WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'https://site.example/img/' || o_orderkey || '.png' END AS mission_patch_url,
      CASE WHEN o_orderkey % 2 = 0 THEN 'https://site.example/w/' ELSE 'https://youtu.be/' END || o_orderkey AS webcast_url,
      1 AS strategy FROM o""",
)
def order_card_records(spark, sf):
    pages = spread(table(spark, sf, "orders")).selectExpr("o_orderkey AS page_id", "'https://site.example/launches' AS url", f"{_CARD} AS html")
    rows = PG.card_records(H.parse_pages(pages), _as_of())
    return rows.select(
        "page_id", "slug", "mission_name", F.col("launch_date").cast("timestamp_ntz").alias("launch_date"), "vehicle_type", "status",
        "details", "mission_patch_url", "webcast_url", "strategy",
    )


_TABLE = """concat('<table class="', CASE WHEN o_orderkey % 6 = 0 THEN 'plain' ELSE 'wikitable sortable' END,
    '"><tr><th>Launch date</th><th>Mission</th><th>Rocket</th><th>Payload</th><th>Mass (kg)</th><th>Orbit</th><th>Outcome</th><th>Result note</th></tr>',
    '<tr><td>', date_format(o_orderdate, 'yyyy-MM-dd'), '</td><td>Order ', o_orderkey, '[12]</td><td>', o_orderpriority, '</td><td>x</td><td>',
    format_number(o_totalprice, 2), CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' kg' ELSE ' t' END, '</td><td>LEO  high</td><td>ignored</td><td>',
    CASE o_orderstatus WHEN 'F' THEN 'Lost at sea' WHEN 'O' THEN 'Nominal' ELSE '?' END, '</td></tr><tr><td>short</td></tr></table>')"""


@query(
    "order_table_records",
    "X4 X5 X6 X8 X11 X14 X15",
    f"""SELECT o_orderkey AS page_id, 'Order ' || o_orderkey AS mission_name, o_orderdate AS launch_date, o_orderpriority AS vehicle_type,
      round(CASE WHEN o_orderkey % 3 = 2 THEN 1000 ELSE 1 END * o_totalprice, 3) AS payload_mass, 'LEO high' AS orbit,
      CASE o_orderstatus WHEN 'F' THEN 'failure' WHEN 'O' THEN 'success' ELSE CASE WHEN o_orderdate > {T} THEN 'upcoming' ELSE 'success' END END AS status,
      coalesce(NULL, '') AS details FROM orders WHERE o_orderkey % 6 <> 0""",
)
def order_table_records(spark, sf):
    pages = spread(table(spark, sf, "orders")).selectExpr("o_orderkey AS page_id", "'https://site.example/list' AS url", f"{_TABLE} AS html")
    rows = PG.table_records(H.parse_pages(pages), _as_of())
    return rows.select(
        "page_id", "mission_name", F.col("launch_date").cast("timestamp_ntz").alias("launch_date"), "vehicle_type",
        F.round("payload_mass", 3).alias("payload_mass"), "orbit", "status", F.coalesce("details", F.lit("")).alias("details"),
    )


# The same table above a list that repeats its mission, names another one, and has items that don't count.
_WIKI = f"""concat('<div>', {_TABLE}, '<ul><li>Order ', o_orderkey, ': launch on ', date_format(o_orderdate, 'yyyy-MM-dd'), ' with Falcon 9, ',
    CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'successful' ELSE 'as it seems' END, ' for customer ', o_custkey, '</li><li>tiny</li>',
    '<li>: starts with a colon and is long enough</li><li>Second Order ', o_orderkey, ': Dragon mission, its day is not known to anyone so far</li></ul>',
    '<ul><li>Another list of words that say nothing here</li></ul></div>')"""


@query(
    "order_wiki_records",
    "X4 X7 X12 X14 W3",
    f"""WITH o AS (SELECT *, 'Order ' || o_orderkey || ': launch on ' || strftime(o_orderdate, '%Y-%m-%d') || ' with Falcon 9, '
          || CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'successful' ELSE 'as it seems' END || ' for customer ' || o_custkey AS item,
          CASE WHEN o_orderdate > {T} THEN 'upcoming' ELSE 'success' END AS by_date FROM orders)
    SELECT o_orderkey AS page_id, 'order-' || o_orderkey AS slug, 'Order ' || o_orderkey AS mission_name, o_orderdate AS launch_date,
      CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority ELSE 'Falcon 9' END AS vehicle_type,
      CASE o_orderstatus WHEN 'F' THEN 'failure' WHEN 'O' THEN 'success' ELSE by_date END AS status,
      CASE WHEN o_orderkey % 6 = 0 THEN item END AS details FROM o
    UNION ALL SELECT o_orderkey, 'second-order-' || o_orderkey, 'Second Order ' || o_orderkey, NULL, 'Dragon', 'upcoming',
      'Second Order ' || o_orderkey || ': Dragon mission, its day is not known to anyone so far' FROM o""",
)
def order_wiki_records(spark, sf):
    pages = spread(table(spark, sf, "orders")).selectExpr("o_orderkey AS page_id", "'https://site.example/list' AS url", f"{_WIKI} AS html")
    rows = PG.wiki_records(H.parse_pages(pages), _as_of())
    return rows.select("page_id", "slug", "mission_name", F.col("launch_date").cast("timestamp_ntz").alias("launch_date"), "vehicle_type", "status", F.nullif("details", F.lit("")).alias("details"))


# Cards whose name stands in a heading, in an element named for it, in a pattern, or in the first line.
_NAMES = """concat('<div class="launch-card">', CASE o_orderkey % 6 WHEN 0 THEN concat('<span class="name">Not ', o_orderkey, '</span><h4>Head ', o_orderkey, '</h4>')
    WHEN 1 THEN concat('<b class="the-title">Title ', o_orderkey, '</b><i class="name">Not this</i>') WHEN 2 THEN concat('<b class="name">Name ', o_orderkey, '</b>')
    WHEN 3 THEN concat('<h2>ab</h2><b class="heading">Part ', o_orderkey, '</b>') WHEN 4 THEN concat('<p>It is Starlink-', o_orderkey, '. More words</p>')
    ELSE concat('<p>Plain line ', o_orderkey, '\nand a second one</p>') END, '<p>some words to fill the card</p></div>')"""


@query(
    "card_name_fallbacks",
    "X9 X1",
    """WITH n AS (SELECT o_orderkey AS page_id, CASE o_orderkey % 6 WHEN 0 THEN 'Head ' || o_orderkey WHEN 1 THEN 'Title ' || o_orderkey
        WHEN 2 THEN 'Name ' || o_orderkey WHEN 3 THEN 'Part ' || o_orderkey WHEN 4 THEN 'Starlink-' || o_orderkey ELSE 'Plain line ' || o_orderkey END AS mission_name FROM orders)
    SELECT page_id, mission_name, replace(lower(mission_name), ' ', '-') AS slug FROM n""",
)
def card_name_fallbacks(spark, sf):
    pages = spread(table(spark, sf, "orders")).selectExpr("o_orderkey AS page_id", "'https://site.example/launches' AS url", f"{_NAMES} AS html")
    return PG.card_records(H.parse_pages(pages), _as_of()).select("page_id", "mission_name", "slug")


_KIT = """concat('ANY PRESS KIT\\n\\n  MISSION OVERVIEW \\nMission: Order ', o_orderkey, '\\nLaunch Date: ', date_format(o_orderdate, 'yyyy-MM-dd'),
    '\\nRocket: falcon', CASE WHEN o_orderkey % 2 = 0 THEN ' 9 B5' ELSE ' heavy' END, '\\nPayload: goods of ', o_custkey, '\\nPayload Mass: ',
    format_number(o_totalprice, 0), ' kg\\nTarget Orbit: LEO\\n\\nLAUNCH DETAILS\\n', repeat('Nothing labelled here. ', 6))"""


@query(
    "order_kit_records",
    "S4 X13 X15 X19 X20 X21 F8",
    f"""SELECT o_orderkey AS doc_id, 'press_kit' AS format, 'order-' || o_orderkey AS slug, o_orderdate AS launch_date,
      CASE WHEN o_orderkey % 2 = 0 THEN 'Falcon 9' ELSE 'Falcon Heavy' END AS vehicle_type, round_even(o_totalprice, 0) AS payload_mass, 'LEO' AS orbit,
      CASE WHEN o_orderdate < {T} THEN 'success' ELSE 'upcoming' END AS status, 'Payload: goods of ' || o_custkey || '; Orbit: LEO' AS details FROM orders""",
)
def order_kit_records(spark, sf):
    docs = spread(table(spark, sf, "orders")).selectExpr("o_orderkey AS doc_id", f"{_KIT} AS text")
    rows = DO.document_records(docs, _as_of())
    return rows.select(
        "doc_id", "format", "slug", F.col("launch_date").cast("timestamp_ntz").alias("launch_date"), "vehicle_type", "payload_mass",
        "orbit", "status", "details",
    )


@query(
    "document_sections",
    "S4 X19",
    r"""WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents)
    SELECT doc_id, count(*) AS sections, CAST(sum(length(trim(t))) AS BIGINT) AS chars FROM d WHERE length(trim(t)) > 100 GROUP BY doc_id""",
)
def document_sections(spark, sf):
    # Every line break of a document becomes a page mark, so that its lines are its sections.
    marked = spread(table(spark, sf, "documents")).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n--- Page 1 ---\n")).alias("text"))
    return DO.sections(marked).groupBy("doc_id").agg(F.count("*").alias("sections"), F.sum(F.length("section")).alias("chars"))


_MENTIONS = [r"(licensed[\s\-]*[a-z]*)", r"(token[\s\-]*[a-z]*)", r"(th[aeiou]n[\s\-]*\d*)"]


@query(
    "document_mentions",
    "X22 U2",
    r"""WITH m AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '(?i)(licensed[\s\-]*[a-z]*)', 1),
        regexp_extract_all(text, '(?i)(token[\s\-]*[a-z]*)', 1), regexp_extract_all(text, '(?i)(th[aeiou]n[\s\-]*\d*)', 1))) AS m FROM documents)
    SELECT DISTINCT doc_id, regexp_replace(m, '^\s+|\s+$', '', 'g') AS mission_name FROM m""",
)
def document_mentions(spark, sf):
    return DO.mentions(spread(table(spark, sf, "documents")), patterns=_MENTIONS).select("doc_id", "mission_name")


@query(
    "parsed_masses",
    "X15",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, CASE l_linenumber % 4 WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity * 1000.0::DOUBLE
        WHEN 2 THEN round_even(l_extendedprice, 0) END AS kg FROM lineitem""",
)
def parsed_masses(spark, sf):
    text = F.expr(
        """CASE l_linenumber % 4 WHEN 0 THEN concat('about ', CAST(l_quantity AS STRING), 'kg or 1 t') WHEN 1 THEN concat(CAST(l_quantity AS STRING), ' tonnes')
        WHEN 2 THEN concat('mass ', format_number(l_extendedprice, 0), ' KG') ELSE 'unknown' END"""
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", E.mass_kg(text).alias("kg"))


@query(
    "relevant_documents",
    "X18",
    "SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed') OR contains(lower(text), 'token')",
)
def relevant_documents(spark, sf):
    from recfuse.functions.text import contains_any

    return table(spark, sf, "documents").filter(contains_any("text", ["licensed", "token"])).select("doc_id")
