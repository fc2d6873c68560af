"""Extraction from page and document literals."""

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recfuse.operators import documents as DO
from recfuse.operators import extract as E
from recfuse.operators import pages as PG
from recfuse.sources import html as H
from recfuse.sources.html import parse_pages

AS_OF = dt.datetime(2024, 6, 1)

def card(heading: str, *parts: str) -> str:
    return f'<section class="launch-card"><header>{heading}</header>{"".join(parts)}</section>'


# Pages are put together from the rules they try: a heading, a time, a vehicle, a long paragraph, an image, a link.
CARDS = "<main>" + "".join(
    [
        card("<h4>Tern Mapper 2</h4>", "<p>Flown on Falcon Heavy from the north pad.</p>", '<time datetime="2023-11-02T04:05:00Z">2 Nov</time>', "<b>Success</b>"),
        card("<h2>Gull Courier 9</h2>", '<p class="description">Carries mail, seeds and two small telescopes to a polar path.</p>', '<time datetime="2025-02-03T00:00:00Z">soon</time>'),
        card("<h3>Auk Beacon</h3>", '<a href="https://youtube.com/watch?v=auk">Stream</a>', '<img src="art/auk.png">', '<time datetime="2022-08-09T01:00:00Z">9 Aug</time>', "<p>Starship test</p>"),
        card("<h2>Skua Relay</h2>", "<span>Failure</span>", '<time datetime="2021-04-01T12:00:00Z">1 Apr</time>'),
    ]
) + "</main>"


def table(head: list[str], *rows: list[str]) -> str:
    line = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"
    return '<table class="wikitable">' + line("th", head) + "".join(line("td", r) for r in rows) + "</table>"


TABLE = table(
    ["Mission", "Launch date", "Rocket", "Orbit", "Mass", "Outcome"],
    ["Tern Mapper 2[12]", "2023-11-02", "Falcon Heavy", "SSO", "4,250 kg", "Success"],
    ["Skua Relay", "2021-04-01", "Falcon 1", "LEO", "180", "Failure"],
    ["Gull Courier 9", "2025-02-03", "Starship", "Polar", "21.5 t", "Planned"],
    ["alone"],
) + "<ol><li>Puffin Glider: a mission of 2020-05-06 that failed with Falcon 9 during ascent</li><li>tiny</li></ol>"

SEARCH = (
    '<ul><li class="search-result"><h3>Press Release: SpaceX Launches the Petrel Weather Mission</h3>'
    '<time datetime="2022-10-11T07:00:00Z">11 Oct</time>'
    "<p>A Falcon 9 rocket carried the Petrel weather spacecraft into orbit for a mission of six years.</p></li>"
    '<li class="search-result"><h3>Gardens of the visitor centre</h3><p>The orchard opens in spring, with plum and pear trees along the river walk.</p></li></ul>'
)

KIT = "\n".join(
    [
        "PRESS KIT",
        "",
        "MISSION OVERVIEW",
        "Target Orbit: Sun-synchronous (SSO)",
        "Payload Mass: 740 kg",
        "Payload: Two radar mappers",
        "Mission: Tern Mapper 3",
        "Vehicle: Falcon 9",
        "Launch Date: 2022-12-24",
        "",
        "LAUNCH DETAILS",
        "Both mappers ride on one adapter and part ways after the second burn, an hour after they left the ground.",
    ]
)
SHEET = "\n".join(["Vehicle: Falcon Heavy", "Mission Name: Gannet Deep Survey", "Payload Mass: 3,100 kg", "Launch Date: 2026-01-31", "Target Orbit: Heliocentric"])
PROSE = "After Crew-11 comes CRS-35 in autumn, and Crew-11 lands before Falcon 9 flies again."


def _pages(spark, *pages):
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    return parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))


def test_cards(spark):
    rows = {r.mission_name: r for r in PG.card_records(_pages(spark, ("https://pads.example/all/", CARDS)), F.lit(AS_OF)).collect()}
    assert set(rows) == {"Tern Mapper 2", "Gull Courier 9", "Auk Beacon", "Skua Relay"}
    assert rows["Tern Mapper 2"].launch_date == dt.datetime(2023, 11, 2, 4, 5)
    assert rows["Tern Mapper 2"].vehicle_type == "Falcon Heavy" and rows["Tern Mapper 2"].status == "success"
    assert rows["Gull Courier 9"].details.startswith("Carries mail") and rows["Gull Courier 9"].status == "upcoming"
    assert rows["Auk Beacon"].webcast_url == "https://youtube.com/watch?v=auk" and rows["Auk Beacon"].vehicle_type == "Starship"
    assert rows["Skua Relay"].status == "failure" and len({r.strategy for r in rows.values()}) == 1


def test_cards_empty(spark):
    assert PG.card_records(_pages(spark, ("https://x.example", "<div>No content</div>")), F.lit(AS_OF)).count() == 0


def test_grid_children(spark):
    html = '<div class="grid"><div><p>a garden wall</p></div><div><h3>Dunlin hop</h3><p>Starship launch</p></div></div>'
    rows = PG.card_records(_pages(spark, ("https://x.example", html)), F.lit(AS_OF)).collect()
    assert [r.mission_name for r in rows] == ["Dunlin hop"]


def test_table_and_list(spark):
    rows = {r.mission_name: r for r in PG.wiki_records(_pages(spark, ("https://w.example/list", TABLE)), F.lit(AS_OF)).collect()}
    assert set(rows) == {"Tern Mapper 2", "Skua Relay", "Gull Courier 9", "Puffin Glider"}
    assert [rows[n].payload_mass for n in ("Tern Mapper 2", "Skua Relay", "Gull Courier 9")] == [4250, 180, 21500]
    assert [rows[n].status for n in ("Tern Mapper 2", "Skua Relay", "Gull Courier 9", "Puffin Glider")] == ["success", "failure", "upcoming", "failure"]
    assert rows["Tern Mapper 2"].orbit == "SSO" and rows["Puffin Glider"].launch_date == dt.datetime(2020, 5, 6)


def test_search_page(spark):
    rows = PG.news_records(_pages(spark, ("https://n.example/search?q=x", SEARCH)), F.lit(AS_OF)).collect()
    assert [r.mission_name for r in rows] == ["SpaceX Launches the Petrel Weather Mission"]
    assert rows[0].launch_date == dt.datetime(2022, 10, 11, 7) and rows[0].strategy == 0


def test_documents(spark):
    docs = spark.createDataFrame([(1, KIT), (2, SHEET), (3, PROSE)], "doc_id long, text string")
    rows = DO.document_records(docs, F.lit(AS_OF)).orderBy("doc_id", "position").collect()
    kit = [r for r in rows if r.doc_id == 1]
    assert [(r.mission_name, r.vehicle_type, r.payload_mass, r.status) for r in kit] == [("Tern Mapper 3", "Falcon 9", 740, "success")]
    assert kit[0].orbit == "Sun-synchronous (SSO)"
    assert kit[0].details == "Payload: Two radar mappers; Orbit: Sun-synchronous (SSO)"
    sheet = DO.document_records(docs, F.lit(AS_OF), formats=["technical"]).filter("doc_id = 2").collect()
    assert sheet[0].vehicle_type == "Falcon Heavy" and sheet[0].payload_mass == 3100
    assert sheet[0].status == "upcoming"
    prose = [r.mission_name for r in rows if r.doc_id == 3]
    assert any("Crew" in n for n in prose) and any("CRS" in n for n in prose) and len(prose) == len(set(prose))


@pytest.mark.parametrize(
    "text,kg", [("9,001 kg", 9001.0), ("0.75 t", 750.0), ("roughly 2,310.25 kg wet", 2310.25), ("unknown", None), ("7 t or 5 kg", 5.0)]
)
def test_mass(spark, text, kg):
    assert spark.range(1).select(E.mass_kg(F.lit(text)).alias("m")).first().m == kg


@pytest.mark.parametrize(
    "title,want",
    [("NASA: Petrels Count the Clouds Again", "Petrels Count the Clouds Again"), ("News update", None), ("Press Release: An orchard beside the pad", "An orchard beside the pad")],
)
def test_title(spark, title, want):
    assert spark.range(1).select(E.clean_title(F.lit(title)).alias("t")).first().t == want


def test_extended_dates(spark):
    row = spark.range(1).select(
        E.first_date(F.lit("from August 19, 2021 onwards")).alias("iso"), E.first_date(F.lit("from August 19, 2021 onwards"), True).alias("ext")
    ).first()
    assert row.iso is None and row.ext == dt.datetime(2021, 8, 19)


def test_pages_come_in_chunks(monkeypatch):
    """A batch of many pages is tokenised a few at a time, with the same rows; it was held as a whole before."""
    pages = [None, "", "<p>a<b>c</b></p>" * 4, "x" * 100, *["<ul><li>one</li></ul>"] * 9]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(len(pages))), "url": ["u"] * len(pages), "html": pages})
    whole = [r for b in H._tokenise(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(H, "CHUNK_CHARS", 50)
    found = list(H._tokenise(iter([batch])))
    assert [r for b in found for r in b.to_pylist()] == whole
    assert [r["page_id"] for r in whole] == list(range(len(pages)))
    assert max(b.num_rows for b in found) <= 3


def test_plain_pages_are_read_without_the_parser(monkeypatch):
    """Pages of ordinary tags need no general parser, which all went through before; the elements are the same."""
    rng = random.Random(2)
    plain = ["<p>", "</p>", '<div class="a b">', "</div>", "<br>", '<A HREF="/q">', "</a>", "a &amp; b ", "\n", "<template>", "</template>", "<!DOCTYPE html>"]
    odd = [*plain, "<br/>", "<!-- c -->", "<script>x<b></script>", "<title>a<b></title>", "<b y=1>", "<", "&lt", "<td", '<a href="x?a=1&amp;b">']
    page = lambda parts: "".join(rng.choice(parts) for _ in range(rng.randrange(12)))

    def read(html):
        rows = []
        return H._Elements(rows).read(html), rows

    pages = [page(plain) for _ in range(300)]
    mixed = [page(odd) for _ in range(1500)]
    with monkeypatch.context() as m:
        m.setattr(H._Elements, "_read_plain", lambda self, html: False)
        want, mixed_want = [read(p) for p in pages], [read(p) for p in mixed]
    assert [read(p) for p in mixed] == mixed_want
    monkeypatch.setattr(H._Elements, "feed", None)
    assert [read(p) for p in pages] == want


def test_plain_pages_are_read_as_by_the_parser(monkeypatch):
    """Random pages of plain and other tags, crossed and open ones: the same elements and texts either way."""
    import random

    from recfuse.sources import html as H

    rng = random.Random(9)
    parts = ["<p>", "</p>", "<DIV class='a'>", '<div Class="a b" data-testid="t">', "</div>", "<br>", '<img src="x" data-src="y">', '<img data-src="y" >', "</img>",
             " a &amp; b ", "\n é ", "x > y", "<template>", "</template>", "<!DOCTYPE html>", "<ul><li>", "</ul>", '<a href="u" href="v">', "</a>", "</p >"]
    rare = ["<!-- c -->", "<script>1 < 2</script>", "<", "a < b", '<i title="a>b">', "<b/>", "<title>t</title>", '<a href="?a&amp;b">', "&lt;"]
    slow = type("Slow", (H._Elements,), {"_read_plain": lambda self, html: False})
    for k in range(400):
        page = "".join(rng.choice(parts if k % 2 or rng.random() < 0.9 else rare) for _ in range(rng.randrange(25)))
        one, two = [["before"]], [["before"]]
        assert H._Elements(one).read(page) == slow(two).read(page), page
        assert one == two, page


def test_wiki_pages_are_tokenised_once(spark):
    """Tables and lists come from one reading of the pages; each had its own before."""
    plan = PG.wiki_records(_pages(spark, ("https://w.example/list", TABLE)), F.lit(AS_OF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
