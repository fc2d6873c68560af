"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Words are stretches without ASCII white space. Counts are taken once per text (``measured``); each
rule compares integers, ``100 * part`` with ``limit * whole``. A text is rejected by the base rules
(``base_failed``) or by any rule of the table.

Null and empty texts have no words and are rejected (``n_words < 10``). Long texts stay in one row;
the work is linear but for two sorts of word windows. Repeated rows are judged alike. Columns other
than doc_id and text are ignored by ``measured`` and kept by ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recfuse.functions.pin import pin
from recfuse.llm.common import texts

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
CAPITALS = "[A-Z]"
WINDOW = 5
STOP_WORDS = (
    "the of and to in is that for with was on at by "
    "le la les de des du et un une que qui dans pour "
    "der die das und ist von mit den zu ein eine nicht "
    "el los las una por con para del se su"
).split()


@dataclass(frozen=True)
class Rule:
    """Rejects a text unless low * whole <= 100 * part <= high * whole."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None

    def passes(self) -> list[str]:
        out = [] if self.low is None else [f"100 * {self.part} >= {self.low} * {self.whole}"]
        return out + ([] if self.high is None else [f"100 * {self.part} <= {self.high} * {self.whole}"])


RULES = (
    Rule("mean word length", "word_chars", "n_words", 200, 1500),
    Rule("symbols to words", "n_symbols", "n_words", None, 10),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 40),
    Rule("capitals to word characters", "n_capitals", "word_chars", None, 40),
    # The first 40 words are free: a short text may have none.
    Rule("stop words to words", "n_stop_words", "(n_words - 40)", 1, None),
    Rule("lines that trail off", "n_trailing_lines", "n_lines", None, 40),
    Rule("bulleted lines", "n_bullet_lines", "n_lines", None, 90),
)
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def verdict(rules: tuple[Rule, ...] = RULES) -> str:
    """The table as one SQL condition over the counts."""
    return " AND ".join([f"NOT ({BASE_FAILED})", *(c for r in rules for c in r.passes())])


def _repeats(hashes: str) -> list[tuple[str, Column]]:
    """Columns, each over the one before: windows, windows in order, their repeated places, words covered."""
    firsts = F.slice(hashes, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0)))
    windows = F.transform(firsts, lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, WINDOW))))
    ordered = F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("i")))),
    ).otherwise(F.array().cast("array<struct<w:bigint,i:bigint>>"))
    same = lambda e, k: F.coalesce(F.get("_ordered", k)["w"] == e["w"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("_ordered", lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("last"))
    covered = F.aggregate(
        "_places",
        start,
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW).cast("long"), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return [("_windows", windows), ("_ordered", ordered), ("_places", places), ("n_repeat_words", covered)]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text."""
    out = texts(docs).select(
        "doc_id",
        "text",
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("_words"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    out = out.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(CAPITALS)).cast("long").alias("n_capitals"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_trailing_lines"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]\x20"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    for name, column in _repeats("_hashes"):
        out = out.withColumn(name, column)
    return out.drop("_hashes", "_windows", "_ordered", "_places")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts, base_failed, kept. The counts are pinned: a filter on what follows them can't evaluate them again."""
    found = measured(docs)
    pinned = found.select("doc_id", F.explode(F.array(F.struct([c for c in found.columns if c != "doc_id"]))).alias("_counts"))
    out = pinned.select("doc_id", "_counts.*")
    return out.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", F.expr(verdict(rules)))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns. One pass, without a join."""
    row = docs.select(F.struct("*").alias("_row"), "text")
    found = measured(row.select(F.col("_row").alias("doc_id"), "text"))
    return pin(found, "_kept", F.expr(verdict(rules))).where("_kept").select("doc_id.*").select(docs.columns)
