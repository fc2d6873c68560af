"""The queries of this subpackage over the given tables, and their SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recfuse.llm import bpe, clusters, manifest, ngram_join, orc_tokens, packing, quality_model, quality_rules, secrets, suffix_dedup, syncmers, toxicity, transducer


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.written_digests(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_OP5 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5),
windows AS (SELECT doc_id, i, words[i:i+4] AS five FROM starts),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, five) >= 2),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
    length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '{quality_rules.SYMBOLS}'))::BIGINT AS n_symbols,
    len(regexp_extract_all(text, '{quality_rules.CAPITALS}'))::BIGINT AS n_capitals,
    len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_trailing_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]\x20')))::BIGINT AS n_bullet_lines,
    len(list_filter(words, lambda x: list_contains({quality_rules.STOP_WORDS}, lower(x))))::BIGINT AS n_stop_words,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  ({quality_rules.BASE_FAILED}) AS base_failed, ({quality_rules.verdict()}) AS kept
FROM counts
"""


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(documents(spark, sf_dir))


_OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN words ELSE words[i:i+4] END AS five
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.five = b.five AND a.doc_id <> b.doc_id
    JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(seen) FROM reach WHERE node = w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""


def op7_packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compared(documents(spark, sf_dir))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(documents(spark, sf_dir))


def op11_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _op11() -> str:
    """Rounds of assignment (a) and new centroids (c); whole numbers below 2**53 are exact in doubles."""
    size = clusters.SIZE
    distance = "list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, c.x) + list_dot_product(c.x, c.x)"
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({clusters.SCALE} * e::DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {size})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{clusters.SEED}:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS k, x FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('{clusters.SEED}:' || coalesce(vec_id::VARCHAR, '')), x) <= {clusters.CLUSTERS})""",
    ]
    for n in range(clusters.ROUNDS + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT r, min({{'d': {distance}, 'k': c.k}}) AS best FROM v, c{n} c GROUP BY r)""")
        if n < clusters.ROUNDS:
            steps.append(f"""m{n} AS (
  SELECT k, list(mean ORDER BY i) AS x FROM (
    SELECT best.k AS k, i, floor(sum(v.x[i]) / count(*)) AS mean FROM v JOIN a{n} USING (r), (SELECT unnest(range(1, {size + 1})) AS i) GROUP BY best.k, i)
  GROUP BY k)""")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c{n}.k, coalesce(m{n}.x, c{n}.x) AS x FROM c{n} LEFT JOIN m{n} USING (k))")
    last = clusters.ROUNDS
    return f"""WITH {", ".join(steps)}
SELECT vec_id, best.k::INTEGER AS cluster, best.d::BIGINT AS distance,
  (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c.x, lambda e: e::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM v JOIN a{last} USING (r) JOIN c{last} c ON c.k = best.k
"""


def op12_transducer_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.round_trip_digests(documents(spark, sf_dir))


def op13_rank_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(documents(spark, sf_dir))


#: Levels that the SQL statement of the manifest unrolls, for the rows of a source and for the sources.
_OP13_LEVELS, _OP13_SOURCE_LEVELS = 13, 8


def _op13() -> str:
    """n: nodes of a level; w: each row's place at that level, the digest folded so far, and its siblings up to it."""
    field = lambda value: f"coalesce(strlen({value}) || ':' || {value}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text])) + ")"
    odd = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384)) & 1"""
    steps = [
        # The register's last inversion turns the lowest bit.
        f"""l AS (SELECT *, {leaf("text")} AS leaf, CASE WHEN {odd} = 1 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS other FROM documents)""",
        """w0 AS MATERIALIZED (
  SELECT doc_id, leaf, other AS folded, '' AS way, 'x' || source AS grp, source,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l)""",
        "n0 AS MATERIALIZED (SELECT coalesce(grp, '') AS grp, i, leaf AS node FROM w0)",
    ]

    def level(n: int) -> None:
        steps.append(f"s{n} AS MATERIALIZED (SELECT grp, i // 3 AS i, list(node ORDER BY i) AS nodes, sum(count(*)) OVER (PARTITION BY grp) AS total FROM n{n} GROUP BY grp, i // 3)")
        steps.append(f"n{n + 1} AS MATERIALIZED (SELECT grp, i, CASE WHEN total = 1 THEN nodes[1] ELSE sha256(array_to_string(nodes, '')) END AS node FROM s{n})")
        left, right = "array_to_string(nodes[1:w.i % 3], '')", "array_to_string(nodes[w.i % 3 + 2:3], '')"
        steps.append(f"""w{n + 1} AS MATERIALIZED (
  SELECT w.* REPLACE (w.i // 3 AS i, way || {left} || {right} AS way, CASE WHEN total = 1 THEN folded ELSE sha256({left} || folded || {right}) END AS folded)
  FROM w{n} w JOIN s{n} s ON s.grp = coalesce(w.grp, '') AND s.i = w.i // 3)""")

    for n in range(_OP13_LEVELS):
        level(n)
    n = _OP13_LEVELS + 1
    steps.append(f"t AS MATERIALIZED (SELECT grp, node AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place FROM n{n - 1})")
    steps.append(f"n{n} AS MATERIALIZED (SELECT '' AS grp, place AS i, subroot AS node FROM t)")
    steps.append(f"w{n} AS MATERIALIZED (SELECT doc_id, leaf, folded, way, '' AS grp, subroot, place AS i FROM w{n - 1} w JOIN t ON t.grp = coalesce(w.grp, ''))")
    for k in range(_OP13_SOURCE_LEVELS):
        level(n + k)
    n += _OP13_SOURCE_LEVELS
    text = f"""WITH {", ".join(steps)}
SELECT doc_id, leaf, subroot, node AS root, sha256(way) AS proof_sha256, folded AS folded_root, folded = node AS verified FROM w{n}, n{n}
"""
    # total counts the groups of three of a level: one group of a single node is the end, of more nodes a level.
    return text.replace("total = 1", "(total = 1 AND len(nodes) = 1)")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_spans,
        op2_quality_model,
        op3_toxicity,
        op4_orc_token_ids,
        op5_quality_rules,
        op6_ngram_join,
        op7_packed_pieces,
        op8_syncmers,
        op9_bpe_round_trip,
        op10_suffix_dedup,
        op11_pivot_clusters,
        op12_transducer_round_trip,
        op13_rank_manifest,
    )
}
SQL: dict[str, str] = {"op5_quality_rules": _OP5, "op6_ngram_join": _OP6, "op11_pivot_clusters": _op11(), "op13_rank_manifest": _op13()}
