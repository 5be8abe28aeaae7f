"""Queries that write pages over the claim graph of ``evidence_queries``, and what is to do after notes changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, incremental, passages, render, views
from .evidence_queries import _ARROW, _L, links
from .registry import query, table

_BRIEF = f"concat_ws(' ', s, CASE WHEN contains(s, sp) THEN NULL ELSE sp END, {_ARROW.format(d='sd')}, '—' || predicate || CASE WHEN negated THEN ' (negated)' ELSE '' END || '→', o, CASE WHEN op = o THEN NULL ELSE op END, {_ARROW.format(d='od')})"
#: id and line of each claim; a passage here is its predicate.
_LINES = f"ln AS (SELECT id, '`' || id || '` ' || {_BRIEF} || ' “' || predicate || '” (' || note || ', ' || status || ')' || CASE WHEN confidence < 0.3 THEN ' ⚠ low confidence' ELSE '' END AS line FROM l)"
_NL = "chr(10)"


def _lines(own: DataFrame) -> DataFrame:
    flags = own.select("id", F.when(F.col("confidence") < 0.3, F.array(F.lit("low confidence"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    return views.claim_lines(own.withColumn("passage", F.col("predicate")), flags)


def _cases(own: DataFrame) -> DataFrame:
    """A case for each note with its claims."""
    made = own.groupBy("note").agg(F.array_sort(F.collect_list("id")).alias("inputs"), F.array_sort(F.collect_set("s_entity")).alias("entities"))
    status = F.when(F.col("note") < "n4", "proposed").otherwise("rejected")
    return made.select(F.concat(F.lit("k"), "note").alias("id"), F.lit("missing_bridge").alias("type"), F.concat(F.lit("Case "), "note").alias("title"), status.alias("status"), "inputs", "entities", F.lit("Said.").alias("text"), F.lit("mine").alias("notes"))


@query(f"WITH {_L}, {_LINES} SELECT id, line FROM ln")
def claim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims as lines of a page, with what to look at first."""
    return _lines(links(spark, sf_dir))


@query(f"""WITH {_L}, {_LINES} SELECT 'cases/k' || note || '.md' AS path, '# Case ' || note || {_NL} || {_NL} || 'missing bridge · ' || CASE WHEN note < 'n4' THEN 'proposed' ELSE 'rejected' END || {_NL} || {_NL} || 'Entities: ' || string_agg(DISTINCT s, ', ' ORDER BY s)
|| {_NL} || {_NL} || '## Claims' || {_NL} || string_agg('- ' || ln.line, {_NL} ORDER BY id) || {_NL} || {_NL} || 'Said.' || {_NL} || {_NL} || '<!-- reviewer-notes -->' || {_NL} || 'mine' AS text FROM l JOIN ln USING (id) GROUP BY note""")
def case_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = links(spark, sf_dir)
    return views.case_pages(_cases(own), _lines(own))


@query(f"""WITH {_L}, {_LINES}, b AS (SELECT s AS entity, o AS other, id, note, study, kind FROM l UNION ALL SELECT o, s, id, note, study, kind FROM l),
g AS (SELECT entity, other, '### ' || other || ' · ' || count(*) || ' claims, ' || count(DISTINCT study) || ' independent' || {_NL} || string_agg('- [' || kind || '] ' || line, {_NL} ORDER BY id) AS t FROM b JOIN ln USING (id) GROUP BY entity, other),
c AS (SELECT entity, string_agg(t, {_NL} || {_NL} ORDER BY other) AS t FROM g GROUP BY entity), n AS (SELECT entity, string_agg(DISTINCT '- ' || note, {_NL} ORDER BY '- ' || note) AS t FROM b GROUP BY entity),
k AS (SELECT s AS entity, string_agg(DISTINCT '- Case ' || note || CASE WHEN note < 'n4' THEN ' · proposed' ELSE ' · rejected' END, {_NL} ORDER BY '- Case ' || note || CASE WHEN note < 'n4' THEN ' · proposed' ELSE ' · rejected' END) AS t FROM l GROUP BY s)
SELECT 'entities/' || entity || '.md' AS path, concat_ws({_NL} || {_NL}, '# ' || entity, 'Scales: ' || CASE WHEN substr(entity, 2)::INT % 7 = 0 THEN 'unmapped' ELSE 'sc' || substr(entity, 2)::INT % 3 END, '## Claims by connected entity', c.t, '## Cases' || {_NL} || k.t, '## Source notes' || {_NL} || n.t) AS text
FROM c JOIN n USING (entity) LEFT JOIN k USING (entity)""")
def entity_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = links(spark, sf_dir)
    return views.entity_pages(own, _scales(spark, sf_dir), _lines(own), _cases(own))


def _scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").where(n % 7 != 0).select(F.concat(F.lit("e"), n.cast("string")).alias("entity"), F.array(F.concat(F.lit("sc"), (n % 3).cast("string"))).alias("scales"))


@query(f"""WITH {_L}, b AS (SELECT s AS entity, o AS other FROM l UNION SELECT o, s FROM l), d AS (SELECT entity, count(*) AS degree, array_to_string(list_sort(list(other))[1 : 6], ', ') AS near FROM b GROUP BY entity),
p AS (SELECT CASE WHEN substr(entity, 2)::INT % 7 = 0 THEN 'unmapped' ELSE 'sc' || substr(entity, 2)::INT % 3 END AS scale, * FROM d), t AS (SELECT scale, string_agg('- ' || entity || ' · linked to ' || near, {_NL} ORDER BY degree DESC, entity) AS ls FROM p GROUP BY scale),
k AS (SELECT 0 AS idx, 'sc0' AS scale, '1. Zero' AS name UNION ALL SELECT 1, 'sc1', '2. One' UNION ALL SELECT 2, 'sc2', '3. Two' UNION ALL SELECT 3, 'sc3', '4. Three' UNION ALL SELECT 4, 'unmapped', 'Unmapped')
SELECT 'framework-map.md' AS path, '# Framework map' || {_NL} || {_NL} || string_agg('## ' || name || {_NL} || coalesce(ls, '*nothing in the indexed notes*'), {_NL} || {_NL} ORDER BY idx) AS text FROM k LEFT JOIN t USING (scale)""")
def framework_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [(i, f"sc{i}", name) for i, name in enumerate(("Zero", "One", "Two", "Three"))]
    return views.map_page(links(spark, sf_dir), _scales(spark, sf_dir), spark.createDataFrame(names, "idx int, id string, name string"))


@query(f"""WITH {_L}, {_LINES}, w AS (SELECT note, count(*) AS n, string_agg('- ' || ln.line, {_NL} ORDER BY l.line, id) AS ls FROM l JOIN ln USING (id) WHERE status IN ('proposed', 'stale', 'deferred') GROUP BY note)
SELECT 'review-queue.md' AS path, '# Review queue' || {_NL} || {_NL} || '## Claims (' || sum(n)::BIGINT || ')' || {_NL} || {_NL} || string_agg('### ' || note || {_NL} || ls, {_NL} || {_NL} ORDER BY note) || {_NL} || {_NL} || '## Cases' || {_NL}
|| (SELECT string_agg('- Case ' || note || ' · proposed', {_NL} ORDER BY note) FROM (SELECT DISTINCT note FROM l WHERE note < 'n4')) AS text FROM w""")
def queue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = links(spark, sf_dir)
    return views.queue_page(own, _lines(own), _cases(own))


@query("""WITH n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS s, n_name AS t FROM nation), q AS (SELECT k, concat_ws(' ', s, 'to', t) AS said FROM n)
SELECT k AS id, left(regexp_replace(lower(said), '[ _]+', '-', 'g'), 50) || '-' || left(sha256(said), 6) AS question FROM q""")
def question_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of questions from a source (or from any) to a target."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("id"), evidence.question_id(F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))).alias("question"))


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 5 = 0""")
def link_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes to ask for relations again: their text or their candidates changed, or they were never asked."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority")
    state = lambda own, others: F.concat_ws("|", own, others)
    now = o.select("id", state("o_orderstatus", "o_orderpriority").alias("state"))
    text = F.when(F.col("id") % 4 == 0, "other").otherwise(F.col("o_orderstatus"))
    others = F.when(F.col("id") % 3 == 0, "other").otherwise(F.col("o_orderpriority"))
    return incremental.todo(now, o.where("id % 5 <> 0").select("id", state(text, others).alias("state")), "id", "state").select("id")


@query("""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), q AS (SELECT doc_id, trim(regexp_replace(l[1], '\\s+', ' ', 'g')) AS q FROM l)
SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'fuzzy 0.90' ELSE 'exact' END AS match, left(sha256(lower(q)), 16) AS hash FROM q WHERE len(q) >= 20 AND doc_id % 3 <> 0""")
def relocated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that are still in their note after lines were put before it; they keep how they were first matched."""
    first = F.btrim(F.regexp_replace(F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0)), r"\s+", " "))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", first.alias("first")).where("length(first) >= 20")
    note = F.when(F.col("doc_id") % 3 == 0, "gone").otherwise(F.concat(F.lit("New.\n\n"), "text"))
    spans = docs.select(F.col("doc_id").alias("id"), F.col("first").alias("text"), F.when(F.col("doc_id") % 2 == 0, "fuzzy 0.90").otherwise("exact").alias("match"), note.alias("note"))
    return passages.relocate_quotes(spans).where("line_start IS NOT NULL").select("id", "match", "hash")


@query(f"""WITH b AS (SELECT n_name || ' → ' || n_regionkey AS l FROM nation WHERE n_regionkey < 2), o AS (SELECT r_name AS l FROM region), d AS (SELECT c_name || ' ~ ' || c_mktsegment AS l FROM customer WHERE c_acctbal > 9990)
SELECT 'maintenance.md' AS path, '# Maintenance' || {_NL} || {_NL} || 'broken: ' || (SELECT count(*) FROM b) || ' orphans: ' || (SELECT count(*) FROM o) || ' duplicates: ' || (SELECT count(*) FROM d) || {_NL} || {_NL} || '## Broken links' || {_NL} || (SELECT string_agg('- ' || l, {_NL} ORDER BY l) FROM b)
|| {_NL} || {_NL} || '## Unconnected notes' || {_NL} || (SELECT string_agg('- ' || l, {_NL} ORDER BY l) FROM o) || coalesce({_NL} || {_NL} || '## Likely duplicates' || {_NL} || (SELECT string_agg('- ' || l, {_NL} ORDER BY l) FROM d), '') AS text""")
def maintenance_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = table(spark, sf_dir, "nation").where("n_regionkey < 2").select(F.col("n_name").alias("src"), F.col("n_regionkey").cast("string").alias("target"))
    orphans = table(spark, sf_dir, "region").select(F.col("r_name").alias("id"))
    alike = table(spark, sf_dir, "customer").where("c_acctbal > 9990").select(F.col("c_name").alias("src"), F.col("c_mktsegment").alias("dst"))
    return render.maintenance_page(broken, orphans, alike)
