"""Queries over a small claim graph, written out of ``nation`` by rules that SQL can say as well, and over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import study_id
from ..operators import evidence, graph, incremental, research
from .registry import query, table

_STATUS = ["proposed", "accepted", "rejected", "stale", "deferred", "superseded"]
_MOVES = ["increase", "decrease", "present", ""]


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed links between entities e0 to e24: one for some ordered pairs (i, j)."""
    i, j = F.col("i"), F.col("j")
    pick = lambda xs, k: F.get(F.array(*map(F.lit, xs)), k.cast("int"))
    pairs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("j")).where("i <> j AND (i * 7 + j * 3) % 11 < 3")
    name = lambda x: F.concat(F.lit("e"), x.cast("string"))
    return pairs.select(
        F.concat(F.lit("c"), (i * 25 + j).cast("string")).alias("id"), F.concat(F.lit("n"), (j % 9).cast("string")).alias("note"), F.concat(F.lit("s"), (i % 6).cast("string")).alias("study"),
        name(i).alias("s_entity"), name(j).alias("o_entity"), F.least(name(i), name(j)).alias("a"), F.greatest(name(i), name(j)).alias("b"),
        pick(["causal", "causal", "associative", "hypothesis", "null"], (i + j) % 5).alias("kind"), F.when((i * j + i) % 3 == 0, -1).otherwise(1).alias("sign"),
        ((i + j) % 10 / 10.0).alias("confidence"), (i % 4 / 4.0).alias("weight"), pick(_STATUS, (i * 3 + j) % 6).alias("status"), (i * 2 + j).alias("line"),
        F.concat(F.lit("rel"), (i % 3).cast("string")).alias("predicate"), (i % 4 == 1).alias("negated"), F.concat(F.lit("fw@"), (j % 2 + 1).cast("string")).alias("framework"),
        F.concat(F.lit("p"), (j % 3).cast("string")).alias("s_property"), pick(_MOVES, i % 4).alias("s_direction"), F.when(j % 2 == 0, name(j)).otherwise("q").alias("o_property"), pick(_MOVES, j % 4).alias("o_direction"),
    )


_pick = lambda xs, k: f"[{', '.join(repr(x) for x in xs)}][{k} + 1]"
_L = f"""l AS (SELECT 'c' || (i * 25 + j) AS id, 'n' || j % 9 AS note, 's' || i % 6 AS study, 'e' || i AS s, 'e' || j AS o, least('e' || i, 'e' || j) AS a, greatest('e' || i, 'e' || j) AS b,
{_pick(["causal", "causal", "associative", "hypothesis", "null"], "(i + j) % 5")} AS kind, CASE WHEN (i * j + i) % 3 = 0 THEN -1 ELSE 1 END AS sign, (i + j) % 10 / 10.0::DOUBLE AS confidence, i % 4 / 4.0::DOUBLE AS weight,
{_pick(_STATUS, "(i * 3 + j) % 6")} AS status, i * 2 + j AS line, 'rel' || i % 3 AS predicate, i % 4 = 1 AS negated, 'fw@' || (j % 2 + 1) AS framework, 'p' || j % 3 AS sp, {_pick(_MOVES, "i % 4")} AS sd,
CASE WHEN j % 2 = 0 THEN 'e' || j ELSE 'q' END AS op, {_pick(_MOVES, "j % 4")} AS od FROM (SELECT n_nationkey AS i, unnest(range(0, 25)) AS j FROM nation) WHERE i <> j AND (i * 7 + j * 3) % 11 < 3)"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("e"), n.cast("string")).alias("entity"), (n % 5 - 1).cast("int").alias("level"))


_LEVELS = "lv AS (SELECT 'e' || n_nationkey AS entity, n_nationkey % 5 - 1 AS level FROM nation)"
_ids = lambda c: F.array_join(c, ",")


@query(f"WITH {_L} SELECT status, count(*) AS n FROM l GROUP BY status")
def claims_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.status_counts(links(spark, sf_dir))


@query(f"""WITH {_L}, r AS (SELECT id, note, s AS entity, sd AS d FROM l UNION ALL SELECT id, note, o, od FROM l)
SELECT entity, count(DISTINCT id) AS n_claims, count(DISTINCT note) AS n_notes, count(*) FILTER (d = 'increase') AS up, count(*) FILTER (d = 'decrease') AS down FROM r GROUP BY entity""")
def entity_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.entity_summary(links(spark, sf_dir))


_ARROW = "nullif(replace(replace({d}, 'increase', '↑'), 'decrease', '↓'), '')"


@query(f"""WITH {_L} SELECT id, concat_ws(' ', s, CASE WHEN contains(s, sp) THEN NULL ELSE sp END, {_ARROW.format(d='sd')}, '—' || predicate || CASE WHEN negated THEN ' (negated)' ELSE '' END || '→', o, CASE WHEN op = o THEN NULL ELSE op END, {_ARROW.format(d='od')}) AS claim FROM l""")
def claim_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.claim_brief(links(spark, sf_dir))


@query(f"WITH {_L} SELECT id, note FROM l WHERE (s = 'e3' OR o = 'e3') AND status = 'accepted' ORDER BY id LIMIT 30")
def claims_of_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.find_claims(links(spark, sf_dir), entity="E-3", status="accepted").select("id", "note")


@query(f"""WITH {_L}, x AS (SELECT l.id, l.a, l.b, l.sign FROM l JOIN l m ON l.a = m.a AND l.b = m.b AND l.id <> m.id ORDER BY l.id LIMIT 1)
SELECT l.id, CASE WHEN l.kind = 'null' THEN 'no effect reported' WHEN l.sign = x.sign THEN 'same direction' ELSE 'opposite direction' END AS relation, study FROM l JOIN x USING (a, b) WHERE l.id <> x.id""")
def claims_of_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other claims of a pair that has several (of the first such claim)."""
    own = links(spark, sf_dir)
    several = own.groupBy("a", "b").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n > 1").agg(F.min("id").alias("id"))
    return evidence.related_claims(own, several.first().id)


@query(f"WITH {_L}, r AS (SELECT id, study, CASE WHEN s = 'e4' THEN o ELSE s END AS other FROM l WHERE s = 'e4' OR o = 'e4') SELECT other, string_agg(id, ',' ORDER BY id) AS claims, count(DISTINCT study) AS n_studies FROM r GROUP BY other")
def entity_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.entity_card(links(spark, sf_dir), "e4").withColumn("claims", _ids("claims"))


@query(f"""WITH {_L}, d AS (SELECT entity, count(DISTINCT other) AS degree FROM (SELECT s AS entity, o AS other FROM l UNION ALL SELECT o, s FROM l) GROUP BY entity),
m AS (SELECT 'e' || n_nationkey AS entity, unnest(CASE WHEN n_nationkey % 7 = 0 THEN ['unmapped'] ELSE ['sc' || n_nationkey % 3, 'sd' || n_nationkey % 2] END) AS scale FROM nation)
SELECT scale, entity, degree, row_number() OVER (PARTITION BY scale ORDER BY degree DESC, entity)::INT AS rank FROM d JOIN m USING (entity)""")
def framework_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    scales = table(spark, sf_dir, "nation").where(n % 7 != 0).select(F.concat(F.lit("e"), n.cast("string")).alias("entity"), F.array(F.concat(F.lit("sc"), (n % 3).cast("string")), F.concat(F.lit("sd"), (n % 2).cast("string"))).alias("scales"))
    return evidence.lanes(links(spark, sf_dir), scales)


_REP = f"""{_L}, g AS (SELECT a, b, arg_min(id, (kind <> 'causal', -confidence, id)) AS id FROM l WHERE kind IN ('causal', 'associative') AND sign <> 0 GROUP BY a, b HAVING count(DISTINCT sign) = 1),
rep AS (SELECT l.* FROM l JOIN g USING (a, b, id))"""
_LOOPS = f"""{_REP}, e AS (SELECT a AS x, b AS y, sign FROM rep UNION ALL SELECT b, a, sign FROM rep),
loops AS (SELECT [p.x, p.y, q.y] AS nodes FROM e p JOIN e q ON q.x = p.y JOIN e r ON r.x = p.x AND r.y = q.y WHERE p.x < p.y AND p.y < q.y AND p.sign * q.sign * r.sign < 0
UNION ALL SELECT [p.x, p.y, q.y, t.y] FROM e p JOIN e q ON q.x = p.y JOIN e t ON t.x = q.y JOIN e v ON v.x = p.x AND v.y = t.y WHERE p.x < p.y AND q.y > p.x AND t.y > p.y AND q.y <> p.y AND t.y <> q.y AND t.y <> p.x AND p.sign * q.sign * t.sign * v.sign < 0)"""
_LOOP_EDGES = "le AS (SELECT nodes, nodes[k] AS u, nodes[k % len(nodes) + 1] AS v FROM (SELECT nodes, unnest(range(1, len(nodes) + 1)) AS k FROM loops)), lx AS (SELECT le.*, rep.* FROM le JOIN rep ON rep.a = least(u, v) AND rep.b = greatest(u, v))"


def _loops(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The loops with a negative product, and the link that stands for each pair."""
    own = links(spark, sf_dir)
    chosen = research.representative_links(own)
    return research.sign_tensions(own), own.join(chosen.select("id"), "id", "left_semi")


@query(f"WITH {_REP} SELECT a, b, id, sign, kind FROM rep")
def pair_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link that stands for each pair whose signed links agree."""
    return research.representative_links(links(spark, sf_dir))


@query(f"WITH {_LOOPS} SELECT array_to_string(nodes, '>') AS nodes, len(nodes) AS length FROM loops")
def sign_tensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loops(spark, sf_dir)[0].select(F.array_join("nodes", ">").alias("nodes"), "length")


@query(f"""WITH {_LOOPS}, {_LOOP_EDGES}, {_LEVELS}, c AS (SELECT lx.*, abs(x.level - y.level) AS span FROM lx JOIN lv x ON x.entity = u JOIN lv y ON y.entity = v),
t AS (SELECT nodes, arg_max(id, (span, kind = 'associative', id)) AS challenger, bool_and(kind = 'causal') AS causal, list_sort(coalesce(list(id) FILTER (kind = 'associative'), [])) AS loose, string_agg(id, ',' ORDER BY id) AS inputs FROM c GROUP BY nodes)
SELECT array_to_string(nodes, '>') AS nodes, CASE WHEN causal THEN 'conditional_sign_tension' ELSE 'potential_tension' END AS type, challenger, array_to_string(list_filter(loose, lambda x: x <> challenger), ',') AS premises, inputs FROM t""")
def tension_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of sign tension with the claim that challenges the others."""
    found = evidence.tension_cases(*_loops(spark, sf_dir), levels(spark, sf_dir))
    return found.select(F.array_join("nodes", ">").alias("nodes"), "type", "challenger", _ids("premises").alias("premises"), _ids("inputs").alias("inputs"))


@query(f"""WITH {_LOOPS}, {_LOOP_EDGES}, d AS (SELECT nodes, node, count(*) FILTER (s = node) AS outs, bool_and(kind = 'causal') AS causal FROM (SELECT nodes, unnest([u, v]) AS node, s, kind FROM lx) GROUP BY ALL)
SELECT array_to_string(nodes, '>') AS nodes, max(node) FILTER (outs = 2) AS source, max(node) FILTER (outs = 0) AS sink FROM d GROUP BY nodes HAVING bool_and(causal) AND count(*) FILTER (outs = 2) = 1""")
def feed_forward_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.feed_forward(*_loops(spark, sf_dir)).withColumn("nodes", F.array_join("nodes", ">"))


@query(f"WITH {_L} SELECT note AS grp, study, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM l GROUP BY ALL HAVING count(DISTINCT id) > 1")
def shared_study_assumptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.shared_studies(links(spark, sf_dir).withColumn("grp", F.col("note"))).withColumn("ids", _ids("ids"))


@query(f"WITH {_L} SELECT study AS grp, s AS entity, string_agg(DISTINCT sp, ',' ORDER BY sp) AS properties FROM l GROUP BY ALL HAVING count(DISTINCT sp) > 1")
def property_assumptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = links(spark, sf_dir).select(F.col("study").alias("grp"), F.col("s_entity").alias("entity"), F.col("s_property").alias("property"))
    return evidence.mixed_properties(own).withColumn("properties", _ids("properties"))


def _check_cases(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    own = links(spark, sf_dir)
    conflict = research.conflicting_results(own).select(F.lit("conflicting_result").alias("type"), F.concat("a", F.lit(" and "), "b").alias("title"), F.array_sort(F.concat("positive", "negative", "no_effect")).alias("inputs"), F.array("a", "b").alias("entities"))
    agree = research.triangulation(own, 1, 0.25).select(F.lit("triangulation").alias("type"), F.concat("a", F.lit(" and "), "b").alias("title"), "inputs", F.array("a", "b").alias("entities"))
    return {"conflicts": conflict, "triangulation": agree}


_SIGNED = "kind IN ('causal', 'associative') AND sign"
_CASES = f"""cf AS (SELECT a, b, list(DISTINCT id) FILTER ({_SIGNED} > 0) AS p, list(DISTINCT id) FILTER ({_SIGNED} < 0) AS n, list(DISTINCT id) FILTER (kind = 'null') AS z, list_sort(list(DISTINCT study) FILTER ({_SIGNED} > 0)) AS sp, list_sort(list(DISTINCT study) FILTER ({_SIGNED} < 0)) AS sn FROM l GROUP BY a, b),
tr AS (SELECT a, b, list(DISTINCT id) AS i FROM l WHERE {_SIGNED} <> 0 AND weight >= 0.25 GROUP BY a, b),
cs AS (SELECT 'conflicting_result' AS type, a, b, list_sort(list_concat(coalesce(p, []), coalesce(n, []), coalesce(z, []))) AS inputs FROM cf WHERE (len(p) > 0 AND len(n) > 0 AND sp <> sn) OR (len(z) > 0 AND coalesce(len(p), 0) + coalesce(len(n), 0) > 0)
UNION ALL SELECT 'triangulation', a, b, list_sort(i) FROM tr)"""


@query(f"WITH {_L}, {_CASES} SELECT type, a || ' and ' || b AS title, array_to_string(inputs, ',') AS inputs FROM cs")
def checked_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks that are enabled, their cases merged."""
    return evidence.run_checks(_check_cases(spark, sf_dir), ("conflicts", "triangulation")).select("type", "title", _ids("inputs").alias("inputs"))


def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _check_cases(spark, sf_dir)["conflicts"].distinct()
    return cases.select(F.col("title").alias("id"), "type", F.when(F.length("title") % 2 == 0, "rejected").otherwise("proposed").alias("status"), "entities", "inputs")


_OPEN = "open_ AS (SELECT a, b, inputs, a || ' and ' || b AS id FROM cs WHERE type = 'conflicting_result' AND length(a || ' and ' || b) % 2 = 1)"


@query(f"WITH {_L}, {_CASES}, {_OPEN} SELECT a, b, id AS \"case\" FROM open_")
def challenged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.challenged_pairs(_conflicts(spark, sf_dir))


@query(f"""WITH {_L}, {_CASES}, {_OPEN}, d AS (SELECT s AS src, o AS dst, true AS fwd, kind, sign, id FROM l UNION ALL SELECT o, s, false, kind, sign, id FROM l),
g AS (SELECT src, dst, bool_or(kind = 'causal' AND fwd) AS causal, arg_min(sign, (kind <> 'causal', id)) AS sign FROM d WHERE kind = 'associative' OR (fwd AND kind IN ('causal', 'hypothesis')) GROUP BY src, dst)
SELECT src, dst, CASE WHEN (least(src, dst), greatest(src, dst)) IN (SELECT (a, b) FROM open_) THEN 'Challenged' WHEN causal THEN 'Supported' ELSE 'Assumed' END AS status, sign FROM g""")
def step_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.step_status(links(spark, sf_dir), research.challenged_pairs(_conflicts(spark, sf_dir)))


_STEPS = "st AS (SELECT s AS src, o AS dst, id, kind AS how, sign FROM l WHERE kind IN ('causal', 'associative', 'hypothesis') UNION ALL SELECT o, s, id, 'assumed-direction', sign FROM l WHERE kind = 'associative')"


@query(f"WITH {_L}, {_STEPS} SELECT src, dst, id, how FROM st")
def step_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.step_options(links(spark, sf_dir)).drop("sign")


_REACHED = f"WITH RECURSIVE {_L}, {_STEPS}, r AS (SELECT 'e1' AS node, 0 AS hops UNION SELECT dst, hops + 1 FROM r JOIN st ON src = node WHERE hops < 3), h AS (SELECT node, min(hops) AS hops FROM r GROUP BY node)"


@query(f"{_REACHED} SELECT node, hops FROM h")
def reachable_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.reachable(evidence.step_options(links(spark, sf_dir)), "e1", 3)


@query(f"{_REACHED}, {_LEVELS} SELECT node, hops, level FROM h JOIN lv ON entity = node ORDER BY level DESC, hops, node LIMIT 1")
def best_reachable_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a reading ends that can't reach its target."""
    return evidence.best_end(evidence.reachable(evidence.step_options(links(spark, sf_dir)), "e1", 3), levels(spark, sf_dir))


def _narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).groupBy(F.col("note").alias("narrative")).agg(F.array_sort(F.collect_list("id")).alias("claims"))


@query(f"""WITH {_LOOPS}, {_LOOP_EDGES}, t AS (SELECT array_to_string(nodes, '>') AS "case", unnest(list(id)) AS id FROM lx GROUP BY nodes HAVING NOT bool_and(kind = 'causal'))
SELECT DISTINCT note AS narrative, "case" FROM t JOIN l USING (id)""")
def narrative_challenges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narratives (the claims of a note) and the open cases of potential tension that share a claim with them."""
    cases = evidence.tension_cases(*_loops(spark, sf_dir), levels(spark, sf_dir)).select(F.array_join("nodes", ">").alias("id"), "type", F.lit("proposed").alias("status"), "inputs")
    return evidence.narrative_challenges(_narratives(spark, sf_dir), cases, ("potential_tension",))


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rank, path, net: simple paths from e1 to e5 by at most three steps."""
    steps = evidence.step_options(links(spark, sf_dir)).select("src", "dst", "sign", F.when(F.col("how") == "assumed-direction", "associative").otherwise(F.col("how")).alias("kind"))
    found = graph.simple_paths(steps, "e1", "e5", 3).groupBy("path").agg(F.min(graph.net_sign(F.col("signs"))).alias("net"))
    return graph.durable(found.select(F.concat(F.size("path").cast("string"), F.array_join("path", ">")).alias("rank"), "path", "net"))


_PATHS = f"""WITH RECURSIVE {_L}, {_STEPS}, p AS (SELECT 'e1' AS cur, ['e1'] AS path, 1 AS net UNION SELECT dst, list_append(path, dst), net * sign FROM p JOIN st ON src = cur WHERE cur <> 'e5' AND len(path) <= 3 AND NOT list_contains(path, dst)),
f AS (SELECT path, min(net) AS net FROM p WHERE cur = 'e5' GROUP BY path), k AS (SELECT len(path) || array_to_string(path, '>') AS rank, path, net, list_transform(range(1, len(path)), lambda i: path[i] || '>' || path[i + 1]) AS edges FROM f),
one AS (SELECT * FROM k ORDER BY rank LIMIT 1), two AS (SELECT k.* FROM k, one WHERE k.rank <> one.rank AND len(list_intersect(k.edges, one.edges)) <= 0.5 * len(k.edges) ORDER BY k.rank LIMIT 1)"""


@query(f"{_PATHS} SELECT rank, array_to_string(path, '>') AS path FROM (FROM one UNION ALL FROM two)")
def competing_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reading of a question and the next one that shares at most half of its edges with it."""
    return research.competing(_readings(spark, sf_dir)).select("rank", F.array_join("path", ">").alias("path"))


@query(f"""{_PATHS}, b AS (SELECT x.path AS a, y.path AS b, CASE WHEN x.net * y.net < 0 THEN ['Reduce e1 and measure e5'] ELSE [] END AS q FROM one x, two y),
o AS (SELECT list_concat(q, list_transform(list_filter(a[2 : len(a) - 1], lambda e: NOT list_contains(b, e)), lambda e: 'Block ' || e || ', then change e1 and measure e5'), list_transform(list_filter(b[2 : len(b) - 1], lambda e: NOT list_contains(a, e)), lambda e: 'Block ' || e || ', then change e1 and measure e5')) AS o FROM b)
SELECT i::INT - 1 AS n, o[i] AS observation FROM (SELECT o, unnest(range(1, least(len(o), 6) + 1)) AS i FROM o)""")
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations that tell two competing readings apart."""
    two = research.competing(_readings(spark, sf_dir)).agg(F.array_sort(F.collect_list(F.struct("rank", "path", "net"))).alias("r"))
    pair = two.select(F.lit(1).alias("pair"), F.get("r", 0)["path"].alias("a"), F.get("r", 1)["path"].alias("b"), F.get("r", 0)["net"].alias("sign_a"), F.get("r", 1)["net"].alias("sign_b"))
    return evidence.predictions(pair).select("n", "observation")


@query(f"""WITH {_L}, {_CASES}, ents AS (SELECT unnest(['e1', 'e2', 'e5']) AS e), onp AS (SELECT id FROM l WHERE s = 'e1' OR o = 'e2'), tc AS (SELECT type, unnest(inputs) AS id FROM cs WHERE a IN (FROM ents) OR b IN (FROM ents)),
rk AS (SELECT id, min(k) AS k FROM (SELECT id, 0 AS k FROM onp UNION ALL SELECT id, 1 FROM tc) GROUP BY id), ag AS (SELECT id FROM l WHERE kind = 'null' AND (s IN (FROM ents) OR o IN (FROM ents)) UNION SELECT id FROM tc WHERE type <> 'triangulation' AND id NOT IN (FROM onp))
(SELECT 'claim' AS part, id FROM rk ORDER BY k, id LIMIT 10) UNION ALL (SELECT 'counterevidence', id FROM ag ORDER BY id LIMIT 5) UNION ALL (SELECT 'excluded', id FROM l WHERE status IN ('rejected', 'superseded') AND (s IN (FROM ents) OR o IN (FROM ents)) ORDER BY id LIMIT 4)""")
def evidence_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an investigation should look at, each part cut at its bound (the feature)."""
    own = links(spark, sf_dir)
    paths = own.where("s_entity = 'e1' OR o_entity = 'e2'").agg(F.array_sort(F.collect_set("id")).alias("claims")).select(F.array(*map(F.lit, ("e1", "e2", "e5"))).alias("nodes"), "claims")
    cases = evidence.run_checks(_check_cases(spark, sf_dir), ("conflicts", "triangulation"))
    return evidence.evidence_package(paths, own, cases, own.where("status IN ('rejected', 'superseded')"), 10, 5, 4)


@query(f"""WITH {_L}, st AS (SELECT note AS narrative, line % 4 AS i, min(s) AS src, max(o) AS dst, list_sort(list_append(list(id), 'c-none')) AS claims FROM l GROUP BY ALL),
x AS (SELECT narrative, i, src, dst, unnest(claims) AS id FROM st), y AS (SELECT x.*, l.status, l.kind, l.s, (l.s = src AND l.o = dst) OR (l.s = dst AND l.o = src) AS joins FROM x LEFT JOIN l USING (id)),
g AS (SELECT narrative, i, coalesce(string_agg(id, ',' ORDER BY id) FILTER (status IS NULL), '') AS unknown, coalesce(string_agg(id, ',' ORDER BY id) FILTER (status IN ('rejected', 'superseded', 'stale', 'source_missing')), '') AS dead,
 coalesce(string_agg(id, ',' ORDER BY id) FILTER (NOT joins), '') AS off, coalesce(string_agg(id, ',' ORDER BY id) FILTER (joins), '') AS kept, coalesce(bool_or(joins), false) AS c, coalesce(bool_or(joins AND kind = 'causal' AND s = src), false) AS f FROM y GROUP BY narrative, i)
SELECT narrative, i, CASE WHEN NOT c THEN 'Missing' WHEN NOT f THEN 'Assumed' ELSE 'Supported' END AS status, kept, unknown, dead, off FROM g""")
def validated_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written steps after the mechanical checks: unknown and unconnected claims go, statuses that nothing justifies are lowered."""
    own = links(spark, sf_dir)
    steps = own.groupBy(F.col("note").alias("narrative"), (F.col("line") % 4).alias("i")).agg(F.min("s_entity").alias("src"), F.max("o_entity").alias("dst"), F.array_append(F.collect_list("id"), F.lit("c-none")).alias("claims"))
    found = evidence.validate_steps(steps.withColumn("status", F.lit("Supported")), own, own)
    return found.select("narrative", "i", "status", *[_ids(c).alias(c) for c in ("kept", "unknown", "dead", "off")])


@query(f"WITH {_L} SELECT note, count(*) AS n, string_agg(id, ',' ORDER BY line, id) AS ids FROM l WHERE status IN ('proposed', 'stale', 'deferred') GROUP BY note")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.review_queue(links(spark, sf_dir)).withColumn("ids", _ids("ids"))


@query(f"""WITH {_L}, d AS (SELECT id, arg_max(act, w) AS act FROM (SELECT id, line AS w, CASE line % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'defer' END AS act FROM l WHERE line % 2 = 0 UNION ALL SELECT id, line + 100, 'accept' FROM l WHERE line % 5 = 0) GROUP BY id)
SELECT l.id, coalesce(CASE act WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'defer' THEN 'deferred' END, status) AS status FROM l LEFT JOIN d USING (id)""")
def reviewed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims after decisions; the latest one counts."""
    own = links(spark, sf_dir)
    act = F.when(F.col("line") % 3 == 0, "accept").when(F.col("line") % 3 == 1, "reject").otherwise("defer")
    decisions = own.where("line % 2 = 0").select("id", act.alias("action"), F.col("line").alias("at")).unionByName(own.where("line % 5 = 0").select("id", F.lit("accept").alias("action"), (F.col("line") + 100).alias("at")))
    return incremental.review(own.select("id", "status"), decisions)


@query(f"WITH {_L} SELECT id FROM l WHERE status IN ('proposed', 'accepted', 'deferred')")
def live_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.live(links(spark, sf_dir), "fw").select("id")


@query(f"""WITH {_L}, m AS (SELECT 'e' || n_nationkey AS entity, unnest(['sc' || n_nationkey % 3, 'sc' || n_nationkey % 4]) AS scale FROM nation)
SELECT 'other version' AS kind, id FROM l WHERE framework <> 'fw@2' UNION ALL SELECT 'unknown predicate', id FROM l WHERE predicate = 'rel2' UNION ALL SELECT DISTINCT 'scale is gone', entity FROM m WHERE scale = 'sc3'""")
def framework_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    scale = lambda k: F.concat(F.lit("sc"), (n % k).cast("string"))
    mappings = table(spark, sf_dir, "nation").select(F.concat(F.lit("e"), n.cast("string")).alias("entity"), F.array(scale(3), scale(4)).alias("scales"))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    return evidence.framework_impact(links(spark, sf_dir), mappings, ids("rel0", "rel1"), ids("sc0", "sc1", "sc2"), "fw@2")


@query(f"WITH {_L} SELECT note, s AS entity, predicate AS scale FROM l WHERE note NOT IN ('n1', 'n4') UNION SELECT note, o, 'new' FROM l WHERE note IN ('n1', 'n4')")
def replaced_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = links(spark, sf_dir)
    fresh = own.where("note IN ('n1', 'n4')").select("note", F.col("o_entity").alias("entity"), F.lit("new").alias("scale"))
    return evidence.replace_votes(own.select("note", F.col("s_entity").alias("entity"), F.col("predicate").alias("scale")), fresh)


@query(f"""WITH {_L}, t AS (SELECT s AS key, 'rel' || (line % 5) AS id, count(*) AS n FROM l GROUP BY ALL), x AS (SELECT *, max(n) OVER (PARTITION BY key) AS top, CASE id WHEN 'rel0' THEN 0 WHEN 'rel1' THEN 1 WHEN 'rel2' THEN 2 ELSE -1 END AS idx FROM t)
SELECT key, string_agg(id, ',' ORDER BY idx, id) FILTER (n = top OR n >= 2) AS scales, sum(n)::BIGINT AS votes FROM x GROUP BY key""")
def mapping_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = links(spark, sf_dir).select(F.col("s_entity").alias("key"), F.col("id").alias("claim"), F.array(F.concat(F.lit("rel"), (F.col("line") % 5).cast("string"))).alias("scales"))
    scales = spark.createDataFrame([(k, f"rel{k}") for k in range(3)], "idx int, id string")
    return research.mapping_tally(sources, scales).select("key", _ids("scales").alias("scales"), "votes")


@query(f"WITH {_L} SELECT note || '/' || study AS title, string_agg(DISTINCT id, ',' ORDER BY id) AS inputs FROM l GROUP BY ALL")
def merged_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of one type and title, united."""
    cases = links(spark, sf_dir).select(F.lit("t").alias("type"), F.concat("note", F.lit("/"), "study").alias("title"), F.array("id").alias("inputs"), F.array("s_entity", "o_entity").alias("entities"))
    return research.merge_cases(cases).select("title", _ids("inputs").alias("inputs"))


@query(f"""WITH {_L}, c AS (SELECT 't' || line % 2 AS type, id, [s, o, 'e' || line % 7] AS ents FROM l), w AS (SELECT n_nationkey AS row, 't' || n_nationkey % 2 AS type, ['e' || n_nationkey, 'e' || (n_nationkey + 1) % 7] AS want FROM nation)
SELECT w.type, array_to_string(want, ',') AS entities, min(id) AS found FROM w LEFT JOIN c ON c.type = w.type AND list_has_all(ents, want) GROUP BY row, w.type, want""")
def expected_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected cases, each with a case that names all its entities."""
    n, name = F.col("n_nationkey"), lambda x: F.concat(F.lit("e"), x.cast("string"))
    want = table(spark, sf_dir, "nation").select(F.concat(F.lit("t"), (n % 2).cast("string")).alias("type"), F.array(name(n), name((n + 1) % 7)).alias("entities"))
    cases = links(spark, sf_dir).select(F.concat(F.lit("t"), (F.col("line") % 2).cast("string")).alias("type"), "id", F.array("s_entity", "o_entity", name(F.col("line") % 7)).alias("entities"))
    return research.expected_cases(want, cases).withColumn("entities", _ids("entities"))


@query(f"""WITH {_L}, p AS (SELECT id, 'd' || line % 3 AS d FROM l WHERE line % 4 <> 0), s AS (SELECT id, 'd' || line % 2 AS d, status FROM l WHERE line % 5 <> 0)
SELECT coalesce(p.id, s.id) AS id, CASE WHEN s.d IS NULL THEN 'created' WHEN p.d IS NULL THEN CASE WHEN status = 'proposed' THEN 'deleted' ELSE 'stale' END WHEN p.d = s.d THEN 'unchanged' ELSE 'updated' END AS outcome FROM p FULL JOIN s USING (id)""")
def check_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What storing the cases of a new run of checks does to those stored."""
    own = links(spark, sf_dir)
    name = lambda k: F.concat(F.lit("d"), (F.col("line") % k).cast("string")).alias("digest")
    return incremental.persist_checks(own.where("line % 4 <> 0").select("id", name(3)), own.where("line % 5 <> 0").select("id", name(2), "status"))


@query(f"""WITH {_L}, r AS (SELECT note AS id, min(status) AS status, list_sort(list(id)) AS inputs FROM l WHERE line % 3 = 0 GROUP BY note), p AS (SELECT note AS id, list_sort(list(id)) AS inputs FROM l WHERE line % 3 = 0 OR note IN ('n2', 'n3', 'n9') GROUP BY note)
SELECT p.id, CASE WHEN r.status IS NULL THEN 'proposed' WHEN r.status IN ('accepted', 'deferred') AND r.inputs <> p.inputs THEN 'stale' ELSE r.status END AS status, CASE WHEN r.status IS NULL THEN 'created' WHEN r.inputs <> p.inputs THEN 'updated' ELSE 'unchanged' END AS outcome FROM p LEFT JOIN r USING (id)""")
def written_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written again: reviews stay, accepted ones with other inputs are stale."""
    own = links(spark, sf_dir)
    stored = own.where("line % 3 = 0").groupBy(F.col("note").alias("id")).agg(F.min("status").alias("status"), F.collect_list("id").alias("inputs"))
    produced = own.where("line % 3 = 0 OR note IN ('n2', 'n3', 'n9')").groupBy(F.col("note").alias("id")).agg(F.collect_list("id").alias("inputs"))
    return evidence.write_records(stored, produced)


@query(f"""WITH {_L}, f AS (SELECT id, list_filter([CASE WHEN confidence < 0.6 THEN 'low confidence' END, CASE WHEN line % 3 <> 0 THEN 'passage not exact' END, CASE WHEN line % 2 = 0 THEN 'inferred effect' END, CASE WHEN line % 4 = 0 THEN 'no context' END, CASE WHEN study = 's1' THEN 'study unknown' END], lambda x: x IS NOT NULL) AS f FROM l)
SELECT id, array_to_string(f, ',') AS flags FROM f""")
def uncertainty_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = links(spark, sf_dir)
    claims = own.select("id", "confidence", F.when(F.col("line") % 3 == 0, "exact").otherwise("fuzzy 0.90").alias("match"), (F.col("line") % 2 == 0).alias("assumed"), F.create_map(F.lit("species"), F.when(F.col("line") % 4 != 0, "mouse")).alias("context"), F.when(F.col("study") == "s1", F.concat(F.lit("note:"), "note")).otherwise(F.col("study")).alias("study"))
    return research.uncertainty(claims).withColumn("flags", _ids("flags"))


@query("""SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 0 THEN 'doi:10.1/' || n_nationkey WHEN n_nationkey % 4 = 1 THEN 'study:' || replace(replace(lower(trim(n_name)), ' ', '-'), '_', '-') || '-2001' ELSE 'note:n' || n_nationkey END AS study FROM nation""")
def study_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study that a note reports: an identifier, else its label, else the note itself."""
    n, k = F.col("n_nationkey"), F.col("n_nationkey").cast("string")
    doi, label = F.when(n % 4 == 0, F.concat(F.lit("10.1/"), k)), F.when(n % 4 == 1, F.concat("n_name", F.lit(" et al. (a review) 2001")))
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "nation").select(n.alias("id"), study_id(doi, none, none, none, label, F.concat(F.lit("n"), k)).alias("study"))


@query("""WITH c AS (SELECT 'c-' || left(sha256(doc_id::VARCHAR), 10) AS id, doc_id FROM documents WHERE doc_id % 3 = 0) SELECT doc_id AS report, id FROM c""")
def claim_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that a report names: here each report names its own, twice, and one that doesn't exist."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("c-"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 10))
    reports = docs.select(F.col("doc_id").alias("report"), F.concat_ws(" ", "text", name, F.lit("and"), name, F.lit("not c-0000000000")).alias("text"))
    return evidence.mentions(reports, docs.where("doc_id % 3 = 0").select(name.alias("id")))


@query("SELECT conv_id, turn, length(role) + length(text) AS chars, (length(text) // 4)::BIGINT AS tokens FROM conversations")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("role") + F.length("text")).cast("long").alias("chars"), evidence.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0)")
def knowledge_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known about notes that still exist (here every fourth is gone)."""
    notes = table(spark, sf_dir, "documents").where("doc_id % 4 <> 0").select(F.col("doc_id").alias("id"))
    return evidence.collect_garbage(table(spark, sf_dir, "labels").select("doc_id", "quality"), notes, "doc_id")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_nationkey % 5 = 0 OR s_acctbal < 1000")
def topics_to_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") >= 1000, "said").alias("synopsis"), (F.col("s_nationkey") % 5 == 0).alias("stale"))
    return evidence.naming_todo(topics).select("id")


@query("""WITH d AS (SELECT p_name AS name, row_number() OVER (ORDER BY p_name) - 1 AS k FROM (SELECT DISTINCT p_name FROM part)) SELECT (k // 400)::INT AS chunk, count(*) AS n, left(sha256(string_agg(name, ',' ORDER BY name)), 10) AS signature FROM d GROUP BY 1""")
def name_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.name_chunks(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))


@query("""WITH g AS (SELECT o_orderkey AS id, 'f' AS field, nullif(lower(trim(o_orderpriority)), '') AS v FROM orders WHERE o_orderkey % 3 <> 0), f AS (SELECT o_orderkey AS id, 'f' AS field, nullif(lower(CASE WHEN o_orderkey % 2 = 0 THEN left(o_orderpriority, 3) ELSE o_orderstatus END), '') AS v FROM orders WHERE o_orderkey % 5 <> 0)
SELECT count(*) FILTER (contains(g.v, f.v) OR contains(f.v, g.v)) AS "right", count(*) FILTER (NOT (contains(g.v, f.v) OR contains(f.v, g.v))) AS wrong, count(*) FILTER (g.v IS NULL) AS invented, count(*) FILTER (f.v IS NULL) AS missed FROM g FULL JOIN f USING (id, field)""")
def gold_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context values against a gold set: right, wrong, invented, missed."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id").withColumn("field", F.lit("f"))
    gold = o.where("id % 3 <> 0").select("id", "field", F.col("o_orderpriority").alias("value"))
    found = o.where("id % 5 <> 0").select("id", "field", F.when(F.col("id") % 2 == 0, F.substring("o_orderpriority", 1, 3)).otherwise(F.col("o_orderstatus")).alias("value"))
    return evidence.context_scores(gold, found)


@query("""WITH u AS (SELECT l_returnflag AS level FROM lineitem GROUP BY 1), s AS (SELECT 0 AS idx, 'A' AS id UNION ALL SELECT 1, 'N' UNION ALL SELECT 2, 'X') SELECT idx, id, id IN (SELECT level FROM u) AS used FROM s""")
def scale_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which scales of the framework a reading passes."""
    paths = table(spark, sf_dir, "lineitem").select(F.array("l_returnflag").alias("levels"))
    return research.coverage(paths, spark.createDataFrame([(0, "A"), (1, "N"), (2, "X")], "idx int, id string"))


@query("SELECT doc_id AS id, left(text, 20) || chr(10) AS body FROM documents WHERE text IS NOT NULL")
def case_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's text without what reviewers noted under it."""
    body = F.concat(F.substring("text", 1, 20), F.lit("\n"), F.lit(evidence.NOTES_MARK), F.lit(" -->\nmine"))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), evidence.case_text(body).alias("body"))
