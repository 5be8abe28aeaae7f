"""Queries that apply the operators to the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ACCENTS, STOP_WORDS, content_hash, norm_name
from ..operators import graph, incremental, lookup, research, search, similarity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- text, search, similarity ----------------------------------------------------------------------------------------

_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
_TERMS = rf"""
tok AS (SELECT doc_id, trim(unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9\-'']+')), '-''') AS w FROM documents),
kept AS (SELECT doc_id, w, length(w) AS n FROM tok WHERE length(w) >= 3 AND w NOT IN ({_STOPS})),
term AS (SELECT doc_id, CASE
  WHEN w LIKE '%ies' AND n >= 6 THEN left(w, n - 3) || 'y'
  WHEN w LIKE '%sses' AND n >= 7 THEN left(w, n - 2)
  WHEN w LIKE '%ing' AND n >= 6 THEN left(w, n - 3)
  WHEN w LIKE '%edly' AND n >= 7 THEN left(w, n - 4)
  WHEN w LIKE '%ed' AND n >= 5 THEN left(w, n - 2)
  WHEN w LIKE '%es' AND n >= 5 THEN CASE WHEN w LIKE '%ches' OR w LIKE '%shes' OR w LIKE '%xes' OR w LIKE '%zes' THEN left(w, n - 2) ELSE left(w, n - 1) END
  WHEN w LIKE '%s' AND n >= 4 THEN left(w, n - 1)
  ELSE w END AS term FROM kept),
tf AS (SELECT doc_id, term, count(*) AS tf FROM term GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
cnt AS (SELECT count(*) AS n FROM documents)"""
_POSTINGS = f"""{_TERMS},
v AS (SELECT doc_id, term, df, n, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1.0) AS v FROM tf JOIN df USING (term), cnt),
post AS (SELECT doc_id, term, df, n, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS w FROM v)"""
_SIMILAR = f"""{_POSTINGS},
c AS (SELECT * FROM post WHERE df <= greatest(2, floor(n * 0.5))),
half AS (SELECT x.doc_id AS a, y.doc_id AS b, round(sum(x.w * y.w), 6) AS score, sum(x.w * y.w) AS raw FROM c x JOIN c y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY ALL),
both_ AS (SELECT a AS src, b AS dst, score FROM half WHERE raw >= 0.12 UNION ALL SELECT b, a, score FROM half WHERE raw >= 0.12),
sim AS (SELECT src, dst, score, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM both_ QUALIFY rank <= 6)"""

_SEARCH = "license version the"


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's lines stand for its sections, its source for the title, its language for the tags."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("note_id"), F.posexplode(F.split("text", "\n")).alias("pos", "body"), F.col("source").alias("title"), F.lit("").alias("heading"), F.col("lang").alias("tags"))


def _bm25_sql() -> str:
    words = search.query_terms(_SEARCH)
    cols = {"title": "source", "heading": "''", "body": "body", "tags": "lang"}
    tok = ", ".join(f"regexp_extract_all(translate(lower({v}), '{ACCENTS[0]}', '{ACCENTS[1]}'), '[\\p{{L}}\\p{{N}}_]+') AS {k}" for k, v in cols.items())
    hit = lambda q, last: f"starts_with(t, '{q}')" if last else f"t = '{q}'"
    f = ", ".join(" + ".join(f"len(list_filter({c}, lambda t: {hit(q, i == len(words) - 1)})) * {w}::DOUBLE" for c, w in search.WEIGHTS.items()) + f" AS f{i}" for i, q in enumerate(words))
    n = ", ".join(f"count_if(f{i} > 0) AS n{i}" for i in range(len(words)))
    score = " + ".join(
        f"CASE WHEN f{i} > 0 THEN CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0.0 END"
        for i in range(len(words))
    )
    some = " OR ".join(f"f{i} > 0" for i in range(len(words)))
    return f"""
WITH l AS (SELECT doc_id, source, lang, string_split(text, chr(10)) AS ls FROM documents),
s AS (SELECT doc_id AS note_id, i - 1 AS pos, source, lang, ls[i] AS body FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM l)),
t AS (SELECT note_id, pos, {tok} FROM s),
c AS (SELECT note_id, pos, len(title) + len(heading) + len(body) + len(tags) AS dl, {f} FROM t),
g AS (SELECT count(*) AS n, avg(dl) AS avgdl, {n} FROM c),
sc AS (SELECT note_id, pos, round({score}, 6) AS score FROM c, g WHERE {some}),
best AS (SELECT * FROM sc ORDER BY score DESC, note_id, pos LIMIT 80),
r AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY score DESC, pos) AS rn FROM best)
SELECT note_id, round(sum(CASE WHEN rn = 1 THEN score ELSE score * 0.25 END), 6) AS score, min(CASE WHEN rn = 1 THEN pos END)::INT AS best
FROM r GROUP BY note_id ORDER BY score DESC, note_id LIMIT 10"""


@query(_bm25_sql())
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return search.search(_sections(spark, sf_dir), notes, _SEARCH)


@query(f"WITH {_TERMS} SELECT term, df, round(ln((1 + n) / (1 + df)) + 1.0, 6) AS idf FROM df, cnt")
def token_df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = docs.agg(F.count("*").alias("n"))
    df = similarity.document_frequency(similarity.term_counts(docs))
    return df.join(F.broadcast(n)).select("term", "df", F.round(similarity.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"WITH {_POSTINGS}, s AS (SELECT lang AS grp, term, round(sum(w), 6) AS weight FROM post JOIN documents USING (doc_id) GROUP BY ALL) SELECT grp, term, weight, row_number() OVER (PARTITION BY grp ORDER BY weight DESC, term)::INT AS rank FROM s QUALIFY rank <= 5")
def top_terms_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return similarity.top_terms(similarity.postings(docs), docs.select(F.col("doc_id").alias("doc"), F.col("lang").alias("grp")))


@query(f"WITH {_SIMILAR} SELECT src, dst, score, rank::INT AS rank FROM sim")
def tfidf_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_documents(table(spark, sf_dir, "documents"))


@query(f"WITH {_SIMILAR} SELECT src, dst, score FROM sim WHERE score >= 0.6 AND src < dst ORDER BY score DESC, src, dst LIMIT 20")
def possible_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.possible_duplicates(tfidf_neighbors(spark, sf_dir))


@query(r"""WITH h AS (SELECT doc_id, left(sha256(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')), 16) AS content_hash FROM documents)
SELECT content_hash, count(*) AS n, min(doc_id) AS first FROM h GROUP BY content_hash HAVING count(*) > 1""")
def content_hash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.hash_duplicates(table(spark, sf_dir, "documents"))


_LOCATE = r"""WITH d AS (SELECT doc_id, text, lower(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
b AS (SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS q FROM benchmark)
SELECT item_id, doc_id, instr(t, q)::INT AS at, left(sha256(q), 16) AS hash FROM b JOIN d ON contains(t, q) WHERE q <> ''"""


@query(_LOCATE)
def passage_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return lookup.locate_passages(table(spark, sf_dir, "documents"), quotes)


# --- pages: links ------------------------------------------------------------------------------------------------------

_LINKS = r"""l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages),
home AS (SELECT regexp_extract(url, '^https?://[^/]+(/[^/?#]*)', 1) AS path, min(page_id) AS dst FROM pages GROUP BY 1),
links AS (SELECT page_id AS src, dst, target FROM l LEFT JOIN home ON target = path AND path <> '')"""


def _page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    links = pages.select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    home = pages.groupBy(F.regexp_extract("url", r"^https?://[^/]+(/[^/?#]*)", 1).alias("path")).agg(F.min("page_id").alias("dst")).where("path <> ''")
    return links.join(home, F.col("target") == F.col("path"), "left").select("src", "dst", "target")


@query(f"WITH {_LINKS} SELECT DISTINCT src, coalesce(dst, -1) AS dst, target FROM links")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_links(spark, sf_dir).distinct().withColumn("dst", F.coalesce("dst", F.lit(-1)))


@query(f"WITH {_LINKS} SELECT src, target, count(*) AS n FROM links WHERE dst IS NULL GROUP BY ALL")
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.broken_links(_page_links(spark, sf_dir)).groupBy("src", "target").agg(F.count("*").alias("n"))


@query(f"WITH {_LINKS} SELECT page_id AS id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM links WHERE dst = p.page_id AND src <> dst) AND NOT EXISTS (SELECT 1 FROM links WHERE src = p.page_id AND dst IS NOT NULL AND dst <> src)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.orphans(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id")), _page_links(spark, sf_dir))


@query(f"WITH {_LINKS} SELECT dst, src FROM links WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL")
def backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.backlinks(_page_links(spark, sf_dir))


@query(f"WITH {_LINKS} SELECT (SELECT count(*) FROM pages) AS notes, (SELECT count(*) FROM links) AS links, (SELECT count(*) FROM links WHERE dst IS NULL) AS broken, (SELECT count(DISTINCT dst) FROM links) AS linked")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.index_stats(table(spark, sf_dir, "pages"), _page_links(spark, sf_dir))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest([lang, source]) AS tag FROM documents) GROUP BY tag ORDER BY n DESC, tag LIMIT 25")
def tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.tag_histogram(table(spark, sf_dir, "documents").select(F.array("lang", "source").alias("tags")))


@query("SELECT conv_id, m.turn AS mark, c.turn AS turn, c.text AS text FROM conversations c JOIN (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id) m USING (conv_id) WHERE abs(c.turn - m.turn) <= 2")
def read_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    marks = turns.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("mark"))
    return lookup.excerpt(turns.select("conv_id", "turn", "text"), marks, "conv_id", "turn", 2)


@query("SELECT doc_id AS id, source AS topic, n_chars AS rank FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def list_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("topic"), F.col("n_chars").alias("rank"))
    return lookup.list_notes(docs)


# --- the trade graph ---------------------------------------------------------------------------------------------------

_TRADE = """f AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY ALL),
flow AS (SELECT * FROM f),
edge AS (SELECT src, dst, sum(w)::DOUBLE AS w FROM (SELECT src, dst, w FROM flow UNION ALL SELECT dst, src, w FROM flow) GROUP BY ALL)"""


#: The strongest partners only: what paths and cycles are enumerated over, as the whole graph joins every pair of nations.
_BACKBONE = _TRADE.replace("SELECT * FROM f)", "SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) <= 3)")


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items from each supplier nation to each customer nation."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_suppkey").join(t("supplier").select("s_suppkey", F.col("s_nationkey").alias("src")), F.col("l_suppkey") == F.col("s_suppkey"))
    bought = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", F.col("c_nationkey").alias("dst")), F.col("o_custkey") == F.col("c_custkey"))
    return lines.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))


def _backbone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier nation's three strongest customer nations."""
    return _flow(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))).where("rn <= 3").drop("rn")


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.accumulate_edges(_flow(spark, sf_dir))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("community"))


@query(f"WITH {_TRADE} SELECT src, dst, w FROM edge")
def trade_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir)


def _pagerank_sql() -> str:
    step = """r{i} AS MATERIALIZED (SELECT id, 0.15 / c.n + 0.85 * (coalesce(g, 0) + loose / c.n) AS rank FROM nodes, c, (SELECT coalesce(sum(rank), 0) AS loose FROM r{j} WHERE id NOT IN (SELECT src FROM flow))
    LEFT JOIN (SELECT dst, sum(rank / n_out) AS g FROM flow JOIN o USING (src) JOIN r{j} ON id = src GROUP BY dst) ON dst = id)"""
    rounds = ",\n".join(step.format(i=i, j=i - 1) for i in range(1, graph.ROUNDS + 1))
    return f"""WITH {_TRADE.replace("flow AS", "flow AS MATERIALIZED")}, nodes AS (SELECT n_nationkey AS id FROM nation), c AS (SELECT count(*) AS n FROM nodes), o AS (SELECT src, count(*) AS n_out FROM flow GROUP BY src),
r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS rank FROM nodes, c), {rounds} SELECT id, round(rank, 8) AS rank FROM r{graph.ROUNDS}"""


@query(_pagerank_sql())
def pagerank_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(_nations(spark, sf_dir).select("id"), _flow(spark, sf_dir)).select("id", F.round("rank", 8).alias("rank"))


@query(f"""WITH {_TRADE}, g AS (SELECT src, n_regionkey AS r, sum(w) AS wc, count(*) AS nc FROM edge JOIN nation ON dst = n_nationkey GROUP BY ALL),
s AS (SELECT src, sum(wc) AS t, sum(wc * wc) AS q, sum(nc) AS n FROM g GROUP BY src)
SELECT n_nationkey AS id, coalesce(CASE WHEN n < 2 OR t = 0 THEN 0.0 ELSE round(1 - q / (t * t), 6) END, 0.0)::DOUBLE AS bridge FROM nation LEFT JOIN s ON src = n_nationkey""")
def bridge_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bridge_scores(_trade(spark, sf_dir), _nations(spark, sf_dir))


@query(f"""WITH {_TRADE}, s AS (SELECT a.n_regionkey AS grp, b.n_regionkey AS other, round(sum(w), 6) AS weight FROM edge JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey GROUP BY ALL)
SELECT grp, other, weight, row_number() OVER (PARTITION BY grp ORDER BY weight DESC, other)::INT AS rank FROM s QUALIFY rank <= 5""")
def neighbour_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbouring_groups(_trade(spark, sf_dir), _nations(spark, sf_dir))


@query(f"""WITH RECURSIVE {_BACKBONE}, p AS (SELECT 0 AS cur, [0] AS path, []::DOUBLE[] AS k UNION ALL SELECT dst, list_append(path, dst), list_concat(k, [-w, dst::DOUBLE]) FROM p JOIN edge ON src = cur WHERE cur <> 24 AND len(path) <= 6 AND NOT list_contains(path, dst)),
h AS (SELECT * FROM p WHERE cur = 24)
SELECT (len(path) - 1)::BIGINT AS hops, array_to_string(path, '>') AS path FROM h ORDER BY len(path), k LIMIT 1""")
def shortest_path_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_path(graph.accumulate_edges(_backbone(spark, sf_dir)), 0, 24).withColumn("path", F.array_join("path", ">"))


@query()
def louvain_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.louvain(_nations(spark, sf_dir).select("id"), _trade(spark, sf_dir))


_SIGNED = f"{_BACKBONE}, pr AS (SELECT src AS a, dst AS b, CASE WHEN w % 2 = 0 THEN 1 ELSE -1 END AS sign FROM edge WHERE src < dst), e AS (SELECT a, b, sign FROM pr UNION ALL SELECT b, a, sign FROM pr)"


def _signed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.accumulate_edges(_backbone(spark, sf_dir)).where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.when(F.col("w") % 2 == 0, 1).otherwise(-1).alias("sign"))


@query(f"""WITH {_SIGNED} SELECT concat_ws('>', x.a, x.b, y.b) AS nodes, x.sign * y.sign * z.sign AS sign, 3::BIGINT AS length FROM e x JOIN e y ON y.a = x.b JOIN e z ON z.a = x.a AND z.b = y.b WHERE x.a < x.b AND x.b < y.b
UNION ALL SELECT concat_ws('>', x.a, x.b, y.b, z.b), x.sign * y.sign * z.sign * v.sign, 4 FROM e x JOIN e y ON y.a = x.b JOIN e z ON z.a = y.b JOIN e v ON v.a = x.a AND v.b = z.b WHERE x.a < x.b AND y.b > x.a AND z.b > x.b AND y.b <> x.b AND z.b <> y.b AND z.b <> x.a""")
def signed_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.signed_cycles(_signed_pairs(spark, sf_dir)).withColumn("nodes", F.array_join("nodes", ">"))


@query(f"""WITH RECURSIVE {_BACKBONE}, st AS (SELECT src, dst, CASE WHEN w % 2 = 0 THEN 1 ELSE -1 END AS sign, CASE WHEN w % 3 = 0 THEN 'associative' ELSE 'causal' END AS kind FROM flow),
p AS (SELECT 0 AS cur, [0] AS path, 1 AS sign, 0.0::DOUBLE AS wt UNION ALL SELECT dst, list_append(path, dst), p.sign * st.sign, wt + CASE kind WHEN 'causal' THEN 1.0 ELSE 0.5 END FROM p JOIN st ON src = cur WHERE cur <> 7 AND len(path) <= 6 AND NOT list_contains(path, dst))
SELECT array_to_string(path, '>') AS path, sign AS net, round(wt / (len(path) - 1) + 0.15 * len(path) - 0.05 * (len(path) - 1), 6) AS score FROM p WHERE cur = 7""")
def reading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _backbone(spark, sf_dir).select("src", "dst", F.when(F.col("w") % 2 == 0, 1).otherwise(-1).alias("sign"), F.when(F.col("w") % 3 == 0, "associative").otherwise("causal").alias("kind"))
    found = graph.simple_paths(steps, 0, 7)
    return found.select(F.array_join("path", ">").alias("path"), graph.net_sign(F.col("signs")).alias("net"), graph.path_score(F.col("kinds"), F.col("path")).alias("score"))


# --- claims ------------------------------------------------------------------------------------------------------------

#: A small framework: what relations and kinds of evidence mean, and the scales in order.
RELATIONS = [("activates", "causal", 1), ("inhibits", "causal", -1), ("associated_with", "associative", 0), ("encodes", "compositional", 0)]
EVIDENCE = [("intervention", 1.0, True), ("genetic", 0.8, True), ("observational", 0.4, False), ("stated", 0.2, False)]
_rel = ", ".join(f"({i}, '{n}', '{k}', {s})" for i, (n, k, s) in enumerate(RELATIONS))
_ev = ", ".join(f"({i}, '{n}', {w}::DOUBLE, {c})" for i, (n, w, c) in enumerate(EVIDENCE))
_CLAIMS = f"""rel(i, predicate, rk, rs) AS (VALUES {_rel}), ev(i, evidence, weight, sc) AS (VALUES {_ev}),
base AS (SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS id, 'n' || (l_orderkey % 5000)::VARCHAR AS note, 's' || (l_orderkey % 997)::VARCHAR AS study, s_nationkey AS sn, p_brand, l_linenumber, p_size, l_quantity AS q, l_discount AS d, l_tax AS tax,
  CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS es, CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS eo, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
link AS (SELECT id, note, study, n_name AS s, p_brand AS o, least(n_name, p_brand) AS a, greatest(n_name, p_brand) AS b, weight, d AS confidence,
  CASE WHEN es <> 0 AND eo <> 0 THEN es * eo ELSE rs * (CASE es WHEN 0 THEN 1 ELSE es END) * (CASE eo WHEN 0 THEN 1 ELSE eo END) END AS sign,
  CASE WHEN tax > 0.07 THEN 'null' WHEN rk = 'compositional' THEN 'structural' WHEN q < 10 THEN 'hypothesis' WHEN rk = 'causal' AND q < 35 AND sc THEN 'causal' ELSE 'associative' END AS kind,
  es <> 0 AND eo <> 0 AND rs <> 0 AND rs <> es * eo AS disagrees FROM base JOIN rel ON rel.i = l_linenumber % 4 JOIN ev ON ev.i = p_size % 4)"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims read off line items: a supplier's nation acts on a part's brand, an order is the study."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    lines = lines.join(t("part").select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    return lines.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        F.concat(F.lit("n"), (F.col("l_orderkey") % 5000).cast("string")).alias("note"),
        F.concat(F.lit("s"), (F.col("l_orderkey") % 997).cast("string")).alias("study"),
        pick([r[0] for r in RELATIONS], F.col("l_linenumber") % 4).alias("predicate"),
        pick([e[0] for e in EVIDENCE], F.col("p_size") % 4).alias("evidence"),
        F.when(F.col("l_quantity") < 10, "hypothesis").when(F.col("l_quantity") < 35, "causal").otherwise("observation").alias("claim_type"),
        (F.col("l_tax") > 0.07).alias("negated"),
        F.col("l_discount").alias("confidence"),
        F.col("n_name").alias("s_entity"),
        F.when(F.col("l_returnflag") == "A", "increase").when(F.col("l_returnflag") == "R", "decrease").otherwise("").alias("s_direction"),
        F.lit("").alias("s_activity_effect"),
        F.lit("").alias("s_effect_basis"),
        F.col("p_brand").alias("o_entity"),
        F.when(F.col("l_linestatus") == "O", "present").otherwise("").alias("o_direction"),
        F.lit("").alias("o_activity_effect"),
        F.lit("").alias("o_effect_basis"),
    )


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = spark.createDataFrame(RELATIONS, "id string, kind string, sign int")
    evidence = spark.createDataFrame(EVIDENCE, "id string, weight double, supports_causal boolean")
    return research.signed_links(_claims(spark, sf_dir), F.broadcast(relations), F.broadcast(evidence))


@query(f"WITH {_CLAIMS} SELECT id, s AS s_entity, o AS o_entity, sign, kind, disagrees FROM link")
def signed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("id", "s_entity", "o_entity", "sign", "kind", "disagrees")


_SG = "kind IN ('causal', 'associative') AND sign"


@query(f"""WITH {_CLAIMS}, g AS (SELECT a, b, count(DISTINCT id) FILTER ({_SG} > 0) AS p, count(DISTINCT id) FILTER ({_SG} < 0) AS n, count(DISTINCT id) FILTER (kind = 'null') AS z,
  list_sort(list(DISTINCT study) FILTER ({_SG} > 0)) AS sp, list_sort(list(DISTINCT study) FILTER ({_SG} < 0)) AS sn FROM link GROUP BY ALL)
SELECT a, b, 'opposite directions' AS label, p AS n_positive, n AS n_negative, z AS n_null FROM g WHERE p > 0 AND n > 0 AND sp <> sn
UNION ALL SELECT a, b, 'an effect vs no effect', p, n, z FROM g WHERE z > 0 AND p + n > 0""")
def conflicting_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = research.conflicting_results(_links(spark, sf_dir))
    return c.select("a", "b", "label", F.size("positive").cast("long").alias("n_positive"), F.size("negative").cast("long").alias("n_negative"), F.size("no_effect").cast("long").alias("n_null"))


@query(f"""WITH {_CLAIMS} SELECT a, b, sign, count(DISTINCT study) AS n_studies, arg_min(id, (kind <> 'causal', -confidence, id)) AS target, count(DISTINCT id) AS n_inputs
FROM link WHERE {_SG} <> 0 AND weight >= 0.3 GROUP BY a, b, sign HAVING count(DISTINCT study) >= 2""")
def triangulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.triangulation(_links(spark, sf_dir)).select("a", "b", "sign", "n_studies", "target", F.size("inputs").cast("long").alias("n_inputs"))


#: Every pair has a causal claim in these tables: for this check, those whose first name's length is no multiple of 3 are read as associations.
_DEMOTED = "CASE WHEN kind = 'causal' AND length(a) % 3 <> 0 THEN 'associative' ELSE kind END"


@query(f"""WITH {_CLAIMS}, k AS (SELECT a, b, id, {_DEMOTED} AS kind FROM link), lv AS (SELECT e, length(e) AS level FROM (SELECT a AS e FROM link UNION SELECT b FROM link)), top AS (SELECT e FROM lv WHERE level = (SELECT max(level) FROM lv))
SELECT a, b, count(DISTINCT id) FILTER (kind = 'associative') AS n_inputs FROM k WHERE a IN (FROM top) OR b IN (FROM top) GROUP BY a, b HAVING NOT bool_or(kind = 'causal') AND n_inputs > 0""")
def missing_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir).withColumn("kind", F.expr(_DEMOTED))
    levels = links.select(F.explode(F.array("a", "b")).alias("entity")).distinct().withColumn("level", F.length("entity"))
    return research.missing_bridges(links, levels).select("a", "b", F.size("inputs").cast("long").alias("n_inputs"))


@query("""WITH c AS (SELECT user_id AS grp, event_id, event_type AS f1, CASE WHEN value < 5 THEN NULL ELSE (value > 10)::VARCHAR END AS f2 FROM events),
m AS (SELECT grp, count(DISTINCT lower(f1)) > 1 AS m1, count(DISTINCT f2) > 1 AS m2, bool_or(f1 IS NULL) AS u1, bool_or(f2 IS NULL) AS u2 FROM c GROUP BY grp)
SELECT grp, CASE WHEN m1 OR m2 THEN 'mismatch' WHEN u1 OR u2 THEN 'unknown' ELSE 'compatible' END AS verdict,
concat_ws(',', CASE WHEN m1 THEN 'kind' END, CASE WHEN m2 THEN 'size' END) AS mismatched, concat_ws(',', CASE WHEN u1 THEN 'kind' END, CASE WHEN u2 THEN 'size' END) AS unknown FROM m""")
def context_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("size"), F.when(F.col("value") >= 5, (F.col("value") > 10).cast("string")))
    groups = table(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("claim"), context.alias("context"))
    return research.context_compare(groups, ("kind", "size")).select("grp", "verdict", F.array_join("mismatched", ",").alias("mismatched"), F.array_join("unknown", ",").alias("unknown"))


@query("""WITH v AS (SELECT p_brand AS entity, p_type AS id, sum(p_size) AS n FROM part WHERE p_size % 7 <> 0 GROUP BY ALL), s AS (SELECT p_type AS id, row_number() OVER (ORDER BY p_type)::INT - 1 AS idx FROM (SELECT DISTINCT p_type FROM part)),
r AS (SELECT entity, string_agg(id, ',' ORDER BY n DESC, idx) AS scales, arg_min(idx, (-n, idx)) AS level FROM v JOIN s USING (id) GROUP BY entity)
SELECT DISTINCT p_brand AS entity, coalesce(scales, 'unmapped') AS scales, coalesce(level, -1)::INT AS level FROM part LEFT JOIN r ON entity = p_brand""")
def scale_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    scales = part.select(F.col("p_type").alias("id")).distinct().withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("id")) - 1)
    mappings = part.select(F.col("p_brand").alias("entity"), F.array("p_type").alias("scales"), F.col("p_size").alias("votes"), F.when(F.col("p_size") % 7 == 0, "rejected").otherwise("proposed").alias("status"))
    return research.entity_scales(mappings, scales, part.select(F.col("p_brand").alias("entity"))).select("entity", F.array_join("scales", ",").alias("scales"), "level")


@query(r"""SELECT p_partkey AS id, coalesce(c.s_name, p_name) AS name FROM (SELECT p_partkey, 'Supplier ' || (p_partkey % 150)::VARCHAR AS p_name, regexp_replace(lower('Supplier ' || (p_partkey % 150)::VARCHAR), '[^a-z0-9]+', '', 'g') AS k FROM part) p
LEFT JOIN (SELECT s_name, 'supplier' || s_suppkey::VARCHAR AS k FROM supplier WHERE s_nationkey <> 3) c USING (k)""")
def alias_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Supplier "), (F.col("p_partkey") % 150).cast("string")).alias("name"))
    s = table(spark, sf_dir, "supplier")
    entities = s.select(F.col("s_name").alias("canonical"), F.array(F.concat(F.lit("SUPPLIER-"), F.col("s_suppkey").cast("string"))).alias("aliases"), F.when(F.col("s_nationkey") == 3, "rejected").otherwise("accepted").alias("status"), F.col("s_suppkey").alias("pos"))
    return research.canonical_names(names, entities, "name")


# --- snapshots ---------------------------------------------------------------------------------------------------------


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0")
def todo_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), content_hash(F.col("text")).alias("hash"))
    stored = docs.where("id % 5 <> 0").withColumn("hash", F.when(F.col("id") % 7 == 0, "old").otherwise(F.col("hash")))
    return incremental.todo(docs, stored, "id", "hash").select("id")


@query("SELECT user_id, event_type, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id")).select("user_id", "event_type", "at", "ts", "value", "event_id")
    done = incremental.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "at")
    return done.select("user_id", "event_type", "ts", "value")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents before and after: of those whose text nobody shares, every 9th is gone, every 11th has a new id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"), content_hash(F.col("text")).alias("hash"))
    single = docs.join(docs.groupBy("hash").agg(F.count("*").alias("n")).where("n = 1"), "hash")
    before = single.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "hash")
    after = single.where("doc_id % 9 <> 0").select(F.concat(F.when(F.col("doc_id") % 11 == 0, "r").otherwise("d"), F.col("doc_id").cast("string")).alias("id"), "hash", "text")
    return before, after


_ONCE = "one AS (SELECT doc_id, text FROM documents QUALIFY count(*) OVER (PARTITION BY text) = 1)"


@query(f"WITH {_ONCE} SELECT 'd' || doc_id AS old_id, 'r' || doc_id AS new_id FROM one WHERE doc_id % 9 <> 0 AND doc_id % 11 = 0")
def rename_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _snapshots(spark, sf_dir)
    return incremental.renames(before, after)


@query(f"""WITH {_ONCE} SELECT 'c' || doc_id AS id, CASE WHEN doc_id % 9 <> 0 AND doc_id % 11 = 0 THEN 'r' ELSE 'd' END || doc_id AS note,
CASE WHEN doc_id % 9 = 0 THEN CASE WHEN doc_id % 4 = 0 THEN 'rejected' ELSE 'source_missing' END WHEN doc_id % 2 = 1 AND doc_id % 4 <> 0 THEN 'stale' WHEN doc_id % 4 = 0 THEN 'rejected' ELSE 'proposed' END AS status FROM one""")
def snapshot_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _snapshots(spark, sf_dir)
    texts = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("note"), "text", "doc_id")
    claims = before.join(texts, F.col("id") == F.col("note")).select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"),
        "note",
        F.when(F.col("doc_id") % 2 == 1, "earlier").otherwise(F.col("hash")).alias("note_revision"),
        F.when(F.col("doc_id") % 4 == 0, "rejected").otherwise("proposed").alias("status"),
        F.concat(F.lit("no such passage "), F.col("note")).alias("passage"),
    )
    return incremental.sync_claims(claims, before, after).select("id", "note", "status")


@query("""SELECT o_orderkey AS id, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS dead FROM orders JOIN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING bool_and(l_returnflag = 'R')) ON l_orderkey = o_orderkey
WHERE o_orderstatus <> 'F' GROUP BY o_orderkey""")
def stale_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_orderkey", "l_linenumber").alias("id"), "l_returnflag")
    claims = lines.select("id", F.when(F.col("l_returnflag") == "R", "stale").otherwise("accepted").alias("status"))
    inputs = lines.groupBy("l_orderkey").agg(F.collect_list("id").alias("inputs"))
    records = table(spark, sf_dir, "orders").join(inputs, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("accepted").alias("status"), "inputs")
    found = incremental.stale_records(records, claims)
    return found.select("id", F.array_join(F.sort_array(F.array_distinct(F.transform("dead", lambda x: x["l_linenumber"].cast("string")))), ",").alias("dead"))


@query("""SELECT doc_id AS id, CASE WHEN quality = 1 AND doc_id % 3 = 0 THEN 'accepted' WHEN toxic = 1 OR doc_id % 2 = 0 THEN 'proposed' ELSE 'rejected' END AS status FROM labels
WHERE toxic = 1 OR doc_id % 2 = 0 OR (quality = 1 AND doc_id % 3 = 0)""")
def merged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    existing = labels.select("id", F.when((F.col("quality") == 1) & (F.col("id") % 3 == 0), "accepted").otherwise("proposed").alias("status"))
    return incremental.merge_claims(existing, labels.where("toxic = 1 OR id % 2 = 0").select("id", F.lit("proposed").alias("status")))


@query("""WITH g AS (SELECT doc_id, toxic FROM labels), p AS (SELECT doc_id, (regexp_matches(lower(text), 'idiot|stupid|loser|moron|trash'))::INT AS toxic FROM documents JOIN labels USING (doc_id)),
m AS (SELECT count(*) AS m FROM (SELECT * FROM g WHERE toxic = 1 INTERSECT SELECT * FROM p WHERE toxic = 1)),
n AS (SELECT m, (SELECT count(*) FROM g WHERE toxic = 1) AS gold, (SELECT count(*) FROM p WHERE toxic = 1) AS extracted FROM m)
SELECT gold, extracted, m AS matched, round(m / nullif(extracted, 0), 3) AS precision, round(m / nullif(gold, 0), 3) AS recall FROM n""")
def gold_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    guess = table(spark, sf_dir, "documents").join(labels.select("doc_id"), "doc_id").where(F.lower("text").rlike("idiot|stupid|loser|moron|trash")).select("doc_id", F.lit(1).alias("toxic"))
    return research.gold_scores(labels.where("toxic = 1"), guess, ["doc_id", "toxic"])


@query("SELECT source AS grp, 't-' || source AS old, round(count(*) FILTER (doc_id % 7 <> 0) / count(*), 6) AS jaccard, count(*) FILTER (doc_id % 7 <> 0) / count(*) < 0.8 AS stale FROM documents GROUP BY source HAVING count(*) FILTER (doc_id % 7 <> 0) / count(*) >= 0.4")
def topic_jaccard_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    groups = docs.select(F.col("source").alias("grp"), F.col("doc_id").alias("member"))
    previous = docs.where("doc_id % 7 <> 0").select(F.concat(F.lit("t-"), F.col("source")).alias("topic"), F.col("doc_id").alias("member"))
    return incremental.reuse_topics(groups, previous)


@query(r"SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS key FROM part")
def normalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), norm_name(F.col("p_name")).alias("key"))


from . import evidence_queries, note_queries, page_queries  # noqa: E402, F401 - they register their queries
