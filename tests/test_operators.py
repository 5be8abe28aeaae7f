import collections
import random
import math
import os

import pytest

import __spark_entry__
from quillspark.functions import text
from quillspark.operators import graph, incremental, lookup, research, search, similarity
from pyspark.sql import functions as F


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(expr.alias("x")).first().x


def test_terms_and_names(spark):
    assert one(spark, text.terms(F.col("a")), a="Studies of the running dogs' boxes, and notes: classes re-used.") == ["study", "runn", "dog", "box", "class", "re-us"]
    assert one(spark, text.norm_name(F.col("a")), a=" TGF-β 1 ") == "tgfbeta1"
    assert one(spark, text.slug(F.col("a")), a="  A  b_c! ") == "a-b-c" and one(spark, text.slug(F.col("a")), a="!?") == "untitled"
    assert one(spark, text.study_id(*[F.lit(None).cast("string")] * 4, F.lit("Lee et al. (2021)"), F.lit("n")), a="") == "study:lee"


def test_pagerank_small_and_joined_agree(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    edges = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "d"), ("d", "a"), ("a", "c"), ("d", "d")], "src string, dst string")
    small = {r.id: r.rank for r in graph.pagerank(nodes, edges, rounds=10).collect()}
    joined = {r.id: r.rank for r in graph.pagerank(nodes, edges, rounds=10, small_edges=0).collect()}
    assert small.keys() == joined.keys() and all(math.isclose(small[k], joined[k]) for k in small)
    assert small["c"] > small["a"] > small["b"] and math.isclose(sum(small.values()), 1)


def _cliques():
    out = {}
    for g in ("abcd", "wxyz"):
        for i in g:
            for j in g:
                if i != j:
                    out.setdefault(i, {})[j] = 1.0
    out["d"]["w"] = out["w"]["d"] = 0.2
    out["lone"] = {}
    return out


def test_louvain_splits_two_cliques(spark):
    adjacency = _cliques()
    edges = spark.createDataFrame([(a, b, w) for a, ns in adjacency.items() for b, w in ns.items()], "src string, dst string, w double")
    nodes = spark.createDataFrame([(v,) for v in adjacency], "id string")
    found = graph.louvain(nodes, edges)
    of = {r.id: r.community for r in found.collect()}
    assert len({of[v] for v in "abcd"}) == 1 and len({of[v] for v in "wxyz"}) == 1 and len(set(of.values())) == 3
    assert of["lone"] == 2 and {of["a"], of["w"]} == {0, 1} and of["a"] < of["w"]
    bridge = {r.id: r.bridge for r in graph.bridge_scores(edges, found).collect()}
    assert bridge["d"] > bridge["a"] == 0 and bridge["lone"] == 0
    path = graph.shortest_path(edges, "a", "z").first()
    assert path.hops == 4 - 1 + 0 and path.path[0] == "a" and path.path[-1] == "z" and path.path[1:3] == ["d", "w"]
    assert graph.shortest_path(edges, "a", "lone").count() == 0


def modularity(edges, of):
    total = sum(w for _, _, w in edges)
    inside = sum(w for a, b, w in edges if of[a] == of[b])
    by = collections.defaultdict(float)
    for a, _, w in edges:
        by[of[a]] += w
    return inside / total - sum((x / total) ** 2 for x in by.values())


def test_louvain_is_a_local_optimum(spark):
    """No single node gains by moving to a neighbour's community; components never share one."""
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(k * 20, k * 20 + 20), 2))): rng.choice([0.5, 1.0, 2.0]) for k in range(3) for _ in range(60)}
    edges = [(a, b, w) for (a, b), w in pairs.items()] + [(b, a, w) for (a, b), w in pairs.items()]
    found = graph.louvain(spark.createDataFrame([(i,) for i in range(61)], "id long"), spark.createDataFrame(edges, "src long, dst long, w double"))
    of = {r.id: r.community for r in found.collect()}
    assert len(of) == 61 and list(of.values()).count(of[60]) == 1 and all(of[a] != of[b] for a in range(20) for b in range(20, 60))
    best = modularity(edges, of)
    assert best > 0.5
    roots = {r.id: r.root for r in graph.connected(spark.createDataFrame([(i,) for i in range(61)], "id long"), spark.createDataFrame(edges, "src long, dst long, w double")).collect()}
    assert all(roots[a] == roots[b] for a, b, _ in edges) and roots[60] == 60 and all(roots[i] <= i for i in roots)


def test_cycles(spark):
    pairs = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("a", "c", -1)], "a string, b string, sign int")
    assert [(r.nodes, r.sign) for r in graph.signed_cycles(pairs).collect()] == [(["a", "b", "c"], -1)]
    assert graph.signed_cycles(pairs, max_cycles=0).count() == 0


def test_neighbours(spark):
    docs = spark.createDataFrame([("a", "apple banana banana"), ("b", "apple banana"), ("c", "cherry plum")], "doc_id string, text string")
    rows = similarity.neighbours(similarity.postings(docs)).collect()
    assert {(r.src, r.dst) for r in rows} == {("a", "b"), ("b", "a")}


def test_search_filters_after_the_cut(spark):
    sections = spark.createDataFrame([("n1", 0, "Caffeine", "", "blocks adenosine receptors", "sleep"), ("n2", 0, "Sleep", "", "sleep and memory", "sleep"), ("n1", 1, "Caffeine", "Dose", "a dose", "")], "note_id string, pos int, title string, heading string, body string, tags string")
    notes = spark.createDataFrame([("n1", ["x"], False), ("n2", ["y"], True)], "id string, tags array<string>, generated boolean")
    assert [r.note_id for r in search.search(sections, notes, "caffeine aden").collect()][0] == "n1"
    assert search.search(sections, notes, "caffeine", tag="y").count() == 0
    assert search.search(sections, notes, "  ").count() == 0
    assert search.search(sections, notes, "blocked receptor sleeping", stem=True).count() == 2


def test_find_note(spark):
    notes = spark.createDataFrame([("a/One", "First", ["uno"]), ("b/Two", "One", [])], "id string, title string, aliases array<string>")
    assert [lookup.find_note(notes, n).first().id for n in ("a/One", "b/two", "one", "UNO", "[[b/Two|x]]")] == ["a/One", "b/Two", "b/Two", "a/One", "b/Two"]


def _claims(spark, rows):
    cols = "id string, note string, study string, predicate string, claim_type string, evidence string, negated boolean, confidence double, s_entity string, s_direction string, s_activity_effect string, s_effect_basis string, o_entity string, o_direction string, o_activity_effect string, o_effect_basis string"
    return spark.createDataFrame(rows, cols)


def test_links_and_checks(spark):
    relations = spark.createDataFrame([("activates", "causal", 1), ("associated_with", "associative", 0)], "id string, kind string, sign int")
    evidence = spark.createDataFrame([("intervention", 1.0, True), ("stated", 0.2, False)], "id string, weight double, supports_causal boolean")
    rows = [
        ("c1", "n1", "s1", "activates", "causal", "intervention", False, 0.9, "A", "increase", "", "", "B", "increase", "", ""),
        ("c2", "n2", "s2", "activates", "causal", "stated", False, 0.9, "A", "present", "decrease", "inferred", "B", "increase", "", ""),
        ("c3", "n3", "s3", "activates", "causal", "intervention", True, 0.9, "A", "", "", "", "B", "", "", ""),
        ("c4", "n4", "s4", "activates", "causal", "intervention", False, 0.5, "A", "", "", "", "B", "", "", ""),
        ("c5", "n5", "s5", "associated_with", "observation", "intervention", False, 0.5, "B", "increase", "", "", "C", "decrease", "", ""),
    ]
    links = research.signed_links(_claims(spark, rows), relations, evidence)
    got = {r.id: (r.kind, r.sign, r.disagrees, r.demoted, r.assumed) for r in links.collect()}
    assert got == {"c1": ("causal", 1, False, False, False), "c2": ("associative", -1, True, True, True), "c3": ("null", 1, False, False, False), "c4": ("causal", 1, False, False, False), "c5": ("associative", -1, False, False, False)}
    assert {r.label for r in research.conflicting_results(links).collect()} == {"opposite directions", "an effect vs no effect"}
    t = research.triangulation(links).collect()
    assert [(r.a, r.b, r.sign, r.n_studies, r.target) for r in t] == [("A", "B", 1, 2, "c1")]
    levels = spark.createDataFrame([("A", 0), ("B", 1), ("C", 2)], "entity string, level int")
    assert [(r.a, r.b, r.inputs) for r in research.missing_bridges(links, levels).collect()] == [("B", "C", ["c5"])]
    steps = {(r.src, r.dst): r.status for r in research.step_status(links, spark.createDataFrame([("A", "B")], "a string, b string")).collect()}
    assert steps == {("A", "B"): "Challenged", ("B", "A"): "Challenged", ("B", "C"): "Assumed", ("C", "B"): "Assumed"}


def test_competing_paths_differ(spark):
    paths = spark.createDataFrame([(1, list("abcd")), (2, list("abce")), (3, list("axd")), (4, list("axe"))], "rank int, path array<string>")
    taken = lambda **k: ["".join(r.path) for r in research.competing(paths, **k).orderBy("rank").collect()]
    assert taken() == ["abcd", "axd"] and taken(k=3) == ["abcd", "axd", "axe"] and taken(overlap=0.7) == ["abcd", "abce"]


def test_merge_keeps_reviews(spark):
    old = spark.createDataFrame([("a", "accepted"), ("b", "proposed"), ("c", "rejected")], "id string, status string")
    new = spark.createDataFrame([("a", "proposed"), ("d", "proposed")], "id string, status string")
    assert {r.id: r.status for r in incremental.merge_claims(old, new).collect()} == {"a": "accepted", "d": "proposed", "c": "rejected"}


def test_sync_states(spark):
    previous = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("gone", "h3"), ("old", "h4")], "id string, hash string")
    current = spark.createDataFrame([("a", "h9", "The  Quote stays"), ("b", "h8", "other"), ("new", "h4", "same")], "id string, hash string, text string")
    rows = [("1", "a", "h1", "accepted", "the quote"), ("2", "b", "h2", "proposed", "lost"), ("3", "b", "h2", "rejected", "lost"), ("4", "gone", "h3", "stale", "x"), ("5", "old", "h4", "deferred", "same"), ("6", "gone", "h3", "superseded", "x")]
    claims = spark.createDataFrame(rows, "id string, note string, note_revision string, status string, passage string")
    got = {r.id: (r.note, r.note_revision, r.status) for r in incremental.sync_claims(claims, previous, current).collect()}
    assert got == {"1": ("a", "h9", "accepted"), "2": ("b", "h2", "stale"), "3": ("b", "h2", "rejected"), "4": ("gone", "h3", "source_missing"), "5": ("new", "h4", "deferred"), "6": ("gone", "h3", "superseded")}


SF = "/root/testdata/sf0.001"
SAMPLE = ["bm25_search", "top_terms_by_lang", "trade_graph_edges", "signed_links", "conflicting_results", "stale_docs", "backlinks", "case_pages", "queue_page", "relocated_passages"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    want = con.sql(__spark_entry__.oracle_sql()[name]).df()
    rows = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).where(d.notna(), None).map(lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v).itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_topic_reuse_groups_every_document(spark, tmp_path):
    docs = [(i, "abc"[i % 3] if i < 60 else "d") for i in range(1, 91)]
    spark.createDataFrame(docs, "doc_id long, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.grp: tuple(r)[1:] for r in __spark_entry__.queries()["topic_jaccard_reuse"](spark, str(tmp_path)).collect()}
    want = {}
    for g in "abcd":
        now, old = {i for i, s in docs if s == g}, {i for i, s in docs if s == g and i % 7}
        j = len(now & old) / len(now | old)
        want[g] = (f"t-{g}", round(j, 6), j < 0.8)
    assert got == want
