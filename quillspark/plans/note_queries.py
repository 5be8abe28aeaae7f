"""Queries that parse, link, search and show notes. The notes are written out of the tables: each document becomes a markdown
file whose parts are known, so that SQL can say what parsing has to find in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, lookup, passages, render, search, similarity
from ..sources import markdown
from .registry import query, table

#: A document's text without what markdown gives a meaning, in both languages.
_CLEAN = "translate(coalesce(text, ''), '#`[]', '')"
_TRIMMED = rf"regexp_replace({_CLEAN}, '^\s+|\s+$', '', 'g')"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, raw, mtime of the notes: frontmatter, a heading, links of all kinds, code, a managed block, the document's text."""
    docs = table(spark, sf_dir, "documents").withColumn("i", F.col("doc_id").cast("string"))
    n = F.col("doc_id")
    raw = F.concat_ws(
        "\n",
        F.lit("---"),
        F.when(n % 3 == 0, F.concat(F.lit('title: "Given '), "i", F.lit('"'))).otherwise(F.lit("kind: plain")),
        F.concat(F.lit("tags: ["), "lang", F.lit(", '#Set"), (n % 4).cast("string"), F.lit("']")),
        F.concat(F.lit("aliases: [Alias "), "i", F.lit("]")),
        F.lit("---"),
        F.concat(F.lit("# Head "), "i"),
        F.concat(F.lit("Intro #Tag"), (n % 7).cast("string"), F.lit(" and [[d"), (n * 7 % 1000).cast("string"), F.lit("#Part two|see]], `code #no [[no]]` ![[d3]]")),
        F.concat(F.lit("[rel](../"), "source", F.lit("/d"), (n + 20).cast("string"), F.lit(".md) [[Alias "), (n * 3 % 1000).cast("string"), F.lit("]] [web](https://x.org/a) [[nowhere "), (n % 5).cast("string"), F.lit("]]")),
        F.lit("```\n# not a heading [[no]] #no\n```"),
        F.lit("## Part two"),
        F.expr(_CLEAN),
        F.lit("<!-- quillspark:start -->\n[[no]]\n<!-- quillspark:end -->"),
    )
    return docs.select(F.concat("source", F.lit("/d"), "i", F.lit(".md")).alias("path"), raw.alias("raw"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("mtime"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.parse_notes(files(spark, sf_dir), generated=("src1",))


_ID = "source || '/d' || doc_id"


@query(f"""SELECT {_ID} AS id, CASE WHEN doc_id % 3 = 0 THEN 'Given ' ELSE 'Head ' END || doc_id AS title,
concat_ws(',', lang, 'set' || doc_id % 4, 'tag' || doc_id % 7) AS tags, 'Alias ' || doc_id AS aliases, source = 'src1' AS generated FROM documents""")
def note_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, tags and aliases of notes: frontmatter (YAML lists), first heading, inline tags outside code and headings."""
    return notes(spark, sf_dir).select("id", "title", F.array_join("tags", ",").alias("tags"), F.array_join("aliases", ",").alias("aliases"), "generated")


_BODY = rf"""regexp_replace('# Head ' || doc_id || chr(10) || 'Intro #Tag' || doc_id % 7 || ' and [[d' || doc_id * 7 % 1000 || '#Part two|see]], `code #no [[no]]` ![[d3]]' || chr(10)
|| '[rel](../' || source || '/d' || doc_id + 20 || '.md) [[Alias ' || doc_id * 3 % 1000 || ']] [web](https://x.org/a) [[nowhere ' || doc_id % 5 || ']]' || chr(10)
|| '```' || chr(10) || '# not a heading [[no]] #no' || chr(10) || '```' || chr(10) || '## Part two' || chr(10) || {_CLEAN}, '\s+$', '')"""


@query(rf"SELECT {_ID} AS id, left(sha256({_BODY}), 16) AS hash, len(regexp_extract_all({_BODY}, '[\p{{L}}\p{{N}}\p{{M}}_]+'))::INT AS words FROM documents")
def note_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hash and word count of the body, frontmatter and managed block apart."""
    return notes(spark, sf_dir).select("id", "hash", F.col("word_count").cast("int").alias("words"))


_LINKS = f"""SELECT {_ID} AS src, unnest([{{'target': 'd' || doc_id * 7 % 1000, 'anchor': 'Part two', 'kind': 'wiki'}}, {{'target': 'd3', 'anchor': '', 'kind': 'embed'}}, {{'target': 'Alias ' || doc_id * 3 % 1000, 'anchor': '', 'kind': 'wiki'}},
{{'target': 'nowhere ' || doc_id % 5, 'anchor': '', 'kind': 'wiki'}}, {{'target': '../' || source || '/d' || doc_id + 20 || '.md', 'anchor': '', 'kind': 'markdown'}}]) AS l, doc_id, source FROM documents"""


@query(f"SELECT src, l.target AS target, l.anchor AS anchor, l.kind AS kind FROM ({_LINKS})")
def note_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wiki links, embeds and markdown links of the bodies; none from code, none to the web."""
    return notes(spark, sf_dir).select(F.col("id").alias("src"), F.explode(markdown.links(F.col("body"))).alias("l")).select("src", "l.target", "l.anchor", "l.kind")


_RESOLVED = f"""d AS (SELECT doc_id, {_ID} AS id FROM documents),
r AS (SELECT l.src, l.l.kind AS kind, l.l.target AS target, CASE WHEN l.l.kind = 'markdown' THEN p.id WHEN l.l.target LIKE 'Alias%' THEN a.id ELSE s.id END AS dst FROM ({_LINKS}) l
LEFT JOIN d p ON l.l.kind = 'markdown' AND p.doc_id = l.doc_id + 20 AND p.id = l.source || '/d' || (l.doc_id + 20)
LEFT JOIN d a ON l.l.target = 'Alias ' || a.doc_id LEFT JOIN d s ON l.l.target = 'd' || s.doc_id)"""


@query(f"WITH {_RESOLVED} SELECT src, coalesce(dst, '') AS dst, target, kind FROM r")
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with the note that they mean: by relative path, file stem or alias; empty where there is none."""
    return markdown.resolve_links(notes(spark, sf_dir)).select("src", F.coalesce("dst", F.lit("")).alias("dst"), "target", "kind")


@query(f"WITH {_RESOLVED} SELECT src, target FROM r WHERE dst IS NULL AND src NOT LIKE 'src1/%'")
def broken_note_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of notes that nobody generated which mean no note."""
    own = notes(spark, sf_dir)
    real = own.where("NOT generated").select(F.col("id").alias("src"))
    return lookup.broken_links(markdown.resolve_links(own).join(real, "src", "left_semi"))


@query(f"""SELECT {_ID} AS note_id, unnest([{{'heading': 'Head ' || doc_id, 'level': 1, 'anchor': 'head-' || doc_id}}, {{'heading': 'Part two', 'level': 2, 'anchor': 'part-two'}}], recursive := true) FROM documents""")
def note_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with their anchors; a heading inside a fence starts none."""
    return markdown.sections(notes(spark, sf_dir)).select("note_id", "heading", "level", "anchor")


@query(rf"SELECT {_ID} AS note_id, left({_TRIMMED}, 500) || CASE WHEN length({_TRIMMED}) > 500 THEN chr(10) || '[cut]' ELSE '' END AS body FROM documents WHERE doc_id = 17")
def read_one_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section by its anchor, cut with a notice."""
    return lookup.read_section(markdown.sections(notes(spark, sf_dir)), "src17/d17", "part-two", 500).select("note_id", "body")


@query(f"SELECT {_ID} AS id FROM documents WHERE doc_id = 21")
def find_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a name means: here an alias, in other case."""
    return lookup.find_note(notes(spark, sf_dir), "[[alias 21]]").select("id")


@query(rf"""WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, list_transform(w, lambda x: regexp_replace(translate(lower(x), '{T.ACCENTS[0]}', '{T.ACCENTS[1]}'), '^[^\p{{L}}\p{{N}}\p{{M}}_]+|[^\p{{L}}\p{{N}}\p{{M}}_]+$', '', 'g')) AS p FROM w),
h AS (SELECT doc_id, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN p[i] IN ('license', 'version') OR starts_with(p[i], 'the') THEN '**' || w[i] || '**' ELSE w[i] END) AS m, coalesce(list_position(list_transform(p, lambda x: x IN ('license', 'version') OR starts_with(x, 'the')), true), 0) AS f, len(w) AS n FROM p),
b AS (SELECT doc_id, m, n, greatest(1, least(f - 9, n - 17)) AS b FROM h)
SELECT doc_id AS note_id, CASE WHEN b > 1 THEN ' … ' ELSE '' END || array_to_string(m[b : b + 17], ' ') || CASE WHEN b + 18 <= n THEN ' … ' ELSE '' END AS snippet FROM b""")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words around the first hit of a search, hits marked."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), F.lit(0).alias("pos"), F.col("text").alias("body"))
    return search.snippets(docs, "license version the").select("note_id", "snippet")


@query(rf"""WITH p AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id AS id, CASE WHEN length(t) <= 60 THEN t ELSE left(t, 59) || '…' END AS line FROM p""")
def one_liners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space collapsed, cut to one line."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.one_line(F.coalesce("text", F.lit("")), 60).alias("line"))


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(left(text, 40)), '[^\p{L}\p{N}\p{M}_\s-]', '', 'g'), '^\s+|\s+$', '', 'g'), '[\s_]+', '-', 'g'), '^$', 'untitled') AS slug FROM conversations""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.slug(F.substring("text", 1, 40)).alias("slug"))


@query("SELECT doc_id AS id, '[[' || doc_id || '|Doc ' || doc_id || ']]' AS wiki, '[Doc ' || doc_id || '](../' || doc_id || '.md)' AS inline FROM documents")
def link_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a note is linked to, in both styles."""
    i = F.col("doc_id").cast("string")
    title = F.concat(F.lit("Doc "), i)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), render.link_to(i, title).alias("wiki"), render.link_to(i, title, "markdown", 1).alias("inline"))


@query(f"WITH {_RESOLVED} SELECT DISTINCT src, dst FROM r WHERE src = (SELECT id FROM d WHERE doc_id = 9) AND dst IS NOT NULL")
def outlinks_of_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = notes(spark, sf_dir)
    known = graph.durable(own.select("id", "title", "aliases"))  # each note is parsed once, for its names
    src = lookup.find_note(known, "d9").first().id
    return lookup.outlinks(markdown.resolve_links(own.where(F.col("id") == src), known), src).where("dst IS NOT NULL").select(F.lit(src).alias("src"), "dst").distinct()


@query(f"""WITH {_RESOLVED}, e AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM r WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst)
SELECT x.src, x.dst, sum(w)::DOUBLE AS w FROM (SELECT a AS src, b AS dst, 1 AS w FROM e UNION ALL SELECT b, a, 1 FROM e) x GROUP BY ALL""")
def note_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between real notes as the analysis has them: each ordered pair of links weighs 1."""
    links = markdown.resolve_links(notes(spark, sf_dir)).where("dst IS NOT NULL AND src <> dst")
    relations = spark.createDataFrame([], "src string, dst string, confidence double")
    similar = spark.createDataFrame([], "src string, dst string, score double")
    return graph.analysis_edges(links, relations, similar)


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """links (orders of a customer's nation), relations (supplier to customer nation with a confidence), similar."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"))
    both = n.select("a", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("b"))
    return (
        both.where("(a * 3 + b) % 5 = 0").select(F.col("a").alias("src"), F.col("b").alias("dst")),
        both.where("(a + b * 2) % 7 = 0").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.concat(F.lit("type"), (F.col("a") % 3).cast("string")).alias("type"), (F.col("b") % 4 / 4.0).alias("confidence")),
        both.where("(a * b) % 6 = 1").select(F.col("a").alias("src"), F.col("b").alias("dst"), ((F.col("a") + F.col("b")) / 64.0).alias("score")),
    )


_PAIRS = """n AS (SELECT n_nationkey AS a, unnest(range(0, 25)) AS b FROM nation),
links AS (SELECT a AS src, b AS dst FROM n WHERE (a * 3 + b) % 5 = 0), relations AS (SELECT a AS src, b AS dst, 'type' || a % 3 AS type, (b % 4) / 4.0::DOUBLE AS confidence FROM n WHERE (a + b * 2) % 7 = 0),
similar_ AS (SELECT a AS src, b AS dst, (a + b) / 64.0::DOUBLE AS score FROM n WHERE (a * b) % 6 = 1)"""


@query(f"""WITH {_PAIRS}, v AS (SELECT src, dst, 1.0::DOUBLE AS w FROM (SELECT DISTINCT src, dst FROM links) UNION ALL SELECT src, dst, 1.0 FROM relations UNION ALL SELECT src, dst, round(score, 4) FROM similar_),
z AS (SELECT * FROM v WHERE src <> dst) SELECT src, dst, round(sum(w), 6) AS w FROM (SELECT src, dst, w FROM z UNION ALL SELECT dst, src, w FROM z) GROUP BY ALL""")
def navigation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as path finding has them: links and relations weigh 1, similarity its rounded score."""
    return graph.navigation_edges(*_pairs(spark, sf_dir)).withColumn("w", F.round("w", 6))


@query(f"""WITH {_PAIRS}, e AS (SELECT src, dst FROM links UNION SELECT src, dst FROM relations UNION SELECT src, dst FROM similar_ UNION SELECT a, b FROM n WHERE (a + b) % 11 = 0)
SELECT src, dst, CASE WHEN (src, dst) IN (SELECT (src, dst) FROM links) THEN 'links to' WHEN (dst, src) IN (SELECT (src, dst) FROM links) THEN 'linked from'
WHEN (src, dst) IN (SELECT (src, dst) FROM relations) THEN 'type' || src % 3 WHEN (dst, src) IN (SELECT (src, dst) FROM relations) THEN 'type' || dst % 3 || ' (inverse)'
WHEN (src, dst) IN (SELECT (src, dst) FROM similar_) THEN 'similar ' || format('{{:.2f}}', (src + dst) / 64.0::DOUBLE) ELSE 'related' END AS reason FROM e""")
def edge_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why two notes are joined: a link, a link back, a relation either way, similarity, or no more than an edge."""
    links, relations, similar = _pairs(spark, sf_dir)
    far = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("dst")).where("(src + dst) % 11 = 0")
    edges = links.select("src", "dst").unionByName(relations.select("src", "dst")).unionByName(similar.select("src", "dst")).unionByName(far)
    return lookup.edge_reason(edges, links, relations, similar)


@query(f"""WITH {_PAIRS}, p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(score) AS score FROM similar_ GROUP BY ALL), t AS (SELECT n_nationkey AS id, CASE WHEN n_regionkey = 2 THEN NULL ELSE n_regionkey END AS topic FROM nation)
SELECT p.a, p.b, score FROM p JOIN t x ON x.id = p.a JOIN t y ON y.id = p.b WHERE x.topic IS DISTINCT FROM y.topic AND NOT EXISTS (SELECT 1 FROM links WHERE least(src, dst) = p.a AND greatest(src, dst) = p.b) ORDER BY score DESC, a, b LIMIT 12""")
def unlinked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar notes of different topics that nothing links (a top-k report)."""
    links, _, similar = _pairs(spark, sf_dir)
    topics = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") != 2, F.col("n_regionkey")).alias("topic"))
    return lookup.unlinked_pairs(similar, topics, links)


@query("""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), q AS (SELECT doc_id, l, len(l)::INT AS k, trim(regexp_replace(l[len(l)], '\\s+', ' ', 'g')) AS q, len(regexp_extract_all(l[len(l)], '\\S+')) AS n FROM l)
SELECT doc_id AS id, CASE WHEN n >= 8 THEN 'exact' END AS match, CASE WHEN n >= 8 THEN left(sha256(lower(q)), 16) END AS hash FROM q WHERE n >= 8""")
def quote_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a note's last line, quoted with other white space, stands in it."""
    docs = table(spark, sf_dir, "documents").withColumn("last", F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), -1)).where(F.size(F.expr(r"regexp_extract_all(last, '\\S+', 0)")) >= 8)
    pairs = docs.select(F.col("doc_id").alias("id"), F.regexp_replace("last", " ", "  ").alias("quote"), F.col("text").alias("note"))
    return passages.locate_quotes(pairs, fuzzy=False).select("id", "match", "hash")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id AS src, event_type AS dst, n AS score FROM c WHERE user_id = 7 ORDER BY n DESC, event_type LIMIT 3""")
def most_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar ones of a note, best first (a top-k read)."""
    scored = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("src"), F.col("event_type").alias("dst")).agg(F.count("*").alias("score"))
    return similarity.most_similar(scored, 7, 3)


@query("SELECT src, dst, type FROM (SELECT user_id AS src, user_id + 1 AS dst, event_type AS type FROM events GROUP BY ALL) WHERE src = 12 OR dst = 12")
def relations_of_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), (F.col("user_id") + 1).alias("dst"), F.col("event_type").alias("type")).distinct()
    return lookup.relations_of(relations, 12)
