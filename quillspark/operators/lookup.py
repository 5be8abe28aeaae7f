"""Lookups and reports over notes, links and passages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import digest, squeeze
from .graph import durable


def find_note(notes: DataFrame, name: str) -> DataFrame:
    """The note that a name means: its id, else id or title in any case, else file stem, else alias. At most one row."""
    wanted = name.strip().removeprefix("[[").removesuffix("]]").split("|")[0].removesuffix(".md")
    low = F.lit(wanted.lower())
    rank = (
        F.when(F.col("id") == wanted, 0)
        .when((F.lower("id") == low) | (F.lower("title") == low), 1)
        .when(F.lower(F.substring_index("id", "/", -1)) == low, 2)
        .when(F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a) == low), 3)
    )
    return notes.withColumn("__rank", rank).where("__rank IS NOT NULL").orderBy("__rank", "id").limit(1).drop("__rank")


def list_notes(notes: DataFrame, tag: str | None = None, topic: str | None = None, by: str = "rank", limit: int = 50) -> DataFrame:
    """The first notes by rank, by date (``recent``) or by title: a top-k report."""
    if tag is not None:
        notes = notes.where(F.array_contains("tags", tag))
    if topic is not None:
        notes = notes.where(F.col("topic") == topic)
    order = {"rank": [F.desc("rank")], "recent": [F.desc("mtime")], "title": [F.asc("title")]}[by]
    return notes.orderBy(*order, "id").limit(limit)


def backlinks(links: DataFrame) -> DataFrame:
    """dst, src: who links to a note, itself apart."""
    return links.where("dst IS NOT NULL AND src <> dst").select("dst", "src").distinct()


def outlinks(links: DataFrame, note) -> DataFrame:
    return links.where(F.col("src") == note).drop("src").distinct()


def relations_of(relations: DataFrame, note) -> DataFrame:
    """Relations from or to a note."""
    return relations.where((F.col("src") == note) | (F.col("dst") == note))


def broken_links(links: DataFrame) -> DataFrame:
    return links.where("dst IS NULL").select("src", "target")


def orphans(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Notes (id) that neither link to another nor are linked to: two anti joins."""
    real = links.where("dst IS NOT NULL AND src <> dst")
    return notes.join(real.select(F.col("dst").alias("id")), "id", "left_anti").join(real.select(F.col("src").alias("id")), "id", "left_anti")


def unlinked_pairs(similar: DataFrame, notes: DataFrame, links: DataFrame, limit: int = 12) -> DataFrame:
    """a, b, score of the most similar notes of different topics (null-safe) without a link in either direction."""
    n = notes.select("id", "topic")
    pairs = similar.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("score"))
    topics = pairs.join(n.select(F.col("id").alias("a"), F.col("topic").alias("ta")), "a").join(n.select(F.col("id").alias("b"), F.col("topic").alias("tb")), "b").where(~F.col("ta").eqNullSafe(F.col("tb")))
    linked = links.where("dst IS NOT NULL").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return topics.join(linked, ["a", "b"], "left_anti").orderBy(F.desc("score"), "a", "b").limit(limit).select("a", "b", "score")


def edge_reason(edges: DataFrame, links: DataFrame, relations: DataFrame, similar: DataFrame) -> DataFrame:
    """src, dst, reason: a link there, a link back, a relation either way, similarity, or just related."""
    flag = lambda df, name, back: df.select(F.col("dst" if back else "src").alias("src"), F.col("src" if back else "dst").alias("dst")).distinct().withColumn(name, F.lit(True))
    typed = relations.groupBy("src", "dst").agg(F.min("type").alias("type"))
    out = edges.select("src", "dst").distinct()
    for side in (flag(links, "there", False), flag(links, "back", True), typed, typed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("type").alias("inverse")), similar.select("src", "dst", "score")):
        out = out.join(side, ["src", "dst"], "left")
    reason = (
        F.when(F.col("there"), "links to").when(F.col("back"), "linked from").when(F.col("type").isNotNull(), F.col("type"))
        .when(F.col("inverse").isNotNull(), F.concat(F.col("inverse"), F.lit(" (inverse)"))).when(F.col("score").isNotNull(), F.concat(F.lit("similar "), F.format_number("score", 2))).otherwise("related")
    )
    return out.select("src", "dst", reason.alias("reason"))


def index_stats(notes: DataFrame, links: DataFrame) -> DataFrame:
    """notes, links, broken, linked: one row."""
    n = notes.agg(F.count("*").alias("notes"))
    return n.join(F.broadcast(links.agg(F.count("*").alias("links"), F.count_if(F.col("dst").isNull()).alias("broken"), F.count_distinct("dst").alias("linked"))))


def tag_histogram(notes: DataFrame, limit: int = 25) -> DataFrame:
    return notes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(limit)


def excerpt(lines: DataFrame, marks: DataFrame, key: str, place: str, around: int) -> DataFrame:
    """Lines within ``around`` of a mark (key, mark)."""
    return lines.join(marks, key).where(F.abs(F.col(place) - F.col("mark")) <= around)


#: Words of the key under which a quote is looked up; quotes of fewer than three words that a projection compares with each
#: text; rows and candidates that are broadcast (each row has a few numbers; more are shuffled).
KEY_WORDS, SHORT_QUOTES, SMALL_ROWS = 4, 200, 200_000


def _small(df: DataFrame) -> DataFrame:
    df = durable(df)
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def locate_passages(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """item_id, doc_id, at, hash: quotes found in texts, white space and case apart; ``at`` counts from 1.

    A quote's words but the first and last (which may be parts of words in a text) are whole words of any text that holds
    it. Up to ``KEY_WORDS`` of them are its key: texts meet it by an equi-join on the hashes of their word runs, and only those that
    meet are compared. Quotes of one or two words have no such key: they are compared with each text in a projection.
    """
    texts = docs.select("doc_id", F.lower(F.regexp_replace("text", r"\s+", " ")).alias("t"))
    q = durable(quotes.select("item_id", F.lower(squeeze(F.col("quote"))).alias("q")).where("q <> ''").withColumn("w", F.split("q", " ")))
    keyed = q.where("size(w) > 2").withColumn("k", F.least(F.lit(KEY_WORDS), F.size("w") - 2))
    sizes = sorted(r.k for r in keyed.select("k").distinct().collect())  # at most KEY_WORDS numbers
    run = lambda w, i, k: F.xxhash64(F.lit(k), *[F.get(w, i + j) for j in range(k)])
    key = F.coalesce(*[F.when(F.col("k") == k, run(F.col("w"), F.lit(1), k)) for k in sizes]) if sizes else F.lit(None).cast("long")
    keys = keyed.select("item_id", key.alias("key"))

    def runs_of(w, k):
        return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(0))), lambda x, i: run(w, i, k))

    def runs(w):
        return F.array_distinct(F.flatten(F.array(*[runs_of(w, k) for k in sizes])))

    out = []
    if sizes:
        of_text = texts.select("doc_id", F.explode(F.element_at(F.transform(F.array(F.split("t", " ")), runs), 1)).alias("key"))
        met = of_text.join(_small(keys), "key").select("doc_id", "item_id").distinct()
        pairs = texts.join(_small(met), "doc_id").join(q.select("item_id", "q"), "item_id")
        out.append(pairs.where(F.contains("t", F.col("q"))).select("item_id", "doc_id", "t", "q"))
    short = q.where("size(w) <= 2").select("item_id", "q")
    rows = [(r.item_id, r.q) for r in short.limit(SHORT_QUOTES + 1).collect()]
    if len(rows) > SHORT_QUOTES:
        raise ValueError(f"over {SHORT_QUOTES} quotes of one or two words: every text would be compared with each")
    if rows:
        listed = F.array(*[F.struct(F.lit(i).alias("item_id"), F.lit(x).alias("q")) for i, x in rows])
        hit = texts.select("doc_id", "t", F.explode(F.filter(listed, lambda x: F.contains(F.col("t"), x["q"]))).alias("x"))
        out.append(hit.select(F.col("x.item_id").alias("item_id"), "doc_id", "t", F.col("x.q").alias("q")))
    if not out:
        out.append(texts.join(q.select("item_id", "q").limit(0), F.lit(True)).select("item_id", "doc_id", "t", "q"))
    found = reduce(DataFrame.unionByName, out)
    return found.select("item_id", "doc_id", F.instr("t", F.col("q")).alias("at"), digest(F.col("q"), 16).alias("hash"))


def read_section(sections: DataFrame, note, heading: str, max_chars: int = 20_000) -> DataFrame:
    """Sections of a note by heading (any case) or anchor, cut with a notice."""
    from ..functions.text import slug

    own = sections.where((F.col("note_id") == note) & ((F.lower("heading") == heading.lower()) | (F.col("anchor") == slug(F.lit(heading)))))
    shown = F.when(F.length("body") > max_chars, F.concat(F.substring("body", 1, max_chars), F.lit("\n[cut]"))).otherwise(F.col("body"))
    return own.select("note_id", "pos", "heading", shown.alias("body"))
