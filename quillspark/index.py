"""The stored index of a notes folder: built once and read by the tools. What is known about notes (relations, summaries,
topic names) outlives a rebuild, follows renames and goes with its note."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import identifier
from .operators import evidence, graph, incremental, lookup, render, search, similarity
from .operators.graph import durable
from .sources import markdown
from .sources.records import Settings, has_snapshot, read_snapshot, write_snapshot
from .streaming.notes import is_stale

#: What is known about notes, beside what is read off them.
KNOWLEDGE = {
    "relations": "src string, dst string, type string, reason string, confidence double, source string",
    "enrichment": "id string, hash string, summary string, key_claims array<string>, open_questions array<string>",
    "link_checked": "id string, state string",
    "topic_names": "topic string, label string, synopsis string",
}
#: The columns that hold note ids.
NOTE_KEYS = {"relations": ("src", "dst"), "enrichment": ("id",), "link_checked": ("id",)}


class Index:
    """Tables under ``<root>/.quillspark``, or under ``folder``: notes (rank, bridge and topic with them), links, sections,
    similar, edges, topics, meta, and the tables of ``KNOWLEDGE``."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, folder: str | None = None):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings or Settings()
        self.folder = (folder or f"{self.root}/.quillspark").rstrip("/")

    def has(self, name: str) -> bool:
        return has_snapshot(self.spark, f"{self.folder}/{name}")

    def table(self, name: str) -> DataFrame:
        if name in KNOWLEDGE and not self.has(name):
            return self.spark.createDataFrame([], KNOWLEDGE[name])
        return read_snapshot(self.spark, f"{self.folder}/{name}")

    def put(self, name: str, df: DataFrame) -> None:
        write_snapshot(df, f"{self.folder}/{name}")

    @property
    def notes(self) -> DataFrame:
        return self.table("notes").where("NOT generated")

    def fresh(self) -> bool:
        """Whether the stored index is of the files that are there now."""
        if not self.has("meta"):
            return False
        meta = self.table("meta").first()
        return not is_stale(markdown.scan(self.spark, self.root, self.settings.exclude).select("path", "mtime"), meta.files, meta.newest)

    def refresh(self) -> None:
        if not self.fresh():
            self.build()

    def _carry(self, notes: DataFrame) -> None:
        """Knowledge follows renamed notes and goes with removed ones."""
        renamed = durable(incremental.renames(self.notes.select("id", "hash"), notes.select("id", "hash"))) if self.has("notes") else None
        for name, keys in NOTE_KEYS.items():
            if self.has(name):
                kept = self.table(name)
                for key in keys:
                    kept = incremental.carry_over(kept, renamed, key) if renamed is not None else kept
                    kept = evidence.collect_garbage(kept, notes, key)
                self.put(name, durable(kept.select(*self.table(name).columns)))

    def _topics(self, communities: DataFrame, posting: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(id, topic) of notes in communities of two or more, and the topics; a community takes over the id of an earlier
        topic that it overlaps enough, and its name is stale if it changed much."""
        big = communities.join(communities.groupBy("community").agg(F.count("*").alias("size")).where("size >= 2"), "community")
        groups = durable(big.select(F.col("community").alias("grp"), F.col("id").alias("member"), "size"))
        sized = groups.groupBy("grp", "size").agg(identifier("t-", F.min("member"), F.bit_xor(F.xxhash64("member"))).alias("fresh"))
        before = self.notes.where("topic IS NOT NULL").select("topic", F.col("id").alias("member")) if self.has("notes") else None
        reused = incremental.reuse_topics(groups.select("grp", "member"), before) if before is not None else self.spark.createDataFrame([], "grp long, old string, jaccard double, stale boolean")
        terms = similarity.top_terms(posting, groups.select(F.col("member").alias("doc"), "grp"), 3)
        label = terms.groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("label"))
        topics = durable(sized.join(reused, "grp", "left").join(label, "grp", "left").select("grp", F.coalesce("old", "fresh").alias("topic"), "size", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("stale", F.lit(False)).alias("stale")))
        return groups.join(topics, "grp").select(F.col("member").alias("id"), "topic"), topics.drop("grp")

    def build(self) -> dict:
        """Read the folder again and replace the tables; the figures of the index. Knowledge is kept."""
        began, s = time.time(), self.settings
        every = durable(markdown.read_notes(self.spark, self.root, s.exclude, (s.output_dir, s.research_dir)))
        notes = every.where("NOT generated")
        self._carry(notes)
        links = durable(markdown.resolve_links(notes))
        said = F.concat_ws(" ", "title", "title", F.array_join("tags", " "), F.array_join("aliases", " "), "body")
        posting = durable(similarity.postings(notes.select("id", said.alias("text")), "id", "text"))
        similar = durable(similarity.neighbours(posting, s.related_k, s.related_floor))
        ids, relations = notes.select("id"), self.table("relations")
        real = links.where("dst IS NOT NULL AND src <> dst").select("src", "dst")
        edges = durable(graph.analysis_edges(real, relations, similar))
        ranks = graph.pagerank(ids, real.unionByName(relations.select("src", "dst")))
        communities = durable(graph.louvain(ids, edges))
        placed, topics = self._topics(communities, posting)
        n = ids.count()
        own = every.join(ranks.select("id", F.round(F.col("rank") * n, 4).alias("rank")), "id", "left").join(graph.bridge_scores(edges, communities), "id", "left").join(placed, "id", "left")
        newest = every.agg(F.max("mtime")).first()[0]
        files = every.count()
        # a navigation page repeats what notes say and is not searched; other generated notes are
        pages = F.col("id").startswith(f"{s.output_dir}/topics/") | F.col("id").isin(f"{s.output_dir}/INDEX", f"{s.output_dir}/AGENTS", f"{s.output_dir}/maintenance")
        for name, df in (("links", links), ("sections", markdown.sections(every.where(~pages))), ("similar", similar), ("edges", graph.navigation_edges(real, relations, similar)), ("topics", topics), ("notes", durable(own))):
            self.put(name, df)
        self.put("meta", self.spark.createDataFrame([(files, newest)], "files long, newest timestamp"))
        return self.stats() | {"seconds": round(time.time() - began, 2)}

    def stats(self) -> dict:
        """notes, generated, links, broken, topics, orphans, relations, enriched."""
        counts = self.table("notes").agg(F.count_if(~F.col("generated")).alias("notes"), F.count_if("generated").alias("generated")).first().asDict()
        figures = lookup.index_stats(self.notes, self.table("links")).first()
        return counts | {
            "links": figures.links, "broken": figures.broken, "topics": self.table("topics").count(), "orphans": lookup.orphans(self.notes.select("id"), self.table("links")).count(),
            "relations": self.table("relations").count(), "enriched": self.table("enrichment").count(),
        }

    def topics(self) -> DataFrame:
        """topic, label, synopsis, size, stale: a given name goes before the one made of terms."""
        named = self.table("topic_names").select("topic", F.col("label").alias("given"), "synopsis")
        return self.table("topics").join(named, "topic", "left").select("topic", F.coalesce("given", "label").alias("label"), "synopsis", "size", "stale")

    def titled_sections(self) -> DataFrame:
        return self.table("sections").join(self.table("notes").select(F.col("id").alias("note_id"), "title", F.array_join("tags", " ").alias("tags")), "note_id")

    def search(self, query: str, limit: int = 10, tag: str | None = None, topic: str | None = None) -> DataFrame:
        """The best notes, with a snippet of their best section."""
        sections = self.titled_sections()
        best = search.search(sections, self.table("notes"), query, limit, tag, topic, stem=True)
        shown = search.snippets(sections.join(F.broadcast(best.select("note_id", F.col("best").alias("pos"))), ["note_id", "pos"]), query).select("note_id", "snippet")
        return best.join(shown, "note_id", "left").join(self.table("notes").select(F.col("id").alias("note_id"), "title", "topic"), "note_id").select("note_id", "title", "topic", "score", "snippet").orderBy(F.desc("score"), "note_id")

    def relate(self, rows: DataFrame) -> None:
        """Add relations; the latest of one (src, dst, type) counts."""
        columns = ["src", "dst", "type", "reason", "confidence", "source"]
        old = self.table("relations").withColumn("at", F.lit(0))
        self.put("relations", durable(incremental.upsert(old, rows.select(*columns).withColumn("at", F.lit(1)), ["src", "dst", "type"], "at").select(*columns)))

    def pages(self) -> DataFrame:
        """Navigation pages (path, text): the index, a page for each topic, what needs care."""
        topics = self.topics().withColumnRenamed("topic", "id")
        notes = self.notes.select("id", "title", "topic", "rank", "bridge").join(self.table("enrichment").select("id", "summary"), "id", "left")
        links, style = self.table("links"), self.settings.link_style
        care = render.maintenance_page(lookup.broken_links(links), lookup.orphans(self.notes.select("id"), links), similarity.possible_duplicates(self.table("similar")))
        return render.index_page(notes, topics, style).unionByName(render.topic_pages(notes, topics, style=style)).unionByName(care)

    def write_pages(self) -> list[str]:
        """Write the pages that changed and remove topic pages whose topic is gone; the paths touched."""
        target = f"{self.root}/{self.settings.output_dir}"
        pages = durable(self.pages())
        touched = sorted(r.path for r in render.write_pages(pages, target).where("changed").collect())
        return touched + render.remove_stale(pages, target, "topics")
