"""A notes folder, indexed: the read tools as methods that return frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, lookup, render, search, similarity
from .sources import markdown
from .sources.records import Settings


class Engine:
    """Frames of one folder: notes, links, sections, similar, edges, ranks, communities. Lazy until a tool runs."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.settings = s = settings or Settings()
        self.notes_all = markdown.read_notes(spark, root, s.exclude, (s.output_dir, s.research_dir)).persist()
        self.notes = self.notes_all.where("NOT generated")
        self.links = markdown.resolve_links(self.notes).persist()
        self.sections = markdown.sections(self.notes)
        self.relations = spark.createDataFrame([], "src string, dst string, type string, confidence double")
        assembled = self.notes.select("id", F.concat_ws(" ", "title", "title", F.array_join("tags", " "), F.array_join("aliases", " "), "body").alias("text"))
        self.posting = similarity.postings(assembled, "id", "text").persist()
        self.similar = similarity.neighbours(self.posting, s.related_k, s.related_floor).persist()
        real = self.links.where("dst IS NOT NULL AND src <> dst").select("src", "dst")
        self.edges = graph.analysis_edges(real, self.relations, self.similar).persist()
        ids = self.notes.select("id")
        self.ranks = graph.pagerank(ids, real)
        self.communities = graph.louvain(ids, self.edges).persist()

    def search(self, query: str, limit: int = 10, tag: str | None = None) -> DataFrame:
        titled = self.sections.join(self.notes.select(F.col("id").alias("note_id"), "title", F.array_join("tags", " ").alias("tags")), "note_id")
        return search.search(titled, self.notes_all, query, limit, tag)

    def read_note(self, name: str) -> DataFrame:
        return lookup.find_note(self.notes_all, name)

    def read_section(self, note: str, heading: str) -> DataFrame:
        return lookup.read_section(self.sections, note, heading)

    def note_links(self, note: str) -> dict[str, DataFrame]:
        return {
            "out": lookup.outlinks(self.links, note),
            "back": lookup.backlinks(self.links).where(F.col("dst") == note),
            "similar": self.similar.where(F.col("src") == note),
            "relations": self.relations.where((F.col("src") == note) | (F.col("dst") == note)),
        }

    def list_notes(self, tag: str | None = None, by: str = "title", limit: int = 50) -> DataFrame:
        return lookup.list_notes(self.notes, tag, None, by, limit)

    def find_path(self, start: str, goal: str) -> DataFrame:
        return graph.shortest_path(self.edges, start, goal)

    def topics(self, k: int = 5) -> DataFrame:
        """community, size, terms of the communities with two notes or more."""
        sizes = self.communities.groupBy("community").agg(F.count("*").alias("size")).where("size >= 2")
        best = similarity.top_terms(self.posting, self.communities.select(F.col("id").alias("doc"), F.col("community").alias("grp")), k)
        terms = best.groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
        return sizes.join(terms, F.col("community") == F.col("grp"), "left").select("community", "size", "terms")

    def maintenance(self) -> dict[str, DataFrame]:
        return {
            "broken": lookup.broken_links(self.links),
            "orphans": lookup.orphans(self.notes.select("id"), self.links),
            "duplicates": similarity.possible_duplicates(self.similar),
        }

    def overview(self) -> dict[str, DataFrame]:
        return {"stats": lookup.index_stats(self.notes, self.links), "tags": lookup.tag_histogram(self.notes), "hubs": self.ranks.orderBy(F.desc("rank"), "id").limit(8), "topics": self.topics()}

    def pages(self) -> DataFrame:
        """Navigation pages: the index and a page for each topic."""
        topics = self.topics().select(F.concat(F.lit("t-"), F.col("community").cast("string")).alias("id"), F.array_join("terms", ", ").alias("label"), F.lit(None).cast("string").alias("synopsis"))
        bridges = graph.bridge_scores(self.edges, self.communities)
        own = self.notes.select("id", "title").join(self.ranks, "id").join(bridges, "id").join(self.communities, "id")
        notes = own.select("id", "title", F.concat(F.lit("t-"), F.col("community").cast("string")).alias("topic"), "rank", "bridge", F.lit(None).cast("string").alias("summary"))
        return render.index_page(notes, topics, self.settings.link_style).unionByName(render.topic_pages(notes, topics, style=self.settings.link_style))

    def write_pages(self, root: str) -> DataFrame:
        return render.write_pages(self.pages(), f"{root.rstrip('/')}/{self.settings.output_dir}")
