"""Pages over a claim graph as (path, text) frames: cases, entities, the framework's lanes, the review queue, an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug
from .evidence import NOTES_MARK, claim_brief, lanes, review_queue
from .render import link_to

LANE_LINKS = 6
_NONE = "- none"


def _bullets(items: Column) -> Column:
    return F.when(F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(_NONE)


def entity_path(entity: Column) -> Column:
    return F.concat(F.lit("entities/"), F.substring(slug(entity), 1, 60), F.lit(".md"))


def claim_lines(claims: DataFrame, flags: DataFrame) -> DataFrame:
    """id, line: a claim's brief, its passage and note, its status, and what to look at first. flags: id, flags."""
    said = claims.select("id", "note", "status", F.coalesce("passage", F.lit("")).alias("passage")).join(claim_brief(claims), "id").join(flags, "id", "left")
    warn = F.when(F.size(F.coalesce("flags", F.array().cast("array<string>"))) > 0, F.concat(F.lit(" ⚠ "), F.array_join("flags", ", "))).otherwise("")
    quote = F.when(F.col("passage") != "", F.concat(F.lit(" “"), F.col("passage"), F.lit("”"))).otherwise("")
    return said.select("id", F.concat(F.lit("`"), "id", F.lit("` "), "claim", quote, F.lit(" ("), "note", F.lit(", "), "status", F.lit(")"), warn).alias("line"))


def case_pages(cases: DataFrame, lines: DataFrame) -> DataFrame:
    """path, text of cases (id, type, title, status, inputs, entities, text, notes): its claims, what it says, and under a mark
    what reviewers noted."""
    used = cases.select("id", F.explode_outer("inputs").alias("claim")).join(lines.select(F.col("id").alias("claim"), "line"), "claim", "left")
    listed = used.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("claim", F.coalesce("line", "claim").alias("line")))), lambda x: x["line"]).alias("lines"))
    head = F.concat(F.lit("# "), "title", F.lit("\n\n"), F.replace(F.col("type"), F.lit("_"), F.lit(" ")), F.lit(" · "), "status", F.lit("\n\nEntities: "), F.array_join("entities", ", "))
    body = F.concat_ws("\n\n", head, F.concat(F.lit("## Claims\n"), _bullets(F.col("lines"))), F.nullif(F.coalesce("text", F.lit("")), F.lit("")))
    text = F.concat(body, F.lit(f"\n\n{NOTES_MARK} -->\n"), F.coalesce("notes", F.lit("")))
    return cases.join(listed, "id", "left").select(F.concat(F.lit("cases/"), "id", F.lit(".md")).alias("path"), text.alias("text"))


def entity_pages(links: DataFrame, scales: DataFrame, lines: DataFrame, cases: DataFrame) -> DataFrame:
    """A page for each entity: its scales, its claims by what they join it to (with the number of studies), its cases, its notes."""
    side = lambda own, other: links.where("s_entity <> o_entity").select(F.col(own).alias("entity"), F.col(other).alias("other"), "id", "note", "study", "kind")
    both = side("s_entity", "o_entity").unionByName(side("o_entity", "s_entity")).join(lines, "id")
    line = F.concat(F.lit("- ["), "kind", F.lit("] "), "line")
    group = both.groupBy("entity", "other").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("l")))), lambda x: x["l"]), "\n").alias("ls"), F.count("*").alias("n"), F.count_distinct("study").alias("k"))
    block = F.concat(F.lit("### "), "other", F.lit(" · "), F.col("n").cast("string"), F.lit(" claims, "), F.col("k").cast("string"), F.lit(" independent\n"), "ls")
    claims = group.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("other", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("claims"))
    notes = both.groupBy("entity").agg(F.array_sort(F.collect_set("note")).alias("notes"))
    own_cases = cases.select(F.explode("entities").alias("entity"), F.concat("title", F.lit(" · "), "status").alias("c")).groupBy("entity").agg(F.array_sort(F.collect_list("c")).alias("cases"))
    joined = claims.join(notes, "entity").join(scales, "entity", "left").join(own_cases, "entity", "left")
    text = F.concat_ws(
        "\n\n", F.concat(F.lit("# "), "entity"), F.concat(F.lit("Scales: "), F.coalesce(F.array_join("scales", ", "), F.lit("unmapped"))), F.lit("## Claims by connected entity"), F.col("claims"),
        F.when(F.size("cases") > 0, F.concat(F.lit("## Cases\n"), _bullets(F.col("cases")))), F.concat(F.lit("## Source notes\n"), _bullets(F.col("notes"))),
    )
    return joined.select(entity_path(F.col("entity")).alias("path"), text.alias("text"))


def map_page(links: DataFrame, entity_scales: DataFrame, scales: DataFrame) -> DataFrame:
    """framework-map.md: a lane for each scale of the framework (idx, id, name) and one for unmapped entities, most neighbours first."""
    both = links.select(F.explode(F.array(F.struct(F.col("s_entity").alias("entity"), F.col("o_entity").alias("other")), F.struct(F.col("o_entity").alias("entity"), F.col("s_entity").alias("other")))).alias("e")).select("e.*").where("entity <> other")
    near = both.groupBy("entity").agg(F.slice(F.array_sort(F.collect_set("other")), 1, LANE_LINKS).alias("near"))
    placed = lanes(links, entity_scales).join(near, "entity", "left")
    line = F.concat(F.lit("- "), "entity", F.coalesce(F.concat(F.lit(" · linked to "), F.array_join("near", ", ")), F.lit("")))
    listed = placed.groupBy(F.col("scale").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("ls"))
    known = scales.select("idx", "id", F.concat((F.col("idx") + 1).cast("string"), F.lit(". "), "name").alias("name"))
    every = known.unionByName(scales.sparkSession.createDataFrame([(1 << 30, "unmapped", "Unmapped")], known.schema))
    lane = F.concat(F.lit("## "), "name", F.lit("\n"), F.coalesce("ls", F.lit("*nothing in the indexed notes*")))
    text = every.join(listed, "id", "left").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", lane.alias("l")))), lambda x: x["l"]), "\n\n").alias("t"))
    return text.select(F.lit("framework-map.md").alias("path"), F.concat(F.lit("# Framework map\n\n"), "t").alias("text"))


def queue_page(claims: DataFrame, lines: DataFrame, cases: DataFrame) -> DataFrame:
    """review-queue.md: claims that wait for a review, by note, and cases that do. As long as the queue."""
    waiting = review_queue(claims).select("note", F.posexplode("ids").alias("k", "id")).join(lines, "id")
    by_note = waiting.groupBy("note").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat(F.lit("- "), "line").alias("l")))), lambda x: x["l"]), "\n").alias("ls"), F.count("*").alias("n"))
    block = F.concat(F.lit("### "), "note", F.lit("\n"), "ls")
    one = by_note.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("note", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("claims"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    open_cases = cases.where("status IN ('proposed', 'stale', 'deferred')").agg(F.array_sort(F.collect_list(F.concat("title", F.lit(" · "), "status"))).alias("cases"))
    text = F.concat(F.lit("# Review queue\n\n## Claims ("), F.col("n").cast("string"), F.lit(")\n\n"), "claims", F.lit("\n\n## Cases\n"), _bullets(F.col("cases")))
    return one.join(F.broadcast(open_cases)).select(F.lit("review-queue.md").alias("path"), text.alias("text"))


def index_page(claims: DataFrame, cases: DataFrame, questions: DataFrame, name: str, style: str = "wiki") -> DataFrame:
    """index.md: claims by status, questions, cases by type."""
    counts = claims.groupBy("status").agg(F.count("*").alias("n")).agg(F.coalesce(F.array_join(F.array_sort(F.collect_list(F.concat("status", F.lit(" "), F.col("n").cast("string")))), ", "), F.lit("")).alias("counts"))
    asked = questions.agg(F.array_sort(F.collect_list(F.concat("question", F.lit(" → "), "target"))).alias("asked"))
    line = F.concat(F.lit("- "), link_to(F.concat(F.lit("cases/"), "id"), F.col("title"), style), F.lit(" · "), "status")
    by_type = cases.groupBy("type").agg(F.concat(F.lit("### "), F.replace(F.first("type"), F.lit("_"), F.lit(" ")), F.lit(" ("), F.count("*").cast("string"), F.lit(")\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("b"))
    listed = by_type.agg(F.coalesce(F.array_join(F.array_sort(F.collect_list("b")), "\n\n"), F.lit("")).alias("cases"))
    one = counts.join(F.broadcast(asked)).join(F.broadcast(listed))
    text = F.concat(F.lit(f"# {name}\n\nClaims: "), "counts", F.lit("\n\n## Questions\n"), _bullets(F.col("asked")), F.lit("\n\n## Cases\n\n"), "cases")
    return one.select(F.lit("index.md").alias("path"), text.alias("text"))


def narrative_pages(narratives: DataFrame, predictions: DataFrame) -> DataFrame:
    """A page for each reading (question, label, path, statuses, net, score), and what would tell the readings of a question apart
    (question, n, observation)."""
    step = F.transform(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("a"), F.slice("path", F.lit(2), F.size("path")).alias("b"), F.col("statuses").alias("s")), lambda x: F.concat(x["a"], F.lit(" → "), x["b"], F.lit(" ["), F.coalesce(x["s"], F.lit("Missing")), F.lit("]")))
    told = predictions.groupBy("question").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "observation"))), lambda x: x["observation"]).alias("told"))
    text = F.concat(F.lit("# Reading "), "label", F.lit("\n\nNet sign: "), F.col("net").cast("string"), F.lit("\n\n## Steps\n"), _bullets(step), F.lit("\n\n## Distinguishing observations\n"), _bullets(F.col("told")))
    return narratives.join(told, "question", "left").select(F.concat(F.lit("narratives/"), "question", F.lit("-"), F.lower("label"), F.lit(".md")).alias("path"), text.alias("text"))
