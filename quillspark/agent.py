"""A loop of model turns and tool calls over an injected model, and what is asked with it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import providers
from .index import Index
from .operators import incremental, lookup
from .operators.graph import durable
from .tools import RELATION_TYPES, ToolError, Tools
from .workspace import Workspace

#: (messages, tools) -> {"text": ..., "calls": [{"id", "name", "args"}]}; without tools it has to answer in words.
Model = Callable[[list[dict], list[dict]], dict]
MAX_RESULT = 20_000
TURNS = {"ask": 40, "insights": 60, "investigate": 30}
LINK_ANSWER = "relations array<struct<candidate: string, type: string, reason: string, confidence: double>>"
NAME_ANSWER = "label string, synopsis string"


def run(model: Model, tools: Tools, task: str, turns: int) -> str:
    """The model's last words. Results are cut at ``MAX_RESULT`` characters, an error goes back to the model as one, and in the
    last turn there are no tools, so that it ends with an answer."""
    messages: list[dict] = [{"role": "user", "content": task}]
    for turn in range(turns):
        answer = model(messages, tools.definitions() if turn < turns - 1 else [])
        calls = answer.get("calls") or []
        messages.append({"role": "assistant", "content": answer.get("text", ""), "calls": calls})
        if not calls or turn == turns - 1:
            return answer.get("text", "")
        for call in calls:
            try:
                said, failed = json.dumps(tools.call(call["name"], call.get("args") or {}), ensure_ascii=False), False
            except ToolError as e:
                said, failed = str(e), True
            messages.append({"role": "tool", "id": call.get("id"), "content": said[:MAX_RESULT], "is_error": failed})
    return ""


def ask(model: Model, index: Index, question: str, workspace: Workspace | None = None) -> str:
    return run(model, Tools(index, workspace), f"Answer from the notes and name the notes you used.\n\n{question}", TURNS["ask"])


def signals(index: Index) -> dict:
    """Where insights may lie: similar notes of different topics that aren't linked, broken links."""
    pairs = lookup.unlinked_pairs(index.table("similar"), index.notes, index.table("links"))
    return {"unlinked": [r.asDict() for r in pairs.collect()], "broken": lookup.broken_links(index.table("links")).count()}


def insights(model: Model, index: Index, n: int = 3, focus: str | None = None) -> tuple[str, list[str]]:
    """A summary and the notes written."""
    tools = Tools(index, writes=True)
    task = f"Write up to {n} insight notes that connect notes of different topics{f' on {focus}' if focus else ''}. Start from: {json.dumps(signals(index))}"
    return run(model, tools, task, TURNS["insights"]), tools.written


def investigate(model: Model, index: Index, workspace: Workspace, question: str, turns: int = TURNS["investigate"]) -> tuple[str, list[str]]:
    """A report and the claims that it names and that exist."""
    from .operators import evidence

    package = Tools(index, workspace).call("compose_context", {"question_id": question})
    report = run(model, Tools(index, workspace, proposals=True), f"Investigate question {question}. Evidence: {json.dumps(package)[:MAX_RESULT]}", turns)
    named = evidence.mentions(index.spark.createDataFrame([(question, report)], "report string, text string"), workspace.table("claims"))
    return report, [r.id for r in named.orderBy("id").collect()]


# --- passes over many notes --------------------------------------------------------------------------------------------


def _outcome(answers: DataFrame) -> dict:
    failed = answers.where("error IS NOT NULL")
    return {"done": answers.where("error IS NULL").count(), "failed": {str(r.key): r.error for r in failed.orderBy("key").limit(200).collect()}}


def enrich(provider: providers.Provider, index: Index, force: bool = False, limit: int | None = None) -> dict:
    """Summaries of notes whose text changed; notes that fail keep what they had."""
    stored = index.table("enrichment")
    todo = index.notes if force else incremental.todo(index.notes, stored, "id", "hash")
    todo = durable(todo.orderBy("id").limit(limit) if limit else todo)
    answers = durable(providers.call(todo.select(F.col("id").alias("key"), "body").withColumnRenamed("body", "prompt"), provider))
    fresh = answers.where("error IS NULL").join(todo.select(F.col("id").alias("key"), "hash"), "key").select(F.col("key").alias("id"), "hash", "result.summary", "result.key_claims", "result.open_questions")
    index.put("enrichment", durable(incremental.upsert(stored.withColumn("at", F.lit(0)), fresh.withColumn("at", F.lit(1)), ["id"], "at").drop("at")))
    return _outcome(answers)


def link(provider: providers.Provider, index: Index, force: bool = False, limit: int | None = None) -> dict:
    """Typed relations between similar notes that aren't linked; a note is asked again when it or its candidates changed."""
    similar, links = index.table("similar"), index.table("links").where("dst IS NOT NULL").select("src", "dst")
    either = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    candidates = durable(similar.select("src", "dst").join(either, ["src", "dst"], "left_anti"))
    listed = candidates.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("others"))
    asked = index.notes.join(listed, "id").withColumn("state", F.concat_ws("|", "hash", F.array_join("others", ",")))
    todo = asked if force else incremental.todo(asked, index.table("link_checked"), "id", "state")
    todo = durable(todo.orderBy("id").limit(limit) if limit else todo)
    prompt = F.concat(F.lit("How does this note relate to the candidates? Types: " + ", ".join(RELATION_TYPES) + ", none.\nCandidates: "), F.array_join("others", ", "), F.lit("\n\n"), "body")
    answers = durable(providers.call(todo.select(F.col("id").alias("key"), prompt.alias("prompt")), provider, LINK_ANSWER))
    given = answers.where("error IS NULL").select(F.col("key").alias("src"), F.explode("result.relations").alias("r")).select("src", F.col("r.candidate").alias("dst"), "r.type", "r.reason", "r.confidence")
    kept = durable(providers.accepted_relations(given, candidates, RELATION_TYPES).select("src", "dst", "type", "reason", "confidence", F.lit("link-pass").alias("source")))
    done = answers.where("error IS NULL").select(F.col("key").alias("id"))
    # what an earlier pass said of these notes goes
    old = index.table("relations")
    earlier = old.where("source = 'link-pass'").join(done.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "type", "source")
    index.put("relations", durable(old.join(earlier, ["src", "dst", "type", "source"], "left_anti").select(*old.columns)))
    index.relate(kept)
    state = todo.select("id", "state").join(done, "id", "left_semi").withColumn("at", F.lit(1))
    index.put("link_checked", durable(incremental.upsert(index.table("link_checked").withColumn("at", F.lit(0)), state, ["id"], "at").select("id", "state")))
    return _outcome(answers) | {"relations": kept.count()}


def name_topics(provider: providers.Provider, index: Index) -> dict:
    """Labels and synopses of topics that have none or changed much."""
    from .operators import evidence

    todo = evidence.naming_todo(index.topics().withColumnRenamed("topic", "id")).select("id", "label")
    titles = index.notes.where("topic IS NOT NULL").groupBy(F.col("topic").alias("id")).agg(F.array_join(F.slice(F.array_sort(F.collect_list("title")), 1, 50), "\n").alias("titles"))
    asked = durable(todo.join(titles, "id"))
    answers = durable(providers.call(asked.select(F.col("id").alias("key"), F.concat(F.lit("Name this topic.\n"), "titles").alias("prompt")), provider, NAME_ANSWER))
    fresh = answers.where("error IS NULL AND result.label IS NOT NULL").select(F.col("key").alias("topic"), "result.label", "result.synopsis").withColumn("at", F.lit(1))
    index.put("topic_names", durable(incremental.upsert(index.table("topic_names").withColumn("at", F.lit(0)), fresh, ["topic"], "at").drop("at")))
    named = index.table("topics")
    index.put("topics", durable(named.join(fresh.select("topic", F.lit(True).alias("__named")), "topic", "left").withColumn("stale", F.col("stale") & F.col("__named").isNull()).select(*named.columns)))
    return _outcome(answers)
