"""The command line: ``python -m quillspark -C FOLDER COMMAND``. Answers are JSON with ``--json``, else lines."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from . import agent
from .functions import providers
from .index import Index
from .server import serve
from .sources.records import Framework, Settings
from .tools import RELATION_TYPES, ToolError, Tools
from .workspace import Refused, Workspace

SETTINGS, FRAMEWORK = "quillspark.toml", "framework.toml"


def session() -> SparkSession:
    """The running session, or one on this machine. A cluster names spark.checkpoint.dir itself."""
    found = SparkSession.getActiveSession()
    if found is not None:
        return found
    return SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _named(path: str | None) -> Callable | None:
    """``module:name``."""
    if not path:
        return None
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


class Context:
    def __init__(self, args: argparse.Namespace):
        self.args, self.root = args, os.path.abspath(args.folder)
        path = os.path.join(self.root, SETTINGS)
        text = open(path, encoding="utf-8").read() if os.path.exists(path) else ""
        self.index = Index(session(), self.root, Settings.parse(text))

    def workspace(self, needed: bool = True) -> Workspace | None:
        path = self.args.framework or os.path.join(self.root, self.index.settings.research_dir, FRAMEWORK)
        if not os.path.exists(path):
            if needed:
                raise Refused(f"no framework at {path}")
            return None
        with open(path, encoding="utf-8") as f:
            return Workspace(self.index, Framework.parse(f.read()))

    def tools(self, **kw) -> Tools:
        self.index.refresh()
        return Tools(self.index, self.workspace(False), **kw)

    def provider(self) -> providers.Provider:
        return _named(self.args.provider) or providers.offline

    def model(self) -> agent.Model:
        found = _named(self.args.model)
        if found is None:
            raise Refused("name a model: --model module:function")
        return found


def _init(c: Context):
    path = os.path.join(c.root, SETTINGS)
    if not os.path.exists(path):
        with open(path, "w", encoding="utf-8") as f:
            f.write('# output_dir = "_notes"\n# link_style = "wiki"\n')
    ignored = os.path.join(c.root, ".gitignore")
    lines = open(ignored, encoding="utf-8").read().splitlines() if os.path.exists(ignored) else []
    if ".quillspark/" not in lines:
        with open(ignored, "a", encoding="utf-8") as f:
            f.write(".quillspark/\n")
    return _organize(c)


def _organize(c: Context):
    return c.index.build() | {"written": c.index.write_pages()}


def _run(c: Context):
    out = {"index": c.index.build()}
    if not c.args.no_model:
        limit = c.args.limit
        out |= {"enrich": agent.enrich(c.provider(), c.index, limit=limit), "link": agent.link(c.provider(), c.index, limit=limit)}
        c.index.build()
        out["topics"] = agent.name_topics(c.provider(), c.index)
    return out | {"written": c.index.write_pages()}


def _pass(run: Callable) -> Callable:
    def go(c: Context):
        c.index.refresh()
        return run(c.provider(), c.index, c.args.force, c.args.limit)

    return go


def _ask(c: Context):
    tools = c.tools(writes=c.args.save)
    said = agent.ask(c.model(), c.index, " ".join(c.args.question), tools.workspace)
    return {"answer": said} | (tools.call("write_note", {"kind": "answers", "title": " ".join(c.args.question), "body": said, "sources": c.args.source}) if c.args.save else {})


def _insights(c: Context):
    c.index.refresh()
    summary, written = agent.insights(c.model(), c.index, c.args.n, c.args.focus)
    return {"summary": summary, "written": written} | _organize(c)


def _topic(c: Context):
    from .tools import rows

    t = c.tools()
    return t.call("topic", {"topic_id": c.args.topic}) if c.args.topic else rows(c.index.topics().orderBy("topic"))


def _tool(name: str, **given: str) -> Callable:
    """A command that is one tool: ``given`` names the argument that each parameter takes."""

    def go(c: Context):
        value = lambda v: " ".join(v) if isinstance(v, list) else v
        args = {k: value(getattr(c.args, v)) for k, v in given.items() if getattr(c.args, v) is not None}
        return c.tools(writes=name == "add_relation").call(name, args)

    return go


def _research(run: Callable) -> Callable:
    def go(c: Context):
        from .tools import rows

        c.index.refresh()
        out = run(c.workspace(), c)
        if hasattr(out, "collect"):
            return rows(out)
        return {k: rows(v) for k, v in out.items()} if isinstance(out, dict) and out and all(hasattr(v, "collect") for v in out.values()) else out

    return go


def _research_run(w: Workspace, c: Context):
    out = {"sync": w.sync()}
    if not c.args.no_model:
        out["extract"] = w.extract(c.provider(), limit=c.args.limit)
    return out | {"check": w.check(), "written": w.write_pages()}


def _question(w: Workspace, c: Context):
    a = c.args
    if a.action == "list":
        return w.table("questions")
    if not a.target:
        raise Refused("a question needs --target")
    return {"question": w.ask(" ".join(a.text), a.target, a.source)}


def _evaluate(w: Workspace, c: Context):
    from pyspark.sql import functions as F

    from .workspace import ANSWER

    spark, folder = w.spark, c.args.gold
    with open(os.path.join(folder, "claims.json"), encoding="utf-8") as f:
        notes = [(k, json.dumps(v)) for k, v in json.load(f).items()]
    claims = spark.createDataFrame(notes, "note string, value string").select("note", F.explode(F.from_json("value", ANSWER)["claims"]).alias("c"))
    gold = claims.select("note", F.col("c.subject.entity").alias("s_entity"), "c.predicate", F.col("c.object.entity").alias("o_entity"), F.coalesce("c.negated", F.lit(False)).alias("negated"))
    path = os.path.join(folder, "expected.json")
    expected = None
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            expected = spark.createDataFrame([(x["type"], x["entities"]) for x in json.load(f).get("cases", [])], "type string, entities array<string>")
    return w.evaluate(gold, expected)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark", description="Index, search and reason over a folder of markdown notes.")
    p.add_argument("-C", "--folder", default=".")
    p.add_argument("--json", action="store_true")
    p.add_argument("--framework", help="framework file")
    p.add_argument("--provider", help="module:function that answers a prompt with JSON")
    p.add_argument("--model", help="module:function of (messages, tools)")
    sub = p.add_subparsers(dest="command", required=True)

    def command(to, name: str, run: Callable, about: str, *options: tuple) -> None:
        sp = to.add_parser(name, help=about, description=about)
        sp.add_argument("--json", action="store_true", default=argparse.SUPPRESS)
        for flags, kw in options:
            sp.add_argument(*flags, **kw)
        sp.set_defaults(run=run)

    o = lambda *flags, **kw: (flags, kw)
    limit, force, tag, topic = o("--limit", type=int), o("--force", action="store_true"), o("--tag"), o("--topic")
    no_model = o("--no-model", action="store_true")
    command(sub, "init", _init, "write a settings file, build the first index")
    command(sub, "index", lambda c: c.index.build(), "build the index again")
    command(sub, "organize", _organize, "build the index and the navigation pages")
    command(sub, "overview", _tool("overview"), "map of the collection")
    command(sub, "search", _tool("search", query="query", limit="limit", tag="tag", topic="topic"), "full-text search", o("query", nargs="+"), o("-n", "--limit", type=int, default=10), tag, topic)
    command(sub, "show", _tool("read_note", note_id="note", section="section", max_chars="max_chars"), "a note, or a section of it", o("note"), o("--section"), o("--max-chars", type=int, dest="max_chars"))
    command(sub, "links", _tool("note_links", note_id="note"), "what a note is tied to", o("note"))
    command(sub, "topic", _topic, "topics, or one of them", o("topic", nargs="?"))
    command(sub, "path", _tool("find_path", from_note="a", to_note="b"), "how two notes connect", o("a"), o("b"))
    command(sub, "notes", _tool("list_notes", tag="tag", topic="topic", sort="sort", limit="limit"), "list notes", tag, topic, o("--sort", choices=["rank", "recent", "title"], default="rank"), o("-n", "--limit", type=int, default=50))
    command(sub, "doctor", _tool("maintenance_report"), "broken links, orphans, duplicates, contradictions")
    command(sub, "relate", _tool("add_relation", src="src", type="type", dst="dst", reason="reason"), "record a relation", o("src"), o("type", choices=RELATION_TYPES), o("dst"), o("reason"))
    command(sub, "enrich", _pass(agent.enrich), "summaries of changed notes", force, limit)
    command(sub, "link", _pass(agent.link), "relations between similar notes", force, limit)
    command(sub, "run", _run, "index, enrich, link, name topics, write pages", no_model, limit)
    command(sub, "ask", _ask, "answer a question from the notes", o("question", nargs="+"), o("--save", action="store_true"), o("--source", action="append", default=[]))
    command(sub, "insights", _insights, "write insight notes", o("-n", type=int, default=3), o("--focus"))
    command(sub, "mcp", lambda c: serve(c.tools(writes=c.args.allow_writes)), "serve the tools on standard input and output", o("--allow-writes", action="store_true"))
    rs = sub.add_parser("research", help="claims, cases, readings and reviews").add_subparsers(dest="research", required=True)

    def research(name: str, run: Callable, about: str, *options: tuple) -> None:
        command(rs, name, _research(run), about, *options)

    research("framework", lambda w, c: w.impact() if c.args.impact else w.frames, "the framework, or what its version touches", o("--impact", action="store_true"))
    research("sync", lambda w, c: w.sync(), "follow renamed, edited and removed notes")
    research("extract", lambda w, c: w.extract(c.provider(), c.args.force, c.args.note, c.args.limit), "claims of changed notes", force, limit, o("--note", action="append"))
    research("check", lambda w, c: w.check(), "run the framework's checks")
    research("run", _research_run, "sync, extract, check, pages", no_model, limit)
    command(rs, "map", _tool("research_overview"), "entities by scale")
    command(rs, "claims", _tool("find_claims", entity="entity", note="note", status="status", text="text", limit="limit"), "list claims", o("--entity"), o("--note"), o("--status"), o("--text"), o("-n", "--limit", type=int, default=50))
    command(rs, "claim", _tool("get_claim", claim_id="id"), "a claim and what bears on it", o("id"))
    research("entity", _entity, "an entity's claims by what they join it to", o("name", nargs="+"))
    command(rs, "cases", _tool("list_cases", case_type="type", status="status"), "list cases", o("--type"), o("--status"))
    command(rs, "case", _tool("get_case", case_id="id"), "a case", o("id"))
    research("question", _question, "ask or list questions", o("action", choices=["new", "list"]), o("text", nargs="*"), o("--target"), o("--source"))
    command(rs, "path", _tool("inspect_path", target="to", source="source"), "competing readings", o("--to", required=True), o("--from", dest="source"))
    command(rs, "context", _tool("compose_context", question_id="question"), "the evidence for a question", o("question"))
    research("narrate", lambda w, c: w.narrate(c.args.question), "two readings, and what tells them apart", o("question"))
    research("investigate", lambda w, c: dict(zip(("report", "claims"), agent.investigate(c.model(), c.index, w, c.args.question, c.args.turns), strict=True)), "let a model look into a question", o("question"), o("--turns", type=int, default=30))
    research("review", _review, "the queue, or a decision", o("action", choices=["queue", "accept", "reject", "defer", "revise"]), o("ids", nargs="*"), o("--note"), o("-m", "--message", default=""), o("--set", action="append", default=[]))
    research("views", lambda w, c: w.write_pages(), "write the research pages")
    research("eval", _evaluate, "scores against a gold set", o("--gold", required=True))
    return p


def _entity(w: Workspace, c: Context):
    from .operators import evidence
    from .tools import _canonical

    return evidence.entity_card(w.links(), _canonical(w, " ".join(c.args.name)).entity)


def _review(w: Workspace, c: Context):
    a = c.args
    return w.queue() if a.action == "queue" else w.review(a.action, a.ids, a.note, a.message, tuple(a.set))


def _show(value, indent: str = "") -> list[str]:
    if isinstance(value, dict):
        return [line for k, v in value.items() for line in ([f"{indent}{k}:", *_show(v, indent + "  ")] if isinstance(v, (dict, list)) else [f"{indent}{k}: {v}"])]
    if isinstance(value, list):
        return [indent + "  ".join(f"{k}={v}" for k, v in x.items()) if isinstance(x, dict) else f"{indent}{x}" for x in value]
    return [f"{indent}{value}"]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        out = args.run(Context(args))
    except (ToolError, Refused) as e:
        print(f"quillspark: {e}", file=sys.stderr)
        return 1
    if out is not None:
        print(json.dumps(out, ensure_ascii=False, default=str) if args.json else "\n".join(_show(out)))
    return 0
