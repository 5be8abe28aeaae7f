"""The tools that a reader, an agent or a server calls by name: answers are plain JSON values, cut at documented bounds."""

from __future__ import annotations

import datetime
import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import slug
from .index import Index
from .operators import evidence, graph, lookup, search, similarity
from .workspace import Refused, Workspace

#: Rows of one answer; characters of a note.
MAX_ROWS, MAX_CHARS = 200, 50_000
# Types of relations between notes, kinds of notes that an agent writes.
RELATION_TYPES = ("supports", "contradicts", "extends", "example_of", "part_of", "prerequisite_for", "alternative_to", "caused_by", "same_topic")
NOTE_KINDS = ("insights", "answers", "questions")


class ToolError(ValueError):
    """What the caller asked for is not there or not allowed; the message says what to do."""


@dataclass(frozen=True)
class Spec:
    name: str
    group: str
    required: dict[str, str]
    optional: dict[str, str]

    def schema(self) -> dict:
        kinds = {"strings": {"type": "array", "items": {"type": "string"}}}
        props = {k: kinds.get(v, {"type": v}) for k, v in (self.required | self.optional).items()}
        return {"type": "object", "properties": props, "required": list(self.required), "additionalProperties": False}


_ = "string"
SPECS = (
    Spec("overview", "read", {}, {}),
    Spec("search", "read", {"query": _}, {"limit": "integer", "tag": _, "topic": _}),
    Spec("read_note", "read", {"note_id": _}, {"section": _, "max_chars": "integer"}),
    Spec("note_links", "read", {"note_id": _}, {}),
    Spec("topic", "read", {"topic_id": _}, {}),
    Spec("find_path", "read", {"from_note": _, "to_note": _}, {}),
    Spec("list_notes", "read", {}, {"tag": _, "topic": _, "sort": _, "limit": "integer"}),
    Spec("maintenance_report", "read", {}, {}),
    Spec("research_overview", "research", {}, {}),
    Spec("find_claims", "research", {}, {"entity": _, "note": _, "status": _, "text": _, "limit": "integer"}),
    Spec("get_claim", "research", {"claim_id": _}, {}),
    Spec("list_cases", "research", {}, {"case_type": _, "status": _}),
    Spec("get_case", "research", {"case_id": _}, {}),
    Spec("inspect_path", "research", {"target": _}, {"source": _}),
    Spec("compose_context", "research", {"question_id": _}, {}),
    Spec("propose_case", "propose", {"title": _, "claim_ids": "strings", "reasoning": _, "explanations": _, "evidence_request": _}, {}),
    Spec("add_relation", "write", {"src": _, "dst": _, "type": _, "reason": _}, {}),
    Spec("write_note", "write", {"kind": _, "title": _, "body": _, "sources": "strings"}, {}),
)


def rows(df: DataFrame, most: int = MAX_ROWS) -> list[dict]:
    """The first ``most`` rows of an answer as JSON values."""
    plain = lambda v: v.isoformat() if isinstance(v, datetime.datetime) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else v
    return [plain(r.asDict(True)) for r in df.limit(most).collect()]


class Tools:
    def __init__(self, index: Index, workspace: Workspace | None = None, writes: bool = False, proposals: bool = False):
        self.index, self.workspace = index, workspace
        self.groups = {"read"} | ({"write"} if writes else set())
        if workspace is not None:
            self.groups |= {"research"} | ({"propose"} if proposals else set())
        #: Paths of the notes that were written.
        self.written: list[str] = []

    def available(self) -> list[Spec]:
        return [s for s in SPECS if s.group in self.groups]

    def definitions(self) -> list[dict]:
        return [{"name": s.name, "description": re.sub(r"\s+", " ", getattr(self, s.name).__doc__).strip(), "input_schema": s.schema()} for s in self.available()]

    def call(self, name: str, args: dict):
        """The answer of a tool; ToolError for an unknown one, for arguments that it doesn't have, and for what it refuses."""
        spec = next((s for s in self.available() if s.name == name), None)
        if spec is None:
            raise ToolError(f"no tool {name}")
        wrong = (set(args) - set(spec.required) - set(spec.optional)) | (set(spec.required) - set(args))
        if wrong:
            raise ToolError(f"{name}: check {', '.join(sorted(wrong))}")
        run: Callable = getattr(self, name)
        try:
            return run(**args)
        except (Refused, graph.TooMany) as e:
            raise ToolError(str(e)) from e

    def resolve(self, name: str) -> str:
        """The id of the note that a name means; ToolError with suggestions."""
        found = lookup.find_note(self.index.table("notes"), name).select("id").first()
        if found is None:
            near = search.did_you_mean(self.index.titled_sections(), self.index.table("notes"), name)
            raise ToolError(f"no note {name}" + (f"; did you mean {', '.join(near)}?" if near else ""))
        return found.id

    # --- notes -------------------------------------------------------------------------------------------------------

    def overview(self) -> dict:
        """Map of the collection: figures, topics, hubs, notes that bridge topics, recent ones, tags, notes of no topic."""
        notes = self.index.notes
        few = lambda df, *order: rows(df.orderBy(*order, "id").select("id", "title"), 8)
        return {
            "stats": self.index.stats(), "topics": rows(self.index.topics().orderBy(F.desc("size"), "topic")), "hubs": few(notes, F.desc("rank")), "bridges": few(notes.where("bridge > 0.3"), F.desc("bridge")),
            "recent": few(notes, F.desc("mtime")), "tags": rows(lookup.tag_histogram(notes)), "unclustered": rows(notes.where("topic IS NULL").orderBy("id").select("id"), 30),
        }

    def search(self, query: str, limit: int = 10, tag: str | None = None, topic: str | None = None) -> list[dict]:
        """Ranked full-text search over titles, headings, texts and tags, with a snippet of the best section."""
        return rows(self.index.search(query, limit, tag, topic).withColumnRenamed("note_id", "id"), limit)

    def read_note(self, note_id: str, section: str | None = None, max_chars: int = MAX_CHARS) -> dict:
        """A note, or one section of it by heading or anchor, with what is known about it."""
        note = self.resolve(note_id)
        own = self.index.table("notes").where(F.col("id") == note)
        head = rows(own.select("id", "title", "tags", "topic", "word_count", "mtime"))[0] | next(iter(rows(self.index.table("enrichment").where(F.col("id") == note).select("summary", "key_claims", "open_questions"))), {})
        if section is not None:
            found = rows(lookup.read_section(self.index.table("sections"), note, section, max_chars))
            if not found:
                raise ToolError(f"{note} has no section {section}")
            return head | {"sections": found}
        cut = F.when(F.length("body") > max_chars, F.concat(F.substring("body", 1, max_chars), F.lit("\n[cut]"))).otherwise(F.col("body"))
        return head | {"text": own.select(cut.alias("text")).first().text}

    def note_links(self, note_id: str) -> dict:
        """A note's links, backlinks, relations and similar notes (and whether they are linked already)."""
        note, links = self.resolve(note_id), self.index.table("links")
        near = similarity.most_similar(self.index.table("similar"), note, self.index.settings.related_k)
        linked = links.where("dst IS NOT NULL").where((F.col("src") == note) | (F.col("dst") == note)).select(F.when(F.col("src") == note, F.col("dst")).otherwise(F.col("src")).alias("dst")).distinct().withColumn("already_linked", F.lit(True))
        return {
            "links": rows(lookup.outlinks(links, note).orderBy("target")), "backlinks": [r["src"] for r in rows(lookup.backlinks(links).where(F.col("dst") == note).orderBy("src"))],
            "relations": rows(lookup.relations_of(self.index.table("relations"), note).orderBy("src", "dst", "type")),
            "similar": rows(near.select("dst", "score").join(linked, "dst", "left").select(F.col("dst").alias("id"), "score", F.coalesce("already_linked", F.lit(False)).alias("already_linked")).orderBy(F.desc("score"), "id")),
        }

    def topic(self, topic_id: str) -> dict:
        """A topic by id or label: its notes by rank, and the topics it has most ties to."""
        found = self.index.topics().where((F.col("topic") == topic_id) | (F.lower("label") == topic_id.lower())).orderBy("topic").first()
        if found is None:
            raise ToolError(f"no topic {topic_id}")
        placed = self.index.notes.where("topic IS NOT NULL").select("id", F.col("topic").alias("community"))
        near = graph.neighbouring_groups(self.index.table("edges"), placed).where(F.col("grp") == found.topic)
        return found.asDict() | {"notes": rows(self.index.notes.where(F.col("topic") == found.topic).orderBy(F.desc("rank"), "id").select("id", "title", "rank")), "near": rows(near.orderBy("rank").select(F.col("other").alias("topic"), "weight"))}

    def find_path(self, from_note: str, to_note: str) -> dict:
        """How two notes connect: the shortest chain of notes, and why each follows the last."""
        found = graph.shortest_path(self.index.table("edges"), self.resolve(from_note), self.resolve(to_note)).first()
        if found is None:
            return {"path": [], "reasons": []}
        steps = self.index.spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(found.path, found.path[1:]))], "i int, src string, dst string")
        reasons = lookup.edge_reason(steps, self.index.table("links"), self.index.table("relations"), self.index.table("similar"))
        return {"path": found.path, "reasons": [r["reason"] for r in rows(steps.join(reasons, ["src", "dst"]).orderBy("i"))]}

    def list_notes(self, tag: str | None = None, topic: str | None = None, sort: str = "rank", limit: int = 50) -> list[dict]:
        """Notes with a tag or of a topic, by rank, date or title."""
        if sort not in ("rank", "recent", "title"):
            raise ToolError(f"no order {sort}")
        return rows(lookup.list_notes(self.index.notes, tag and tag.lower(), topic, sort, limit).select("id", "title", "tags", "topic", "rank"), limit)

    def maintenance_report(self) -> dict:
        """Broken links, unconnected notes, likely duplicates, contradictions."""
        links = self.index.table("links")
        return {
            "broken": rows(lookup.broken_links(links).orderBy("src", "target")), "orphans": [r["id"] for r in rows(lookup.orphans(self.index.notes.select("id"), links).orderBy("id"))],
            "duplicates": rows(similarity.possible_duplicates(self.index.table("similar"))), "contradictions": rows(self.index.table("relations").where("type = 'contradicts'").orderBy("src", "dst")),
        }

    # --- claims ------------------------------------------------------------------------------------------------------

    def research_overview(self) -> dict:
        """The framework's lanes, claims by status, cases by type, questions."""
        w = self.workspace
        links = w.links()
        lanes = evidence.lanes(links, w.levels(links).select("entity", "scales"))
        return {"framework": w.framework.ref, "lanes": rows(lanes.orderBy("scale", "rank")), "claims": rows(evidence.status_counts(w.table("claims")).orderBy("status")), "cases": rows(w.table("cases").groupBy("type").agg(F.count("*").alias("n")).orderBy("type")), "questions": rows(w.table("questions").orderBy("id"))}

    def find_claims(self, entity: str | None = None, note: str | None = None, status: str | None = None, text: str | None = None, limit: int = 30) -> list[dict]:
        """Claims of an entity (by any of its names), a note or a status, or with words in their passage."""
        w = self.workspace
        own = w.table("claims")
        if entity is not None:
            own = w.live() if status is None else own
            entity = next((r.entity for r in [_canonical(w, entity)] if r), entity)
        found = evidence.find_claims(own, entity, note and self.resolve(note), status, text, limit)
        return rows(found.select("id", "note", "status", "passage").join(evidence.claim_brief(found), "id").orderBy("id"), limit)

    def get_claim(self, claim_id: str) -> dict:
        """A claim with the lines around its passage, how it is read, related claims and reviews."""
        found = {k: rows(v) for k, v in self.workspace.claim(claim_id).items()}
        if not found["claim"]:
            raise ToolError(f"no claim {claim_id}")
        return found | {"claim": found["claim"][0]}

    def list_cases(self, case_type: str | None = None, status: str | None = None) -> list[dict]:
        """Cases of a type or a status."""
        own = self.workspace.table("cases")
        for column, value in (("type", case_type), ("status", status)):
            own = own.where(F.col(column) == value) if value is not None else own
        return rows(own.select("id", "type", "title", "status").orderBy("type", "id"))

    def get_case(self, case_id: str) -> dict:
        """A case with its claims; not what reviewers noted."""
        found = rows(self.workspace.table("cases").where(F.col("id") == case_id).drop("notes"))
        if not found:
            raise ToolError(f"no case {case_id}")
        return found[0]

    def inspect_path(self, target: str, source: str | None = None) -> list[dict]:
        """Competing readings that end at a target, with the status of each step."""
        return rows(self.workspace.readings(target, source))

    def compose_context(self, question_id: str) -> dict:
        """The claims, counterevidence and exclusions that an investigation of a question should look at, and about how many tokens they are."""
        picked = rows(self.workspace.context(question_id))
        ids = sorted({r["id"] for r in picked})
        own = self.workspace.table("claims").where(F.col("id").isin(ids))
        briefs = {r["id"]: r["claim"] for r in rows(evidence.claim_brief(own))}
        parts: dict[str, list] = {}
        for r in picked:
            parts.setdefault(r["part"], []).append({"id": r["id"], "claim": briefs.get(r["id"], "")})
        return parts | {"tokens": sum(len(b) for b in briefs.values()) // 4}

    def propose_case(self, title: str, claim_ids: list[str], reasoning: str, explanations: str, evidence_request: str) -> dict:
        """Propose a finding for review: the claims it rests on, how they fit, what may explain it, which evidence would decide."""
        text = f"## Reasoning\n{reasoning}\n\n## Explanations\n{explanations}\n\n## Evidence that would decide\n{evidence_request}"
        return {"case": self.workspace.propose_case(title, claim_ids, text)}

    # --- writing -----------------------------------------------------------------------------------------------------

    def add_relation(self, src: str, dst: str, type: str, reason: str) -> dict:  # noqa: A002 - the argument's public name
        """Record a typed relation between two notes, with its reason."""
        if type not in RELATION_TYPES:
            raise ToolError(f"no relation {type}: one of {', '.join(RELATION_TYPES)}")
        a, b = self.resolve(src), self.resolve(dst)
        if a == b:
            raise ToolError("a note has no relation to itself")
        self.index.relate(self.index.spark.createDataFrame([(a, b, type, reason, 1.0, "tool")], "src string, dst string, type string, reason string, confidence double, source string"))
        return {"relation": f"{a} {type} {b}"}

    def write_note(self, kind: str, title: str, body: str, sources: list[str]) -> dict:
        """Write a note (insights, answers or questions) that names its sources."""
        if kind not in NOTE_KINDS:
            raise ToolError(f"no kind {kind}: one of {', '.join(NOTE_KINDS)}")
        if not sources:
            raise ToolError("name at least one source note")
        ids = [self.resolve(s) for s in sources]
        name = self.index.spark.range(1).select(F.substring(slug(F.lit(title)), 1, 60).alias("s")).first().s
        stem = f"{datetime.date.today().isoformat()}-{name}"
        folder = os.path.join(self.index.root, self.index.settings.output_dir, kind)
        os.makedirs(folder, exist_ok=True)
        text = "\n".join([f"# {title}", "", body.strip(), "", "## Sources", *[f"- [[{i}]]" for i in ids], ""])
        for n in range(1, 1000):
            path = os.path.join(folder, f"{stem}{'' if n == 1 else f'-{n}'}.md")
            try:
                with open(path, "x", encoding="utf-8") as f:
                    f.write(text)
                break
            except FileExistsError:
                continue
        else:
            raise ToolError(f"too many notes named {stem}")
        self.written.append(os.path.relpath(path, self.index.root))
        return {"path": self.written[-1]}


def _canonical(w: Workspace, name: str):
    from .operators.research import canonical_names

    one = w.spark.createDataFrame([(name,)], "entity string")
    return canonical_names(one, w.table("entities"), "entity").first()
