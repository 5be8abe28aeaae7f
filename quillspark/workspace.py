"""Evidence-linked claims of a notes folder: extraction by an injected model, sync, checks, readings, reviews, pages.

Tables are snapshots under ``<root>/<research_dir>/tables``; what can be said of them is in ``operators``.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import providers
from .functions.text import identifier, passage_hash, study_id
from .index import Index
from .operators import evidence, graph, incremental, lookup, passages, render, research, views
from .operators.graph import durable
from .sources.records import Framework, has_snapshot, read_snapshot, write_snapshot

_SIDE = "{s}_entity string, {s}_property string, {s}_direction string, {s}_activity_effect string, {s}_effect_basis string, {s}_scales array<string>"
CLAIM = (
    "id string, note string, note_revision string, study string, predicate string, claim_type string, evidence string, negated boolean, confidence double, status string, status_reason string, framework string, passage string, "
    f"line int, match string, supersedes string, context map<string,string>, {_SIDE.format(s='s')}, {_SIDE.format(s='o')}"
)
TABLES = {
    "claims": CLAIM,
    "cases": "id string, type string, title string, status string, inputs array<string>, entities array<string>, text string, notes string",
    "mappings": "key string, entity string, property string, scales array<string>, votes long, status string",
    "entities": "canonical string, aliases array<string>, status string, pos int",
    "reviews": "target string, action string, reason string, at string",
    "questions": "id string, question string, target string, source string",
    "narratives": "question string, label string, path array<string>, statuses array<string>, net int, score double",
    "extracted": "id string, state string",
    "revisions": "id string, hash string",
}
_PART = "struct<entity: string, property: string, direction: string, activity_effect: string, effect_basis: string, scales: array<string>>"
#: What a model answers for a note.
ANSWER = f"study_label string, claims array<struct<quote: string, claim_type: string, subject: {_PART}, predicate: string, object: {_PART}, negated: boolean, context: map<string,string>, evidence: string, confidence: double>>"
ACTIONS = {"accept": "accepted", "reject": "rejected", "defer": "deferred"}
MAX_STEPS, MIN_WEIGHT = 6, 0.3


class Refused(ValueError):
    """A request that names something unknown, or that is not allowed."""


def set_path(row: dict, setting: str) -> None:
    """Apply ``a.b=value`` to nested dicts; the value is JSON, or else taken as text."""
    path, _, raw = setting.partition("=")
    try:
        value = json.loads(raw)
    except json.JSONDecodeError:
        value = raw
    *above, last = path.split(".")
    for key in above:
        row = row.setdefault(key, {})
        if not isinstance(row, dict):
            raise Refused(f"{path}: {key} holds no fields")
    row[last] = value


def nested(row: dict) -> dict:
    """A flat claim row with its subject and object as dicts."""
    out = {k: v for k, v in row.items() if k[:2] not in ("s_", "o_")}
    return out | {name: {k[2:]: v for k, v in row.items() if k.startswith(s)} for name, s in (("subject", "s_"), ("object", "o_"))}


def flat(claim: dict) -> dict:
    out = {k: v for k, v in claim.items() if k not in ("subject", "object")}
    return out | {f"{s}_{k}": v for name, s in (("subject", "s"), ("object", "o")) for k, v in claim[name].items()}


class Workspace:
    def __init__(self, index: Index, framework: Framework):
        self.index, self.framework, self.spark = index, framework, index.spark
        self.base = f"{index.root}/{index.settings.research_dir}"
        self.frames = framework.frames(index.spark)

    # --- tables ------------------------------------------------------------------------------------------------------

    def table(self, name: str) -> DataFrame:
        path = f"{self.base}/tables/{name}"
        return read_snapshot(self.spark, path) if has_snapshot(self.spark, path) else self.spark.createDataFrame([], TABLES[name])

    def put(self, name: str, df: DataFrame) -> None:
        wanted = T.StructType.fromDDL(TABLES[name])
        write_snapshot(durable(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])), f"{self.base}/tables/{name}")

    def _log(self, rows: list[tuple[str, str, str]]) -> None:
        now = datetime.now(timezone.utc).isoformat(timespec="seconds")
        if rows:
            self.put("reviews", self.table("reviews").unionByName(self.spark.createDataFrame([(*r, now) for r in rows], TABLES["reviews"])))

    def live(self) -> DataFrame:
        """Claims in use, entities by their canonical names."""
        own = research.live(self.table("claims"), self.framework.id)
        for side in ("s_entity", "o_entity"):
            own = research.canonical_names(own, self.table("entities"), side)
        return own

    def links(self) -> DataFrame:
        return research.signed_links(self.live(), self.frames["relations"], self.frames["evidence"])

    def levels(self, links: DataFrame) -> DataFrame:
        """entity, scales, level by the votes of its mappings."""
        named = research.canonical_names(self.table("mappings"), self.table("entities"), "entity")
        return research.entity_scales(named, self.frames["scales"].select("id", "idx"), links.select(F.explode(F.array("s_entity", "o_entity")).alias("entity")))

    # --- extraction --------------------------------------------------------------------------------------------------

    def pending(self) -> DataFrame:
        """Notes whose text or framework changed since they were read for claims."""
        state = F.concat("hash", F.lit("@"), F.lit(self.framework.ref))
        return incremental.todo(self.index.notes.withColumn("state", state), self.table("extracted"), "id", "state")

    def extract(self, provider: providers.Provider, force: bool = False, notes: list[str] | None = None, limit: int | None = None) -> dict:
        """Ask for the claims of notes that changed; quotes that don't occur in their note give no claim. Reviews stay."""
        todo = self.index.notes.withColumn("state", F.concat("hash", F.lit("@"), F.lit(self.framework.ref))) if force else self.pending()
        todo = todo.where(F.col("id").isin(notes)) if notes else todo
        todo = durable(todo.orderBy("id").limit(limit) if limit else todo)
        prompt = F.concat(F.lit("Claims of this note, as JSON.\nNote: "), "id", F.lit("\n\n"), "raw")
        answers = durable(providers.call(todo.select(F.col("id").alias("key"), prompt.alias("prompt")), provider, ANSWER))
        good = answers.where("error IS NULL").select(F.col("key").alias("note"), "result.study_label", F.posexplode("result.claims").alias("k", "c"))
        asked = good.join(todo.select(F.col("id").alias("note"), "raw", F.col("hash").alias("note_revision"), "frontmatter"), "note")
        asked = durable(asked.withColumn("qid", F.concat_ws("#", "note", F.col("k").cast("string"))))
        found = passages.locate_quotes(asked.select(F.col("qid").alias("id"), F.col("c.quote").alias("quote"), F.col("raw").alias("note"))).where("line_start IS NOT NULL")
        fm = lambda k: F.get_json_object(F.try_element_at("frontmatter", F.lit(k)), "$")
        study = study_id(fm("doi"), fm("pmid"), fm("pmcid"), fm("study_id"), F.coalesce("study_label", fm("source")), F.col("note"))
        part = lambda s, name: [F.col(f"c.{name}.{k}").alias(f"{s}_{k}") for k in ("entity", "property", "direction", "activity_effect", "effect_basis", "scales")]
        sides = [F.to_json(F.col(f"c.{name}")) for name in ("subject", "object")]
        fresh = asked.join(found.select(F.col("id").alias("qid"), "text", "line_start", "match"), "qid").select(
            identifier("c-", passage_hash(F.col("text")), F.col("note"), F.col("c.predicate"), *sides).alias("id"), "note", "note_revision", study.alias("study"), "c.predicate", "c.claim_type", "c.evidence",
            F.coalesce("c.negated", F.lit(False)).alias("negated"), "c.confidence", F.lit("proposed").alias("status"), F.lit(None).cast("string").alias("status_reason"), F.lit(self.framework.ref).alias("framework"),
            F.col("text").alias("passage"), F.col("line_start").alias("line"), "match", F.lit(None).cast("string").alias("supersedes"), "c.context", *part("s", "subject"), *part("o", "object"),
        )
        fresh = durable(fresh.dropDuplicates(["id"]))
        claims, read = self.table("claims"), answers.where("error IS NULL").select(F.col("key").alias("note"))
        own = claims.join(read, "note", "left_semi").select(*claims.columns)
        merged = durable(incremental.merge_claims(own.select("id", "status"), fresh.select("id", "status")))
        rows = fresh.unionByName(own.join(fresh.select("id"), "id", "left_anti").select(*fresh.columns)).drop("status").join(merged, "id")
        self.put("claims", claims.join(read, "note", "left_anti").select(*fresh.columns).unionByName(rows.select(*fresh.columns)))
        self._vote()
        state = todo.select("id", "state").join(read.select(F.col("note").alias("id")), "id", "left_semi").withColumn("at", F.lit(1))
        self.put("extracted", incremental.upsert(self.table("extracted").withColumn("at", F.lit(0)), state, ["id"], "at").select("id", "state"))
        failed = answers.where("error IS NOT NULL")
        return {"notes": read.count(), "claims": fresh.count(), "not_found": asked.count() - found.count(), "failed": {r.key: r.error for r in failed.orderBy("key").limit(200).collect()}}

    def _vote(self) -> None:
        """Tally the scales that claims give their participants; a mapping that was reviewed stays as it is."""
        own = self.table("claims").where(F.col("status").isin(*research.LIVE))
        side = lambda s: own.select(F.col(f"{s}_entity").alias("entity"), F.coalesce(f"{s}_property", F.lit("")).alias("property"), F.col("id").alias("claim"), F.col(f"{s}_scales").alias("scales"))
        sources = side("s").unionByName(side("o")).withColumn("key", F.concat_ws("|", "entity", "property"))
        tally = research.mapping_tally(sources.select("key", "claim", "scales"), self.frames["scales"].select("id", "idx"))
        named = tally.join(sources.select("key", "entity", "property").distinct(), "key").withColumn("status", F.lit("proposed"))
        kept = self.table("mappings").where("status <> 'proposed'")
        self.put("mappings", kept.unionByName(named.join(kept.select("key"), "key", "left_anti").select(*kept.columns)))

    # --- sync, checks ------------------------------------------------------------------------------------------------

    def sync(self) -> dict:
        """Follow notes that were renamed, edited or removed; claims whose passage is gone and cases built on them are stale."""
        now = self.index.notes.select("id", "hash", F.col("raw").alias("text"))
        before, claims = self.table("revisions"), self.table("claims")
        moved = durable(incremental.renames(before, now.select("id", "hash")))
        synced = durable(incremental.sync_claims(claims.select("id", "note", "note_revision", "status", "passage"), before, now))
        changed = claims.select("id", F.col("status").alias("was")).join(synced.select("id", "status"), "id").where("was <> status")
        report = {"renamed": [[r.old_id, r.new_id] for r in moved.orderBy("old_id").limit(200).collect()], "changed": {r.status: r.n for r in changed.groupBy("status").agg(F.count("*").alias("n")).collect()}}
        self.put("claims", claims.drop("note", "note_revision", "status").join(synced, "id"))
        self.put("extracted", incremental.carry_over(self.table("extracted"), moved, "id"))
        self.put("revisions", now.select("id", "hash"))
        return report | {"stale_cases": self._mark_stale()}

    def _mark_stale(self) -> list[str]:
        cases = self.table("cases")
        dead = durable(evidence_stale(cases, self.table("claims")))
        ids = [r.id for r in dead.orderBy("id").limit(200).collect()]
        if ids:
            self.put("cases", cases.join(dead.withColumn("__dead", F.lit(True)), "id", "left").withColumn("status", F.when(F.col("__dead"), "stale").otherwise(F.col("status"))))
        return ids

    def check(self) -> dict:
        """Run the framework's checks over the live claims and store their cases: a review and what reviewers noted stay, cases
        that no check finds any more go (or are stale, if they were reviewed), and those that an agent proposed stay."""
        links = durable(self.links())
        levels = durable(self.levels(links).select("entity", "level"))
        chosen = research.representative_links(links)
        tension = evidence.tension_cases(research.sign_tensions(links), links.join(chosen.select("id"), "id", "left_semi"), levels)
        name = F.concat("a", F.lit(" and "), "b")
        case = lambda df, kind, title, inputs, entities: df.select(F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), title.alias("title"), inputs.alias("inputs"), F.array_sort(entities).alias("entities"))
        pair = F.array("a", "b")
        conflicts, agree, bridges = research.conflicting_results(links), research.triangulation(links, 2, MIN_WEIGHT), research.missing_bridges(links, levels)
        produced = {
            "conditional_sign_tension": case(tension, F.col("type"), F.concat(F.lit("Opposing signs: "), F.array_join(F.array_sort("nodes"), ", ")), F.col("inputs"), F.col("nodes")),
            "conflicting_result": case(conflicts, "conflicting_result", F.concat(name, F.lit(": "), "label"), F.when(F.col("label") == "opposite directions", F.concat("positive", "negative")).otherwise(F.concat("positive", "negative", "no_effect")), pair),
            "independent_evidence": case(agree, "triangulation", F.concat(name, F.lit(": "), F.col("n_studies").cast("string"), F.lit(" studies agree")), F.col("inputs"), pair),
            "missing_bridge": case(bridges, "missing_bridge", F.concat(name, F.lit(": no causal evidence")), F.col("inputs"), pair),
        }
        enabled = tuple(c["id"] for c in self.framework.checks if c["id"] in produced) if self.framework.checks else tuple(produced)
        if not enabled:
            return {}
        found = durable(evidence.run_checks(produced, enabled))
        digest = F.sha2(F.array_join(F.array_sort("inputs"), ","), 256).alias("digest")
        stored = self.table("cases")
        own = stored.where("type <> 'agent_finding'")
        outcome = durable(incremental.persist_checks(found.select("id", digest), own.select("id", digest, "status")))
        before = own.select("id", F.col("status").alias("was"), F.col("text").alias("said"), F.col("notes").alias("noted"))
        fresh = found.join(before, "id", "left").select("id", "type", "title", F.coalesce("was", F.lit("proposed")).alias("status"), "inputs", "entities", F.col("said").alias("text"), F.col("noted").alias("notes"))
        old = own.join(outcome.where("outcome = 'stale'").select("id"), "id", "left_semi").withColumn("status", F.lit("stale")).select(*stored.columns)
        self.put("cases", fresh.unionByName(old).unionByName(stored.where("type = 'agent_finding'")))
        return {r.outcome: r.n for r in outcome.groupBy("outcome").agg(F.count("*").alias("n")).collect()}

    def propose_case(self, title: str, claim_ids: list[str], text: str = "") -> str:
        """Store an agent's finding for review; every claim it names has to exist."""
        claims = self.table("claims").where(F.col("id").isin(claim_ids))
        rows = claims.select("id", "s_entity", "o_entity").collect()  # as many as were named
        missing = sorted(set(claim_ids) - {r.id for r in rows})
        if missing or not rows:
            raise Refused(f"no claim {', '.join(missing)}" if missing else "a case needs a claim")
        row = self.spark.createDataFrame([(title, sorted(set(claim_ids)), sorted({e for r in rows for e in (r.s_entity, r.o_entity)}), text)], "title string, inputs array<string>, entities array<string>, text string")
        made = durable(row.select(identifier("case-", F.col("title"), F.array_join("inputs", ",")).alias("id"), F.lit("agent_finding").alias("type"), "title", F.lit("proposed").alias("status"), "inputs", "entities", "text", F.lit("").alias("notes")))
        stored = self.table("cases")
        self.put("cases", stored.unionByName(made.join(stored.select("id"), "id", "left_anti").select(*stored.columns)))
        return made.first().id

    # --- reviews -----------------------------------------------------------------------------------------------------

    def review(self, action: str, ids: list[str], note: str | None = None, reason: str = "", sets: tuple[str, ...] = ()) -> list[str]:
        """Accept, reject, defer or revise claims, ``map:`` mappings, ``ent:`` merges and cases; what rests on them may become stale.
        With ``note``, also all its proposed claims. The ids that were reviewed (of a revised claim, the new one)."""
        if action not in (*ACTIONS, "revise"):
            raise Refused(f"no action {action}")
        if note is not None:
            ids = [*ids, *[r.id for r in self.table("claims").where((F.col("note") == note) & (F.col("status") == "proposed")).select("id").orderBy("id").collect()]]
        done, log = [], []
        groups = {"claims": [i for i in ids if i.startswith("c-")], "mappings": [i for i in ids if i.startswith("map:")], "entities": [i for i in ids if i.startswith("ent:")]}
        groups["cases"] = [i for i in ids if not any(i in g for g in groups.values())]
        for name, key, named in (("claims", "id", groups["claims"]), ("mappings", "key", groups["mappings"]), ("entities", "canonical", groups["entities"]), ("cases", "id", groups["cases"])):
            if not named:
                continue
            bare = [i.split(":", 1)[1] if name in ("mappings", "entities") else i for i in named]
            stored = self.table(name)
            missing = sorted(set(bare) - {r[0] for r in stored.where(F.col(key).isin(bare)).select(key).collect()})
            if missing:
                raise Refused(f"nothing in {name} with id {', '.join(missing)}")
            hit = F.col(key).isin(bare)
            if action == "revise" and name == "claims":
                done += [self._revise(i, sets, reason) for i in bare]
            elif action == "revise" and name == "cases":
                raise Refused("revise applies to claims and mappings")
            else:
                changed = stored.withColumn("status", F.when(hit, ACTIONS.get(action, "accepted")).otherwise(F.col("status")))
                if name == "claims":
                    changed = changed.withColumn("status_reason", F.when(hit, reason).otherwise(F.col("status_reason")))
                if action == "revise" and name == "mappings":
                    scales = [x for s in sets if s.startswith("scales=") for x in s.removeprefix("scales=").split(",") if x]
                    unknown = set(scales) - {s["id"] for s in self.framework.scales} - {research.UNMAPPED}
                    if unknown:
                        raise Refused(f"unknown scales {', '.join(sorted(unknown))}")
                    changed = changed.withColumn("scales", F.when(hit, F.array(*map(F.lit, scales))).otherwise(F.col("scales")))
                self.put(name, changed)
                done += named
                log += [(i, action, reason) for i in named]
        self._log(log)
        self._mark_stale()
        return done

    def _revise(self, claim: str, sets: tuple[str, ...], reason: str) -> str:
        claims = self.table("claims")
        row = nested(claims.where(F.col("id") == claim).first().asDict(True))
        for s in sets:
            set_path(row, s)
        unknown = set(flat(row)) - set(claims.columns)
        if unknown:
            raise Refused(f"a claim has no {', '.join(sorted(unknown))}")
        new = self.spark.createDataFrame([json.dumps(flat(row), default=str)], "string").select(F.from_json("value", CLAIM).alias("c")).select("c.*")
        made = durable(new.withColumn("supersedes", F.lit(claim)).withColumn("status", F.lit("accepted")).withColumn("status_reason", F.lit(reason or "revised by a reviewer")).withColumn("id", identifier("c-", F.lit(claim), *[F.lit(s) for s in sorted(sets)])))
        hit = F.col("id") == claim
        new_id = made.first().id
        old = claims.withColumn("status_reason", F.when(hit, f"revised as {new_id}").otherwise(F.col("status_reason"))).withColumn("status", F.when(hit, "superseded").otherwise(F.col("status")))
        self.put("claims", old.where(F.col("id") != new_id).unionByName(made.select(*old.columns)))
        self._log([(claim, "revise", reason), (new_id, "accept", f"revision of {claim}")])
        return new_id

    def queue(self) -> dict[str, DataFrame]:
        waiting = F.col("status").isin(*evidence.PENDING)
        return {"claims": evidence.review_queue(self.table("claims")), "cases": self.table("cases").where(waiting), "mappings": self.table("mappings").where("status = 'proposed'"), "entities": self.table("entities").where("status = 'proposed'")}

    def impact(self) -> DataFrame:
        return evidence.framework_impact(self.table("claims"), self.table("mappings").select("entity", F.array_except("scales", F.array(F.lit(research.UNMAPPED))).alias("scales")), self.frames["relations"], self.frames["scales"], self.framework.ref)

    # --- reading -----------------------------------------------------------------------------------------------------

    def claim(self, claim: str) -> dict[str, DataFrame]:
        """A claim, the lines around its passage, what else is said of its pair, its reviews."""
        own = self.table("claims").where(F.col("id") == claim)
        lines = self.index.notes.select(F.col("id").alias("note"), F.posexplode(F.split("raw", "\n")).alias("at", "text")).withColumn("at", F.col("at") + 1)
        around = lookup.excerpt(lines, own.select("note", F.col("line").alias("mark")), "note", "at", 2).select("at", "text").orderBy("at")
        links = self.links()
        return {"claim": own.join(evidence.claim_brief(own), "id"), "excerpt": around, "read_as": links.where(F.col("id") == claim).select("kind", "sign", "demoted", "assumed"), "related": evidence.related_claims(links, claim), "reviews": self.table("reviews").where(F.col("target") == claim)}

    def ask(self, question: str, target: str, source: str | None = None) -> str:
        row = self.spark.createDataFrame([(question, target, source)], "question string, target string, source string")
        made = durable(row.withColumn("id", evidence.question_id(F.col("target"), F.coalesce("source", F.lit("any")))))
        stored = self.table("questions")
        self.put("questions", stored.join(made.select("id"), "id", "left_anti").select(*stored.columns).unionByName(made.select(*stored.columns)))
        return made.first().id

    def readings(self, target: str, source: str | None = None, k: int = 3) -> DataFrame:
        """rank, path, statuses, net, score of ``k`` competing readings. Without a source they start at the lowest entity (then the
        furthest) from which the target is reached; if nothing reaches it, at the best end with a last step that is missing."""
        links = durable(self.links())
        placed = durable(self.levels(links))
        steps = evidence.step_options(links).select("src", "dst", "sign", F.when(F.col("how") == "assumed-direction", "associative").otherwise(F.col("how")).alias("kind"))
        if source is None:
            back = evidence.reachable(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst")), target, MAX_STEPS).where("hops > 0").join(placed, F.col("node") == F.col("entity"))
            first = back.orderBy(F.when(F.col("level") >= 0, F.col("level")).otherwise(1 << 30), F.desc("hops"), "node").first()
            if first is None:
                raise Refused(f"nothing leads to {target}")
            source = first.node
        found = durable(graph.simple_paths(steps, source, target, MAX_STEPS))
        gap = None
        if found.isEmpty():
            gap = evidence.best_end(evidence.reachable(steps, source, MAX_STEPS), placed.select("entity", "level")).first().node
            found = durable(graph.simple_paths(steps, source, gap, MAX_STEPS)) if gap != source else self.spark.createDataFrame([([source], [], [])], found.schema)
        best = found.withColumn("n", F.monotonically_increasing_id())
        nodes = best.select("n", F.explode("path").alias("entity")).join(placed, "entity", "left").groupBy("n").agg(F.collect_list("level").alias("levels"))
        score = F.when(F.size("kinds") > 0, graph.path_score(F.col("kinds"), F.col("levels"))).otherwise(0.0)
        scored = best.join(nodes, "n").groupBy("path").agg(F.max(score).alias("score"), F.min(graph.net_sign(F.col("signs"))).alias("net"))
        order = F.struct((-F.col("score")).alias("s"), F.col("path").alias("p"))
        chosen = durable(research.competing(durable(scored.select(order.alias("rank"), "path", "score", "net")), k))
        state = research.step_status(links, research.challenged_pairs(self.table("cases")))
        walk = chosen.where("size(path) > 1").select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst")))).alias("i", "e")).select("path", "i", "e.*")
        walked = walk.join(state.select("src", "dst", "status"), ["src", "dst"], "left").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("status", F.lit("Missing")).alias("s")))), lambda x: x["s"]).alias("statuses"))
        out = chosen.join(walked, "path", "left").withColumn("statuses", F.coalesce("statuses", F.array().cast("array<string>")))
        if gap is not None:
            out = out.withColumn("path", F.array_append("path", F.lit(target))).withColumn("statuses", F.array_append("statuses", F.lit("Missing"))).withColumn("net", F.lit(0))
        return out.orderBy("rank").select("path", "statuses", "net", "score")

    def narrate(self, question: str) -> DataFrame:
        """The two competing readings of a question, stored; observations that tell them apart (question, n, kind, observation)."""
        asked = self.table("questions").where(F.col("id") == question).first()
        if asked is None:
            raise Refused(f"no question {question}")
        rows = self.readings(asked.target, asked.source, 2).collect()  # at most two
        made = durable(self.spark.createDataFrame([(question, "AB"[i], r.path, r.statuses, r.net, r.score) for i, r in enumerate(rows)], TABLES["narratives"]))
        self.put("narratives", self.table("narratives").where(F.col("question") != question).unionByName(made))
        if len(rows) < 2:
            return self.spark.createDataFrame([], "question string, n int, kind string, observation string")
        pair = self.spark.createDataFrame([(question, rows[0].path, rows[1].path, rows[0].net, rows[1].net)], "pair string, a array<string>, b array<string>, sign_a int, sign_b int")
        return evidence.predictions(pair).withColumnRenamed("pair", "question")

    def context(self, question: str) -> DataFrame:
        """part, id: what an investigation of a question should look at."""
        asked = self.table("questions").where(F.col("id") == question).first()
        if asked is None:
            raise Refused(f"no question {question}")
        links = durable(self.links())
        nodes = durable(self.readings(asked.target, asked.source)).select(F.col("path").alias("nodes"))
        pairs = nodes.where("size(nodes) > 1").select(F.explode(F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda i: F.struct(F.least(F.element_at("nodes", i), F.element_at("nodes", i + 1)).alias("a"), F.greatest(F.element_at("nodes", i), F.element_at("nodes", i + 1)).alias("b")))).alias("p")).select("p.*").distinct()
        claims = links.join(pairs, ["a", "b"]).agg(F.collect_set("id").alias("claims"))
        paths = nodes.agg(F.array_distinct(F.flatten(F.collect_list("nodes"))).alias("nodes")).join(F.broadcast(claims))
        out = self.table("claims").where(F.col("status").isin(*research.DEAD))
        return evidence.evidence_package(paths, links, self.table("cases").where("status <> 'rejected'"), out)

    # --- pages, scores -----------------------------------------------------------------------------------------------

    def pages(self) -> DataFrame:
        links, claims, cases = durable(self.links()), self.table("claims"), self.table("cases")
        lines = durable(views.claim_lines(claims, research.uncertainty(links)))
        scales = self.levels(links)
        parts = [
            views.case_pages(cases, lines), views.entity_pages(links, scales.select("entity", "scales"), lines, cases), views.map_page(links, scales.select("entity", "scales"), self.frames["scales"]),
            views.queue_page(claims, lines, cases), views.index_page(claims, cases, self.table("questions"), f"Research: {self.framework.ref}"),
            views.narrative_pages(self.table("narratives"), self.spark.createDataFrame([], "question string, n int, observation string")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def write_pages(self) -> list[str]:
        pages, target = durable(self.pages()), f"{self.base}/views"
        touched = sorted(r.path for r in render.write_pages(pages, target).where("changed").collect())
        return touched + [p for inside in ("entities", "cases", "narratives") for p in render.remove_stale(pages, target, inside)]

    def evaluate(self, gold: DataFrame, expected: DataFrame | None = None) -> dict:
        """Scores against a gold set (note, s_entity, predicate, o_entity, negated), and the expected cases (type, entities) that were found."""
        key = ["note", "s_entity", "predicate", "o_entity", "negated"]
        scores = research.gold_scores(gold, self.table("claims").where(F.col("status") != "rejected"), key).first().asDict()
        if expected is not None:
            found = research.expected_cases(expected, self.table("cases"))
            scores["cases"] = [r.asDict() for r in found.collect()]  # as many as are expected
        return scores


def evidence_stale(cases: DataFrame, claims: DataFrame) -> DataFrame:
    """id of the cases, neither rejected nor stale yet, with an input that is not a live claim."""
    return incremental.stale_records(cases.select("id", "status", "inputs"), claims).select("id")
