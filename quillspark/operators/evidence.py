"""What is read off a claim graph: briefs and lookups of claims, loops and their challengers, readings, reviews, impact.

Links are the rows of ``research.signed_links`` (id, note, study, s_entity, o_entity, a, b, sign, kind, confidence); what
else an operator needs is said there. Levels are (entity, level), -1 for entities of no scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identifier, norm_name, slug
from .graph import durable
from .research import DEAD, merge_cases

# How a direction is shown.
ARROWS = {"increase": "↑", "decrease": "↓", "present": "present", "absent": "absent"}
NOTES_MARK = "<!-- reviewer-notes"
PENDING = ("proposed", "stale", "deferred")


# --- claims ------------------------------------------------------------------------------------------------------------


def state_label(entity: Column, prop: Column, direction: Column) -> Column:
    """Entity, property (unless the name says it already) and direction in one line."""
    said = F.coalesce(prop, F.lit(""))
    shown = F.when((said == "") | F.contains(F.lower(entity), F.lower(said)), F.lit(None)).otherwise(said)
    arrow = F.element_at(F.create_map(*[F.lit(x) for kv in ARROWS.items() for x in kv]), F.coalesce(direction, F.lit("")))
    return F.concat_ws(" ", entity, shown, arrow)


def claim_brief(claims: DataFrame) -> DataFrame:
    """id, claim: subject, predicate (negated or not) and object in one line."""
    side = lambda s: state_label(F.col(f"{s}_entity"), F.col(f"{s}_property"), F.col(f"{s}_direction"))
    middle = F.concat(F.lit("—"), F.col("predicate"), F.when(F.coalesce("negated", F.lit(False)), " (negated)").otherwise(""), F.lit("→"))
    return claims.select("id", F.concat_ws(" ", side("s"), middle, side("o")).alias("claim"))


def find_claims(claims: DataFrame, entity: str | None = None, note: str | None = None, status: str | None = None, text: str | None = None, limit: int = 30) -> DataFrame:
    """The first claims, by id, of an entity in either role, a note, a status, or with words in the passage (a top-k read)."""
    if entity is not None:
        key = norm_name(F.lit(entity))
        claims = claims.where((norm_name(F.col("s_entity")) == key) | (norm_name(F.col("o_entity")) == key))
    for column, value in (("note", note), ("status", status)):
        if value is not None:
            claims = claims.where(F.col(column) == value)
    if text is not None:
        claims = claims.where(F.contains(F.lower("passage"), F.lit(text.lower())))
    return claims.orderBy("id").limit(limit)


def related_claims(links: DataFrame, claim: str) -> DataFrame:
    """id, relation, study of the other links of a claim's pair: same or opposite direction, or no effect."""
    own = F.broadcast(links.where(F.col("id") == claim).select("a", "b", F.col("sign").alias("__sign")))
    relation = F.when(F.col("kind") == "null", "no effect reported").when(F.col("sign") == F.col("__sign"), "same direction").otherwise("opposite direction")
    return links.where(F.col("id") != claim).join(own, ["a", "b"]).select("id", relation.alias("relation"), "study")


def entity_summary(links: DataFrame) -> DataFrame:
    """entity, n_claims, n_notes, up, down: claims that name an entity in either role, and how often it is said to move."""
    role = lambda s: F.struct(F.col(f"{s}_entity").alias("entity"), F.col(f"{s}_direction").alias("moved"))
    both = links.select("id", "note", F.explode(F.array(role("s"), role("o"))).alias("r")).select("id", "note", "r.*")
    return both.groupBy("entity").agg(
        F.count_distinct("id").alias("n_claims"), F.count_distinct("note").alias("n_notes"), F.count_if(F.col("moved") == "increase").alias("up"), F.count_if(F.col("moved") == "decrease").alias("down")
    )


def status_counts(claims: DataFrame) -> DataFrame:
    return claims.groupBy("status").agg(F.count("*").alias("n"))


def entity_card(links: DataFrame, entity: str) -> DataFrame:
    """other, claims (sorted ids), n_studies: an entity's claims by what they join it to."""
    own = links.where((F.col("s_entity") == entity) | (F.col("o_entity") == entity)).withColumn("other", F.when(F.col("s_entity") == entity, F.col("o_entity")).otherwise(F.col("s_entity")))
    return own.groupBy("other").agg(F.array_sort(F.collect_set("id")).alias("claims"), F.count_distinct("study").alias("n_studies"))


def lanes(links: DataFrame, scales: DataFrame) -> DataFrame:
    """scale, entity, degree, rank: the entities of each scale (an entity may have several), most neighbours first.
    scales: entity, scales."""
    both = links.select(F.explode(F.array(F.struct(F.col("s_entity").alias("entity"), F.col("o_entity").alias("other")), F.struct(F.col("o_entity").alias("entity"), F.col("s_entity").alias("other")))).alias("e"))
    degree = both.groupBy("e.entity").agg(F.count_distinct("e.other").alias("degree"))
    placed = degree.join(scales, "entity", "left").select(F.explode(F.coalesce("scales", F.array(F.lit("unmapped")))).alias("scale"), "entity", "degree")
    return placed.withColumn("rank", F.row_number().over(Window.partitionBy("scale").orderBy(F.desc("degree"), "entity")))


# --- loops -------------------------------------------------------------------------------------------------------------


def _loop_edges(loops: DataFrame, links: DataFrame) -> DataFrame:
    """nodes, i, u, v and the link of each edge of each loop. loops: nodes; links: one for each pair."""
    n = F.size("nodes")
    step = F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.get("nodes", i).alias("u"), F.get("nodes", (i + 1) % n).alias("v"))))
    edges = loops.select("nodes", step.alias("e")).select("nodes", "e.*").withColumn("a", F.least("u", "v")).withColumn("b", F.greatest("u", "v"))
    return edges.join(links.select("a", "b", "id", "kind", "s_entity", "sign"), ["a", "b"])


def feed_forward(loops: DataFrame, links: DataFrame) -> DataFrame:
    """nodes, source, sink of the all-causal loops in which one node has two causal routes to another that make up the loop.

    Around a loop, a node from which both its edges go is a source. There are as many sources as sinks; with one of each,
    the two ways from the source to the sink are the routes.
    """
    edges = _loop_edges(loops, links)
    ends = edges.select("nodes", "kind", F.explode(F.array("u", "v")).alias("node"), F.col("s_entity"))
    degree = ends.groupBy("nodes", "node").agg(F.count_if(F.col("s_entity") == F.col("node")).alias("out"), F.bool_and(F.col("kind") == "causal").alias("causal"))
    found = degree.groupBy("nodes").agg(
        F.bool_and("causal").alias("causal"), F.count_if(F.col("out") == 2).alias("n"), F.max(F.when(F.col("out") == 2, F.col("node"))).alias("source"), F.max(F.when(F.col("out") == 0, F.col("node"))).alias("sink")
    )
    return found.where("causal AND n = 1").select("nodes", "source", "sink")


def tension_cases(loops: DataFrame, links: DataFrame, levels: DataFrame) -> DataFrame:
    """nodes, type, challenger, premises, inputs of each loop with a negative product.

    The challenger is the link over the widest distance of levels (an association first, then the last id); ``premises``
    are the associations among the others, each of which the route needs to be causal. All causal: conditional.
    """
    at = lambda c: levels.select(F.col("entity").alias(c), F.col("level").alias(f"l{c}"))
    edges = _loop_edges(loops, links).join(at("u"), "u", "left").join(at("v"), "v", "left")
    span = F.abs(F.coalesce("lu", F.lit(-1)) - F.coalesce("lv", F.lit(-1)))
    order = F.struct(span.alias("span"), (F.col("kind") == "associative").alias("loose"), "id")
    cases = edges.groupBy("nodes").agg(F.max(order).alias("top"), F.bool_and(F.col("kind") == "causal").alias("causal"), F.array_sort(F.collect_list(F.when(F.col("kind") == "associative", F.col("id")))).alias("loose"), F.array_sort(F.collect_list("id")).alias("inputs"))
    kind = F.when(F.col("causal"), "conditional_sign_tension").otherwise("potential_tension")
    return cases.select("nodes", kind.alias("type"), F.col("top.id").alias("challenger"), F.array_except("loose", F.array("top.id")).alias("premises"), "inputs")


# --- assumptions -------------------------------------------------------------------------------------------------------


def shared_studies(groups: DataFrame) -> DataFrame:
    """grp, study, ids: claims of a group (grp, id, study) that come from one study, so are not independent."""
    return groups.groupBy("grp", "study").agg(F.array_sort(F.collect_set("id")).alias("ids")).where("size(ids) > 1")


def mixed_properties(groups: DataFrame) -> DataFrame:
    """grp, entity, properties: entities that a group's claims (grp, entity, property) measure by several properties."""
    return groups.groupBy("grp", "entity").agg(F.array_sort(F.collect_set(F.coalesce("property", F.lit("")))).alias("properties")).where("size(properties) > 1")


def run_checks(produced: dict[str, DataFrame], enabled: tuple[str, ...]) -> DataFrame:
    """The merged cases of the checks that are enabled. produced: check -> cases (type, title, inputs, entities)."""
    cases = None
    for name in enabled:
        own = produced[name].select("type", "title", "inputs", "entities")
        cases = own if cases is None else cases.unionByName(own)
    return merge_cases(cases)


# --- readings ----------------------------------------------------------------------------------------------------------


def step_options(links: DataFrame) -> DataFrame:
    """src, dst, id, how, sign: causal links and hypotheses read forward only, associations either way."""
    forward = links.where("kind IN ('causal', 'associative', 'hypothesis')").select(F.col("s_entity").alias("src"), F.col("o_entity").alias("dst"), "id", F.col("kind").alias("how"), "sign")
    back = links.where("kind = 'associative'").select(F.col("o_entity").alias("src"), F.col("s_entity").alias("dst"), "id", F.lit("assumed-direction").alias("how"), "sign")
    return forward.unionByName(back)


def reachable(steps: DataFrame, start: str, depth: int = 6) -> DataFrame:
    """node, hops from ``start`` by at most ``depth`` steps (src, dst): a front at a time."""
    edges = durable(steps.select("src", "dst").distinct())
    seen = front = durable(steps.sparkSession.createDataFrame([(start, 0)], "node string, hops int"))
    for hop in range(1, depth + 1):
        front = durable(front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def best_end(reached: DataFrame, levels: DataFrame) -> DataFrame:
    """The node of the highest level that was reached, by the fewest steps (then the first): a reading that can't reach its
    target ends there, and its last step is missing."""
    placed = reached.join(levels, F.col("node") == F.col("entity"), "left").select("node", "hops", F.coalesce("level", F.lit(-1)).alias("level"))
    return placed.orderBy(F.desc("level"), "hops", "node").limit(1)


def narrative_challenges(narratives: DataFrame, cases: DataFrame, types: tuple[str, ...] = ("potential_tension", "conditional_sign_tension")) -> DataFrame:
    """narrative, case: open tension cases that share a claim with a narrative. narratives: narrative, claims; cases: id, type, status, inputs."""
    mine = narratives.select("narrative", F.explode("claims").alias("claim"))
    theirs = cases.where(F.col("type").isin(*types) & (F.coalesce("status", F.lit("proposed")) != "rejected")).select(F.col("id").alias("case"), F.explode("inputs").alias("claim"))
    return mine.join(theirs, "claim").select("narrative", "case").distinct()


def predictions(pairs: DataFrame, limit: int = 6) -> DataFrame:
    """pair, n, kind, observation for two readings (pair, a, b: node paths; sign_a, sign_b) of one question.

    With one source and opposite net signs, changing the source tells them apart; so does blocking a node between that only
    one of them passes. At most ``limit`` for each pair, in the order of the readings.
    """
    target = F.element_at("a", -1)
    first = lambda p: F.element_at(p, 1)
    inner = lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 2, F.lit(0)))
    ends = F.array(first("a"), first("b"), target)
    opposite = (first("a") == first("b")) & (F.col("sign_a") * F.col("sign_b") < 0)
    perturb = F.when(opposite, F.array(F.struct(F.lit("perturbation").alias("kind"), F.concat(F.lit("Reduce "), first("a"), F.lit(" and measure "), target).alias("observation")))).otherwise(
        F.array().cast("array<struct<kind:string,observation:string>>")
    )

    def blocked(mine: str, theirs: str) -> Column:
        only = F.filter(inner(mine), lambda e: ~F.array_contains(inner(theirs), e) & ~F.array_contains(ends, e))
        return F.transform(only, lambda e: F.struct(F.lit("mediation").alias("kind"), F.concat(F.lit("Block "), e, F.lit(", then change "), first(mine), F.lit(" and measure "), target).alias("observation")))

    listed = F.slice(F.concat(perturb, blocked("a", "b"), blocked("b", "a")), F.lit(1), F.lit(limit))
    return pairs.select("pair", F.posexplode(listed).alias("n", "p")).select("pair", "n", "p.kind", "p.observation")


def validate_steps(steps: DataFrame, links: DataFrame, claims: DataFrame) -> DataFrame:
    """narrative, i, status, kept, unknown, dead, off for written steps (narrative, i, src, dst, status, claims).

    Unknown claims go, claims out of use are flagged, claims that don't connect the step go; a step that no live claim
    connects is Missing, and Supported needs a causal one in its direction.
    """
    named = steps.select("narrative", "i", "src", "dst", F.explode_outer("claims").alias("id"))
    known = named.join(claims.select("id", F.col("status").alias("now")), "id", "left").join(links.select("id", "s_entity", "o_entity", "kind"), "id", "left")
    joins = F.array_sort(F.array("s_entity", "o_entity")) == F.array_sort(F.array("src", "dst"))
    live = F.col("kind").isNotNull() & F.col("now").isNotNull()
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("id"))))
    found = known.groupBy("narrative", "i").agg(
        ids(F.col("id").isNotNull() & F.col("now").isNull()).alias("unknown"), ids(F.col("now").isin(*DEAD)).alias("dead"), ids(live & ~joins).alias("off"), ids(F.col("now").isNotNull() & ~F.coalesce(live & ~joins, F.lit(False))).alias("kept"),
        F.coalesce(F.bool_or(live & joins), F.lit(False)).alias("connected"), F.coalesce(F.bool_or(live & joins & (F.col("kind") == "causal") & (F.col("s_entity") == F.col("src"))), F.lit(False)).alias("causal"),
    )
    status = F.when(~F.col("connected"), "Missing").when((F.col("status") == "Supported") & ~F.col("causal"), "Assumed").otherwise(F.col("status"))
    return steps.select("narrative", "i", "status").join(found, ["narrative", "i"]).select("narrative", "i", status.alias("status"), "kept", "unknown", "dead", "off")


def evidence_package(paths: DataFrame, links: DataFrame, cases: DataFrame, excluded: DataFrame, most: int = 60, counter: int = 20, out: int = 30) -> DataFrame:
    """part, id: what an investigation should look at: claims on the readings and in cases that touch them, evidence against,
    and claims that are out of use; each part is cut at its documented bound, in the order of ids.

    paths: nodes, claims; cases: type, entities, inputs; excluded: id, s_entity, o_entity.
    """
    ents = durable(paths.select(F.explode("nodes").alias("entity")).distinct())
    on_path = paths.select(F.explode("claims").alias("id")).distinct()
    numbered = cases.withColumn("__case", F.xxhash64("type", F.array_join("inputs", ",")))
    touching = numbered.join(numbered.select("__case", F.explode("entities").alias("entity")).join(ents, "entity", "left_semi").select("__case").distinct(), "__case", "left_semi")
    in_cases = touching.select("type", F.explode("inputs").alias("id"))
    pick = lambda df, n, part, order=("id",): df.orderBy(*order).limit(n).select(F.lit(part).alias("part"), "id")
    ranked = on_path.withColumn("k", F.lit(0)).unionByName(in_cases.select("id").withColumn("k", F.lit(1))).groupBy("id").agg(F.min("k").alias("k"))
    near = lambda df: df.where("s_entity IS NOT NULL").select("id", F.explode(F.array("s_entity", "o_entity")).alias("entity")).join(ents, "entity", "left_semi").select("id").distinct()
    against = near(links.where("kind = 'null'")).unionByName(in_cases.where("type <> 'triangulation'").select("id").distinct().join(on_path, "id", "left_anti")).distinct()
    return pick(ranked, most, "claim", ("k", "id")).unionByName(pick(against, counter, "counterevidence")).unionByName(pick(near(excluded), out, "excluded"))


def token_estimate(payload: Column) -> Column:
    """Tokens of a JSON payload: a quarter of its characters."""
    return F.floor(F.length(payload) / 4).cast("long")


def mentions(reports: DataFrame, claims: DataFrame) -> DataFrame:
    """report, id: claims that a report names by id and that exist. reports: report, text."""
    named = reports.select("report", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"c-[0-9a-f]{10}"), F.lit(0)))).alias("id"))
    return named.join(claims.select("id"), "id", "left_semi").select("report", "id")


def question_id(target: Column, source: Column) -> Column:
    """Id of a question: a slug of at most 50 characters and a short digest."""
    said = F.concat_ws(" ", source, F.lit("to"), target)
    return F.concat(F.substring(slug(said), 1, 50), F.substring(identifier("-", said), 1, 7))


# --- reviews, state, impact --------------------------------------------------------------------------------------------


def review_queue(claims: DataFrame) -> DataFrame:
    """note, n, ids: claims that wait for a review, by note, in the order of their lines. claims: id, note, status, line."""
    waiting = claims.where(F.col("status").isin(*PENDING))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("line", "id"))), lambda x: x["id"])
    return waiting.groupBy("note").agg(F.count("*").alias("n"), listed.alias("ids"))


def write_records(stored: DataFrame, produced: DataFrame) -> DataFrame:
    """id, status, outcome of writing records again: a review stays, and an accepted or deferred one whose inputs changed is
    stale. stored: id, status, inputs; produced: id, inputs (arrays)."""
    old = stored.select("id", F.col("status").alias("was"), F.array_sort("inputs").alias("had"))
    both = produced.select("id", F.array_sort("inputs").alias("has")).join(old, "id", "left")
    changed = ~F.col("has").eqNullSafe(F.col("had"))
    status = F.when(F.col("was").isNull(), "proposed").when(F.col("was").isin("accepted", "deferred") & changed, "stale").otherwise(F.col("was"))
    outcome = F.when(F.col("was").isNull(), "created").when(changed, "updated").otherwise("unchanged")
    return both.select("id", status.alias("status"), outcome.alias("outcome"))


def case_text(body: Column) -> Column:
    """A record's text before the reviewers' notes."""
    return F.substring_index(body, NOTES_MARK, 1)


def framework_impact(claims: DataFrame, mappings: DataFrame, relations: DataFrame, scales: DataFrame, ref: str) -> DataFrame:
    """kind, id: claims of another version of the framework, claims with an unknown predicate, entities mapped to a scale that is gone."""
    other = claims.where(F.col("framework") != ref).select(F.lit("other version").alias("kind"), "id")
    unknown = claims.join(relations.select(F.col("id").alias("predicate")), "predicate", "left_anti").select(F.lit("unknown predicate").alias("kind"), "id")
    gone = mappings.select("entity", F.explode("scales").alias("scale")).join(scales.select(F.col("id").alias("scale")), "scale", "left_anti").select(F.lit("scale is gone").alias("kind"), F.col("entity").alias("id"))
    return other.unionByName(unknown).unionByName(gone.distinct())


def replace_votes(votes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Votes (note, entity, scale) after the notes in ``fresh`` voted again: their earlier votes go."""
    return votes.join(fresh.select("note").distinct(), "note", "left_anti").unionByName(fresh).distinct()


def collect_garbage(knowledge: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """What is known about notes (id) that still exist."""
    return knowledge.join(notes.select(F.col("id").alias(key)), key, "left_semi")


def naming_todo(topics: DataFrame) -> DataFrame:
    """Topics (id, synopsis, stale) that wait for a name."""
    return topics.where(F.coalesce("stale", F.lit(False)) | (F.coalesce("synopsis", F.lit("")) == ""))


def name_chunks(names: DataFrame, size: int = 400) -> DataFrame:
    """chunk, n, signature: the distinct names in chunks of ``size``, in order; what a batch pass has seen already is known by
    its signature. One row number over the distinct names, which are few beside the claims."""
    numbered = names.select("name").distinct().withColumn("k", F.row_number().over(Window.orderBy("name")) - 1)
    return numbered.groupBy(F.floor(F.col("k") / size).cast("int").alias("chunk")).agg(F.count("*").alias("n"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("name")), ","), 256), 1, 10).alias("signature"))


def context_scores(gold: DataFrame, found: DataFrame) -> DataFrame:
    """right, wrong, invented, missed: context values (id, field, value) of matched claims. A value is right if one holds the
    other, in any case."""
    blank = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    both = gold.select("id", "field", blank("value").alias("g")).join(found.select("id", "field", blank("value").alias("f")), ["id", "field"], "full")
    alike = F.contains("g", F.col("f")) | F.contains("f", F.col("g"))
    has = F.col("g").isNotNull() & F.col("f").isNotNull()
    return both.agg(
        F.count_if(has & alike).alias("right"), F.count_if(has & ~alike).alias("wrong"), F.count_if(F.col("g").isNull() & F.col("f").isNotNull()).alias("invented"), F.count_if(F.col("g").isNotNull() & F.col("f").isNull()).alias("missed")
    )
