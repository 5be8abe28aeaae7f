"""Evidence reasoning: claims to signed links, checks over the claim graph, narratives, scoring against a gold set.

A claim frame is flat: id, note, study, predicate, claim_type, evidence, negated, confidence, status, framework,
context (map), and for subject and object ``s_``/``o_`` + entity, property, direction, activity_effect, effect_basis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identifier, norm_name, strip

#: Statuses of claims in use, and of those that are out of it.
LIVE, DEAD = ("proposed", "accepted", "deferred"), ("rejected", "superseded", "stale", "source_missing")
UNMAPPED = "unmapped"


def live(claims: DataFrame, framework: str) -> DataFrame:
    return claims.where(F.col("status").isin(*LIVE) & (F.substring_index("framework", "@", 1) == framework))


def canonical_names(names: DataFrame, entities: DataFrame, column: str) -> DataFrame:
    """``names`` with ``column`` replaced by its canonical name. entities: canonical, aliases, status, pos (later rows win)."""
    alias = entities.where("status <> 'rejected'").select("canonical", "pos", F.explode(F.concat("aliases", F.array("canonical"))).alias("alias"))
    table = alias.groupBy(norm_name(F.col("alias")).alias("__key")).agg(F.max_by("canonical", "pos").alias("__to"))
    return names.withColumn("__key", norm_name(F.col(column))).join(table, "__key", "left").withColumn(column, F.coalesce("__to", strip(F.col(column)))).drop("__key", "__to")


def effect(side: str) -> Column:
    """How a participant's state moves its entity: stated or inferred effect, else the direction; 0 if unknown."""
    stated = F.col(f"{side}_activity_effect")
    moved = F.col(f"{side}_direction")
    return (
        F.when(stated == "increase", 1).when(stated == "decrease", -1).when(moved.isin("increase", "present"), 1).when(moved.isin("decrease", "absent"), -1).otherwise(0)
    )


def signed_links(claims: DataFrame, relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims plus sign, kind, disagrees, demoted, assumed. relations: id, kind, sign; evidence: id, weight, supports_causal."""
    rel = relations.select(F.col("id").alias("predicate"), F.col("kind").alias("r_kind"), F.col("sign").alias("r_sign"))
    ev = evidence.select(F.col("id").alias("evidence"), F.col("weight").alias("weight"), "supports_causal")
    es, eo = effect("s"), effect("o")
    joined = claims.join(rel, "predicate", "left").join(ev, "evidence", "left").withColumn("es", es).withColumn("eo", eo)
    r_sign = F.coalesce("r_sign", F.lit(0))
    one = lambda c: F.when(F.col(c) == 0, 1).otherwise(F.col(c))
    both = (F.col("es") != 0) & (F.col("eo") != 0)
    causal_words = F.coalesce(F.col("r_kind") == "causal", F.lit(False)) & (F.col("claim_type") == "causal")
    kind = (
        F.when(F.coalesce("negated", F.lit(False)), "null")
        .when(F.col("r_kind").isNull() | F.col("r_kind").isin("compositional", "descriptive"), "structural")
        .when(F.col("claim_type") == "hypothesis", "hypothesis")
        .when(causal_words & F.coalesce("supports_causal", F.lit(False)), "causal")
        .otherwise("associative")
    )
    out = joined.withColumn("sign", F.when(both, F.col("es") * F.col("eo")).otherwise(r_sign * one("es") * one("eo")).cast("int")).withColumn("kind", kind)
    inferred = lambda s: (F.col(f"{s}_effect_basis") == "inferred") & F.col(f"{s}_activity_effect").isin("increase", "decrease")
    return (
        out.withColumn("disagrees", both & (r_sign != 0) & (r_sign != F.col("sign")))
        .withColumn("demoted", (F.col("kind") == "associative") & ((F.col("r_kind") == "causal") | (F.col("claim_type") == "causal")))
        .withColumn("assumed", F.coalesce(inferred("s"), F.lit(False)) | F.coalesce(inferred("o"), F.lit(False)))
        .withColumn("a", F.least("s_entity", "o_entity"))
        .withColumn("b", F.greatest("s_entity", "o_entity"))
        .drop("es", "eo", "r_kind", "r_sign")
    )


def entity_scales(mappings: DataFrame, scales: DataFrame, entities: DataFrame) -> DataFrame:
    """entity, scales (most votes first, ties in framework order), level. mappings: entity, scales, votes, status;
    scales: id, idx; entities: entity."""
    votes = mappings.where("status <> 'rejected'").select("entity", F.explode("scales").alias("id"), F.coalesce("votes", F.lit(1)).alias("votes"))
    ranked = votes.groupBy("entity", "id").agg(F.sum("votes").alias("n")).join(scales, "id")
    listed = ranked.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "idx", "id"))).alias("s"))
    joined = entities.select("entity").distinct().join(listed, "entity", "left")
    return joined.select("entity", F.coalesce(F.col("s.id"), F.array(F.lit(UNMAPPED))).alias("scales"), F.coalesce(F.element_at("s", 1)["idx"], F.lit(-1)).alias("level"))


def mapping_tally(sources: DataFrame, scales: DataFrame) -> DataFrame:
    """key, scales, votes: the scales that most sources name, or at least two; in framework order, unknown ones first.
    sources: key, claim, scales."""
    tally = sources.select("key", F.explode("scales").alias("id")).groupBy("key", "id").agg(F.count("*").alias("n"))
    best = tally.withColumn("top", F.max("n").over(Window.partitionBy("key"))).join(scales, "id", "left")
    kept = F.filter(F.sort_array(F.collect_list(F.struct(F.coalesce("idx", F.lit(-1)).alias("idx"), "id", "n", "top"))), lambda x: (x["n"] == x["top"]) | (x["n"] >= 2))
    return best.groupBy("key").agg(F.transform(kept, lambda x: x["id"]).alias("scales"), F.sum("n").alias("votes"))


def context_compare(groups: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """grp, verdict, mismatched, unknown. groups: grp, claim, context (map)."""
    long = groups.select("grp", "claim", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.element_at("context", f).alias("v")) for f in fields])).alias("x")).select("grp", "claim", "x.*")
    blank = F.col("v").isNull() | F.col("v").isin("", "unknown")
    by_field = long.groupBy("grp", "field").agg(F.count_distinct(F.when(~blank, F.lower(strip(F.col("v"))))).alias("values"), F.max(blank).alias("unknown"))
    found = by_field.groupBy("grp").agg(
        F.sort_array(F.collect_list(F.when(F.col("values") > 1, F.col("field")))).alias("mismatched"), F.sort_array(F.collect_list(F.when(F.col("unknown"), F.col("field")))).alias("unknown")
    )
    verdict = F.when(F.size("mismatched") > 0, "mismatch").when(F.size("unknown") > 0, "unknown").otherwise("compatible")
    return found.select("grp", verdict.alias("verdict"), "mismatched", "unknown")


def _case(kind: str, inputs: Column) -> Column:
    return identifier(f"{kind}-", F.lit(kind), F.array_join(inputs, ","))


_ids = lambda condition: F.sort_array(F.collect_set(F.when(condition, F.col("id"))))
_studies = lambda condition: F.sort_array(F.collect_set(F.when(condition, F.col("study"))))
SIGNED = "kind IN ('causal', 'associative') AND sign <> 0"


def conflicting_results(links: DataFrame) -> DataFrame:
    """a, b, label, positive, negative, no_effect: opposite signs whose study sets differ; an effect against none."""
    signed = F.expr(SIGNED)
    by_pair = links.groupBy("a", "b").agg(
        _ids(signed & (F.col("sign") > 0)).alias("positive"), _ids(signed & (F.col("sign") < 0)).alias("negative"), _ids(F.col("kind") == "null").alias("no_effect"),
        _studies(signed & (F.col("sign") > 0)).alias("sp"), _studies(signed & (F.col("sign") < 0)).alias("sn"),
    )
    opposite = (F.size("positive") > 0) & (F.size("negative") > 0) & (F.col("sp") != F.col("sn"))
    null = (F.size("no_effect") > 0) & (F.size("positive") + F.size("negative") > 0)
    labels = F.array_compact(F.array(F.when(opposite, F.lit("opposite directions")), F.when(null, F.lit("an effect vs no effect"))))
    out = by_pair.select("a", "b", F.explode(labels).alias("label"), "positive", "negative", "no_effect")
    inputs = F.when(F.col("label") == "opposite directions", F.concat("positive", "negative")).otherwise(F.concat("positive", "negative", "no_effect"))
    return out.withColumn("case_id", _case("conflicting-result", F.sort_array(inputs)))


def triangulation(links: DataFrame, min_studies: int = 2, min_weight: float = 0.3) -> DataFrame:
    """a, b, sign, n_studies, target, inputs, repeated: agreement from independent studies; bare statements don't count."""
    supported = links.where(SIGNED).where(F.coalesce("weight", F.lit(0.0)) >= min_weight)
    best = F.min_by("id", F.struct((F.col("kind") != "causal").alias("x"), (-F.col("confidence")).alias("c"), "id"))
    notes = supported.groupBy("a", "b", "sign", "study").agg(F.count_distinct("note").alias("n"))
    repeated = notes.where("n > 1").groupBy("a", "b", "sign").agg(F.sort_array(F.collect_set("study")).alias("repeated"))
    found = supported.groupBy("a", "b", "sign").agg(F.count_distinct("study").alias("n_studies"), best.alias("target"), F.sort_array(F.collect_set("id")).alias("inputs")).where(F.col("n_studies") >= min_studies)
    return found.join(repeated, ["a", "b", "sign"], "left").withColumn("repeated", F.coalesce("repeated", F.array().cast("array<string>")))


def missing_bridges(links: DataFrame, levels: DataFrame) -> DataFrame:
    """a, b, inputs: pairs that touch the top observed level, associated but never causal. levels: entity, level."""
    observed = levels.join(links.select(F.explode(F.array("a", "b")).alias("entity")).distinct(), "entity", "left_semi")
    highest = F.broadcast(observed.agg(F.max("level").alias("top")))
    top = observed.join(highest, F.col("level") == F.col("top")).select("entity")
    pairs = links.groupBy("a", "b").agg(F.bool_or(F.col("kind") == "causal").alias("causal"), _ids(F.col("kind") == "associative").alias("inputs")).where("NOT causal AND size(inputs) > 0")
    ends = pairs.select("a", "b", "inputs", F.explode(F.array("a", "b")).alias("entity")).join(top, "entity", "left_semi")
    return ends.select("a", "b", "inputs").distinct()


def representative_links(links: DataFrame) -> DataFrame:
    """a, b, id, sign, kind: for pairs whose signed links agree, the causal, most confident, first one."""
    signed = links.where(SIGNED)
    agree = signed.groupBy("a", "b").agg(F.min("sign").alias("lo"), F.max("sign").alias("hi"), F.min(F.struct((F.col("kind") != "causal").alias("x"), (-F.col("confidence")).alias("c"), "id", "kind")).alias("r"))
    return agree.where("lo = hi").select("a", "b", F.col("r.id").alias("id"), F.col("lo").alias("sign"), F.col("r.kind").alias("kind"))


def sign_tensions(links: DataFrame, max_loop: int = 4) -> DataFrame:
    """nodes, length: loops of agreed signs whose product is negative."""
    from .graph import signed_cycles

    return signed_cycles(representative_links(links).where("a <> b").select("a", "b", "sign"), max_loop).where("sign < 0").select("nodes", "length")


def merge_cases(cases: DataFrame) -> DataFrame:
    """One case for each (type, title): inputs and entities united and sorted, id from what it unites."""
    merged = cases.groupBy("type", "title").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("inputs")))).alias("inputs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("entities")))).alias("entities"))
    return merged.withColumn("id", identifier("case-", F.col("type"), F.array_join("inputs", ",")))


def challenged_pairs(cases: DataFrame) -> DataFrame:
    """a, b, case: entity pairs of conflicting cases that are not rejected. cases: id, type, status, entities."""
    open_cases = cases.where("type = 'conflicting_result' AND coalesce(status, 'proposed') <> 'rejected'")
    e = open_cases.select(F.col("id").alias("case"), "entities", F.posexplode("entities").alias("i", "x"))
    return e.select("case", "i", "x", F.posexplode("entities").alias("j", "y")).where("i < j").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "case").distinct()


def step_status(links: DataFrame, challenged: DataFrame) -> DataFrame:
    """src, dst, status, sign of each reading step in either direction. challenged: a, b."""
    usable = links.where("kind IN ('causal', 'associative', 'hypothesis')")
    both = usable.select(F.explode(F.array(F.struct(F.col("s_entity").alias("src"), F.col("o_entity").alias("dst"), F.lit(True).alias("forward")), F.struct(F.col("o_entity").alias("src"), F.col("s_entity").alias("dst"), F.lit(False).alias("forward")))).alias("e"), "kind", "sign", "id").select("e.*", "kind", "sign", "id")
    readable = both.where("kind = 'associative' OR forward")
    grouped = readable.groupBy("src", "dst").agg(F.bool_or((F.col("kind") == "causal") & F.col("forward")).alias("causal"), F.min(F.struct((F.col("kind") != "causal").alias("x"), "id", "sign")).alias("used"))
    marked = grouped.join(challenged.select("a", "b").distinct().withColumn("hit", F.lit(True)), (F.least("src", "dst") == F.col("a")) & (F.greatest("src", "dst") == F.col("b")), "left")
    status = F.when(F.col("hit"), "Challenged").when(F.col("causal"), "Supported").otherwise("Assumed")
    return marked.select("src", "dst", status.alias("status"), F.col("used.sign").alias("sign"))


def competing(paths: DataFrame, k: int = 2, overlap: float = 0.5) -> DataFrame:
    """rank, path of the first ``k`` paths (rank, path) of which each shares at most ``overlap`` of its edges with every one
    taken before it. Each choice is one join of path edges; only ``k`` rows are ever held."""
    step = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("u"), F.element_at("path", i + 1).alias("v")))
    edges = paths.where("size(path) > 1").select("rank", F.explode(F.array_distinct(step)).alias("e"))
    lengths = edges.groupBy("rank").agg(F.count("*").alias("n"))
    taken = paths.orderBy("rank").limit(1)
    for _ in range(k - 1):
        used = F.broadcast(taken.select(F.col("rank").alias("by")))
        theirs = edges.join(used, F.col("rank") == F.col("by")).select("by", "e")
        shared = edges.join(F.broadcast(theirs), "e").groupBy("rank", "by").agg(F.count("*").alias("m"))
        barred = shared.join(lengths, "rank").where(F.col("m") > overlap * F.col("n")).select("rank").distinct()
        free = paths.join(barred, "rank", "left_anti").join(taken.select("rank"), "rank", "left_anti")
        taken = taken.unionByName(free.orderBy("rank").limit(1).select(*taken.columns))
    return taken


def gold_scores(gold: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """gold, extracted, matched, precision, recall (3 places): first row of each key counts."""
    g, f = gold.select(*key).distinct(), found.select(*key).distinct()
    sides = g.withColumn("g", F.lit(1)).join(f.withColumn("f", F.lit(1)), key, "full")
    n = sides.agg(F.count("g").alias("gold"), F.count("f").alias("extracted"), F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).alias("matched"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 3)
    return n.select("*", ratio("matched", "extracted").alias("precision"), ratio("matched", "gold").alias("recall"))


def expected_cases(expected: DataFrame, cases: DataFrame) -> DataFrame:
    """Expected cases (type, entities) with found: a case of the type whose entities hold all that are wanted."""
    e = expected.withColumn("row", F.monotonically_increasing_id())
    pair = e.join(cases.select(F.col("type").alias("ct"), F.col("entities").alias("ce"), F.col("id").alias("cid")), (F.col("type") == F.col("ct")) & (F.size(F.array_except("entities", F.col("ce"))) == 0), "left")
    return pair.groupBy("row").agg(F.first("type").alias("type"), F.first("entities").alias("entities"), F.min("cid").alias("found")).drop("row")


def uncertainty(claims: DataFrame) -> DataFrame:
    """id, flags: low confidence, passage not exact, inferred effect, no context, unknown study."""
    flags = [
        F.when(F.col("confidence") < 0.6, F.lit("low confidence")),
        F.when(F.coalesce("match", F.lit("")) != "exact", F.lit("passage not exact")),
        F.when(F.col("assumed"), F.lit("inferred effect")),
        F.when(F.size(F.map_filter("context", lambda _, v: F.coalesce(v, F.lit("")) != "")) <= 0, F.lit("no context")),
        F.when(F.col("study").startswith("note:"), F.lit("study unknown")),
    ]
    return claims.select("id", F.array_compact(F.array(*flags)).alias("flags"))


def coverage(paths: DataFrame, scales: DataFrame) -> DataFrame:
    """idx, id, used of each scale, in framework order. paths: levels (array of scale ids)."""
    used = paths.select(F.explode("levels").alias("id")).distinct().withColumn("hit", F.lit(True))
    return scales.join(used, "id", "left").select("idx", "id", F.coalesce("hit", F.lit(False)).alias("used"))


def dead_inputs(steps: DataFrame, claims: DataFrame) -> DataFrame:
    """narrative, unknown, dead: claims that a written narrative names but that don't exist, or are out of use."""
    named = steps.select("narrative", F.explode("claims").alias("id")).distinct().join(claims.select("id", "status"), "id", "left")
    return named.groupBy("narrative").agg(_ids(F.col("status").isNull()).alias("unknown"), _ids(F.col("status").isin(*DEAD)).alias("dead"))

