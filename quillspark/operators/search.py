"""BM25 over weighted section columns, and the roll-up of sections to notes."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stemming import porter, stems
from ..functions.text import ACCENTS, search_tokens, squeeze
from .graph import durable

#: Weights of the section columns; BM25's two parameters; a section beyond the best counts a quarter.
WEIGHTS = {"title": 8.0, "heading": 4.0, "body": 1.0, "tags": 3.0}
K1, B, EXTRA, GENERATED, FAN_OUT = 1.2, 0.75, 0.25, 0.5, 8


def query_terms(query: str) -> list[str]:
    """Lower-case words without accents; the last one matches as a prefix."""
    plain = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(c))
    return re.findall(r"\w+", plain)


def _hits(tokens: Column, term: str, prefix: bool) -> Column:
    return F.size(F.filter(tokens, lambda t: t.startswith(term) if prefix else t == term))


def scored_sections(sections: DataFrame, query: str, weights: dict[str, float] = WEIGHTS, stem: bool = False) -> DataFrame:
    """note_id, pos, score of each section with a hit.

    The terms are known when the plan is made, so one projection counts them and nothing is exploded. Its narrow rows are
    kept, so that texts are read once for the corpus figures (one row, joined back by a broadcast) and the scores. ``stem`` compares Porter stems (an Arrow function).
    """
    wanted = query_terms(query)
    if not wanted:
        return sections.select("note_id", "pos", F.lit(0.0).alias("score")).where(F.lit(False))
    if stem:
        wanted = [porter(w) for w in wanted]
    reduced = stems if stem else lambda c: c

    def figures(tokens: Column) -> Column:
        return F.struct(F.size(tokens).alias("n"), *[_hits(tokens, q, i == len(wanted) - 1).alias(f"h{i}") for i, q in enumerate(wanted)])

    # each column is tokenised once, bound inside the expression; what is left of a section are its figures
    once = lambda c: F.element_at(F.transform(F.array(reduced(search_tokens(F.coalesce(F.col(c), F.lit(""))))), figures), 1)
    found = sections.select("note_id", "pos", *[once(c).alias(c) for c in weights])
    length = sum((F.col(c)["n"] for c in weights), F.lit(0))
    # a term counts as found in a row by any column, whatever its weight
    hits = [sum((F.col(c)[f"h{i}"] * F.lit(w) for c, w in weights.items()), F.lit(0.0)) for i in range(len(wanted))]
    counted = durable(found.select("note_id", "pos", length.alias("dl"), *[h.alias(f"f{i}") for i, h in enumerate(hits)]))
    n_q = [F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(wanted))]
    corpus = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *n_q)
    score = F.lit(0.0)
    for i in range(len(wanted)):
        rare = F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        f = F.col(f"f{i}")
        weight = F.when(rare <= 0, F.lit(1e-6)).otherwise(rare)
        score = score + F.when(f > 0, weight * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    any_hit = F.greatest(*[F.col(f"f{i}") for i in range(len(wanted))], F.lit(0.0)) > 0
    return counted.where(any_hit).join(F.broadcast(corpus)).select("note_id", "pos", F.round(score, 6).alias("score"))


def search(sections: DataFrame, notes: DataFrame, query: str, limit: int = 10, tag: str | None = None, topic: str | None = None, stem: bool = False) -> DataFrame:
    """note_id, score, best (position of the best section): the best sections are taken first, then rolled up,
    filtered, weighted and cut, in this order. notes: id, and if there are any, tags, topic, generated."""
    best = scored_sections(sections, query, stem=stem).orderBy(F.desc("score"), "note_id", "pos").limit(limit * FAN_OUT)
    ranked = best.withColumn("rn", F.row_number().over(Window.partitionBy("note_id").orderBy(F.desc("score"), "pos")))
    rolled = ranked.groupBy("note_id").agg(F.sum(F.when(F.col("rn") == 1, F.col("score")).otherwise(F.col("score") * EXTRA)).alias("s"), F.min(F.when(F.col("rn") == 1, F.col("pos"))).alias("best"))
    own = notes.join(F.broadcast(rolled), notes["id"] == rolled["note_id"])
    if tag is not None:
        own = own.where(F.array_contains("tags", tag.lower()))
    if topic is not None:
        own = own.where(F.col("topic") == topic)
    factor = F.when(F.col("generated"), GENERATED).otherwise(1.0) if "generated" in notes.columns else F.lit(1.0)
    return own.select("note_id", F.round(F.col("s") * factor, 6).alias("score"), "best").orderBy(F.desc("score"), "note_id").limit(limit)



#: Marks around a hit, what stands for left-out text, and the words shown.
MARK, MORE, SNIPPET = "**", " … ", 18


def snippets(sections: DataFrame, query: str, words: int = SNIPPET) -> DataFrame:
    """note_id, pos, snippet: the ``words`` words of the body around its first hit, hits marked; the first ones without a hit."""
    wanted = query_terms(query)
    plain = lambda w: F.regexp_replace(F.translate(F.lower(w), *ACCENTS), r"(?U)^[^\w]+|[^\w]+$", "")

    def is_hit(w: Column) -> Column:
        hit = F.lit(False)
        for i, q in enumerate(wanted):
            hit = hit | (plain(w).startswith(q) if i == len(wanted) - 1 else plain(w) == q)
        return hit

    def cut(ws: Column) -> Column:
        marked = F.transform(ws, lambda w: F.struct(w.alias("w"), is_hit(w).alias("hit")))

        def shown(m: Column) -> Column:
            first = F.array_position(F.transform(m, lambda x: x["hit"]), True)
            begin = F.greatest(F.lit(1), F.least(first - words // 2, F.size(m) - (words - 1))).cast("int")
            text = F.array_join(F.transform(F.slice(m, begin, F.lit(words)), lambda x: F.when(x["hit"], F.concat(F.lit(MARK), x["w"], F.lit(MARK))).otherwise(x["w"])), " ")
            return F.concat(F.when(begin > 1, MORE).otherwise(""), text, F.when(begin + words <= F.size(m), MORE).otherwise(""))

        return F.element_at(F.transform(F.array(marked), shown), 1)

    body = F.filter(F.split(squeeze(F.coalesce("body", F.lit(""))), " "), lambda w: w != "")
    return sections.select("note_id", "pos", F.element_at(F.transform(F.array(body), cut), 1).alias("snippet"))


def did_you_mean(sections: DataFrame, notes: DataFrame, name: str, limit: int = 5) -> list[str]:
    """Ids to offer for a name that no note has: the best notes of a search for it."""
    return [r.note_id for r in search(sections, notes, name, limit).collect()]
