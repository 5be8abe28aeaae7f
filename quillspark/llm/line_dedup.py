"""Line dedup: an exact pass by content hash, and a segment-partition edit join for near copies; native operations only.

Lines of at least ``NEAR_CHARS`` characters are cut into threshold + 1 segments. A line within the threshold keeps one of
them whole, so each line is indexed under (length, segment number, segment) and probed with its substrings at the places
that a partner of each length can have them. Candidates are verified by a banded bit-parallel edit distance: the
2 * threshold + 1 diagonals of a column are the bits of one word; those that differ in too many short pieces are ruled out
before. Linked lines and copies form classes, of which the first line (least doc_id, then place) stays.

A key that more than ``HOT_LINES`` different lines share doesn't pair them all. With threshold 1, the rest of its lines
differs in one place, so each is dealt out under the line without that place (as an XOR of hashes of places and
characters, so that a line costs its length), and the first of each deal is the candidate of the others. All candidates are
verified alike. Other thresholds have no such way: a hot key raises.

Defined results: a null text has no lines; a line without a word is never removed; rows with a null doc_id are left as
they are and repeat nobody; rows that repeat doc_id and text are one document; rows of one doc_id with different texts are
different documents, of which the one with the lesser hash of its text comes first; other columns are not read, and pass
through ``without_lines`` untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import add_part, bound_reads, cut_lineage, free_name, let, small, with_text_id
from .components import components

THRESHOLD, NEAR_CHARS, HOT_LINES = 1, 8, 64
_BLANKS = " \t\n\x0b\x0c\r"


def _alike(a: Column, b: Column, threshold: int) -> Column:
    """False only for strings that are more than ``threshold`` edits apart: an edit touches one piece of ``a`` at most, and
    moves the others by one place at most, so all pieces but ``threshold`` stand in ``b`` at most that far from their place."""
    n, k = F.length(a), 4 * (threshold + 1)

    def lost(i: int) -> Column:
        first = F.floor(n * i / k).cast("int")
        size = F.floor(n * (i + 1) / k).cast("int") - first
        piece = F.substring(a, first + 1, size)
        # a place before the beginning counts from the end: that can only find a piece too many
        there = [F.substring(b, first + 1 + shift, size) == piece for shift in sorted(range(-threshold, threshold + 1), key=abs)]
        return F.when(reduce(Column.__or__, there), 0).otherwise(1)

    return reduce(Column.__add__, map(lost, range(k))) <= threshold


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether the edit distance of two strings (of ``threshold`` characters at least) is at most ``threshold``.

    Of the candidates that share a segment, few are alike in the rest: those that ``_alike`` rules out skip the columns.

    Banded bit-parallel columns: bit k of a word stands for the cell of ``a`` at j + k - threshold, for character j of
    ``b``. One addition carries the equal diagonals through the band; the band then moves down by a shift. The distance
    is followed along the band's lowest diagonal, and along the last row once that is reached.
    """
    width = 2 * threshold + 1
    full, top = F.lit((1 << width) - 1).cast("long"), F.lit(1 << (width - 1)).cast("long")
    zero = F.lit(0).cast("long")
    la, lb = F.length(a), F.length(b)

    def inverted(x: Column) -> Column:
        return full.bitwiseXOR(x.bitwiseAND(full))

    def distance(t: Column) -> Column:
        x, n = t["x"], F.size(t["x"])
        begin = F.struct(F.lit(threshold).cast("long").alias("dist"), F.lit((1 << width) - (1 << threshold)).cast("long").alias("vp"), zero.alias("vn"), F.lit(0).alias("j"))

        def column(s: Column, c: Column) -> Column:
            match = reduce(Column.bitwiseOR, [F.when(F.get(x, s["j"] + (k - threshold)) == c, F.lit(1 << k)).otherwise(0).cast("long") for k in range(width)])
            vp, vn, j = s["vp"], s["vn"], s["j"]

            def step(d0: Column) -> Column:
                hp, hn, down = vn.bitwiseOR(inverted(d0.bitwiseOR(vp))), d0.bitwiseAND(vp), F.shiftright(d0, 1)
                row = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(n - 1 - j + threshold, F.lit(0)))
                last = F.when(hp.bitwiseAND(row) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(row) != 0, 1).otherwise(0)
                diagonal = F.when(d0.bitwiseAND(top) == 0, 1).otherwise(0)
                return F.struct(
                    (s["dist"] + F.when(j < n - threshold, diagonal).otherwise(last)).alias("dist"),
                    hn.bitwiseOR(inverted(down.bitwiseOR(hp))).alias("vp"),
                    down.bitwiseAND(hp).alias("vn"),
                    (j + 1).alias("j"),
                )

            return let(match, lambda m: let((m.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(m).bitwiseOR(vn).bitwiseAND(full), step))

        return F.aggregate(t["y"], begin, column)["dist"]

    chars = F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    return F.when((F.abs(la - lb) <= threshold) & _alike(a, b, threshold), let(chars, distance) <= threshold).otherwise(False)


def _lines(docs: DataFrame) -> DataFrame:
    """doc, part, place and line of each line with a word. docs: doc_id, part, text."""
    return (
        docs.where("doc_id IS NOT NULL")
        .select(F.col("doc_id").alias("doc"), "part", F.posexplode(F.split("text", "\n")).alias("place", "line"))
        .where(F.btrim("line", F.lit(_BLANKS)) != "")
    )


def _identity(line: Column) -> list[Column]:
    """Two independent 64-bit hashes name a line."""
    return [F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g")]


def _keys(line: Column, threshold: int) -> Column:
    """Index keys (side 0) and probe keys (side 1) of a line, with where the segment stands in it."""
    n, k, out = F.length(line), threshold + 1, []

    def key(length: Column, i: int, start: Column, size: Column, side: int) -> Column:
        return F.struct(
            F.xxhash64(length, F.lit(i), F.substring(line, start + 1, size)).alias("key"), F.lit(side).cast("byte").alias("side"), start.cast("int").alias("start"), size.cast("int").alias("size")
        )

    for shorter in range(threshold + 1):
        length = n - shorter
        for i in range(k):
            first = F.floor(length * i / k).cast("int")
            size = F.floor(length * (i + 1) / k).cast("int") - first
            for shift in range(max(-i, shorter - (threshold - i)), min(i, shorter + threshold - i) + 1):
                same = shorter == 0 and shift == 0
                out.append(key(length, i, first + shift, size, 0 if same else 1))
    return F.array(*out)


def _candidates(lines: DataFrame, threshold: int) -> DataFrame:
    """Key rows of lines whose key at least two different lines have: key, side, start, size, h, g."""
    long_lines = lines.where(F.length("line") >= NEAR_CHARS)
    rows = long_lines.select(*_identity(F.col("line")), F.explode(_keys(F.col("line"), threshold)).alias("k")).select("k.*", "h", "g")
    live = rows.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.min("side").alias("s")).where("a < b AND s = 0").select("key")
    found = rows.join(live, "key", "left_semi").groupBy("key", "side", "h", "g").agg(F.first("start").alias("start"), F.first("size").alias("size"))
    return cut_lineage(found)


def _dealt_out(hot: DataFrame) -> DataFrame:
    """x, y: of the lines of each hot key, the first of those that agree but for one place, and each of the others.

    hot: key, side, h, g, start and size of the segment, line. A line without its character i meets those that differ there
    (all within one edit of each other); a line as it is meets those with one character more.
    """
    rest = F.concat(F.expr("substring(line, 1, start)"), F.expr("substring(line, start + size + 1)"))
    chars = hot.select("key", "side", F.struct("h", "g").alias("x"), F.posexplode(F.split(rest, "")).alias("i", "c"))
    hashed = chars.select("key", "side", "x", "i", F.xxhash64("i", "c").alias("here"), F.xxhash64(F.col("i") - 1, "c").alias("before"))
    line = Window.partitionBy("key", "side", "x")
    upto = line.orderBy("i")
    # XOR of the characters at their places: all, all but this one, and all but this one with the later ones moved up
    whole = F.bit_xor("here").over(line)
    lead = F.bit_xor("here").over(upto).bitwiseXOR(F.col("here"))
    tail = F.bit_xor("before").over(line).bitwiseXOR(F.bit_xor("before").over(upto))
    placed = hashed.select("key", "side", "x", "i", whole.alias("whole"), whole.bitwiseXOR(F.col("here")).alias("masked"), lead.bitwiseXOR(tail).alias("shorter"))
    masked = placed.where("side = 0").select(F.xxhash64("key", F.lit(0), "i", "masked").alias("v"), "x")
    shorter = placed.where("side = 1").select(F.xxhash64("key", F.lit(1), "shorter").alias("v"), F.col("x").alias("y"))
    as_it_is = placed.where("side = 0 AND i = 0").select(F.xxhash64("key", F.lit(1), "whole").alias("v"), "x")
    first = masked.groupBy("v").agg(F.min("x").alias("a"), F.max("x").alias("z")).where("a < z").select("v", "a")
    stars = masked.join(first, "v").where("a < x").select(F.col("a").alias("x"), F.col("x").alias("y"))
    least = as_it_is.groupBy("v").agg(F.min("x").alias("x"))  # lines of one rest and key are one line
    return stars.unionByName(least.join(shorter, "v").select("x", "y"))


def _links(lines: DataFrame, threshold: int) -> DataFrame:
    """a, b: hashes of different lines within the threshold, enough of them to connect all that are linked."""
    rows = _candidates(lines, threshold)
    wanted = small(cut_lineage(rows.select("h", "g").distinct()))
    texts = cut_lineage(lines.where(F.length("line") >= NEAR_CHARS).select(*_identity(F.col("line")), "line").join(wanted, ["h", "g"], "left_semi").groupBy("h", "g").agg(F.first("line").alias("line")))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    sized = rows.join(sizes, "key")
    few, hot = sized.where(F.col("n") <= HOT_LINES), sized.where(F.col("n") > HOT_LINES)
    if threshold != 1 and not hot.isEmpty():
        raise ValueError(f"threshold {threshold}: a key has over {HOT_LINES} lines, and only threshold 1 has a way around all their pairs")
    pairs = (
        few.where("side = 0").select("key", F.col("h").alias("a"), F.col("g").alias("ga"))
        .join(few.select("key", F.col("h").alias("b"), F.col("g").alias("gb"), "side"), "key")
        .where("a < b OR (side = 1 AND a > b)")
        .select(F.struct(F.col("a").alias("h"), F.col("ga").alias("g")).alias("x"), F.struct(F.col("b").alias("h"), F.col("gb").alias("g")).alias("y"))
    )
    if threshold == 1:
        pairs = pairs.unionByName(_dealt_out(hot.join(texts, ["h", "g"])))
    pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct()
    left = texts.select(F.col("h").alias("a"), F.col("g").alias("ga"), F.col("line").alias("la"))
    right = texts.select(F.col("h").alias("b"), F.col("g").alias("gb"), F.col("line").alias("lb"))
    named = pairs.select(F.col("x.h").alias("a"), F.col("x.g").alias("ga"), F.col("y.h").alias("b"), F.col("y.g").alias("gb"))
    return named.join(left, ["a", "ga"]).join(right, ["b", "gb"]).where(within(F.col("la"), F.col("lb"), threshold)).select("a", "b")


def removed_lines(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc, part, place, near: the lines that go; ``near`` if no equal line came before. docs: doc_id, part, text."""
    bound_reads(docs.sparkSession)
    lines = _lines(docs)
    known = lines.select("doc", "part", "place", *_identity(F.col("line")))
    firsts = known.groupBy("h", "g").agg(F.min(F.struct("doc", "part", "place")).alias("first"), F.count("*").alias("n"))
    roots = components(_links(lines, threshold), "a", "b")
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    members = cut_lineage(firsts.join(linked, F.col("h") == F.col("node")).select("h", "g", "first", "root"))
    heads = members.groupBy("root").agg(F.min("first").alias("head"))
    near = members.join(heads, "root").select("h", "g", F.col("first").alias("own"), "head")
    copies = firsts.where("n > 1").select("h", "g", F.col("first").alias("own"), F.col("first").alias("head"))
    decided = near.unionByName(copies.join(members.select("h", "g"), ["h", "g"], "left_anti"))
    here = F.struct("doc", "part", "place")
    return known.join(decided, ["h", "g"]).where(here != F.col("head")).select("doc", "part", "place", (here == F.col("own")).alias("near")).distinct()


def line_dedup(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_lines, n_removed, n_near, removed_lines (their numbers from 0, comma-joined) for each row of ``docs``."""
    own = with_text_id(docs)
    gone = removed_lines(own, threshold).groupBy("doc", F.col("part").alias("p")).agg(F.sort_array(F.collect_list(F.struct("place", "near"))).alias("gone"))
    counted = own.select("doc_id", "part", F.greatest(F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long"), F.lit(0)).alias("n_lines"))
    none = F.array().cast("array<struct<place:int,near:boolean>>")
    return counted.join(gone, (F.col("doc_id") == F.col("doc")) & (F.col("part") == F.col("p")), "left").select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.size(F.filter(F.coalesce("gone", none), lambda x: x["near"])).cast("long").alias("n_near"),
        F.array_join(F.transform(F.coalesce("gone", none), lambda x: x["place"].cast("string")), ",").alias("removed_lines"),
    )


def without_lines(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without the removed lines; all columns stay, ``n_chars`` follows the text. A text of which
    no line with a word is left is dropped; one that had none is kept."""
    part, doc, p, gone, left = (free_name(docs, c) for c in ("part", "doc", "p", "gone", "left"))
    lines = removed_lines(with_text_id(docs), threshold).groupBy(F.col("doc").alias(doc), F.col("part").alias(p)).agg(F.collect_list("place").alias(gone))
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    joined = add_part(docs, part).join(lines, (F.col("doc_id").cast("long") == F.col(doc)) & (F.col(part) == F.col(p)), "left")
    joined = joined.withColumn(left, F.when(F.col(gone).isNull(), F.col("text")).otherwise(rest))
    kept = joined.where(F.col(gone).isNull() | (F.btrim(left, F.lit(_BLANKS)) != ""))

    def column(c: str) -> Column:
        if c == "text":
            return F.col(left).alias(c)
        if c == "n_chars":
            return F.when(F.col(gone).isNull(), F.col(c)).otherwise(F.length(left)).cast(docs.schema[c].dataType).alias(c)
        return F.col(f"`{c}`")

    return kept.select(*map(column, docs.columns))
