"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``RADIUS`` bits share a variant within half the radius of both (an odd radius: within the lower
half of one, the upper half of the other). Every distinct fingerprint has 2081 such variants at radius 4; they are shuffled
by a prefix, so that a fingerprint travels once for each prefix that its variants can have, and the variants of a prefix
are expanded where they meet. All fingerprints of one variant are within the radius of one in its lower half, so each is
linked to one such (verified), not to all. The prefix grows with the number of fingerprints; a prefix that is nevertheless
shared by more than ``HOT_PRINTS`` of them is dealt out again under ``STEP`` more bits, in rounds, if need be up to whole
variants, which have at most as many fingerprints as a ball of half the radius. Copies are one fingerprint, and components
are computed distributed over fingerprints.

Defined results: a null or empty text has fingerprint zero and is linked like any other; rows with a null doc_id link
nothing and get the component of their fingerprint (null if no doc_id has it); rows that share a doc_id are linked by their
texts alone, each row has the component of its own text; repeated rows are returned as they come; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, bound_reads, cut_lineage, give_back, keep_only, small
from .components import components

SHINGLE, SEED, BITS, RADIUS = 4, 42, 64, 4
#: A greater radius raises: a fingerprint would have over 8 million variants.
MOST_RADIUS = 8
#: Variants that one prefix should have on average; and the most that a task holds at a time.
PREFIX_VARIANTS, HELD_VARIANTS = 500_000, 1_000_000
#: Fingerprints of a prefix beyond which it is split, and the bits that a split adds.
HOT_PRINTS, STEP = 50_000, 4
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    size = min(SHINGLE, len(words))
    starts = np.concatenate([[0], ends[: len(words) - size]]).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), fp (long with the fingerprint's bits) for each row of ``docs``. Only texts go to Python."""

    bound_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keep_only()
        for texts in batches:
            yield pd.Series(np.fromiter(map(fingerprint, texts), "u8", len(texts)).view("i8"))
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), run("text").alias("fp"))


@lru_cache(maxsize=64)
def _flips(bits: int, most: int) -> np.ndarray:
    """All masks over the low ``bits`` bits with at most ``most`` ones."""
    masks, top = [np.zeros(1, np.uint64)], np.array([-1])
    for _ in range(min(most, bits)):
        more = bits - 1 - top
        top = np.repeat(top, more) + 1 + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        masks.append(np.repeat(masks[-1], more) | np.uint64(1) << top.astype(np.uint64))
    return np.concatenate(masks)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node that each of n nodes reaches over the edges a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _collide(fp: np.ndarray, prefix: int, bits: int, half: int, odd: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index, index) of fingerprints that share a variant whose ``bits`` highest bits are ``prefix``.

    Each is paired with one of the variant's fingerprints: with the nearest to the variant if ``odd``.
    """
    low_bits = BITS - bits
    apart = np.bitwise_count((fp >> np.uint64(low_bits)) ^ np.uint64(prefix)) if bits else np.zeros(len(fp), np.uint8)
    near = np.flatnonzero(apart <= half)
    if len(near) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    masks = [_flips(low_bits, half - d) for d in range(half + 1)]
    if sum(int((apart == d).sum()) * len(masks[d]) for d in range(half + 1)) > HELD_VARIANTS and low_bits > 2:
        parts = [_collide(fp[near], prefix << 1 | b, bits + 1, half, odd) for b in (0, 1)]  # one more bit of the prefix
        return near[np.concatenate([p[0] for p in parts])], near[np.concatenate([p[1] for p in parts])]
    keep = np.uint64((1 << low_bits) - 1)
    variants, who = [], []
    for d in range(half + 1):
        own = np.flatnonzero(apart == d)
        variants.append(((fp[own] & keep)[:, None] ^ masks[d]).reshape(-1))
        who.append(np.repeat(own, len(masks[d])))
    variants, who = np.concatenate(variants), np.concatenate(who)
    order = np.lexsort([np.bitwise_count(fp[who] ^ (variants | np.uint64(prefix << low_bits))), variants]) if odd else np.argsort(variants, kind="stable")
    variants = variants[order]
    same = np.flatnonzero(variants[1:] == variants[:-1])
    if not len(same):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    who = who[order]
    begins = np.flatnonzero(np.concatenate([[True], variants[1:] != variants[:-1]]))
    group = np.searchsorted(begins, same + 1, side="right") - 1
    pairs = np.unique(np.column_stack([who[begins[group]], who[same + 1]]), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _dealt(prints: DataFrame, bits: int, half: int) -> DataFrame:
    """bits, prefix, fp: each fingerprint under every prefix that a variant of it can have."""
    near = F.transform(F.array(*[F.lit(int(m)) for m in _flips(bits, half).tolist()]), lambda m: F.shiftrightunsigned("fp", BITS - bits).bitwiseXOR(m.cast("long")))
    return prints.select(F.lit(bits).alias("bits"), F.explode(near).alias("prefix"), "fp")


def _split(hot: DataFrame, half: int) -> DataFrame:
    """Rows of hot prefixes under each longer prefix that a variant of them can have."""
    hot = hot.select(F.col("bits").alias("was"), F.col("prefix").alias("head"), "fp")
    step = F.least(F.lit(STEP), F.lit(BITS) - F.col("was"))
    longer = F.col("was") + step
    shift = lambda x, n: F.call_function("shiftleft", x, n)
    tails = F.transform(F.sequence(F.lit(0).cast("long"), shift(F.lit(1).cast("long"), step) - 1), lambda t: shift(F.col("head"), step).bitwiseOR(t))
    apart = lambda p: F.bit_count(F.call_function("shiftrightunsigned", F.col("fp"), F.lit(BITS) - longer).bitwiseXOR(p))
    return hot.select(longer.alias("bits"), F.explode(F.filter(tails, lambda p: apart(p) <= half)).alias("prefix"), "fp")


def link(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, root for distinct ``prints`` (fp): pairs that connect whatever lies within ``radius`` bits."""
    if not 0 <= radius <= MOST_RADIUS:
        raise ValueError(f"radius {radius} is not within 0 and {MOST_RADIUS}")
    bound_reads(prints.sparkSession)
    half, odd = (radius + 1) // 2, radius % 2 == 1
    total = prints.count() * len(_flips(BITS, half))
    bits = min(32, max(2, (total // PREFIX_VARIANTS).bit_length()))
    dealt, done = _dealt(prints, bits, half), []
    while True:
        # at 64 bits a prefix is a variant: its ball bounds it
        hot = cut_lineage(dealt.groupBy("bits", "prefix").agg(F.count("*").alias("n")).where((F.col("n") > HOT_PRINTS) & (F.col("bits") < BITS)).select("bits", "prefix"))
        if hot.isEmpty():
            break
        hot = small(hot)
        done.append(dealt.join(hot, ["bits", "prefix"], "left_anti"))
        dealt = cut_lineage(_split(dealt.join(hot, ["bits", "prefix"], "left_semi"), half))
    for part in done:
        dealt = dealt.unionByName(part)

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy().view("u8")
        a, b = _collide(fp, int(np.int64(key[1]).view("u8")), int(key[0]), half, odd)
        close = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        a, b = a[close], b[close]
        nodes, local = np.unique(np.concatenate([a, b]), return_inverse=True)
        local = local.reshape(-1)
        root = _roots(len(nodes), local[: len(a)], local[len(a) :])
        own = pdf["fp"].to_numpy()[nodes]
        linked = root != np.arange(len(nodes))
        return pd.DataFrame({"fp": own[linked], "root": own[root[linked]]})

    return dealt.groupBy("bits", "prefix").applyInPandas(meet, "fp long, root long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, h, fp, component_id for each row of ``docs``."""
    prints = cut_lineage(fingerprints(docs))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("doc"))
    roots = cut_lineage(components(link(distinct.where("doc IS NOT NULL").select("fp"), radius), "fp", "root"))
    classes = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    members = distinct.join(classes, F.col("fp") == F.col("node"), "left").select("fp", "doc", "root")
    least = members.where("root IS NOT NULL").groupBy("root").agg(F.min("doc").alias("least"))
    of_print = members.join(least, "root", "left").select("fp", F.coalesce("least", "doc").alias("component_id"))
    return prints.join(of_print, "fp").select("doc_id", "h", "fp", "component_id")


def first_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of their component; all columns stay. A null doc_id stays."""
    found = near_duplicates(docs.where("doc_id IS NOT NULL"), radius)
    gone = found.where("doc_id <> component_id").select(F.struct("doc_id", "h").alias("gone")).distinct()
    own = F.struct(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("h"))
    return docs.join(gone, own == gone["gone"], "left_anti")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
