"""Toxicity: a linear classifier with counterfactual regularisation, fitted here on a bounded sample of labelled rows.

Features are the words of a text and their beginnings (``PREFIXES`` bytes), each present or not. Besides the log loss,
training penalises what a swap of an identity term for another of its kind changes in the score: for the labelled
sentences that name one, and for a neutral mention of each pair of terms. So the terms themselves carry no weight.
The driver sees ``SAMPLE_ROWS`` labelled rows at most (least hash of the doc_id first) and fits on ``SAMPLE_CHARS``
characters of them at most; a row that would exceed these is skipped. Scoring is map-only over all texts.

Defined results: a null text counts as empty and gets the score of no feature; rows with a null doc_id are not held out and
never learnt from; repeated rows are scored as they come; rows without a label are not learnt from; with no labels at all
every score is next to 0 (the sigmoid of -40). Other columns are not read, and pass through ``without_toxic`` untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, give_back, keep_only

#: Bounds of the fit: labelled rows that the driver collects, characters of all of them, features kept.
SAMPLE_ROWS, SAMPLE_CHARS, MAX_FEATURES = 6000, 40_000_000, 4_000
PREFIXES = (3, 4, 5, 6)
THRESHOLD, ROUNDS, RATE, RIDGE, FAIRNESS = 0.3, 400, 0.1, 1e-5, 1.0
WORD_CACHE = 150_000
#: Terms of one group stand for each other in counterfactuals: each group is of one language and one kind.
IDENTITIES = (
    "women men girls boys", "femmes hommes filles garçons", "frauen männer mädchen jungen", "mujeres hombres niñas niños",
    "christian muslim jewish hindu buddhist", "chrétien musulman juif", "christlich muslimisch jüdisch", "cristiano musulmán judío",
    "black white asian latino african european", "noir blanc africain européen", "schwarz weiß afrikanisch europäisch", "negro blanco africano europeo",
    "gay straight lesbian transgender queer", "homosexuel hétérosexuel", "schwul lesbisch", "heterosexual homosexual",
    "immigrant refugee foreigner native", "immigré réfugié étranger", "einwanderer flüchtling ausländer", "inmigrante refugiado extranjero",
    "old young disabled deaf blind", "vieux jeune", "alt jung", "viejo joven",
)
_TABLE = bytes(c if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SENTENCE = re.compile(r"[^.!?\n]+")


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode().translate(_TABLE).split())


def features_of(word: bytes) -> list[bytes]:
    return [b"=" + word, *(word[:k] for k in PREFIXES if len(word) > k)]


def _present(words: set[bytes]) -> set[bytes]:
    return {f for w in words for f in features_of(w)}


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = -40.0
    _words: dict[bytes, tuple[tuple[bytes, float], ...]] = field(default_factory=dict)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "_words": {}}

    def forget(self) -> None:
        """Empty the cache of words."""
        self._words.clear()

    def score(self, text: str | None) -> float:
        known, found = self._words, {}
        if len(known) > WORD_CACHE:
            known.clear()
        for w in words_of(text):
            own = known.get(w)
            if own is None:
                own = known[w] = tuple((f, self.weights[f]) for f in features_of(w) if f in self.weights)
            if own:
                found.update(own)
        z = self.bias + sum(found[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-max(-40.0, min(40.0, z)))))


def _counterfactuals(texts: list[str]) -> list[tuple[set[bytes], set[bytes]]]:
    """Features of sentences and of the same with an identity term swapped."""
    groups = [[t.encode() for t in g.split()] for g in IDENTITIES]
    of_term = {t: g for g in groups for t in g}
    pairs = [(_present({a}), _present({b})) for g in groups for a, b in zip(g, g[1:] + g[:1], strict=True)]
    for text in texts:
        if not of_term.keys().isdisjoint(words_of(text)):
            for s in _SENTENCE.findall(text):
                words = words_of(s)
                for t in words & of_term.keys():
                    g = of_term[t]
                    pairs.append((_present(words), _present(words - {t} | {g[(g.index(t) + 1) % len(g)]})))
    return pairs


def fit(rows: list[tuple[str, int]], fairness: float = FAIRNESS) -> Model:
    """Fit on (text, label) rows; ``fairness`` weighs the penalty on what a swapped identity term changes."""
    if not rows:
        return Model()
    texts, y = [t or "" for t, _ in rows], np.array([r for _, r in rows], float)
    ids: dict[bytes, int] = {}  # features are numbers from here on: a text's set of them would take 30 times the memory
    present = [np.array([ids.setdefault(f, len(ids)) for f in _present(words_of(t))], np.int32) for t in texts]
    n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    count = lambda own: np.bincount(np.concatenate([np.zeros(0, np.int32), *own]), minlength=len(ids))
    with_one, without = count([p for p, v in zip(present, y, strict=True) if v]), count([p for p, v in zip(present, y, strict=True) if not v])
    gap = np.where(with_one + without >= 3, np.abs(with_one / n1 - without / n0), 0.0)
    names = list(ids)
    chosen = [names[k] for k in sorted(np.flatnonzero(gap > 0).tolist(), key=lambda k: (-gap[k], names[k]))[:MAX_FEATURES]]
    pairs = _counterfactuals(texts)
    number = {f: k for k, f in enumerate(dict.fromkeys([*chosen, *sorted({f for a, b in pairs[: sum(len(g.split()) for g in IDENTITIES)] for f in a | b})]))}
    column = np.full(len(ids), -1, np.int64)
    for f, k in number.items():
        if f in ids:
            column[ids[f]] = k
    kept = [np.sort(c[c >= 0]) for c in (column[p] for p in present)]
    row, col = np.repeat(np.arange(len(kept)), list(map(len, kept))), np.concatenate(kept)
    del ids, names, present

    def matrix(sets: list[set[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        cols = [sorted(number[f] for f in s if f in number) for s in sets]
        return np.repeat(np.arange(len(sets)), list(map(len, cols))), np.array([c for x in cols for c in x], np.int64)

    left, right = matrix([a - b for a, b in pairs]), matrix([b - a for a, b in pairs])
    n, m, d = len(y), len(number), len(pairs)
    w, bias = np.zeros(m), float(np.log(n1 / n0))
    moment, spread = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, ROUNDS + 1):
        z = np.bincount(row, w[col], n) + bias
        miss = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        change = np.bincount(left[0], w[left[1]], d) - np.bincount(right[0], w[right[1]], d)
        grad = np.bincount(col, miss[row], m) + RIDGE * w
        grad += 2 * fairness / d * (np.bincount(left[1], change[left[0]], m) - np.bincount(right[1], change[right[0]], m))
        grad = np.append(grad, miss.sum())
        moment = 0.9 * moment + 0.1 * grad
        spread = 0.99 * spread + 0.01 * grad**2
        step = RATE * (moment / (1 - 0.9**t)) / (np.sqrt(spread / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return Model({f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-3}, float(bias))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled rows that are not held out.

    In the order of the hash, a row whose text would bring the total over ``SAMPLE_CHARS`` is skipped, those after it are
    not; a text that is longer alone doesn't reach the driver. Raises if that leaves no row of those with a label.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    drawn = usable.select(F.col("doc_id").cast("long").alias("__id"), "toxic").orderBy(F.xxhash64("__id"), "__id", "toxic").limit(sample_rows)
    n = F.coalesce(F.length("text"), F.lit(0))
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), n.alias("n"), F.when(n <= SAMPLE_CHARS, F.col("text")).alias("text")).join(F.broadcast(drawn), "__id")
    texts = texts.select("__id", "n", "text", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("__id"), "__id", "toxic", "n", F.xxhash64("text"))
    rows, size, skipped = [], 0, 0
    for r in texts.toLocalIterator():
        if size + r.n > SAMPLE_CHARS:
            skipped += 1
            continue
        size += r.n
        rows.append((r["__id"], r.text or "", r.toxic))
    if skipped and not rows:
        raise ValueError(f"each of the {skipped} labelled texts has over {SAMPLE_CHARS} characters: nothing to fit on")
    rows.sort()
    return fit([(t, y) for _, t, y in rows])


def _scores(docs: DataFrame, model: Model) -> Column:
    """The score of ``text``; the broadcast model has ``MAX_FEATURES`` features at most (and the terms). Only texts go to Python."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keep_only()
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype=float)
        shared.value.forget()
        give_back()

    return score(F.col("text"))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    doc_id = F.col("doc_id").cast("long")
    held = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
    scored = docs.select(doc_id.alias("doc_id"), held.alias("held_out"), _scores(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, train(docs, labels))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below the threshold; all columns stay."""
    return docs.where(_scores(docs, train(docs, labels)) < THRESHOLD)
