"""Where a quoted passage stands in a note: exactly (white space and case apart), else by the most similar lines."""

from __future__ import annotations

import difflib
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FUZZY, WINDOWS = 0.85, (1, 2, 3)
SCHEMA = "line_start int, line_end int, heading string, text string, hash string, match string"
_HEADING = re.compile(r"#{1,6}\s+(.*?)\s*$")


def _squeeze(text: str) -> str:
    return " ".join(text.split())


def locate(quote: str, note: str, fuzzy: bool = True) -> dict | None:
    """Lines (from 1), the heading above them, the text found, its hash, and ``exact`` or ``fuzzy`` with the ratio; None if it isn't there."""
    want, lines = _squeeze(quote).lower(), note.split("\n")
    if not want:
        return None
    plain = [_squeeze(x) for x in lines]
    filled = [i for i, x in enumerate(plain) if x]
    joined = " ".join(plain[i] for i in filled)
    at, match, first, last, text = joined.lower().find(want), "exact", 0, 0, ""
    if at >= 0:
        begin = 0
        spans = []
        for i in filled:
            spans.append((begin, begin + len(plain[i]), i))
            begin += len(plain[i]) + 1
        own = [i for a, b, i in spans if a < at + len(want) and b > at]
        first, last, text = own[0], own[-1], joined[at : at + len(want)]
    elif fuzzy:
        best = 0.0
        for k in WINDOWS:
            for n in range(len(plain) - k + 1):
                candidate = _squeeze(" ".join(plain[n : n + k]))
                matcher = difflib.SequenceMatcher(None, want, candidate.lower(), autojunk=False)
                if matcher.real_quick_ratio() > best and matcher.quick_ratio() > best and (ratio := matcher.ratio()) > best:
                    best, first, last, text = ratio, n, n + k - 1, candidate
        if best < FUZZY:
            return None
        match = f"fuzzy {best:.2f}"
    else:
        return None
    above = next((m[1] for x in reversed(lines[: first + 1]) if (m := _HEADING.match(x))), "")
    digest = hashlib.sha256(text.lower().encode()).hexdigest()[:16]
    return {"line_start": first + 1, "line_end": last + 1, "heading": above, "text": text, "hash": digest, "match": match}


def relocate(span: dict, note: str) -> dict | None:
    """Where the text of an earlier span stands in a changed note, exactly; it keeps how it was matched at first."""
    found = locate(span["text"], note, fuzzy=False)
    return found and found | {"match": span.get("match", "exact")}


def locate_quotes(pairs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """pairs (id, quote, note) with where the quote stands; nulls where it doesn't."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [locate(q or "", n or "", fuzzy) or {} for q, n in zip(pdf["quote"], pdf["note"], strict=True)]
            out = {"id": pdf["id"]} | {c: pd.Series([f.get(c) for f in found], dtype="Int32", index=pdf.index) for c in ("line_start", "line_end")}
            yield pd.DataFrame(out | {c: pd.Series([f.get(c) for f in found], dtype=object, index=pdf.index) for c in ("heading", "text", "hash", "match")})

    kind = pairs.schema["id"].dataType.simpleString()
    return pairs.select("id", F.col("quote"), F.col("note")).mapInPandas(run, f"id {kind}, {SCHEMA}")


def relocate_quotes(spans: DataFrame) -> DataFrame:
    """spans (id, text, match, note) with where their text stands in the changed note, exactly; nulls where it is gone."""
    found = locate_quotes(spans.select("id", F.col("text").alias("quote"), "note"), fuzzy=False)
    return found.drop("match").join(spans.select("id", "match"), "id").withColumn("match", F.when(F.col("line_start").isNotNull(), F.col("match")))
