"""Batch calls of a model: injected, run on partitions, failures kept apart from results."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: prompt -> JSON text of the answer.
Provider = Callable[[str], str]
MAX_PROMPT = 60_000


def offline(prompt: str) -> str:
    """A stub that needs no network: the first sentence as a summary, the longest words as topics."""
    words = sorted({w.strip(".,;:").lower() for w in prompt.split()}, key=lambda w: (-len(w), w))
    return json.dumps({"summary": prompt.split(".")[0][:200].strip(), "topics": words[:3], "note_type": "note", "key_claims": [], "open_questions": [], "entities": []})


ENRICHMENT = "summary string, topics array<string>, note_type string, key_claims array<string>, open_questions array<string>, entities array<string>"


def call(prompts: DataFrame, provider: Provider = offline, schema: str = ENRICHMENT) -> DataFrame:
    """key, result (struct), error for prompts (key, prompt): one failed call is a row with an error, the rest goes on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, prompt in zip(pdf["key"], pdf["prompt"], strict=True):
                try:
                    rows.append((key, provider(prompt or ""), None))
                except Exception as e:  # noqa: BLE001 - whatever a provider raises belongs to its row
                    rows.append((key, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["key", "answer", "error"])

    cut = prompts.select("key", F.substring("prompt", 1, MAX_PROMPT).alias("prompt"))
    kind = prompts.schema["key"].dataType.simpleString()
    answers = cut.mapInPandas(run, f"key {kind}, answer string, error string")
    parsed = answers.withColumn("result", F.from_json("answer", schema))
    bad = F.col("error").isNull() & F.col("result").isNull()
    return parsed.select("key", "result", F.when(bad, "not an object").otherwise(F.col("error")).alias("error"))


def accepted_relations(answers: DataFrame, candidates: DataFrame, types: tuple[str, ...], least: float = 0.5) -> DataFrame:
    """src, dst, type, confidence that a link pass keeps: known type, known candidate, confident enough."""
    return answers.where(F.col("type").isin(*types) & (F.col("confidence") >= least)).join(candidates.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
