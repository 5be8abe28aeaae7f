"""The pipeline's stages on planted cases."""

import random

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, shared, long = prose(30), prose(12), prose(300)
    few = lambda n: " ".join(rng.choice(words[:40]) for _ in range(n))
    docs = [(i, few(60) + (" zarkish blorp grunz" if i % 4 == 0 else ""), "en", "s", 1) for i in range(240)]
    docs += [(1000, long, "en", "s", 1), (1001, long.replace(" ", "  ", 1), "en", "s", 1)]  # near copies, different lines
    docs += [(1010, f"{prose(40)}\n{shared}", "en", "s", 1), (1011, f"{prose(40)}\n{shared}", "en", "s", 1)]
    docs += [(1020, f"{prose(20)} {passage.upper()} {prose(20)}", "en", "s", 1), (1030, None, None, None, None), (1031, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        at = spark.read.parquet(str(tmp_path / f"out{k}"))
        if name != "packing":
            assert sorted(at.columns) == sorted(COLUMNS)
            seen[name] = {r.doc_id: r for r in at.collect()}
    clean = {d[0] for d in docs if d[0] >= 1000 or d[0] % 4}
    assert set(seen["toxicity"]) == clean
    lines = seen["line_dedup"]
    assert lines[1010].text.endswith(shared) and not lines[1011].text.endswith(shared) and lines[1011].n_chars == len(lines[1011].text)
    assert set(seen["near_dedup"]) & {1000, 1001} == {1000}
    left = seen["decontamination"]
    assert passage.upper() not in left[1020].text and len(left[1020].text) > 100 and left[1000].text == long
    pieces = at.collect()
    assert {p.doc_id for p in pieces} == set(left) and all(0 < p.length <= 4096 for p in pieces)
