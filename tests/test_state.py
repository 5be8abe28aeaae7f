import pytest
from pyspark.sql import functions as F

from quillspark.functions import providers
from quillspark.sources import records
from quillspark.streaming import notes


def test_settings_and_framework():
    s = records.Settings.parse('[quillspark]\noutput_dir = "out/"\nrelated_k = 3\nnonsense = 1\nexclude = ["a", "b"]')
    assert (s.output_dir, s.related_k, s.exclude, s.related_floor) == ("out", 3, ("a", "b"), 0.12)
    good = 'id = "f"\nversion = 2\ncontext_fields = ["x"]\ncontext_match = ["x"]\n[[scales]]\nid = "s"\n[[relations]]\nid = "r"\nkind = "causal"\nsign = -1\n[[evidence]]\nid = "e"\nweight = 0.5\n'
    assert records.Framework.parse(good).ref == "f@2"
    for bad in (good.replace("-1", "2"), good.replace('"causal"', '"odd"'), good.replace('match = ["x"]', 'match = ["y"]'), good + '[[scales]]\nid = "s"\n', good.replace("0.5", "1.5")):
        with pytest.raises(ValueError):
            records.Framework.parse(bad)


def test_snapshot_replaces_what_it_reads(spark, tmp_path):
    path = str(tmp_path / "t")
    records.write_snapshot(spark.range(3), path)
    records.write_snapshot(spark.read.parquet(path).where("id > 0"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]


def test_jsonl_last_file_wins(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "v": 1}\n\n{"id": "2", "v": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"id": "1", "v": 9}\n')
    assert {r.id: r.v for r in records.read_jsonl(spark, str(tmp_path), "id string, v int", "id").collect()} == {"1": 9, "2": 2}


def test_changed_pages(spark):
    page = lambda rows: spark.createDataFrame(rows, "path string, text string")
    assert [r.path for r in records.changed_pages(page([("a", "1"), ("b", "2")]), page([("a", "1"), ("b", "x")])).collect()] == ["b"]


def test_failures_stay_with_their_row(spark):
    def provider(prompt):
        if "bad" in prompt:
            raise RuntimeError("no")
        return providers.offline(prompt) if "odd" not in prompt else "odd"

    prompts = spark.createDataFrame([("1", "Good text. More."), ("2", "bad"), ("3", "odd"), ("4", None)], "key string, prompt string")
    got = {r.key: r for r in providers.call(prompts, provider).collect()}
    assert got["1"].result.summary == "Good text" and got["1"].error is None and got["2"].error == "RuntimeError: no"
    assert got["4"].error is None


def test_stream_reads_each_note_once(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.md").write_text("# A")
    seen = []
    run = lambda: notes.index_available(spark, str(tmp_path / "n"), str(tmp_path / "cp"), lambda df, _: seen.extend(r.raw for r in df.collect()))
    assert run() == 1 and run() == 0
    (tmp_path / "n" / "b.md").write_text("# B")
    assert run() == 1 and sorted(seen) == ["# A", "# B"]
    files = spark.createDataFrame([("a",)], "path string").withColumn("mtime", F.current_timestamp())
    assert notes.is_stale(files, 2, None) and notes.is_stale(files, 1, None)
