from pyspark.sql import functions as F

from quillspark.api import Engine
from quillspark.operators import render

NOTES = {
    "sleep/caffeine.md": "# Caffeine\n#sleep\nCaffeine blocks adenosine receptors and delays sleep. See [[naps]].",
    "sleep/naps.md": "# Naps\n#sleep\nNaps restore attention; sleep and memory. See [[caffeine]] and [[memory]].",
    "learn/memory.md": "# Memory\n#learning\nMemory grows with spaced retrieval practice. See [[spacing]].",
    "learn/spacing.md": "# Spacing\n#learning\nSpaced retrieval practice beats cramming for memory. See [[memory]] [[syllabus]].",
    "inbox/thought.md": "Nothing here connects, honestly.",
}


def test_folder_end_to_end(spark, tmp_path):
    for name, text in NOTES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    e = Engine(spark, str(tmp_path))
    assert e.search("caffeine adenosine").first().note_id == "sleep/caffeine"
    assert {r.note_id for r in e.search("memory", tag="learning").collect()} == {"learn/memory", "learn/spacing"}
    m = e.maintenance()
    assert [(r.src, r.target) for r in m["broken"].collect()] == [("learn/spacing", "syllabus")]
    assert [r.id for r in m["orphans"].collect()] == ["inbox/thought"]
    assert e.find_path("sleep/caffeine", "learn/spacing").first().path == ["sleep/caffeine", "sleep/naps", "learn/memory", "learn/spacing"]
    assert e.read_note("naps").first().id == "sleep/naps"
    assert {r.tag: r.n for r in e.overview()["tags"].collect()} == {"sleep": 2, "learning": 2}
    first = {r.path: r.changed for r in e.write_pages(str(tmp_path / "shared")).collect()}
    assert "INDEX.md" in first and all(first.values()) and len(first) >= 2
    assert not any(r.changed for r in e.write_pages(str(tmp_path / "shared")).collect())


def test_blocks(spark):
    notes = spark.createDataFrame([("a", "A", "t"), ("b", "B", "t"), ("c", "C", None)], "id string, title string, topic string")
    back = spark.createDataFrame([("a", "b")], "dst string, src string")
    rel = spark.createDataFrame([("a", "c", "supports")], "src string, dst string, type string")
    sim = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.5)], "src string, dst string, score double")
    block = {r.id: r.block for r in render.note_blocks(notes, back, rel, sim).collect()}
    assert block["a"].splitlines()[1:-1] == ["Topic: t", "", "## Linked from", "- [[b|B]]", "", "## Relations", "- supports [[c|C]]", "", "## Similar, not linked", "- [[c|C]]"]
    once = spark.createDataFrame([("text\n", "<!-- quillspark:start -->\nx\n<!-- quillspark:end -->")], "raw string, block string")
    twice = once.withColumn("raw", render.with_block(F.col("raw"), F.col("block"))).withColumn("again", render.with_block(F.col("raw"), F.col("block"))).first()
    assert twice.raw == twice.again == "text\n\n<!-- quillspark:start -->\nx\n<!-- quillspark:end -->\n"


def test_maintenance_page_lists_every_line(spark):
    broken = spark.createDataFrame([("b", "x"), ("a", "x"), ("a", "x")], "src string, target string")
    orphans = spark.createDataFrame([], "id string")
    alike = spark.range(250).selectExpr("format_string('n%03d', id) AS src", "'m' AS dst")
    page = render.maintenance_page(broken, orphans, alike).collect()
    lines = ["# Maintenance", "", "broken: 3 orphans: 0 duplicates: 250", "", "## Broken links", "- a → x", "- a → x", "- b → x", "", "## Likely duplicates", *(f"- n{i:03d} ~ m" for i in range(250))]
    assert [(r.path, r.text.split("\n")) for r in page] == [("maintenance.md", lines)]
