from pyspark.sql import functions as F

from quillspark.sources import markdown as M

NOTES = {
    "learn/recall.md": '---\ntags: [Memory, "#study"]\naliases: testing effect\n---\n# Active recall\n\nSee [[spacing]] and [[sleep/naps#When|naps]] ![[spacing]].\n#habit text\n\n```\n# not a heading [[nope]]\n```\n## Why\nIt works `[[nope]]`.\n## How\nTry.',
    "learn/spacing.md": "---\ntitle: Spaced practice\ntag: memory\n---\nPre.\n\n[up](../sleep/naps.md) [web](https://x.org/a) [pic](a.png) [[Testing Effect]] [[gone]]",
    "sleep/naps.md": "# Naps\n<!-- quillspark:start -->\n[[recall]]\n<!-- quillspark:end -->\n#sleep",
    "out/page.md": "made",
    "node_modules/x.md": "skip",
}


def _notes(spark, tmp_path, **kw):
    for name, text in NOTES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.md").write_bytes(b"caf\xe9 \xff")
    return M.read_notes(spark, str(tmp_path), **kw)


def test_notes(spark, tmp_path):
    rows = {r.id: r for r in _notes(spark, tmp_path, exclude=("bad.md",), generated=("out",)).collect()}
    assert set(rows) == {"learn/recall", "learn/spacing", "sleep/naps", "out/page"}
    r = rows["learn/recall"]
    assert r.title == "Active recall" and r.tags == ["memory", "study", "habit"] and r.aliases == ["testing effect"]
    assert rows["learn/spacing"].title == "Spaced practice" and rows["learn/spacing"].tags == ["memory"]
    assert rows["sleep/naps"].body == "# Naps\n\n#sleep" and rows["out/page"].generated and not r.generated


def test_bad_bytes_are_replaced(spark, tmp_path):
    raw = {r.id: r.raw for r in _notes(spark, tmp_path).select("id", "raw").collect()}["bad"]
    assert raw.startswith("caf") and "�" in raw


def test_links_are_resolved(spark, tmp_path):
    got = {(r.src, r.target, r.anchor, r.kind, r.dst) for r in M.resolve_links(_notes(spark, tmp_path)).collect()}
    assert got == {
        ("learn/recall", "spacing", "", "wiki", "learn/spacing"),
        ("learn/recall", "sleep/naps", "When", "wiki", "sleep/naps"),
        ("learn/recall", "spacing", "", "embed", "learn/spacing"),
        ("learn/spacing", "../sleep/naps.md", "", "markdown", "sleep/naps"),
        ("learn/spacing", "Testing Effect", "", "wiki", "learn/recall"),
        ("learn/spacing", "gone", "", "wiki", None),
    }


def test_sections_ignore_fences(spark, tmp_path):
    rows = M.sections(_notes(spark, tmp_path)).where(F.col("note_id") == "learn/recall").orderBy("pos").collect()
    assert [(r.level, r.heading, r.anchor) for r in rows] == [(1, "Active recall", "active-recall"), (2, "Why", "why"), (2, "How", "how")]
    assert "# not a heading" in rows[0].body
