import io
import json

import pytest

from quillspark import agent
from quillspark.cli import main
from quillspark.index import Index
from quillspark.server import handle, serve
from quillspark.tools import ToolError, Tools

NOTES = {
    "sleep/caffeine.md": "# Caffeine\n#sleep\nCaffeine blocks adenosine receptors and delays sleep. See [[naps]].",
    "sleep/naps.md": "---\naliases: [Siesta]\n---\n# Naps\n#sleep\nNaps restore attention; sleep and memory. See [[caffeine]] and [[memory]].",
    "learn/memory.md": "# Memory\n#learning\nMemory grows with spaced retrieval practice. See [[spacing]].\n\n## Limits\nInterference.",
    "learn/spacing.md": "# Spacing\n#learning\nSpaced retrieval practice beats cramming for memory. See [[memory]] [[syllabus]].",
    "inbox/thought.md": "Nothing here connects, honestly.",
    "_drafts/plan.md": "# Plan\nAn unusual zeppelin.",
    "node_modules/x.md": "never",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("vault")
    for name, text in NOTES.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    return folder


@pytest.fixture(scope="module")
def index(spark, root):
    found = Index(spark, str(root))
    stats = found.build()
    assert (stats["notes"], stats["generated"], stats["broken"]) == (6, 0, 1)
    return found


def test_tools(index):
    t = Tools(index, writes=True)
    assert [r["id"] for r in t.call("search", {"query": "zeppelin"})] == ["_drafts/plan"]
    hit = t.call("search", {"query": "caffeine adenosine"})[0]
    assert hit["id"] == "sleep/caffeine" and "**Caffeine**" in hit["snippet"]
    assert t.call("read_note", {"note_id": "siesta"})["id"] == "sleep/naps"
    assert t.call("read_note", {"note_id": "memory", "section": "limits"})["sections"][0]["body"] == "Interference."
    with pytest.raises(ToolError, match="did you mean .*learn/"):
        t.call("read_note", {"note_id": "retrieval practice"})
    assert t.call("note_links", {"note_id": "naps"})["backlinks"] == ["sleep/caffeine"]
    path = t.call("find_path", {"from_note": "caffeine", "to_note": "spacing"})
    assert path["path"] == ["sleep/caffeine", "sleep/naps", "learn/memory", "learn/spacing"] and path["reasons"][1] == "links to"
    report = t.call("maintenance_report", {})
    assert report["orphans"] == ["_drafts/plan", "inbox/thought"] and report["broken"] == [{"src": "learn/spacing", "target": "syllabus"}]
    over = t.call("overview", {})
    topic = next(n["topic"] for n in t.call("list_notes", {}) if n["id"] == "learn/memory")
    assert {x["topic"] for x in over["topics"]} and topic and "learn/spacing" in [n["id"] for n in t.call("topic", {"topic_id": topic})["notes"]]
    assert t.call("add_relation", {"src": "caffeine", "dst": "naps", "type": "contradicts", "reason": "r"}) == {"relation": "sleep/caffeine contradicts sleep/naps"}
    assert [r["type"] for r in t.call("note_links", {"note_id": "naps"})["relations"]] == ["contradicts"]
    for name, args in (("add_relation", {"src": "naps", "dst": "naps", "type": "supports", "reason": ""}), ("search", {}), ("find_claims", {}), ("write_note", {"kind": "answers", "title": "t", "body": "b", "sources": []})):
        with pytest.raises(ToolError):
            t.call(name, args)
    assert "write_note" not in {d["name"] for d in Tools(index).definitions()}


def test_agent_loop(index):
    seen = []

    def model(messages, tools):
        seen.append((messages[-1], len(tools)))
        turn = len(seen)
        return {"text": f"turn {turn}", "calls": [{"id": "1", "name": "read_note" if turn > 1 else "none", "args": {"note_id": "naps"}}]}

    assert agent.run(model, Tools(index), "go", 3) == "turn 3"
    assert seen[1][0]["is_error"] and not seen[2][0]["is_error"] and seen[2][1] == 0 and "Naps" in seen[2][0]["content"]


def test_server(index):
    t = Tools(index)
    assert "search" in {x["name"] for x in handle(t, {"jsonrpc": "2.0", "id": 1, "method": "tools/list"})["result"]["tools"]}
    out = io.StringIO()
    calls = [{"id": 2, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "caffeine"}}}, {"method": "notifications/initialized"}, {"id": 3, "method": "none"}, {"id": 4, "method": "resources/read", "params": {"uri": "notes://index"}}]
    serve(t, io.StringIO("\n".join(json.dumps(c) for c in calls) + "\nno json\n"), out)
    a, b, c, d = map(json.loads, out.getvalue().splitlines())
    assert "sleep/caffeine" in a["result"]["content"][0]["text"] and b["error"]["code"] == -32601 and "# Index" in c["result"]["contents"][0]["text"] and d["error"]["code"] == -32700


def test_passes_keep_failures_apart(index):
    def provider(prompt):
        if "Nothing here" in prompt:
            raise RuntimeError("no")
        if prompt.startswith("How does"):
            return json.dumps({"relations": [{"candidate": "learn/memory", "type": "extends", "reason": "r", "confidence": 0.9}, {"candidate": "gone", "type": "extends", "reason": "r", "confidence": 0.9}]})
        return json.dumps({"summary": prompt[:9], "key_claims": ["k"], "open_questions": [], "label": "Named", "synopsis": "s"})

    first = agent.enrich(provider, index)
    assert first["done"] == 5 and list(first["failed"]) == ["inbox/thought"]
    assert agent.enrich(provider, index)["done"] == 0  # the rest is up to date; the failed one is tried again
    assert {r.src for r in index.table("relations").where("type = 'extends'").collect()} <= {r.src for r in index.table("similar").collect()}
    agent.link(provider, index)
    assert {r.dst for r in index.table("relations").where("source = 'link-pass'").collect()} <= {"learn/memory"}
    agent.name_topics(provider, index)
    assert {r.label for r in index.topics().collect()} == {"Named"}


def test_command_line_and_rebuild(spark, index, root, capsys):
    def run(*args):
        code = main(["-C", str(root), "--json", *args])
        out = capsys.readouterr().out
        return code, json.loads(out) if out else None

    assert run("init")[0] == 0 and (root / "quillspark.toml").exists() and (root / "_notes" / "INDEX.md").exists() and ".quillspark/" in (root / ".gitignore").read_text()
    before = {r.topic for r in index.table("topics").collect()}
    (root / "sleep/naps.md").rename(root / "sleep/rest.md")
    (root / "new.md").write_text("# Zettelkasten\nAtomic notes.\n")
    assert run("search", "zettelkasten")[1][0]["id"] == "new"  # indexed again by itself
    assert {(r.src, r.dst) for r in index.table("relations").where("type = 'contradicts'").collect()} == {("sleep/caffeine", "sleep/rest")}
    assert before & {r.topic for r in index.table("topics").collect()}
    assert run("show", "no such note xyz")[0] == 1
    assert run("links", "memory")[1]["links"]
    written = Tools(index, writes=True).call("write_note", {"kind": "answers", "title": "Why: sleep?", "body": "Because quokka.", "sources": ["caffeine"]})["path"]
    assert written.endswith("-why-sleep.md") and run("search", "quokka")[1][0]["id"] == written.removesuffix(".md")
