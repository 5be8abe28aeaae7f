import json

import pytest

from quillspark.index import Index
from quillspark.sources.records import Framework
from quillspark.tools import Tools
from quillspark.workspace import Refused, Workspace

FRAMEWORK = """
id = "fw"
version = 2
context_fields = ["species"]
context_match = ["species"]
[[scales]]
id = "gene"
[[scales]]
id = "cell"
[[scales]]
id = "organ"
[[relations]]
id = "activates"
kind = "causal"
sign = 1
[[relations]]
id = "inhibits"
kind = "causal"
sign = -1
[[relations]]
id = "linked"
kind = "associative"
sign = 0
[[evidence]]
id = "trial"
weight = 0.9
supports_causal = true
[[evidence]]
id = "observed"
weight = 0.5
"""
NOTES = {
    "p/one.md": "---\ndoi: 10.1/a\n---\nGene GA drives growth of cells in mice.\n\nMore text.",
    "p/two.md": "Growth of cells drives scarring of organs.",
    "p/three.md": "Losing GA goes with scarring of organs in patients.",
    "p/four.md": "GA raised growth of cells again.",
    "p/five.md": "GA had no effect on growth of cells in rats.",
}


def claim(quote, s, predicate, o, evidence="trial", kind="causal", negated=False, down=False):
    scales = {"GA": "gene", "growth": "cell", "scarring": "organ"}
    side = lambda e, d: {"entity": e, "property": "level", "direction": d, "activity_effect": "unknown", "effect_basis": "stated", "scales": [scales[e]]}
    return {"quote": quote, "claim_type": kind, "subject": side(s, "decrease" if down else "increase"), "predicate": predicate, "object": side(o, "increase"), "negated": negated, "context": {"species": "mouse"}, "evidence": evidence, "confidence": 0.9}


ANSWERS = {
    "p/one": [claim("gene GA drives  growth of cells", "GA", "activates", "growth"), claim("words that are nowhere to be found", "GA", "activates", "scarring")],
    "p/two": [claim("Growth of cells drives scarring", "growth", "activates", "scarring")],
    "p/three": [claim("Losing GA goes with scarring", "GA", "linked", "scarring", "observed", "association", down=True)],
    "p/four": [claim("GA raised growth", "GA", "activates", "growth")],
    "p/five": [claim("GA had no effect on growth", "GA", "activates", "growth", negated=True)],
}


def _provider(answers):
    # a closure travels to the executors by value; they don't know this module
    def run(prompt):
        note = prompt.split("Note: ")[1].split("\n")[0]
        return json.dumps({"study_label": note, "claims": answers[note]})

    return run


provider = _provider(ANSWERS)


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("papers")
    for name, text in NOTES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    index = Index(spark, str(root))
    index.build()
    w = Workspace(index, Framework.parse(FRAMEWORK))
    w.sync()
    report = w.extract(provider)
    assert report == {"notes": 5, "claims": 5, "not_found": 1, "failed": {}}
    return w


def by_note(ws):
    return {r.note: r for r in ws.table("claims").where("status <> 'superseded'").collect()}


def test_extract_check_read(ws):
    assert ws.pending().count() == 0
    one = by_note(ws)["p/one"]
    assert (one.study, one.line, one.match) == ("doi:10.1/a", 4, "exact")
    kinds = {r.note: (r.kind, r.sign) for r in ws.links().collect()}
    assert kinds["p/one"] == ("causal", 1) and kinds["p/three"] == ("associative", -1) and kinds["p/five"][0] == "null"
    assert {r.entity: r.level for r in ws.levels(ws.links()).collect()} == {"GA": 0, "growth": 1, "scarring": 2}
    ws.check()
    cases = {r.type: r for r in ws.table("cases").collect()}
    assert cases["potential_tension"].entities == ["GA", "growth", "scarring"] and set(cases) == {"potential_tension", "conflicting_result", "triangulation", "missing_bridge"}
    assert ws.check() == {"unchanged": 4}
    t = Tools(ws.index, ws, proposals=True)
    assert {r["note"] for r in t.call("find_claims", {"entity": "ga"})} == {"p/one", "p/three", "p/four", "p/five"}
    got = t.call("get_claim", {"claim_id": one.id})
    assert got["read_as"][0]["kind"] == "causal" and {r["relation"] for r in got["related"]} == {"same direction", "no effect reported"} and any("drives growth" in x["text"] for x in got["excerpt"])
    made = t.call("propose_case", {"title": "Found", "claim_ids": [one.id], "reasoning": "r", "explanations": "e", "evidence_request": "q"})["case"]
    assert t.call("get_case", {"case_id": made})["inputs"] == [one.id]
    with pytest.raises(ValueError):
        t.call("propose_case", {"title": "Found", "claim_ids": ["c-0000000000"], "reasoning": "r", "explanations": "e", "evidence_request": "q"})
    assert t.call("research_overview", {})["claims"] == [{"status": "proposed", "n": 5}]


def test_questions_and_pages(ws):
    q = ws.ask("Why scars?", "scarring", "GA")
    assert q == ws.ask("Why scars?", "scarring", "GA") and ws.table("questions").count() == 1
    read = ws.readings("scarring").collect()
    assert read[0].path[0] == "GA" and {tuple(r.path) for r in read} == {("GA", "scarring"), ("GA", "growth", "scarring")}
    assert {s for r in read for s in r.statuses} <= {"Supported", "Assumed", "Challenged"}
    told = [r.observation for r in ws.narrate(q).orderBy("n").collect()]
    assert told == ["Reduce GA and measure scarring", "Block growth, then change GA and measure scarring"]
    gap = ws.readings("elsewhere", "GA").first()
    assert gap.path[-2:] == ["scarring", "elsewhere"] and gap.statuses[-1] == "Missing"
    assert Tools(ws.index, ws).call("compose_context", {"question_id": q})["claim"]
    touched = ws.write_pages()
    assert {"framework-map.md", "review-queue.md", "index.md", "entities/ga.md"} <= set(touched) and ws.write_pages() == []
    views = ws.index.root + "/_research/views/"
    assert "## 1. gene\n- GA · linked to growth, scarring" in open(views + "framework-map.md").read()
    assert "3 claims, 3 independent" in open(views + "entities/ga.md").read()


def test_reviews_and_changes(ws):
    root = ws.index.root
    one = by_note(ws)["p/one"]
    tension = ws.table("cases").where("type = 'potential_tension'").first()
    assert ws.review("accept", [tension.id, "map:GA|level"], note="p/two", reason="read") == ["p/two" and by_note(ws)["p/two"].id, "map:GA|level", tension.id]
    assert ws.extract(provider, force=True, notes=["p/two"])["claims"] == 1 and by_note(ws)["p/two"].status == "accepted"
    for action, ids, sets in (("revise", ["map:GA|level"], ("scales=nowhere",)), ("accept", ["c-none"], ()), ("revise", [tension.id], ()), ("forget", [], ()), ("revise", [one.id], ("subject.colour=red",))):
        with pytest.raises(Refused):
            ws.review(action, ids, sets=sets)
    loose = by_note(ws)["p/three"]
    new = ws.review("revise", [loose.id], sets=("subject.effect_basis=inferred", "confidence=0.4"))[0]
    made = ws.table("claims").where(f"id = '{new}'").first()
    assert (made.supersedes, made.status, made.s_effect_basis, made.confidence) == (loose.id, "accepted", "inferred", 0.4)
    assert ws.table("cases").where(f"id = '{tension.id}'").first().status == "stale"
    assert {r.action for r in ws.table("reviews").collect()} == {"accept", "revise"}
    import os

    os.rename(f"{root}/p/one.md", f"{root}/p/uno.md")
    os.remove(f"{root}/p/four.md")
    with open(f"{root}/p/five.md", "w") as f:
        f.write("GA did something else.")
    ws.index.build()
    report = ws.sync()
    assert report["renamed"] == [["p/one", "p/uno"]] and report["changed"] == {"stale": 1, "source_missing": 1}
    assert by_note(ws)["p/uno"].status == "proposed" and by_note(ws)["p/four"].status == "source_missing"
    assert ws.impact().count() == 0 and ws.queue()["claims"].count() >= 1
