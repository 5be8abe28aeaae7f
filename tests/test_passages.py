from quillspark.functions.stemming import porter
from quillspark.operators.passages import locate, locate_quotes, relocate

NOTE = "---\nsource: x\n---\n# Results\nLoss of KRN1\nraises the   SIG level.\n\n## Other\nUnrelated line here."


def test_exact_over_lines_and_fuzzy():
    found = locate("krn1 raises the SIG level", NOTE)
    assert (found["line_start"], found["line_end"], found["heading"], found["match"]) == (5, 6, "Results", "exact")
    typo = locate("Loss of KRN1 raises teh SIG levl.", NOTE)
    assert typo["match"].startswith("fuzzy 0.9") and (typo["line_start"], typo["line_end"]) == (5, 6)
    assert locate("nothing like this at all", NOTE) is None and locate("Loss of KRN1 raises teh SIG levl.", NOTE, fuzzy=False) is None
    assert locate("", NOTE) is None
    assert relocate(typo | {"text": "loss of krn1"}, "new\n" + NOTE)["line_start"] == 6 and relocate(typo, NOTE.replace("KRN1", "K2")) is None


def test_frames(spark):
    df = spark.createDataFrame([(1, "unrelated LINE", NOTE), (2, None, NOTE), (3, "x", None)], "id int, quote string, note string")
    got = {r.id: r for r in locate_quotes(df).collect()}
    assert got[1].line_start == 9 and got[1].heading == "Other" and got[2].match is None and got[3].match is None


def test_porter():
    words = "caresses ponies ties cats agreed plastered motoring sing conflated hopping falling filing happy sky relational conditional rational electrical hopeful adjustment adoption controll rate"
    stems = "caress poni ti cat agre plaster motor sing conflat hop fall file happi sky relat condit ration electr hope adjust adopt control rate"
    assert [porter(w) for w in words.split()] == stems.split()
