import random

import duckdb
import pytest

import __spark_entry__
from quillspark.operators import similarity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents in five partitions: one word joins many of them; copies, no text, no id, one id twice."""
    rng = random.Random(5)
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    texts = [" ".join([*rng.choices(words, k=rng.randint(0, 12)), *["shared"] * (i % 2), f"only{i}x"]) for i in range(300)]
    texts[7], texts[11], texts[40:46] = None, "", [texts[41]] * 6
    rows = [(i, t) for i, t in enumerate(texts)] + [(20, "shared wak wbl"), (None, "wak wbl wcm")]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{d}/documents.parquet")
    return str(d)


def _most_rows(node):
    """The most rows that a node of an executed plan gave out."""
    m = node.metrics()
    inner = [getattr(node, x)() for x in ("executedPlan", "plan") if x in dir(node) and "children" in dir(getattr(node, x)())]
    kids = node.children()
    return max([m.apply("numOutputRows").value() if m.contains("numOutputRows") else 0, *map(_most_rows, [*inner, *(kids.apply(i) for i in range(kids.size()))])])


@pytest.mark.parametrize("name", ["tfidf_neighbors", "possible_duplicates"])
def test_pairs_are_no_rows(spark, folder, name):
    df = __spark_entry__.queries()[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    assert want and sorted(got) == sorted(want)
    # 150 documents share a word: 11 175 pairs; each document gives at most 6 partners in each of its blocks' tiles
    assert 0 < _most_rows(df._jdf.queryExecution().executedPlan()) <= 300 * 6 * 5


def test_postings_give_the_same_neighbours(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("cast(doc_id AS string) AS doc_id", "text")
    of_posting, of_docs = (sorted(map(tuple, x.collect())) for x in (similarity.neighbours(similarity.postings(docs)), similarity.similar_documents(docs)))
    assert of_posting and of_posting == of_docs
