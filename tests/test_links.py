import duckdb
import pytest

import __spark_entry__


@pytest.mark.parametrize("name", ["outlinks_of_note", "resolved_links"])
def test_notes_are_parsed_once(spark, name, tmp_path):
    """Names and links are kept: what joins them reads no text again."""
    text = "Some words.\n\nMore [words] here."
    spark.createDataFrame([(i, text, "en", f"src{i % 3}") for i in range(40)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = __spark_entry__.queries()[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "parquet" not in plan
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())
