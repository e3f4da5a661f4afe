"""What operators leave to the driver."""

from pyspark.sql import functions as F

from weftlake.llm import lines


def test_line_dedup_broadcasts_nothing(spark, monkeypatch):
    """Small work tables are merged as large ones are: by its files a table can look small that fills the driver as a hash table."""
    plans, write = [], lines.table
    monkeypatch.setattr(lines, "table", lambda df, tag: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, tag))[1])
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.expr("concat_ws('\n', transform(sequence(0, 9), k -> concat('line ', id div 3 + k)))").alias("text"))
    out = lines.dedup_lines(docs)
    assert {r["n_removed_lines"] for r in out.collect()} == {0, 9, 10}
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
