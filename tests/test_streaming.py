"""The stream gives what the batch gives, file after file."""

from __future__ import annotations

from glossa.operators.corpus import silver
from glossa.streaming import annotate

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "Ana reads. A dog ran!", "en", "s", 21), (2, None, "de", "s", 0), (3, "Ein Hund. Ana reads", None, None, 19)]
    folder = str(tmp_path / "in")
    docs = spark.createDataFrame(rows, SCHEMA)
    for k in range(3):
        docs.where(f"doc_id = {k + 1}").coalesce(1).write.mode("append").parquet(folder)
    stream = annotate.documents(spark, folder)
    tokens = annotate.annotated(stream).writeStream.format("memory").queryName("tokens_seen").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start()
    counts = annotate.running_vocabulary(stream).writeStream.format("memory").queryName("forms_seen").outputMode("complete").option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start()
    tokens.awaitTermination(120)
    counts.awaitTermination(120)
    want = silver(docs)
    assert sorted(map(str, spark.table("tokens_seen").collect())) == sorted(map(str, want.collect()))
    assert {r.form: r["count"] for r in spark.table("forms_seen").collect()} == {r.form: r["count"] for r in want.groupBy("form").count().collect()}
