"""Resumable labelling stream: each post is labelled exactly once across runs."""

from postmetrics.operators import labels as lb
from postmetrics.streaming.labelling import label_stream


def test_label_stream_resumes(spark, tmp_path):
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    docs = spark.createDataFrame([(i, f"text {i} was that") for i in range(40)], "doc_id long, text string")
    docs.where("doc_id < 20").repartition(4).write.mode("append").parquet(src)
    label_stream(spark, src, "doc_id long, text string", out, "doc_id", "text", checkpoint=ckpt,
                 files_per_trigger=2).awaitTermination()
    assert spark.read.parquet(out).count() == 20
    docs.where("doc_id >= 20").repartition(3).write.mode("append").parquet(src)
    label_stream(spark, src, "doc_id long, text string", out, "doc_id", "text", checkpoint=ckpt).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 40 and got.select("doc_id").distinct().count() == 40
    assert set(got.columns) == {"doc_id", *lb.LABEL_FIELDS}
