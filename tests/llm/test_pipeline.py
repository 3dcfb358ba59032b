"""The pipeline's stages on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline as pipeline
from postmetrics.llm.registry import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    prepare(spark)
    rng = random.Random(11)
    docs, labels = [], []
    for k in range(120):
        docs.append((k, _words(rng, 120) + "."))
        labels.append((k, 1, 0))
    for k in range(120, 160):
        docs.append((k, "!! ".join(_words(rng, 80).upper().split()) + " ### $$$"))
        labels.append((k, 0, 0))
    docs += [(200 + k, docs[k][1]) for k in range(5)]  # exact copies
    for k in range(5):  # near copies
        w = docs[10 + k][1].split()
        w[3] = "other"
        docs.append((210 + k, " ".join(w)))
    passage = _words(rng, 70)
    docs += [(220 + k, f"{_words(rng, 60)}\n{passage}\n{_words(rng, 60)}.") for k in range(4)]
    docs += [(240 + k, f"{_words(rng, 60)}\nAll rights reserved by all.\n{_words(rng, 60)}.") for k in range(30)]
    labels += [(k, 1, 0) for k, _ in docs if k >= 200]
    rows = [(k, t, "en", f"site{k % 15}", len(t)) for k, t in docs]
    rows += [(None, docs[20][1], None, None, None), (900, None, "en", "site1", None)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), rows, passage


def test_stages_take_effect_in_order(spark, corpus):
    path, rows, passage = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    after = {}
    for name, step in pipeline.STAGES[:-1]:
        docs = pipeline.stage(step(spark, docs, path), name)
        assert docs.dtypes == [tuple(x.split()) for x in ("doc_id bigint", "text string", "lang string", "source string", "n_chars bigint")]
        after[name] = docs.collect()
    ids = {name: {r["doc_id"] for r in got} for name, got in after.items()}
    good = {r[0] for r in rows if r[0] is not None and r[0] not in range(120, 160) and r[0] != 900}
    assert not ids["quality"] & set(range(120, 160)) and ids["quality"] >= good
    texts = {r["doc_id"]: r["text"] for r in after["lines"]}
    assert not any("All rights reserved by all." in t for t in texts.values())
    assert all(texts[k] == t for k, t, *_ in rows if k in range(0, 120))
    assert all(len(r["text"]) == r["n_chars"] for r in after["lines"] if r["text"])
    gone = ids["lines"] - ids["near_duplicates"]
    assert gone == {*range(200, 205), *range(210, 215)}
    cut = {r["doc_id"]: r["text"] for r in after["repeats"]}
    assert ids["repeats"] == ids["near_duplicates"]
    assert not any(passage in cut[220 + k] for k in range(4)) and all(len(cut[220 + k]) > 400 for k in range(4))
    assert all(cut[k] == t for k, t, *_ in rows if k in range(30, 120))
    packed = pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r["doc_id"] for r in packed} == ids["repeats"]
    whole = pipeline.run(spark, path).collect()
    assert sorted((r["doc_id"] or -1, r["start"], r["length"], r["ids_crc32"]) for r in whole) == sorted(
        (r["doc_id"] or -1, r["start"], r["length"], r["ids_crc32"]) for r in packed)


def test_empty_corpus(spark, tmp_path):
    prepare(spark)
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_drop_rows_not_ids(spark):
    prepare(spark)
    rng = random.Random(3)
    first, other, third = (_words(rng, 80) for _ in range(3))
    near = [t.rsplit(" ", 1)[0] + " changed" for t in (first, other)]
    # 5 has a near copy of 1's text and a clean one, which 7 nearly repeats
    rows = [(1, first), (5, near[0]), (5, other), (7, near[1]), (9, third), (None, third), (11, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], SCHEMA)
    got = pipeline.near_duplicates(spark, docs, "").collect()
    assert {(r["doc_id"], r["text"]) for r in got} == {rows[i] for i in (0, 2, 4, 5, 6)} and len(got) == 5


def test_extra_columns_and_very_long_texts_pass_through(spark, corpus, tmp_path):
    """Columns named like the stages' own ones keep their values; one text is over 300 kB; rows repeat."""
    path, rows, _ = corpus
    rng = random.Random(5)
    long_text = "\n".join(_words(rng, 100) + "." for _ in range(600))
    few = [r for r in rows if r[0] is not None and (r[0] < 40 or r[0] in range(120, 130))] + [(950, long_text, "en", "site2", len(long_text))]
    few += [few[3], few[3]]
    extra = {"row": "string", "score": "double", "own_text": "long", "own_id": "string", "kept": "boolean", "start": "long", "id": "long"}
    values = ("r", 0.25, 7, "o", False, 3, 5)
    docs = spark.createDataFrame([(*r, *values) for r in few], SCHEMA + ", " + ", ".join(f"{k} {v}" for k, v in extra.items())).repartition(2)
    columns = docs.columns
    judged = pipeline.STAGES[0][1](spark, docs, path)
    assert judged.columns == columns and not set(range(120, 130)) & {r["doc_id"] for r in judged.select("doc_id").collect()}
    for name, step in pipeline.STAGES[1:-1]:
        docs = pipeline.stage(step(spark, docs, path), name)
        assert docs.columns == columns
    got = {r["doc_id"]: r for r in docs.collect()}
    assert all(tuple(r[k] for k in extra) == values for r in got.values())
    assert set(range(40)) | {950} <= set(got)
    assert got[950]["text"] == long_text and docs.count() == len(got)
    packed = pipeline.STAGES[-1][1](spark, docs, path).where("doc_id = 950").collect()
    assert sum(r["length"] for r in packed) == packed[0]["doc_tokens"] > 50_000
