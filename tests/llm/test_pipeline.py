"""The stages on small documents, and on an empty table."""

import random

from tests.llm.test_operators import prose

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C

    r = random.Random(1)
    rows, labels = [], []
    for k in range(240):
        text = prose(9000 + k, 60)
        if k % 4 == 0:
            text += ". You wretch vermin dunce."
        rows.append((k, text, "en", "s", len(text)))
        labels.append((k, 1, int(k % 4 == 0)))
    item = prose(77, 40)
    near = prose(78, 300)
    rows += [
        (1000, rows[1][1], "en", "s", 1), (1001, near, "en", "s", 1), (1002, near.replace("river", "brook", 1), None, None, None), (1003, prose(79, 50) + " " + item, "en", "s", 1),
        (1004, None, None, None, None), (1005, "", "en", "s", 0), (None, prose(80, 50), "en", "s", 1), (None, None, None, None, None),
    ]
    r.shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for n, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if n < len(C.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        kept.append({x.doc_id for x in docs.select("doc_id").collect()})
    assert not any(k in kept[0] for k in range(0, 240, 4)) and {k for k in range(240) if k % 4} <= kept[0]
    assert kept[0] - kept[1] == {1000, 1005}  # the null text is the empty text of 1005; 1004 stays
    assert kept[1] - kept[2] == {1002}
    assert kept[2] - kept[3] == {1003}
    assert kept[3] == kept[4]
    whole = C.run(spark, str(tmp_path))
    assert whole.count() == docs.count() and set(whole.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as C

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
