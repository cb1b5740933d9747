"""The pipeline's result as a whole."""

import pytest

import corpus_pipeline
from driftmap.llm import bpe, mixing, queries


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    """Documents of very unequal length in several files, so that files are not read in the order of their names."""
    folder = tmp_path_factory.mktemp("sf")
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(4000 if k % 7 == 0 else 60))
    rows = [(k, text(k), "en", f"s{k % 3}", len(text(k))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    docs.write.parquet(f"{folder}/documents.parquet")
    return rows, corpus_pipeline.run(spark, str(folder))


def test_rows_come_in_the_order_of_the_mix(spark, result):
    rows, df = result
    got = df.collect()
    assert [r.position for r in got] == list(range(400))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {r["__id"]: r.position for r in mixing.scheduled(docs).collect()}
    assert {r.doc_id: r.position for r in got} == want


def test_tokens_decode_to_the_documents(spark, result):
    rows, df = result
    back = bpe.decoded(df, queries.tokenizer("byte_bpe_50k.json")).collect()
    assert {r.doc_id: r.decoded for r in back} == {r[0]: r[1] for r in rows}
