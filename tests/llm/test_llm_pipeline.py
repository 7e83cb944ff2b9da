"""The pipeline's stages on a small corpus with planted cases, and on the given tables."""

import numpy as np
import pytest
from conftest import SF

import corpus_pipeline
from wardline.llm import sentencepiece_codec


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.new_folder(spark, "stage")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(frame):
    return {r.doc_id for r in frame.select("doc_id").collect()}


def test_stages_keep_columns_and_shrink(stages):
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert after.columns == before.columns and ids(after) <= ids(before)
    assert ids(stages[-1]) == ids(stages[-2])


def test_run_gives_the_last_stage(spark, stages):
    rows = lambda f: sorted((r.doc_id, r.ids) for r in f.collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stages[-1])


def test_benchmark_texts_are_gone(spark, stages):
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda f: {r.doc_id for r in f.collect() if any(x in " ".join((r.text or "").split()) for x in items)}
    found = holds(stages[3])
    assert found and not holds(stages[4]) and ids(stages[3]) - ids(stages[4]) >= found


def test_lines_of_fifty_words_are_there_once(stages):
    lines = [x for r in stages[2].collect() for x in (r.text or "").split("\n") if len(x.split()) >= 50]
    assert len(lines) == len(set(lines))


def test_ids_spell_the_texts(stages):
    decoder = sentencepiece_codec.Decoder(sentencepiece_codec.load())
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    assert all(decoder(np.array(r.ids, dtype=np.int32)) == texts[r.doc_id] for r in stages[5].collect())
