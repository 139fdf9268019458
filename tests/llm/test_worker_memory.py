"""What a Python worker holds stays small: it lives on through all stages of the pipeline and keeps what it took."""

import tracemalloc

import pyarrow as pa
import pytest

import corpus_pipeline
from hubbub.llm import line_dedup, packing, quality, setsketch, tokens
from hubbub.llm.common import few_at_once

SETTINGS = quality.Settings()


def bitmaps(docs):
    return docs.sparkSession.createDataFrame([], "doc_id long, bitmap binary")


JOBS = {
    "context_sums": lambda docs: quality.context_sums(docs, SETTINGS),
    "score": lambda docs: quality.score(docs.select("text"), quality.Model(SETTINGS, quality.np.zeros((SETTINGS.buckets, 64)))),
    "sketches": lambda docs: setsketch.sketches(docs, setsketch.Plan()),
    "apply_bitmaps": lambda docs: line_dedup.apply_bitmaps(docs.select("text", "doc_id"), bitmaps(docs)),
}


@pytest.mark.parametrize("job", JOBS)
def test_texts_of_a_batch_are_not_held_at_once(spark, monkeypatch, job):
    class Caught(Exception):
        pass

    docs, found = spark.createDataFrame([(1, "a")], "doc_id long, text string"), []

    def catch(self, run, schema):
        found.append(run)
        raise Caught

    with monkeypatch.context() as patch:
        patch.setattr(type(docs), "mapInArrow", catch)
        with pytest.raises(Caught):
            JOBS[job](docs)
    n = 8000
    ids, texts = pa.array(range(n), pa.int64()), pa.array([" " * 4096] * n)
    batch = pa.RecordBatch.from_pydict({"doc_id": ids, "text": texts, "text_hash": ids, "bitmap": pa.nulls(n, pa.binary())})
    batch = batch.select(["text"]) if job == "score" else batch
    run, rows = found[0], 0
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for out in run(iter([batch])):
        rows += out.num_rows
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert rows == (0 if job == "context_sums" else n)
    assert peak < 20e6  # all texts are 33 MB


def test_few_at_once_keeps_all_rows_in_order():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (0, 1, 4, 9)]
    out = list(few_at_once(iter(batches), rows=4))
    assert [b.num_rows for b in out] == [1, 4, 4, 4, 1]
    assert [x for b in out for x in b["x"].to_pylist()] == [0, *range(4), *range(9)]


def test_pipeline_remembers_few_words(spark, monkeypatch):
    """250,000 different words, packed in this process: not all of them stay."""
    found = []
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with monkeypatch.context() as patch:
        patch.setattr(type(docs), "mapInArrow", lambda self, run, schema: found.append(run))
        corpus_pipeline.pack_sequences(spark, docs, "")
    monkeypatch.setattr(tokens, "_encoders", {})
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [" ".join(f"w{i}" for i in range(250_000))]})
    assert sum(sum(out["length"].to_pylist()) for out in found[0](iter([batch]))) > 250_000
    (encoder,) = tokens._encoders.values()
    assert max(map(len, (encoder.first, encoder.later, encoder.pieces))) <= 200_000
