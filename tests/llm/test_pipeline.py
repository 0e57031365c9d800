"""The pipeline over the driver's smallest tables: each stage against what its operator decides."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from skyloom.llm.near_dedup import near_duplicates
from skyloom.llm.shared import read_documents, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def test_stages(spark):
    docs = read_documents(spark, SF)
    columns = docs.columns
    after = {}
    for name, stage in P.STAGES:
        docs = table(stage(spark, docs, SF), name)
        after[name] = docs
        assert name == "packing" or docs.columns == columns
    whole = read_documents(spark, SF)
    assert after["language_id"].count() >= 0.95 * whole.where("length(trim(text)) > 0").count()
    assert after["line_dedup"].where("n_chars <> length(text)").count() == 0
    assert near_duplicates(after["near_dedup"]).where("not kept").count() == 0
    kept = {r["doc_id"] for r in near_duplicates(after["line_dedup"]).where("kept").collect()}
    assert {r["doc_id"] for r in after["near_dedup"].collect()} == kept
    assert after["mixing"].join(after["near_dedup"], "doc_id", "left_anti").count() == 0
    pieces = after["packing"]
    assert pieces.select("doc_id").distinct().count() == after["mixing"].count()
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_stages_of_awkward_documents(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for _, stage in P.STAGES:
            docs = table(stage(spark, docs, SF), "stage")


def test_packing_in_the_pipeline_remembers_fewer_pieces(monkeypatch):
    """Its workers run beside what four stages have left in memory; op6's, which run alone, keep the encoder's own bound."""
    from skyloom.llm import tokens

    asked = []
    monkeypatch.setattr(P, "pack", lambda docs, path, **how: asked.append(how))
    P.pack_sequences(None, None, "")
    made = tokens.encoder(P.public_tokenizers.path("byte_bpe_50k.json"), **asked[0])
    assert made.remembered <= tokens.REMEMBERED // 4


def test_language_tasks_hold_a_bounded_slice(spark):
    """1,000 long texts in one batch: what a task makes of texts at once is bounded by their size, not by their number."""
    import tracemalloc

    import pyarrow as pa

    from skyloom.llm.langid import train
    from skyloom.llm.shared import sliced_by_size

    class Rows:
        def where(self, *_):
            return self

        select = where

        def mapInArrow(self, task, schema):
            self.task = task
            raise StopIteration

    rows = Rows()
    with pytest.raises(StopIteration):
        train(rows)
    texts = ["many words of a long text " * 150] * 1000
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * 1000)], ["text", "lang"])
    tracemalloc.start()
    out = list(rows.task(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(out[0].column(2).to_pylist()) > 3_000_000 and peak < 60_000_000
    odd = pa.RecordBatch.from_arrays([pa.array([None, "", "a" * 10, "b" * 10, "c" * 500, None, "d"])], ["text"])
    parts = [b.column(0).to_pylist() for b in sliced_by_size(iter([odd, odd.slice(0, 0), odd.slice(4)]), 0, 20)]
    assert parts == [[None, "", "a" * 10, "b" * 10], ["c" * 500], [None, "d"], ["c" * 500], [None, "d"]]
