"""What plans and tables must not grow to, whatever the input."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from spreadrank.llm import kneser_ney, sentencepiece_lattice


def test_no_plan_of_the_model_has_many_shuffles(spark, monkeypatch):
    """A plan's shuffles all have threads, code and events on the driver at once."""
    shuffles = []

    def noted(df, label, write=kneser_ney.materialize):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return write(df, label)

    monkeypatch.setattr(kneser_ney, "materialize", noted)
    docs = spark.createDataFrame([(d, "one two three four " * 3, "en") for d in range(12)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, 1, 0) for d in range(12)], "doc_id long, quality int, toxic int")
    assert kneser_ney.classify(docs, labels).count() == 12
    assert max(shuffles) <= 12


def peak_mb(batches) -> float:
    """MB that numpy and Python have at once while ``batches`` are made."""
    tracemalloc.start()
    for _ in batches:
        pass
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


class Sent:
    def __init__(self, value):
        self.value = value


def test_a_worker_of_the_lattice_stays_small():
    """A batch of texts or words is worked off in runs, however large it is."""
    none = pa.table({"key": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})
    texts = pa.record_batch([pa.array([" ab" * 1000] * 1000), pa.array(range(1000))], names=["text", "doc_id"])
    assert peak_mb(sentencepiece_lattice.numbered(Sent(sentencepiece_lattice.Frequent(none)))(iter([texts]))) < 25
    words = pa.record_batch([pa.array(sorted(np.random.default_rng(1).integers(10**14, 10**15, 10_000).astype(str))), pa.array(np.ones(10_000, np.int64))], names=["word", "n"])
    model = sentencepiece_lattice.Model([(str(k), -1.0 - k, k) for k in range(1000)], None, 0)
    assert peak_mb(sentencepiece_lattice.Pieces(model).lattice(iter([words]))) < 15


@pytest.fixture
def plans(monkeypatch):
    """The plans that the SentencePiece operator writes."""
    out = []

    def noted(df, label, write=sentencepiece_lattice.materialize):
        out.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(sentencepiece_lattice, "materialize", noted)
    return out


def passes(plans) -> int:
    return max(stage.count("MapInArrow") for plan in plans for stage in plan.split("Exchange"))


def test_no_stage_of_the_lattice_has_two_passes_in_python(spark, plans):
    """Each pass has a worker for every core, and these stay for a while."""
    model = sentencepiece_lattice.Model([("▁", -1.0, 3), ("a", -2.0, 4)], None, 0)
    docs = spark.createDataFrame([(d, "a aa " * 3) for d in range(12)], "doc_id long, text string")
    assert sentencepiece_lattice.round_trips(docs, model).filter("round_trip").count() == 12
    assert passes(plans) == 1


def test_no_stage_of_the_pipeline_encodes_with_two_passes_in_python(spark, plans):
    """The workers of the stages before are there as well."""
    pytest.importorskip("sentencepiece")
    import corpus_pipeline

    docs = spark.createDataFrame([(d, "a aa " * 3) for d in range(12)], "doc_id long, text string")
    assert dict(corpus_pipeline.STAGES)["3 SentencePiece encoding"](spark, docs, "").filter("size(ids) > 0").count() == 12
    assert passes(plans) == 1
