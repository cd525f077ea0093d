"""The pipeline's stages over the smallest tables, each against what its operator says of all its input."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    import corpus_pipeline as p
    from spreadrank.llm import decontaminate, jaccard_join, kneser_ney

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    kept, columns = [docs], docs.columns
    for k, (name, stage) in enumerate(p.STAGES):
        stage(spark, kept[-1], SF).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
        assert k == 4 or kept[-1].columns == columns, name
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert ids[1] == {r.doc_id for r in kneser_ney.classify(docs, labels).filter("kept").collect()}
    assert ids[2] == ids[1]
    assert ids[3] == {r.doc_id for r in jaccard_join.jaccard_classes(kept[2]).filter("doc_id = component_id").collect()}
    assert ids[4] == {r.doc_id for r in decontaminate.find_leaks(kept[3], bench).filter("size(items) = 0").collect()}
    assert ids[5] == ids[4] and ids[5] and len(ids[5]) < len(ids[0])
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=p.PIECES)
    text = {r.doc_id: r.text for r in kept[4].collect()}
    assert all(r.ids == sp.encode(text[r.doc_id]) for r in kept[5].collect())
    assert {r.doc_id for r in p.run(spark, SF).collect()} == ids[5]
