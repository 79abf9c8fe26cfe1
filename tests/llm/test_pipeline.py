from __future__ import annotations

import corpus_pipeline
from rowgate.llm.decontaminate import find_matches
from rowgate.llm.pii import base_spans
from rowgate.llm.simhash import near_duplicates
from rowgate.session import stage

SF_DIR = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    kept = {"documents": docs}
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF_DIR), name)
        kept[name] = docs
        if name != "packing":
            assert docs.schema == kept["documents"].schema
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in kept.items()}

    gone = ids["documents"] - ids["toxicity"]
    assert gone and all(labels.get(i, 1) for i in gone)

    groups = near_duplicates(kept["toxicity"]).select("doc_id", "component_id").collect()
    assert ids["simhash_near_dedup"] == {r.component_id for r in groups}
    assert kept["simhash_near_dedup"].count() == len(ids["simhash_near_dedup"])

    before = {r.doc_id: r for r in find_matches(kept["simhash_near_dedup"], benchmark).collect()}
    clean = {i for i, r in before.items() if not r.spans}
    assert clean <= ids["decontamination"] and len(clean) < len(before)
    assert find_matches(kept["decontamination"], benchmark).filter("size(spans) > 0").count() == 0
    was = {r.doc_id: r for r in kept["simhash_near_dedup"].collect()}
    now = {r.doc_id: r for r in kept["decontamination"].collect()}
    assert all(now[i] == was[i] for i in clean)
    assert all(now[i].n_chars == len(now[i].text) for i in set(now) - clean)

    assert ids["pii"] == ids["decontamination"]
    out = {r.doc_id: r for r in kept["pii"].collect()}
    found = {i for i, r in now.items() if base_spans(r.text)}
    assert found and all(out[i].text != now[i].text for i in found)
    assert all(not base_spans(r.text) for r in out.values())
    assert all(out[i] == now[i] for i in out if not any(c in "0123456789@" for c in now[i].text))

    assert ids["packing"] == ids["pii"]


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["bin_id", "doc_id", "start", "length"]
    first = sorted(map(tuple, rows.collect()))
    assert first and first == sorted(map(tuple, corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()))
