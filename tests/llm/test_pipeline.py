import re

import corpus_pipeline
from lanewise.plans.frozen import written


def test_stages_keep_clean_documents(spark, sf_dir):
    docs = source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        if name != "sentence pieces":
            assert docs.columns == source.columns
    before = {r.doc_id: r.text for r in source.collect()}
    clean = [d for d, t in labels.items() if t == 0]
    assert sum(d in kept["toxicity"] for d in clean) >= 0.98 * len(clean)
    bad = re.compile("idiot|moron", re.I)
    assert not [d for d, t in kept["toxicity"].items() if len(bad.findall(t)) > 1]
    texts = list(kept["near duplicates"].values())
    assert len(texts) == len(set(texts)) < len(kept["toxicity"])
    assert kept["repeated passages"].keys() == kept["near duplicates"].keys()
    with_item = {d for d, t in kept["repeated passages"].items() if any(i in t for i in items)}
    assert with_item and kept["benchmark leaks"].keys() == kept["repeated passages"].keys() - with_item
    assert kept["sentence pieces"] == kept["benchmark leaks"]
    assert all(kept["toxicity"][d] == before[d] for d in kept["toxicity"])


def test_run_is_the_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns[-1] == "ids" and rows.count() > 0
