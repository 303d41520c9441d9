"""The pipeline against a plain re-implementation, stage by stage."""

import corpus_pipeline
from threadlens.llm import quality_rules, secrets

from . import plain


def test_run_equals_plain_stages(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    table = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.op2(table).where("kept").collect()}
    failed = {r[0] for r in plain.op2(docs) if r[-1]}
    assert not kept & failed
    rows = [d for d in docs if d[0] in kept]
    rows = [d for d, c in zip(rows, plain.op10(rows)) if c[2] == d[0]]
    bad = {r[0] for r in plain.op1(rows, items) if r[-1]}
    rows = [d for d in rows if d[0] not in bad]
    found = {r.doc_id: r.spans for r in secrets.op6(table).collect()}
    want = {}
    for doc, text in rows:
        out, at = "", 0
        for span in filter(None, found[doc].split(",")):
            _, a, b = span.split(":")
            if int(a) >= at:
                out += text[at : int(a)] + "[secret]"
            at = max(at, int(b))
        want[doc] = plain.sha(out + text[at:])
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and len(got) > 50


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).schema.simpleString() == docs.schema.simpleString()
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
