"""Verdicts and ablations from a stored ledger."""

from threadlens.llm import queries, quality_rules


def test_verdicts_and_ablation_read_no_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {(r.policy, r.rule): tuple(r)[2:] for r in queries.queries()["op2_rule_ablation"](spark, sf).collect()}
    bits = [r.fail_bits for r in quality_rules.op2(docs).collect()]
    names = [name for name, _ in quality_rules.RULES]
    want = {}
    for policy, mask in quality_rules.POLICIES.items():
        for b, name in enumerate(names):
            if mask >> b & 1:
                failed = [x & mask for x in bits]
                want[policy, name] = (sum(x >> b & 1 for x in failed), sum(x == 1 << b for x in failed), sum(not x & ~(1 << b) for x in failed))
    assert found == want and len(found) == 12
    for df in (quality_rules.op2(docs), quality_rules.op2_ablation(docs)):
        files = df.inputFiles()
        assert files and all("rule-ledger" in f for f in files)
