"""Quality rules as a bitmask ledger, in DataFrame functions only.

``stored`` evaluates every rule once a document and writes the measurements and
one bit for each failed rule, with the document's address and the version of the
rule set.  A policy is a mask of bits with a version: applying one, changing one
or asking what each rule costs reads the stored integers and never a text again.
``carried`` is a ledger whose rows also keep the documents, for a stage that
passes texts on; policies filter its stored bits in the same way.

Rows: one ledger row for each input row, repeated rows included.  Null and
empty texts have no words, so they fail ``few_words``.  A null ``doc_id`` stays
null.  An empty table gives an empty ledger.  Input columns other than
``doc_id`` and ``text`` are dropped by ``ledger`` and kept by ``carried`` and
``passing``, whatever their names.  Three-word windows are compared by their
64-bit xxHash inside one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

SPACES = " \t\n\x0b\f\r"
SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]

#: (name, condition under which a document fails); the place in this list is the bit
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "4 * n_symbols > n_words"),
    ("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("upper_case", "2 * n_upper > word_chars"),
]
BASE_MASK = 0b11
RULE_SET = "rules-1"  # a new version for every change to RULES or to a measurement

#: versioned policies; a document is kept if it fails none of the policy's rules
POLICIES: dict[str, int] = {"base": BASE_MASK, "2024-1": 0b001111, "2024-2": 0b111111}
CURRENT = "2024-2"


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one column for each of MEASURES."""
    raw = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    one = raw.withColumn("_w", F.array_remove(F.split("_t", SPLIT), "")).withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    two = one.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.translate("_t", SPACES, "")).cast("long"),
        "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_upper": (F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
        "_h": F.expr("transform(slice(_w, 1, greatest(size(_w) - 2, 0)), (w, i) -> xxhash64(w, get(_w, i + 1), get(_w, i + 2)))"),
    }).drop("_t", "_w", "_l")
    # Most documents repeat no window: one sort of primitive longs tells, and the rest is skipped.
    three = two.withColumn("_s", F.sort_array("_h")).withColumn("_any", F.exists(F.expr("transform(_s, (x, i) -> x = get(_s, i - 1))"), lambda x: x))
    four = three.withColumn("_p", F.expr("case when _any then array_sort(transform(_h, (x, i) -> struct(x as x, i as i))) end"))
    five = four.withColumn("_r", F.expr("array_sort(transform(filter(_p, (s, j) -> s.x = get(_p, j - 1).x or s.x = get(_p, j + 1).x), s -> s.i))"))
    covered = F.expr("aggregate(transform(_r, (p, j) -> least(3, coalesce(get(_r, j + 1) - p, 3))), 0L, (a, x) -> a + x)")
    done = five.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    # The generator keeps filters above it: pushed below, one would spell every measurement out again at each use.
    return done.select(*docs.columns, F.explode(F.array(F.struct(*MEASURES))).alias("_m")).select(*docs.columns, "_m.*")


def fail_bits(rules: list[tuple[str, str]] = RULES) -> Column:
    return F.expr(" | ".join(f"(case when {condition} then {1 << bit}L else 0L end)" for bit, (_, condition) in enumerate(rules)))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the text's address, the rule set's version, the measurements and ``bits``: bit b is set if rule b fails."""
    own = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("address"))
    return measured(own).withColumns({"bits": fail_bits(), "rule_set": F.lit(RULE_SET)}).select("doc_id", "address", "rule_set", *MEASURES, "bits")


def stored(docs: DataFrame) -> DataFrame:
    """The ledger as a written table; the texts are read here and not again."""
    return scratch.durable(ledger(docs), "rule-ledger")


def carried(docs: DataFrame) -> DataFrame:
    """The ledger as a written table whose rows keep their document as ``own``."""
    own = docs.select(F.struct(*docs.columns).alias("own"), F.col("text").alias("_text"))
    return scratch.durable(measured(own, "_text").withColumns({"bits": fail_bits(), "rule_set": F.lit(RULE_SET)}).drop("_text"), "rule-ledger")


def verdicts(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A ledger with ``kept`` under a policy and the policy's version."""
    return rows.withColumns({"kept": F.col("bits").bitwiseAND(F.lit(POLICIES[policy])) == 0, "policy": F.lit(policy)})


def passing(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with their own columns, by the bits of a written ledger."""
    return verdicts(carried(docs), policy).where("kept").select("own.*")


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that dropping it would keep.

    ``rows`` is a stored ledger.  It is first counted by its distinct bit patterns (at most 2 ** rules
    rows), so no rule reads the documents again.
    """
    mask = POLICIES[policy]
    patterns = rows.select(F.col("bits").bitwiseAND(F.lit(mask)).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << b).cast("long").alias("bit")) for b, (name, _) in enumerate(RULES) if mask >> b & 1]))
    each = patterns.withColumn("r", rules).select("bits", "n", "r.*")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def op2(docs: DataFrame) -> DataFrame:
    rows = verdicts(stored(docs))
    failed = F.col("bits").bitwiseAND(F.lit(BASE_MASK)) != 0
    return rows.select("doc_id", *MEASURES[:5], failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"), F.col("bits").alias("fail_bits"), "policy")


def op2_ablation(docs: DataFrame) -> DataFrame:
    """What each rule of each policy costs, all from one stored ledger."""
    rows = stored(docs)
    parts = [ablation(rows, policy).select(F.lit(policy).alias("policy"), "*") for policy in POLICIES]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every
