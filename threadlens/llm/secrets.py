"""Secret scans over an incremental ledger of blobs, in DataFrame functions only.

Every version of every document is addressed by the SHA-256 of its text.  The
ledger is a folder of rows (blob, rules, found): what some rules, each named with
its version, found in a blob, also that they found nothing.  ``update`` scans
only pairs of blob and rule version that the ledger lacks, appends what it finds
and gives the whole ledger; ``by_path`` joins findings back to every row that
carries the blob.  Two runs that append the same pair do no harm: findings are
read as sets.

Null texts count as empty; equal texts share one scan and all get the same
findings; repeated rows give repeated results; a null ``doc_id`` stays null; an
empty table gives an empty result.  Other input columns are ignored by scans and
kept by ``redacted``, whatever their names.  Offsets count code points, the end
is exclusive.  Work is linear in a text and in its findings: places are running
sums over the matches, and a text is cut once into pieces from which what stays
is put together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0  # characters that the group must have
    version: str = "1"

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


RULES: tuple[Rule, ...] = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
BASE = 3

FINDING = "struct<start: bigint, rule: string, end: bigint>"
LEDGER = f"blob string, rules array<string>, found array<{FINDING}>"


def _matches(text: Column, rule: Rule) -> Column:
    """array<struct<gap, size, judged>>: characters before each match, of it and of its judged group; empty where nothing matches."""
    pattern = F.lit(rule.pattern)
    pieces, whole = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    zipped = F.arrays_zip(F.transform(F.slice(pieces, 1, F.size(whole)), F.length).alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(judged, F.length).alias("judged"))
    return F.when(text.rlike(rule.pattern), zipped).otherwise(F.array().cast("array<struct<gap: int, size: int, judged: int>>"))


def blobs(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys``, the text and the blob's address."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*keys, text.alias("text"), F.sha2(text, 256).alias("blob"))


def scan(docs: DataFrame, known: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows for the pairs of blob and rule version that ``known`` lacks."""
    names = F.array(*[F.lit(r.name) for r in rules])
    once = blobs(docs).groupBy("blob").agg(F.first("text").alias("text"))
    if known is not None:
        done = known.where(F.arrays_overlap("rules", names)).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
        once = once.join(done, "blob", "left").withColumn("rules", F.array_except(names, F.coalesce("done", F.array().cast("array<string>")))).where(F.size("rules") > 0)
    else:
        once = once.withColumn("rules", names)
    # a rule that is not asked for reads an empty text
    found = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(r.name).alias("rule"), F.lit(r.least).alias("least"), _matches(F.when(F.array_contains("rules", r.name), F.col("text")).otherwise(""), r).alias("m")) for k, r in enumerate(rules)])
    scanned = scratch.durable(once.select("blob", "rules", F.filter(found, lambda x: F.size(x["m"]) > 0).alias("f")), "secret-matches")
    each = scanned.select("blob", F.inline("f")).select("blob", "rank", "rule", "least", F.posexplode("m").alias("at", "m"))
    so_far = Window.partitionBy("blob", "rank").orderBy("at")
    placed = each.withColumn("end", F.sum(F.col("m.gap").cast("long") + F.col("m.size")).over(so_far)).where(F.col("m.judged") >= F.col("least"))
    lists = placed.groupBy("blob").agg(F.collect_list(F.struct((F.col("end") - F.col("m.size")).alias("start"), "rule", "end")).alias("found"))
    quiet = scanned.where(F.size("f") == 0).select("blob", "rules", F.array().cast(f"array<{FINDING}>").alias("found"))
    loud = scanned.where(F.size("f") > 0).select("blob", "rules").join(lists, "blob", "left")
    return quiet.unionByName(loud.withColumn("found", F.coalesce("found", F.array().cast(f"array<{FINDING}>"))))


def update(spark: SparkSession, docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at ``path`` lacks, append it there, and return the whole ledger."""
    jvm = spark._jvm.org.apache.hadoop.fs
    where = jvm.Path(path)
    known = spark.read.schema(LEDGER).parquet(path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None
    scan(docs, known, rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def _hits(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, found) of the blobs with findings of ``rules``, each once, by start and the rules' order."""
    rank = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.name, k)])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    ranked = F.transform("found", lambda x: F.struct(x["start"].alias("start"), F.element_at(rank, x["rule"]).alias("rank"), x["end"].alias("end")))
    own = ledger.where(F.size("found") > 0).select("blob", F.filter(ranked, lambda x: x["rank"].isNotNull()).alias("found")).where(F.size("found") > 0)
    every = own.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))
    return every.withColumn("found", F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), F.get(kinds, x["rank"]).alias("kind"))))


PLACED = "array<struct<start: bigint, rank: int, end: bigint, kind: string>>"


def by_path(docs: DataFrame, ledger: DataFrame, *keys: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keys`` of every row with the findings of its blob as ``found``; an empty list where there are none."""
    own = docs.select(F.struct(*keys).alias("_own"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    rows = own.join(_hits(ledger, rules), "blob", "left")
    return rows.select("_own.*", F.coalesce("found", F.array().cast(PLACED)).alias("found"))


def spelled(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


PIECE = 4096


def redacted(docs: DataFrame, ledger: DataFrame, mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; spans that overlap become one mark."""
    each = _hits(ledger, rules).select("blob", F.inline("found"))
    order = Window.partitionBy("blob").orderBy("start", "end", "rank")
    # a span that starts before all earlier ones have ended goes on with them
    opens = each.withColumn("before", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("part", F.sum(F.when(F.col("before") > F.col("start"), 0).otherwise(1)).over(order))
    spans = opens.groupBy("blob", "part").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    lists = spans.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))
    own = docs.select(F.struct(*docs.columns).alias("own"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    joined = own.join(lists, "blob", "left").withColumn("text", F.col("own.text"))
    # whole texts are cut once into pieces; a stretch is looked for in the pieces that hold it only
    cut = joined.withColumn("pieces", F.when(F.col("spans").isNotNull(), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))

    def stretch(a: Column, b: Column) -> Column:
        first, last = F.floor(a / PIECE), F.floor((b - 1) / PIECE)
        whole = F.array_join(F.slice("pieces", (first + 1).cast("int"), (last - first + 1).cast("int")), "")
        return F.when(b > a, F.substring(whole, (a - first * PIECE + 1).cast("int"), (b - a).cast("int"))).otherwise("")

    before = lambda i: F.when(i > 0, F.get("spans", i - 1)["b"]).otherwise(F.lit(0).cast("long"))
    head = F.array_join(F.transform("spans", lambda x, i: F.concat(stretch(before(i), x["a"]), F.lit(mark))), "")
    clean = F.concat(head, stretch(F.element_at("spans", -1)["b"], F.length("text").cast("long")))
    return cut.select("own", F.when(F.col("spans").isNotNull(), clean).otherwise(F.col("text")).alias("text")).select(F.col("own").withField("text", F.col("text")).alias("own")).select("own.*")


def op6(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Findings of every row through the ledger at ``path``, or through one of its own."""
    ledger = update(docs.sparkSession, docs, path or scratch.new_path(docs.sparkSession, "secret-ledger"))
    rows = by_path(docs, ledger, "doc_id")
    base = F.filter("found", lambda x: x["rank"] < BASE)
    count = lambda k: F.size(F.filter("found", lambda x: x["rank"] == k)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("found")).alias("spans"))
