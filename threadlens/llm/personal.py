"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans.  Six labelers vote for each proposal (1 personal, -1 not,
0 no opinion): its strict form, gazetteers, cue words before it, what it is glued
to, the variety of its characters, and whether the text holds other kinds too.
Expectation-maximisation over the counts of vote patterns, kind by kind, gives
each labeler's reliability and each pattern's probability; with these as soft
labels a final naive Bayes classifier of spans is trained on votes, shape, size,
neighbours and the word before, and decides.  Spans of the BASE kinds that pass
their test stay whatever it says; spans of the other kinds stay if it accepts
them and they overlap no base span.

What is gathered is bounded: 3**6 vote patterns and SLOTS x VALUES weights a kind.
Soft counts are whole millionths, so sums do not depend on their order.  Places
are running sums over the matches of a text, as in ``secrets``; only matches with
CONTEXT characters around them move, never texts.

Null texts count as empty; repeated rows give repeated results, each row by
itself; a null ``doc_id`` stays null; an empty table gives an empty result.  Only
``doc_id`` and ``text`` are read.  Offsets count code points, the end is
exclusive.  Patterns never go back over what they have read, so that very long
texts, runs of digits or of dots take time in proportion to their length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

CONTEXT = 24
ROUNDS = 20
MILLION = 1_000_000


def _digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def _number(digit: Column) -> Column:
    return F.position(digit, F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")) - 1


def luhn(digits: Column) -> Column:
    """Whether the last digit makes the checksum right."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, _number(d)).otherwise(_number(d) * 2 - F.when(_number(d) > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(said: Column) -> Column:
    """An account number's remainder: its first four characters go last, letters count 10 to 35."""
    plain = F.replace(said, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(_number(c) > 9, 100).otherwise(10) + _number(c)) % 97)


def _between(x: Column, least: int, most: int) -> Column:
    return (F.length(_digits(x)) >= least) & (F.length(_digits(x)) <= most)


def _octets(said: Column) -> Column:
    """Whether four numbers are 255 at most, leading zeros or not."""
    value = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(said, r"\."), lambda p: (F.length(value(p)) <= 3) & (F.coalesce(F.left(value(p), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))


@dataclass(frozen=True)
class Kind:
    """What a pattern finds, the test a match must pass, its strict form and its gazetteer's opinion (1, 0, -1), and its cue words."""

    name: str
    pattern: str
    holds: Callable[[Column], Column]
    form: Callable[[Column], Column]
    listed: Callable[[Column], Column]
    cues: str


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(~yes if no is None else no, -1).otherwise(0)


def _yes(said: Column) -> Column:
    return F.lit(True)


def _none(said: Column) -> Column:
    return F.lit(0)


# Gazetteers: fixed values.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|it|nl|uk|ie|eu|ch|at|be|pt|pl|se|no|dk|fi|co|mx|ar|cl|pe|br|ca|us|au|nz|in|jp"
ROLES = "info|admin|support|sales|contact|office|help|noreply|no-reply|postmaster|webmaster|abuse|news|service"
CALLING = "1|7|20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-36]|2[2-6][0-9]|35[0-9]|37[0-9]|38[0-9]|42[0-3]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|85[0-6]|88[06]|9[67][0-9]|99[2-8]"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|62|36|35"
ACCOUNTS = "AD|AE|AT|BE|BG|BR|CH|CR|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IL|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SA|SE|SI|SK|SM|TR"
GIVEN = "James|Mary|John|Robert|Michael|William|David|Richard|Thomas|Sarah|Karen|Daniel|Emma|Olivia|Anna|Maria|María|José|Juan|Luis|Carlos|Ana|Carmen|Pedro|Hans|Peter|Klaus|Jürgen|Pierre|Jean|Marie|Camille|Louis"
TITLES = "Mr|Mrs|Ms|Dr|Prof|Sr|Sra|Herr|Frau|Mme|Señor|Señora"
STREETS = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Boulevard|Blvd|Court|Way"
UNLIKELY = r"(?i)\b(version|release|isbn|issn|doi|order|invoice|ref|sku|build|page|figure|serial|revision|commit|hash|chapter|section|v)\b[\s.:#=]*$"

_NUMBER = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])"
_ISSUED = lambda x: _vote(_digits(x).rlike(f"^({ISSUERS})"))

#: the contract's kinds first; a match that fails ``holds`` is dropped without another try
KINDS: tuple[Kind, ...] = (
    Kind(
        "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _yes,
        lambda x: _vote(x.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9_%+-]|\.(?!\.))*+@") & x.rlike(r"\.[A-Za-z]{2,24}$")),
        lambda x: _vote(x.rlike(rf"(?i)\.({DOMAINS})$") & ~x.rlike(rf"(?i)^({ROLES})@"), x.rlike(rf"(?i)^({ROLES})@")),
        r"(?i)(e-?mail|mail|contact|write|correo|kontakt|courriel|address)\W*$",
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _octets,
        lambda x: _vote(~x.rlike(r"(^|\.)0[0-9]")),
        lambda x: _vote(~x.rlike(r"^(0|10|127|255|192\.168|169\.254|172\.(1[6-9]|2[0-9]|3[01]))\.")),
        r"(?i)(ip|host|server|address|client|login|from|addr)\W*$",
    ),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9])++", lambda x: _between(x, 12, 19) & luhn(_digits(x)),
        lambda x: _vote(x.rlike(r"^([0-9]+|[0-9]{4}([\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$")), _ISSUED,
        r"(?i)(card|visa|credit|debit|amex|mastercard|tarjeta|karte|carte|pan)\W*$",
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: _between(x, 9, 15),
        lambda x: _vote(_between(x, 10, 13)), lambda x: _vote(_digits(x).rlike(f"^({CALLING})")),
        r"(?i)(phone|tel|telephone|call|mobile|cell|fax|whatsapp|teléfono|telefon|tél)\W*$",
    ),
    Kind(
        "tel", r"(?<![0-9+])(?:\+?[0-9]{1,3}[\x20.-])?(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])", lambda x: _between(x, 8, 15),
        lambda x: _vote(x.rlike(r"^\+|\("), x.rlike(r"^[0-9 ]+$")), lambda x: _vote(x.rlike(rf"^(\+({CALLING})[^0-9])?\W*[2-9][0-9]{{1,3}}\W")),
        r"(?i)(phone|tel|telephone|call|mobile|cell|fax|whatsapp|teléfono|telefon|tél)\W*$",
    ),
    Kind(
        "pan", _NUMBER, lambda x: luhn(_digits(x)), lambda x: _vote(x.rlike(r"[\x20-]|^[0-9]{15,16}$")), _ISSUED,
        r"(?i)(card|visa|credit|debit|amex|mastercard|tarjeta|karte|carte|pan)\W*$",
    ),
    Kind(
        "ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _yes,
        lambda x: _vote(~x.rlike("^(000|666|9)|-00-|-0000$")), _none, r"(?i)(ssn|social|security|tax)\W*$",
    ),
    Kind(
        "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _yes,
        lambda x: _vote(mod97(x) == 1), lambda x: _vote(x.rlike(f"^({ACCOUNTS})")), r"(?i)(iban|account|konto|cuenta|compte|bank)\W*$",
    ),
    Kind(
        "name", rf"(?<!\p{{L}})(?:(?:{TITLES})\.?\x20\p{{Lu}}\p{{Ll}}{{1,30}}+(?:\x20\p{{Lu}}\p{{Ll}}{{1,30}}+)?|(?:{GIVEN})\x20\p{{Lu}}\p{{Ll}}{{1,30}}+)(?!\p{{L}})", _yes,
        lambda x: _vote(x.rlike(r"\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$"), F.lit(False)), lambda x: _vote(x.rlike(rf"(?<!\p{{L}})({GIVEN})(?!\p{{L}})"), F.lit(False)),
        r"(?i)(name|nombre|by|dear|from|signed|author|nom)\W*$",
    ),
    Kind(
        "address", rf"(?<![0-9A-Za-z])[0-9]{{1,5}}\x20(?:\p{{Lu}}\p{{Ll}}{{1,20}}+\x20){{1,3}}(?:{STREETS})(?!\p{{L}})|(?<!\p{{L}})(?:Calle|Carrera|Avenida|Rue|Via)\x20\p{{Lu}}\p{{Ll}}{{1,20}}+\x20[0-9]{{1,5}}(?![0-9])", _yes,
        lambda x: _vote(x.rlike("[0-9]")), _none, r"(?i)(address|live at|lives at|at|direccion|dirección|adresse|home)\W*$",
    ),
    Kind(
        "birth", r"(?<![0-9])(?=[0-9])(?<=(?:born|birth|dob|DOB|Born|Birth|nacid[oa]|geboren)[^0-9\n]{0,16})(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9])", _yes,
        lambda x: _vote(x.rlike("(19|20)[0-9]{2}")), _none, r"(?i)(born|birth|dob|on|nacid[oa]|geboren)\W*$",
    ),
)
BASE = 4
FAMILIES = (0, 1, 2, 3, 3, 2, 4, 5, 6, 7, 8)  # kinds that find the same sort of thing keep each other no company
LABELERS = ("form", "gazetteer", "cue", "glue", "variety", "company")
SLOTS, VALUES = len(LABELERS) + 6, 64

MATCH = "struct<gap: int, size: int, said: string, before: string, after: string, holds: boolean>"


def _found(kind: Kind, pieces: Column, whole: Column) -> Column:
    """array<MATCH>: every match of a kind with the characters since the last one and its neighbourhood."""
    m = F.size(whole)
    zipped = F.arrays_zip(F.slice(pieces, 1, m).alias("gap"), whole.alias("said"), F.slice(pieces, 2, m).alias("after"))
    told = F.transform(zipped, lambda z: F.struct(F.length(z["gap"]).alias("gap"), F.length(z["said"]).alias("size"), F.left(z["said"], F.lit(80)).alias("said"), F.right(z["gap"], F.lit(CONTEXT)).alias("before"), F.left(z["after"], F.lit(CONTEXT)).alias("after"), F.coalesce(kind.holds(z["said"]), F.lit(False)).alias("holds")))
    return F.when(whole.isNotNull(), told).otherwise(F.array().cast(f"array<{MATCH}>"))


def matches(docs: DataFrame, *keys: str) -> DataFrame:
    """(row, keys, found): a written table of each row's matches by kind, kinds without any left out."""
    text = docs.select(F.monotonically_increasing_id().alias("row"), *keys, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = [F.when(F.col("text").rlike(k.pattern), f(k)).alias(f"{n}{i}") for i, k in enumerate(KINDS) for n, f in (("p", lambda k: F.split("text", k.pattern, -1)), ("w", lambda k: F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))))]
    cut = text.select("row", *keys, *parts)
    every = F.array(*[F.struct(F.lit(i).alias("rank"), _found(k, F.col(f"p{i}"), F.col(f"w{i}")).alias("m")) for i, k in enumerate(KINDS)])
    return scratch.durable(cut.select("row", *keys, F.filter(every, lambda x: F.size(x["m"]) > 0).alias("found")), "personal-matches")


def _by_kind(of: Callable[[Kind], Column]) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for i, k in enumerate(KINDS):
        out = out.when(F.col("rank") == i, of(k))
    return out


def _votes() -> Column:
    said, before, after = F.col("said"), F.col("before"), F.col("after")
    glued = before.rlike(r"[\p{L}0-9_=/]$") | after.rlike(r"^[\p{L}0-9_=/]")
    different = F.size(F.array_distinct(F.split(F.regexp_replace(said, r"[^\p{L}0-9]", ""), "")))
    cue = F.when(_by_kind(lambda k: before.rlike(k.cues).cast("int")) == 1, 1).when(before.rlike(UNLIKELY), -1).otherwise(0)
    votes = [_by_kind(lambda k: k.form(said)), _by_kind(lambda k: k.listed(said)), cue, F.when(glued, -1).otherwise(1), F.when(different <= 2, -1).when(different >= 4, 1).otherwise(0), F.when(F.col("kinds") > 1, 1).otherwise(0)]
    return F.array(*[F.coalesce(v, F.lit(0)).cast("int") for v in votes])


def _class(neighbour: Column) -> Column:
    return F.when(neighbour == "", 0).when(neighbour == " ", 1).when(neighbour == "\n", 2).when(neighbour.rlike(r"^\p{L}$"), 3).when(neighbour.rlike("^[0-9]$"), 4).when(neighbour.isin(*",;.:!?"), 5).when(neighbour.isin(*"()[]{}<>\"'"), 6).otherwise(7)


def _features() -> Column:
    """SLOTS places in the table of weights."""
    said, before, after = F.col("said"), F.col("before"), F.col("after")
    shape = F.regexp_replace(F.regexp_replace(said, r"\p{L}+", "a"), "[0-9]+", "9")
    word = F.lower(F.regexp_extract(before, r"(\p{L}+)\P{L}*$", 1))
    bucket = lambda x: F.pmod(F.crc32(x.cast("binary")), F.lit(VALUES))
    kinds = [*[F.get("votes", j) + 1 for j in range(len(LABELERS))], bucket(shape), F.least(F.col("size"), F.lit(VALUES - 1)), _class(F.right(before, F.lit(1))), _class(F.left(after, F.lit(1))), bucket(word), F.least(F.length(_digits(said)), F.lit(VALUES - 1))]
    return F.array(*[(F.lit(slot * VALUES) + x).cast("int") for slot, x in enumerate(kinds)])


def candidates(found: DataFrame) -> DataFrame:
    """(row, rank, start, end, votes, features) of every match that passes its test; a written table."""
    families = F.array(*[F.lit(x) for x in FAMILIES])
    kinds = F.size(F.array_distinct(F.transform("found", lambda x: F.get(families, x["rank"]))))
    each = found.where(F.size("found") > 0).select("row", kinds.alias("kinds"), F.inline("found")).repartition("row").select("row", "kinds", "rank", F.posexplode("m").alias("at", "m"))
    so_far = Window.partitionBy("row", "rank").orderBy("at")
    placed = each.withColumn("end", F.sum(F.col("m.gap").cast("long") + F.col("m.size")).over(so_far)).where("m.holds")
    told = placed.select("row", "rank", "kinds", (F.col("end") - F.col("m.size")).alias("start"), "end", "m.size", "m.said", "m.before", "m.after").withColumn("votes", _votes())
    return scratch.durable(told.select("row", "rank", "start", "end", "votes", _features().alias("features")), "personal-candidates")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _logit(votes: Column, state: Column) -> Column:
    out = F.log(state["prior"] / (1 - state["prior"]))
    for j in range(len(LABELERS)):
        a, b, v = F.get(state["right"], j), F.get(state["wrong"], j), F.get(votes, j)
        out = out + F.when(v == 1, F.log(a / b)).when(v == -1, F.log((1 - a) / (1 - b))).otherwise(0.0)
    return out


def _probability(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def reliabilities(candidate: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(rank, prior, right, wrong): how often each labeler votes 1, if it votes, on personal and on other spans.

    Counts of at most 3**6 vote patterns a kind are gathered and ordered, and the rounds run over them.  Each
    rate starts at 0.8 or 0.2 and keeps the weight of five votes of that kind, so that labels never change sides.
    """
    counted = candidate.groupBy("rank", "votes").agg(F.count("*").cast("double").alias("n"))
    kinds = counted.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    width = len(LABELERS)
    start = F.struct(F.lit(0.5).alias("prior"), F.array(*[F.lit(0.8)] * width).alias("right"), F.array(*[F.lit(0.2)] * width).alias("wrong"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def step(state: Column, _: Column) -> Column:
        def maximised(weighted: Column) -> Column:  # (votes, p: expected personal ones, q: expected others)
            rate = lambda side, j, extra: (total(F.transform(weighted, lambda x: F.when(F.get(x["votes"], j) == 1, x[side]).otherwise(0.0))) + extra) / (total(F.transform(weighted, lambda x: F.when(F.get(x["votes"], j) != 0, x[side]).otherwise(0.0))) + 5)
            personal, all_ = total(F.transform(weighted, lambda x: x["p"])), total(F.transform(weighted, lambda x: x["p"] + x["q"]))
            return F.struct(((personal + 1) / (all_ + 2)).alias("prior"), F.array(*[rate("p", j, 4.0) for j in range(width)]).alias("right"), F.array(*[rate("q", j, 1.0) for j in range(width)]).alias("wrong"))

        expected = F.transform("patterns", lambda x: _bound(_probability(_logit(x["votes"], state)), lambda y: F.struct(x["votes"].alias("votes"), (x["n"] * y).alias("p"), (x["n"] * (1 - y)).alias("q"))))
        return _bound(expected, maximised)

    return kinds.select("rank", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("s")).select("rank", "s.*")


def weights(candidate: DataFrame, rates: DataFrame) -> DataFrame:
    """(rank, bias, weight): naive Bayes over SLOTS x VALUES feature values a kind, from soft labels in millionths."""
    y = F.round(_probability(F.round(_logit(F.col("votes"), F.struct("prior", "right", "wrong")), 9)) * MILLION).cast("long")
    soft = candidate.join(F.broadcast(rates), "rank").select("rank", y.alias("y"), "features")  # one row a kind
    each = soft.select("rank", "y", F.explode("features").alias("feature")).groupBy("rank", "feature").agg(F.sum("y").alias("p"), F.sum(MILLION - F.col("y")).alias("q"))
    # every candidate has one value in each slot, so the first slot holds each of them once
    whole = each.groupBy("rank").agg(F.sum(F.when(F.col("feature") < VALUES, F.col("p"))).alias("p_all"), F.sum(F.when(F.col("feature") < VALUES, F.col("q"))).alias("q_all"))
    share = lambda n, total: F.log((n + MILLION) / (total + VALUES * MILLION))
    listed = each.join(whole, "rank").groupBy("rank", "p_all", "q_all").agg(F.map_from_entries(F.collect_list(F.struct("feature", (share(F.col("p"), F.col("p_all")) - share(F.col("q"), F.col("q_all"))).alias("w")))).alias("known"))
    other = share(F.lit(0), F.col("p_all")) - share(F.lit(0), F.col("q_all"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(SLOTS * VALUES - 1)), lambda i: F.coalesce(F.try_element_at("known", i), other))
    return listed.select("rank", F.log((F.col("p_all") + MILLION) / (F.col("q_all") + MILLION)).alias("bias"), dense.alias("weight"))


def spans(found: DataFrame) -> DataFrame:
    """(row, start, rank, end, probability): base spans, and those of the other kinds that the classifier accepts."""
    candidate = candidates(found)
    model = weights(candidate, scratch.durable(reliabilities(candidate), "personal-rates"))
    logit = F.aggregate("features", F.col("bias"), lambda a, i: a + F.get("weight", i))
    judged = candidate.join(F.broadcast(scratch.durable(model, "personal-weights")), "rank").withColumn("logit", F.round(logit, 9))  # one row a kind
    kept = judged.where((F.col("rank") < BASE) | (F.col("logit") > 0)).select("row", "start", "rank", "end", F.round(_probability(F.col("logit")), 6).alias("probability")).repartition("row")
    base = F.col("rank") < BASE
    earlier, later = Window.partitionBy("row").orderBy("start", "rank"), Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank"))
    near = kept.withColumns({"reach": F.max(F.when(base, F.col("end"))).over(earlier), "next": F.min(F.when(base, F.col("start"))).over(later)})
    clear = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    return near.where(base | clear).drop("reach", "next")


PLACED = "array<struct<start: bigint, rank: int, end: bigint, probability: double>>"


def scanned(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys`` of every row with its spans by start and kind, as ``found``; an empty list where there are none."""
    found = matches(docs, *keys)
    lists = spans(found).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "probability"))).alias("spans"))
    none = F.array().cast(PLACED)
    loud = found.where(F.size("found") > 0).select("row", *keys).join(lists, "row", "left").select(*keys, F.coalesce("spans", none).alias("found"))
    return found.where(F.size("found") == 0).select(*keys, none.alias("found")).unionByName(loud)


def spelled(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op11(docs: DataFrame) -> DataFrame:
    rows = scanned(docs, "doc_id")
    count = lambda k: F.size(F.filter("found", lambda x: x["rank"] == k)).cast("long")
    base = F.filter("found", lambda x: x["rank"] < BASE)
    return rows.select("doc_id", *[count(i).alias(f"n_{KINDS[i].name}") for i in range(BASE)], F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("found")).alias("spans"))
