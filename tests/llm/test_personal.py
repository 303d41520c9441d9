"""Personal data against the contract's patterns and a plain re-implementation of votes, EM and the classifier."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from threadlens.llm import personal as P

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def digits(x):
    return re.sub("[^0-9]", "", x)


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0


def holds(kind, x):
    d = digits(x)
    return {
        "ip": lambda: all(int(p) <= 255 for p in x.split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15,
        "tel": lambda: 8 <= len(d) <= 15, "pan": lambda: luhn(d),
    }.get(kind, lambda: True)()


def mod97(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def has(pattern, x):
    return bool(regex.search(pattern, x))


def sign(yes, no=None):
    return 1 if yes else -1 if (not yes if no is None else no) else 0


GROUPED = r"^([0-9]+|[0-9]{4}([ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"


def form(kind, x):
    return {
        "email": lambda: sign(has(r"^[A-Za-z0-9](?:[A-Za-z0-9_%+-]|\.(?!\.))*@", x) and has(r"\.[A-Za-z]{2,24}$", x)), "ip": lambda: sign(not has(r"(^|\.)0[0-9]", x)), "card": lambda: sign(has(GROUPED, x)),
        "phone": lambda: sign(10 <= len(digits(x)) <= 13), "tel": lambda: sign(has(r"^\+|\(", x), has("^[0-9 ]+$", x)), "pan": lambda: sign(has(r"[ -]|^[0-9]{15,16}$", x)), "ssn": lambda: sign(not has("^(000|666|9)|-00-|-0000$", x)),
        "iban": lambda: sign(mod97(x) == 1), "name": lambda: sign(has(r"\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$", x), False), "address": lambda: sign(has("[0-9]", x)), "birth": lambda: sign(has("(19|20)[0-9]{2}", x)),
    }[kind]()


def listed(kind, x):
    role = has(rf"(?i)^({P.ROLES})@", x)
    return {
        "email": lambda: sign(has(rf"(?i)\.({P.DOMAINS})$", x) and not role, role), "ip": lambda: sign(not has(r"^(0|10|127|255|192\.168|169\.254|172\.(1[6-9]|2[0-9]|3[01]))\.", x)), "card": lambda: sign(has(f"^({P.ISSUERS})", digits(x))),
        "pan": lambda: sign(has(f"^({P.ISSUERS})", digits(x))), "phone": lambda: sign(has(f"^({P.CALLING})", digits(x))), "tel": lambda: sign(has(rf"^(\+({P.CALLING})[^0-9])?[^A-Za-z0-9_]*[2-9][0-9]{{1,3}}[^A-Za-z0-9_]", x)),
        "iban": lambda: sign(has(f"^({P.ACCOUNTS})", x)), "name": lambda: sign(has(rf"(?<!\p{{L}})({P.GIVEN})(?!\p{{L}})", x), False),
    }.get(kind, lambda: 0)()


def neighbour(c):
    return 0 if c == "" else 1 if c == " " else 2 if c == "\n" else 3 if has(r"\p{L}", c) else 4 if c in "0123456789" else 5 if c in ",;.:!?" else 6 if c in "()[]{}<>\"'" else 7


def plain(texts):
    """[(n of each base kind, base spans, all spans)] of each text."""
    rows = []
    for r, text in enumerate(texts):
        text, mine = text or "", []
        for rank, kind in enumerate(P.KINDS):
            pattern = BASE[rank][1] if rank < 4 else kind.pattern
            found, last = list(regex.finditer(pattern, text)), 0
            for k, m in enumerate(found):
                after = text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)]
                mine.append((rank, m.start(), m.end(), m.group(), text[last : m.start()][-24:], after[:24]))
                last = m.end()
        kinds = len({P.FAMILIES[x[0]] for x in mine})
        for rank, a, b, said, before, after in mine:
            kind = P.KINDS[rank]
            if not holds(kind.name, said):
                continue
            cut = said[:80]
            different = len(set(regex.sub(r"[^\p{L}0-9]", "", cut)))
            glued = has(r"[\p{L}0-9_=/]$", before) or has(r"^[\p{L}0-9_=/]", after)
            cue = 1 if has(re.sub(r"\\W", "[^A-Za-z0-9_]", kind.cues), before) else -1 if regex.search(P.UNLIKELY, before, regex.ASCII) else 0
            votes = (form(kind.name, cut), listed(kind.name, cut), cue, -1 if glued else 1, -1 if different <= 2 else 1 if different >= 4 else 0, int(kinds > 1))
            shape = re.sub("[0-9]+", "9", regex.sub(r"\p{L}+", "a", cut))
            word = regex.search(r"(\p{L}+)\P{L}*$", before)
            crc = lambda x: zlib.crc32(x.encode()) % 64
            f = [*[v + 1 for v in votes], crc(shape), min(b - a, 63), neighbour(before[-1:]), neighbour(after[:1]), crc(word[1].lower() if word else ""), min(len(digits(cut)), 63)]
            rows.append((r, rank, a, b, votes, tuple(64 * slot + v for slot, v in enumerate(f))))
    logits = {}
    for rank in {x[1] for x in rows}:
        patterns = Counter(x[4] for x in rows if x[1] == rank)
        prior, right, wrong = 0.5, [0.8] * 6, [0.2] * 6
        score = lambda v: math.log(prior / (1 - prior)) + sum(math.log(a / b) if x == 1 else math.log((1 - a) / (1 - b)) if x == -1 else 0 for x, a, b in zip(v, right, wrong, strict=True))  # noqa: B023, E731
        sure = lambda s: 1 / (1 + math.exp(-s))
        for _ in range(P.ROUNDS):
            ys = {v: sure(score(v)) for v in patterns}
            rate = lambda j, side, extra: (sum(n * side(ys[v]) for v, n in patterns.items() if v[j] == 1) + extra) / (sum(n * side(ys[v]) for v, n in patterns.items() if v[j]) + 5)  # noqa: B023, E731
            prior, right, wrong = (sum(n * ys[v] for v, n in patterns.items()) + 1) / (patterns.total() + 2), [rate(j, lambda y: y, 4) for j in range(6)], [rate(j, lambda y: 1 - y, 1) for j in range(6)]
        p, q = defaultdict(float), defaultdict(float)
        for x in (x for x in rows if x[1] == rank):
            y = round(sure(score(x[4])), 6)
            for k in (*x[5], None):
                p[k] += y
                q[k] += 1 - y
        for x in (x for x in rows if x[1] == rank):
            logits[x[:4]] = math.log((p[None] + 1) / (q[None] + 1)) + sum(math.log((p[k] + 1) / (p[None] + 64)) - math.log((q[k] + 1) / (q[None] + 64)) for k in x[5])
    out = []
    for r in range(len(texts)):
        base = [x for x in rows if x[0] == r and x[1] < 4]
        more = [x for x in rows if x[0] == r and x[1] >= 4 and logits[x[:4]] > 1e-9 and not any(b[2] < x[3] and b[3] > x[2] for b in base)]
        told = lambda xs: ",".join(f"{P.KINDS[x[1]].name}:{x[2]}:{x[3]}" for x in sorted(xs, key=lambda x: (x[2], x[1])))
        out.append((*[sum(x[1] == k for x in base) for k in range(4)], hashlib.sha256(told(base).encode()).hexdigest(), told([*base, *more])))
    return out


ODD = [
    None, "", "nothing here", "mail me at ana.b@x.example.com or b_c@d.e, not a@b or @c.d a@b.c_d@e.f a@b..c x@y.z.", "1.2.3.4 256.1.1.1 001.002.003.004 1.2.3.4.5.6.7.8 10.0.0.1 1.2.3",
    "card 4111 1111 1111 1111, visa 4111111111111111 5500-0000-0000-0004 4111111111111112 1234 5678", "call +1 (269) 555-3296 4524132264652876 and +1 (269) 555-3296, +49 30 1234567 +12 +1", "(415) 555-2671 or 415-555-2671, 415 555 2671 order 123 456 7890",
    "ssn 123-45-6789, 000-12-3456 9123-45-6789", "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 XX00AAAABBBBCCCC", "Dr. Jane Miller met María López and James Smith, Mr Who", "at 12 Main Street, 5 Old Mill Road; Calle Mayor 12", "born 1980-02-03, on 2020-01-01; geboren am 3.4.1975",
    "ñ€𝒳 a@b.cd 𝒳𝒳 1.1.1.1 日本 a@b.cd", "id=4111111111111111x +44 20 7946 0958\n192.168.0.1", "x" * 50_000, "9" * 40_000, "1 " * 40_000, "a." * 30_000 + "@" + "b." * 30_000, "1.2." * 20_000, "+1" + " " * 40_000, "+1 " * 20_000, "a@" * 20_000,
]


@pytest.mark.parametrize("which", ["odd", "table"])
def test_equal_to_plain(spark, sf, which):
    texts = ODD + ODD[3:7] if which == "odd" else [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    df = spark.createDataFrame([(k, x, "r", 5) for k, x in enumerate(texts)], "doc_id bigint, text string, row string, kinds int").repartition(3)
    got = [tuple(r)[1:] for r in P.op11(df).orderBy("doc_id").collect()]
    want = plain(texts)
    for k, (a, b) in enumerate(zip(got, want, strict=True)):
        assert a == b, (k, (texts[k] or "")[:80])


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a@b.com")] * 30 + [(4, "a@b.com")] * 30 + [(4, None)], "doc_id bigint, text string").repartition(5)
    rows = P.op11(df).collect()
    assert Counter((r.doc_id, r.n_email) for r in rows) == {(None, 1): 30, (4, 1): 30, (4, 0): 1}
    assert P.op11(df.limit(0)).count() == 0


def test_reliable_labelers_are_found(spark):
    """Labelers 0, 3 and 4 agree; labeler 1 is random: EM trusts the former."""
    rows = [(k, 0, [s, 1 if k * 7 % 13 > 6 else -1, 0, s, s if k % 9 else -s, 0]) for k in range(600) for s in [1 if k % 3 else -1]]
    candidate = spark.createDataFrame(rows, "row bigint, rank int, votes array<int>")
    got = P.reliabilities(candidate).first()
    assert 0.6 < got.prior < 0.73 and got.right[0] > 0.95 > 0.2 > got.wrong[0] and abs(got.right[1] - got.wrong[1]) < 0.1 and got.wrong[4] > got.wrong[0] + 0.2


def test_known_numbers(spark):
    row = spark.range(1).select(P.luhn(F.lit("4111111111111111")), P.luhn(F.lit("4111111111111112")), P.mod97(F.lit("DE89 3704 0044 0532 0130 00")), P.mod97(F.lit("DE88370400440532013000"))).first()
    assert row[0] and not row[1] and row[2] == 1 and row[3] != 1
