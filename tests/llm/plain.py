"""Plain re-implementations of the contracts, one text at a time."""

import hashlib
import re
from collections import Counter

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def words1(text):
    return ALNUM.findall((text or "").translate(LOW))


def words2(text):
    return SPACED.findall(text or "")


def op1(docs, items):
    windows = {}
    for item, text in items:
        w = words1(text)
        for i in range(max(len(w) - 12, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words1(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[key]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def op2(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        w = words2(text)
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        out.append((doc, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    return out


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def op6(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        n = Counter(k for _, k, _ in spans)
        kinds = ("assign", "access", "hex")
        out.append((doc, n[0], n[1], n[2], sha(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans)))))
    return out


def op8(docs):
    """Rows with equal doc_id and text count as one document."""
    rows = {}
    for doc, text in docs:
        rows.setdefault((doc, text or ""), words2(text))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, gone = set(), {}
    for key in order:
        w, drop = rows[key], set()
        for i in range(len(w) - 19):
            gram = tuple(w[i : i + 20])
            if gram in seen:
                drop |= set(range(i, i + 20))
            seen.add(gram)
        gone[key] = drop
    out = []
    for doc, text in docs:
        w, drop = rows[doc, text or ""], gone[doc, text or ""]
        out.append((doc, len(w), len(drop), sha(" ".join(x for i, x in enumerate(w) if i not in drop))))
    return out


PHRASES = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}


def op9(docs):
    out = []
    for doc, text in docs:
        w = words1(text)
        found = sorted((i, label) for p, label in PHRASES.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p)
        out.append((doc, len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))))
    return out


def shingles(text):
    w = words2((text or "").translate(LOW))
    if 0 < len(w) < 5:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def op10(docs):
    sets = [shingles(t) for _, t in docs]
    where, root = {}, list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    equal = {}
    for i, s in enumerate(sets):
        if s:
            root[find(i)] = find(equal.setdefault(s, i))
    for i in equal.values():
        for x in sets[i]:
            where.setdefault(x, []).append(i)
    for i in equal.values():
        near = Counter(j for x in sets[i] for j in where[x] if j < i)
        for j, n in near.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        r = find(i)
        least[r] = min((d for d in (doc, least.get(r)) if d is not None), default=None)
    return [(doc, len(s), least[find(i)] if s else doc) for i, ((doc, _), s) in enumerate(zip(docs, sets))]
