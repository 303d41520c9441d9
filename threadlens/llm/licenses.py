"""License notices and identifier tags.

One Aho-Corasick automaton finds phrases, as whole words, in the normalised text
of many documents at once.  Where it meets an identifier tag, the expression
that follows in the raw text is parsed by a shunting yard (AND binds tighter
than OR, WITH tightest) and evaluated: an expression is permissive if a choice
among its ORs leaves permissive licences only.

Operands are the identifiers of IDENTIFIERS and of the families FAMILY describes, each also with "+", and references
("LicenseRef-..."); an operator that no operand follows belongs to the prose
after the expression.  WITH joins one identifier and one exception.  What cannot
be read at all gets the label ``spdx:invalid``.

Null and empty texts have no words and no labels.  Repeated rows give repeated
results, a null ``doc_id`` stays null, empty tables give empty results, other
columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .wordscan import ALNUM, Words, slices, texts_of

#: fixed values: the phrases of the base contract and their labels
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: notice phrases beyond the base
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl", "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd", "permission is hereby granted free of charge": "mit-text", "isc license": "isc",
    "eclipse public license": "epl", "creative commons": "creative-commons", "cc0": "cc0", "public domain": "public-domain", "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
TAG_RAW = re.compile(r"SPDX-License-Identifier[ \t]*:[ \t]*([^\r\n]*)", re.I)

#: fixed values: identifiers of permissive licences, besides the families below
PERMISSIVE_NAMES = frozenset(
    """0bsd afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 apache-1.0 apache-1.1 apache-2.0 artistic-2.0 blueoak-1.0.0 bsl-1.0 bzip2-1.0.6 curl ecl-2.0 efl-2.0 ftl hpnd icu ijg imagemagick isc json
    libpng libpng-2.0 libtiff mit mit-0 mit-cmu mit-modern-variant mulanpsl-2.0 ncsa nist-pd ntp openssl php-3.0 php-3.01 postgresql psf-2.0 python-2.0 ruby tcl unicode-3.0 unicode-dfs-2016
    unlicense upl-1.0 w3c wtfpl x11 xfree86-1.1 zlib zpl-2.0 zpl-2.1 cc0-1.0 ms-pl""".split()
)
#: fixed values: families whose members follow from version and variant
PERMISSIVE_FAMILY = re.compile(r"(bsd-[1-4]-clause(-[a-z-]+)?|cc-by-[1-4]\.[05](-[a-z]{2,3})?|apache-\d\.\d|mit(-[a-z]+)*)")
FAMILY = re.compile(
    r"(a?gpl|lgpl|gfdl)-[1-3]\.[0-9](-(only|or-later|invariants|no-invariants)){0,2}|cc-by(-nc)?(-nd|-sa)?-[1-4]\.[05](-[a-z]{2,3}){0,2}|cc-(pddc|sa-1\.0|pdm-1\.0)|bsd-[1-4]-clause(-[a-z0-9-]+)?"
    r"|artistic-[12]\.0(-perl|-cl8)?|(afl|osl|apsl|epl|eupl|mpl|npl|cddl|cpal|cpl|lppl|ofl|oldap|php|python|psf|zpl|w3c|ecl|efl|rpl|sspl|busl|cecill|nasa|ncgl|ogl-uk|odc-by|oclc|rpsl|sisl|spl|upl|ypl)-\d(\.\d+[a-z]?){0,2}|mit(-[a-z]+)*"
)


def permissive(name: str) -> bool:
    plain = name.lower().removesuffix("+")
    return plain in PERMISSIVE_NAMES or bool(PERMISSIVE_FAMILY.fullmatch(plain))


#: fixed values: licence identifiers and exceptions in common use, in lower case
IDENTIFIERS = frozenset(
    """0bsd afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause
    bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 bzip2-1.0.6 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-3.0 cc-by-nc-4.0
    cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0 cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 curl
    ecl-2.0 efl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 ftl gfdl-1.1 gfdl-1.2 gfdl-1.3 gfdl-1.3-only gfdl-1.3-or-later gpl-1.0 gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only
    gpl-3.0-or-later hpnd icu ijg imagemagick ipl-1.0 isc json lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later
    libpng libpng-2.0 libtiff lppl-1.3c mit mit-0 mit-cmu mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-pl ms-rl mulanpsl-2.0 ncsa nist-pd ntp odbl-1.0 ofl-1.0 ofl-1.1 openssl
    osl-2.1 osl-3.0 php-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sgi-b-2.0 sissl sleepycat spl-1.0 tcl unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11
    xfree86-1.1 zlib zpl-2.0 zpl-2.1""".split()
)
EXCEPTIONS = frozenset(
    """autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 ecos-exception-2.0 font-exception-2.0 gcc-exception-2.0
    gcc-exception-3.1 gnu-javamail-exception libtool-exception linux-syscall-note llvm-exception lzma-exception ocaml-lgpl-linking-exception openssl-exception qt-gpl-exception-1.0
    qt-lgpl-exception-1.1 swift-exception u-boot-exception-2.0 wxwindows-exception-3.1""".split()
)
REFERENCE = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+|additionref-[a-z0-9.-]+")
PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:_-]+")


def known(token: str) -> bool:
    name = token.lower()
    plain = name.removesuffix("+")
    return name in IDENTIFIERS or plain in IDENTIFIERS or plain in PERMISSIVE_NAMES or bool(FAMILY.fullmatch(plain) or REFERENCE.fullmatch(name))


def read(text: str) -> tuple[list[str], str | None]:
    """The longest beginning of ``text`` that is an expression, as tokens; ValueError where there is none.

    Where licences follow it in a parenthesis that is never closed, also the operator before that.
    """
    out: list[str] = []
    best, depth, before, named = 0, 0, "(", 0
    for token in TOKEN.findall(text):
        upper = token.upper()
        if token == "(":
            if before not in ("(", "AND", "OR"):
                break
            depth += 1
            kind = "("
        elif token == ")":
            if before not in ("id", "exception", ")") or not depth:
                break
            depth -= 1
            kind = ")"
        elif upper in PRECEDENCE:
            if before not in (("id",) if upper == "WITH" else ("id", "exception", ")")):
                break
            kind = upper
        elif before == "WITH":
            if token.lower() not in EXCEPTIONS and not REFERENCE.fullmatch(token.lower()):
                break
            kind = "exception"
        elif before in ("(", "AND", "OR") and known(token):
            kind, named = "id", len(out) + 1
        else:
            break
        out.append(upper if kind in PRECEDENCE else token)
        before = kind
        if not depth and kind in ("id", "exception", ")"):
            best = len(out)
    if not best:
        raise ValueError(text)
    return out[:best], out[best] if named > best else None


def expression_tokens(text: str) -> list[str]:
    return read(text)[0]


def to_postfix(expression: str) -> list[str]:
    """Operands and operators in evaluation order; ValueError where it is no expression."""
    out: list[str] = []
    held: list[str] = []
    for token in expression_tokens(expression):
        if token == "(":
            held.append(token)
        elif token == ")":
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif token in PRECEDENCE:
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[token]:
                out.append(held.pop())
            held.append(token)
        else:
            out.append(token)
    return out + held[::-1]


def evaluate(expression: str) -> tuple[list[str], bool]:
    """The identifiers named, sorted, and whether some choice is permissive throughout.

    What breaks off after an OR leaves the choices before it; after an AND it leaves none that is known to be permissive.
    """
    names: set[str] = set()
    stack: list[tuple[str | None, bool]] = []  # an operand's name until it is known to stand alone
    for token in to_postfix(expression):
        if token not in PRECEDENCE:
            stack.append((token.lower(), permissive(token)))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        if token == "WITH":
            stack.append((f"{left} with {right}", a))
            continue
        names |= {x for x in (left, right) if x}
        stack.append((None, a and b if token == "AND" else a or b))
    last, free = stack.pop()
    return sorted(names | ({last} if last else set())), free and read(expression)[1] != "AND"


_automata: list = []


def automaton():
    """Phrases with blanks around them, so that only whole words match."""
    if not _automata:
        import ahocorasick

        found = ahocorasick.Automaton()
        for phrase, label in [*BASE.items(), *NOTICES.items(), (TAG, "")]:
            found.add_word(f" {phrase} ", (len(phrase) + 1, phrase, label))
        found.make_automaton()
        _automata.append(found)
    return _automata[0]


def scan(texts: list[bytes]) -> tuple[np.ndarray, dict[int, list[tuple[int, str, str]]]]:
    """Words of each text, and for texts with any: (first word, phrase, label) in order."""
    words = Words(texts, ALNUM, fold=True)
    counts = np.diff(words.first)
    # one byte a character: every word between blanks, a line feed after each text
    inside = np.zeros(len(words.data) + 1, bool)
    inside[1:] = ALNUM[words.data]
    line = np.zeros(len(words.data), bool)
    line[words.base[1:] - 1] = True
    keep = inside[1:] | inside[:-1] | line
    flat = np.where(inside[1:], words.data, np.uint8(32))[keep]
    marks = np.flatnonzero(line[keep])
    # a text's end closes its last word with a blank and opens the next text with another
    flat = np.insert(flat, np.repeat(marks + 1, 2), np.tile(np.array([10, 32], np.uint8), len(marks)))
    flat = np.concatenate((np.array([32], np.uint8), flat))
    text = flat.tobytes().decode("latin-1")
    solid = ALNUM[flat]
    starts = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    hits: dict[int, list] = {}
    for end, (back, phrase, label) in automaton().iter(text):
        word = int(np.searchsorted(starts, end - back))
        doc = int(np.searchsorted(words.first, word, "right")) - 1
        hits.setdefault(doc, []).append((word - int(words.first[doc]), phrase, label))
    for doc in hits:
        hits[doc].sort()
    return counts, hits


RESULT = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, permissive boolean, places array<struct<word: bigint, phrase: string>>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("permissive", pa.bool_()), ("places", pa.list_(pa.struct([("word", pa.int64()), ("phrase", pa.string())])))])


def licensed(docs: DataFrame) -> DataFrame:
    """One row a document with every place found, its labels and whether its expressions allow a permissive choice (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch.column(1))
            counts, hits = scan(texts)
            rows = {name: [] for name in _ARROW.names[1:]}
            for k, n in enumerate(counts.tolist()):
                found = hits.get(k, ())
                places = [w for w, phrase, _ in found if phrase in BASE]
                base = sorted({label for _, phrase, label in found if phrase in BASE})
                labels, tags = {label for _, _, label in found if label}, []
                if any(phrase == TAG for _, phrase, _ in found):
                    for m in TAG_RAW.finditer(texts[k].decode("utf-8", "replace")):
                        try:
                            names, permissive = evaluate(m[1])
                        except ValueError:
                            labels.add("spdx:invalid")
                            continue
                        labels |= {f"spdx:{x}" for x in names}
                        tags.append(permissive)
                # a tag or a full notice is near certain; each bare phrase leaves a doubt of a half
                doubt = 0.05 ** bool(tags) * 0.5 ** sum(1 for _, phrase, _ in found if phrase != TAG)
                values = (n, len(places), places[0] if places else None, places[-1] if places else None, ",".join(base), ",".join(sorted(labels)), 1.0 - doubt, all(tags) if tags else None, [{"word": w, "phrase": p} for w, p, _ in found])
                for name, value in zip(rows, values, strict=True):
                    rows[name].append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(rows[f.name], f.type) for f in list(_ARROW)[1:]]], schema=_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def op9(docs: DataFrame) -> DataFrame:
    return licensed(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permissive")
