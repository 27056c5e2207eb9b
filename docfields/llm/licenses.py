"""License scans: notice phrases and identifier tags by Aho-Corasick, licence
expressions by a shunting-yard parser.

Words are runs of ASCII letters and digits and of all characters beyond ASCII,
with A-Z in lower case. An automaton over the text's words finds each place
where a phrase's words stand consecutively. Where it finds the words of an
identifier tag, the licence expression after the tag is parsed from the text
itself and evaluated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from docfields.llm.common import arrow_map, prepare, renamed, slices

#: Base phrases. Fixed values.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Phrases of the method's own.
NOTICES = {
    "lesser general public license": "lgpl", "affero general public license": "agpl", "mozilla public license": "mpl",
    "eclipse public license": "epl", "european union public licence": "eupl", "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd", "isc license": "isc", "boost software license": "bsl",
    "permission is hereby granted free of charge": "mit", "mit licence": "mit", "apache licence": "apache",
    "general public licence": "gpl", "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "cc0": "cc0",
    "creative commons attribution": "cc-by", "public domain": "public-domain", "unlicense": "unlicense",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: Labels of identifiers, by how they begin.
FAMILIES = ["lgpl", "agpl", "gpl", "apache", "mit", "bsd", "mpl", "epl", "eupl", "isc", "bsl", "cc0", "cc-by-nc-sa",
            "cc-by-nc-nd", "cc-by-nc", "cc-by-sa", "cc-by-nd", "cc-by", "unlicense", "zlib", "wtfpl"]
#: How free use is under a label, for the evaluation of expressions: or takes
#: the freer side, and the stricter one, with lifts its licence a little.
FREEDOM = {"lgpl": 0.6, "agpl": 0.2, "gpl": 0.4, "mpl": 0.7, "epl": 0.7, "eupl": 0.6, "cc-by-sa": 0.5, "cc-by-nc": 0.2,
           "cc-by-nd": 0.2, "cc-by-nc-sa": 0.1, "cc-by-nc-nd": 0.1, "proprietary": 0.0, "other": 0.5}
EXCEPTION = 0.1
#: Weight of each kind of evidence; a document's score is that of all kinds it has, 1 - product(1 - weight).
WEIGHTS = {"expression": 0.95, "base": 0.8, "notice": 0.6}

_KEEP = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
TAG_TEXT = re.compile(r"SPDX-License-Identifier\s*:[ \t]*", re.IGNORECASE)
TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
PRIORITY = {"OR": 1, "AND": 2, "WITH": 3}


def words_of(text: str) -> list[bytes]:
    """Words of a text, by byte value: bytes beyond ASCII belong to words."""
    return text.encode().translate(_KEEP).split()


def label_of(identifier: str) -> str:
    name = identifier.lower()
    return next((f for f in FAMILIES if re.match(rf"{f}(?![a-z])", name)), "other")


def parse_expression(text: str, at: int = 0, stop: int | None = None) -> tuple[list[str], str] | None:
    """Longest licence expression that begins at ``at`` (and ends by ``stop``)
    in postfix order, and the part of the text it takes; None where there is none.

    The text is cut where it stops being an expression (comment ends, prose):
    one pass over the tokens finds the last place where all that came before is
    whole, and the shunting-yard takes the tokens up to there: operands go out,
    operators wait for those that bind tighter.
    """
    stop = len(text) if stop is None else stop
    tokens, whole, depth, operand, place = [], 0, 0, True, at
    while m := TOKEN.match(text, place, stop):
        t, place = m[1], m.end()
        operator = t.upper() in PRIORITY
        if operand:
            if operator or t == ")":
                break
            depth += t == "("
            operand = t == "("
        elif t == ")":
            if not depth:
                break
            depth -= 1
        elif operator:
            operand = True
        else:
            break
        tokens.append((t, place))
        if not operand and not depth:
            whole = len(tokens)
    if not whole:
        return None
    out, waiting = [], []
    for t, _ in tokens[:whole]:
        op = t.upper() if t.upper() in PRIORITY else None
        if t == "(":
            waiting.append(t)
        elif t == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif op:
            while waiting and waiting[-1] != "(" and PRIORITY[waiting[-1]] >= PRIORITY[op]:
                out.append(waiting.pop())
            waiting.append(op)
        else:
            out.append(t)
    return out + waiting[::-1], text[at:tokens[whole - 1][1]].strip()


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels of an expression's licences, and the freedom it grants."""
    stack: list[tuple[set[str], float]] = []
    for t in postfix:
        if t in PRIORITY:
            (b, y), (a, x) = stack.pop(), stack.pop()
            stack.append((a, min(1.0, x + EXCEPTION)) if t == "WITH" else (a | b, max(x, y) if t == "OR" else min(x, y)))
        else:
            stack.append(({label_of(t)}, FREEDOM.get(label_of(t), 1.0)))
    return stack[0]


@lru_cache(1)
def automaton():
    import ahocorasick
    out = ahocorasick.Automaton()
    for phrase in (*BASE, *NOTICES, TAG):
        out.add_word(f" {phrase} ", phrase)
    out.make_automaton()
    return out


def tagged(text: str) -> Iterator[tuple[list[str], str]]:
    """The expression after each tag, up to the end of the line or the next tag."""
    tags = list(TAG_TEXT.finditer(text))
    for m, following in zip(tags, [*(t.start() for t in tags[1:]), len(text)], strict=True):
        end = text.find("\n", m.end(), following)
        if found := parse_expression(text, m.end(), end if end >= 0 else following):
            yield found


def scan(text: str) -> tuple:
    words = words_of(text)
    line = f" {b' '.join(words).decode()} "
    hits = list(automaton().iter(line))
    if not hits:
        return len(words), 0, None, None, "", "", 0.0, [], None
    # a hit's last word ends at the space it ends with: words before it, by counting on
    starts, at, n = [], 0, 0
    for end, phrase in hits:
        n += line.count(" ", at, end)
        at = end
        if phrase in BASE:
            starts.append(n - phrase.count(" ") - 1)
    found = {p for _, p in hits}
    base = {BASE[p] for p in found if p in BASE}
    notices = {NOTICES[p] for p in found if p in NOTICES}
    # a longer phrase stands for the shorter one that it holds
    notices -= {NOTICES[p] for p in found if p in NOTICES and any(p != q and q.startswith(p + " ") for q in found)
                and sum(q == p for _, q in hits) <= sum(q != p and q.startswith(p + " ") for _, q in hits)}
    expressions, freedom = [], [FREEDOM.get(x, 1.0) for x in base | notices]
    own = set(notices)
    if TAG in found:
        for postfix, written in tagged(text):
            labels, free = evaluate(postfix)
            own |= labels
            freedom.append(free)
            expressions.append(written)
    score = 1.0
    for kind, there in (("expression", expressions), ("base", base), ("notice", notices)):
        score *= 1 - WEIGHTS[kind] * bool(there)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | own)), 1 - score, expressions, min(freedom, default=None))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, places of base phrases, labels, evidence
    ``score``, the licence ``expressions`` as written, and ``freedom`` (0 to 1:
    the strictest of all that was found; null where nothing was).

    A null text counts as empty; null ids, repeated rows and empty tables pass
    through; other columns are not looked at.
    """
    prepare(docs.sparkSession)
    src = renamed(docs, doc_id=id_col, text=text_col)
    kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
             ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
             ("expressions", pa.list_(pa.string())), ("freedom", pa.float64())]

    def run(batch: pa.RecordBatch):
        texts = batch.column(1).to_pylist()
        for a, b in slices(texts):
            columns = zip(*(scan(t or "") for t in texts[a:b]), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), *(pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True))],
                names=["doc_id", *(n for n, _ in kinds)])

    return arrow_map(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, "
                               "first_word long, last_word long, base_labels string, labels string, score double, "
                               "expressions array<string>, freedom double")
