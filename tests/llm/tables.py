"""Small tables with every kind of awkward row, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np

DOCS = "doc_id long, text string, lang string, source string, n_chars long, token string, sig long, key string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\f\r"


def prose(seed: int, words: int) -> str:
    """Invented text with few chance repetitions."""
    rng = np.random.default_rng(seed)
    parts = ["ra", "ne", "tol", "Ki", "mu", "sé", "dor", "ba", "lin", "ox"]
    text = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(words)]
    for at in range(9, words, 11):
        text[at] += ".\n" if at % 2 else ","
    return " ".join(text)


def changed(text: str, seed: int, count: int) -> str:
    words = text.split(" ")
    rng = np.random.default_rng(seed)
    for at in rng.choice(len(words), count, replace=False):
        words[at] = f"x{seed}y{at}"
    return " ".join(words)


def documents(spark, rows):
    """``rows`` of (doc_id, text[, lang, source]) with extra columns whose names clash."""
    full = []
    for row in rows:
        doc_id, text, lang, source = (*row, None, None)[:4]
        full.append((doc_id, text, lang, source, None, "clash", 1, "clash"))
    return spark.createDataFrame(full, DOCS)


def awkward_rows():
    """Nulls, empty and very long texts, ties, repeated rows, copies and near copies."""
    base = prose(1, 150)
    long = prose(2, 30_000)
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "two words here"),
        (7, base), (8, base), (8, base), (9, changed(base, 3, 2)), (10, changed(base, 4, 2)),
        (11, base.upper()), (None, base), (None, "nobody knows this line"), (12, "...\n\n!!!"),
        (13, long), (14, changed(long, 5, 300)), (15, "same line of text\nother A"),
        (16, "  SAME line of text\nother B"), (17, "é" * 300), (18, "é" * 300 + "x"), (19, "a" * 1000),
    ]
    return rows + [(20 + i, changed(base, 100 + i, 3)) for i in range(60)]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_components(rows):
    """(doc_id, set size, component) by comparing all pairs of different sets."""
    sets = [shingles(t) for _, t in rows]
    kinds = sorted({s for s in sets if s}, key=lambda s: sorted(s))
    parent = list(range(len(kinds)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(kinds):
        for j in range(i):
            shared = len(a & kinds[j])
            if 100 * shared >= 80 * len(a | kinds[j]):
                parent[find(i)] = find(j)
    number = {s: find(i) for i, s in enumerate(kinds)}
    lowest = {}
    for (doc_id, _), s in zip(rows, sets):
        if s and doc_id is not None:
            lowest[number[s]] = min(doc_id, lowest.get(number[s], doc_id))
    return Counter((d, len(s), lowest.get(number[s]) if s else d) for (d, _), s in zip(rows, sets))


def brute_repeats(rows, length=200):
    """(doc_id, bytes, removed, spans, hash of the rest) by counting every window."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = Counter()
    for (doc_id, _), b in zip(rows, texts):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        rest = bytes(v for v, g in zip(b, gone) if not g)
        out[(doc_id, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest())] += 1
    return out


def brute_lines(rows):
    """(doc_id, lines, dropped, kept text); rows that share an id are one document."""
    def key(line):
        return line.strip(BLANK).translate(UPPER)

    owners = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            owners.setdefault(key(line), set()).add(doc_id)

    def first(ids):
        known = [i for i in ids if i is not None]
        return min(known) if known else None

    out = Counter()
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [
            x for x in lines
            if len(key(x)) < 10 or len(owners[key(x)]) < 2 or first(owners[key(x)]) == doc_id
        ]
        out[(doc_id, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    return out


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute_contamination(rows, items, n=10):
    windows = {}
    for item_id, text in items:
        w = bench_words(text)
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(item_id)
    out = Counter()
    for doc_id, text in rows:
        w, hit, found = bench_words(text), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                ids = windows.get(tuple(w[i : i + m]))
                if ids:
                    hit.update(range(i, i + m))
                    found |= ids
        names = sorted(str(i) for i in found if i is not None)
        out[(doc_id, len(w), len(hit), tuple(names))] += 1
    return out
