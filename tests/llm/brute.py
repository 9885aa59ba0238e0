"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import re

import numpy as np
import pandas as pd

DDL = "doc_id long, text string, lang string, source string, n_chars long, block string, rep long, c0 string"


def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, names that clash with the operators' own."""
    base = " ".join(f"word{i}" for i in range(60))
    texts = [
        (1, base, "en"), (2, base, "en"), (3, base + " more", "en"), (4, base.upper(), "de"), (5, None, "fr"), (6, "", None), (7, "é", "fr"), (8, " \t\n", "en"), (9, "12 34 !?", "en"),
        (10, "ab" * 9000, "en"), (11, "x" * 49 + base[:120], "en"), (12, base[3:90] + "ö" + base[200:], "de"), (13, base[:40], "de"), (14, "one two three", None), (15, "ONE two  three", "en"), (15, "ONE two  three", "en"), (None, base[:200], "en"), (17, "ä" * 60 + "ö", "de"), (18, "ü" + "ä" * 60, "de"),
    ]
    rows = [(i, t, lang, None if i == 3 else f"src{(i or 0) % 12}", None if t is None else len(t), "b", 3, "c") for i, t, lang in texts]
    return spark.createDataFrame(rows, DDL)


def empty_documents(spark):
    return spark.createDataFrame([], DDL)


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def repeats(rows, length=50):
    first = {}
    low = float("-inf")
    order = sorted(((low if i is None else i), t.encode()) for i, t in rows)
    for i, b in order:
        for j in range(len(b) - length + 1):
            first.setdefault(b[j : j + length], i)
    out = []
    for i, b in order:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if first[b[j : j + length]] < i:
                gone[j : j + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((None if i == low else i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
    return {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def jaccard(rows, k, percent):
    """Rows are the nodes; (id, set size, smallest id of the component, links, place of the component's first row)."""
    low = float("-inf")
    order = sorted(range(len(rows)), key=lambda a: (low if rows[a][0] is None else rows[a][0], rows[a][1]))
    rows = [rows[a] for a in order]
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))
    links = collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(
        ((rows[a][0], len(sets[a]), rows[find(a)][0], links[a]) for a in range(len(rows))), key=str
    ), [rows[a] for a in range(len(rows)) if find(a) == a]


def plain(df):
    pdf = df.toPandas()
    return sorted(
        (
            tuple(
                None if not isinstance(x, list) and pd.isna(x) else int(x) if isinstance(x, float) and x == int(x) else x for x in r
            ) for r in pdf.itertuples(index=False, name=None)
        ),
        key=str
    )


def bands(fp, n, width):
    """The bands of a fingerprint that say something, on both of its scales."""
    scale, samples = int(fp[:2], 16), (len(fp) - 2) // 4
    parts = {(scale - s, b): fp[2 + 2 * (samples * s + b * width) :][: 2 * width] for s in (0, 1) for b in range(n)}
    return {(*k, v) for k, v in parts.items() if v.strip("0")}


def fingerprint(text, seed=0, classes=64, period=1 << 16, samples=128):
    """One step of the walk at a time: at output step i the character under the pointer is written, and a shared bit says whether the pointer moves on."""
    if seed not in _bits:
        _bits[seed] = np.random.default_rng(20240229 + seed).integers(
            0, 2, (classes, period), dtype=np.uint8
        ).tolist(), np.random.default_rng(7919 + seed).random(samples)
    bits, places = _bits[seed]
    points, written, at = [ord(c) for c in text], [], 0
    while at < len(points):
        written.append(points[at])
        at += bits[(points[at] * 2654435769 % 2**32) >> 26][(len(written) - 1) % period]
    scale = max(6, (2 * len(points)).bit_length())
    out = bytes([scale])
    for s in (scale, scale - 1):
        for place in places:
            i = int(place * 2**s)
            out += bytes([1 + ((written[i] * 2246822519 % 2**32) >> 16) % 255 if i < len(written) else 0])
    return out.hex()


_bits = {}
