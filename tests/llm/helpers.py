"""Brute-force versions and small fixtures."""

from __future__ import annotations

import random
import re
import zlib

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def fold(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def classes(nodes, links):
    """Smallest node reachable from each node."""
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def texts(n, seed=1):
    """Invented texts: copies, near copies, shared passages, odd characters, empty and null ones."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    out: list[str | None] = [None, "", "  \n", "one", "one two", "One\ttwo", "x" * 30_000]
    while len(out) < n:
        kind = rng.random()
        if kind < 0.3 and len(out) > 10:
            base = (rng.choice(out[7:]) or "a b c d").split(" ")
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = rng.choice(words)
            out.append(" ".join(base))
        else:
            own = [rng.choice(words) for _ in range(rng.randint(1, 90))]
            out.append(" ".join(own + ([passage] if kind < 0.5 else [])) + rng.choice(["", ".", "\n", " !!"]))
    return out


def documents(spark, rows, extra=True):
    """documents with clashing extra columns: rows of (doc_id, text) or (doc_id, text, source)."""
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (", score double, n long, token string, rep long, gid long, label string, h long, kept_text string, row_key long" if extra else "")
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src1", len(r[1] or "")) + ((0.5, 1, "t", 2, 3, "l", 4, "k", 5) if extra else ()) for r in rows]
    return spark.createDataFrame(full, schema)
