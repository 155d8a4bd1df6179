"""Brute-force versions of the two substring operators."""

import hashlib
import re
from collections import defaultdict


def repeated_words(rows, window):
    """(n_words, n_removed, sha256) per row."""
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = defaultdict(int)
    for w in texts:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i:i + window])] += 1
    out = []
    for w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def repeated_bytes(rows, window):
    """(n_bytes, n_removed, n_spans, sha256) per row."""
    data = [(-1 if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for key, d in data:
        for i in range(len(d) - window + 1):
            s = d[i:i + window]
            least[s] = min(least.get(s, key), key)
    out = []
    for key, d in data:
        end, spans, kept = 0, [], bytearray(len(d))
        for i in range(len(d) - window + 1):
            if least[d[i:i + window]] < key:
                if i > end or not spans:
                    spans.append([i, i + window])
                spans[-1][1] = end = i + window
        for a, b in spans:
            kept[a:b] = b"\1" * (b - a)
        left = bytes(c for c, k in zip(d, kept) if not k)
        out.append((len(d), len(d) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
    return out
