"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict


def jaccard_components(docs):
    """docs: (doc_id, text); -> {row: (doc_id, n_shingles, component_id)}."""
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in where[x]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        ids[find(i)].append(d)
    return [(d, len(sets[i]), min(ids[find(i)])) for i, (d, _) in enumerate(docs)]


def remove_repeats(docs, span):
    raws = [(t or "").encode() for _, t in docs]
    seen = defaultdict(int)
    for r in raws:
        for i in range(len(r) - span + 1):
            seen[r[i : i + span]] += 1
    out = []
    for (d, _), r in zip(docs, raws, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - span + 1):
            if seen[r[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out
