"""Sequential matching inside one page: one-to-one assignment, edge-sorted families, repeated discovery."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pandas as pd


def assign(pairs: pd.DataFrame) -> pd.DataFrame:
    """One-to-one pairs (a, b) with as many pairs as possible: augmenting paths, candidates in order of cost then b.

    pairs: a, b, cost. Left rows are taken in order of a.
    """
    options = {a: list(g.sort_values(["cost", "b"])["b"]) for a, g in pairs.groupby("a", sort=True)}
    owner: dict = {}

    def place(a, tried: set) -> bool:
        for b in options[a]:
            if b not in tried:
                tried.add(b)
                if b not in owner or place(owner[b], tried):
                    owner[b] = a
                    return True
        return False

    for a in sorted(options):
        place(a, set())
    return pd.DataFrame(sorted((a, b) for b, a in owner.items()), columns=["a", "b"])


def families(values: pd.DataFrame, limit: float) -> pd.DataFrame:
    """Complete-link families by edges from near to far: two families join if all their values stay within limit.

    values: key, value. Families of one row are dropped; they are numbered by their least key.
    """
    v = values.sort_values(["value", "key"])
    keys, x = list(v["key"]), list(v["value"])
    # joining only neighbours in value order is enough: a wider pair has a wider spread. A part is known by its first
    # row; last, after and before tell its last row, the next part and the one before
    last, after, before = list(range(len(x))), [*range(1, len(x)), None], [None, *range(len(x) - 1)]
    queue = [(x[i + 1] - x[i], i, i + 1, i + 1) for i in range(len(x) - 1)]
    heapify(queue)
    gone: set[int] = set()
    while queue and queue[0][0] <= limit:
        _, a, b, end = heappop(queue)
        if a in gone or b in gone or after[a] != b or last[b] != end:
            continue
        last[a], after[a] = last[b], after[b]
        gone.add(b)
        if after[a] is not None:
            before[after[a]] = a
            heappush(queue, (x[last[after[a]]] - x[a], a, after[a], last[after[a]]))
        if before[a] is not None:
            heappush(queue, (x[last[a]] - x[before[a]], before[a], a, last[a]))
    groups = sorted(sorted(keys[a : last[a] + 1]) for a in range(len(x)) if a not in gone and last[a] > a)
    return pd.DataFrame([(k, n) for n, g in enumerate(groups) for k in g], columns=["key", "family"])


def discover(atoms: pd.DataFrame, least: int) -> pd.DataFrame:
    """Again and again the motif with the most free atoms (ties: the smaller motif) takes them, while it has at least `least`.

    atoms: atom, motifs (list). Result: atom, motif, turn.
    """
    free = {a: set(m) for a, m in zip(atoms["atom"], atoms["motifs"], strict=True)}
    out, turn = [], 0
    while True:
        count: dict = {}
        for motifs in free.values():
            for m in motifs:
                count[m] = count.get(m, 0) + 1
        best = min(count, key=lambda m: (-count[m], m), default=None)
        if best is None or count[best] < least:
            return pd.DataFrame(out, columns=["atom", "motif", "turn"])
        taken = sorted(a for a, m in free.items() if best in m)
        out += [(a, best, turn) for a in taken]
        for a in taken:
            del free[a]
        turn += 1
