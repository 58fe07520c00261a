"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: str | None, k: int) -> frozenset:
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(rows: list[tuple], k: int, share: int, of: int) -> list[tuple[int, int]]:
    """(set size, least key of the component) of each (key, text) row; null keys name nothing."""
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and of * len(x & y) >= share * len(x | y):
                parent[root(i)] = root(j)
    least: dict[int, int | None] = {}
    for i, (key, _) in enumerate(rows):
        r = root(i)
        known = least.get(r)
        least[r] = key if known is None else known if key is None else min(known, key)
    return [(len(s), least[root(i)] if s else rows[i][0]) for i, s in enumerate(sets)]


def source_targets(sizes: dict[str | None, int], weights=(3, 1, 2), share=1.5, most=2.0) -> dict[str | None, float]:
    """Water filling: what is over a source's bound goes to the others by weight."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    free, left = set(order), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total >= most * sizes[s]]
        if not over:
            for s in free:
                out[s] = left * weight[s] / total
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def first_merge_encode(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merges the leftmost pair of the lowest rank until none is left."""
    while True:
        pairs = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        if not pairs:
            return symbols
        _, i = min(pairs)
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]


def edit_distance_at_most_one(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def best_products(rows: list[tuple[int, list[float]]], queries: list[int], k: int) -> dict[int, list[tuple[int, float]]]:
    out = defaultdict(list)
    for q, v in rows:
        if q in queries:
            found = [(-sum(x * y for x, y in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return dict(out)


def fewest_bins(sizes, capacity):
    """Fewest bins by trying every place for every size."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room + sizes[i] <= capacity:
                at = bins.index(room)
                put(i + 1, [*bins[:at], room + sizes[i], *bins[at + 1 :]])
        put(i + 1, [*bins, sizes[i]])

    put(0, [])
    return best[0]


def periodic_runs(words, least_words, least_exponent):
    """Runs by comparing words at every distance; a period that a smaller one explains is dropped."""
    n, out = len(words), []
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least_words, least_exponent * q):
                part = words[i : i + length]
                if not any(part[r:] == part[:-r] for r in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def hard_negatives(rows, is_anchor, positives, negatives, low, high):
    out = []
    for a, label, v in rows:
        if not is_anchor(a):
            continue
        scored = [(sum(int(x) * int(y) for x, y in zip(v, w, strict=True)), i, other) for i, other, w in rows if i != a and len(w) == len(v)]
        best = sorted((-s, i) for s, i, other in scored if other == label)[:positives]
        for s, i in best:
            fit = sorted((-t, j) for t, j, other in scored if other != label and -low * s <= 100 * t <= -high * s)[:negatives]
            out += [(a, i, rank, j, -s, -t) for rank, (t, j) in enumerate(fit, 1)]
    return out
