"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import xxhash

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))


def shingles(text, size):
    w = words(text)
    return [" ".join(w)] if 0 < len(w) <= size else [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)]


def simhash(text):
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(ids, linked):
    """Smallest id of each component; ``linked(i, j)`` on positions."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)].append(ids[i])
    return [min(least[find(i)], default=None) for i in range(len(ids))]


def leaks(docs, items, size=5, least=0.8):
    """``{(doc, item): containment}``; items of equal shingles under the smallest id."""
    sets = defaultdict(list)
    for key, text in items:
        if s := frozenset(shingles(text, size)):
            sets[s].append(key)
    out = {}
    for key, text in docs:
        have = set(shingles(text, size))
        for s, keys in sets.items():
            if len(have & s) / len(s) >= least:
                out[key, min(keys)] = len(have & s) / len(s)
    return out


def without_common_lines(rows, min_docs):
    """``[(id, n_lines, n_dropped, kept text)]``."""
    blank = " \t\n\x0b\f\r"
    split = [(key, (text or "").split("\n")) for key, text in rows]
    seen = Counter(k for _, lines in split for k in {line.strip(blank).translate(UP) for line in lines} if k)
    out = []
    for key, lines in split:
        kept = [line for line in lines if seen[line.strip(blank).translate(UP)] < min_docs]
        out.append((key, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def slots(names, size, number):
    """Lookup table by explicit preference lists."""
    order = []
    for name in names:
        start, step = number(f"start/{name}") % size, number(f"step/{name}") % (size - 1) + 1
        order.append([(start + i * step) % size for i in range(size)])
    table, turn = {}, 0
    while len(table) < size:
        prefer = order[turn % len(names)]
        table[next(s for s in prefer if s not in table)] = turn % len(names)
        turn += 1
    return [table[i] for i in range(size)]


def targets(sizes, weights, most):
    """Share by weight; stop at the cap; share the excess again until none is above."""
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    out, left = {}, sum(sizes.values())
    open_ = list(names)
    while open_:
        total = sum(weight[n] for n in open_)
        over = [n for n in open_ if left * weight[n] / total > most * sizes[n]]
        if not over:
            return out | {n: left * weight[n] / total for n in open_}
        for n in over:
            out[n] = float(most * sizes[n])
            open_.remove(n)
        left = sum(sizes.values()) - sum(out.values())
    return out
