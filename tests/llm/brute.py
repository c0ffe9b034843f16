"""Plain statements of the contracts, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import regex

SPACES = r"[\x20\x09-\x0D]+"


def words(text):
    return [w for w in re.split(SPACES, text or "") if w]


def cut(rows, window=20):
    """rows of (id, text) -> per row (n_words, kept words)."""
    first = {}
    key = lambda d: -(2**63) if d is None else d
    split = [(key(d), words(t)) for d, t in rows]
    for d, w in split:
        for s in range(len(w) - window + 1):
            at = first.setdefault(tuple(w[s : s + window]), (d, s))
            first[tuple(w[s : s + window])] = min(at, (d, s))
    gone = defaultdict(set)
    for d, w in split:
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (d, s):
                gone[d] |= set(range(s, s + window))
    return [(len(w), [x for i, x in enumerate(w) if i not in gone[d]]) for d, w in split]


def judged(text):
    w, body = words(text), text or ""
    lines = [x for x in body.split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {i + j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(8)}
    n, chars, symbols = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in body)
    dup = len(lines) - len(set(lines))
    failed = n < 20 or 100 * len(again) > 30 * n
    fine = 10 * symbols <= 2 * n and 100 * dup <= 50 * len(lines) and 2 * n <= chars <= 12 * n
    letters = sum(bool(regex.search(r"\p{L}", x)) for x in w)
    return n, chars, symbols, dup, len(again), failed, not failed and fine and 100 * letters >= 50 * n


def mixed(rows):
    """rows of (id, source, size) -> per row (source_size, target, taken). Equal rows share a cut evenly."""
    total, n = defaultdict(int), len(rows)
    for _, source, size in rows:
        total[source] += size
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = 1.5 * sum(total.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > 2 * total[s]}
        for s in over or open_:
            target[s] = 2.0 * total[s] if over else unit * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    key = lambda d: int(hashlib.md5(f"mix:{'' if d is None else d}".encode()).hexdigest()[:15], 16)
    groups = Counter(rows)
    taken = {}
    for source in order:
        if not total[source]:
            continue
        rounds, rest = divmod(int(target[source]), total[source])
        for row in sorted((r for r in groups if r[1] == source), key=lambda r: (key(r[0]), r[0] is not None, r[0] or 0, r[2])):
            give = min(rest, row[2] * groups[row])
            taken[row] = rounds * row[2] + give // groups[row]
            rest -= give
    assert n == len(rows)
    return [(total[r[1]], target[r[1]], taken.get(r, 0)) for r in rows]
