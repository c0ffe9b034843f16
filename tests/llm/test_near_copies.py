import random
from collections import defaultdict

import xxhash

from gableframe.llm import simhash
from gableframe.llm.components import components


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    """Least member reachable over all pairs within three bits."""
    values, root = list(values), {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def brute(rows):
    prints = [(d, brute_fingerprint(t)) for d, t in rows]
    root = brute_components({p for _, p in prints})
    least = defaultdict(list)
    for d, p in prints:
        least[root[p]].append(d)
    return sorted(
        (repr(d), f"{p:016x}", min((x for x in least[root[p]] if x is not None), default=None)) for d, p in prints
    )


def result(docs):
    return sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_copies(docs).collect())


def test_whole_table(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert result(documents) == brute(rows)


def test_odd_rows(edges, edge_rows):
    assert result(edges) == brute([(r[0], r[1]) for r in edge_rows])


def test_no_rows(nothing):
    assert result(nothing) == []
    assert simhash.one_per_group(nothing).count() == 0


def test_one_row_of_each_group_stays(edges, documents):
    kept = simhash.one_per_group(edges)
    assert kept.columns == edges.columns
    groups = {r.component_id for r in simhash.near_copies(edges).collect()}
    assert kept.count() == len(groups)
    want = {r.component_id for r in simhash.near_copies(documents).collect()}
    assert sorted(r.doc_id for r in simhash.one_per_group(documents).collect()) == sorted(want)


def signed(v):
    return v - 2**64 if v >= 2**63 else v


def test_links_of_dense_cells_connect_as_all_pairs_do(spark):
    """A cloud of values a few bits apart, by pairs and by midpoints."""
    rng = random.Random(3)
    cloud = {0}
    while len(cloud) < 260:
        cloud.add(rng.choice(list(cloud)) ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 5, 7]))))
    cloud |= {rng.getrandbits(64) for _ in range(40)}
    want = defaultdict(set)
    for v, root in brute_components(cloud).items():
        want[root].add(signed(v))
    values = spark.createDataFrame([(signed(v),) for v in cloud], "fp long")
    for dense in (2, 10_000):
        got = defaultdict(set)
        for r in components(simhash.links(values, dense=dense)).collect():
            got[r.root].add(r.node)
        assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000 - i, 5000) for i in range(50)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 951 for i in [*range(951, 1001), 5000]}
