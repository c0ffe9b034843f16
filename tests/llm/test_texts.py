"""Repeated passages, quality rules and mixing against plain statements of them."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from gableframe.llm import mixing, quality, substrings


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def passages(spark):
    """Documents that share passages, within and across, touching and overlapping."""
    rng = random.Random(4)
    pool = [[f"p{k}w{i}" for i in range(rng.randint(15, 70))] for k in range(6)]
    rows = []
    for d in range(60):
        body = []
        for _ in range(rng.randint(0, 5)):
            body += rng.choice(pool) if rng.random() < 0.6 else [f"u{rng.randint(0, 9)}" for _ in range(rng.randint(1, 40))]
        rows.append((d * 7 - 50, rng.choice([" ", "\n", " \t"]).join(body)))
    rows += [(999, "again " * 70), rows[5], (None, rows[6][1])]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("name", ["passages", "edges", "documents", "nothing"])
def test_cut(name, request):
    docs = request.getfixturevalue(name)
    rows = pairs(docs)
    want = sorted(repr((d, n, n - len(k), " ".join(k))) for (d, _), (n, k) in zip(rows, brute.cut(rows), strict=True))
    got = substrings.cut_texts(docs, substrings.repeated_spans(docs)).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in got) == want


def test_small_batches_and_pieces_find_the_same(spark, passages, monkeypatch):
    """Repeats are found between batches as within one, and words across pieces of a text."""
    monkeypatch.setattr(substrings, "PIECE", 7)
    body = "ab cdefghij  k\nlm " * 9 + "é" * 30
    cut_up = substrings.word_hashes(body.encode()).tolist()
    monkeypatch.setattr(substrings, "PIECE", 1 << 20)
    assert substrings.word_hashes(body.encode()).tolist() == cut_up and len(cut_up) == 37
    whole = sorted(map(repr, substrings.repeated_spans(passages).collect()))
    many = passages.repartition(9)
    assert sorted(map(repr, substrings.repeated_spans(many).collect())) == whole


def test_without_repeats_keeps_columns_and_whole_texts(edges, passages):
    kept = substrings.without_repeats(edges)
    assert kept.columns == edges.columns
    rows = pairs(passages)
    want = [
        (d, t if n == len(k) else " ".join(k)) for (d, t), (n, k) in zip(rows, brute.cut(rows), strict=True) if k or not n
    ]
    assert sorted(map(repr, pairs(substrings.without_repeats(passages)))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["edges", "documents", "nothing"])
def test_judge(name, request):
    docs = request.getfixturevalue(name)
    rows = pairs(docs)
    got = sorted(repr(tuple(r)) for r in quality.judge(docs).collect())
    assert got == sorted(repr((d, *brute.judged(t))) for d, t in rows)
    good = quality.keep_good(docs)
    assert good.columns == docs.columns
    assert sorted(map(repr, pairs(good))) == sorted(repr((d, t)) for d, t in rows if brute.judged(t)[-1])


def test_order_of_rules_decides_nothing(documents):
    counts = {quality.keep_good(documents, rules=rules).count() for rules in (quality.RULES, quality.RULES[::-1])}
    assert len(counts) == 1


def test_later_rules_are_not_computed(spark):
    docs = spark.createDataFrame([("one two",)], "text string")
    failing = ("failing", lambda s: F.raise_error(F.lit("computed")).isNotNull())
    found = quality.signals(F.col("text"), quality.words_of(F.col("text")))
    chain = quality.first_rejection([quality.BASE_RULES[0], failing], found)
    assert docs.select(chain.alias("x")).first().x == "few_words"


@pytest.mark.parametrize("name", ["edges", "documents", "nothing"])
def test_mix(name, request):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, r.source, len(brute.words(r.text))) for r in docs.select("doc_id", "source", "text").collect()]
    want = [(d, n, *rest) for (d, _, n), rest in zip(rows, brute.mixed(rows), strict=True)]
    got = [tuple(r) for r in mixing.mix(docs).collect()]
    for a, b in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
        assert a[:3] == b[:3] and a[4] == b[4] and a[3] == pytest.approx(b[3])


def test_many_ranges_cut_alike(documents, monkeypatch):
    whole = sorted(mixing.mix(documents).collect())
    monkeypatch.setattr(mixing, "_range", lambda key, n_rows: F.lit(0).cast("long"))
    assert sorted(mixing.mix(documents).collect()) == whole


@pytest.mark.parametrize("name", ["edges", "documents"])
def test_mixed_rows_hold_the_words_taken(name, request):
    docs = request.getfixturevalue(name)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    taken = {}
    for d, t in pairs(out):
        taken[d] = taken.get(d, 0) + len(brute.words(t))
    want = {}
    for r in mixing.mix(docs).where("taken > 0").collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert taken == want
    texts = {d: brute.words(t) for d, t in pairs(docs)}
    assert all(brute.words(t) == texts[d][: len(brute.words(t))] for d, t in pairs(out) if name == "documents")
