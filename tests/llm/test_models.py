"""Trained operators: held-out accuracy, and brute-force versions of what they compute."""

import math
import random
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gableframe.llm import ctw, langid, licenses, queries, tokencounts, vptree


def test_languages_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op2_language_id(spark, sf).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    aside = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == lang[r.doc_id] for r in aside) / len(aside)
    assert right > 0.97, right
    assert abs(np.mean([r.score for r in aside]) - right) < 0.05


def test_languages_of_odd_rows(edges, nothing, documents):
    for rows in (nothing, edges.where("lang is null")):
        model = langid.train(rows)
        assert {(r.lang_pred, r.score) for r in langid.predict(edges, model).collect()} == {("und", 0.0)}
    model = langid.train(documents)
    found = {r.doc_id: r for r in langid.predict(edges, model).collect()}
    assert [found[i].lang_pred == "und" for i in range(7)] == [True, True, True, False, False, False, False]
    assert langid.predict(nothing, model).count() == 0


def test_pieces_of_a_text_give_its_n_grams(monkeypatch):
    text = "Ab  cdé fgh\nijk" * 5
    whole = Counter(np.concatenate(list(langid.grams(text))).tolist())
    monkeypatch.setattr(langid, "PIECE", 4)
    assert Counter(np.concatenate(list(langid.grams(text))).tolist()) == whole


D = ctw.DEPTH


class PlainTree:
    """Context-tree weighting by its definition, one decision and context at a time."""

    def __init__(self, texts):
        self.n = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for text in texts:
            for context, node, bit in self.steps(text):
                for d in range(D + 1):
                    self.n[d, context[D - d :], node][bit] += 1
                    if d:
                        self.children[d - 1, context[D + 1 - d :], node].add(context[D - d :])

    @staticmethod
    def steps(text):
        b = bytes(D) + text.lower() + b"\xff"
        for i in range(D, len(b)):
            node = 1
            for k in range(7, -1, -1):
                bit = b[i] >> k & 1
                yield b[i - D : i], node, bit
                node = node * 2 + bit

    def estimate(self, at):
        a, b = self.n.get(at, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1), (b + 0.5) / (a + b + 1)

    def weighted(self, d, context, node):
        own = self.estimate((d, context, node))[0]
        if d == D:
            return own
        below = sum(self.weighted(d + 1, c, node) for c in self.children.get((d, context, node), ()))
        return float(np.logaddexp(own, below)) - math.log(2)

    def predict(self, d, context, node):
        """Probability of a one, mixed from this depth on."""
        seen, one = self.estimate((d, context[D - d :], node))
        if d == D:
            return one
        share = math.exp(seen - math.log(2) - self.weighted(d, context[D - d :], node))
        return share * one + (1 - share) * self.predict(d + 1, context, node)

    def log10(self, text):
        return sum(
            math.log10(p if bit else 1 - p) for c, node, bit in self.steps(text) for p in [self.predict(0, c, node)]
        )


def test_context_tree_by_definition(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abA é") for _ in range(rng.randint(0, 40))) for _ in range(12)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").select(F.col("text").cast("binary").alias("body"))
    tree = ctw.train_tree(docs, min_share=0)
    plain = PlainTree([t.encode() for t in texts])
    for text in [*texts[:4], "", "abab", "zé", "ab\x00"]:
        assert tree.log10(text.encode()) == pytest.approx(plain.log10(text.encode()), abs=1e-4)
    probabilities = 10.0 ** tree.table.astype(float)
    assert np.allclose(probabilities.sum(axis=1), 1, atol=1e-4)
    pruned = ctw.train_tree(docs, min_share=0.03)
    assert len(pruned.table) < len(tree.table)
    assert np.allclose((10.0 ** pruned.table.astype(float)).sum(axis=1), 1, atol=1e-4)


def test_pieces_of_a_text_are_scored_as_one(documents, monkeypatch):
    tree = ctw.train_tree(documents.select(F.col("text").cast("binary").alias("body")))
    text = documents.first().text.encode()
    whole = tree.log10(text)
    monkeypatch.setattr(ctw, "PIECE", 10)
    assert tree.log10(text) == pytest.approx(whole) and tree.log10(text[:40]) < 0


def plain_words(rows):
    learnt = [(t or "").encode().lower().split() for d, t in rows if zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2]
    counts = Counter(w for t in learnt for w in t)
    ends, n = len(learnt), sum(counts.values()) + len(learnt)
    bottom = math.log10(n + len(counts) + (ends > 0) + 1)
    for d, t in rows:
        c = [*[counts[w] for w in (t or "").encode().lower().split()], ends]
        yield repr(d), len(c), sum(x > 0 for x in c), n, round(sum(math.log10(x + 1) - bottom for x in c), 5)


@pytest.mark.parametrize("name", ["edges", "documents", "nothing"])
@pytest.mark.parametrize("head", [5, 100_000])
def test_word_model(name, head, request, monkeypatch):
    monkeypatch.setattr(ctw, "HEAD_WORDS", head)
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = ctw.score(docs).collect()
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(plain_words(rows))
    assert all(r.score < 0 and r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 7 == 2) for r in got)


def test_tree_on_held_out_texts(spark):
    """The tree pays for white space and order of bytes, which the word model gets for nothing."""
    rows = ctw.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > 1.05 * sum(r.base_score for r in rows)
    assert np.median([r.bits_per_byte for r in rows]) < 2.6


@pytest.mark.parametrize("head", [5, 3000, 1 << 21])
def test_score_is_that_of_all_contexts(spark, documents, head, monkeypatch):
    """Contexts met once count as well, whether the codes travel with the tasks or are joined."""
    for name, value in (("HEAD_CODES", head), ("CODES_AT_ONCE", 2000), ("RARE_AT_ONCE", 1000), ("PIECE", 500)):
        monkeypatch.setattr(ctw, name, value)
    docs = documents.where("doc_id < 60")
    body = docs.select("doc_id", F.col("text").cast("binary").alias("body"))
    tree = ctw.train_tree(body.where(~ctw.held_out(F.col("doc_id"))), min_share=0)
    want = {r.doc_id: tree.log10(bytes(r.body or b"")) for r in body.collect()}
    got = {r.doc_id: r.score for r in ctw.score(docs).collect()}
    assert got == pytest.approx(want, rel=1e-5)


def dot(x, y):
    total = 0.0  # sum() would compensate for rounding
    for a, b in zip(x, y, strict=True):
        total += a * b
    return total


def plain_nearest(rows):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.all(np.isfinite(v)) and any(v)}
    out = []
    for q in sorted(i for i in good if i % 20 == 0):
        scored = sorted((-dot(good[q].tolist(), good[i].tolist()), i) for i in good if i != q and len(good[i]) == len(good[q]))
        out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:20])]
    return out


def test_nearest_of_the_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = queries.op5_nearest_neighbours(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(plain_nearest(rows))


@pytest.mark.parametrize("leaf,shard", [(2, 7), (128, 20_000)])
def test_nearest_with_ties_and_odd_vectors(spark, leaf, shard, monkeypatch):
    monkeypatch.setattr(vptree, "LEAF", leaf)
    monkeypatch.setattr(vptree, "SHARD", shard)
    monkeypatch.setattr(vptree, "BLOCK", 2)
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(3)]) for i in range(90)]
    rows += [(i, [1.0, 1.0, 0.0]) for i in range(100, 160)]
    rows += [(160, None), (161, []), (162, [0.0, 0.0, 0.0]), (163, [1.0, None, 0.0]), (180, [float("nan"), 0.0, 1.0])]
    rows += [(164, [float("inf"), 0.0, 1.0]), (None, [1.0, 1.0, 1.0]), (200, [1.0, 2.0]), (201, [3.0, 1.0]), (40, rows[40][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vptree.nearest(table).collect())) == sorted(plain_nearest(rows))
    assert vptree.nearest(table.limit(0)).count() == 0


def test_relaxed_search_keeps_most(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    exact = {(r.query_id, r.vec_id) for r in vptree.nearest(table).collect()}
    near = {(r.query_id, r.vec_id) for r in vptree.nearest(table, factor=1.2).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_licences(spark, documents, edges, nothing):
    scanner = licenses.train(documents)
    planted = {
        "Apache License, Version 2.0": "Apache-2.0", "the MIT License": "MIT", "GNU General Public License": "GPL", "CC BY-NC 4.0": "CC-BY-NC",
    }
    want = {r.doc_id: {f for k, f in planted.items() if k in r.text} for r in documents.collect()}
    got = {r.doc_id: r for r in licenses.scan(documents, scanner).collect()}
    assert all(set(filter(None, got[d].licenses.split(","))) == f for d, f in want.items())
    assert {(r.licenses, r.n_paragraphs, r.score) for r in licenses.scan(edges, scanner).collect()} == {("", 0, None)}
    assert licenses.scan(nothing, scanner).count() == 0
    text = "Preface.\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files\nend"
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), scanner).first()
    assert row.licenses == "MIT" and row.n_paragraphs == 1
    assert licenses.scan(edges, licenses.train(nothing)).where("n_paragraphs > 0").count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions"""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""


def test_licences_across_lines(spark, documents):
    rng = random.Random(4)
    prose = [w for r in documents.limit(20).collect() for w in (r.text or "").split() if w.isalpha()]

    def filler(n):
        return " ".join(rng.choice(prose) for _ in range(n))

    texts, want = [], []
    for family, notice in (("MIT", MIT), ("BSD", BSD), ("GPL", GPL)):
        for width in (50, 72, 80):
            for mark in ("", "# ", " * ", "// ", "% ", "rem "):
                lines = "\n".join(mark + x for x in textwrap.wrap(notice, width))
                texts.append(f"{filler(30)}\n\n{lines}\n\n{filler(30)}")
                want.append(family)
        texts.append(f"{filler(200)} {' '.join(notice.split())} {filler(200)}")
        want.append(family)
    others = ("Licensed under CC BY-SA 4.0", "This work is licensed under the GNU Lesser General Public License, version 3",
              "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License")
    for notice in others:
        texts.append(f"{filler(30)}\n{notice}\n{filler(30)}")
        want.append("unknown")
    texts += [filler(300), "He lost the driving license and the copyright in 1990."]
    want += ["", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.n_paragraphs) for r in licenses.scan(docs, licenses.train(documents)).collect()}
    assert [(i, got[i][0]) for i in range(len(want))] == list(enumerate(want))


def test_tokens_of_sections_add_up(documents, edges, nothing):
    path, pattern = queries.BYTE_BPE, queries.public_tokenizers.PATTERN
    codec = tokencounts.encoding(path, pattern)[0]
    for docs in (documents, edges):
        rows = docs.select("doc_id", "source", "text").collect()
        for rule in tokencounts.RULES:
            got = tokencounts.tokens_per_section(docs, path, pattern, rule, fields=("source", "text")).collect()
            total, chars = Counter(), Counter()
            for r in got:
                total[r.doc_id] += r.n_tokens
                chars[r.doc_id] += r.n_chars
            want, length = Counter(), Counter()
            for r in rows:
                whole = f"{r.source or ''}\n{r.text or ''}"
                want[r.doc_id] += len(codec.encode_ordinary(whole))
                length[r.doc_id] += len(whole)
            assert chars == length and all(total[d] == pytest.approx(want[d]) for d in want)
    assert tokencounts.tokens_per_section(nothing, path, pattern).count() == 0


def test_rules_for_tokens_that_cross():
    starts, ends, edges = np.array([0, 2, 9]), np.array([2, 9, 10]), np.array([0, 3, 8, 10])
    got = {rule: tokencounts.attribute(starts, ends, edges, rule) for rule in tokencounts.RULES}
    assert got["first"][0].tolist() == [2, 0, 1] and got["most"][0].tolist() == [1, 1, 1]
    assert got["share"][0].tolist() == pytest.approx([1 + 1 / 7, 5 / 7, 1 + 1 / 7])
    assert got["most"][1].tolist() == [1, 1, 1]
