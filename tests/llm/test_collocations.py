import re
from collections import Counter

from pyspark.sql import functions as F

from gableframe.llm import collocations as C
from gableframe.llm import members


def brute(rows, least=30, top=2000):
    """rows of (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    most = Counter()
    for (lang, p), a in f.items():
        if len(p) > 2 and a >= least:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[lang, p[i : i + k]] = max(a, most[lang, p[i : i + k]])
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least and 100 * most[lang, p] < 80 * a:
            cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), a, f[lang, p[:k]], f[lang, p[k:]], score))
    return [
        (lang, i + 1, r[2].decode(), r[3], r[4], r[5], n[lang], r[6])
        for lang in sorted(found)
        for i, r in enumerate(sorted(found[lang])[:top])
    ]


def got(docs, **more):
    return [tuple(r) for r in C.collocations(docs, **more).orderBy("lang", "rank").collect()]


def test_whole_table(documents):
    rows = [(r.lang, r.text) for r in documents.select("lang", "text").collect()]
    want = brute(rows)
    assert len(want) >= 50 and got(documents) == want


def test_ties_and_the_top(spark):
    text = "a b. c d! a b c d\te f, The the The\nthe\x0bthe ß  é;\u0085 x   x"
    rows = [(None, text)] * 3 + [("und", "a b"), ("de", "A B c"), ("de", None), ("", "a b a b a b"), ("fr", "q")] * 2
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert got(docs, least=2) == brute(rows, 2)
    assert got(docs, least=2, top=3) == brute(rows, 2, 3)


def test_odd_rows(edges, edge_rows, nothing):
    rows = [(r[2], r[1]) for r in edge_rows]
    assert got(edges, least=2) == brute(rows, 2)
    assert got(nothing) == []


def test_stripes_are_cut_and_texts_split(documents, monkeypatch):
    """Texts split in short parts, and prefix totals over all segments of a stripe."""
    rows = [(r.lang, r.text) for r in documents.select("lang", "text").collect()]
    monkeypatch.setattr(C, "PIECE", 7)
    body = rows[0][1].encode()
    parts = [w for part in C.tokens(body) for w in part]
    monkeypatch.setattr(C, "PIECE", 1 << 20)
    assert parts == [w for part in C.tokens(body) for w in part]
    totals = {(r.lang, r.phrase): r.n for r in C.stripes(documents, 30, 2)[2].collect()}
    single = Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        single.update((lang or "und", w) for w in re.split(r"[.,;:!?\x0A-\x0D\x20\x09]+", low) if w)
    assert all(totals[k] == t for k, t in single.items() if t >= 30) and any(t >= 30 for t in single.values())


def test_filter_holds_all_members(spark):
    keys = spark.range(0, 5000).selectExpr("xxhash64(id) as key")
    filled = spark.sparkContext.broadcast(members.filter_of(keys.union(spark.sql("select cast(null as long)"))))
    hit = members.may_be_in(F.col("key"), filled)
    assert keys.where(hit).count() == 5000
    strangers = spark.range(5000, 105000).selectExpr("if(id % 10 = 0, null, xxhash64(id)) as key")
    assert strangers.where(hit).count() < 100
