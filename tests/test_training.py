"""Tokens, sampling, rendering, XML, tagging and scores."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gableframe.functions import tokens as T
from gableframe.operators import labelling as L
from gableframe.operators import sampling as S
from gableframe.operators import scoring as R
from gableframe.plans import rendering as X
from gableframe.schema import RENDER_LABELS

COUNTIES = ["WEST SUSSEX", "SUSSEX", "SOMERSET", "GLOUCESTERSHIRE", "AVON", "YNYS MÔN", "TYNE & WEAR", "KENT", "POWYS"]
SYNONYMS = {"RD": "ROAD", "APT": "APARTMENT", "GLOS": "GLOUCESTERSHIRE", "A-RD": "A ROAD"}
TEXTS = [
    "flat 25 willowbrook drive GL510pu cheltenham gloucestershire",
    "5 somerset",
    "Bradford on Avon, Avon",
    "dinas powys powys",
    "Sussex House, West Sussex rd",
    "12 - 14 high st / 3/2 to let 5 TO 9, in kent co road",
    "kentish town, KENT UNIVERSITY",
    "The Mill (rear), 3a-5b A-RD; tyne & wear #4",
    "ynys môn 7",
    "1 glos way glos",
    "stratford upon avon",
    "back\\slash IN CO - end.",
    "",
    None,
]


def remove(text):
    """County removal said in Python, letter by letter as the rule states it."""
    keep = sorted({*T.KEPT_BEFORE, *T.COMPANY, *T.FLAT, *T.RESIDENTIAL, *T.ROAD})
    out, i = "", 0
    while i < len(text):
        hit = next((c for c in COUNTIES if text.startswith(c, i)), None)
        # Of the names that fit here the first whose surroundings allow removal is taken.
        for c in (c for c in COUNTIES if text.startswith(c, i)):
            after = text[i + len(c) :]
            before = re.search(r"\b(ON|DINAS|UPON|[0-9])\s$", text[:i])
            if not before and not re.match(r"\s(" + "|".join(keep) + r")\b", after):
                hit = c
                break
        else:
            hit = None
        if hit:
            i += len(hit)
        else:
            out += text[i]
            i += 1
    return out


def tokens_of(text):
    s = remove((text or "").upper())
    s = re.sub(r"(\d+[A-Z]?) *- *(\d+[A-Z]?)", r"\1-\2", s)
    s = re.sub(r"(\d+)/(\d+)", r"\1-\2", s)
    s = re.sub(r"(\d+) *TO *(\d+)", r"\1-\2", s)
    for piece in (" IN ", " CO ", " - ", ",", "\\"):
        s = s.replace(piece, " ")
    s = remove(" ".join(SYNONYMS.get(w, w) for w in s.split()))
    return re.findall(r"\(*\b[^\s,;#&()]+[.,;)\n]*|[#&]", s)


def test_tokenize_matches_python(spark):
    lookups = T.Lookups(counties=COUNTIES, synonyms=SYNONYMS)
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    rows = df.select(
        "t", T.tokenize(F.col("t"), lookups).alias("tokens"), T.remove_counties(F.upper("t"), COUNTIES).alias("rest")
    ).collect()
    for r in rows:
        assert r.tokens == tokens_of(r.t), r.t
        if r.t is not None:
            assert r.rest == remove(r.t.upper()), r.t
    assert rows[0].tokens == ["FLAT", "25", "WILLOWBROOK", "DRIVE", "GL510PU", "CHELTENHAM"]
    assert "AVON" in rows[2].tokens and rows[2].tokens.count("AVON") == 1


def test_features(spark):
    df = spark.createDataFrame([(["FLAT", "25", "WILLOWBROOK", "dr.", "GL510PU"],), (["X"],), ([],)], "tokens array<string>")
    lookups = T.Lookups(outcodes=["GL510PU"])
    full, single, empty = [r.features for r in T.sequence_features(df, "tokens", lookups).collect()]
    own = [f.own for f in full]
    assert [o.digits for o in own] == ["no_digits", "all_digits", "no_digits", "no_digits", "some_digits"]
    assert [o.word for o in own] == ["FLAT", None, "WILLOWBROOK", "DR.", "GL510PU"]
    assert [o.length for o in own] == ["w:4", "d:2", "w:11", "w:3", "w:7"]
    assert [o.endsinpunc for o in own] == [None, None, None, ".", None]
    assert own[0].flat and not own[1].flat and own[4].outcode and not own[1].has_vowels
    assert full[0].previous is None and full[0].rawstring_start and full[1].previous_is_start
    assert full[1].previous == own[0] and full[1].next == own[2]
    assert full[4].rawstring_end and full[4].next is None and full[3].next_is_end
    assert single[0].singleton and not single[0].rawstring_start and empty == []


def reference_sample(rows, n, seed):
    import hashlib

    draw = {k: hashlib.md5(f"{seed}|{k}".encode()).hexdigest() for k, _ in rows}
    strata = sorted({s for _, s in rows})
    quota = max(1, n // len(strata))
    first, rest = [], []
    for s in strata:
        ks = sorted((k for k, x in rows if x == s), key=draw.get)
        first += ks[:quota]
        rest += ks[quota:]
    return set((sorted(first, key=draw.get) + sorted(rest, key=draw.get))[:n])


@pytest.mark.parametrize("n", [1, 3, 40, 333, 999, 1000, 5000])
def test_balanced_sample(spark, n):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, s string")
    got = [r.k for r in S.balanced_sample(df.repartition(5), n, "k", F.col("s"), 1).collect()]
    assert len(got) == len(set(got)) and set(got) == reference_sample(rows, n, 1)


def test_random_subset_and_split_do_not_depend_on_partitions(spark):
    df = spark.range(700)
    a = {r.id for r in S.random_subset(df, 50, "id").collect()}
    assert len(a) == 50 and a == {r.id for r in S.random_subset(df.repartition(9), 50, "id").collect()}
    assert S.random_subset(df, 0, "id").count() == 0 and S.random_subset(df, 9999, "id").count() == 700
    split = {r.id: r.split for r in S.train_holdout(df, "id", 0.2).collect()}
    assert split == {r.id: r.split for r in S.train_holdout(df.repartition(5), "id", 0.2).collect()}
    assert 0.1 < sum(v == "test" for v in split.values()) / 700 < 0.3


FIELDS = ["id", "property_type", "BuildingName", "BuildingNumber", "SubBuildingName", "StreetName", "Locality", "TownName", "Postcode", "Outcode", "Incode"]


@pytest.fixture(scope="module")
def addresses(spark):
    rows = []
    for i, (name, number, sub, street, place) in enumerate(
        itertools.product(["ROSE HALL", None], ["12.0", None], ["FLAT 3", ""], ["HIGH STREET", None], ["HAM", None])
    ):
        for j in range(4):
            rows.append((f"{i}-{j}", "F" if sub else "D", name, number, sub, street, place, "TOWN & CO", "GL1 1AA", "GL1", "1AA"))
    return spark.createDataFrame(rows, ", ".join(f"{f} string" for f in FIELDS))


@pytest.mark.parametrize("realistic", [True, False])
def test_rendering_keeps_all_tokens(addresses, realistic):
    for r in X.render_labelled(addresses, "id", 1, realistic).collect():
        want = sorted(
            (t, n) for n in RENDER_LABELS for t in (["GL1", "1AA"] if n == "Postcode" else (r[n] or "").replace("12.0", "12").split())
        )
        assert sorted((p.token, p.label) for p in r.labelled) == want
        assert [p.label for p in r.labelled][-2:] == ["Postcode", "Postcode"]
        labels = [k for k, _ in itertools.groupby(p.label for p in r.labelled)]
        assert len(labels) == len(set(labels))


def test_xml_shards_are_whole_documents(spark, addresses, tmp_path):
    from xml.etree import ElementTree

    rendered = S.train_holdout(X.render_labelled(addresses, "id", 1), "id", 0.3, 1)
    X.write_labelled_xml(rendered, str(tmp_path / "xml"), "id", rows_per_shard=25)
    files = sorted((tmp_path / "xml").rglob("*.txt"))
    sizes = {}
    for f in files:
        root = ElementTree.parse(f).getroot()
        assert root.tag == "AddressCollection"
        sizes.setdefault(f.parent.parent.name, []).append(len(root))
    counts = {f"split={r.split}": r.n for r in S.group_counts(rendered, "split").collect()}
    for split, n in counts.items():
        assert sorted(sizes[split], reverse=True) == [25] * (n // 25) + ([n % 25] if n % 25 else [])
    back = X.read_labelled_xml(spark, str(tmp_path / "xml"))
    want = sorted(str([(p.token, p.label) for p in r.labelled]) for r in rendered.collect())
    assert sorted(str([(p.token, p.label) for p in r.labelled]) for r in back.collect()) == want


def test_best_path_is_the_best_of_all_paths():
    rng = np.random.default_rng(5)
    k, sizes = 3, np.array([1, 2, 4, 4])
    emit, moves = rng.normal(size=(4, 4, k)), rng.normal(size=(k + 1, k))
    path, marginal, whole = L.best_path(emit, moves, sizes)
    for i, n in enumerate(sizes):
        scores = {}
        for labels in itertools.product(range(k), repeat=int(n)):
            before = [k, *labels[:-1]]
            scores[labels] = sum(moves[b, a] + emit[i, t, a] for t, (b, a) in enumerate(zip(before, labels)))
        total = np.logaddexp.reduce(list(scores.values()))
        best = max(scores, key=scores.get)
        assert tuple(path[i, :n]) == best
        assert whole[i] == pytest.approx(np.exp(scores[best] - total))
        for t in range(n):
            want = sum(np.exp(s - total) for labels, s in scores.items() if labels[t] == best[t])
            assert marginal[i, t] == pytest.approx(want)


@pytest.fixture(scope="module")
def counts(addresses):
    return L.fit_labels(X.render_labelled(addresses, "id", 1), labels=RENDER_LABELS)


def test_counts(counts, addresses):
    rows = X.render_labelled(addresses, "id", 1).collect()
    assert counts.transitions.sum() == sum(len(r.labelled) for r in rows)
    assert counts.label_totals.sum() == counts.transitions.sum()
    words = {r.word: r.asDict() for r in counts.words.collect()}
    assert words["ROSE"]["BuildingName"] == sum(r.BuildingName is not None for r in rows)


def test_tagging(spark, counts):
    df = spark.createDataFrame([("a", "FLAT 3 ROSE HALL HIGH STREET TOWN GL1 1AA"), ("b", ""), ("c", None), ("d", "ZZZ")], "id string, t string")
    got = {r.id: r.tagged for r in L.tag_text(df, "t", counts).collect()}
    assert [p.label for p in got["a"].pairs] == ["SubBuildingName"] * 2 + ["BuildingName"] * 2 + ["StreetName"] * 2 + ["TownName"] + ["Postcode"] * 2
    assert got["b"].pairs == [] and got["c"].pairs == [] and got["b"].sequence_probability == 0.0
    assert len(got["d"].pairs) == 1
    assert all(0 < p.marginal <= 1 + 1e-9 for p in got["a"].pairs) and 0 < got["a"].sequence_probability <= 1


def test_joined_words_give_the_same_tags(spark, counts, addresses):
    df = X.render_labelled(addresses, "id", 1).select("id", F.transform("labelled", lambda p: p["token"]).alias("g"))
    a = {r.id: r.tagged for r in L.tag_tokens(df, "g", counts).collect()}
    b = {r.id: r.tagged for r in L.tag_tokens(df, "g", counts, head_words=0).collect()}
    c = {r.id: r.tagged for r in L.tag_tokens(df, "g", counts, head_words=3).collect()}
    assert b == c
    for k, x in a.items():
        assert [p.label for p in x.pairs] == [p.label for p in b[k].pairs]
        assert [p.marginal for p in x.pairs] == pytest.approx([p.marginal for p in b[k].pairs])


def test_rows_with_null_or_repeated_keys_are_tagged_alike(spark, counts):
    line = "FLAT 3 ROSE HALL HIGH STREET TOWN GL1 1AA"
    df = spark.createDataFrame([("a", line), ("a", line), (None, line), ("a", "HIGH STREET")], "id string, t string")
    for head in (0, 5, 1000):
        got = [(r.id, [p.label for p in r.tagged.pairs]) for r in L.tag_text(df, "t", counts, head_words=head).collect()]
        assert sorted(len(g[1]) for g in got) == [2, 9, 9, 9]
        assert len({tuple(g[1]) for g in got if len(g[1]) == 9}) == 1


def test_shape_in_workers_is_that_of_the_columns(spark):
    tokens = ["12", "12A", "rose", "St.", "FLAT", "12-14", "é1)", "ß", "x" * 30, "GL1", "north", ",", "TOWN", "1\n", "٣"]
    own = L.Lookups(outcodes=("GL1",), posttowns=("TOWN",))
    df = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", L.shape_of(F.col("t"), own).alias("s"))
    assert {r.t: r.s for r in df.collect()} == {t: L.shape_text(t, own) for t in tokens}


def test_components(spark):
    df = spark.createDataFrame([([("FLAT", "S"), ("3,", "S"), ("HIGH", "R"), ("ST;", "R")],), ([],)], "p array<struct<token:string,label:string>>")
    got = [r.y for r in df.select(L.components(F.col("p")).alias("y")).collect()]
    assert got == [{"S": "FLAT 3", "R": "HIGH ST"}, {}]


def test_scores(spark):
    rows = [(["a", "b"], ["a", "b"]), (["a", "a"], ["a", "b"]), (["c"], ["b"])]
    df = spark.createDataFrame(rows, "true array<string>, predicted array<string>")
    assert R.sequence_accuracy(df).first().sequence_accuracy == pytest.approx(1 / 3)
    got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in R.label_report(df).collect()}
    assert got["a"] == pytest.approx((1.0, 2 / 3, 0.8, 3))
    assert got["b"] == pytest.approx((1 / 3, 1.0, 0.5, 1))
    assert got["c"] == (0.0, 0.0, 0.0, 1)
    assert R.weighted_f1(df).first().weighted_f1 == pytest.approx((0.8 * 3 + 0.5) / 5)


def test_tuning_prefers_sensible_smoothing(addresses):
    labelled = X.render_labelled(addresses, "id", 1)
    got = L.tune_smoothing(labelled, "id", [L.Smoothing(0.1, 0.1), L.Smoothing(1e6, 1e6)], 2, labels=RENDER_LABELS).collect()
    assert got[0].candidate == 0 and got[0].sequence_accuracy >= got[1].sequence_accuracy
    by_f1 = L.tune_smoothing(
        labelled, "id", [L.Smoothing(1e6, 1e6), L.Smoothing(0.1, 0.1)], 2, labels=RENDER_LABELS, objective="weighted_f1"
    )
    assert by_f1.first().candidate == 1 and by_f1.first().weighted_f1 == pytest.approx(got[0].weighted_f1)
    refitted, smoothing = L.refit_best(labelled, by_f1, labels=RENDER_LABELS)
    assert smoothing == L.Smoothing(0.1, 0.1) and refitted.label_totals.sum() > 0
    assert len(L.draw_smoothing(4)) == 4 and L.draw_smoothing(4) == L.draw_smoothing(4)


def test_names_in_a_trie_match_as_listed(spark):
    """Names that begin alike, in any order of the list, against a plain alternation."""
    import itertools
    import re

    names = ["YORK", "YORKSHIRE", "YORKS", "KENT", "KE", "ISLE OF ELY", "ISLE"]
    kept = "|".join(dict.fromkeys([*T.KEPT_BEFORE, *T.COMPANY, *T.FLAT, *T.RESIDENTIAL, *T.ROAD]))
    texts = ["YORKSHIRE YORK ROAD", "YORKS ROAD KENTISH", "1 KENT", "UPON YORKSHIRE", "ISLE OF ELY ISLE OF X", "KE ROAD KENT ROAD KE"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for listed in itertools.islice(itertools.permutations(names), 0, None, 500):
        plain = rf"(?<!\bON\s)(?<!\bDINAS\s)(?<!\bUPON\s)(?<![0-9]\s)(?:{'|'.join(listed)})(?!\s(?:{kept})\b)"
        got = [r.x for r in df.select(T.remove_counties(F.col("t"), listed).alias("x")).collect()]
        assert got == [re.sub(plain, "", t) for t in texts], listed


def test_long_lists_take_no_longer(spark, sf_dir):
    """Hundreds of names and synonyms: the pattern grows by letters alone, tokens meet few words."""
    counties = [f"{a}{b}SHIRE" for a in ("NORTH", "SOUTH", "EAST", "WEST", "MID") for b in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    synonyms = {f"W{i}": f"WORD {i}" for i in range(300)}
    assert len(T.county_pattern(counties)) < 2 * len("|".join(counties))
    df = spark.createDataFrame([("W7 w299 NORTHQSHIRE W300 WESTASHIRE ROAD",)], "t string")
    got = df.select(T.tokenize(F.col("t"), T.Lookups(counties=counties, synonyms=synonyms)).alias("x")).first().x
    assert got == ["WORD", "7", "WORD", "299", "W300", "WESTASHIRE", "ROAD"]


def test_each_distinct_text_is_tagged_once(spark, monkeypatch):
    """Repeated and missing texts come back as often as they came, tagged as single ones are."""
    labelled = spark.createDataFrame([([("12", "BuildingNumber"), ("HIGH", "StreetName")],)], "labelled array<struct<token:string,label:string>>")
    counts = L.fit_labels(labelled, labels=RENDER_LABELS)
    rows = [(i, ("12 HIGH", "7 MILL", None, "")[i % 4]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, t string")
    plain = L.tag_tokens(df.withColumn("g", T.tokenize(F.col("t"), T.Lookups())), "g", counts).drop("g")
    tagged, tag = [], L.tag_tokens
    monkeypatch.setattr(L, "tag_tokens", lambda d, *a, **o: tagged.append(d.count()) or tag(d, *a, **o))
    found = L.tag_text(df, "t", counts)
    assert found.columns == ["id", "t", "tagged"] and tagged == [4]
    assert sorted(found.collect()) == sorted(plain.select("id", "t", "tagged").collect())
