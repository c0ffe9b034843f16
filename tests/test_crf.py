"""The conditional random field against enumeration, and against the counting tagger."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gableframe.functions import tokens as T
from gableframe.operators import crf
from gableframe.operators import labelling as L
from gableframe.operators import scoring as R
from gableframe.schema import RENDER_LABELS

LOOKUPS = T.Lookups(outcodes=("GL1",), posttowns=("BATH",))
SCHEMA = "id long, labelled array<struct<token:string,label:string>>"


def chains(rng, n=12, most=4, labels=3):
    sizes = rng.integers(1, most + 1, n)
    tokens = int(sizes.sum())
    counts = rng.integers(0, 4, 6)
    given = crf.Sequences(
        rng.integers(0, 5, int(counts.sum())), counts, rng.integers(0, 6, tokens), sizes, rng.integers(0, labels, tokens), np.arange(n) % 3
    )
    return given, crf.Layout(5, labels)


def paths(given, layout, weights):
    """Per row all label sequences and their scores, from the definition."""
    slots, places, moves = layout.views(weights)
    ends = np.cumsum(given.counts)
    own = [given.codes[e - c : e] for e, c in zip(ends, given.counts, strict=True)]
    start = 0
    for n in given.sizes:
        at = given.at[start : start + n]
        scores = {}
        for path in itertools.product(range(layout.labels), repeat=int(n)):
            total = 0.0
            for t, y in enumerate(path):
                total += slots[0][own[at[t]], y].sum()
                total += slots[1][own[at[t - 1]], y].sum() if t else 0
                total += slots[2][own[at[t + 1]], y].sum() if t + 1 < n else 0
                flags = (t == 0 and n > 1, t == n - 1 and n > 1, n == 1, t == 1, t == n - 2 and n > 1)
                total += sum(places[i, y] for i, f in enumerate(flags) if f)
                total += moves[path[t - 1], y] if t else 0
            scores[path] = total
        yield start, scores
        start += n


def brute_loss(given, layout, weights, rows):
    loss = 0.0
    for (start, scores), n, chosen in zip(paths(given, layout, weights), given.sizes, rows, strict=True):
        if chosen:
            true = tuple(given.labels[start : start + n].tolist())
            loss += np.log(sum(np.exp(s) for s in scores.values())) - scores[true]
    return loss


@pytest.mark.parametrize("seed", range(4))
def test_loss_and_gradient_equal_enumeration(seed):
    rng = np.random.default_rng(seed)
    given, layout = chains(rng)
    weights, rows = rng.normal(size=layout.size), given.folds != 1
    loss, gradient = crf.loss_and_gradient(given, layout, weights, rows)
    assert loss == pytest.approx(brute_loss(given, layout, weights, rows))
    for i in range(layout.size):
        step = np.zeros(layout.size)
        step[i] = 1e-5
        slope = (brute_loss(given, layout, weights + step, rows) - brute_loss(given, layout, weights - step, rows)) / 2e-5
        assert gradient[i] == pytest.approx(slope, abs=1e-5)


def test_decoding_equals_enumeration():
    rng = np.random.default_rng(9)
    given, layout = chains(rng, 30)
    weights = rng.normal(size=layout.size)
    decoder = crf._Decoder(crf.Field(tuple("abc"), tuple("vwxyz"), weights))
    names, margins, whole = decoder.decode(given, weights)
    for (start, scores), n, own in zip(paths(given, layout, weights), given.sizes, whole, strict=True):
        total = sum(np.exp(s) for s in scores.values())
        best = max(scores, key=scores.get)
        assert tuple(names[start : start + n]) == best
        assert own == pytest.approx(np.exp(scores[best]) / total)
        for t, y in enumerate(best):
            mass = sum(np.exp(s) for p, s in scores.items() if p[t] == y)
            assert margins[start + t] == pytest.approx(mass / total)


@pytest.mark.parametrize("c1", [0.0, 0.7])
def test_solver_finds_the_minimum(c1):
    """A quadratic with known minimum: shrunk by c1, with one weight that is not free."""
    scale, middle = np.array([1.0, 10.0, 100.0, 3.0]), np.array([2.0, -0.05, 0.3, 5.0])
    solver = crf.minimise(np.array([True, True, True, False]), crf.Penalty(c1, 0.0), 200, delta=0.0)
    x = next(solver)
    while True:
        try:
            x = solver.send((0.5 * (scale * (x - middle) ** 2).sum(), scale * (x - middle)))
        except StopIteration as end:
            found = end.value
            break
    want = np.sign(middle) * np.maximum(np.abs(middle) - c1 / scale, 0)
    assert found[:3] == pytest.approx(want[:3], abs=1e-4) and found[3] == 0


def test_attributes_in_workers_are_those_of_columns(spark):
    rows = ["FLAT", "Flat-2A-b", "12", "12A", "St.", "12.", "GL1", "bath", "N", "1ST", "--", "ÉÉ", "ltd,", "(A)", "x;", "UNI", "٣"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = df.select("t", crf.attribute_list(T.token_features(F.col("t"), LOOKUPS)).alias("a")).collect()
    assert all(sorted(r.a) == sorted(crf.attributes(r.t, LOOKUPS)) for r in got)


@pytest.fixture(scope="module")
def labelled(spark, sf_dir):
    from workload.training import labelled as rendered

    return rendered(spark, sf_dir).select("id", "labelled").cache()


def test_holdout_is_no_worse_than_that_of_counts(spark, labelled):
    split = labelled.withColumn("held", F.pmod(F.xxhash64("id"), F.lit(5)) == 0)
    split = split.withColumn("given", F.transform("labelled", lambda p: p["token"]))
    train, test = split.where("not held"), split.where("held")
    model = crf.fit_field(train, labels=RENDER_LABELS, lookups=LOOKUPS)
    counted = L.fit_labels(train, labels=RENDER_LABELS)
    found = [crf.tag_with_field(test, "given", model), L.tag_tokens(test, "given", counted)]
    scores = [R.sequence_accuracy(L.true_and_predicted(f)).first().sequence_accuracy for f in found]
    f1 = [R.weighted_f1(L.true_and_predicted(f)).first().weighted_f1 for f in found]
    assert scores[0] >= scores[1] and f1[0] >= f1[1] and scores[0] > 0.8
    again = crf.fit_field(train.repartition(3), labels=RENDER_LABELS, lookups=LOOKUPS)
    assert again.attributes == model.attributes


def test_penalties_and_frequencies_thin_the_model(spark, labelled):
    few = labelled.limit(150).cache()
    sizes = {}
    for name, options in {
        "plain": {"penalty": crf.Penalty(0.0, 0.01)},
        "sparse": {"penalty": crf.Penalty(2.0, 0.0)},
        "frequent": {"penalty": crf.Penalty(0.0, 0.01), "min_freq": 5},
        "bounded": {"penalty": crf.Penalty(0.0, 0.01), "most": 10},
    }.items():
        model = crf.fit_field(few, labels=RENDER_LABELS, steps=25, **options)
        sizes[name] = int((model.weights != 0).sum())
        assert len(model.attributes) <= (10 if name == "bounded" else 10**6)
    assert sizes["plain"] > sizes["sparse"] > 0 and sizes["plain"] > sizes["frequent"] and sizes["plain"] > sizes["bounded"]


def test_search_scores_as_single_fits_do(spark, labelled):
    from gableframe.operators.sampling import uniform

    few = labelled.limit(120).cache()
    candidates = crf.draw_penalties(3, 1)
    tuned = crf.tune_field(few, "id", candidates, folds=2, seed=1, labels=RENDER_LABELS, steps=8).collect()
    assert sorted(r.candidate for r in tuned) == [0, 1, 2]
    assert [r.sequence_accuracy for r in tuned] == sorted((r.sequence_accuracy for r in tuned), reverse=True)
    fold = F.floor(uniform(F.col("id"), 1, "fold") * 2)
    given = few.withColumn("given", F.transform("labelled", lambda p: p["token"])).withColumn("fold", fold)
    scores = []
    for k in range(2):
        train = given.where(F.col("fold") != k)
        model = crf.fit_field(train, labels=RENDER_LABELS, penalty=candidates[1], steps=8)
        tagged = crf.tag_with_field(given.where(F.col("fold") == k), "given", model)
        scores.append(R.sequence_accuracy(L.true_and_predicted(tagged)).first().sequence_accuracy)
    row = next(r for r in tuned if r.candidate == 1)
    assert row.c1 == candidates[1].c1 and row.sequence_accuracy == pytest.approx(np.mean(scores), abs=0.03)


def test_odd_rows(spark):
    rows = [(1, [("FLAT", "SubBuildingName"), ("1", "SubBuildingName")]), (2, []), (3, None), (4, [("X", None)]), (5, [("Y", "no label")])]
    df = spark.createDataFrame(rows, SCHEMA)
    model = crf.fit_field(df, labels=RENDER_LABELS, steps=5)
    given = df.withColumn("given", F.transform("labelled", lambda p: p["token"]))
    got = {r.id: r.tagged for r in crf.tag_with_field(given, "given", model).collect()}
    assert [p.label for p in got[1].pairs] == ["SubBuildingName"] * 2 and got[2].pairs == [] == got[3].pairs
    assert got[3].sequence_probability == 0.0 and 0 < got[5].sequence_probability <= 1
    empty = crf.fit_field(df.where("id > 1"), labels=RENDER_LABELS)
    assert not empty.weights.any() and crf.tag_with_field(given, "given", empty).count() == 5


def test_solvers_run_within_their_share_of_the_driver(spark, labelled, monkeypatch):
    """With room for one solver each pass serves one, and the search finds the same."""
    few = labelled.limit(60).cache()
    candidates, options = crf.draw_penalties(2, 1), {"folds": 2, "seed": 1, "labels": RENDER_LABELS, "steps": 3}
    together = crf.tune_field(few, "id", candidates, **options).collect()
    served, added = [], crf._added
    monkeypatch.setattr(crf, "_added", lambda b, y, models, *a: served.append(len(models)) or added(b, y, models, *a))
    monkeypatch.setattr(crf, "SOLVED_AT_ONCE", 1)
    assert crf.tune_field(few, "id", candidates, **options).collect() == together
    assert set(served) == {1}


def test_rows_are_dealt_to_all_cores(spark, sf_dir):
    from workload.training import labelled as rendered

    rows = rendered(spark, sf_dir)
    dealt = crf._rows(rows, "labelled", F.lit(0))
    files = dealt.select(F.input_file_name().alias("f")).distinct().count()
    assert files >= min(spark.sparkContext.defaultParallelism, dealt.count()) and dealt.count() == rows.count()


def test_all_attributes_are_kept(spark):
    """More attributes than any bound of earlier versions held: each has its weight and its row of the gradient."""
    rows = 200_500
    df = spark.range(rows).select(
        F.array(F.struct(F.format_string("W%06dX", "id").alias("token"), F.lit("StreetName").alias("label"))).alias("labelled")
    )
    own = crf.first_gradient(df, labels=RENDER_LABELS).where("slot = 'own' and attribute like 'word=%' and label = 'StreetName'")
    found = own.agg(F.count(F.lit(1)).alias("n"), F.min("gradient").alias("lo"), F.max("gradient").alias("hi")).first()
    assert found.n == rows and found.lo == pytest.approx(1 / 7 - 1) == found.hi
    model = crf.fit_field(df, labels=RENDER_LABELS, penalty=crf.Penalty(0.0, 0.1), steps=1)
    words = [i for i, a in enumerate(model.attributes) if a.startswith("word=")]
    assert len(words) == rows and model.weights.reshape(-1, 7)[words, RENDER_LABELS.index("StreetName")].all()


def test_attributes_are_found_among_equal_hashes(monkeypatch):
    monkeypatch.setattr(crf.Known, "_hashes", staticmethod(lambda texts: np.array([len(t) % 2 for t in texts], np.uint64)))
    known = crf.Known(["a", "bb", "c", "dd", "e"])
    assert known.numbers_of(["e", "dd", "x", "a", "yy", "bb", "a", "c"]).tolist() == [4, 3, -1, 0, -1, 1, 0, 2]


def test_search_trains_to_the_end(spark, labelled, monkeypatch):
    """Without a number of steps the solver gains no more, and neither way of training leaves a weight out."""
    few = labelled.limit(80).cache()
    candidates, options = crf.draw_penalties(2, 1), {"folds": 2, "seed": 1, "labels": RENDER_LABELS}
    sent = {r.candidate: r for r in crf.tune_field(few, "id", candidates, **options).collect()}
    monkeypatch.setattr(crf, "SENT_BYTES", 0)
    passes = {r.candidate: r for r in crf.tune_field(few, "id", candidates, **options).collect()}
    for i, row in sent.items():
        assert row.sequence_accuracy == pytest.approx(passes[i].sequence_accuracy, abs=0.03)


@pytest.mark.parametrize("first", [1, 5])
def test_optimum_of_some_attributes_at_a_time(monkeypatch, first):
    """Repeated rows count as often as they come, and attributes left out at first come in: the loss is that of all weights at once."""
    monkeypatch.setattr(crf, "FIRST_ATTRIBUTES", first)
    rng = np.random.default_rng(3)
    blocks = [chains(rng, 60)[0] for _ in range(2)] * 2
    layout, penalty = crf.Layout(5, 3), crf.Penalty(0.8, 0.05)
    free = np.arange(layout.size)

    def loss(x):
        sums = [crf.loss_and_gradient(b, layout, x, b.folds != 1) for b in blocks]
        return sum(a for a, _ in sums), sum(g for _, g in sums)

    solver = crf.minimise(np.ones(layout.size, bool), penalty, None, delta=1e-9)
    point = next(solver)
    while True:
        try:
            point = solver.send(loss(point))
        except StopIteration as end:
            best = end.value
            break
    found = crf._optimum(blocks, layout, 1, free, penalty, delta=1e-9)
    whole = [loss(x)[0] + penalty.c2 * x @ x + penalty.c1 * np.abs(x).sum() for x in (best, found)]
    assert whole[1] == pytest.approx(whole[0], rel=1e-6)


def test_query_searches_without_a_number_of_steps(spark, monkeypatch):
    from workload import training
    from workload.registry import QUERIES

    given = []
    monkeypatch.setattr(training, "labelled", lambda s, d: None)
    monkeypatch.setattr(crf, "tune_field", lambda *a, **options: given.append(options) or spark.range(0))
    QUERIES["tune_crf"](spark, "")
    assert given[0].get("steps") is None
