"""Sequence labelling of address tokens: counts, tagging, scores, smoothing search.

Training is two aggregates: label transitions and labels per token word and token shape. A tagger
reads them as a first-order model and finds the best label sequence and the probability of every
label, batch by batch in NumPy on the executors.

The shape table and the transitions have a bounded number of entries. The word table grows with the
vocabulary: its most frequent words, a fixed number at most, travel with the tasks, and the counts
of all others are joined to the distinct word lists that hold them.
"""

import re

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Iterator, Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gableframe.functions.tokens import DIRECTIONS, FLAGS, Lookups, tokenize
from gableframe.operators.sampling import uniform
from gableframe.operators.skew import skew_join
from gableframe.schema import TAG_LABELS
from gableframe.scratch import settle

# Most frequent words that travel with the tasks.
HEAD_WORDS = 100_000
# Cells (addresses x longest address) decoded at once.
CELLS = 200_000
START = "^"


def word_of(token: Column) -> Column:
    return F.upper(token)


def shape_of(token: Column, lookups: Lookups = Lookups()) -> Column:
    """What a token looks like, as one short text out of a bounded number of texts."""
    clean = F.upper(token)
    size = F.length(clean)
    sets = {**FLAGS, "directional": DIRECTIONS, "outcode": lookups.outcodes, "posttown": lookups.posttowns}
    flags = [F.when(clean.isin(list(names)), F.lit(n)) for n, names in sets.items() if names]
    digits = (
        F.when(clean.rlike(r"^[0-9]+\z"), "all_digits")
        .when(clean.rlike("[0-9]"), "some_digits")
        .otherwise("no_digits")
    )
    vowels = F.when(clean.rlike("[AEIOU]"), F.lit("vowels"))
    dash = F.when(clean.contains("-"), F.lit("dash"))
    end = F.when(clean.rlike(r"[.,;)]\z"), F.lit("punct"))
    return F.concat_ws(" ", digits, size.cast("string"), vowels, dash, end, *flags)


def shape_text(token: str, lookups: Lookups = Lookups()) -> str:
    """What shape_of gives, for one token in a Python worker."""
    clean = token.upper()
    digits = "all_digits" if re.fullmatch("[0-9]+", clean) else "some_digits" if re.search("[0-9]", clean) else "no_digits"
    sets = {**FLAGS, "directional": DIRECTIONS, "outcode": lookups.outcodes, "posttown": lookups.posttowns}
    parts = [
        digits,
        str(len(clean)),
        "vowels" if re.search("[AEIOU]", clean) else "",
        "dash" if "-" in clean else "",
        "punct" if clean.endswith((".", ",", ";", ")")) else "",
        *[n for n, names in sets.items() if clean in names],
    ]
    return " ".join(p for p in parts if p)


@dataclass(frozen=True)
class LabelCounts:
    """What training has counted. `words` holds one row per word: word, then a count per label."""

    labels: tuple[str, ...]
    words: DataFrame
    shapes: dict[str, np.ndarray]
    transitions: np.ndarray
    label_totals: np.ndarray
    n_words: int


@dataclass(frozen=True)
class Smoothing:
    """Pseudo-counts added to word and shape counts, and to transitions."""

    tokens: float = 0.3
    transitions: float = 0.1


def label_events(
    labelled: DataFrame, column: str = "labelled", lookups: Lookups = Lookups()
) -> DataFrame:
    """How often each word, shape and preceding label meets each label: (kind, value, label, n).

    All three come out of one pass. Counts combine on the map side, so that a frequent word or
    label is one small row per task.
    """
    pairs = F.col(column)
    names = F.transform(pairs, lambda p: p["label"])
    before = F.concat(
        F.array(F.lit(START)), F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0)))
    )
    tokens = labelled.select(
        F.inline(
            F.zip_with(
                pairs, before, lambda p, b: F.struct(p["token"].alias("token"), p["label"].alias("label"), b.alias("before"))
            )
        )
    ).where(F.col("label").isNotNull())
    kinds = {
        "word": word_of(F.col("token")),
        "shape": shape_of(F.col("token"), lookups),
        "before": F.col("before"),
    }
    seen = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])
    return (
        tokens.select("label", F.inline(seen))
        .groupBy("kind", "value", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def counts_per_label(events: DataFrame, kind: str, labels: Sequence[str] = TAG_LABELS) -> DataFrame:
    """One row per value of a kind with its count under each label."""
    columns = [
        F.coalesce(F.sum(F.when(F.col("label") == n, F.col("n"))), F.lit(0)).alias(n) for n in labels
    ]
    return events.where(F.col("kind") == kind).groupBy(F.col("value").alias(kind)).agg(*columns)


def fit_labels(
    labelled: DataFrame,
    column: str = "labelled",
    labels: Sequence[str] = TAG_LABELS,
    lookups: Lookups = Lookups(),
    min_count: int = 1,
) -> LabelCounts:
    """Counts labels per word, per shape and per preceding label.

    Words seen less than `min_count` times are left to their shape. The counts are written to the
    shared folder, as several jobs will read them; the word table stays there.
    """
    labels = tuple(labels)
    events = settle(label_events(labelled, column, lookups), "label-events")
    words = counts_per_label(events, "word", labels)
    if min_count > 1:
        words = words.where(sum((F.col(n) for n in labels), F.lit(0)) >= min_count)

    def small_table(kind: str) -> dict[str, np.ndarray]:
        # Bounded by the numbers of shapes or labels, not by the data.
        rows = counts_per_label(events, kind, labels).toLocalIterator()
        return {r[kind]: np.array([r[n] for n in labels], dtype=float) for r in rows}

    shapes, moves = small_table("shape"), small_table("before")
    none = np.zeros(len(labels))
    transitions = np.stack([moves.get(n, none) for n in (*labels, START)])
    totals = sum(shapes.values(), none)
    return LabelCounts(labels, words, shapes, transitions, totals, words.count())


def _log_rows(counts: np.ndarray, totals: np.ndarray, kinds: int, alpha: float) -> np.ndarray:
    """log P(kind | label) with pseudo-counts, for rows of counts per label."""
    return np.log(counts + alpha) - np.log(totals + alpha * (kinds + 1))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    high = x.max(axis=axis, keepdims=True)
    return np.squeeze(high, axis) + np.log(np.exp(x - high).sum(axis=axis))


def best_path(emit: np.ndarray, moves: np.ndarray, sizes: np.ndarray):
    """Best labels, their marginals, and the probability of the sequence.

    `emit` is addresses x positions x labels, padded; `moves` has the start as its last row. Sums over the
    label before or after are products with the chances of the moves, scaled by the largest of each row.
    """
    n, width, k = emit.shape
    step, start = moves[:k], moves[k]
    high = step.max()
    chances = np.exp(step - high)
    score, alpha = start + emit[:, 0], start + emit[:, 0]
    back = np.zeros((n, width, k), dtype=np.int16)
    alphas = np.empty_like(emit)
    alphas[:, 0] = alpha
    for t in range(1, width):
        live = (sizes > t)[:, None]
        best = score[:, :1] + step[0]
        for i in range(1, k):
            other = score[:, i : i + 1] + step[i]
            better = other > best
            back[:, t][better] = i
            best = np.where(better, other, best)
        score = np.where(live, best + emit[:, t], score)
        peak = alpha.max(axis=1, keepdims=True)
        ahead = np.log(np.exp(alpha - peak) @ chances) + (peak + high)
        alpha = np.where(live, ahead + emit[:, t], alpha)
        alphas[:, t] = alpha
    total = _log_sum(alpha, 1)
    path = np.zeros((n, width), dtype=np.int16)
    betas = np.zeros_like(emit)
    current = score.argmax(axis=1)
    rows = np.arange(n)
    for t in range(width - 1, -1, -1):
        inside = sizes > t
        path[:, t] = np.where(inside, current, 0)
        current = np.where(inside & (t > 0), back[rows, t, current], current)
        if t + 1 < width:
            after = emit[:, t + 1] + betas[:, t + 1]
            peak = after.max(axis=1, keepdims=True)
            behind = np.log(np.exp(after - peak) @ chances.T) + (peak + high)
            betas[:, t] = np.where((sizes > t + 1)[:, None], behind, 0.0)
    chosen = np.take_along_axis(alphas + betas, path[:, :, None].astype(np.intp), axis=2)[:, :, 0]
    return path, np.exp(chosen - total[:, None]), np.exp(score.max(axis=1) - total)


def _batches(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers grouped by length so that a padded block stays within CELLS."""
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    start = 0
    while start < len(order):
        near = sizes[order[start : start + CELLS]]
        cells = np.arange(1, len(near) + 1) * near
        end = start + max(1, int(np.searchsorted(cells, CELLS, side="right")))
        yield order[start:end]
        start = end


class _Tagger:
    """Scores and decodes batches in a Python worker; each distinct token is looked at once a batch."""

    def __init__(self, counts: dict, smoothing: Smoothing):
        self.labels = np.array(counts["labels"], dtype=object)
        self.shapes, self.totals, self.words = counts["shapes"], counts["totals"], counts["words"]
        self.n_words, self.lookups = counts["n_words"], counts["lookups"]
        self.counted = counts["transitions"]
        self.smooth(smoothing)

    def smooth(self, smoothing: Smoothing) -> None:
        self.alpha = smoothing.tokens
        moves = self.counted + smoothing.transitions
        self.moves = np.log(moves) - np.log(moves.sum(axis=1, keepdims=True))

    def look_up(self, tokens: pa.ListArray, rare_words: pa.ListArray, rare_counts: pa.ListArray) -> None:
        """Counts of the words and shapes of a batch."""
        none = np.zeros(len(self.labels))
        self.sizes = np.diff(tokens.offsets.to_numpy())
        listed = rare_words.flatten().dictionary_encode()
        first = np.unique(listed.indices.to_numpy(), return_index=True)[1]
        counts = rare_counts.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(none))[first]
        rare = dict(zip(listed.dictionary.to_pylist(), counts, strict=True))
        everything = tokens.flatten().fill_null("").dictionary_encode()
        self.codes, distinct = everything.indices.to_numpy(), everything.dictionary.to_pylist()
        words = [t.upper() for t in distinct]
        found = [self.words.get(w, rare.get(w, none)) for w in words]
        shapes = [self.shapes.get(shape_text(t, self.lookups), none) for t in distinct]
        self.found = np.array(found, dtype=float).reshape(-1, len(none))
        self.shaped = np.array(shapes, dtype=float).reshape(-1, len(none))

    def decode(self):
        """Label numbers and their probabilities end to end, and the probability of each sequence."""
        whole = np.zeros(len(self.sizes))
        names = np.zeros(len(self.codes), int)
        margins = np.zeros(len(names))
        if len(names):
            emit = _log_rows(self.found, self.totals, self.n_words, self.alpha)
            emit = (emit + _log_rows(self.shaped, self.totals, len(self.shapes), self.alpha))[self.codes]
            starts = np.cumsum(self.sizes) - self.sizes
            for rows in _batches(self.sizes):
                places = np.arange(int(self.sizes[rows[-1]]))
                inside = places < self.sizes[rows][:, None]
                at = (starts[rows][:, None] + places)[inside]
                block = np.zeros((*inside.shape, len(self.labels)))
                block[inside] = emit[at]
                path, marginal, whole[rows] = best_path(block, self.moves, self.sizes[rows])
                names[at] = path[inside]
                margins[at] = marginal[inside]
        return names, margins, whole


def tagged_array(labels: Sequence[str], sizes: np.ndarray, names: np.ndarray, margins: np.ndarray, whole: np.ndarray) -> pa.StructArray:
    """Lists of so many labels and probabilities, and the probability of each sequence, as an Arrow column."""
    ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    texts = pa.array(labels, pa.string()).take(pa.array(names))
    lists = [pa.ListArray.from_arrays(ends, v) for v in (texts, pa.array(margins))]
    return pa.StructArray.from_arrays([*lists, pa.array(whole)], ["labels", "marginals", "whole"])


def _with_rare(df: DataFrame, tokens: str, counts: LabelCounts, head_words: int) -> tuple[DataFrame, dict]:
    """Adds __tokens, __rare_words and __rare_counts; the rest of the model, bounded, as a plain dict.

    Rare words are joined to the distinct lists of words, so that neither a row's key nor the number
    of its copies plays a part, and a word of many lists is one small row for each.
    """
    total = sum((F.col(n) for n in counts.labels), F.lit(0))
    per_word = F.array(*[F.col(n).cast("double") for n in counts.labels]).alias("c")
    ranked = counts.words.select("word", total.alias("total"), per_word)
    head = ranked.orderBy(F.desc("total"), "word").limit(head_words).toArrow() if head_words else None
    words = dict(zip(head["word"].to_pylist(), head["c"].to_pylist(), strict=True)) if head else {}
    rare = ranked
    if words:
        # The last word of the head tells on which side of the cut each word is.
        least, last = head["total"][-1].as_py(), head["word"][-1].as_py()
        rare = ranked.where((F.col("total") < least) | ((F.col("total") == least) & (F.col("word") > last)))
    given = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    listed = df.withColumn("__tokens", given).withColumn("__words", F.array_distinct(F.transform("__tokens", word_of)))
    found = (
        listed.select("__words")
        .distinct()
        .select("__words", F.explode("__words").alias("word"))
        .join(rare.select("word", "c"), "word")
        .groupBy("__words")
        .agg(F.collect_list(F.struct("word", "c")).alias("l"))
        .select("__words", F.col("l")["word"].alias("__rare_words"), F.col("l")["c"].alias("__rare_counts"))
    )
    plain = {
        "labels": counts.labels, "shapes": counts.shapes, "transitions": counts.transitions,
        "totals": counts.label_totals, "n_words": counts.n_words, "words": words,
    }
    return listed.join(settle(found, "rare-words"), "__words", "left").drop("__words"), plain


def tag_tokens(
    df: DataFrame,
    tokens: str,
    counts: LabelCounts,
    smoothing: Smoothing = Smoothing(),
    lookups: Lookups = Lookups(),
    out: str = "tagged",
    head_words: int = HEAD_WORDS,
) -> DataFrame:
    """Adds the best label of each token with its probability, and that of the sequence.

    Rows are tagged by their tokens alone. Rows without tokens get no pairs and probability zero.
    """
    joined, plain = _with_rare(df, tokens, counts, head_words)
    model = df.sparkSession.sparkContext.broadcast(plain | {"lookups": lookups})

    @F.arrow_udf("labels array<string>, marginals array<double>, whole double")
    def decode(batches: Iterator[Tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        tagger = _Tagger(model.value, smoothing)
        for batch in batches:
            tagger.look_up(*batch)
            yield tagged_array(tagger.labels, tagger.sizes, *tagger.decode())

    found = F.col("__found")
    pairs = F.transform(
        F.arrays_zip("__tokens", found["labels"].alias("labels"), found["marginals"].alias("marginals")),
        lambda x: F.struct(
            x["__tokens"].alias("token"), x["labels"].alias("label"), x["marginals"].alias("marginal")
        ),
    )
    inputs = ["__tokens", "__rare_words", "__rare_counts"]
    return (
        joined.withColumn("__found", decode(*[F.col(c) for c in inputs]))
        .withColumn(out, F.struct(pairs.alias("pairs"), found["whole"].alias("sequence_probability")))
        .drop("__found", *inputs)
    )


def parse(tagged: Column) -> Column:
    """(token, label) pairs; none for text without tokens (C17)."""
    return F.transform(tagged["pairs"], lambda p: F.struct(p["token"], p["label"]))


def parse_with_marginals(tagged: Column) -> Column:
    """(token, label, probability) triples."""
    return tagged["pairs"]


def parse_with_probabilities(tagged: Column) -> Column:
    """Tokens, labels, probabilities of the labels and of the sequence."""
    pairs = tagged["pairs"]
    return F.struct(
        F.transform(pairs, lambda p: p["token"]).alias("tokens"),
        F.transform(pairs, lambda p: p["label"]).alias("tags"),
        F.transform(pairs, lambda p: p["marginal"]).alias("marginal_probabilities"),
        tagged["sequence_probability"].alias("sequence_probability"),
    )


def components(pairs: Column) -> Column:
    """Map from label to its tokens joined, blanks, commas and semicolons stripped (C20)."""
    labels = F.array_distinct(F.transform(pairs, lambda p: p["label"]))
    return F.map_from_entries(
        F.transform(
            labels,
            lambda n: F.struct(
                n.alias("key"),
                F.btrim(
                    F.array_join(
                        F.transform(F.filter(pairs, lambda p: p["label"] == n), lambda p: p["token"]), " "
                    ),
                    F.lit(" ,;"),
                ).alias("value"),
            ),
        )
    )


def tag_text(
    df: DataFrame,
    text: str,
    counts: LabelCounts,
    lookups: Lookups = Lookups(),
    tokenizer=None,
    **options,
) -> DataFrame:
    """Tags free text; `tokenizer` maps the text column to an array of tokens (C17).

    Each distinct text is split and tagged once, and joined to its rows; a text of very many rows is dealt to parts.
    """
    make = tokenizer or (lambda c: tokenize(c, lookups))
    # In a struct a missing text is a value that joins like any other.
    keyed = df.withColumn("__text", F.struct(F.col(text).alias("value")))
    texts = settle(keyed.groupBy("__text").agg(F.count(F.lit(1)).alias("__n")), "texts")
    split = texts.select("__text", make(F.col("__text")["value"]).alias("__raw_tokens"))
    tagged = tag_tokens(split, "__raw_tokens", counts, lookups=lookups, **options).drop("__raw_tokens")
    return skew_join(keyed, tagged, ["__text"], "left", counts=texts).drop("__text")


def true_and_predicted(tagged: DataFrame, labelled: str = "labelled", out: str = "tagged") -> DataFrame:
    """Label arrays to score: what was given and what was found."""
    return tagged.select(
        F.transform(labelled, lambda p: p["label"]).alias("true"),
        F.transform(F.col(out)["pairs"], lambda p: p["label"]).alias("predicted"),
    )


# --- search ------------------------------------------------------------------------


def draw_smoothing(n: int, seed: int = 42) -> list[Smoothing]:
    """Candidates from exponential distributions of mean 0.5 and 0.05."""
    rng = np.random.default_rng(seed)
    return [
        Smoothing(float(a) + 1e-6, float(b) + 1e-6)
        for a, b in zip(rng.exponential(0.5, n), rng.exponential(0.05, n))
    ]


def tune_smoothing(
    labelled: DataFrame,
    key: str,
    candidates: Sequence[Smoothing],
    folds: int = 3,
    seed: int = 42,
    column: str = "labelled",
    labels: Sequence[str] = TAG_LABELS,
    lookups: Lookups = Lookups(),
    objective: str = "sequence_accuracy",
    head_words: int = HEAD_WORDS,
) -> DataFrame:
    """Cross-validated scores of all candidates, best by the objective first.

    The objectives are sequence_accuracy, the share of fully right sequences, and weighted_f1. Counts
    do not depend on smoothing: there is one fit per fold and one pass over the rows held out, in
    which a batch is looked up once and decoded for each candidate.
    """
    fold = F.floor(uniform(F.col(f"`{key}`"), seed, "fold") * folds).cast("int")
    given = F.transform(column, lambda p: p["token"]).alias("__given")
    rows = settle(labelled.select(column, given, fold.alias("__fold")), "folds")
    names = tuple(labels)

    def scores_of(counts: LabelCounts, held: DataFrame) -> DataFrame:
        joined, plain = _with_rare(held, "__given", counts, head_words)
        model = held.sparkSession.sparkContext.broadcast(plain | {"lookups": lookups})
        true = F.transform(column, lambda p: p["label"]).alias("true")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tagger = _Tagger(model.value, candidates[0])
            n = len(names)
            number = {n: i for i, n in enumerate(names)}
            for batch in batches:
                tagger.look_up(*[batch.column(c) for c in ("__tokens", "__rare_words", "__rare_counts")])
                asked = np.array([number[a] for a in batch.column("true").flatten().to_pylist()], dtype=int)
                owner = np.repeat(np.arange(batch.num_rows), tagger.sizes)
                for i, smoothing in enumerate(candidates):
                    tagger.smooth(smoothing)
                    said = tagger.decode()[0]
                    wrong = len(np.unique(owner[said != asked]))
                    columns = {
                        "candidate": np.full(n + 1, i),
                        "label": [*names, ""],
                        "hits": np.append(np.bincount(asked[said == asked], minlength=n), batch.num_rows - wrong),
                        "claimed": np.append(np.bincount(said, minlength=n), 0),
                        "support": np.append(np.bincount(asked, minlength=n), batch.num_rows),
                    }
                    yield pa.RecordBatch.from_pydict(columns)

        cells = joined.select("__tokens", "__rare_words", "__rare_counts", true).mapInArrow(
            run, "candidate long, label string, hits long, claimed long, support long"
        )
        return cells.groupBy("candidate", "label").agg(*[F.sum(c).alias(c) for c in ("hits", "claimed", "support")])

    per_fold = None
    for k in range(folds):
        counts = fit_labels(rows.where(F.col("__fold") != k), column, names, lookups)
        part = scores_of(counts, rows.where(F.col("__fold") == k)).withColumn("fold", F.lit(k))
        per_fold = part if per_fold is None else per_fold.unionByName(part)
    whole = F.col("label") == ""
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hits"), F.col("claimed") + F.col("support")), F.lit(0.0))
    support = F.when(~whole, F.col("support"))
    folded = per_fold.groupBy("candidate", "fold").agg(
        F.sum(F.when(whole, F.col("hits") / F.col("support"))).alias("sequence_accuracy"),
        (F.sum(f1 * support) / F.sum(support)).alias("weighted_f1"),
    )
    given_as = F.array(*[F.struct(F.lit(s.tokens).alias("tokens"), F.lit(s.transitions).alias("transitions")) for s in candidates])
    means = folded.groupBy("candidate").agg(*[F.avg(c).alias(c) for c in ("sequence_accuracy", "weighted_f1")])
    parameters = F.element_at(given_as, F.col("candidate").cast("int") + 1)
    return means.select("candidate", parameters.alias("p"), "sequence_accuracy", "weighted_f1").select(
        "candidate", "p.*", "sequence_accuracy", "weighted_f1"
    ).orderBy(F.desc(objective), "candidate")


def refit_best(
    labelled: DataFrame,
    tuned: DataFrame,
    column: str = "labelled",
    labels: Sequence[str] = TAG_LABELS,
    lookups: Lookups = Lookups(),
) -> tuple[LabelCounts, Smoothing]:
    """The best candidate of a search, with counts of all rows."""
    best = tuned.first()
    return fit_labels(labelled, column, labels, lookups), Smoothing(best["tokens"], best["transitions"])
