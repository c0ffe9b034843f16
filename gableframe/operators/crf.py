"""A linear-chain conditional random field over address tokens, trained on Spark.

A position is described by the attributes of its token and of both neighbours and by its place in
the text. Training rows are coded once into blocks in the shared folder. Each step of the solver is one pass over
the blocks: tasks run forward and backward over their sequences and send loss and gradient, Spark
adds them up, and the driver takes a quasi-Newton step. All attributes are kept; only weights of pairs that were
met are sent, and a block works on those of its own attributes. A search trains all candidates and folds in the
same passes, or, if the blocks are small enough to be sent, each candidate and fold to the end in a task of its own.
"""

import re
from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gableframe.functions.tokens import FLAGS, Lookups, token_features
from gableframe.operators.labelling import _batches, best_path, tagged_array
from gableframe.operators.sampling import uniform
from gableframe.schema import TAG_LABELS
from gableframe.scratch import settle

# Rows per block, and weights per row of a partial gradient.
BLOCK = 4096
CHUNK = 4096
# Sums of gradients that a task holds.
SUMS_PER_TASK = 1 << 22
# Weights and gradients that the solvers of a search hold on the driver at a time.
SOLVED_AT_ONCE = 1 << 23
# Blocks of up to so many bytes are sent to tasks that solve a candidate each.
SENT_BYTES = 1 << 26
# Attributes, the most frequent ones, that such a task starts with.
FIRST_ATTRIBUTES = 512
# Tokens that it works on at a time.
CACHED = 1 << 13
# Losses and gradients are added as whole multiples of these, so that their sum does not depend on the order of tasks.
GRAIN = 2.0**-24
FINE_GRAIN = 2.0**-32
SLOTS = ("own", "previous", "next")
PLACES = ("rawstring_start", "rawstring_end", "singleton", "previous_is_start", "next_is_end")
BLOCKS = "codes binary, counts binary, at binary, sizes binary, labels binary, folds binary"


# --- attributes --------------------------------------------------------------------


def attribute_list(features: Column) -> Column:
    """The features of a token (C15) as a list of attributes; one per hyphen, none for what does not apply."""
    valued = [F.concat(F.lit(f"{n}="), features[n]) for n in ("digits", "word", "length", "endsinpunc")]
    flags = [F.when(features[n], F.lit(n)) for n in ("outcode", "posttown", "has_vowels", *FLAGS)]
    known = F.filter(F.array(*valued, *flags), lambda a: a.isNotNull())
    return F.concat(known, F.array_repeat(F.lit("hyphenations"), features["hyphenations"].cast("int")))


def attributes(token: str, lookups: Lookups = Lookups()) -> list[str]:
    """What attribute_list gives, for one token in a Python worker."""
    clean = token.upper()
    number = re.search(r"^\d+$", clean)
    digits = "all_digits" if number else "some_digits" if re.search("[0-9]", clean) else "no_digits"
    found = [f"digits={digits}"]
    if not number:
        found.append(f"word={clean}")
    found.append(f"length={'d' if number else 'w'}:{len(clean)}")
    if re.search(r"^.+\.$", token):
        found.append(f"endsinpunc={token[-1]}")
    sets = {"outcode": lookups.outcodes, "posttown": lookups.posttowns}
    found += [n for n, names in sets.items() if clean in names]
    if re.search("[AEIOU]", clean):
        found.append("has_vowels")
    return found + [n for n, names in FLAGS.items() if clean in names] + ["hyphenations"] * clean.count("-")


def attribute_counts(labelled: DataFrame, column: str = "labelled", lookups: Lookups = Lookups()) -> DataFrame:
    """(slot, attribute, label, n): how often an attribute of a token or of a neighbour meets a label.

    Tokens are counted first, so that each distinct one is looked at once; neighbours likewise.
    """
    pairs = F.col(column)

    def beside(i: Column, by: int) -> Column:
        return F.get(pairs, i + by)["token"]

    slots = F.transform(
        pairs,
        lambda p, i: F.array(
            *[
                F.struct(F.lit(slot).alias("slot"), token.alias("token"), p["label"].alias("label"))
                for slot, token in zip(SLOTS, (p["token"], beside(i, -1), beside(i, 1)), strict=True)
            ]
        ),
    )
    met = labelled.select(F.inline(F.flatten(slots))).where("token is not null and label is not null")
    met = met.groupBy("slot", "token", "label").agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(attribute_list(token_features(F.col("token"), lookups))).alias("attribute")
    return met.select("slot", "label", "n", each).groupBy("slot", "attribute", "label").agg(F.sum("n").alias("n"))


def _kept(labelled: DataFrame, column: str, lookups: Lookups, min_freq: float, most: int | None = None) -> list[str]:
    """Attributes of tokens that occur often enough, the most frequent ones first; all, or at most so many."""
    counts = attribute_counts(labelled, column, lookups).where("slot = 'own'")
    counts = counts.groupBy("attribute").agg(F.sum("n").alias("n")).where(F.col("n") >= max(min_freq, 1))
    counts = counts.orderBy(F.desc("n"), "attribute")
    return (counts if most is None else counts.limit(most)).toArrow()["attribute"].to_pylist()


class Known:
    """Numbers of the attributes kept, in a few arrays: texts in the order of their hashes, which find them."""

    def __init__(self, names: Sequence[str]):
        hashes = self._hashes(names)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.numbers = hashes[order], order.astype(np.int32)
        self.texts = pa.array(names, pa.large_string()).take(pa.array(order))

    @staticmethod
    def _hashes(texts: Sequence[str]) -> np.ndarray:
        return pd.util.hash_array(np.array(texts, dtype=object), categorize=False) if len(texts) else np.zeros(0, np.uint64)

    def numbers_of(self, texts: Sequence[str]) -> np.ndarray:
        """The number of each text, -1 for one that is not kept."""
        which, distinct = pd.factorize(np.array(texts, dtype=object))
        hashes, asked = self._hashes(distinct), pa.array(distinct, pa.large_string())
        found = np.full(len(distinct), -1, np.int32)
        at = np.searchsorted(self.hashes, hashes)
        open_ = np.arange(len(distinct))
        while len(open_ := open_[at[open_] < len(self.hashes)]):
            open_ = open_[self.hashes[at[open_]] == hashes[open_]]
            same = pc.equal(self.texts.take(pa.array(at[open_])), asked.take(pa.array(open_))).to_numpy(zero_copy_only=False).astype(bool)
            found[open_[same]] = self.numbers[at[open_[same]]]
            # Others with the same hash.
            open_ = open_[~same]
            at[open_] += 1
        return found[which]


# --- blocks ------------------------------------------------------------------------


def _rows(labelled: DataFrame, column: str, fold: Column) -> DataFrame:
    """The pairs and the fold of each row, written once and dealt out evenly: few bytes are much work here."""
    parts = 2 * labelled.sparkSession.sparkContext.defaultParallelism
    return settle(labelled.select(F.col(column).alias("pairs"), fold.cast("int").alias("fold")).repartition(parts), "labelled")


def _distinct(rows: Sequence[Sequence[str | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of each token and the distinct tokens; a null one counts as empty."""
    return pd.factorize(np.array([t or "" for r in rows for t in r], dtype=object))


def _coded(rows: Sequence[Sequence[str]], known: Known) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the attributes of each token end to end, and how many each has."""
    codes = known.numbers_of([a for r in rows for a in r])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return codes[codes >= 0], np.bincount(owner[codes >= 0], minlength=len(rows)).astype(np.int32)


def _blocks(given: DataFrame, labels: Sequence[str], names: list[str], lookups: Lookups) -> DataFrame:
    """Training rows in blocks of bounded size. Rows without tokens, and those with an unknown label, are left out."""
    known = given.sparkSession.sparkContext.broadcast(Known(names))
    number = {n: i for i, n in enumerate(labels)}
    rows = given.select(
        F.transform("pairs", lambda p: p["token"]).alias("tokens"), F.transform("pairs", lambda p: p["label"]).alias("labels"), "fold"
    ).where((F.size("tokens") > 0) & F.forall("labels", lambda n: F.coalesce(n.isin(list(labels)), F.lit(False))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                tokens, given = part.column("tokens").to_pylist(), part.column("labels").to_pylist()
                at, distinct = _distinct(tokens)
                codes, counts = _coded([attributes(t, lookups) for t in distinct], known.value)
                columns = [
                    codes,
                    counts,
                    at.astype(np.int32),
                    np.array([len(r) for r in tokens], np.int32),
                    np.array([number[n] for r in given for n in r], np.int16),
                    part.column("fold").to_numpy().astype(np.int16),
                ]
                names = ["codes", "counts", "at", "sizes", "labels", "folds"]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names)

    return rows.mapInArrow(run, BLOCKS)


@dataclass
class Sequences:
    """Some coded rows: distinct tokens with their attributes, tokens end to end, rows."""

    codes: np.ndarray
    counts: np.ndarray
    at: np.ndarray
    sizes: np.ndarray
    labels: np.ndarray | None = None
    folds: np.ndarray | None = None
    place: np.ndarray = field(init=False)
    left: np.ndarray = field(init=False)
    own_codes: np.ndarray = field(init=False)
    code_at: np.ndarray = field(init=False)
    owner: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        ends = np.cumsum(self.sizes)
        self.place = np.arange(len(self.at)) - np.repeat(ends - self.sizes, self.sizes)
        self.left = np.repeat(self.sizes, self.sizes) - 1 - self.place
        self.own_codes, self.code_at = np.unique(self.codes, return_inverse=True)
        self.owner = np.repeat(np.arange(len(self.counts)), self.counts)

    @classmethod
    def unpack(cls, batch: pa.RecordBatch, i: int) -> "Sequences":
        kinds = (np.int32, np.int32, np.int32, np.int32, np.int16, np.int16)
        return cls(*[np.frombuffer(c[i].as_py(), k) for c, k in zip(batch.columns, kinds, strict=True)])

    def subset(self, rows: np.ndarray) -> "Sequences":
        """The chosen rows, with the attributes of all tokens."""
        inside = np.repeat(rows, self.sizes)
        return Sequences(self.codes, self.counts, self.at[inside], self.sizes[rows], self.labels[inside], self.folds[rows])

    def weight_rows(self, layout: "Layout") -> np.ndarray:
        """Rows of the weights that these rows may meet: those of their attributes by slot, of places and of transitions."""
        n = layout.attributes
        slots = [i * n + self.own_codes for i in range(len(SLOTS))]
        return np.concatenate([*slots, np.arange(len(SLOTS) * n, layout.size // layout.labels)]).astype(np.int64)

    def places(self) -> np.ndarray:
        """Which of PLACES hold for each token."""
        first, last, several = self.place == 0, self.left == 0, np.repeat(self.sizes > 1, self.sizes)
        return np.stack([first & several, last & several, ~several, self.place == 1, (self.left == 1) & several])


@dataclass(frozen=True)
class Layout:
    """Where the weights of a model stand in one vector."""

    attributes: int
    labels: int

    @property
    def size(self) -> int:
        return (len(SLOTS) * self.attributes + len(PLACES) + self.labels) * self.labels

    def views(self, weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Weights per slot, of places, and of transitions."""
        rows = weights.reshape(-1, self.labels)
        n = self.attributes
        return [rows[i * n : (i + 1) * n] for i in range(len(SLOTS))], rows[len(SLOTS) * n : -self.labels], rows[-self.labels :]


@dataclass(frozen=True)
class Sparse:
    """A vector of weights that is zero but at some places, which ascend."""

    at: np.ndarray
    values: np.ndarray

    def placed(self, rows: np.ndarray, labels: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the places lie in the given rows of weights, and where there, the rows end to end."""
        low, high = (np.searchsorted(self.at, r * labels) for r in (rows, rows + 1))
        sizes = high - low
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        held = np.repeat(low, sizes) + inside
        return held, self.at[held] + np.repeat((np.arange(len(rows)) - rows) * labels, sizes)


def _own(given: Sequences, layout: Layout, weights: np.ndarray | Sparse) -> np.ndarray:
    """The rows of weights that the given rows may meet."""
    rows = given.weight_rows(layout)
    if not isinstance(weights, Sparse):
        return weights.reshape(-1, layout.labels)[rows]
    held, there = weights.placed(rows, layout.labels)
    own = np.zeros(len(rows) * layout.labels)
    own[there] = weights.values[held]
    return own.reshape(-1, layout.labels)


def _per_token(given: Sequences, own: np.ndarray) -> list[np.ndarray]:
    """Per slot the sums of the weights of each distinct token's attributes, a row per label."""
    n, owner, several = len(given.own_codes), given.owner, len(given.counts)
    slots = [own[i * n : (i + 1) * n].T for i in range(len(SLOTS))]
    return [np.stack([np.bincount(owner, w[given.code_at], several) for w in s]) for s in slots]


def emissions(given: Sequences, layout: Layout, weights: np.ndarray | Sparse) -> np.ndarray:
    """Score of each label at each token."""
    table = _own(given, layout, weights)
    own, before, after = (s.T for s in _per_token(given, table))
    emit = own[given.at] + given.places().T.astype(float) @ table[-len(PLACES) - layout.labels : -layout.labels]
    inner, outer = given.place > 0, given.left > 0
    emit[inner] += before[given.at[np.flatnonzero(inner) - 1]]
    emit[outer] += after[given.at[np.flatnonzero(outer) + 1]]
    return emit


class Lattice:
    """The chosen rows place by place, longer rows first, so that all rows that reach a place stand side by side.

    Each row counts `times` times.
    """

    def __init__(self, given: Sequences, labels: int, rows: np.ndarray, times: np.ndarray | None = None):
        chosen = np.flatnonzero(rows & (given.sizes > 0))
        chosen = chosen[np.argsort(-given.sizes[chosen], kind="stable")]
        sizes, starts = given.sizes[chosen], (np.cumsum(given.sizes) - given.sizes)[chosen]
        width = int(sizes[0]) if len(sizes) else 0
        live = [int(np.searchsorted(-sizes, -t)) for t in range(width + 2)]
        ends = np.cumsum(live)
        self.given, self.k, self.width, self.opened = given, labels, width, live[0]
        self.parts = [slice(int(e) - n, int(e)) for e, n in zip(ends, live, strict=True)][:width]
        # Of each place the rows that go on.
        self.onward = [slice(p.start, p.start + n) for p, n in zip(self.parts, live[1:])]
        here = np.concatenate([np.zeros(0, np.int64), *[starts[: live[t]] + t for t in range(width)]]).astype(np.intp)
        self.tokens, self.labels = given.at[here].astype(np.intp), given.labels[here].astype(np.intp)
        self.before = np.concatenate([self.tokens[:0], *[self.tokens[p] for p in self.onward]])
        self.places = np.arange(len(here))
        weighed = np.ones(len(chosen)) if times is None else times[chosen].astype(float)
        self.times = np.concatenate([np.zeros(0), *[weighed[:n] for n in live[:width]]])
        self.moved = np.zeros((labels, labels))
        np.add.at(self.moved, (self.onto(self.labels), self.labels[self.opened :]), self.times[self.opened :])
        # Where each of PLACES holds.
        self.flags: list[list[slice]] = [[] for _ in PLACES]
        for t, part in enumerate(self.parts):
            first, more, last = part.start, live[t + 1], live[t + 2]
            if t == 0:
                self.flags[0], self.flags[2] = [slice(0, more)], [slice(more, part.stop)]
            else:
                self.flags[1].append(slice(first + more, part.stop))
            if t == 1:
                self.flags[3] = [part]
            self.flags[4].append(slice(first + last, first + more))

    def onto(self, rows: np.ndarray) -> np.ndarray:
        """What stands at the places before, for all places but the first ones."""
        return np.concatenate([rows[..., :0], *[rows[..., p] for p in self.onward]], axis=-1)

    def loss_and_gradient(self, own: np.ndarray) -> tuple[float, np.ndarray]:
        """Negative log-likelihood and its gradient, for the weights that the rows may meet."""
        given, k, n, several = self.given, self.k, len(self.given.own_codes), len(self.given.counts)
        moves, marks = own[-k:], own[-k - len(PLACES) : -k]
        mine, before, after = _per_token(given, own)
        emit = mine.take(self.tokens, axis=1)
        emit[:, self.opened :] += before.take(self.before, axis=1)
        after = after.take(self.tokens[self.opened :], axis=1)
        for p, q in zip(self.onward, self.parts[1:]):
            emit[:, p] += after[:, q.start - self.opened : q.stop - self.opened]
        for flags, mark in zip(self.flags, marks, strict=True):
            for p in flags:
                emit[:, p] += mark[:, None]
        if not self.width:
            return 0.0, np.zeros_like(own)
        peak, highest = emit.max(axis=0), moves.max()
        step = np.exp(moves - highest)
        loss = ((peak - emit[self.labels, self.places]) * self.times).sum() - (moves * self.moved).sum()
        loss += highest * self.times[self.opened :].sum()
        local = np.exp(emit - peak)
        alpha, beta, scale = np.empty_like(local), np.ones_like(local), np.empty(len(peak))
        for t, p in enumerate(self.parts):
            ahead = local[:, p] if not t else (step.T @ alpha[:, self.onward[t - 1]]) * local[:, p]
            scale[p] = ahead.sum(axis=0)
            alpha[:, p] = ahead / scale[p]
        loss += (np.log(scale) * self.times).sum()
        local /= scale
        pairs = np.zeros((k, k))
        for t in range(self.width - 2, -1, -1):
            p, q = self.onward[t], self.parts[t + 1]
            back = local[:, q] * beta[:, q]
            beta[:, p] = step @ back
            pairs += alpha[:, p] @ (back * self.times[q]).T
        resid = alpha * beta
        resid[self.labels, self.places] -= 1.0
        resid *= self.times
        out = np.empty_like(own)
        ahead, behind = resid[:, self.opened :], self.onto(resid)
        slots = ((self.tokens, resid), (self.before, ahead), (self.tokens[self.opened :], behind))
        for i, (tokens, rows) in enumerate(slots):
            for label, row in enumerate(rows):
                per_token = np.bincount(tokens, row, several)
                out[i * n : (i + 1) * n, label] = np.bincount(given.code_at, per_token[given.owner], n)
        for i, flags in enumerate(self.flags):
            out[len(SLOTS) * n + i] = sum((resid[:, p].sum(axis=1) for p in flags), np.zeros(k))
        out[-k:] = pairs * step - self.moved
        return float(loss), out


def loss_and_gradient(given: Sequences, layout: Layout, weights: np.ndarray | Sparse, rows: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of the chosen rows and its gradient, by forward and backward passes."""
    loss, own = Lattice(given, layout.labels, rows).loss_and_gradient(_own(given, layout, weights))
    out = np.zeros((layout.size // layout.labels, layout.labels))
    out[given.weight_rows(layout)] = own
    return loss, out.ravel()


def seen(given: Sequences, labels: int, rows: np.ndarray) -> np.ndarray:
    """How often each attribute, place and transition met each label in the chosen rows, by weight_rows."""
    n, several, chosen = len(given.own_codes), len(given.counts), np.repeat(rows, given.sizes)
    inner, outer = np.flatnonzero((given.place > 0) & chosen), np.flatnonzero((given.left > 0) & chosen)
    out = np.zeros((len(SLOTS) * n + len(PLACES) + labels, labels))
    whole = np.flatnonzero(chosen)
    for i, (here, there) in enumerate(zip((whole, inner, outer), (whole, inner - 1, outer + 1), strict=True)):
        hits = np.bincount(given.at[there] * labels + given.labels[here], minlength=several * labels).reshape(-1, labels)
        for label, row in enumerate(hits.T):
            out[i * n : (i + 1) * n, label] = np.bincount(given.code_at, row[given.owner], n)
    for i, held in enumerate(given.places()):
        out[len(SLOTS) * n + i] = np.bincount(given.labels[held & chosen], minlength=labels)
    np.add.at(out[-labels:], (given.labels[inner - 1], given.labels[inner]), 1.0)
    return out


# --- passes ------------------------------------------------------------------------


def _met(blocks: DataFrame, layout: Layout, folds: Sequence[int], min_freq: float, all_transitions: bool) -> dict[int, np.ndarray]:
    """For each fold the places of the weights that were met at least min_freq times, once at least, outside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                given = Sequences.unpack(batch, i)
                rows = given.weight_rows(layout)
                for fold in np.unique(given.folds):
                    hits = seen(given, layout.labels, given.folds == fold)
                    row, label = np.nonzero(hits)
                    columns = [rows[row] * layout.labels + label, np.full(len(row), fold, np.int32), hits[row, label].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["place", "fold", "n"])

    cells = blocks.mapInArrow(run, "place long, fold int, n long").groupBy("place")
    outside = [F.coalesce(F.sum(F.when(F.col("fold") != f, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, f in enumerate(folds)]
    cells = cells.agg(*outside).toArrow()
    place = cells["place"].to_numpy()
    always = np.arange(layout.size - layout.labels**2 if all_transitions else layout.size, layout.size)
    return {f: np.union1d(place[cells[f"n{i}"].to_numpy() >= max(min_freq, 0.5)], always) for i, f in enumerate(folds)}


def _added(
    blocks: DataFrame, layout: Layout, models: list[tuple[int, np.ndarray]], free: dict[int, np.ndarray], known: Broadcast, at_least: int = 1
) -> list[tuple[float, np.ndarray]]:
    """Loss and gradient of each model, a fold to leave out and the values of the weights that are free in it.

    Tasks send sums by chunk of the free weights, as whole multiples of the grains, without zeros. Each adds up
    its blocks, and tasks meet by chunk. Models are dealt to groups, each a scan of its own, so that a task holds
    a bounded number of sums, or those of one model; few blocks are scanned by at_least groups, so that all cores have work.
    """
    sent = blocks.sparkSession.sparkContext.broadcast(models)
    sizes = [len(free[f]) for f, _ in models]
    groups = min(len(models), max(at_least, -(-sum(sizes) // SUMS_PER_TASK)))

    def of_group(own: list[int]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {m: np.zeros(sizes[m] + 1) for m in own}
            for batch in batches:
                for i in range(batch.num_rows):
                    given = Sequences.unpack(batch, i)
                    rows = given.weight_rows(layout)
                    shared = {}
                    for m in own:
                        fold, values = sent.value[m]
                        if fold not in shared:
                            held, there = Sparse(known.value[fold], values).placed(rows, layout.labels)
                            shared[fold] = Lattice(given, layout.labels, given.folds != fold), held, there
                        lattice, held, there = shared[fold]
                        weights = np.zeros(len(rows) * layout.labels)
                        weights[there] = values[held]
                        loss, gradient = lattice.loss_and_gradient(weights.reshape(-1, layout.labels))
                        sums[m][0] += loss
                        sums[m][1 + held] += gradient.ravel()[there]
            for m, sum_ in sums.items():
                grains = np.rint(sum_ / np.where(np.arange(len(sum_)), FINE_GRAIN, GRAIN)).astype(np.int64)
                for start in range(0, len(grains), CHUNK):
                    part = grains[start : start + CHUNK]
                    at = np.flatnonzero(part)
                    if len(at):
                        columns = [[m], [start], [at.astype(np.int16).tobytes()], [part[at].tobytes()]]
                        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                        yield pa.RecordBatch.from_arrays(arrays, ["model", "start", "at", "sums"])

        return blocks.mapInArrow(run, "model int, start int, at binary, sums binary")

    def unite(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(CHUNK, np.int64)
        for batch in batches:
            for at, sums in zip(batch.column("at").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                whole[np.frombuffer(at, np.int16)] += np.frombuffer(sums, np.int64)
        columns = [pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([whole.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["model", "start", "sums"])

    partial = reduce(DataFrame.unionByName, [of_group(list(range(g, len(models), groups))) for g in range(groups)])
    united = partial.groupBy("model", "start").applyInArrow(unite, "model int, start int, sums binary")
    out = [np.zeros(n + 1) for n in sizes]
    for r in united.toLocalIterator():
        here = out[r["model"]][r["start"] : r["start"] + CHUNK]
        here += np.frombuffer(bytes(r["sums"]), np.int64)[: len(here)] * FINE_GRAIN
    sent.destroy()
    return [(float(x[0] / FINE_GRAIN * GRAIN), x[1:]) for x in out]


# --- solver ------------------------------------------------------------------------


@dataclass(frozen=True)
class Penalty:
    """Weights of the sum of absolute values and of the sum of squares."""

    c1: float = 0.3
    c2: float = 0.001


def minimise(
    free: np.ndarray,
    penalty: Penalty,
    steps: int | None = 100,
    memory: int = 6,
    epsilon: float = 1e-5,
    delta: float = 1e-5,
    period: int = 10,
    start: np.ndarray | None = None,
) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Orthant-wise quasi-Newton steps. Yields points, is sent loss and gradient there, returns the best point.

    Weights that are not free stay zero. Without c1 this is the plain limited-memory method. Ends when
    the gradient is small, when period steps have gained less than the share delta, or after so many steps, if
    they are given. Starts at zero or at the given point.
    """

    def whole(loss: float, gradient: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        return loss + penalty.c2 * (x @ x) + penalty.c1 * np.abs(x).sum(), np.where(free, gradient + 2 * penalty.c2 * x, 0.0)

    def slope(x: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The gradient with the steepest of the one-sided slopes of the absolute values."""
        sides = np.where(g + penalty.c1 < 0, g + penalty.c1, np.where(g - penalty.c1 > 0, g - penalty.c1, 0.0))
        return np.where(x != 0, g + penalty.c1 * np.sign(x), sides) * free

    x = np.zeros(len(free)) if start is None else start
    loss, g = whole(*(yield x), x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    past = [loss]
    for _ in count() if steps is None else range(steps):
        down = slope(x, g)
        if np.linalg.norm(down) <= epsilon * max(1.0, np.linalg.norm(x)):
            break
        d, held = -down, []
        for s, y in reversed(moves):
            a = (s @ d) / (s @ y)
            d, held = d - a * y, [*held, a]
        if moves:
            s, y = moves[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(moves, reversed(held), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        d = np.where(d * down < 0, d, 0.0) if penalty.c1 else d
        if d @ down >= 0:
            d, moves = -down, []
        side = np.where(x != 0, np.sign(x), -np.sign(down))
        rate = 1.0 if moves else 1.0 / np.linalg.norm(d)
        for _ in range(30):
            to = x + rate * d
            if penalty.c1:
                to = np.where(to * side < 0, 0.0, to)
            reached, slope_there = whole(*(yield to), to)
            if reached <= loss + 1e-4 * (down @ (to - x)):
                break
            rate /= 2
        else:
            break
        s, y = to - x, slope_there - g
        if s @ y > 1e-12:
            moves = [*moves, (s, y)][-memory:]
        x, loss, g = to, reached, slope_there
        past.append(loss)
        if len(past) > period and past[-period - 1] - loss < delta * abs(loss):
            break
    return x


def _solved(
    blocks: DataFrame, layout: Layout, runs: list[tuple[int, Penalty]], free: dict[int, np.ndarray], steps: int | None, memory: int = 6
) -> Iterator[tuple[int, np.ndarray]]:
    """Number and values of the free weights for each pair of a fold to leave out and a penalty, as they are found.

    Every pass serves all solvers that run; so many run at a time that their vectors, of the free weights
    alone, stay within SOLVED_AT_ONCE, or one. The next starts where one has ended.
    """
    at_least = blocks.sparkSession.sparkContext.defaultParallelism // max(1, blocks.count())
    known = blocks.sparkSession.sparkContext.broadcast(free)
    # Points and slopes that a solver remembers, and some at hand.
    at_once = max(1, SOLVED_AT_ONCE // (max(1, *map(len, free.values())) * (2 * memory + 8)))
    solvers, asked = {}, {}
    waiting = list(enumerate(runs))[::-1]
    while asked or waiting:
        while waiting and len(asked) < at_once:
            i, (fold, penalty) = waiting.pop()
            solvers[i] = minimise(np.ones(len(free[fold]), bool), penalty, steps, memory)
            asked[i] = next(solvers[i])
        live = sorted(asked)
        found = _added(blocks, layout, [(runs[i][0], asked[i]) for i in live], free, known, at_least)
        for i, sums in zip(live, found, strict=True):
            try:
                asked[i] = solvers[i].send(sums)
            except StopIteration as end:
                del asked[i], solvers[i]
                yield i, end.value
    known.destroy()


@dataclass(frozen=True)
class Field:
    """A trained model: labels, attributes, and the weights as Layout places them."""

    labels: tuple[str, ...]
    attributes: tuple[str, ...]
    weights: np.ndarray
    lookups: Lookups = Lookups()

    @property
    def layout(self) -> Layout:
        return Layout(len(self.attributes), len(self.labels))


def fit_field(
    labelled: DataFrame,
    column: str = "labelled",
    labels: Sequence[str] = TAG_LABELS,
    lookups: Lookups = Lookups(),
    penalty: Penalty = Penalty(),
    min_freq: float = 0.0,
    all_transitions: bool = True,
    steps: int | None = 100,
    most: int | None = None,
) -> Field:
    """Weights that fit the labelled rows best under a penalty.

    Only pairs of attribute and label that were met at least min_freq times, once at least, have a
    weight; transitions all have one with all_transitions. All attributes are kept, or at most `most`.
    Without a row to learn from all weights are zero.
    """
    rows = _rows(labelled, column, F.lit(0))
    names = _kept(rows, "pairs", lookups, min_freq, most)
    blocks = settle(_blocks(rows, labels, names, lookups), "sequences")
    layout = Layout(len(names), len(labels))
    weights = np.zeros(layout.size)
    free = _met(blocks, layout, [-1], min_freq, all_transitions)
    for _, found in _solved(blocks, layout, [(-1, penalty)], free, steps):
        weights[free[-1]] = found
    return Field(tuple(labels), tuple(names), weights, lookups)


def first_gradient(labelled: DataFrame, column: str = "labelled", labels: Sequence[str] = TAG_LABELS, lookups: Lookups = Lookups()) -> DataFrame:
    """(slot, attribute, label, gradient) where all weights are zero: what the solver starts from.

    Transitions have the slot move and the label before as their attribute, places the slot place.
    """
    given = _rows(labelled, column, F.lit(0))
    names = _kept(given, "pairs", lookups, 0)
    layout = Layout(len(names), len(labels))
    blocks = _blocks(given, labels, names, lookups)
    spark = labelled.sparkSession
    slopes = [f"slope{i}" for i in range(layout.labels)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Sequences.unpack(batch, i)
                rows = block.weight_rows(layout)
                lattice = Lattice(block, layout.labels, np.ones(len(block.sizes), bool))
                own = lattice.loss_and_gradient(np.zeros((len(rows), layout.labels)))[1]
                columns = [rows, *np.rint(own.T / FINE_GRAIN).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", *slopes])

    added = blocks.mapInArrow(run, "id long, " + ", ".join(f"{c} long" for c in slopes))
    added = added.groupBy("id").agg(*[F.sum(c).alias(c) for c in slopes])
    sent = spark.sparkContext.broadcast((pa.array(names, pa.large_string()), tuple(labels)))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attributes_, labels_ = sent.value
        texts = pa.concat_arrays([*[attributes_] * len(SLOTS), pa.array([*PLACES, *labels_], pa.large_string())])
        slots = pa.array([*SLOTS, "place", "move"])
        ends = np.cumsum([len(attributes_)] * len(SLOTS) + [len(PLACES), len(labels_)])
        for batch in batches:
            rows = batch.column("id").to_numpy()
            slot = slots.take(pa.array(np.searchsorted(ends, rows, side="right")))
            text = texts.take(pa.array(rows)).cast(pa.string())
            for label, column in zip(labels_, slopes, strict=True):
                slope = pa.array(batch.column(column).to_numpy() * FINE_GRAIN)
                columns = [slot, text, pa.array([label] * len(rows), pa.string()), slope]
                yield pa.RecordBatch.from_arrays(columns, ["slot", "attribute", "label", "gradient"])

    # Attributes that a slot never has stand still.
    whole = spark.range(layout.size // layout.labels).join(added, "id", "left").fillna(0, slopes)
    return whole.mapInArrow(named, "slot string, attribute string, label string, gradient double")


# --- tagging -----------------------------------------------------------------------


def _decoded(given: Sequences, layout: Layout, weights: np.ndarray | Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label numbers and their probabilities end to end, and the probability of each sequence."""
    whole = np.zeros(len(given.sizes))
    names, margins = np.zeros(len(given.at), int), np.zeros(len(given.at))
    if len(names):
        emit = emissions(given, layout, weights)
        k = layout.labels
        moves = np.vstack([_own(given, layout, weights)[-k:], np.zeros(k)])
        starts = np.cumsum(given.sizes) - given.sizes
        for rows in _batches(given.sizes):
            places = np.arange(int(given.sizes[rows[-1]]))
            inside = places < given.sizes[rows][:, None]
            at = (starts[rows][:, None] + places)[inside]
            block = np.zeros((*inside.shape, k))
            block[inside] = emit[at]
            path, marginal, whole[rows] = best_path(block, moves, given.sizes[rows])
            names[at] = path[inside]
            margins[at] = marginal[inside]
    return names, margins, whole


class _Decoder:
    """Labels for batches in a Python worker; each distinct token is looked at once a batch."""

    def __init__(self, model: Field, known: Known | None = None):
        self.known = known or Known(model.attributes)
        self.layout = Layout(len(self.known.numbers), len(model.labels))
        self.attributes = lru_cache(100_000)(lambda token: attributes(token, model.lookups))

    def sequences(self, tokens: pa.ListArray) -> Sequences:
        everything = tokens.flatten().fill_null("").dictionary_encode()
        codes, counts = _coded([self.attributes(t) for t in everything.dictionary.to_pylist()], self.known)
        return Sequences(codes, counts, everything.indices.to_numpy(), np.diff(tokens.offsets.to_numpy()).astype(np.int64))

    def decode(self, given: Sequences, weights: np.ndarray | Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _decoded(given, self.layout, weights)


def tag_with_field(df: DataFrame, tokens: str, model: Field, out: str = "tagged") -> DataFrame:
    """Adds the best label of each token with its probability, and that of the sequence.

    Rows are tagged by their tokens alone, nothing is shuffled. Rows without tokens get no pairs
    and probability zero.
    """
    held = np.flatnonzero(model.weights)
    # Attributes as Known holds them, and no weights of zero.
    bare, weights = Field(model.labels, (), np.zeros(0), model.lookups), Sparse(held, model.weights[held])
    sent = df.sparkSession.sparkContext.broadcast((bare, Known(model.attributes), weights))

    @F.arrow_udf("labels array<string>, marginals array<double>, whole double")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bare, known, weights = sent.value
        decoder = _Decoder(bare, known)
        for batch in batches:
            given = decoder.sequences(batch)
            yield tagged_array(bare.labels, given.sizes, *decoder.decode(given, weights))

    given = F.coalesce(F.col(f"`{tokens}`"), F.array().cast("array<string>"))
    found = F.col("__found")
    zipped = F.arrays_zip("__tokens", found["labels"].alias("labels"), found["marginals"].alias("marginals"))
    pairs = F.transform(
        zipped, lambda x: F.struct(x["__tokens"].alias("token"), x["labels"].alias("label"), x["marginals"].alias("marginal"))
    )
    return (
        df.withColumn("__tokens", given)
        .withColumn("__found", decode(F.col("__tokens")))
        .withColumn(out, F.struct(pairs.alias("pairs"), found["whole"].alias("sequence_probability")))
        .drop("__found", "__tokens")
    )


# --- search ------------------------------------------------------------------------


def draw_penalties(n: int, seed: int = 42) -> list[Penalty]:
    """Candidates from exponential distributions of mean 0.5 and 0.05."""
    rng = np.random.default_rng(seed)
    return [Penalty(float(a), float(b)) for a, b in zip(rng.exponential(0.5, n), rng.exponential(0.05, n), strict=True)]


CELLS = "run long, label string, hits long, claimed long, support long"


def _hits(given: Sequences, fold: int, layout: Layout, weights: Sparse) -> np.ndarray:
    """Hits, claimed and support of each label, and at the end of sequences, over the rows of the fold."""
    held, n = given.subset(given.folds == fold), layout.labels
    if not len(held.sizes):
        return np.zeros((3, n + 1), np.int64)
    said = _decoded(held, layout, weights)[0]
    right = said == held.labels
    wrong = len(np.unique(np.repeat(np.arange(len(held.sizes)), held.sizes)[~right]))
    return np.array(
        [
            [*np.bincount(said[right], minlength=n), len(held.sizes) - wrong],
            [*np.bincount(said, minlength=n), 0],
            [*np.bincount(held.labels, minlength=n), len(held.sizes)],
        ]
    )


def _cells(number: int, labels: Sequence[str], sums: np.ndarray) -> pa.RecordBatch:
    """The sums of a run as rows; the label "" counts sequences."""
    arrays = [pa.array([number] * (len(labels) + 1)), pa.array([*labels, ""]), *[pa.array(c) for c in sums]]
    return pa.RecordBatch.from_arrays(arrays, ["run", "label", "hits", "claimed", "support"])


def _scored(blocks: DataFrame, layout: Layout, models: list[tuple[int, int, Sparse]], labels: Sequence[str]) -> list[tuple]:
    """Of each model (number of the run, fold, weights) its number, label, hits, claimed and support over the rows of its fold."""
    sent = blocks.sparkSession.sparkContext.broadcast(models)
    labels = tuple(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(sent.value), 3, len(labels) + 1), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                given = Sequences.unpack(batch, i)
                for (_, fold, weights), sum_ in zip(sent.value, sums, strict=True):
                    sum_ += _hits(given, fold, layout, weights)
        for (number, *_), sum_ in zip(sent.value, sums, strict=True):
            yield _cells(number, labels, sum_)

    cells = blocks.mapInArrow(run, CELLS).groupBy("run", "label").agg(*[F.sum(c).alias(c) for c in ("hits", "claimed", "support")])
    cells = [tuple(r) for r in cells.collect()]
    sent.destroy()
    return cells


def _merged(blocks: list[Sequences], kept: np.ndarray, fold: int, labels: int) -> tuple[Sequences, np.ndarray]:
    """The rows outside the fold with the kept attributes alone, equal ones once, and how often each comes.

    Tokens are numbered by the attributes they are left with, rows by their tokens and labels.
    """

    def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts = np.ascontiguousarray(rows).view(f"V{rows.shape[1] * rows.itemsize}").ravel()
        _, first, number, times = np.unique(texts, return_index=True, return_inverse=True, return_counts=True)
        return first, number, times

    def padded(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.full((len(sizes), max(1, int(sizes.max(initial=0)))), -1, np.int32)
        out[np.arange(out.shape[1]) < sizes[:, None]] = values
        return out

    codes, counts = (np.concatenate([getattr(b, c) for b in blocks]) for c in ("codes", "counts"))
    owner = np.repeat(np.arange(len(counts)), counts)[kept[codes]]
    tokens = padded(codes[kept[codes]], np.bincount(owner, minlength=len(counts)))
    first, number, _ = distinct(tokens)
    tokens = tokens[first]
    ends = np.cumsum([len(b.counts) for b in blocks])
    at, held, sizes = [], [], []
    for b, end in zip(blocks, ends, strict=True):
        rows = (b.folds != fold) & (b.sizes > 0)
        inside = np.repeat(rows, b.sizes)
        at.append(number[end - len(b.counts) + b.at[inside]])
        held.append(b.labels[inside])
        sizes.append(b.sizes[rows])
    at, held, sizes = (np.concatenate(c) for c in (at, held, sizes))
    rows = padded(at * labels + held, sizes)
    first, _, times = distinct(rows)
    rows = rows[first]
    cells = rows[rows >= 0]
    given = Sequences(
        tokens[tokens >= 0], (tokens >= 0).sum(axis=1), cells // labels, (rows >= 0).sum(axis=1), cells % labels, np.full(len(rows), -1, np.int16)
    )
    return given, times


def _optimum(
    blocks: list[Sequences], layout: Layout, fold: int, free: np.ndarray, penalty: Penalty, delta: float = 1e-5
) -> np.ndarray:
    """The free weights that fit the rows outside the fold best, for blocks that are at hand.

    With c1 most weights are zero, and rows that differ by the attributes of such weights alone are one row. So
    the most frequent attributes are solved first, over distinct rows; then all rows tell which weights at zero
    have a slope above c1, whose attributes join. Ends when there are none, or when all
    of them gained less than the share delta. Rows are worked on by so many as fit a processor's cache.
    """
    k, n, last = layout.labels, layout.attributes, len(SLOTS) * layout.attributes
    number = np.where(free // k < last, free // k % max(n, 1), n)
    lattices = [Lattice(b, k, b.folds != fold) for b in blocks]
    placed = [Sparse(free, free).placed(b.weight_rows(layout), k) for b in blocks]
    x, past = np.zeros(len(free)), None
    kept = np.arange(n) < (FIRST_ATTRIBUTES if penalty.c1 else n)
    while True:
        given, times = _merged(blocks, kept, fold, k)
        near = np.cumsum(given.sizes) // CACHED
        parts = [Lattice(given, k, near == i, times) for i in np.unique(near)]
        own = np.flatnonzero(np.append(kept, True)[number])
        held, there = Sparse(free[own], own).placed(rows := given.weight_rows(layout), k)
        solver = minimise(np.ones(len(own), bool), penalty, None, delta=delta, start=x[own])
        point = next(solver)
        while True:
            weights, slopes = np.zeros(len(rows) * k), np.zeros(len(own))
            weights[there] = point[held]
            loss = 0.0
            for part in parts:
                more, gradient = part.loss_and_gradient(weights.reshape(-1, k))
                loss += more
                slopes[held] += gradient.ravel()[there]
            try:
                point = solver.send((loss, slopes))
            except StopIteration as end:
                x[own] = end.value
                break
        slopes, loss = np.zeros(len(free)), 0.0
        for block, part, (held, there) in zip(blocks, lattices, placed, strict=True):
            weights = np.zeros(len(block.weight_rows(layout)) * k)
            weights[there] = x[held]
            more, gradient = part.loss_and_gradient(weights.reshape(-1, k))
            loss += more
            slopes[held] += gradient.ravel()[there]
        loss += penalty.c2 * (x @ x) + penalty.c1 * np.abs(x).sum()
        steep = np.zeros(n + 1, bool)
        steep[number[(x == 0) & (np.abs(slopes) > penalty.c1)]] = True
        new = steep[:n] & ~kept
        if not new.any() or (past is not None and past - loss < delta * abs(loss)):
            return x
        kept, past = kept | new, loss


def _each_solved(
    blocks: DataFrame, layout: Layout, runs: list[tuple[int, Penalty]], free: dict[int, np.ndarray], labels: Sequence[str]
) -> list[tuple]:
    """What _scored gives for all runs, each solved to the end and scored in a task of its own, to which the blocks are sent."""
    sent = blocks.sparkSession.sparkContext.broadcast((blocks.toArrow().to_batches(), free))
    labels = tuple(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, free_ = sent.value
        given = [Sequences.unpack(p, i) for p in parts for i in range(p.num_rows)]
        for batch in batches:
            for number in batch.column("id").to_pylist():
                fold, penalty = runs[number]
                found = _optimum(given, layout, fold, free_[fold], penalty)
                weights = Sparse(free_[fold][found != 0], found[found != 0])
                yield _cells(number, labels, sum(_hits(g, fold, layout, weights) for g in given))

    numbers = blocks.sparkSession.range(0, len(runs), 1, max(1, len(runs)))
    cells = [tuple(r) for r in numbers.mapInArrow(run, CELLS).collect()]
    sent.destroy()
    return cells


def tune_field(
    labelled: DataFrame,
    key: str,
    candidates: Sequence[Penalty],
    folds: int = 3,
    seed: int = 42,
    column: str = "labelled",
    labels: Sequence[str] = TAG_LABELS,
    lookups: Lookups = Lookups(),
    objective: str = "sequence_accuracy",
    min_freq: float = 0.0,
    all_transitions: bool = True,
    steps: int | None = None,
    most: int | None = None,
) -> DataFrame:
    """Cross-validated scores of all penalties, best by the objective first.

    The objectives are sequence_accuracy, the share of fully right sequences, and weighted_f1. Without steps each
    candidate is trained until it gains no more. If the blocks are small enough to be sent, a task trains and scores
    a candidate and fold. Else as many of them as the driver has room for are trained by the same passes over the
    rows, and those that have ended are scored together.
    """
    fold = F.floor(uniform(F.col(f"`{key}`"), seed, "fold") * folds)
    rows = _rows(labelled, column, fold)
    names = _kept(rows, "pairs", lookups, min_freq, most)
    blocks = settle(_blocks(rows, labels, names, lookups), "sequences")
    layout = Layout(len(names), len(labels))
    runs = [(k, c) for k in range(folds) for c in candidates]
    free = _met(blocks, layout, range(folds), min_freq, all_transitions)
    size = sum((F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in blocks.columns), F.lit(0))
    if steps is None and blocks.agg(size).first()[0] <= SENT_BYTES and max(map(len, free.values())) <= SOLVED_AT_ONCE:
        scored = _each_solved(blocks, layout, runs, free, labels)
    else:
        scored, waiting, held, left = [], [], 0, len(runs)
        for i, found in _solved(blocks, layout, runs, free, steps):
            nonzero, own = np.flatnonzero(found), free[runs[i][0]]
            waiting, held, left = [*waiting, (i, runs[i][0], Sparse(own[nonzero], found[nonzero]))], held + len(nonzero), left - 1
            if held >= SOLVED_AT_ONCE // 4 or not left:
                scored += _scored(blocks, layout, waiting, labels)
                waiting, held = [], 0
    # A row per run and label, whatever the number of addresses.
    cells = sorted((i % len(candidates), runs[i][0], *cell) for i, *cell in scored)
    kinds = "candidate long, fold long, label string, hits long, claimed long, support long"
    cells = labelled.sparkSession.createDataFrame(cells, kinds)
    cells = cells.groupBy("candidate", "fold", "label").agg(*[F.sum(c).alias(c) for c in ("hits", "claimed", "support")])
    whole = F.col("label") == ""
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hits"), F.col("claimed") + F.col("support")), F.lit(0.0))
    support = F.when(~whole, F.col("support"))
    folded = cells.groupBy("candidate", "fold").agg(
        F.sum(F.when(whole, F.try_divide("hits", "support"))).alias("sequence_accuracy"),
        F.try_divide(F.sum(f1 * support), F.sum(support)).alias("weighted_f1"),
    )
    means = folded.groupBy("candidate").agg(*[F.avg(c).alias(c) for c in ("sequence_accuracy", "weighted_f1")])
    given = F.array(*[F.struct(F.lit(p.c1).alias("c1"), F.lit(p.c2).alias("c2")) for p in candidates])
    found = means.withColumn("p", F.element_at(given, F.col("candidate").cast("int") + 1))
    return found.select("candidate", "p.*", "sequence_accuracy", "weighted_f1").orderBy(F.desc(objective), "candidate")


def refit_field(labelled: DataFrame, tuned: DataFrame, **options) -> Field:
    """The best penalty of a search, trained on all rows."""
    best = tuned.first()
    return fit_field(labelled, penalty=Penalty(best["c1"], best["c2"]), **options)
