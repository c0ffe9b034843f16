"""Language of a text: multinomial regression on TF-IDF of hashed character n-grams."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gableframe.llm import linear
from gableframe.scratch import settle

BITS = 16
SIZES = (1, 2, 3)
FOLDS = 5
# About so many labelled texts of each language are learnt from; a fifth of them sets the temperature.
SAMPLE_PER_LANGUAGE = 1500
# Features are small, as their shares sum up to one per size of n-gram.
PACE = linear.Pace(alpha=60, l1=1e-4, l2=1e-4, rounds=5)
UNKNOWN = "und"
PIECE = 1 << 18
LETTER = regex.compile(r"\p{L}")
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def grams(text: str, bits: int = BITS) -> Iterator[np.ndarray]:
    """Features of all n-grams of the lower-cased text, white space as one blank, piece by piece."""
    plain = f" {' '.join(text.lower().split())} "
    for at in range(0, len(plain), PIECE):
        code = np.frombuffer(plain[max(0, at - 2) : at + PIECE].encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        lead = min(at, 2)  # what the piece before has counted
        key = code
        for n, factor in zip(SIZES, FACTORS, strict=True):
            if n > 1:
                key = (key[:-1] << np.uint64(21)) | code[n - 1 :]
            yield ((key[max(0, lead - n + 1) :] * np.uint64(factor)) >> np.uint64(64 - bits)).astype(np.int64)


def held_out(id_col: Column) -> Column:
    """Fold 0 by the checksum of the id; a null id is held out."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _document_counts(texts: DataFrame, bits: int) -> np.ndarray:
    """In how many texts each feature occurs; the last is the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in _strings(batch):
                seen = np.zeros(1 << bits, bool)
                for f in grams(text or "", bits):
                    seen[f] = True
                df += seen
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"f": np.append(at, 1 << bits), "n": np.append(df[at], n)})

    out = np.zeros((1 << bits) + 1)
    for row in texts.mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["f"]] = row["n"]
    return out


def _strings(batch: pa.RecordBatch) -> Iterator[str | None]:
    column = batch.column("text")
    for at in range(0, len(column), 64):
        yield from column.slice(at, 64).to_pylist()


def _examples(rows: DataFrame, idf: np.ndarray, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ats, xs = [], []
            for text in _strings(batch):
                count = np.zeros(1 << bits)
                for f in grams(text or "", bits):
                    count += np.bincount(f, minlength=1 << bits)
                at = np.flatnonzero(count)
                ats.append(at.astype(np.int32))
                xs.append(count[at] * idf[at] / count.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("label"), pa.array(ats, pa.list_(pa.int32())), pa.array(xs, pa.list_(pa.float64()))],
                ["key", "label", "at", "x"],
            )

    return rows.mapInArrow(run, "key long, label int, at array<int>, x array<double>")


class Model:
    """Languages, the table that scores each feature, the bias, and the temperature."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, bits: int):
        self.languages, self.table, self.bias = languages, table, bias
        self.temperature, self.bits = temperature, bits

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not LETTER.search(text):
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.languages)), 0
        for f in grams(text, self.bits):
            total += self.table[f].sum(axis=0, dtype=np.float64)
            n += len(f)
        p = linear.softmax((total / n + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def train(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", bits: int = BITS,
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> Model:
    """Learns from rows with a language.

    Document frequencies are those of all rows. The regression learns from a sample, by the hash of
    the key, of about per_language texts of each language. A feature is the share of the n-grams
    of the text that fall on it, times its inverse document frequency.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(
        F.xxhash64(F.col(key_col).cast("string")).alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros(0), 1.0, bits)
    counts = _document_counts(rows.select("text"), bits)
    idf = np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1
    known = F.create_map(*[F.lit(v) for k in languages for v in (k, languages.index(k))])
    rate = F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, per_language / sizes[k]))])
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(draw < rate[F.col("lang")]).select("key", known[F.col("lang")].cast("int").alias("label"), "text")
    examples = settle(_examples(sample, idf, bits), "examples")
    aside = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(5)) == 0
    weights = linear.fit(examples.where(~aside), len(languages), 1 << bits, PACE)
    heat = linear.temperature(examples.where(aside), weights)
    return Model(languages, (weights[:-1] * idf[:, None]).astype(np.float32), weights[-1], heat, bits)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score (the calibrated probability).

    Null texts, and texts without a letter, are 'und' with score 0; so is every text if nothing was learnt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in _strings(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
