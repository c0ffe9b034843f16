"""The regression, its temperature, TF-IDF and token counts against plain loops."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gableframe.llm import langid, linear, tokencounts

EXAMPLES = "key long, label int, at array<int>, x array<double>"


@pytest.fixture(scope="module")
def examples():
    rng = random.Random(1)
    rows = []
    for key in range(120):
        label = rng.randrange(3)
        at = sorted(rng.sample(range(10), 4) + [10 + label] * (rng.random() < 0.8))
        rows.append((key, label, at, [round(rng.uniform(0.1, 1.0), 3) for _ in at]))
    return rows


def plain_weight(z, n, pace):
    if abs(z) <= pace.l1:
        return 0.0
    return -(z - math.copysign(pace.l1, z)) / ((pace.beta + math.sqrt(n)) / pace.alpha + pace.l2)


def plain_fit(shards, classes, features, pace):
    """Shards of examples in order; one number at a time."""
    z, n = defaultdict(float), defaultdict(float)
    total = sum(map(len, shards))
    for _ in range(pace.rounds):
        states = []
        for rows in shards:
            z1, n1 = defaultdict(float, z), defaultdict(float, n)
            for _, label, at, x in rows:
                cells = [*zip(at, x), (features, 1.0)]
                w = {(i, c): plain_weight(z1[i, c], n1[i, c], pace) for i, _ in cells for c in range(classes)}
                scores = [sum(v * w[i, c] for i, v in cells) for c in range(classes)]
                top = max(scores)
                e = [math.exp(s - top) for s in scores]
                for i, v in cells:
                    for c in range(classes):
                        g = v * (e[c] / sum(e) - (c == label))
                        step = (math.sqrt(n1[i, c] + g * g) - math.sqrt(n1[i, c])) / pace.alpha
                        z1[i, c] += g - step * w[i, c]
                        n1[i, c] += g * g
            states.append((len(rows), z1, n1))
        z = defaultdict(float, {k: sum(m / total * s[k] for m, s, _ in states) for k in {k for _, s, _ in states for k in s}})
        n = defaultdict(float, {k: sum(m / total * s[k] for m, _, s in states) for k in {k for _, _, s in states for k in s}})
    return [[plain_weight(z[i, c], n[i, c], pace) for c in range(classes)] for i in range(features + 1)]


def test_fit_and_temperature(spark, examples):
    pace = linear.Pace(alpha=1.5, l1=0.05, l2=0.01, rounds=2)
    df = spark.createDataFrame(examples, EXAMPLES)
    dealt = defaultdict(list)
    for r in df.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(linear.SHARDS))).orderBy("key").collect():
        dealt[r["shard"]].append((r.key, r.label, r["at"], r.x))
    weights = linear.fit(df, 3, 16, pace)
    want = np.array(plain_fit(list(dealt.values()), 3, 16, pace))
    assert np.abs(weights - want).max() < 1e-9 and (want[13:16] == 0).all() and (want == 0).sum() > 9

    def loss(heat):
        total = 0.0
        for _, label, at, x in examples:
            s = [sum(v * want[i][c] for i, v in zip(at, x)) + want[16][c] for c in range(3)]
            total -= s[label] / heat - math.log(sum(math.exp(v / heat) for v in s))
        return total

    assert linear.temperature(df, weights) == min(linear.TEMPERATURES, key=loss)
    assert linear.temperature(df.where("false"), weights) == 1.0


def plain_grams(text):
    plain = f" {' '.join(text.lower().split())} "
    out = Counter()
    for n, factor in zip((1, 2, 3), langid.FACTORS):
        for i in range(len(plain) - n + 1):
            key = 0
            for c in plain[i : i + n]:
                key = key << 21 | ord(c)
            out[key % 2**64 * factor % 2**64 >> 64 - 16] += 1
    return out


def test_features_are_shares_times_idf(documents):
    rows = documents.limit(40).select(F.col("doc_id").alias("key"), F.lit(0).alias("label"), "text")
    texts = {r.key: r.text or "" for r in rows.collect()}
    rows = rows.where(F.col("key").isin(list(texts)))
    counted = {k: plain_grams(t) for k, t in texts.items()}
    df = Counter(f for c in counted.values() for f in c)
    counts = langid._document_counts(rows.select("text"), 16)
    assert counts[-1] == len(texts) and all(counts[f] == n for f, n in df.items()) and counts[:-1].sum() == sum(df.values())
    idf = np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1
    for r in langid._examples(rows, idf, 16).collect():
        own, total = counted[r.key], sum(counted[r.key].values())
        want = {f: n * (math.log((1 + len(texts)) / (1 + df[f])) + 1) / total for f, n in own.items()}
        assert dict(zip(r["at"], r.x)) == pytest.approx(want)


def plain_sections(text, codec, rule):
    """Tokens per line, token by token and character by character."""
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"]
    edges = [0, *ends, *([len(text)] if not ends or ends[-1] < len(text) else [])] if text else [0, 0]
    n = max(1, len(edges) - 1)
    line_of = [next(k for k in range(n) if edges[k] <= i < edges[k + 1]) for i in range(len(text))]
    of_byte = [i for i, c in enumerate(text) for _ in c.encode()]
    firsts = {b: i for b, i in enumerate(of_byte) if b == 0 or of_byte[b - 1] != i}
    counts, crossing, at, seen = [0.0] * n, [0] * n, 0, 0
    for token in codec.encode_ordinary(text):
        size = len(codec.decode_single_token_bytes(token))
        chars = [firsts[b] for b in range(at, at + size) if b in firsts]
        at += size
        lines = [line_of[i] for i in chars] or [line_of[min(seen, len(text) - 1)]]
        seen += len(chars)
        share = Counter(lines)
        if len(share) > 1:
            for k in share:
                crossing[k] += 1
        if rule == "share":
            for k, m in share.items():
                counts[k] += m / len(lines)
        else:
            counts[lines[0] if rule == "first" else min(share, key=lambda k: (-share[k], k))] += 1
    return counts, crossing


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_lines_of_token_counts(spark, rule):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = ["a b\n\n\n  c\nd", "", "\n", "one\n", "x\n\n\n\n\n\n\n\ny", "ü€😀\n\n\r\n \n\tß\U0001f600\U0001f600", "  \n  \n\n a", "no line", "\n\n\n\n"]
    codec = tokencounts.encoding(path, pattern)[0]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(dict)
    for r in tokencounts.tokens_per_section(df, path, pattern, rule).collect():
        got[r.doc_id][r.section] = (r.n_tokens, r.n_crossing)
    for i, text in enumerate(texts):
        counts, crossing = plain_sections(text, codec, rule)
        assert [got[i][k][0] for k in sorted(got[i])] == pytest.approx(counts), text
        assert [got[i][k][1] for k in sorted(got[i])] == crossing, text


def test_shards_are_averaged_in_blocks_of_features(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, sorted(rng.choice(16, 4, replace=False).tolist()), rng.random(4).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, label int, at array<int>, x array<double>")
    whole = linear.fit(df, 3, 16, linear.Pace(rounds=2))
    monkeypatch.setattr(linear, "BLOCK", 5)
    assert np.abs(whole).max() > 0 and np.array_equal(whole, linear.fit(df, 3, 16, linear.Pace(rounds=2)))
