import public_tokenizers
import pytest

import brute
import corpus_pipeline
from gableframe.llm import bpe
from gableframe.llm.queries import WORD_BPE
from test_near_copies import brute as near_copies

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain(rows):
    """The five stages on rows of (doc_id, text, source)."""
    rows = [r for r in rows if brute.judged(r[1])[-1]]
    groups = {d: c for d, _, c in near_copies([r[:2] for r in rows])}
    rows = [r for r in rows if groups[repr(r[0])] == r[0]]
    cut = brute.cut([r[:2] for r in rows])
    rows = [(d, t if n == len(k) else " ".join(k), s) for (d, t, s), (n, k) in zip(rows, cut, strict=True) if k]
    sizes = [(d, s, len(brute.words(t))) for d, t, s in rows]
    out = []
    for (d, t, _), (_, _, size), (_, _, taken) in zip(rows, sizes, brute.mixed(sizes), strict=True):
        while taken > 0:
            out.append((d, t if taken >= size else " ".join(brute.words(t)[:taken])))
            taken -= size
    return out


def test_run_is_what_the_stages_say(spark, sf_dir, documents):
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    codec = bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    want = [(d, codec.whole.encode(t, add_special_tokens=False).ids) for d, t in plain(rows)]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted(want)
    assert all(r.n_tokens == len(r.ids) for r in got)


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_the_columns(spark, sf_dir, documents, stage):
    name, step = corpus_pipeline.STAGES[stage]
    out = step(spark, documents, sf_dir)
    assert out.columns == COLUMNS and out.count() > 0
    assert step(spark, documents.limit(0), sf_dir).count() == 0
    assert WORD_BPE.endswith(".json") and name
