import os
import subprocess
import sys

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gableframe.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codecs():
    return bpe.Codec(PATH), bpe.Codec(PATH, leaf=6)


def whole(codec, text):
    ids = codec.whole.encode(text, add_special_tokens=False).ids
    return ids, codec.whole.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(
    st.one_of(
        st.text(max_size=60),
        st.text("abinthegd'sA1., \n", max_size=200),
        st.lists(st.sampled_from(["<|endoftext|>", "<|", "the", "ING", " ", "\x1c", "İ", "é", "'S", "H\u0331", "h\u0331", "I\u0307", "\u0301"]), max_size=30).map("".join),
    )
)
def test_as_the_tokenizer(codecs, text):
    text = text.encode("utf-8", "replace").decode()
    for codec in codecs:
        ids, out = codec.encode(text.encode())
        assert (ids.tolist(), out.decode()) == whole(codec, text)


@pytest.mark.parametrize("unit", ["a", "ab", "theing", "aé", "thestar", "zqxj"])
def test_long_stretches(codecs, unit):
    text = unit * (20_000 // len(unit)) + "'s" + unit * 500
    ids, out = codecs[0].encode(text.encode())
    assert (ids.tolist(), out.decode()) == whole(codecs[0], text)


def test_forgetting_changes_nothing(codecs, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 8)
    codec = bpe.Codec(PATH)
    for i in range(30):
        text = " ".join(f"w{j % (i + 3)}" for j in range(40))
        assert codec.encode(text.encode())[0].tolist() == whole(codec, text)[0]


def test_rows(documents, edges, nothing, codecs):
    for docs in (documents, edges):
        rows = docs.select("doc_id", "text").collect()
        want = sorted(repr((r.doc_id, *whole(codecs[0], r.text or ""))) for r in rows)
        assert sorted(repr((r.doc_id, r.ids, r.decoded)) for r in bpe.encoded(docs, PATH).collect()) == want
    assert bpe.encoded(nothing, PATH).count() == 0


THREADS = """
import os, sys
from gableframe.llm import bpe
own = bpe.codec(sys.argv[1])
before = len(os.listdir("/proc/self/task"))
own.encode_all([b" ".join(b"w%dx%d" % (i, j) for i in range(500)) for j in range(20)])
print(len(os.listdir("/proc/self/task")) - before)
"""


def test_a_worker_starts_no_threads_of_its_own():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("TOKENIZERS_", "RAYON_"))} | {"PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", THREADS, PATH], env=env, capture_output=True, text=True, timeout=120, check=True)
    assert done.stdout.split() == ["0"]


def test_the_merges_within_long_stretches_are_read_when_one_comes():
    own = bpe.Codec(PATH)
    own.encode(b"a few short words")
    assert "inner" not in vars(own)
    body = "ab" * bpe.LEAF
    ids = own.encode(body.encode())[0].tolist()
    assert "inner" in vars(own) and ids == own.whole.encode(body, add_special_tokens=False).ids
