"""The encoder against the library."""

import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from torusflow.llm import pieces

PATH = pieces.model_path()
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return pieces.encoder(f.read())


words = st.sampled_from(["the", "of", " ", "  ", "\n", "▁", ".", ",", "é", "漢", "😀", "<s>", "</s>", "<unk>", "<0x41>", "aaa", "ing", "\x00", "\t", "'", "##", "²."])


@given(st.one_of(st.text(max_size=40), st.lists(words, max_size=30).map("".join)))
@settings(max_examples=600, deadline=None)
def test_equals_the_library(own, text):
    ids = LIB.encode(text, add_eos=True)
    got, n, decoded = own.run(text)
    assert got == " ".join(map(str, ids)) and n == len(ids)
    assert decoded == LIB.decode(ids) == own.decode(ids)


def test_long_runs(own):
    for text in ("a" * 3000, " " * 300, "ab" * 1500, "é" * 500, "the " * 2000):
        assert own.run(text)[0] == " ".join(map(str, LIB.encode(text, add_eos=True)))


def test_table(spark):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z")]
    got = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH, texts=True).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [len(LIB.encode("Hello world")) + 1, 1, 1, 1]
    assert got[1]["ids_sha256"] == hashlib.sha256(b"2").hexdigest() and got[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[0]["decoded"] == "Hello world"
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
