import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cuelight.llm import bpe as B


@pytest.fixture(scope="module")
def pair():
    return B.tokenizer(B.word_bpe_path()), Tokenizer.from_file(B.word_bpe_path())


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="abcdefgilnorstu 'Σß́🎉<|>/w1²\n\x1c\x85", max_size=80), st.sampled_from(["<|endoftext|>", "a<|startoftext|>b", "IT'S they're", "<|"])))
def test_same_as_library(pair, text):
    own, lib = pair
    want = lib.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want
    assert own.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_speculation_is_verified_not_trusted(pair):
    own, _ = pair
    words = [f"{a}{b}{c}" for a in ("tion", "the", "ann", "un") for b in ("tion", "ing", "ed", "eau") for c in ("s", "tion", "er", "ou")]
    spelled = [w + B.END for w in words]
    greedy, exact = [own.greedy(s) for s in spelled], [own.exact(s) for s in spelled]
    assert own.encode_words(words) == exact
    assert any(g != e for g, e in zip(greedy, exact)) and any(g == e for g, e in zip(greedy, exact))


def test_long_words_are_merged_whole(pair):
    own, lib = pair
    for word in ("a" * 200_000, "thequickbrownfox" * 10_000, "été" * 30_000, "!?" * 40_000):
        assert own.encode(word) == lib.encode(word, add_special_tokens=False).ids


def test_kept_words_are_bounded(pair):
    fresh = B.WordBpe(B.word_bpe_path())
    fresh.KEPT_LETTERS = 1000
    for k in range(50):
        text = " ".join(chr(97 + k % 26) * (100 + j + k) for j in range(5))
        assert fresh.encode(text) == pair[1].encode(text, add_special_tokens=False).ids
        assert sum(map(len, fresh.known)) < 5000


def test_rows(spark, documents, pair):
    _, lib = pair
    want = []
    for r in documents.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id or -1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(r.doc_id or -1, *r[1:]) for r in B.encode_digests(documents, B.word_bpe_path()).collect()]
    assert sorted(got) == sorted(want)
    full = {r.doc_id: r for r in B.encode_documents(documents, B.word_bpe_path()).collect()}
    assert full[8].ids == lib.encode("word", add_special_tokens=False).ids and full[6].ids == [] and full[8].decoded == "word</w>"
    assert B.encode_digests(documents.limit(0), B.word_bpe_path()).count() == 0
