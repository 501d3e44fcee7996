import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cuelight.llm import packing as P


def best_fit_decreasing(counts, capacity):
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [g for g in gaps if g >= length]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - length)
            else:
                gaps.append(capacity - length)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 30), max_size=12))
def test_runs_are_best_fit(counts):
    plan, used, ranks = P.best_fit_runs(counts, 20), {}, {}
    for length, rank, n, sequence, each, at in plan:
        for k in range(n):
            assert (length, rank + k) not in ranks
            ranks[length, rank + k] = 1
            used.setdefault(sequence + k // each, []).append((at + k % each * length, length))
    assert len(ranks) == sum(counts.values())
    for spans in used.values():
        end = 0
        for start, length in sorted(spans):
            assert start == end
            end += length
        assert end <= 20
    assert sorted(used) == list(range(len(used))) and len(used) == best_fit_decreasing(counts, 20)


def check(rows, got, lib):
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    texts = {}
    for r in rows:
        texts.setdefault(r.doc_id, []).append(r.text or "")
    assert set(by) == set(texts)
    for key, pieces in by.items():
        ids = lib.encode(texts[key][0], add_special_tokens=False).ids + [2]
        assert sum(p.length for p in pieces) == len(ids) * len(texts[key])
        for p in pieces:
            part = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
            assert zlib.crc32(part) == p.ids_crc32 and (p.length == 1024 or p.piece == 0)
    spans = {}
    for r in got:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        end = 0
        for at, length in sorted(s):
            assert at == end
            end += length
        assert end <= 1024
    counts = {}
    for r in got:
        counts[r.length] = counts.get(r.length, 0) + 1
    assert len(spans) == best_fit_decreasing(counts, 1024)


def test_rows(spark, documents, small):
    files = P.byte_bpe_files()
    lib = Tokenizer.from_file(files[0])
    check(documents.collect(), P.pack_documents(documents, files).collect(), lib)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(docs.collect(), P.pack_documents(docs, files).collect(), lib)
    assert P.pack_documents(documents.limit(0), files).count() == 0


def test_sequences_hold_the_ids(spark, documents):
    files = P.byte_bpe_files()
    packed = P.pack_documents(documents, files, keep_ids=True)
    seqs = P.sequences(packed).collect()
    assert sum(len(s.input_ids) for s in seqs) == packed.selectExpr("sum(length)").first()[0]
    bound = P.best_fit_bound(spark, packed).first()
    assert bound.used == len(seqs) >= bound.least


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.sampled_from(["a<|endoftext|>b", "x" * 1500, " " * 1200, "it's  they're \u1680 x"])))
def test_ranks_give_the_tokenizers_ids(text):
    files = P.byte_bpe_files()
    codec = P.codec(*files)
    want = codec.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == want
