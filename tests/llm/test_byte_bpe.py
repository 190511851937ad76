"""Operator 1 against the tiktoken library on whole texts."""

import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tabstat.llm import byte_bpe
from tabstat.llm.common import split_units

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def whole():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows_of(frame):
    return sorted((r.doc_id is not None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in frame.collect())


@pytest.mark.parametrize("chunk,overlap", [(byte_bpe.CHUNK, byte_bpe.OVERLAP), (50, 7), (9, 9)])
def test_matches_library(spark, whole, odd_docs, chunk, overlap):
    got = rows_of(byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(odd_docs, RANKS, P.PATTERN, chunk, overlap), RANKS, P.PATTERN)))
    want = []
    for r in odd_docs.select("doc_id", "text").collect():
        ids = whole.encode_ordinary(r.text or "")
        want.append((r.doc_id is not None, r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_empty_table(spark, odd_docs):
    assert byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(odd_docs.limit(0), RANKS, P.PATTERN), RANKS, P.PATTERN)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é1.'s \n\t\u00a0\u3000𝄞", max_size=60))
def test_units_keep_tokens(text):
    coder = byte_bpe._coder(RANKS, P.PATTERN)[0]
    assert "".join(split_units(text)) == text
    assert [i for u in split_units(text) for i in coder.encode_ordinary(u)] == coder.encode_ordinary(text)
