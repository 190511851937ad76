"""Operator 3: pieces against the tokenizers library, plans against bounds."""

import json
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabstat.llm import packing
from tabstat.llm.common import split_units

PATH = P.path("byte_bpe_50k.json")


def held(runs, capacity):
    out = np.zeros(capacity + 1, int)
    for n, own in runs:
        assert n > 0 and own and sum(own) <= capacity
        for length in own:
            out[length] += n
    return out


@pytest.mark.parametrize("lengths", [
    [], [1], [2048] * 7, [1025] * 50 + [1023] * 40 + [2] * 9, [683] * 30 + [682] * 60, list(range(1, 2049)),
    np.random.default_rng(1).integers(1, 2049, 4000).tolist(), np.random.default_rng(2).integers(500, 1200, 3000).tolist()])
def test_plan_holds_every_piece(lengths):
    counts = np.bincount(lengths, minlength=2049) if lengths else np.zeros(2049, int)
    runs = packing.plan(counts)
    assert (held(runs, 2048) == counts).all()
    alone = packing._best_fit([], counts.copy(), 2048)
    assert sum(n for n, _ in runs) <= 1.03 * sum(n for n, _ in alone) + 1


def test_documents(spark, odd_docs):
    rows = packing.pack_documents(odd_docs, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for d in odd_docs.select("doc_id", "text").collect():
        ids = np.array(tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) - (len(ids) - 1) // 2048 * 2048
        for piece, (a, b) in enumerate(zip([0, *range(first, len(ids), 2048)], [first, *range(first + 2048, len(ids) + 1, 2048)])):
            want.append((d.doc_id or -1, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


@lru_cache(maxsize=1)
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab Zé1²٣.'s \n\t\u00a0\u3000𝄞,’ß<|>"), st.characters(exclude_categories=["Cs"])), max_size=50))
def test_ids_are_those_of_the_library(text):
    tokenizer = library()
    got = packing._tokenizer(PATH).packed([split_units(text)])[0]
    assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_use_the_library(tmp_path):
    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["model"]["merges"] = spec["model"]["merges"][:100] + spec["model"]["merges"][101:]
    other = tmp_path / "t.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    assert packing._ranks(str(other)) is None and packing._ranks(PATH) is not None
    text = "the quick brown fox, and then some."
    got = packing._tokenizer(str(other)).packed([split_units(text)])[0]
    assert np.frombuffer(got, "<u4").tolist() == Tokenizer.from_file(str(other)).encode(text, add_special_tokens=False).ids


def test_empty_table(spark, odd_docs):
    assert packing.pack_documents(odd_docs.limit(0), PATH).collect() == []


ADDED = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> y\n<|endoftext|><|endoftext|>.", "a <|endoftext|>  b", "end.\n<|endoftext|>\n\nnext", "<|endoftext| >", "<|<|endoftext|>|>", "né <|endoftext|>'s 12"]


def test_added_tokens_are_matched(spark, tmp_path):
    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["model"]["merges"] = spec["model"]["merges"][:100] + spec["model"]["merges"][101:]
    other = tmp_path / "t.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    spec["added_tokens"][0]["lstrip"] = True
    strips = tmp_path / "s.json"
    strips.write_text(json.dumps(spec), encoding="utf-8")
    for path in (PATH, str(other), str(strips)):
        plain = Tokenizer.from_file(path)
        for text in ADDED:
            got = packing._tokenizer(path).packed([packing._units(path)(text)])[0]
            assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, (path, text)
    plain = Tokenizer.from_file(PATH)
    assert plain.encode(ADDED[0], add_special_tokens=False).ids == [64, 50256, 65]
    docs = spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.tokenise(docs, PATH).collect()}
    for i, text in enumerate(ADDED):
        ids = np.array(plain.encode(text, add_special_tokens=False).ids + [0], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))
