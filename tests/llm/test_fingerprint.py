"""Operator 8 against direct computation."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tabstat.llm import fingerprint as fp


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abé", max_size=24), st.text(alphabet="abé", max_size=24))
def test_extensions(a, b):
    x, y = (fp.PrefixHashes(fp.code_points(t)) for t in (a, b))
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            assert x.extension(i, y, j) == n


def test_documents(spark, odd_docs):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd_docs.collect()))
    want = []
    for k, (some, doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][2]
        changed = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        own, other, follow = (fp.fingerprint(fp.PrefixHashes(fp.code_points(t))) for t in (text, changed, after))
        want.append((some, doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, other, fp.likeness(own, other), fp.likeness(own, follow)))
    got = [(r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fp.fingerprints(odd_docs).collect()]
    assert sorted(got) == sorted(want)
    assert fp.fingerprints(odd_docs.limit(0)).collect() == []


def mark(text):
    return fp.fingerprint(fp.PrefixHashes(fp.code_points(text)))


def share(a, b):
    """The share of common spans that a likeness estimates, from the spans themselves."""
    gram = fp.GRAM if min(len(a), len(b)) >= 4 * fp.GRAM else fp.SHORT_GRAM
    x, y = ({t[i:i + min(gram, len(t))] for i in range(len(t) - min(gram, len(t)) + 1)} if t else set() for t in (a, b))
    return 1.0 if a == b else len(x & y) / len(x | y) if x and y else 0.0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdefgh ", max_size=33), st.integers(0, 33), st.integers(0, 33))
def test_short_texts_have_exact_shares(text, low, high):
    """Sketches of up to SKETCH spans hold them all."""
    other = text[min(low, high):max(low, high)] + text[:low]
    if len(other) < 35 and len(set(text[i:i + 3] for i in range(len(text)))) <= 32:
        assert abs(fp.likeness(mark(text), mark(other)) - share(text, other)) < 1e-12


def test_no_length_parts_like_texts():
    text = "the quick brown fox jumps over a lazy dog, and the cat looks on from its warm window seat; rain fell all day" * 3
    for n in range(4, 200):
        assert fp.likeness(mark(text[:n]), mark(text[:n + 1])) > (0.8 if n > 12 else 0.4)
    half = text[:60]
    assert fp.likeness(mark(half), mark(half[:32])) > 0.3 and fp.likeness(mark(half[:32]), mark(half)) > 0.3


def test_likeness_against_the_shares():
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    errors = []
    for n in (20, 60, 300, 1500):
        for part in (0.1, 0.3, 0.5, 0.8):
            a = " ".join(rng.choice(words, n))
            b = a[:int(len(a) * part)] + " ".join(rng.choice(words, n))[int(len(a) * part):]
            errors.append(fp.likeness(mark(a), mark(b)) - share(a, b))
    assert max(map(abs, errors)) < 0.35 and abs(np.mean(errors)) < 0.06


def test_likeness():
    text = " ".join(f"word{k * 37 % 1000}" for k in range(2000))
    own = mark(text)
    half = mark(text[:len(text) // 2] + "".join(chr(0x4E00 + k % 20000) for k in range(len(text) // 2)))
    assert fp.likeness(own, own) == 1.0 and 0.1 < fp.likeness(own, half) < 0.6
    assert fp.likeness(own, mark("")) == 0.0 and fp.likeness(mark(""), mark("")) == 1.0
