import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabstat.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    """Conversations as lists of (role, text)."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256((str(len(role.encode())) + ":" + role + text).encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, name, role, text))
    return {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}


def again(convs):
    out = {}
    for c, own in convs.items():
        h = crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, own in convs.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    rows = []
    for node, own in members.items():
        below = [n for n in members if n[:len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(not any(m[:len(n)] == n and len(m) > len(n) for m in below) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        rows.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_tree_is_balanced_and_finds_every_sequence():
    rng = random.Random(3)
    words = sorted({tuple(rng.randrange(50) for _ in range(rng.randrange(1, 6))) for _ in range(400)})
    tree = T.Tree()
    last = {words[k]: tree.insert(list(words[k])) for k in T.medians(len(words))}
    assert sorted(T.medians(13)) == list(range(13))
    for w, at in last.items():
        path = []
        while at >= 0:
            path.append(tree.symbol[at])
            at = tree.up[at]
        assert tuple(reversed(path)) == w
    assert len(tree.symbol) == len({w[:d] for w in words for d in range(1, len(w) + 1)})
    order = {at: k for k, at in enumerate(tree.postorder())}
    assert len(order) == len(tree.symbol) and all(up < 0 or order[at] < order[up] for at, up in enumerate(tree.up))
    steps, at = 0, tree.root  # the way to the smallest first symbol
    while tree.low[at] >= 0:
        steps, at = steps + 1, tree.low[at]
    assert steps <= 10


def rows_of(seed, convs=40, longest=12):
    rng = random.Random(seed)
    rows, texts = [], ["a", "bb", "é", "", None]
    for c in range(convs):
        if c % 7 == 6:
            continue
        n = rng.choice([1, 2, 3, longest])
        kind = rng.randrange(3)
        for t in range(n):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", None]) if rng.random() < 0.1 else "user" if t % 2 == 0 else "assistant",
                         texts[(kind * t) % 5] if kind else f"same {t}"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment,shard", [(64, 20_000), (3, 4), (1, 1), (4, 7)])
def test_nodes_equal_brute_force_at_any_cut(spark, segment, shard):
    rows = rows_of(segment)
    out = got(T.trie(T.rebuilt(T.turns(frame(spark, rows))), segment=segment, shard=shard))
    assert out == brute(again(sequences(rows)))


def test_without_rebuilding(spark):
    rows = rows_of(9, convs=20)
    assert got(T.trie(T.sized(T.turns(frame(spark, rows))), segment=4, shard=3)) == brute(sequences(rows))


def test_hot_conversation_hot_copies_and_repeated_rows(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(300)]  # a conversation of many segments
    rows += [(c, t, "user", f"t{t}") for c in range(10, 150) for t in range(2)]  # copies
    rows += [(5, 0, "user", "x")] * 3 + [(None, 0, "user", "no conversation"), (7, None, None, None), (8, 0, "a", "bc"), (9, 0, "ab", "c")]
    assert got(T.trie(T.rebuilt(T.turns(frame(spark, rows))), segment=16, shard=5)) == brute(again(sequences(rows)))


def test_empty_and_turnless(spark):
    assert got(T.trie(T.rebuilt(T.turns(frame(spark, [(None, 0, "a", "b")]))))) == []
    # base 0 is absent and all of c's turns are before h, so c has no turn left
    c = next(c for c in range(1, 500) if c % 5 and crc32(str(c).encode()) % 9 >= 1)
    rows = [(c, 0, "user", "x")]
    assert got(T.trie(T.rebuilt(T.turns(frame(spark, rows))))) == brute(again(sequences(rows)))
    extra = frame(spark, rows_of(2, convs=10)).selectExpr("*", "1 as key", "2 as pos", "3 as size", "4 as bytes")
    assert got(T.trie(T.rebuilt(T.turns(extra)))) == brute(again(sequences(rows_of(2, convs=10))))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=4), min_size=1, max_size=12))
def test_one_shard_counts(words):
    """A shard that is whole: its group's totals are those of the trie."""
    words = sorted(map(tuple, words))
    distinct = sorted(set(words))
    rows = [dict(seg=0, prefix="0:0", path="".join(x * T.NAME for x in w), bytes=[1] * len(w), n=words.count(w), conv_id=k, prefix_conv_id=0, kids=0,
                 deep_leaves=0, deep_saved=0, ends=None) for k, w in enumerate(distinct)]
    nodes = [dict(zip(T.NODES, n)) for n in T.shard_nodes(rows, "s", 64)]
    prefixes = {w[:d] for w in distinct for d in range(len(w) + 1)}
    assert len(nodes) == len(prefixes)
    assert sorted(n["n_convs"] for n in nodes) == sorted(sum(w[:len(p)] == p for w in words) for p in prefixes)
