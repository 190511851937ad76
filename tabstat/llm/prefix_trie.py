"""Operator 13: the trie of conversation prefixes, from ternary search trees
over dictionary-encoded turns, one per range shard.

A conversation is a sequence of turns (role, text). Each distinct sequence of
its first d turns is a node of depth d; its members are the conversations that
start with it.

Method.

1. A turn is a digest of (role, text) and the bytes of its text. Conversations
   are numbered by a range partitioning on (conversation, turn), so one of any
   length is spread over tasks; texts are not shuffled.
2. A sequence is cut into segments of SEGMENT turns. What stands before a
   segment is named by a sum of digests of the earlier (place, segment) pairs,
   which distributes; a segment is a row, a conversation of any length is many.
   Equal segments after equal turns collapse, with their number of members and
   the smallest member.
3. The distinct segments are range partitioned in order of what precedes them
   and their turns. A task cuts its range into shards of at most SHARD
   segments. A shard numbers its turns (dictionary), puts its sequences into a
   ternary search tree, the median first and so on, which keeps it balanced,
   and walks it with a stack: members, smallest member, children, leaves and
   savings are accumulated from the children of a node to the node.
4. Only nodes on the way to the first and the last sequence of a shard can
   occur in another shard. These boundary nodes carry what hangs below them
   inside the shard; equal ones of all shards are merged, and each one's own
   leaves and savings are added to its (at most SEGMENT) ancestors among them.
5. What lies below the end of a segment belongs to further segments. Their
   groups are totalled first (steps 3 and 4); a total goes to all segments on
   the way of one representative, its smallest member, by sums over that
   conversation's places, so depth costs no rounds.
6. Members that end at a node are sorted by a range partitioning on (node,
   member) and joined to pieces in parallel; a digest then reads the pieces in
   order (SHA-256 of one text cannot be split further).

Nothing is collected on the driver; broadcasts hold one row per range
partition. Names of turns, segments and nodes are 128-bit digests (the sums:
two of 60 bits).

Defined results: rows without conv_id belong to no conversation; null role or
text is the empty string; turns with equal numbers (null comes first) are
ordered by the digest of (role, text), so repeated rows are turns next to each
other; other columns are not read; an empty table has no nodes. In ``rebuilt``,
c - c % 5 has the sign rule of SQL.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabstat.llm.common import written
from tabstat.session import ship_package

#: Turns a segment; digits of a turn's name; segments in one tree.
SEGMENT, NAME, SHARD = 64, 32, 20_000
#: Places of one conversation that a window sees at once.
PLACES = 1024
#: Members joined to one piece before their digest.
PIECE = 50_000
EMPTY = hashlib.sha256(b"").hexdigest()

#: Nodes of a shard. ``top``: the node of a group (the end of a prefix);
#: ``boundary``: it may be in other shards too, and only what it has in this
#: one is counted, ``nid`` names it, ``above`` names its ancestors up to the top.
NODES = {"top": pa.bool_(), "boundary": pa.bool_(), "shard": pa.string(), "nid": pa.string(), "parent_nid": pa.string(), "above": pa.list_(pa.string()),
         "prefix": pa.string(), "depth": pa.int64(), "conv_id": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(),
         "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "bytes": pa.int64(), "ends": pa.string()}
_SPARK = {pa.bool_(): "boolean", pa.string(): "string", pa.int64(): "long", pa.list_(pa.string()): "array<string>"}


def _name(*parts) -> Column:
    return F.substring(F.sha2(F.concat(*parts).cast("binary"), 256), 1, NAME)


def _placed(batches):
    """Adds (part, pos): the range partition, and a row's place among those of
    its conversation there. Rows come sorted by conversation."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column("conv_id").to_numpy()
        if not len(conv):
            continue
        new = np.concatenate(([True], conv[1:] != conv[:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0))
        pos = np.arange(len(conv)) - first
        if conv[0] == last:
            pos[first == 0] += n
        last, n = conv[-1], int(pos[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(np.full(len(conv), part, np.int32)), pa.array(pos, pa.int64()), batch.column("key"), batch.column("bytes")],
            ["conv_id", "part", "pos", "key", "bytes"])


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, bytes): every turn with its place from 0, its name
    and the UTF-8 bytes of its text."""
    ship_package(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), _name(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("key"),
        F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")]
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                     .mapInArrow(_placed, "conv_id long, part int, pos long, key string, bytes long"), "trie-turns")
    parts = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a partition continues at most one conversation, so this has at most one row per partition
    later = parts.select("conv_id", "part", F.sum("n").over(before).alias("skip")).where("skip is not null")
    return placed.join(F.broadcast(later), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("pos") + F.coalesce("skip", F.lit(0))).alias("pos"), "key", "bytes")


def rebuilt(rows: DataFrame) -> DataFrame:
    """Conversation c becomes the first h turns of conversation c - c % 5 (all
    if fewer, none if absent), then its own turns after its first h;
    h = crc32(decimal c) % 9. Input as given by ``turns``; adds ``size``, the
    turns of the rebuilt conversation, and keeps a turnless one as a row
    without place."""
    base = F.col("conv_id") - F.col("conv_id") % 5
    convs = rows.groupBy("conv_id").agg((F.max("pos") + 1).alias("own")).select(
        "conv_id", "own", base.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h"))
    short = convs.select(F.col("conv_id").alias("base"), F.least("own", F.lit(8)).alias("lent"))
    convs = convs.join(short, "base", "left").withColumn("lent", F.least(F.coalesce("lent", F.lit(0)), "h"))
    convs = written(convs.withColumn("size", F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "trie-convs")
    heads = rows.where("pos < 8 and conv_id % 5 = 0").select(F.col("conv_id").alias("base"), "pos", "key", "bytes")
    lent = convs.join(heads, "base").where("pos < h").select("conv_id", "pos", "key", "bytes", "size")
    # a conversation of any length meets its row once per PLACES turns
    block = F.floor(F.col("pos") / PLACES)
    moved = convs.where("own > h").select("conv_id", "h", "lent", "size", F.explode(F.sequence(F.floor(F.col("h") / PLACES), F.floor((F.col("own") - 1) / PLACES))).alias("block"))
    own = rows.withColumn("block", block).join(moved, ["conv_id", "block"]).where("pos >= h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "key", "bytes", "size")
    none = convs.where("size = 0").select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("bytes"), "size")
    return lent.unionByName(own).unionByName(none)


def sized(rows: DataFrame) -> DataFrame:
    """The conversations as they are, with ``size``: for a trie without
    rebuilding."""
    n = rows.groupBy("conv_id").agg((F.max("pos") + 1).alias("size"))
    spread = n.select("conv_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / PLACES))).alias("block"))
    return rows.withColumn("block", F.floor(F.col("pos") / PLACES)).join(spread, ["conv_id", "block"]).drop("block")


def _sums(rows: DataFrame, values: list[str], after: bool = False) -> DataFrame:
    """Adds ``before_<value>``: the sum over the earlier (later) segments of the
    conversation, by windows of PLACES rows."""
    order = F.col("seg").desc() if after else F.col("seg")
    rows = rows.withColumn("block", F.floor(F.col("seg") / PLACES))
    inner = Window.partitionBy("conv_id", "block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("conv_id").orderBy(F.col("block").desc() if after else F.col("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(*(F.sum(v).alias(v) for v in values))
    blocks = blocks.select("conv_id", "block", *(F.coalesce(F.sum(v).over(outer), F.lit(0)).alias(f"outer_{v}") for v in values))
    rows = rows.withColumns({f"inner_{v}": F.coalesce(F.sum(v).over(inner), F.lit(0)) for v in values})
    rows = rows.join(blocks, ["conv_id", "block"])
    out = rows.withColumns({f"before_{v}": F.col(f"inner_{v}") + F.col(f"outer_{v}") for v in values})
    return out.drop("block", *(f"{p}_{v}" for p in ("inner", "outer") for v in values))


def segments(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, seg, n, path, bytes, more, prefix, after, sid): the segments of
    each conversation. ``path`` joins the names of its turns, ``prefix`` names
    all earlier turns, ``after`` those and its own, ``sid`` the segment after
    that prefix; ``more`` tells whether another one follows."""
    own = (rows.where("pos is not null").withColumn("seg", F.floor(F.col("pos") / segment))
           .groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "bytes"))).alias("t"), F.first("size").alias("size")))
    own = own.select("conv_id", "seg", F.size("t").cast("long").alias("n"), F.array_join("t.key", "").alias("path"), F.col("t.bytes").alias("bytes"),
                     (F.col("size") > (F.col("seg") + 1) * segment).alias("more"), (F.col("size") > segment).alias("long"))
    digest = F.sha2(F.concat(F.col("seg").cast("string"), F.lit(":"), F.col("path")).cast("binary"), 256)
    own = own.withColumns({k: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)") for k, at in (("a", 1), ("b", 16))})
    own = written(own, "trie-parts")
    zero = F.lit(0).cast("decimal(38,0)")
    names = ["conv_id", "seg", "n", "path", "bytes", "more", "a", "b", "before_a", "before_b"]
    one = own.where("not long").withColumns({"before_a": zero, "before_b": zero}).select(*names)
    every = one.unionByName(_sums(own.where("long"), ["a", "b"]).select(*names))

    def name(*which: str) -> Column:
        return F.concat_ws(":", *(sum((F.col(c) for c in w.split("+")[1:]), F.col(w.split("+")[0])).cast("decimal(38,0)").cast("string") for w in which))

    every = every.withColumns({"prefix": name("before_a", "before_b"), "after": name("before_a+a", "before_b+b")}).drop("a", "b", "before_a", "before_b")
    return every.withColumn("sid", _name(F.col("seg").cast("string"), F.lit("|"), "prefix", F.lit("|"), "path"))


class Tree:
    """A ternary search tree of integer sequences. Node k has a symbol, links
    to smaller and larger symbols at the same place (low, high), to the first
    node of the next place (down), and to the node of the place before (up)."""

    def __init__(self):
        self.symbol, self.low, self.high, self.down, self.up, self.depth = [], [], [], [], [], []
        self.root = -1

    def _new(self, symbol: int, up: int, depth: int) -> int:
        for links, v in ((self.symbol, symbol), (self.low, -1), (self.high, -1), (self.down, -1), (self.up, up), (self.depth, depth)):
            links.append(v)
        return len(self.symbol) - 1

    def insert(self, sequence: list[int]) -> int:
        """Adds a sequence that is not empty; its last node."""
        symbol, low, high, down = self.symbol, self.low, self.high, self.down
        up = -1
        for depth, s in enumerate(sequence):
            at = self.root if up < 0 else down[up]
            if at < 0:
                at = self._new(s, up, depth)
                if up < 0:
                    self.root = at
                else:
                    down[up] = at
            while s != symbol[at]:
                side = low if s < symbol[at] else high
                if side[at] < 0:
                    side[at] = self._new(s, up, depth)
                at = side[at]
            up = at
        return up

    def postorder(self) -> list[int]:
        """Every node after all nodes of the places below it."""
        stack, out = [self.root] if self.root >= 0 else [], []
        while stack:
            at = stack.pop()
            out.append(at)
            stack += [k for k in (self.low[at], self.high[at], self.down[at]) if k >= 0]
        return out[::-1]


def medians(n: int) -> list[int]:
    """0..n-1, the middle first, then the middles of the halves, and so on."""
    out, spans = [], [(0, n)]
    for low, high in spans:  # grows while it is read
        if low < high:
            mid = (low + high) // 2
            out.append(mid)
            spans += [(low, mid), (mid + 1, high)]
    return out


def _nid(seg: int, prefix: str, path: str) -> str:
    return hashlib.sha256(f"{seg}|{prefix}|{path}".encode()).hexdigest()[:NAME]


def shard_nodes(rows: list[dict], shard: str, segment: int) -> list[tuple]:
    """The nodes of one shard's sorted segments, as rows of NODES. A group (the
    segments after one prefix) is a node itself, that of the prefix's end."""
    groups = [(r["seg"], r["prefix"]) for r in rows]
    keys = [[r["path"][i:i + NAME] for i in range(0, len(r["path"]), NAME)] for r in rows]
    symbols = sorted({k for row in keys for k in row})
    code = {k: i for i, k in enumerate(symbols)}
    group = {g: i for i, g in enumerate(dict.fromkeys(groups))}
    tree = Tree()
    last = [0] * len(rows)
    for k in medians(len(rows)):
        last[k] = tree.insert([group[groups[k]], *(code[x] for x in keys[k])])
    size = len(tree.symbol)
    members, smallest, size_bytes = [0] * size, [None] * size, [0] * size
    children, leaves, saved, ends, boundary = [0] * size, [0] * size, [0] * size, [None] * size, [False] * size
    first_row = [0] * size
    for k, r in enumerate(rows):
        at = last[k]
        members[at], smallest[at], ends[at] = r["n"], r["conv_id"], r["ends"]
        children[at], leaves[at], saved[at] = r["kids"], r["deep_leaves"], r["deep_saved"]
        for b in reversed([0, *r["bytes"]]):
            size_bytes[at], first_row[at] = b, k
            if k in (0, len(rows) - 1):
                boundary[at] = True
            at = tree.up[at]
    out = []
    for at in tree.postorder():
        up, r = tree.up[at], rows[first_row[at]]
        if up < 0:  # a group; what its members have below is a node of the segment before
            smallest[at] = r["prefix_conv_id"] if r["prefix_conv_id"] is not None else smallest[at]
        if not boundary[at]:
            leaves[at] += children[at] == 0
            saved[at] += (members[at] - 1) * size_bytes[at]
        if up >= 0:
            members[up] += members[at]
            smallest[up] = smallest[at] if smallest[up] is None else min(smallest[up], smallest[at])
            if not boundary[at]:
                children[up] += 1
                leaves[up] += leaves[at]
                saved[up] += saved[at]
    for at in range(size):
        up, r, depth = tree.up[at], rows[first_row[at]], tree.depth[at]
        seg, prefix = r["seg"], r["prefix"]
        names = [_nid(seg, prefix, r["path"][:NAME * d]) for d in range(depth + 1)] if boundary[at] else [None]
        edge = up >= 0 and boundary[up]
        parent = (names[-2] if boundary[at] else _nid(seg, prefix, r["path"][:NAME * (depth - 1)])) if edge else None
        out.append((up < 0, boundary[at], shard, names[-1], parent, names[:-1], prefix if up < 0 else None, seg * segment + depth, smallest[at],
                    None if up < 0 or edge else smallest[up], members[at], children[at], leaves[at], saved[at], size_bytes[at], ends[at]))
    return out


def _shards(segment: int, shard: int):
    def run(batches):
        part, rows, k = TaskContext.get().partitionId(), [], 0
        schema = pa.schema(list(NODES.items()))

        def made(own):
            columns = zip(*shard_nodes(own, f"{part}-{k}", segment))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            rows += batch.to_pylist()
            while len(rows) >= shard:
                yield made(rows[:shard])
                rows, k = rows[shard:], k + 1
        if rows:
            yield made(rows)
    return run


def _nodes(distinct: DataFrame, label: str, segment: int, shard: int) -> tuple[DataFrame, DataFrame]:
    """Rows of NODES of all shards of the distinct segments, and the boundary
    nodes merged over the shards."""
    order = ["seg", "prefix", "path"]
    schema = ", ".join(f"{k} {_SPARK[t]}" for k, t in NODES.items())
    rows = written(distinct.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_shards(segment, shard), schema), f"trie-{label}")
    edge = rows.where("boundary").groupBy("nid").agg(
        *(F.first(c).alias(c) for c in ("top", "parent_nid", "above", "prefix", "depth")), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("bytes").alias("bytes"), F.max("ends").alias("ends"))
    # children that are boundary nodes themselves count once over all shards
    kids = edge.where("parent_nid is not null").groupBy(F.col("parent_nid").alias("nid")).agg(F.count(F.lit(1)).alias("kids"))
    edge = edge.join(kids, "nid", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).drop("kids")
    edge = edge.withColumns({"n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"),
                             "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes")})
    edge = written(edge, f"trie-edge-{label}")
    sums = (edge.select(F.explode(F.concat("above", F.array("nid"))).alias("nid"), "n_leaves", "saved_tokens")
            .groupBy("nid").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
    return rows, written(edge.drop("n_leaves", "saved_tokens", "above").join(sums, "nid"), f"trie-merged-{label}")


def _pieces(batches):
    """(sid, first, ids): members of each sid, sorted, joined to pieces."""
    sid, own = None, []
    for batch in batches:
        out = []
        for s, c in zip(batch.column("sid").to_pylist(), batch.column("conv_id").to_pylist()):
            if s != sid or len(own) >= PIECE:
                if own:
                    out.append((sid, own[0], ",".join(map(str, own))))
                sid, own = s, []
            own.append(c)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["sid", "first", "ids"])
    if own:
        yield pa.RecordBatch.from_arrays([pa.array([sid]), pa.array([own[0]]), pa.array([",".join(map(str, own))])], ["sid", "first", "ids"])


def _digests(batches):
    """(sid, ends): SHA-256 of the pieces of each sid in order, comma-joined."""
    sid, state = None, None
    for batch in batches:
        out = []
        for s, ids in zip(batch.column("sid").to_pylist(), batch.column("ids").to_pylist()):
            if s != sid:
                if sid is not None:
                    out.append((sid, state.hexdigest()))
                sid, state = s, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["sid", "ends"])
    if sid is not None:
        yield pa.RecordBatch.from_arrays([pa.array([sid]), pa.array([state.hexdigest()])], ["sid", "ends"])


def _ends(members: DataFrame) -> DataFrame:
    """(sid, ends): the digest of the members that end at each segment's end."""
    pieces = (members.repartitionByRange("sid", "conv_id").sortWithinPartitions("sid", "conv_id")
              .mapInArrow(_pieces, "sid string, first long, ids string"))
    return written(pieces.repartition("sid").sortWithinPartitions("sid", "first").mapInArrow(_digests, "sid string, ends string"), "trie-ends")


def trie(rows: DataFrame, segment: int = SEGMENT, shard: int = SHARD) -> DataFrame:
    """The nodes of the conversations (conv_id, pos, key, bytes, size), one row
    each: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. ``segment`` turns are a row, ``shard`` segments
    a tree; neither changes the result."""
    every = written(segments(rows, segment), "trie-segments")
    none = written(rows.where("pos is null").select("conv_id"), "trie-turnless")
    least = every.select("conv_id").unionByName(none).agg(F.min("conv_id")).first()[0]
    ends = _ends(every.where("not more").select("sid", "conv_id").unionByName(none.select(F.lit("").alias("sid"), "conv_id")))
    distinct = written(every.groupBy("sid", "seg", "prefix", "path").agg(
        F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.max("more").alias("more")), "trie-distinct")

    # groups of later segments: totals, handed to the segments on their way
    later = distinct.where("seg > 0")
    prefixes = (every.where(F.col("n") == segment).groupBy((F.col("seg") + 1).alias("seg"), F.col("after").alias("prefix"))
                .agg(F.min("conv_id").alias("prefix_conv_id")))
    later = later.join(prefixes, ["seg", "prefix"])
    zero = F.lit(0).cast("long")
    first_pass = later.withColumns({"kids": F.col("more").cast("long"), "deep_leaves": zero, "deep_saved": zero, "ends": F.lit(None).cast("string")})
    shards, merged = _nodes(first_pass, "later", segment, shard)
    names = ["prefix", "depth", "conv_id", "n_children", "n_leaves", "saved_tokens"]
    totals = shards.where("top and not boundary").select(*names).unionByName(merged.where("top").select(*names))
    totals = totals.select("conv_id", (F.col("depth") / segment - 1).cast("long").alias("seg"), F.col("n_children").alias("kids"),
                           F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    totals = totals.groupBy("conv_id", "seg").agg(*(F.sum(c).alias(c) for c in ("kids", "leaves", "saved")))
    way = every.where((F.col("n") == segment) | (F.col("seg") > 0)).select("conv_id", "seg", "sid").join(totals, ["conv_id", "seg"], "left").na.fill(0, ["kids", "leaves", "saved"])
    way = _sums(way, ["leaves", "saved"], after=True)
    deep = way.groupBy("sid").agg(F.sum("kids").alias("kids"), F.sum(F.col("leaves") + F.col("before_leaves")).alias("deep_leaves"),
                                  F.sum(F.col("saved") + F.col("before_saved")).alias("deep_saved"))

    # all segments
    start = distinct.where("seg = 0").withColumn("prefix_conv_id", F.lit(least).cast("long"))
    whole = start.unionByName(later.select(*start.columns))
    whole = whole.join(ends, "sid", "left")
    short = whole.where("not more").withColumns({"kids": zero, "deep_leaves": zero, "deep_saved": zero})
    whole = short.unionByName(whole.where("more").join(deep, "sid").select(*short.columns))
    shards, merged = _nodes(whole.drop("more", "sid"), "all", segment, shard)

    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    inside = shards.where("not boundary and not top")
    own = merged.select("nid", F.col("conv_id").alias("above_conv_id"))
    seen = shards.where("boundary").select("shard", "nid").join(own, "nid").select("shard", F.col("nid").alias("parent_nid"), "above_conv_id")
    below = inside.where("parent_nid is not null").join(seen, ["shard", "parent_nid"]).withColumn("parent_conv_id", F.col("above_conv_id"))
    edge = merged.where("not top").join(own.withColumnRenamed("nid", "parent_nid"), "parent_nid").withColumn("parent_conv_id", F.col("above_conv_id"))
    root = merged.where("top and depth = 0").select("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens").unionByName(
        none.select("conv_id", F.lit(1).cast("long").alias("n_convs"), *(zero.alias(c) for c in ("n_children", "n_leaves", "saved_tokens"))))
    root = root.agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))).where("n_convs > 0")
    root = root.withColumns({"n_leaves": F.greatest("n_leaves", F.lit(1)), "depth": zero, "parent_conv_id": F.lit(None).cast("long"), "sid": F.lit("")}).join(ends, "sid", "left")
    nodes = root.select(*out)
    for part in (inside.where("parent_nid is null"), below, edge):
        nodes = nodes.unionByName(part.select(*out))
    return nodes.select(*out[:-1], F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))
