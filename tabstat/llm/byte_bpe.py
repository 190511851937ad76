"""Operator 1: byte-level BPE encoding by overlapping chunks, and decoding.

Encoding. A text of at most ``CHUNK`` code points is one chunk. A longer one
is cut into windows of ``CHUNK + OVERLAP`` code points that start every
``CHUNK``; each window is pre-tokenised on its own, in parallel. The pattern
looks only forward, so two scans that share one pre-token boundary agree from
there on: neighbouring windows are stitched at the first boundary that both
have inside their overlap. A match that touches the end of its window might
reach further in the whole text, so its end is not trusted. The stitched
spans are then encoded piece by piece, in parallel, and the ids of a document
are put together in window order. Where two windows share no boundary (one
pre-token longer than the overlap), the document is encoded as one span.

Decoding concatenates the raw bytes of the ids.

Defined results: null text is the empty text (no ids, no bytes); repeated
rows are repeated in the result; equal texts get equal ids; other columns of
the input, whatever their names, are not read; an empty table gives an empty
result. ``doc_id`` may be null or repeated.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabstat.llm.common import UnitCache, in_groups, int_lists, prepare, split_units, strings, text_or_empty

#: Code points of a chunk, and how far neighbouring windows overlap.
CHUNK = 32_768
OVERLAP = 1_024


@lru_cache(maxsize=4)
def _coder(ranks_path: str, pattern: str):
    """The worker's encoder, its unit cache and the bytes of every id."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    return coder, UnitCache(lambda units: map(coder.encode_ordinary, units)), by_id


@lru_cache(maxsize=4)
def _scanner(pattern: str):
    import regex

    return regex.compile(pattern)


def trusted_cuts(window: str, pattern: str, last: bool) -> list[int]:
    """Boundaries of a scan from the window's start, 0 first.

    The end of a match that touches the end of the window counts only where
    the text ends too.
    """
    cuts = [0, *(m.end() for m in _scanner(pattern).finditer(window))]
    if not last and cuts[-1] == len(window):
        cuts.pop()
    return cuts or [0]


def _encode_short(ranks_path: str, pattern: str):
    def run(batches):
        _, cache, _ = _coder(ranks_path, pattern)
        for batch in batches:
            ids = []
            for group in in_groups(strings(batch, "text")):
                ids += cache.packed([split_units(t) if t else [] for t in group])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), int_lists(ids, pa.int32())], ["doc_id", "ids"])

    return run


def _scan(pattern: str, chunk: int, overlap: int):
    def run(batches):
        for batch in batches:
            numbers, counts = batch.column("w").to_pylist(), batch.column("n_windows").to_pylist()
            cuts, head, tail = [], [], []
            for window, w, n in zip(strings(batch, "window"), numbers, counts):
                own = trusted_cuts(window, pattern, last=w + 1 == n)
                cuts.append(own)
                head.append([c for c in own if c < overlap])
                tail.append([c - chunk for c in own if c >= chunk])
            kept = [batch.column(c) for c in ("doc_id", "text_sha", "copies", "w", "n_windows", "window")]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(int_lists(x, pa.int32()) for x in (cuts, head, tail))],
                ["doc_id", "text_sha", "copies", "w", "n_windows", "window", "cuts", "head", "tail"])

    return run


def _encode_spans(ranks_path: str, pattern: str, chunk: int):
    """Ids of the pieces between a window's stitches; the window's own part
    of the text where its document does not stitch."""
    def run(batches):
        _, cache, _ = _coder(ranks_path, pattern)
        for batch in batches:
            ids, body = [], []
            for window, cuts, since, until, whole in zip(*(batch.column(c).to_pylist() for c in ("window", "cuts", "since", "until", "stitched"))):
                if not whole:
                    ids.append(b"")
                    body.append(window[:chunk])
                    continue
                body.append("")
                until = cuts[-1] if until is None else until
                ends = [c for c in cuts if since <= c <= until]
                ids += cache.packed([[window[a:b] for a, b in zip(ends, ends[1:])]])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "text_sha", "copies", "stitched", "w")), int_lists(ids, pa.int32()), pa.array(body, pa.string())],
                ["doc_id", "text_sha", "copies", "stitched", "w", "ids", "body"])

    return run


def _finish(ranks_path: str, pattern: str):
    """Documents that do not stitch are encoded as one span."""
    def run(batches):
        coder, _, _ = _coder(ranks_path, pattern)
        for batch in batches:
            ids = [coder.encode_ordinary("".join(body)) if not whole else parts for whole, parts, body in zip(*(batch.column(c).to_pylist() for c in ("stitched", "ids", "body")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copies"), int_lists(ids, pa.int32())], ["doc_id", "copies", "ids"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, as ``encode_ordinary`` gives them."""
    if not 1 <= overlap <= chunk:
        raise ValueError("overlap must be between 1 and chunk")
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    short = docs.where(F.length("text") <= chunk).mapInArrow(_encode_short(ranks_path, pattern), f"doc_id {kind}, ids array<int>")

    windows = (docs.where(F.length("text") > chunk)
               .groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
               .withColumn("n_windows", F.ceil(F.length("text") / chunk).cast("int"))
               .select("doc_id", F.sha2("text", 256).alias("text_sha"), "copies", "n_windows", "text",
                       F.explode(F.sequence(F.lit(0), F.col("n_windows") - 1)).alias("w"))
               .select("doc_id", "text_sha", "copies", "w", "n_windows",
                       F.substring("text", F.col("w") * chunk + 1, F.lit(chunk + overlap)).alias("window")))
    key = f"doc_id {kind}, text_sha string, copies long"
    scanned = windows.mapInArrow(_scan(pattern, chunk, overlap), f"{key}, w int, n_windows int, window string, cuts array<int>, head array<int>, tail array<int>")
    document = Window.partitionBy("doc_id", "text_sha")
    in_order = document.orderBy("w")
    stitched = (scanned
                .withColumn("since", F.when(F.col("w") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(in_order), "head"))))
                .withColumn("until", F.lead("since").over(in_order) + chunk)
                .withColumn("stitched", F.min(F.col("since").isNotNull()).over(document))
                .select("doc_id", "text_sha", "copies", "w", "window", "cuts", "since", "until", "stitched"))
    encoded = stitched.mapInArrow(_encode_spans(ranks_path, pattern, chunk), f"{key}, stitched boolean, w int, ids array<int>, body string")
    whole = (encoded.groupBy("doc_id", "text_sha", "copies", "stitched")
             .agg(F.array_sort(F.collect_list(F.struct("w", "ids", "body"))).alias("parts"))
             .select("doc_id", "copies", "stitched", F.flatten("parts.ids").alias("ids"), F.col("parts.body").alias("body")))
    long = (whole.mapInArrow(_finish(ranks_path, pattern), f"doc_id {kind}, copies long, ids array<int>")
            .select("doc_id", "ids", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("doc_id", "ids"))
    return short.unionByName(long)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded binary): the concatenated bytes of the ids."""
    prepare(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        by_id = _coder(ranks_path, pattern)[2]
        for batch in batches:
            texts = [b"".join(map(by_id.__getitem__, ids or ())) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """Count and digests of encoded and decoded documents."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
