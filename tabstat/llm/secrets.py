"""Operator 9: secret scans with multipart credential linking.

Base spans. Three patterns are matched in every whole text, leftmost and
without overlap for each kind: ``assign`` (a credential word assigned a value
of 12 or more characters), ``access`` (an access identifier of 18 or more
characters) and ``hex`` (16 or more hexadecimal digits). Matches that are too
short are dropped and not tried again from within.

Linked spans. Weaker parts are looked for as well: identifiers (access-like
tokens, words such as user or client with a value), secrets (long mixed tokens, values of credential words
of 6 or more characters) and endpoints (URLs with a scheme in any case, and
host:port, where the host is a name with a letter, an IP address or an IPv6
address in brackets, the port is at most 65535, and a URL or an assignment does
not hold it already). Alone each is too common to report. The parts and the
base spans of a text are interval-joined within scopes: a scope is a run of
lines of one paragraph (ended by an empty line, of either line ending), at most SCOPE code points wide on either side of the
weak part; a part of any length that overlaps it is in it. A weak secret is reported (kind ``linked``)
only where its scope also has a part of another role, an identifier or an
endpoint next to it, that does not overlap it; the identifier that complements
it is reported with it.

Defined results: null text is the empty text, with no spans; repeated rows
repeat; equal texts have equal spans; offsets are code points, end exclusive;
other columns are not read by the scan; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.llm.common import prepare, strings, text_or_empty

#: Kinds in the order that breaks ties of equal starts.
KINDS = ("assign", "access", "hex", "linked")
#: Code points on either side of a weak secret that its scope reaches at most.
SCOPE = 200

# The base patterns of the contract.
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is found where its maximal run starts
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

_ID_WORD = re.compile(r"""(?i:access_?key(?:_?id)?|client_?id|account|username|user|login)["']?\x20?[:=]\x20?["']?([A-Za-z0-9_.@-]{3,})""", re.ASCII)
_ID_TOKEN = re.compile(r"(?<![A-Z0-9])(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{8,}")
_SECRET_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_ENDPOINT = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,10}://[^\s\"'<>]+")
_PARAGRAPH = re.compile(r"\n\r?\n")
_PORT = re.compile(r":([0-9]{1,5})(?![0-9A-Za-z_])")
_IP = re.compile(r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?!$)|$)){4}")
_HOST_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.-_")
#: Longest name of a host.
_HOST_MOST = 253


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += ((m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST)
    found += ((m.start(), m.end(), "hex") for m in _HEX.finditer(text))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _mixed(token: str) -> bool:
    """Looks drawn at random: three kinds of characters, or digits among both
    cases, and no dominant character."""
    kinds = any(c.islower() for c in token) + any(c.isupper() for c in token) + any(c.isdigit() for c in token)
    return kinds == 3 and len(set(token)) * 2 >= min(len(token), 40)


def _overlapping(spans: list[tuple]):
    """Tells whether any of the spans overlaps (start, end), by one search."""
    spans = sorted((a, b) for a, b, *_ in spans)
    starts, furthest = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

    def meets(start: int, end: int) -> bool:
        k = bisect_left(starts, end)
        return k > 0 and furthest[k - 1] > start
    return meets


def _host_ports(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """host:port outside the spans ``taken``."""
    out, held = [], _overlapping(taken)
    for m in _PORT.finditer(text):
        if int(m[1]) > 65535:
            continue
        colon = at = m.start()
        low = max(0, colon - _HOST_MOST)
        if text[colon - 1:colon] == "]":
            at = text.rfind("[", low, colon)
            if at < 0 or text.count(":", at, colon) < 2 or not re.fullmatch(r"[0-9A-Fa-f:.]+", text[at + 1:colon - 1]):
                continue
        else:
            while at > low and text[at - 1] in _HOST_CHARACTERS:
                at -= 1
            at += colon - at - len(text[at:colon].lstrip(".-_"))
            host = text[at:colon]
            if not host or host[-1] in ".-_" or ".." in host or not (any(c.isalpha() for c in host) or _IP.fullmatch(host)):
                continue
        if not held(at, m.end()):
            out.append((at, m.end()))
    return out


def _parts(text: str) -> list[tuple[int, int, str]]:
    """Weak parts with their roles: id, secret, endpoint."""
    parts = [(*m.span(1), "id") for m in _ID_WORD.finditer(text)]
    parts += ((*m.span(), "id") for m in _ID_TOKEN.finditer(text))
    parts += ((*m.span(), "secret") for m in _SECRET_TOKEN.finditer(text) if _mixed(m[0]))
    parts += ((*m.span(2), "secret") for m in _ASSIGN.finditer(text) if 6 <= m.end(2) - m.start(2) < ASSIGN_LEAST)
    urls = [m.span() for m in _ENDPOINT.finditer(text)]
    parts += ((*u, "endpoint") for u in urls)
    if any(role == "secret" for *_, role in parts):  # endpoints alone link nothing
        taken = urls + [m.span() for words in (_ASSIGN, _ID_WORD) for m in words.finditer(text)]
        parts += ((*h, "endpoint") for h in _host_ports(text, taken))
    return parts


def linked_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak secrets, and their identifiers, whose complements share a scope."""
    parts, known = _parts(text), _overlapping(base)
    weak = [p for p in parts if p[2] == "secret" and not known(p[0], p[1])]
    if not weak:
        return []
    others = sorted([p for p in parts if p[2] != "secret"] + [(s, e, "id") for s, e, k in base if k == "access"])
    starts = [p[0] for p in others]
    furthest = list(accumulate((p[1] for p in others), max))  # of an end, up to each part
    breaks = [m.start() for m in _PARAGRAPH.finditer(text)]
    found = set()
    for s, e, _ in weak:
        low, high = max(0, s - SCOPE), min(len(text), e + SCOPE)
        own = bisect_left(breaks, s)
        if own:
            low = max(low, breaks[own - 1] + 1)
        own = bisect_left(breaks, e)
        if own < len(breaks):
            high = min(high, breaks[own])
        for k in range(bisect_right(furthest, low), bisect_left(starts, high)):
            a, b, role = others[k]
            if b > low and (b <= s or a >= e):
                found.add((s, e, "linked"))
                if role == "id" and not known(a, b):
                    found.add((a, b, "linked"))
    return sorted(found)


def scan_text(text: str) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    return sorted(base + linked_spans(text, base), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans array<struct<start,stop,kind>>) of every whole text."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())])

    def run(batches):
        for batch in batches:
            spans = [[{"start": s, "stop": e, "kind": k} for s, e, k in scan_text(t)] for t in strings(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(span))], ["doc_id", "spans"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, spans array<struct<start:int,stop:int,kind:string>>")


def digests(scanned: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as one string."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "linked")
    return scanned.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                          F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact_text(text: str) -> str:
    """The text with every span replaced by its kind in brackets; spans that
    touch or overlap are one."""
    out, at = [], 0
    merged: list[list] = []
    for s, e, k in scan_text(text):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, k])
    for s, e, k in merged:
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their secrets replaced; ``n_chars`` follows the text.

    Null texts stay null; all columns keep their names, order and types.
    """
    prepare(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = [t if t is None else redact_text(t) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out
