"""Operator 9: base spans against a direct scan; linked spans."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tabstat.llm import secrets

TEXTS = ['token = "abcdefghijkl" x', "PASSWORD:short", "api_key=" + "Z" * 12 + " apikey : 'q1234567890123'", "AKIA" + "A" * 14, "AKIA" + "B" * 13, "deadbeefdeadbeef 0123456789abcdef0", "x" * 70_000 + " secret=" + "a" * 30,
         "user: alice 9fK2mQ7xLp0ZtRw8Vb3Nc5Hj", "9fK2mQ7xLp0ZtRw8Vb3Nc5Hj alone here", "passwd=a=b=c=d=e=f=g", "", None, "é token=ééé"]


def direct(t):
    f = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
    f += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    f += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(f, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_scan(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 AS spans")
    got = {r.doc_id: r for r in secrets.digests(secrets.scan(frame)).collect()}
    for i, t in enumerate(TEXTS):
        want = direct(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == kind for k, *_ in want) for kind in ("assign", "access", "hex"))
    assert secrets.digests(secrets.scan(frame.limit(0))).collect() == []


def test_weak_parts_need_a_complement():
    assert secrets.scan_text(TEXTS[7]) == [(6, 11, "linked"), (12, 36, "linked")]
    assert secrets.scan_text(TEXTS[8]) == []
    assert secrets.scan_text("user: alice" + "\n\n" + TEXTS[8]) == []


def test_redaction(spark):
    rows = [(1, "a token=abcdefghijklmn b", 5), (2, None, None), (3, "plain", 5)]
    out = {r.doc_id: r for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert (out[1].text, out[1].n_chars) == ("a [ASSIGN] b", 12) and out[2].text is None and out[3].text == "plain"


def test_endpoints():
    for endpoint in ("db.internal:5432", "10.0.0.7:22", "localhost:8080", "[fe80::1]:443", "HTTPS://DB.INTERNAL/x"):
        assert secrets.scan_text(f"password: hunter22 host {endpoint}") == [(10, 18, "linked")], endpoint
        assert secrets.redact_text(f"password: hunter22 host {endpoint}") == f"password: [LINKED] host {endpoint}"
    for other in ("at 12:30", "300.1.1.1:22", "token:12345", "db.internal:99999", "ratio :80", "a::b"):
        assert secrets.scan_text(f"password: hunter22 host {other}") == [], other
    assert secrets.scan_text("see https://example.com:443/Docs/Guide2024/index") == []


def test_long_parts_beside_a_secret():
    url = "https://x.org/?" + "q=a&" * 100
    assert secrets.scan_text(f"{url} password: hunter22") == [(len(url) + 11, len(url) + 19, "linked")]
    assert secrets.scan_text(f"password: hunter22 {url}") == [(10, 18, "linked")]
    assert secrets.scan_text(f"{url} {'w ' * 100}password: hunter22") == []


def test_identifiers_of_any_length_go_whole():
    name = "svc." + "xyz-" * 31 + "@corp"
    assert secrets.redact_text(f"user: {name} 9fK2mQ7xLp0ZtRw8Vb3Nc5Hj") == "user: [LINKED] [LINKED]"


def test_paragraphs_of_either_line_ending():
    for gap in ("\n\n", "\r\n\r\n"):
        assert secrets.scan_text("user: alice" + gap + TEXTS[8]) == []
        assert secrets.scan_text("user: alice" + gap[len(gap) // 2:] + TEXTS[8])[1:] != []


def brute_linked(text, base):
    """Every weak secret against every other part."""
    parts = secrets._parts(text)
    clash = lambda a, b, spans: any(s < b and a < e for s, e, *_ in spans)
    others = [p for p in parts if p[2] != "secret"] + [(s, e, "id") for s, e, k in base if k == "access"]
    out = set()
    for s, e, role in parts:
        if role != "secret" or clash(s, e, base):
            continue
        gaps = [m.start() for m in re.finditer(r"\n\r?\n", text)]
        low = max([0, s - secrets.SCOPE, *(g + 1 for g in gaps if g < s)])
        high = min([len(text), e + secrets.SCOPE, *(g for g in gaps if g >= e)])
        for a, b, other in others:
            if b > low and a < high and (b <= s or a >= e):
                out.add((s, e, "linked"))
                if other == "id" and not clash(a, b, base):
                    out.add((a, b, "linked"))
    return sorted(out)


PIECES = ["user: alice ", "client_id=" + "q" * 90 + " ", "9fK2mQ7xLp0ZtRw8Vb3Nc5Hj ", "password: hunter22 ", "AKIA" + "A" * 16 + " ", "db.internal:5432 ", "https://x.org/a?b=c ",
          "\n\n", "\r\n\r\n", "\n", "plain words stand here " * 6, "secret=" + "z" * 20 + " ", "deadbeef" * 3 + " "]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_linked_spans_equal_a_brute_force_join(pieces):
    text = "".join(pieces)
    base = secrets.base_spans(text)
    assert secrets.linked_spans(text, base) == brute_linked(text, base)


def test_time_follows_the_length():
    import time

    def seconds(n):
        text = "".join(f"user: name{k} password: hunt{k:04d} host db{k}.internal:5432 token={k:020d}\n" for k in range(n))
        at = time.perf_counter()
        secrets.scan_text(text)
        return time.perf_counter() - at

    seconds(500)
    assert seconds(8_000) < 4 * 2.5 * max(seconds(2_000), 0.02)
