"""Operator 10: base spans against a direct scan, in JVM functions alone."""

import hashlib
import re

import pytest

from tabstat.llm import pii

TEXTS = ["a@b.c_x@d.e", "a@b.c@d.e f@g.h..x@y.z", "1.2.3.4.5.6.7.8 300.1.1.1 1.2.3.4", "4111 1111 1111 1111 41111111111111111234 4111-1111-1111-1111-", "+1 (980) 555-6268 +12345678901234567 +1-2", "é𝄞 me@x.org 0001.2.3.255",
         "", None, "@ @@ a@ @b.c + +1", "1" * 20_000, "1 2 " * 5_000, "a" * 30_000 + "@b.c", ("4" * 16 + " x@y.zz,") * 40]


def luhn(digits):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def direct(t):
    only = lambda m: re.sub("[^0-9]", "", m[0])
    f = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    f += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    f += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(only(m)) <= 19 and luhn(only(m))]
    f += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(only(m)) <= 15]
    return [f"{k}:{a}:{b}" for k, a, b in sorted(f, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 AS base", "2 AS spans", "3 AS candidates")


def test_base_spans(spark, frame):
    for r in pii.digests(pii.scan(frame, None)).collect():
        want = direct(TEXTS[r.doc_id] or "")
        assert r.spans == ",".join(want) and r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in ("email", "ip", "card", "phone")]
    assert pii.digests(pii.scan(frame.limit(0), None)).collect() == []


def test_model_keeps_base_spans(spark):
    texts = []
    for i in range(400):
        texts += [(4 * i, f"mail me at user{i}@host{i % 7}.org now"), (4 * i + 1, f"call +1 (98{i % 10}) 555-{1000 + i} today"), (4 * i + 2, f"order 20{i:06d}1234567 shipped"), (4 * i + 3, f"call 0098{i % 10} 555 {1000 + i} today")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = pii.train(docs)
    assert model is not None and "CASE WHEN c." in model["margin"]
    rows = pii.digests(pii.scan(docs, model)).collect()
    by_id = dict(texts)
    assert len(rows) == len(texts)
    for r in rows:
        assert [s for s in r.spans.split(",") if s and not s.startswith("likely")] == direct(by_id[r.doc_id])
    plan = pii.scan(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEval", "Arrow")


PLANTED = ["see (212) 555-0187 soon", "see 212.555.0188 soon", "write root7@localhost, please", "x root8@intranet y", "account 99887766554 is open", '{"a":"root9@localhost","b":"z@y.org"}']


def mixed(n):
    out = []
    for i in range(n):
        out += [f"the desk of user{i} is user{i}@host{i % 7}.org now", f"the desk has +1 (98{i % 10}) 555-{1000 + i} today", f"order 77{i:05d}441 shipped", f"part 20{i:06d}-12-{i:04d} and key@{i}% off"]
    return out


def test_planted_data_beyond_the_base_is_reported(spark):
    texts = list(enumerate(mixed(300) + PLANTED + ["order 7712345441 shipped"]))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = pii.train(docs)
    assert set(model["least"]) == {0, 1}
    got = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s] for r in pii.digests(pii.scan(docs, model)).collect()}
    likely = {i: [t[int(a):int(b)] for k, a, b in got[i] if k == "likely"] for i, t in texts}
    assert [likely[i] for i in range(1200, 1206)] == [["(212) 555-0187"], ["212.555.0188"], ["root7@localhost"], ["root8@intranet"], ["99887766554"], ["root9@localhost"]]
    assert likely[1206] == [] and sum(map(len, [likely[i] for i in range(1200)])) <= 24


def test_candidates_are_bounded_and_overlap(spark):
    texts = ["admin@localhost,foo@bar.com", "x" * 500 + "=admin@localhost&y=" + "z" * 500, "a@b@c", "4111 1111 1111 1111 (980) 555-6268", " ".join(["12345"] * 100) + " 980-555-6268", "7" * 500, "9805556268"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {texts[r.doc_id][c.start:c.stop] for c in r.candidates if c.clear} for r in pii.candidates(pii.base(docs)).collect()}
    assert got[0] == got[1] == {"admin@localhost"} and got[2] == {"a@b", "b@c"}
    assert got[3] == {"(980) 555-6268", "555-6268"} and "980-555-6268" in got[4] and got[5] == {"7" * 500} and got[6] == {"9805556268"}
    assert all(len(m) <= 55 for m in got[4])


def test_trees_learn_from_every_document(spark):
    docs = spark.createDataFrame([(i, f"tel: 555-{i % 10}{i % 7}9-1234 or 12345678 pieces") for i in range(6000)], "doc_id long, text string")
    seen = []
    old = pii.examples
    try:
        pii.examples = lambda d: (seen.append(d.count()), old(d.limit(0)))[1]
        pii.train(docs)
    finally:
        pii.examples = old
    assert seen == [6000]
