"""Operator 10: personal data by candidate gradient boosting, in DataFrame
functions throughout.

Base spans. Four patterns are matched in every whole text, leftmost and
without overlap for each kind: e-mail addresses, IP addresses (parts up to
255), card numbers (14 to 19 digits that pass Luhn's check) and international
phone numbers (10 to 15 digits). Matches that fail a check are dropped and not
tried again from within. Patterns are written with possessive quantifiers and
start only where a run of their characters starts, which finds the same
matches without backtracking into long runs.

Candidates. Two high-recall generators propose bounded, overlapping spans.
Around every ``@`` (``word``): what stands before and after it up to white
space, another ``@`` or a delimiter, at most LOCAL and HOST characters, which
are the longest that mail addresses may have. Of numbers (``number``): from
every group of digits on, each run of groups with 7 to 19 digits, and each
group of 20 or more digits whole. Neither needs the rest of a long token, so a
base span beside a candidate, or a text without white space, hides none.

Evidence. No label comes from the base patterns' own match. Positives are
candidates after a cue word (``tel``, ``call``, ``mail``, ``account`` ...) and
base spans re-written, in their context, into formats that no base pattern has
(national phone numbers, hosts without a dot, cards in groups set off by dots
or two spaces; one hash-chosen form for each span). All other candidates clear
of base spans are negatives, parts of rows of digits included, although some may
be personal data: the precision is rather understated by them. Cue words are not among the features, which
describe format (length, digits, groups, separators, letters, check digit) and
neighbouring characters. Boosted trees learn from three quarters of all
documents, chosen by hash; for each generator the least threshold that keeps
PRECISION on the held-out quarter selects candidates.

Reported as kind ``likely`` are the candidates clear of base spans that the
threshold selects or that follow a cue word, without those inside another one
reported; base spans always stay. The trees become one column expression, so
scoring needs neither a join nor Python.

Defined results: null text is the empty text, with no spans; repeated rows
repeat; equal texts have equal spans; offsets are code points, end exclusive;
other columns are not read; an empty table gives an empty result. Where
the documents have candidates of one class only, cue words alone select.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabstat.llm.common import text_or_empty

#: Kinds in the order that breaks ties of equal starts.
KINDS = ("email", "ip", "card", "phone", "likely")
#: Trees, depth, and the precision that the thresholds keep.
TREES, DEPTH, PRECISION = 8, 3, 0.98

# The base patterns of the contract, in Java's syntax.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",  # a run of fewer digits is no card
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = ("word", "number")
#: Longest parts of a mail address; characters of context before a span.
LOCAL, HOST, CONTEXT = 64, 253, 24
_INNER = r"[^\s@,;:\"'<>()\[\]{}|&=?/\\]"
_LOCAL = rf"(?:{_INNER}|(?<=\p{{L}})'(?=\p{{L}}))+$"
_HOST = rf"^{_INNER}*[\p{{L}}\p{{N}}]"
_GAP = r"[\x20().-]{0,2}+"
_NUMBER = rf"(?s)(?<![0-9A-Za-z+(])(?=([+(]?[0-9](?:{_GAP}[0-9]){{6,18}}(?![0-9])|[0-9]{{20,}}+)(.{{0,3}}))"
_AFTER_CUE = r")[^\p{L}\p{N}]{1,3}(?:[A-Za-z]{1,6}[^\p{L}\p{N}]{1,3}){0,2}$"
#: Evidence for labels, by generator; never a feature.
CUES = {"word": r"(?i)(?<![\p{L}\p{N}])(?:e-?mail|mail|mailto|contact|write|reach" + _AFTER_CUE,
        "number": r"(?i)(?<![\p{L}\p{N}])(?:t[eé]l(?:[eé](?:f|ph)\p{L}*)?|phone|call|fax|mobile|cell|whatsapp|card|visa|account|iban" + _AFTER_CUE}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets(m: Column) -> Column:
    return m.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$")


def _passes(kind: str, m: Column) -> Column:
    """The check on a match of a base pattern."""
    digits = _digits(m)
    if kind == "ip":
        return _octets(m)
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _pieces(docs: DataFrame, patterns: dict[str, str], needs: dict[str, str]) -> DataFrame:
    """Two columns a pattern: the text between matches, and the matches.

    ``needs`` names a character without which a pattern cannot match.
    """
    columns = {}
    for name, pattern in patterns.items():
        wanted = F.col("text").contains(needs[name]) if name in needs else F.col("text").rlike("[0-9]")
        columns[f"between_{name}"] = F.when(wanted, F.split("text", pattern, -1)).otherwise(F.array("text"))
        columns[f"found_{name}"] = F.when(wanted, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return docs.withColumns(columns)


def _spans(name: str) -> Column:
    """array<struct<start, stop, m, before, after>> from the two columns."""
    parts = F.filter(F.arrays_zip(F.col(f"between_{name}").alias("gap"), F.col(f"found_{name}").alias("m"), F.slice(F.col(f"between_{name}"), F.lit(2), F.size(f"between_{name}")).alias("rest")),
                     lambda x: x["m"].isNotNull())
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int,m:string,before:string,after:string>>)").alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["m"])
        own = F.struct(start.alias("start"), stop.alias("stop"), x["m"].alias("m"), F.right(x["gap"], F.lit(24)).alias("before"), F.left(x["rest"], F.lit(1)).alias("after"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(own)).alias("out"))

    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def base(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, base array<struct<start,rank,stop>>), in order."""
    kinds = [k for k in KINDS if k in PATTERNS]
    found = _pieces(docs.select("doc_id", text_or_empty().alias("text"), *keep), PATTERNS, {"email": "@", "phone": "+"})

    def checked(rank, kind):
        return F.transform(F.filter(_spans(kind), lambda s: _passes(kind, s["m"])),
                           lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop")))

    lists = [checked(rank, kind) for rank, kind in enumerate(kinds)]
    return found.select("doc_id", "text", *keep, F.array_sort(F.concat(*lists)).alias("base"))


def _features(s: Column) -> dict[str, Column]:
    """Format and neighbours of a candidate."""
    m, digits = s["m"], _digits(s["m"])

    def count(character):
        return F.length(m) - F.length(F.replace(m, F.lit(character), F.lit("")))

    def beside(low, high):
        return F.exists("base", lambda b: (b["stop"] >= low) & (b["start"] <= high))

    out = {"n": F.length(m), "digits": F.length(digits), "letters": F.length(F.regexp_replace(m, r"[^\p{L}]", "")), "groups": F.length(F.regexp_replace(F.regexp_replace(m, "[0-9]+", "9"), "[^9]", "")),
           "dots": count("."), "dashes": count("-"), "spaces": count(" "), "brackets": count("("), "plus": m.startswith("+"), "zero": m.startswith("0"),
           "luhn": F.length(digits).between(13, 19) & F.call_function("luhn_check", digits), "letter_after": s["after"].rlike(r"^[\p{L}\p{N}]"), "letter_before": s["before"].rlike(r"[\p{L}\p{N}]$"),
           # more digits of the same row, unless they are a base span's
           "joined_before": s["before"].rlike(rf"[0-9]{_GAP}$") & ~beside(s["start"] - 3, s["start"] - 1), "joined_after": s["after"].rlike(rf"^{_GAP}[0-9]") & ~beside(s["stop"] + 1, s["stop"] + 3)}
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in out.items()}


_SPAN = "cast(array() as array<struct<start:int,stop:int,m:string,before:string,after:string,longest:boolean>>)"


def _span(start: Column, m: Column, before: Column, after: Column, longest: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), (start + F.length(m)).cast("int").alias("stop"), m.alias("m"), before.alias("before"), after.alias("after"), longest.alias("longest"))


def _words() -> Column:
    """A span around each ``@`` with something on both sides."""
    parts = F.split("text", "@", -1)
    pairs = F.arrays_zip(F.slice(parts, 1, F.size(parts) - 1).alias("gap"), F.slice(parts, 2, F.size(parts) - 1).alias("rest"))
    zero = F.struct(F.lit(0).alias("at"), F.expr(_SPAN).alias("out"))

    def step(acc, x):
        local = F.regexp_extract(F.right(x["gap"], F.lit(LOCAL)), _LOCAL, 0)
        host = F.regexp_extract(F.left(x["rest"], F.lit(HOST)), _HOST, 0)
        end = acc["at"] + F.length(x["gap"])
        near = F.right(x["gap"], F.length(local) + CONTEXT)
        own = _span(end - F.length(local), F.concat(local, F.lit("@"), host), F.left(near, F.length(near) - F.length(local)), F.substring(x["rest"], F.length(host) + 1, F.lit(3)), F.lit(True))
        return F.struct((end + 1).alias("at"), F.when((local == "") | (host == ""), acc["out"]).otherwise(F.concat(acc["out"], F.array(own))).alias("out"))

    return F.when(F.col("text").contains("@"), F.aggregate(pairs, zero, step, lambda acc: acc["out"])).otherwise(F.expr(_SPAN))


def _numbers() -> Column:
    """Spans of groups of digits from every group on.

    The pattern matches no characters and looks ahead, so spans may overlap.
    A space before the text keeps a match off its very start, where a split
    has no empty part.
    """
    text = F.concat(F.lit(" "), F.col("text"))
    run, tail = (F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(k)) for k in (1, 2))
    rows = F.arrays_zip(F.slice(F.split(text, _NUMBER, -1), F.lit(1), F.size(run)).alias("gap"), run.alias("m"), tail.alias("tail"))
    zero = F.struct(F.lit(-1).alias("at"), F.expr("cast(array() as array<struct<start:int,m:string,before:string,tail:string>>)").alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        own = F.struct(start.alias("start"), x["m"].alias("m"), F.right(x["gap"], F.lit(CONTEXT)).alias("before"), x["tail"].alias("tail"))
        return F.struct(start.alias("at"), F.concat(acc["out"], F.array(own)).alias("out"))

    def spans(r):
        n = F.length(r["m"])
        near = F.concat(r["m"], r["tail"])
        ends = F.filter(F.sequence(F.lit(7), n), lambda p: F.substring(r["m"], p, F.lit(2)).rlike("^[0-9](?![0-9])") & (F.length(_digits(F.left(r["m"], p))) >= 7))
        ends = F.when(r["m"].rlike("^[0-9]{20,}$"), F.array(n)).otherwise(ends)
        return F.transform(ends, lambda p: _span(r["start"], F.left(r["m"], p), r["before"], F.substring(near, p + 1, F.lit(3)), p == n))

    found = F.flatten(F.transform(F.aggregate(rows, zero, step, lambda acc: acc["out"]), spans))
    return F.when(F.col("text").rlike(rf"[0-9](?:{_GAP}[0-9]){{6}}"), found).otherwise(F.expr(_SPAN))


def candidates(found: DataFrame) -> DataFrame:
    """Adds ``candidates`` array<struct<start, stop, generator, longest, cue,
    clear, features...>>; ``longest`` where no other starts at the same place
    and is longer, ``clear`` where no base span overlaps."""
    pieces = found.withColumns({"found_word": _words(), "found_number": _numbers()})

    def described(rank, name):
        def one(s):
            clear = ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
            return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(rank).alias("generator"), s["longest"].alias("longest"), s["before"].rlike(CUES[name]).alias("cue"), clear.alias("clear"),
                            *(v.alias(k) for k, v in _features(s).items()))
        return F.transform(f"found_{name}", one)

    lists = [described(rank, name) for rank, name in enumerate(GENERATORS)]
    return pieces.select(*found.columns, F.concat(*lists).alias("candidates"))


#: Features in the order the trees number them.
NAMES = ["n", "digits", "letters", "groups", "dots", "dashes", "spaces", "brackets", "plus", "zero", "luhn", "letter_after", "letter_before", "joined_before", "joined_after"]


def rewritten(found: DataFrame) -> DataFrame:
    """(doc_id, text, low, high): each base mail address, card and phone number
    with its context, in a format that no base pattern has, at [low, high)."""
    rows = found.select("doc_id", "text", F.explode("base").alias("b"))
    rows = rows.select("doc_id", F.element_at(F.array(*map(F.lit, KINDS)), F.col("b.rank") + 1).alias("kind"), F.expr("substring(text, b.start + 1, b.stop - b.start)").alias("m"),
                       F.expr(f"right(left(text, b.start), {CONTEXT})").alias("left"), F.expr(f"substring(text, b.stop + 1, {CONTEXT})").alias("right"), "b.start")
    digits = _digits(F.col("m"))
    national = [F.regexp_replace(F.right(digits, F.lit(10)), r"^(...)(...)(....)$", form) for form in ("($1) $2-$3", "$1-$2-$3", "$1.$2.$3", "$1 $2 $3", "0$1 $2$3", "0$1-$2$3")]
    local = F.substring_index("m", "@", 1)
    forms = {"phone": [*national, F.concat(F.lit("00"), digits)], "email": [F.regexp_extract("m", r"^[^@]+@[^.@]+", 0), F.concat(local, F.lit("@localhost"))],
             "card": [F.regexp_replace(digits, "(....)(?=.)", form) for form in ("$1.", "$1  ")]}
    form = F.lit(None).cast("string")
    for kind, own in forms.items():
        form = F.when(F.col("kind") == kind, F.element_at(F.array(*own), (F.pmod(F.xxhash64("doc_id", "start", "m"), F.lit(len(own))) + 1).cast("int"))).otherwise(form)
    rows = rows.withColumn("form", form).where("form is not null")
    return rows.select("doc_id", F.concat("left", "form", "right").alias("text"), F.length("left").alias("low"), (F.length("left") + F.length("form")).alias("high"))


def examples(chosen: DataFrame) -> DataFrame:
    """(doc_id, label, generator, features...): the labelled candidates.

    Of the candidates from a place that a cue word names the longest is an
    example; others that overlap it, or lie inside a re-written span, are none.
    """
    found = base(chosen)
    clear = candidates(found).withColumn("cued", F.filter("candidates", lambda c: c["clear"] & c["cue"] & c["longest"]))
    others = F.filter("candidates", lambda c: c["clear"] & ~c["cue"] & ~F.exists("cued", lambda x: (x["start"] < c["stop"]) & (c["start"] < x["stop"])))
    own = clear.select("doc_id", F.explode(F.concat("cued", others)).alias("c"))
    own = own.select("doc_id", F.col("c.cue").cast("double").alias("label"), "c.*")
    made = rewritten(found)
    made = (candidates(base(made, ("low", "high"))).select("doc_id", F.explode(F.filter("candidates", lambda c: c["clear"] & (c["start"] == F.col("low")) & (c["stop"] == F.col("high")))).alias("c"))
            .select("doc_id", F.lit(1.0).alias("label"), "c.*"))
    return own.unionByName(made).select("doc_id", "label", "generator", *NAMES)


def _tree(lines: list[str]) -> str:
    """One tree of a model's description as nested conditions on ``c``."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return line.split(":")[1].strip()
    feature, bound = re.search(r"feature (\d+) <= ([-\d.E]+)", line).groups()
    low = _tree(lines)
    lines.pop(0)  # Else
    return f"CASE WHEN c.{NAMES[int(feature)]} <= {bound} THEN {low} ELSE {_tree(lines)} END"


def margin(model) -> str:
    """The model's margin as an SQL expression on a candidate ``c``."""
    parts = []
    for tree, weight in zip(model.trees, model.treeWeights):
        lines = [x for x in tree.toDebugString.split("\n")[1:] if x.strip()]
        parts.append(f"{weight!r}D * ({_tree(lines)})")
    return " + ".join(parts)


def train(docs: DataFrame) -> dict:
    """Margin expression and a threshold for each generator, from all
    documents; no threshold where they do not have both classes."""
    rows = examples(docs).withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(4)) == 0)
    rows = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows).persist()
    try:
        if rows.where("not held").select("label").distinct().count() < 2:
            return {"margin": "0D", "least": {}}
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=17).fit(rows.where("not held"))
        text = margin(model)
        scored = rows.where("held").select("generator", "label", F.round(F.expr(re.sub(r"\bc\.", "", text)), 2).alias("m"))
        counts = scored.groupBy("generator", "m").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")).collect()  # a row per hundredth of margin
    finally:
        rows.unpersist()
    least = {}
    for g in range(len(GENERATORS)):
        n = good = 0
        for r in sorted((r for r in counts if r.generator == g), key=lambda r: -r.m):
            n, good = n + r.n, good + r.good
            if n >= 10 and good >= PRECISION * n:
                least[g] = r.m
    return {"margin": text, "least": least}


def scan(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, text, spans array<struct<start,rank,stop>>) of every whole text;
    base spans only where there is no model."""
    found = base(docs)
    if model is None:
        return found.select("doc_id", "text", F.col("base").alias("spans"))
    bound = " ".join(f"WHEN c.generator = {g} THEN {m!r}D" for g, m in model["least"].items()) or "WHEN false THEN 0D"
    likely = F.expr(f"array_sort(transform(filter(candidates, c -> c.clear AND (c.cue OR round({model['margin']}, 2) >= CASE {bound} ELSE 1e9D END)), "
                    "c -> named_struct('start', c.start, 'back', -c.stop)))")
    # by start, the longest first: one inside another ends no later than one before it
    zero = F.struct(F.lit(-1).alias("at"), F.expr("cast(array() as array<struct<start:int,rank:int,stop:int>>)").alias("out"))

    def step(acc, x):
        stop = -x["back"]
        own = F.struct(x["start"].alias("start"), F.lit(KINDS.index("likely")).alias("rank"), stop.alias("stop"))
        return F.when(stop > acc["at"], F.struct(stop.alias("at"), F.concat(acc["out"], F.array(own)).alias("out"))).otherwise(acc)

    outer = F.aggregate(likely, zero, step, lambda acc: acc["out"])
    return candidates(found).select("doc_id", "text", F.array_sort(F.concat(F.col("base"), outer)).alias("spans"))


def digests(scanned: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as one string."""
    names = F.array(*map(F.lit, KINDS))
    likely = KINDS.index("likely")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count(rank):
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    counts = [count(rank) for rank in range(likely)]
    return scanned.select("doc_id", *counts, F.sha2(listed(F.filter("spans", lambda s: s["rank"] < likely)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
