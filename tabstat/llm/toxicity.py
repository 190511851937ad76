"""Operator 6: toxicity by a subsequence string-kernel SVM with Nyström landmarks.

Kernel. Two tokens are compared by the gap-weighted subsequences of four
characters that they share, marks for the token's start and end among them: a
subsequence that spans s characters weighs DECAY ** (s - 4), spans of at most
SPAN characters count, and the kernel is normalised by the tokens' own norms. Characters put into a word only lengthen
the spans ("idxiot"), so such words stay near the plain one. Punctuation in a
word is left out ("i.d-i.o.t"), and single characters in a row ("i d i o t")
are one token.

Training. Labelled documents (a bounded, hash-chosen sample, equal texts once)
are cut into sentences. Sentences of clean documents are clean; a toxic
document is a bag in which some token is toxic. Tokens that occur in no clean
sentence and in several toxic documents are the witnesses, tokens of clean
sentences the negatives. LANDMARKS tokens span the Nyström features
(K_zz^-1/2 k_z(x)); a linear SVM on them is trained by accelerated
gradient steps, and further rounds add the clean tokens that it takes for toxic
and the best token of every training bag that it rejects. The SVM's margin for a token is linear in the token's
subsequences, so it is folded into one table over them, which is all that
scoring needs.

Scoring. A document is seen through the margins of its BEST most toxic
different tokens, over all its sentences; a logistic curve fitted on labelled
documents that were not trained on turns them into a score between 0 and 1.

Defined results: a text without tokens (null, empty, white space) gets the
calibrated score of the clean side; repeated rows repeat; equal texts score
equal; columns other than doc_id and text are not read for a score; an empty
table gives an empty result, and without labels of both kinds every text
scores 0.
"""

from __future__ import annotations

import re
from heapq import nlargest
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabstat.llm.common import in_groups, prepare, strings, text_or_empty

#: Kernel: weight of each further character spanned, and the longest span.
DECAY, SPAN = 0.7, 7
#: Letters keep their own class, other characters share classes by hash; a
#: subsequence is hashed to an index below SLOTS.
CLASSES, SLOTS = 64, 1 << 20
START, END = "\x02", "\x03"
#: Longest token scored in one go; longer ones are windows that overlap by half.
WINDOW = 24
LANDMARKS = 400
#: Different tokens of a text that its score looks at, the most toxic first.
BEST = 3
#: Rounds of hard negatives and missed bags after the first fit.
ROUNDS = 2
#: Bounds of the training sample: labelled documents, and tokens of each kind.
SAMPLE_DOCS = 6_000
SAMPLE_TOKENS = 2_000

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Offsets of the second, third and fourth character.
_GAPS = [(i, j, k) for k in range(3, SPAN) for j in range(2, k) for i in range(1, j)]


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s.strip()]


def tokens(sentence: str) -> list[str]:
    """Lower-case words without punctuation; single characters in a row are
    one token; long ones become overlapping windows."""
    out, letters = [], []
    for w in [*sentence.lower().split(), ""]:
        if not w.isalnum():
            w = "".join(filter(str.isalnum, w))
        if len(w) == 1:
            letters.append(w)
            continue
        if letters:
            out += _windows("".join(letters))
            letters = []
        if w:
            out += _windows(w)
    return out


def _windows(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word]
    return [word[i:i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, slot, weight) of all gapped subsequences, each pair once, scaled
    to norm 1 in every word."""
    words = [START + w + END for w in words]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    kind = np.where((code >= 97) & (code <= 122), code - 97, 26 + code * 2654435761 % (CLASSES - 26))
    word = np.repeat(np.arange(len(words)), lengths)
    at, slot, weight = [], [], []
    for i, j, k in _GAPS:
        n = len(kind) - k
        if n <= 0:
            continue
        same = np.flatnonzero(word[:n] == word[k:])
        own = ((kind[same] * CLASSES + kind[same + i]) * CLASSES + kind[same + j]) * CLASSES + kind[same + k]
        at.append(word[same])
        slot.append(own * 0x9E3779B1 >> 7 & SLOTS - 1)
        weight.append(np.full(len(same), DECAY ** (k - 3)))
    if not at:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0),)
    at, slot, weight = map(np.concatenate, (at, slot, weight))
    pair, back = np.unique(at * SLOTS + slot, return_inverse=True)
    weight = np.bincount(back, weight)
    at, slot = pair // SLOTS, pair % SLOTS
    norm = np.sqrt(np.bincount(at, weight ** 2, len(words)))
    return at, slot, weight / norm[at]


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised kernel of every word of a with every word of b."""
    out = np.zeros((len(a), len(b)))
    at, slot, weight = subsequences(a)
    order = np.argsort(slot, kind="stable")
    at, slot, weight = at[order], slot[order], weight[order]
    of, own, value = subsequences(b)
    low, high = np.searchsorted(slot, own), np.searchsorted(slot, own, "right")
    bounds = np.searchsorted(of, np.arange(len(b) + 1))
    for k in range(len(b)):
        part = slice(bounds[k], bounds[k + 1])
        n = high[part] - low[part]
        hit = np.repeat(low[part] - np.cumsum(n) + n, n) + np.arange(n.sum())  # the words' entries with these slots
        out[:, k] = np.bincount(at[hit], weight[hit] * np.repeat(value[part], n), len(a))
    return out


class Scorer:
    """Margins of tokens and texts by the folded table; margins of frequent
    tokens are kept between batches."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, bias: float, limit: int = 500_000):
        self.table = np.zeros(SLOTS)
        self.table[slots] = weights
        self.bias, self.known, self.limit = bias, {}, limit

    def margins(self, words: list[str]) -> np.ndarray:
        at, slot, weight = subsequences(words)
        return np.bincount(at, weight * self.table[slot], len(words)) + self.bias

    def texts(self, texts: list[str]) -> np.ndarray:
        """The BEST largest margins of each text's different tokens, clipped to
        [-1, 2]; -1 where a text has fewer."""
        known = self.known
        if len(known) > self.limit:
            known.clear()
        own = [list(chain.from_iterable(map(tokens, sentences(t)))) for t in texts]
        new = list({w for row in own for w in row if w not in known})
        fresh = {}
        for group in in_groups(new, 200_000):
            fresh.update(zip(group, self.margins(group).tolist()))
        known.update(fresh)
        out = np.full((len(texts), BEST), -1.0)
        for k, row in enumerate(own):
            for j, m in enumerate(nlargest(BEST, map(known.__getitem__, set(row)))):
                out[k, j] = min(max(m, -1.0), 2.0)
        return out


def _features(landmarks: list[str]):
    """Maps words to Nyström features; also the map's matrix."""
    k = kernel(landmarks, landmarks)
    value, vector = np.linalg.eigh((k + k.T) / 2)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    return root, lambda words: kernel(words, landmarks) @ root


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-5, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge) by accelerated gradient steps; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = v = np.zeros(x.shape[1])
    step = 1 / (2 * np.linalg.eigvalsh((x * weight[:, None]).T @ x)[-1] + penalty)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (penalty * v - 2 * x.T @ (weight * slack * y))
        v = new + t / (t + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Coefficients and offset of a logistic curve, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    if not 0 < label.sum() < len(label):
        return np.array([1.0] * (x.shape[1] - 1) + [0.0])
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.1] * (len(w) - 1) + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - label) + ridge @ w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _pick(words: list[str], most: int) -> list[str]:
    """At most ``most`` of the words, spread by hash."""
    return sorted(words, key=lambda w: (crc32(w.encode()), w))[:most]


def training_rows(docs: DataFrame, labels: DataFrame, allowed, sample: int = SAMPLE_DOCS) -> DataFrame:
    """(text, toxic, part): about ``sample`` labelled documents, equal texts
    once, chosen by a hash of the id; part 0 calibrates, the others train.

    A text with contrary labels counts as toxic. ``allowed`` is the condition
    on doc_id for labels that may be learnt from.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).where(allowed).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = min(1.0, sample / max(n, 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    return (rows.groupBy("text").agg(F.max("toxic").alias("toxic"))
            .withColumn("part", F.pmod(F.xxhash64("text"), F.lit(4))))


def _count_tokens(batches):
    """(token, toxic) once per training document, with its part."""
    for batch in batches:
        out = {"doc": [], "token": [], "toxic": [], "part": []}
        for k, (text, toxic, part) in enumerate(zip(strings(batch, "text"), batch.column("toxic").to_pylist(), batch.column("part").to_pylist())):
            own = set(chain.from_iterable(map(tokens, sentences(text))))
            out["token"] += own
            out["toxic"] += [toxic] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(out["token"], pa.string()), pa.array(out["toxic"], pa.int32())], ["token", "toxic"])


def train(docs: DataFrame, labels: DataFrame, allowed) -> dict:
    """The folded model: slots, weights, bias, and the curve of the scores."""
    prepare(docs.sparkSession)
    rows = training_rows(docs, labels, allowed).select("text", F.col("toxic").cast("int").alias("toxic"), F.col("part").cast("int").alias("part")).persist()
    try:
        nothing = {"slots": np.empty(0, np.int64), "weights": np.empty(0), "bias": -1.0, "curve": np.array([0.0] * BEST + [-50.0])}
        if rows.select("toxic").distinct().count() < 2:
            return nothing
        counts = (rows.where("part > 0").mapInArrow(_count_tokens, "token string, toxic int")
                  .groupBy("token").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))).persist()
        order = F.xxhash64("token")
        often = counts.groupBy((F.col("pos") + F.col("neg")).alias("n")).agg(F.count(F.lit(1)).alias("tokens"), F.sum("pos").alias("pos")).where("n <= 64").toPandas()
        witness = [(r.token, r.pos) for r in counts.where("neg * 20 <= pos and pos > 1").orderBy(F.desc("pos"), order).limit(SAMPLE_TOKENS).collect()]
        least = _significant(often)
        witness = [w for w, n in witness if n >= least]
        known = set(witness)
        clean = [r.token for r in counts.where("neg > 0").orderBy(F.desc("neg"), order).limit(SAMPLE_TOKENS).collect()]
        clean += [r.token for r in counts.where("neg > 0").orderBy(order).limit(SAMPLE_TOKENS).collect()]
        clean = [w for w in dict.fromkeys(clean) if w not in known]
        if not witness or not clean:
            return nothing
        model = _fit(witness, clean, [])
        for _ in range(ROUNDS):
            # clean tokens that the machine takes for toxic or nearly so become
            # negatives; the best token of a bag without any becomes positive
            # where it stands out from all but one in a thousand clean ones
            scorer = Scorer(model["slots"], model["weights"], model["bias"])
            floor = float(np.quantile(scorer.margins(clean), 0.999))
            shared = docs.sparkSession.sparkContext.broadcast(model)
            hard = (counts.where("neg > 0 and neg * 20 > pos").select("token", "neg").mapInArrow(_token_margins(shared), "token string, neg long, margin double")
                    .where("margin > -0.8").orderBy(F.desc(F.col("margin") + F.log("neg")), order).limit(SAMPLE_TOKENS).collect())
            bags = rows.where("part > 0 and toxic = 1").mapInArrow(_missed(shared), "token string, margin double").where(F.col("margin") > floor)
            more = [r.token for r in bags.groupBy("token").agg(F.max("margin").alias("m")).orderBy(F.desc("m"), order).limit(SAMPLE_TOKENS).collect()]
            known |= set(clean)
            taken = [r.token for r in hard]
            clean += [w for w in taken if w not in known]
            known |= set(clean)
            witness += [w for w in more if w not in known]
            known |= set(witness)
            model = _fit(witness, clean, taken)
        counts.unpersist()
        shared = docs.sparkSession.sparkContext.broadcast(model)
        held = rows.where("part = 0").mapInArrow(_margins(shared, "toxic"), "toxic int, margins array<double>").toPandas()
        return model | {"curve": _logistic(np.array(held["margins"].tolist()).reshape(-1, BEST), held["toxic"].to_numpy())}
    finally:
        rows.unpersist()


def _significant(often) -> int:
    """The least number of toxic documents at which a token that only toxic
    ones have is no chance: among the tokens that occur so often, fewer than
    one in two would be toxic throughout at the base rate."""
    base = min(0.5, max(often["pos"].sum() / max((often["n"] * often["tokens"]).sum(), 1), 1e-6))
    by_n = dict(zip(often["n"], often["tokens"]))
    return next((n for n in range(2, 64) if sum(t * base ** k for k, t in by_n.items() if k >= n) < 0.5), 64)


def _variant(word: str) -> str:
    """The word with one character put in, place and character by hash."""
    h = crc32(word.encode())
    at = 1 + h % max(1, len(word) - 1)
    return word[:at] + "abcdefghijklmnopqrstuvwxyz0123456789"[h // 64 % 36] + word[at:]


def _fit(positive: list[str], clean: list[str], hard: list[str]) -> dict:
    """SVM on Nyström features of tokens and of their one-insertion variants."""
    landmarks = positive[:LANDMARKS // 2] + hard[:LANDMARKS // 4] + _pick(clean, LANDMARKS // 4)
    landmarks = list(dict.fromkeys(landmarks))
    words = [*positive, *map(_variant, positive), *clean, *map(_variant, clean)]
    y = np.repeat([1.0, -1.0], [2 * len(positive), 2 * len(clean)])
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())  # both sides weigh the same in all
    root, features = _features(landmarks)
    w, bias = _svm(features(words), y, weight)
    share = root @ w
    at, slot, value = subsequences(landmarks)
    table = np.bincount(slot, value * share[at], SLOTS)
    own = np.flatnonzero(table)
    return {"slots": own, "weights": table[own], "bias": bias}


def _token_margins(shared):
    def run(batches):
        model = shared.value
        scorer = Scorer(model["slots"], model["weights"], model["bias"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("neg"), pa.array(scorer.margins(strings(batch, "token")), pa.float64())], ["token", "neg", "margin"])

    return run


def _missed(shared):
    """The most toxic token of every toxic document that has no token above 0."""
    def run(batches):
        model = shared.value
        scorer = Scorer(model["slots"], model["weights"], model["bias"])
        for batch in batches:
            best = []
            for text in strings(batch, "text"):
                own = sorted(set(chain.from_iterable(map(tokens, sentences(text)))))
                if own:
                    m = scorer.margins(own)
                    if m.max() <= 0:
                        best.append((own[int(m.argmax())], float(m.max())))
            yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64())], ["token", "margin"])

    return run


def _margins(shared, keep: str):
    def run(batches):
        model = shared.value
        scorer = Scorer(model["slots"], model["weights"], model["bias"])
        for batch in batches:
            best = [row for group in in_groups(strings(batch, "text"), 1 << 20) for row in scorer.texts(group).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(best, pa.list_(pa.float64()))], [keep, "margins"])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every whole text."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_margins(shared, "doc_id"), f"doc_id {kind}, margins array<double>")
    curve = model["curve"].tolist()
    value = sum((F.col("margins")[k] * curve[k] for k in range(BEST)), F.lit(curve[-1]))
    return scored.select("doc_id", (1 / (1 + F.exp(-value))).alias("score"))


def reject(docs: DataFrame, model: dict) -> DataFrame:
    """The documents that score below 0.5, columns and types unchanged."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(*(shared.value[k] for k in ("slots", "weights", "bias")))
        curve = shared.value["curve"]
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            clean = [v < 0 for group in in_groups(texts, 1 << 20) for v in scorer.texts(group) @ curve[:-1] + curve[-1]]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id):
    """The fold that no label may be learnt from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0
