"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three characters of the lower-cased text, with digits and white space folded
and a blank put at both ends, weighted by term share times inverse document frequency. Document frequencies are
counted over all documents that may teach. The weights are learned by follow-the-regularised-leader with elastic-net
penalties on a sample of at most ``PER_LANG`` documents of each language, and a temperature fitted on a part of the
sample kept aside calibrates the scores.

Null languages do not teach. Null texts and texts without a letter are ``und`` with score 0. Without anything to
learn from every text is ``und``. Equal scores go to the smaller language name. Only text and lang are read; held-out
documents, lang, source and doc_id are no inputs of a prediction. Repeated rows are predicted each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.quality_rules import held_out
from loomery.llm.words import mix
from loomery.runtime import Scratch, released

BITS = 14
SIZE = 1 << BITS
PER_LANG = 600
EPOCHS = 4
_CUT = 1 << 20
_FOLD = str.maketrans({**{c: "0" for c in "0123456789"}, **{c: " " for c in "\t\n\x0b\x0c\r "}})


def _folded(text: str) -> str:
    return f" {text.lower().translate(_FOLD)} "


def _buckets(padded: str, lens: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams that start at each character of texts on end, a row a character; -1 where one would leave its text."""
    x = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    stop, place = np.repeat(np.cumsum(lens), lens), np.arange(len(x))
    out = np.empty((len(x), 3), dtype=np.int32)
    one, two, three = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    h1 = x * one
    h2 = h1.copy()
    h2[:-1] += (x[1:] + np.uint64(1)) * two
    h3 = h2.copy()
    h3[:-2] += (x[2:] + np.uint64(1)) * three
    shift = np.uint64(64 - BITS)
    for k, h in enumerate((h1, h2, h3)):
        out[:, k] = (mix(h + np.uint64(k)) >> shift).astype(np.int32)
        if k:
            out[place + k >= stop, k] = -1
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, and each text's first one (n + 1 offsets)."""
    padded = [_folded(t) for t in texts]
    lens = np.array([len(p) for p in padded], dtype=np.int64)
    flat = _buckets("".join(padded), lens).reshape(-1)
    keep = flat >= 0
    before = np.concatenate([[0], np.cumsum(keep)])
    return flat[keep], before[np.concatenate([[0], np.cumsum(lens)]) * 3]


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket occurs in one text, however long: window by window, each n-gram by where it starts."""
    padded, total = _folded(text), np.zeros(SIZE, dtype=np.int64)
    for a in range(0, len(padded), _CUT):
        part = padded[a : a + _CUT + 2]
        own = _buckets(part, np.array([len(part)]))[:_CUT]
        total += np.bincount(own[own >= 0], minlength=SIZE)
    return total


def _parts(texts: list):
    """Slices of a batch of bounded size in characters, whole texts each; a longer text is a slice of its own."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= _CUT):
            size += len(texts[j] or "")
            j += 1
        yield i, [t or "" for t in texts[i:j]]
        i = j


@released
def _frequencies(batches):
    """Document frequencies of the buckets over a task's documents; bucket -1 counts documents."""
    df, n = np.zeros(SIZE, dtype=np.int64), 0
    for batch in batches:
        for _, texts in _parts(batch.column("text").to_pylist()):
            n += len(texts)
            if len(texts[0]) > _CUT:
                df += gram_counts(texts[0]) > 0
                continue
            g, off = grams(texts)
            for k in range(len(texts)):
                df[np.unique(g[off[k] : off[k + 1]])] += 1
    hit = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1).astype(np.int32)), pa.array(np.append(df[hit], n))], ["bucket", "df"])


@released
def _features(batches):
    """Distinct buckets and their counts of each document."""
    for batch in batches:
        at, langs = [], batch.column("lang")
        b_, c_ = [], []
        for i, texts in _parts(batch.column("text").to_pylist()):
            long = gram_counts(texts[0]) if len(texts[0]) > _CUT else None
            g, off = grams(texts) if long is None else (None, None)
            for k in range(len(texts)):
                b, c = (np.flatnonzero(long), long[long > 0]) if long is not None else np.unique(g[off[k] : off[k + 1]], return_counts=True)
                at.append(i + k)
                b_.append(b.astype(np.int32))
                c_.append(c.astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("key"), langs, pa.array(b_, pa.list_(pa.int32())), pa.array(c_, pa.list_(pa.int32()))], ["key", "lang", "buckets", "counts"])


@dataclass
class Model:
    langs: list[str]
    #: a row of weights for each bucket, IDF included, and a bias
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def _soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, epochs: int = EPOCHS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (SIZE x classes) and bias by follow-the-regularised-leader, one document at a time."""
    z, n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))
    rng = np.random.default_rng(seed)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i, v = rows[r]
            i, v = np.append(i, SIZE), np.append(v, 1.0)
            w = weights(i)
            p = _soft(v @ w)
            p[y[r]] -= 1
            g = v[:, None] * p[None, :]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(SIZE + 1))
    return w[:-1], w[-1]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by a golden-section search."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(_soft(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    lo, hi, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Learn from (doc_id, text, lang) rows outside the held-out part."""
    scratch = Scratch(docs.sparkSession, "langid")
    mine = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    # SIZE + 1 counters come to the driver
    freq = mine.select("text").mapInArrow(_frequencies, "bucket int, df bigint").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(SIZE + 1)
    df[freq["bucket"].to_numpy()] = freq["df"].to_numpy()
    total, df = df[-1], df[:-1]
    idf = np.log((1 + total) / (1 + df)) + 0.1
    sizes = {r["lang"]: r["count"] for r in mine.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((SIZE, 0)), np.zeros(0), 1.0)
    # a hash deals out about per_lang documents of each language; the hash's share is exact integers
    parts = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(max(1, -(-n // per_lang))))])
    key = F.xxhash64("doc_id", "text")
    sample = mine.withColumn("key", key).where(F.pmod(F.xxhash64(F.col("key"), F.lit(11)), F.element_at(parts, F.col("lang"))) == 0)
    t = scratch.keep(sample.select("key", "lang", "text").mapInArrow(_features, "key bigint, lang string, buckets array<int>, counts array<int>"), "sample").toArrow().sort_by([("key", "ascending"), ("lang", "ascending")])
    at = {x: i for i, x in enumerate(langs)}
    y = np.array([at[x] for x in t["lang"].to_pylist()])
    rows = []
    for b, c in zip(t["buckets"], t["counts"], strict=True):
        b, c = b.values.to_numpy(), c.values.to_numpy().astype(float)
        rows.append((b, 10 * c / max(1.0, c.sum()) * idf[b]))
    aside = np.abs(t["key"].to_numpy()) % 5 == 0
    learn = np.flatnonzero(~aside) if (~aside).any() else np.arange(len(rows))
    w, bias = ftrl([rows[i] for i in learn], y[learn], len(langs))
    test = np.flatnonzero(aside)
    logits = np.array([rows[i][1] @ w[rows[i][0]] + bias for i in test]).reshape(len(test), len(langs))
    return Model(langs, w * idf[:, None] * 10, bias, _temperature(logits, y[test]))


def _predictor(shared):
    @released
    def run(batches):
        m: Model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lang, prob = ["und"] * len(texts), [0.0] * len(texts)
            for i, part in _parts(texts) if m.langs else ():
                total = np.zeros((len(part), len(m.langs)))
                if len(part[0]) > _CUT:
                    own = gram_counts(part[0])
                    total[0] = own @ m.weights / max(1, own.sum())
                else:
                    g, off = grams(part)
                    counts = np.maximum(1, np.diff(off))
                    for c in range(len(m.langs)):
                        run_ = np.concatenate([[0.0], np.cumsum(m.weights[g, c])])
                        total[:, c] = (run_[off[1:]] - run_[off[:-1]]) / counts
                p = _soft((total + m.bias) / m.temperature)
                for k, t in enumerate(part):
                    if any(map(str.isalpha, t)):
                        j = int(p[k].argmax())
                        lang[i + k], prob[i + k] = m.langs[j], float(min(1.0, p[k, j]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(lang), pa.array(prob)], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_predictor(shared), "doc_id bigint, lang_pred string, score double")
