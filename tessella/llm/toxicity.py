"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is a logistic
function of word and word-stem weights; the document's is their noisy-or,
1 - prod(1 - p).  The weights are trained from document labels alone, and the
sentence probabilities then locate the offending sentences.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, fold, materialize, trimmed

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")
_WORD = re.compile(r"[^\W_]+")
#: Leading characters of a word that are features beside the whole word.
STEMS = (3, 4, 5, 6)
#: Features are hashed to so many weights, so that every word has some, however rare.
BUCKETS = 1 << 20
#: Words that a worker remembers before it starts afresh.
MEMO = 120_000


def features(word: str) -> list[int]:
    """Hashed features of a word: the word itself and its stems."""
    names = [f"={word}", *(f"{n}{word[:n]}" for n in STEMS if len(word) > n)]
    return [zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in names]


def sentences(text: str) -> list[str]:
    """Parts that hold a word."""
    return [s for s in _SENTENCE.split(text) if _WORD.search(s)]


class Memo(dict):
    """``make`` of each word, remembered for at most MEMO words at a time."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= MEMO:
            self.clear()
        self[word] = value = self.make(word)
        return value


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    bias: float = -6.0  # of a sentence

    @property
    def empty(self) -> float:
        """Score of a text without words: that of one sentence of no known word."""
        return float(1 / (1 + np.exp(-self.bias)))

    def memo(self) -> Memo:
        return Memo(lambda w: float(self.weights[features(w)].sum()))

    def scores(self, text: str | None, memo: Memo) -> np.ndarray:
        """Probability of each sentence of ``text``."""
        sums = [self.bias + sum(map(memo.__getitem__, set(_WORD.findall(s.lower())))) for s in sentences(text or "")]
        return 1 / (1 + np.exp(-np.clip(np.array(sums, float), -40, 40)))

    def noisy_or(self, p: np.ndarray) -> float:
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else self.empty


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: label, draw, the number of features of each sentence, and the features."""
    memo = Memo(features)
    for batch in batches:
        lens, ids = [], []
        for text in batch.column(0):
            ln, fs = [], []
            for s in sentences(text.as_py() or ""):
                before = len(fs)
                for w in set(_WORD.findall(s.lower())):
                    fs += memo[w]
                ln.append(len(fs) - before)
            lens.append(ln)
            ids.append(fs)
        size = [len(x) + len(y) for x, y in zip(ids, lens, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(size, pa.int64()), pa.array(lens, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int32()))], ["label", "draw", "size", "lens", "ids"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8_000, entries: int = 16_000_000, folds: int = 5, held_out: int = 0) -> Model:
    """Train on at most about ``sample`` labelled documents, half of each label where there are as many.

    They are drawn by a hash of doc_id within each label and weighted by the share
    drawn; should they hold more than ``entries`` features (of long texts), a smaller
    share is drawn.  These bounds are for the labelled rows only: every word of the
    sample is a feature.  The driver receives the hashed features of the sampled
    sentences, 4 bytes each.  Rows without doc_id or label, or of the fold
    ``held_out``, are left out; repeated labels of one document count once, the
    largest standing.  ``docs`` is read once.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id", folds) != held_out)).groupBy("doc_id").agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("label"))
    size = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(size) < 2:
        return Model()  # nothing to tell apart: every text scores low
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1_000_003)) / 1_000_003
    few = min(sample // 2, *size.values())
    share = {label: min(1.0, (few if n == few else sample - few) / n) for label, n in size.items()}
    some = known.withColumn("draw", draw).filter(F.col("draw") < F.when(F.col("label") == 1, share[1]).otherwise(share[0]))
    # at most about `sample` small rows, so the labels can be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "label", "draw")
    bags = materialize(rows.mapInArrow(trimmed(_bags), "label int, draw double, size long, lens array<int>, ids array<int>"), "toxicity-bags")
    held = bags.agg(F.sum("size")).first()[0] or 0
    cut = min(1.0, entries / max(held, 1))
    data = bags.filter(F.col("draw") < cut * F.when(F.col("label") == 1, share[1]).otherwise(share[0])).orderBy("draw").toArrow()
    discard(bags)
    label = data.column("label").to_numpy().astype(float)
    if len(set(label.tolist())) < 2:
        return Model()
    lens, ids = (data.column(c).combine_chunks() for c in ("lens", "ids"))
    weight = np.where(label > 0, 1 / share[1], 1 / share[0])
    return train(label, weight, np.diff(lens.offsets.to_numpy()), lens.flatten().to_numpy(), ids.flatten().to_numpy())


def train(label: np.ndarray, weight: np.ndarray, per_doc: np.ndarray, per_sentence: np.ndarray, ids: np.ndarray, batch: int = 128, epochs: int = 10, least_steps: int = 600, evidence: float = 0.5) -> Model:
    """Minimise the noisy-or loss plus an L1 penalty by proximal Adam over batches of documents in a fixed order.

    label and weight by document; its sentences; their features, one after the other.
    The penalty is worth ``evidence`` documents: a feature that moves the loss less
    than they would gets weight 0.  A document without sentences counts as one
    sentence without features.
    The bias stays at or below the log-odds of a toxic document, so a sentence of
    unknown words is never likelier toxic than a document is.
    """
    docs = len(label)
    seen = np.bincount(ids, minlength=BUCKETS) > 0
    used, size = np.flatnonzero(seen), int(seen.sum())
    ids = (np.cumsum(seen, dtype=np.int32) - 1)[ids]
    doc_at = np.concatenate([[0], np.cumsum(per_doc)])
    sent_at = np.concatenate([[0], np.cumsum(per_sentence)])
    rate = (weight * label).sum() / weight.sum()
    most = float(np.log(rate / (1 - rate)))
    weight = weight / weight.mean()
    w, bias = np.zeros(size), min(-4.0, most)
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    order = np.random.default_rng(7).permutation(docs)
    batches = [np.sort(order[i : i + batch]) for i in range(0, docs, batch)]
    steps = max(epochs * len(batches), least_steps)
    for step in range(1, steps + 1):
        some = batches[step % len(batches)]
        n = per_doc[some]
        s = np.repeat(doc_at[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        doc_of = np.repeat(np.arange(len(some)), n)
        k = per_sentence[s]
        f = ids[np.repeat(sent_at[s] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())]
        sent_of = np.repeat(np.arange(len(s)), k)
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(sent_of, w[f], minlength=len(s)), -35, 35)))
        p0 = 1 / (1 + np.exp(-bias))
        bare = n == 0
        clear = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(some)) + bare * np.log1p(-p0)
        q = np.clip(-np.expm1(clear), 1e-9, 1 - 1e-12)
        # d loss / d z of a sentence: p (1 - y / q)
        pull = (1 - label[some] / q) * weight[some] / len(some)
        gz = p * pull[doc_of]
        g = np.append(np.bincount(f, gz[sent_of], minlength=size), gz.sum() + (bare * p0 * pull).sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        pace = 0.05 * (1 - 0.9 * step / steps)
        scale = pace / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        move = scale * m / (1 - 0.9**step)
        w, bias = w - move[:-1], float(np.clip(bias - move[-1], -15, most))
        w = np.sign(w) * np.maximum(np.abs(w) - scale[:-1] * evidence / docs, 0)
    out = np.zeros(BUCKETS, np.float32)
    out[used] = w
    return Model(out, bias)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", spans: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Score every whole text: key, score, predicted (score >= 0.5) and, with ``spans``, the offending sentences.

    ``offending`` lists (sentence, probability) of the sentences with probability
    0.5 or more, or of the strongest one where only their union reaches 0.5.
    A text without words (null and empty ones too) scores as one sentence of no known word.
    Whole texts are scored, sentence by sentence, however long; rows with a null key too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        memo = m.memo()
        for batch in batches:
            out, found = [], []
            for value in batch.column(0):
                t = value.as_py()
                p = m.scores(t, memo)
                out.append(m.noisy_or(p))
                if spans:
                    bad = [] if out[-1] < 0.5 or not len(p) else np.flatnonzero(p >= 0.5).tolist() or [int(p.argmax())]
                    parts = sentences(t) if bad else []
                    found.append([{"sentence": parts[i], "p": float(p[i])} for i in bad])
            arrays = [*batch.columns[1:], pa.array(out, pa.float64()), pa.array([int(x >= 0.5) for x in out], pa.int32())]
            names = [*batch.schema.names[1:], "score", "predicted"]
            if spans:
                arrays.append(pa.array(found, pa.list_(pa.struct([("sentence", pa.string()), ("p", pa.float64())]))))
                names.append("offending")
            yield pa.RecordBatch.from_arrays(arrays, names)

    small = docs.select(docs[text].alias("_text"), docs[key].alias("_key"), *(docs[c].alias(f"_c{i}") for i, c in enumerate(carry)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.schema.fields[1:]) + ", score double, predicted int" + ", offending array<struct<sentence:string,p:double>>" * spans
    out = small.mapInArrow(trimmed(run), schema).withColumnRenamed("_key", key)
    for i, c in enumerate(carry):
        out = out.withColumnRenamed(f"_c{i}", c)
    return out
