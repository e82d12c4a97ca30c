"""Language identification by multilingual mixture inference.

Each language has a smoothed byte-trigram distribution.  A document is a mixture
of languages: expectation-maximisation estimates the proportions, and the set of
languages is chosen by penalised likelihood over nested sets, from the one
strongest language upwards.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import fold, trimmed

#: Trigrams are hashed to so many buckets; a model has languages x BUCKETS numbers.
BUCKETS = 1 << 15
SMOOTHING = 0.05
UNDETERMINED = "und"

_TABLE = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))
_SPACES = re.compile(rb" +")
#: A model of at most so many bytes goes to the driver and to every task.
MOST_BYTES = 512 << 20


def trigram_counts(text: str) -> np.ndarray | None:
    """Bucket counts of the letters' byte trigrams, words set off by one space; None without a letter."""
    if not any(map(str.isalpha, text)):
        return None
    raw = b" " + _SPACES.sub(b" ", text.lower().encode("utf-8").translate(_TABLE)).strip() + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return np.bincount(code >> np.uint32(17), minlength=BUCKETS)


@dataclass
class Model:
    langs: list[str]
    prob: np.ndarray  # languages x BUCKETS

    def em(self, p: np.ndarray, counts: np.ndarray, theta: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
        total = counts.sum()
        for _ in range(steps):
            joint = theta[:, None] * p
            new = joint @ (counts / joint.sum(0)) / total
            done = np.abs(new - theta).max() < 1e-4
            theta = new
            if done:
                break
        return theta, float(np.log(theta @ p) @ counts)

    def mixture(self, text: str | None, penalty: float = 1.0, steps: int = 25) -> dict[str, float]:
        """Proportions of the chosen languages; empty where there is no letter or no model."""
        counts = trigram_counts(text) if text else None
        if counts is None or not self.langs:
            return {}
        at = np.flatnonzero(counts)
        c = counts[at].astype(float)
        p = self.prob[:, at]
        theta, _ = self.em(p, c, np.full(len(self.langs), 1 / len(self.langs)), steps)
        single = np.log(p) @ c
        first = int(np.argmax(single))
        rest = [i for i in np.argsort(-theta, kind="stable") if i != first]
        # overlapping trigrams are no independent draws: a third of them count
        price = penalty * 0.5 * math.log(c.sum() / 3 + 1)
        best, chosen = float(single[first]) / 3 - price, {first: 1.0}
        for k in range(1, len(rest) + 1):
            some = [first, *rest[:k]]
            start = np.maximum(theta[some], 1e-3)
            mix, like = self.em(p[some], c, start / start.sum(), steps)
            if like / 3 - price * (k + 1) <= best:
                break
            best, chosen = like / 3 - price * (k + 1), dict(zip(some, mix.tolist(), strict=True))
        return {self.langs[i]: v for i, v in sorted(chosen.items(), key=lambda x: (-x[1], x[0]))}


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (counts := trigram_counts(text)) is not None:
                sums[lang] = sums[lang] + counts if lang in sums else counts
    for lang, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], ["lang", "bucket", "n"])


def fit(docs: DataFrame, per_language: int = 2_000, folds: int = 5, held_out: int = 0) -> Model:
    """Fit on about ``per_language`` documents of each lang value, drawn by a hash of doc_id.

    Only rows with text, lang and doc_id whose crc32(doc_id) mod ``folds`` is not
    ``held_out`` are eligible.  The model collected holds languages x BUCKETS counts,
    of MOST_BYTES at most: more values of lang raise an error.
    """
    rows = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold("doc_id", folds) != held_out))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), F.lit(1_000_003)) / 1_000_003
    sums = rows.filter(draw < share).select("lang", "text").mapInArrow(trimmed(_gram_rows), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = sorted(sizes)
    if 8 * BUCKETS * len(langs) > MOST_BYTES:
        raise ValueError(f"{len(langs)} values of lang are more than a model can hold")
    counts = np.zeros((len(langs), BUCKETS))
    table = sums.toArrow()
    if table.num_rows:
        place = {lang: i for i, lang in enumerate(langs)}
        row = np.array([place[x] for x in table.column("lang").to_pylist()])
        counts[row, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    keep = counts.sum(1) > 0
    counts = counts[keep]
    return Model([x for x, k in zip(langs, keep, strict=True) if k], (counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS))


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", penalty: float = 1.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Predict each whole text's language: key, lang_pred, score, languages (map of proportions), and ``carry``.

    ``lang_pred`` is the chosen language with the largest proportion and ``score``
    that proportion.  A null, empty or letterless text, or a model fitted on no
    rows, gives ``und``, score 0 and an empty map.  A letter is what Unicode calls one:
    digits, fractions and numerals are none.  Only the text is looked at, and the whole
    of it, however long; a task holds one text's counts at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            mixes = [m.mixture(t.as_py(), penalty) for t in batch.column(0)]
            first = [next(iter(x.items()), (UNDETERMINED, 0.0)) for x in mixes]
            out = [pa.array([x[0] for x in first], pa.string()), pa.array([min(1.0, x[1]) for x in first], pa.float64()), pa.array([list(x.items()) for x in mixes], pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *out], [*batch.schema.names[1:], "lang_pred", "score", "languages"])

    kept = [docs[text].alias("_text"), docs[key].alias("_key"), *(docs[c].alias(f"_c{i}") for i, c in enumerate(carry))]
    small = docs.select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.schema.fields[1:]) + ", lang_pred string, score double, languages map<string,double>"
    out = small.mapInArrow(trimmed(run), schema).withColumnRenamed("_key", key)
    for i, c in enumerate(carry):
        out = out.withColumnRenamed(f"_c{i}", c)
    return out
