"""Trigram language model by deleted interpolation, trained and applied in packed blocks.

    P1(w)      = a1 c(w) / N            + (1 - a1) / (V + 1)
    P2(w | v)  = a2[b] c(v,w) / c(v)    + (1 - a2[b]) P1(w)        b: bucket of c(v)
    P3(w | uv) = a3[b] c(u,v,w) / c(u,v) + (1 - a3[b]) P2(w | v)   b: bucket of c(u,v)

A bucket is the logarithm of the context's count.  The weights are learned, order
by order, by expectation-maximisation on held-out documents of the training part,
each of which is scored with its own counts deleted.

Documents travel in blocks, which are numbered and written once.  A block sends the
distinct hashes of its words, pairs and triples, sorted and cut into key ranges, with
their counts in its training documents; each range is summed over all blocks, and the
totals go back to the blocks in the same order.  No table of words is ever held in one
place.  The number of ranges follows from the number of tokens, so a range has about
the same bytes at every size; a key has at most one entry for each block.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, fold, materialize, release, trimmed

#: Documents of a block at most, and bytes of text after which a block ends.
BLOCK, BLOCK_BYTES = 2_048, 6 << 20
#: Bits of a key.
BITS = 56
#: Tokens whose messages share a key range: about 10 bytes a token.
RANGE_TOKENS = 1_250_000
#: Context buckets: 0 for an unseen context, then one for each power of two.
BUCKETS = 41
#: Ratios of an estimate to the one it backs off to are told apart in steps of 1/STEPS of a power of two.
STEPS, NEVER = 8, -9999
_START = np.uint64(0x9E3779B97F4A7C15)
_ROW = "block long, part long, keys binary, counts binary"
_BLOCK = "block long, tokens long, learned long, body binary"
_NAMES = ["block", "part", "keys", "counts"]
_KINDS = (pa.int64(), pa.int64(), pa.binary(), pa.binary())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)


END = b" "


def tokenize(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct word, word of each token, tokens of each text); every text ends in one END."""
    import xxhash

    ids, lists = _Ids(), []
    end = ids[END]
    for t in texts:
        words = np.fromiter(map(ids.__getitem__, t.lower().split()), np.uint32)
        lists.append(np.append(words, np.uint32(end)))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in ids), np.uint64, len(ids))
    return hashes, np.concatenate(lists), np.array([len(x) for x in lists], np.int64)


class Tokens:
    """The words, pairs and triples of a block.

    A text starts like after an END, so the start's count is the number of texts.
    Its first word has no triple of its own: there, the pair stands for it.
    Keys of words are odd and the others even, so one sorted list holds them all.
    """

    def __init__(self, hashes: np.ndarray, word: np.ndarray, lens: np.ndarray):
        self.lens, self.word, self.size = lens, word.astype(np.int64), len(hashes)
        self.doc = np.repeat(np.arange(len(lens)), lens)
        self.first = np.cumsum(lens) - lens
        self.context = np.concatenate(([0], self.word[:-1]))
        self.context[self.first] = 0  # END is word 0
        self.pairs, self.pair_at = np.unique(self.context * self.size + self.word, return_inverse=True)
        later = np.ones(len(self.word), bool)
        later[self.first] = False
        self.later = np.flatnonzero(later)  # tokens with a triple
        self.triples, self.triple_at = np.unique(self.pair_at[self.later - 1] * self.size + self.word[self.later], return_inverse=True)
        words = hashes
        v, w = self.pairs // self.size, self.pairs % self.size
        pairs = _mix(_mix(words[v] + _START) ^ words[w])
        before, last = self.triples // max(self.size, 1), self.triples % max(self.size, 1)
        triples = _mix(_mix(pairs[before] + _START) ^ words[last])
        drop = np.uint64(64 - BITS)
        self.keys = np.concatenate([words >> drop | np.uint64(1), *(x >> drop & ~np.uint64(1) for x in (pairs, triples))])
        self.order = np.argsort(self.keys)

    def counts(self, some: np.ndarray) -> np.ndarray:
        """How often each key occurs in the texts marked by ``some``."""
        here = some[self.doc]
        return np.concatenate([np.bincount(self.word[here], minlength=self.size), np.bincount(self.pair_at[here], minlength=len(self.pairs)), np.bincount(self.triple_at[here[self.later]], minlength=len(self.triples))])

    def spread(self, per_key: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each token the counts of its word, of the word before, of their pair, and of the pair before and the triple."""
        words, pairs, triples = np.split(per_key, [self.size, self.size + len(self.pairs)])
        w, v, vw = words[self.word], words[self.context], pairs[self.pair_at]
        uv, uvw = v.copy(), vw.copy()
        uv[self.later] = pairs[self.pair_at[self.later - 1]]
        uvw[self.later] = triples[self.triple_at]
        return w, v, vw, uv, uvw

    def own(self) -> tuple[np.ndarray, ...]:
        """The same counts within each token's own text."""

        def inside(what: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
            _, at, n = np.unique(doc * max(size, 1) + what, return_inverse=True, return_counts=True)
            return n[at]

        w = inside(self.word, self.doc, self.size)
        v = np.concatenate(([1], w[:-1]))
        v[self.first] = 1  # a text has one start
        vw = inside(self.pair_at, self.doc, len(self.pairs))
        uv, uvw = v.copy(), vw.copy()
        uv[self.later] = vw[self.later - 1]
        uvw[self.later] = inside(self.triple_at, self.doc[self.later], len(self.triples))
        return w, v, vw, uv, uvw


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbered blocks; documents for the weights (fold 1) form odd ones of their own."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3)
    n = TaskContext.get().partitionId() << 32
    open_: dict[int, list] = {0: [], 1: []}
    held = [0, 0]

    def close(kind: int) -> pa.RecordBatch:
        nonlocal n
        ids, texts, folds = zip(*open_[kind], strict=True)
        body = squeeze.compress(pickle.dumps((list(ids), list(texts), np.array(folds))))
        open_[kind], held[kind] = [], 0
        n += 2
        lens = np.array([len(t.split()) + 1 for t in texts])
        learned = int(lens[np.array(folds) > 0].sum())
        row = (n + kind, pa.int64()), (int(lens.sum()), pa.int64()), (learned, pa.int64()), (body, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in row], ["block", "tokens", "learned", "body"])

    for batch in batches:
        for key, text, part in zip(*(batch.column(i) for i in range(3)), strict=True):
            part, raw = part.as_py(), (text.as_py() or "").encode()
            kind = int(part == 1)
            open_[kind].append((key.as_py(), raw, -1 if part is None else part))
            held[kind] += len(raw)
            if len(open_[kind]) >= BLOCK or held[kind] >= BLOCK_BYTES:
                yield close(kind)
    for kind, some in open_.items():
        if some:
            yield close(kind)


def _load(body: bytes) -> tuple[list, np.ndarray, Tokens]:
    import zstandard

    ids, texts, folds = pickle.loads(zstandard.ZstdDecompressor().decompress(body))
    return ids, folds, Tokens(*tokenize(texts))


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys: the first, then the steps, in as many bytes as the largest step needs."""
    steps = np.diff(keys)
    width = (int(steps.max(initial=0)).bit_length() + 7) // 8
    return bytes([width]) + keys[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack_keys(data: bytes) -> np.ndarray:
    width, n = data[0], 1
    if width:
        n += (len(data) - 9) // width
    steps = np.zeros((n, 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8, 1)
    steps[1:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(n - 1, width)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def _pack_counts(x: np.ndarray) -> bytes:
    """One byte each; those of 255 or more stand as eight bytes each behind the others."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype(np.int64).tobytes()


def _unpack_counts(data: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(data, np.uint8, n).astype(np.int64)
    x[x == 255] = np.frombuffer(data, np.uint8, offset=n).view(np.int64) if len(data) > n else 255
    return x


def _send(parts: int) -> Callable:
    edges = np.array([(p << BITS) // parts for p in range(1, parts)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                _, folds, t = _load(body.as_py())
                counts, keys = t.counts(folds > 0)[t.order], t.keys[t.order]
                cut = [0, *np.searchsorted(keys, edges), len(keys)]
                yield _batch([(block, p, _pack_keys(keys[a:b]), _pack_counts(counts[a:b])) for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a])

    return run


def _sum_range(table: pa.Table) -> pa.Table:
    """Totals of one key range, sent back to every block in the block's order; block -1: the distinct words."""
    keys = [_unpack_keys(x.as_py()) for x in table.column("keys")]
    counts = np.concatenate([_unpack_counts(x.as_py(), len(k)) for x, k in zip(table.column("counts"), keys, strict=True)])
    flat, part = np.concatenate(keys), table.column("part")[0].as_py()
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    sums = np.add.reduceat(counts[order], np.flatnonzero(first))
    words = int(((ordered[first] & np.uint64(1) == 1) & (sums > 0)).sum())
    back = np.empty(len(flat), np.int64)
    back[order] = sums[np.cumsum(first) - 1]
    ends = np.cumsum([len(k) for k in keys])
    out = [(block, part, len(k).to_bytes(8, "little"), _pack_counts(back[e - len(k) : e])) for block, k, e in zip(table.column("block").to_pylist(), keys, ends, strict=True)]
    return pa.Table.from_batches([_batch([*out, (-1, part, words.to_bytes(8, "little"), b"")])])


def _unpack(table: pa.Table) -> tuple[list, np.ndarray, Tokens, np.ndarray]:
    """(ids, folds, tokens, total of each of the block's keys) from a block's own row (part -1) and its totals."""
    rows = sorted(zip(table.column("part").to_pylist(), range(table.num_rows), strict=True))
    ids, folds, t = _load(table.column("keys")[rows[0][1]].as_py())
    got = [_unpack_counts(table.column("counts")[i].as_py(), int.from_bytes(table.column("keys")[i].as_py(), "little")) for _, i in rows[1:]]
    counts = np.empty(len(t.order), np.int64)
    counts[t.order] = np.concatenate(got)
    return ids, folds, t, counts


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.log2(np.maximum(c, 1)).astype(np.int64) + 1, 0).clip(0, BUCKETS - 1)


def _held(table: pa.Table) -> pa.Table:
    """The held-out tokens of a block: distinct rows of their counts with their own texts deleted, and how often they occur."""
    _, _, t, totals = _unpack(table)
    counts = [a - b for a, b in zip(t.spread(totals), t.own(), strict=True)]
    columns = [*counts, np.repeat(t.lens, t.lens)]
    mixed = np.zeros(len(t.word), np.uint64)
    for c in columns:
        mixed = _mix(mixed + _START ^ c.astype(np.uint64))
    _, at, n = np.unique(mixed, return_index=True, return_counts=True)
    return pa.table([*(pa.array(c[at]) for c in columns), pa.array(n)], names=["w", "v", "vw", "uv", "uvw", "length", "n"])


class Weights:
    """Weights of the orders 1, 2 and 3, by context bucket; order 1 has one context."""

    def __init__(self, total: int, distinct: int):
        self.total, self.distinct, self.by_order = total, distinct, []

    def probability(self, w, v, vw, uv, uvw, total=None) -> np.ndarray:
        """Of each token, by the orders that have weights."""
        total = self.total if total is None else total
        p = np.full(len(w), 1 / (self.distinct + 1))
        for weights, (count, context) in zip(self.by_order, ((w, total), (vw, v), (uvw, uv)), strict=False):
            context = np.broadcast_to(context, count.shape)
            mine = weights[_bucket(context)]
            p = mine * count / np.maximum(context, 1) + (1 - mine) * p
        return p

    def events(self, w, v, vw, uv, uvw, length, n) -> tuple[np.ndarray, ...]:
        """(bucket, ratio, n) of held-out tokens for the next order: its estimate against what it backs off to."""
        total = np.maximum(self.total - length, 0)
        count, context = ((w, total), (vw, v), (uvw, uv))[len(self.by_order)]
        lower = self.probability(w, v, vw, uv, uvw, total)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where((count > 0) & (context > 0), np.round(STEPS * np.log2(count / context / lower)), NEVER).astype(np.int64)
        return _bucket(context), ratio, n


def learn_weights(events: np.ndarray, steps: int = 60) -> np.ndarray:
    """EM for each bucket over rows (bucket, ratio, n); returns each bucket's weight of the specific estimate.

    A bucket without events takes the weight of the one below, or 0.5; an unseen context has weight 0.
    """
    out = np.zeros(BUCKETS)
    last = 0.5
    for b in range(1, BUCKETS):
        e = events[events[:, 0] == b]
        if len(e):
            like = np.where(e[:, 1] > NEVER, 2.0 ** (e[:, 1] / STEPS), 0)
            last = 0.5
            for _ in range(steps):
                mine = last * like / (last * like + 1 - last)
                last = float((mine @ e[:, 2] + 1) / (e[:, 2].sum() + 2))  # one more event of each kind
        out[b] = last
    return out


def _count_events(model: Weights) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, ratio, n = model.events(*(c.to_numpy() for c in batch.columns))
            got, at = np.unique(b * 2 * -NEVER + ratio - NEVER, return_inverse=True)
            sums = np.bincount(at, n, minlength=len(got)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(got // (2 * -NEVER)), pa.array(got % (2 * -NEVER) + NEVER), pa.array(sums)], ["b", "ratio", "n"])

    return run


def _score(model: Weights, key_type: pa.DataType) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        ids, folds, t, totals = _unpack(table)
        counts = t.spread(totals)
        base = np.log10((counts[0] + 0.1) / (model.total + 0.1 * (model.distinct + 1)))
        sums = lambda x: np.add.reduceat(x, t.first)
        columns = [pa.array(ids, key_type), pa.array(folds == 0), pa.array(t.lens), pa.array(sums((counts[0] > 0).astype(np.int64))), pa.array(np.full(len(ids), model.total)), pa.array(sums(base)), pa.array(sums(np.log10(model.probability(*counts))))]
        return pa.table(columns, names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    """Train on the documents whose crc32(key) mod ``folds`` is not 0 and score all of them.

    Of the training documents, those with remainder 1 also serve to learn the
    mixture weights, each with its own counts deleted.  A null text counts as
    empty: one end token.  A row with a null key is scored but not learned from,
    and is not held out.  Repeated rows count as often as they stand.  Without
    training rows, score and base_score are 0.  Words, pairs and triples are told
    apart by hashes of BITS bits.  A text longer than BLOCK_BYTES ends its block, so a
    task holds one such text at a time.  ``docs`` is read once, so its rows may come
    in any order.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), fold(docs[key], folds).alias("fold"))
    key_type = to_arrow_type(docs.schema[key].dataType)
    blocks = materialize(rows.mapInArrow(trimmed(_pack), _BLOCK), "lm-blocks")
    tokens, total = (x or 0 for x in blocks.agg(F.sum("tokens"), F.sum("learned")).first())
    parts = max(1, -(-tokens // RANGE_TOKENS))

    totals = materialize(blocks.mapInArrow(trimmed(_send(parts), 1), _ROW).groupBy("part").applyInArrow(_sum_range, _ROW), "lm-totals")
    release(docs.sparkSession)  # the messages are the largest shuffle by far
    distinct = sum(int.from_bytes(x, "little") for x in totals.filter("block = -1").select("keys").toArrow().column(0).to_pylist())
    own = blocks.select("block", F.lit(-1).cast("long").alias("part"), F.col("body").alias("keys"), F.lit(b"").alias("counts"))
    whole = own.unionByName(totals.filter("block >= 0"))

    counts = ("w", "v", "vw", "uv", "uvw", "length", "n")
    held = materialize(whole.filter("block % 2 = 1").groupBy("block").applyInArrow(_held, ", ".join(f"{c} long" for c in counts)), "lm-held")
    model = Weights(total, distinct)
    for _ in range(3):
        events = held.mapInArrow(trimmed(_count_events(model), 100_000), "b long, ratio long, n long").groupBy("b", "ratio").agg(F.sum("n").alias("n")).toArrow()
        model.by_order.append(learn_weights(np.stack([events.column(c).to_numpy() for c in ("b", "ratio", "n")], axis=1)) if total else np.zeros(BUCKETS))
    discard(held)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return whole.groupBy("block").applyInArrow(_score(model, key_type), schema).withColumnRenamed("key", key)
