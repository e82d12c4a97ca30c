"""Near-duplicate groups: banded MinHash candidates, sequential Bayesian pruning, exact verification.

Equal shingle sets are one class from the start.  Class representatives are
banded; in each bucket the others are compared with the smallest member first,
and only members that are still in different groups are then compared with each
other, in blocks.  A candidate pair is compared in batches of its signatures and
dropped once the posterior probability of reaching the threshold falls below the
chosen miss probability; what is left is verified on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import discard, fits, lookup_join, materialize, trimmed

WORDS = 5
PERCENT = 75
#: 128 hashes in 32 bands of 4: a pair at similarity 0.75 shares no band with probability 5e-6.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Hashes compared at a time, and the probability at which a pair may be given up wrongly.
BATCH, MISS = 16, 1e-6
#: The first hashes, one byte of each, are compared inside a bucket.
FIRST = 64
#: Bucket members that a part of a block holds: of first bytes, and of full sets.
WIDE, BLOCK = 4_000, 800
#: Bytes of full sets that a part of a block holds on average; a single larger set is a part.
SET_BYTES = 16 << 20
#: Sizes of a pair that can be linked differ by less than this factor.
CLASS = 1.34
#: Lists of bare ids of at most so many rows are broadcast.
ID_ROWS = 500_000
#: Words whose hashes a worker remembers before it starts afresh.
MEMO = 120_000
#: Parts that the partners of one document are dealt to when sets are compared.
SALT = 256

_MUL = np.random.default_rng(20240101).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(20240102).integers(0, 1 << 63, HASHES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of the runs of five words; the whole sequence where there are fewer."""

    def __init__(self):
        import xxhash

        self.digest = xxhash.xxh3_64_intdigest
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8").lower().split()
        if len(words) < WORDS:
            return np.array([self.digest(b" ".join(words), 1)], np.uint64) if words else np.zeros(0, np.uint64)
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, digest = self.memo, self.digest
        for w in words:
            if w not in memo:
                memo[w] = digest(w)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        n = len(h) - WORDS + 1
        out = h[:n]
        for i in range(1, WORDS):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        return np.unique(_mix(out))


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minimum hashes, 32 bits each."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        low = np.minimum(low, (shingles[at : at + 1024, None] * _MUL + _ADD).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """Rows x BANDS keys of rows x HASHES signatures."""
    x = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), x.shape[:2])
    for i in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + x[:, :, i])
    return key.view(np.int64)


@cache
def least_matches(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Fewest of n matching hashes at which similarity >= percent is at least ``miss`` likely, by a uniform prior."""
    s = (np.arange(20_000) + 0.5) / 20_000
    for m in range(n + 1):
        log = m * np.log(s) + (n - m) * np.log1p(-s)
        p = np.exp(log - log.max())
        if p[s >= percent / 100].sum() / p.sum() >= miss:
            return m
    return n


def survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indexes of the pairs of signature rows that no batch rules out."""
    alive, hits = np.arange(len(a)), np.zeros(len(a), np.int64)
    for end in range(BATCH, a.shape[1] + 1, BATCH):
        hits = hits + (a[alive, end - BATCH : end] == b[alive, end - BATCH : end]).sum(axis=1)
        keep = hits >= least_matches(end)
        alive, hits = alive[keep], hits[keep]
    return alive


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    shingle = Shingler()
    for batch in batches:
        n, ids, sigs = [], [], []
        for text in batch.column(1):
            s = shingle(text.as_py())
            n.append(len(s))
            ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sigs.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_id", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingle = Shingler()
    for batch in batches:
        sets = [shingle(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([signature(s).tobytes() for s in sets], pa.binary())], ["id", "set", "sig"])


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_matrix(batch.column(1), np.uint32, HASHES))
            ids, sizes = (np.repeat(batch.column(c).to_numpy(), BANDS) for c in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids), pa.array(sizes)], ["bucket", "doc_id", "n_shingles"])


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keep = survivors(_matrix(batch.column(2), np.uint32, HASHES), _matrix(batch.column(3), np.uint32, HASHES))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], ["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, salt, b); the row without b brings a's set."""
    at, own = None, None
    for batch in batches:
        a, b = [], []
        for x, y, z, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if z is None:
                at, own = (x, y), np.frombuffer(s, np.uint64)
                continue
            if at != (x, y):
                raise RuntimeError(f"the shingles of document {x} are missing")
            other = np.frombuffer(s, np.uint64)
            both = np.isin(other, own, assume_unique=True).sum() if len(other) < 50 else len(np.intersect1d(own, other, assume_unique=True))
            if 100 * both >= PERCENT * (len(own) + len(other) - both):
                a.append(x)
                b.append(z)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with the same (bucket, class, i, j), which the rows come sorted by."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:4] != key:
                if len(rows) > 1:
                    yield key, rows
                key, rows = row[:4], []
            rows.append(row)
    if len(rows) > 1:
        yield key, rows


class _Block:
    """Members of a block; each pair of different groups is met once, those of one part of two in their own block."""

    def __init__(self, key: tuple, rows: list[tuple]):
        self.parts = None if key[2] == key[3] else np.array([r[4] for r in rows])
        self.first = key[2]
        self.ids, self.group, self.n = (np.array([r[k] for r in rows], np.int64) for k in (5, 6, 7))

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """(member, later or opposite members that their groups and sizes leave)."""
        for k in range(len(self.ids)):
            if self.parts is None:
                others = np.arange(k + 1, len(self.ids))
            elif self.parts[k] == self.first:
                others = np.flatnonzero(self.parts != self.first)
            else:
                continue
            small, large = np.minimum(self.n[k], self.n[others]), np.maximum(self.n[k], self.n[others])
            others = others[(self.group[others] != self.group[k]) & (100 * small >= PERCENT * large)]
            if len(others):
                yield k, others


def _open_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a block that have a partner in another group which their first hashes do not rule out."""
    least, names = least_matches(FIRST), ["bucket", "doc_id", "component", "n_shingles"]
    for key, rows in _blocks(batches):
        block, found = _Block(key, rows), np.zeros(len(rows), bool)
        first = np.frombuffer(b"".join(r[8] for r in rows), np.uint8).reshape(-1, FIRST)
        for k, others in block.pairs():
            if found[k] and found[others].all():
                continue
            near = others[(first[others] == first[k]).sum(axis=1) >= least]
            found[near] = True
            found[k] |= len(near) > 0
        kept = [(r[0], *r[5:8]) for r, f in zip(rows, found, strict=True) if f]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept, strict=True)], names)


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links that join groups of a block: no more than it has members.

    Members come with signature and set.  A pair is compared in the first band that
    it shares, batch by batch, and confirmed on the full sets unless its groups have
    been joined in this block before.
    """
    for key, rows in _blocks(batches):
        block = _Block(key, rows)
        sig = np.frombuffer(b"".join(r[8] for r in rows), np.uint32).reshape(-1, HASHES)
        sets = [np.frombuffer(r[9], np.uint64) for r in rows]
        band = int(np.flatnonzero(band_keys(sig[:1])[0] == key[0])[0])
        root = {int(g): int(g) for g in block.group}

        def find(g: int) -> int:
            while root[g] != g:
                root[g] = root[root[g]]
                g = root[g]
            return g

        links = []
        for k, others in block.pairs():
            mine = find(int(block.group[k]))
            others = others[[find(int(g)) != mine for g in block.group[others]]]
            if not len(others):
                continue
            same = (sig[others] == sig[k]).reshape(-1, BANDS, ROWS).all(axis=2)
            others = others[same.argmax(axis=1) == band]
            others = others[survivors(np.broadcast_to(sig[k], (len(others), HASHES)), sig[others])]
            if not len(others):
                continue
            flat = np.concatenate([sets[o] for o in others])
            place = np.searchsorted(sets[k], flat).clip(max=len(sets[k]) - 1)
            size = block.n[others]
            both = np.add.reduceat(sets[k][place] == flat, np.cumsum(size) - size, dtype=np.int64)
            for o in others[100 * both >= PERCENT * (block.n[k] + size - both)]:
                x, y = find(int(block.group[k])), find(int(block.group[o]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    links.append((int(block.ids[k]), int(block.ids[o])))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])


def _needed(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def _few(ids: DataFrame) -> DataFrame:
    """Written ids, marked for broadcast where there are few."""
    return F.broadcast(ids) if fits(ids, ID_ROWS) else ids


def sets_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, set, sig) of some documents, shingled again: sets of all documents are never kept."""
    some = texts.join(_few(ids), texts["doc_id"] == ids["id"]).select("doc_id", "text")
    return materialize(some.mapInArrow(trimmed(_sets), "id long, set binary, sig binary").dropDuplicates(["id"]), "dup-sets")


def verify(pairs: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold: pruned on signatures, confirmed on full sets."""
    ids = materialize(_needed(pairs), "dup-ids")
    some = materialize(reps.select(F.col("doc_id").alias("id"), "sig").join(_few(ids), "id"), "dup-sigs")
    left, right = some.select(F.col("id").alias("a"), F.col("sig").alias("x")), some.select(F.col("id").alias("b"), F.col("sig").alias("y"))
    close = materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_prune, "a long, b long"), "dup-close")
    ids = materialize(_needed(close), "dup-close-ids")
    sets = sets_of(ids, texts)
    salted = close.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALT)).cast("int"))
    sets = sets.select("id", "set")
    partners = salted.join(sets.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "set")
    own = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "set")
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = partners.unionByName(own).repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return materialize(dealt.mapInArrow(trimmed(_confirm), "a long, b long"), "dup-links")


def components(links: DataFrame) -> DataFrame:
    """(id, component): each linked id with the smallest id reachable, by alternating large and small stars."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "cc-least")
        total = least.agg(F.sum("n")).first()[0] or 0
        rows = lookup_join(both, least, "a", "n", total)
        if large:
            m = F.least("m", "a")
            out = rows.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), m.alias("b"))
        else:
            out = rows.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return materialize(out.filter("a <> b").distinct(), "cc-edges")

    # a is the larger end
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "cc-edges")
    stamp = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = stamp(edges)
    while now[0]:
        edges = star(star(edges, True), False)
        before, now = now, stamp(edges)
        if now == before:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def group_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Near-duplicate groups over whole texts: doc_id, n_shingles, component_id, kept.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a
    document's set are its distinct runs of five words, or the whole sequence where
    it has fewer.  Documents are linked at a Jaccard similarity of 0.75 or more.
    ``component_id`` is the smallest id reachable and ``kept`` marks it.  Null,
    empty and wordless texts have no shingles and stay alone.  Rows with equal
    texts are linked even if their id repeats; rows with a null id are counted
    but linked with nothing: component_id is null and they are kept.
    Shingles are told apart by 64-bit hashes.  Whole texts are shingled, however
    long: a task holds one text's shingles, or SET_BYTES of sets, at a time.
    """
    spark = docs.sparkSession
    texts = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    signed = materialize(texts.mapInArrow(trimmed(_sign), "doc_id long, n_shingles long, set_id binary, sig binary"), "dup-signed")
    full = signed.filter("doc_id is not null and n_shingles > 0")
    classes = materialize(full.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1"), "dup-classes")
    copies = classes.agg(F.sum("n")).first()[0] or 0

    marked = lookup_join(signed, classes, "set_id", "n", copies).withColumn("alone", F.col("rep").isNull()).withColumn("rep", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    reps = marked.filter("rep = doc_id")
    reps = materialize(reps.filter("alone").unionByName(reps.filter("not alone").dropDuplicates(["doc_id"])).select("doc_id", "n_shingles", "sig"), "dup-reps")

    bands = reps.select("doc_id", "sig", "n_shingles").mapInArrow(trimmed(_band), "bucket long, doc_id long, n_shingles long")
    buckets = materialize(bands.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).filter("n > 1"), "dup-buckets")
    members = buckets.agg(F.sum("n")).first()[0] or 0
    banded = materialize(lookup_join(bands, buckets, "bucket", "n", members).filter("hub is not null"), "dup-banded")
    stars = materialize(banded.filter("hub <> doc_id").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), "dup-stars")
    links = verify(stars, reps, texts)
    discard(stars)

    # buckets whose members are not in one group yet, without those whose only pair was compared
    groups = components(links)
    now = lookup_groups(banded, groups)
    discard(links, banded, buckets)
    split = now.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m")).filter("low <> high and m > 2").select("bucket", "m")
    split = materialize(split, "dup-split")
    total = split.agg(F.sum("m")).first()[0] or 0
    if total:
        open_ = lookup_join(now, split.withColumn("n", F.col("m")), "bucket", "n", total).filter("m is not null").drop("m")
        count = int(spark.conf.get("spark.sql.shuffle.partitions"))
        place = ("bucket", "class", "i", "j")
        deal = lambda d: d.repartition(count, *place).sortWithinPartitions(*place)
        member = (*place, "part", "doc_id", "component", "n_shingles")
        first = reps.select("doc_id", first_bytes("sig").alias("first"))
        rows = in_blocks(open_, WIDE).join(first, "doc_id").select(*member, "first")
        near = deal(rows).mapInArrow(trimmed(_open_members, 5_000), "bucket long, doc_id long, component long, n_shingles long")
        near = materialize(near.distinct(), "dup-near")
        ids = materialize(near.select(F.col("doc_id").alias("id")).distinct(), "dup-near-ids")
        sets = sets_of(ids, texts)
        loaded = in_blocks(near, BLOCK).join(sets.withColumnRenamed("id", "doc_id"), "doc_id").select(*member, "sig", "set")
        more = materialize(deal(loaded).mapInArrow(trimmed(_block_links), "a long, b long"), "dup-more")
        discard(near, ids, sets)
        links = materialize(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), "dup-all-links")
        groups = components(links)
        discard(more, links)
    discard(now, split)

    sized = groups.join(classes.select(F.col("rep").alias("id"), "n"), "id", "left")
    sized = materialize(sized.groupBy(F.col("id").alias("rep")).agg(F.max("component").alias("component"), F.coalesce(F.max("n"), F.lit(1)).cast("long").alias("n")), "dup-groups")
    rows = sized.agg(F.sum("n")).first()[0] or 0
    out = lookup_join(marked.select("doc_id", "n_shingles", "rep"), sized, "rep", "n", rows)
    component = F.coalesce("component", "rep", "doc_id")
    return out.select(F.col("doc_id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def lookup_groups(banded: DataFrame, groups: DataFrame) -> DataFrame:
    """(bucket, doc_id, n_shingles, component) of the banded members; unlinked ones are their own group."""
    table = F.broadcast(groups) if fits(groups, ID_ROWS) else groups
    out = banded.select("bucket", "doc_id", "n_shingles").join(table.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return materialize(out.withColumn("component", F.coalesce("component", "doc_id")), "dup-now")


def in_blocks(members: DataFrame, block: int) -> DataFrame:
    """Members of open buckets dealt to blocks (bucket, class, i, j) in which each pair of like size meets once.

    A bucket that fits a block is one class.  In larger ones, members are told apart by
    classes of size: a pair that can be linked is of one class or of two neighbours.  A class of a bucket is cut into parts of about
    ``block`` members and SET_BYTES of sets.  In block (i, j) of class c, part i of c
    meets part j; the parts of class c + 1 are numbered behind those of c.
    """
    held = F.sum(8 * F.col("n_shingles"))
    large = members.groupBy("bucket").agg(F.count("*").alias("m"), held.alias("held")).filter((F.col("m") > block) | (F.col("held") > SET_BYTES)).select("bucket", F.lit(True).alias("large"))
    size = F.floor(F.log(F.col("n_shingles")) / F.log(F.lit(CLASS))).cast("int")
    members = members.join(large, "bucket", "left").withColumn("class", F.when(F.col("large"), size).otherwise(-1)).drop("large")
    sums = members.groupBy("bucket", "class").agg(F.count("*").alias("m"), held.alias("held"))
    parts = F.greatest(F.ceil(F.col("m") / block), F.least(F.col("m"), F.ceil(F.col("held") / SET_BYTES))).cast("int")
    order = Window.partitionBy("bucket").orderBy("class")
    beside = lambda f, step: F.coalesce(F.when(f("class").over(order) == F.col("class") + step, f("parts").over(order)), F.lit(0))
    cells = sums.withColumn("parts", parts).withColumn("lower", beside(F.lag, -1)).withColumn("upper", beside(F.lead, 1))
    # a member that would stand alone meets nobody
    cells = cells.filter("m > 1 or lower > 0 or upper > 0").drop("m", "held")
    some = members.join(cells, ["bucket", "class"])
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.col("parts")).cast("int")
    # in its own class a member meets the parts of both; in the class below, the parts of that class
    own = F.transform(F.sequence(F.lit(0), F.col("parts") + F.col("upper") - 1), lambda k: F.struct(F.col("class").alias("class"), F.least("_part", k).alias("i"), F.greatest("_part", k).alias("j"), F.col("_part").alias("part")))
    at = F.col("lower") + F.col("_part")
    below = F.transform(F.sequence(F.lit(0), F.col("lower") - 1), lambda k: F.struct((F.col("class") - 1).alias("class"), k.alias("i"), at.alias("j"), at.alias("part")))
    below = F.when(F.col("lower") > 0, below).otherwise(F.array().cast("array<struct<class:int,i:int,j:int,part:int>>"))
    return some.withColumn("_part", part).withColumn("_at", F.explode(F.concat(own, below))).select("bucket", "_at.class", "_at.i", "_at.j", "_at.part", "doc_id", "component", "n_shingles")


def first_bytes(sig):
    """The lowest byte of each of the FIRST first hashes."""
    return F.unhex(F.regexp_replace(F.substring(F.hex(sig), 1, 8 * FIRST), "(..)......", "$1"))
