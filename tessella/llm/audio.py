"""Chroma fingerprints of media columns, and their alignment.

Samples become frames of twelve pitch-class energies.  Sixteen rectangle filters
over the integral image of the frames, two Gray-coded bits each, give one packed
32-bit integer for every window of frames.  For each query and recording, a histogram
over all offsets counts the agreeing bits of sampled words; offsets that stand out are
compared in full, and a match is told by the share of differing bits over the overlap.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import fits, lookup_join, materialize, trimmed

#: Samples a second, of a frame, and between frames.
RATE, FRAME, HOP = 4_000, 1_024, 512
#: Frames that one integer looks at.
SPAN = 16
#: Hertz that count as pitch.
LOW, HIGH = 200.0, 950.0
#: Filters: (kind, first pitch class, pitch classes, frames), by rule.
FILTERS = [(k % 6, (5 * k) % 12, 3 + k % 4 * 3, (4, 8, 12, 16)[k * 7 // 4 % 4]) for k in range(16)]
#: Log ratios at which the two bits of a filter change.
CUTS = (-0.25, 0.0, 0.25)
#: A match: at most this share of differing bits over at least so many integers.
MOST_ERRORS, LEAST_OVERLAP = 0.15, 16
#: Every so many words, two count for the offset histogram; an offset is given up beyond so many standard deviations.
SAMPLE_EVERY, SAMPLE_Z = 8, 4.0
#: Lists of bare ids of at most so many rows are broadcast.
ID_ROWS = 500_000
#: Words of queries that go to all tasks at once, 4 bytes each.
ROUND_WORDS = 2_000_000
#: Columns of matches.
MATCH = "q long, r long, offset int, overlap int, errors double"


def _pitch_weights() -> np.ndarray:
    """Spectrum bins x 12: each bin in range counts for its nearest pitch class."""
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    used = (hertz >= LOW) & (hertz <= HIGH)
    pitch = np.round(12 * np.log2(np.maximum(hertz, 1) / 440.0)).astype(int) % 12
    out = np.zeros((len(hertz), 12), np.float32)
    out[np.flatnonzero(used), pitch[used]] = 1
    return out


_WEIGHTS = _pitch_weights()
_BINS = np.flatnonzero(_WEIGHTS.any(axis=1))
_WINDOW = np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames x 12 of one recording, each frame of unit length or zero."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[:: HOP][:n]
    spectrum = np.abs(np.fft.rfft(frames * _WINDOW, axis=1)[:, _BINS]).astype(np.float32) ** 2
    energy = spectrum @ _WEIGHTS[_BINS]
    norm = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.where(norm > 1e-3, energy / np.maximum(norm, 1e-9), 0).astype(np.float32)


def fingerprint_frames(frames: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer for each window of SPAN frames; none for shorter recordings."""
    n = len(frames) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    wide = np.concatenate([frames, frames], axis=1)  # pitch classes wrap around
    total = np.zeros((len(frames) + 1, 25))
    total[1:, 1:] = wide.cumsum(axis=0).cumsum(axis=1)

    def box(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return total[t1 : t1 + n, p1] - total[t0 : t0 + n, p1] - total[t1 : t1 + n, p0] + total[t0 : t0 + n, p0]

    out = np.zeros(n, np.uint32)
    for kind, p, height, width in FILTERS:
        q, mid_p, mid_t = p + height, p + height // 2, width // 2
        third_p, third_t = max(1, height // 3), max(1, width // 3)
        everything = box(0, width, p, q)
        if kind == 0:  # these pitch classes against all
            a, b = everything / height, box(0, width, 0, 12) / 12
        elif kind == 1:  # upper against lower
            a, b = box(0, width, mid_p, q), box(0, width, p, mid_p)
        elif kind == 2:  # later against earlier
            a, b = box(mid_t, width, p, q), box(0, mid_t, p, q)
        elif kind == 3:  # crosswise
            a = box(mid_t, width, mid_p, q) + box(0, mid_t, p, mid_p)
            b = everything - a
        elif kind == 4:  # the middle of the time against its ends
            a = 2 * box(third_t, width - third_t, p, q)
            b = everything - a / 2
        else:  # the middle of the pitch against its ends
            a = 2 * box(0, width, p + third_p, q - third_p) if height > 2 * third_p else everything
            b = everything - a / 2
        ratio = np.log((np.maximum(a, 0) + 0.05) / (np.maximum(b, 0) + 0.05))
        level = np.searchsorted(CUTS, ratio, side="right").astype(np.uint32)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1))
    return out


def wav_samples(data: bytes | None) -> np.ndarray:
    """Samples of mono 16-bit PCM in a RIFF container; nothing for other or broken data."""
    if not data or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return np.zeros(0, np.int16)
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"data":
            body = data[at + 8 : at + 8 + size]
            return np.frombuffer(body[: len(body) // 2 * 2], "<i2")
        at += 8 + size + size % 2
    return np.zeros(0, np.int16)


def melody_samples(values: list[float] | None, notes: int = 24, length: int = 512) -> np.ndarray:
    """A recording of one note for each number of a vector: its size picks the pitch, in semitones from 220 Hz."""
    if values is None or not len(values):
        return np.zeros(0, np.int16)
    v = np.nan_to_num(np.asarray([0.0 if x is None else x for x in values], float))
    spread = np.sqrt(np.mean(v * v)) or 1.0
    pitch = np.floor((np.clip(v / spread, -2.4, 2.399) + 2.4) / 4.8 * notes).astype(int)
    wave = np.sin(2 * np.pi * 220.0 * 2.0 ** (np.arange(notes)[:, None] / 12) * np.arange(length) / RATE)
    return (wave[pitch].ravel() * 12_000).astype(np.int16)


def fingerprint(df: DataFrame, key: str, media: str, decode: Callable = wav_samples) -> DataFrame:
    """key, fingerprint (array of int) of every row's media value; ``decode`` gives its samples.

    Null, empty, too short and undecodable media have the empty fingerprint.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint_frames(chroma(decode(v.as_py()))).view(np.int32) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.list_(pa.int32()))], ["key", "fingerprint"])

    return df.select(df[key].cast("long").alias("key"), df[media].alias("media")).mapInArrow(trimmed(run), "key long, fingerprint array<int>").withColumnRenamed("key", key)


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """(overlap, share of differing bits) of a[i + offset] against b[i]."""
    start, end = max(0, -offset), min(len(b), len(a) - offset)
    if end <= start:
        return 0, 1.0
    x = a[start + offset : end + offset].view(np.uint32) ^ b[start:end].view(np.uint32)
    return end - start, int(np.bitwise_count(x).sum()) / (32 * (end - start))


def _lay_out(prints: list[np.ndarray], n: int) -> dict[str, np.ndarray]:
    """Recordings end to end, so far apart that a query of ``n`` words overlaps one of them by LEAST_OVERLAP at most places only.

    words and pairs (of neighbouring words, for the histogram) by place; for each place a query may
    start at: the recording, the offset, and the query's first and last word over it.
    """
    gap = n - LEAST_OVERLAP
    sizes = np.array([len(p) for p in prints])
    starts = gap + np.concatenate([[0], np.cumsum(sizes + gap)[:-1]])
    words = np.zeros(starts[-1] + sizes[-1] + gap, np.uint32)
    for at, p in zip(starts, prints, strict=True):
        words[at : at + len(p)] = p
    places = sizes + n - 2 * LEAST_OVERLAP + 1
    which = np.repeat(np.arange(len(prints)), places)
    at = np.arange(len(which)) - np.repeat(np.cumsum(places) - places, places) + starts[which] - gap
    offset = starts[which] - at
    first, last = np.maximum(offset, 0), np.minimum(offset + sizes[which], n)
    pairs = words[:-1] | words[1:].astype(np.uint64) << np.uint64(32)
    # places are told apart by the words they overlap, as few kinds; kind 0 overlaps too little
    spans, inverse = np.unique(first * (n + 1) + last, return_inverse=True)
    kind = np.zeros(len(words) - n + 1, np.uint16 if len(spans) < 65_535 else np.uint32)
    kind[at] = inverse + 1
    most = np.floor(32 * (last - first) * MOST_ERRORS + 1e-6).astype(np.int64)
    return {"words": words, "pairs": pairs, "which": which, "at": at, "offset": offset, "first": first, "last": last, "most": most, "kind": kind, "spans": spans}


def _offset_histogram(query: np.ndarray, pairs: np.ndarray, places: int, sampled: np.ndarray) -> np.ndarray:
    """For each place the query may start at: how many bits of its sampled pairs of words differ from what lies there."""
    total = np.zeros(places, np.uint16 if len(sampled) < 1_000 else np.uint32)
    some, both, bits = np.zeros(places, np.uint8), np.empty(places, np.uint64), np.empty(places, np.uint8)
    for at, k in enumerate(sampled):
        two = query[k] | query[k + 1].astype(np.uint64) << np.uint64(32)
        np.bitwise_count(np.bitwise_xor(pairs[k : k + places], two, out=both), out=bits)
        some += bits
        if at % 3 == 2:  # 3 * 64 bits fit a byte
            total += some
            some[:] = 0
    total += some
    return total


def _best(query: np.ndarray, d: dict[str, np.ndarray]) -> Iterator[tuple[int, int, int, float]]:
    """(recording, offset, overlap, errors) of the best offset of each matching recording.

    The histogram of differing bits over all offsets is taken from two words in every
    SAMPLE_EVERY; offsets are compared in full unless their sample differs by more than
    SAMPLE_Z standard deviations above MOST_ERRORS.
    """
    n = len(query)
    sampled = np.arange(0, n - 1, SAMPLE_EVERY)
    used = np.zeros(n, bool)
    used[sampled] = used[sampled + 1] = True
    own = np.bitwise_count(query).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(np.where(used, own, 0))])
    seen = np.concatenate([[0], np.cumsum(used)])
    begin, end = d["spans"] // (n + 1), d["spans"] % (n + 1)
    bits = 32.0 * (seen[end] - seen[begin])
    # words over a gap differ in the query's own bits
    limit = np.floor(bits * MOST_ERRORS + SAMPLE_Z * np.sqrt(bits * MOST_ERRORS * (1 - MOST_ERRORS))) + before[begin] + before[n] - before[end]
    limit = np.concatenate([[-1], limit]).astype(np.int32)
    differ = _offset_histogram(query, d["pairs"], len(d["kind"]), sampled)
    some = np.flatnonzero(differ <= limit.max(initial=-1))  # few, before each meets its own limit
    some = np.searchsorted(d["at"], some[differ[some] <= limit[d["kind"][some]]])
    first, last = d["first"], d["last"]
    errors = np.empty(len(some), np.int64)
    for a in range(0, len(some), 4_096):
        at = some[a : a + 4_096]
        x = np.bitwise_count(d["words"][d["at"][at][:, None] + np.arange(n)] ^ query)
        inside = (np.arange(n) >= first[at][:, None]) & (np.arange(n) < last[at][:, None])
        errors[a : a + len(at)] = np.where(inside, x, 0).sum(axis=1)
    near = errors <= d["most"][some]
    some, errors = some[near], errors[near]
    if len(some):
        overlap = last[some] - first[some]
        share, r, offset = errors / (32 * overlap), d["which"][some], d["offset"][some]
        order = np.lexsort((offset, -overlap, share, r))
        for i in order[np.concatenate([[True], r[order][1:] != r[order][:-1]])]:
            if share[i] <= MOST_ERRORS:
                yield int(r[i]), int(offset[i]), int(overlap[i]), float(share[i])


def best_offsets(queries: list[np.ndarray], prints: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, float]]:
    """(query, recording, offset, overlap, errors) of each pair that matches at any offset.

    The best one of a pair: fewest errors, then most overlap, then least offset.
    """
    kept = [k for k, p in enumerate(prints) if len(p) >= LEAST_OVERLAP]
    by_size: dict[int, list[int]] = {}
    for k, q in enumerate(queries):
        by_size.setdefault(len(q), []).append(k)
    for n, members in by_size.items():
        if n < LEAST_OVERLAP or not kept:
            continue
        d = _lay_out([prints[k] for k in kept], n)
        for k in members:
            for r, *rest in _best(queries[k], d):
                yield k, kept[r], *rest


def _compare(prints: DataFrame, ids: list[int], queries: list[np.ndarray], itself: bool) -> DataFrame:
    """Matches of some queries, which every task gets, in one pass over ``prints``."""
    shared = prints.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, words = shared.value
        for batch in batches:
            names = batch.column(0).to_pylist()
            listed = batch.column(1)
            ends, flat = listed.offsets.to_numpy(), listed.values.to_numpy(zero_copy_only=False).view(np.uint32)
            recordings = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            out = [(asked[q], names[r], *rest) for q, r, *rest in best_offsets(words, recordings) if itself or asked[q] != names[r]]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds, strict=True)], ["q", "r", "offset", "overlap", "errors"])

    out = materialize(prints.mapInArrow(trimmed(run), MATCH), "audio-matches")
    shared.unpersist()
    return out


def align(prints: DataFrame, asked: DataFrame, itself: bool = False) -> DataFrame:
    """Matches (q, r, offset, overlap, errors) of the recordings ``asked`` among ``prints``, both (id, fingerprint).

    Both are written tables with unique ids.  Every query meets every recording at
    every offset in a histogram of sampled bits: bits that differ may lie in all words,
    so no shared integer can be asked for.  If bits err independently, a match at the
    limit of MOST_ERRORS is given up there with probability 3e-5.  The best match of a pair is returned (fewest errors,
    then most overlap, then least offset).  Queries go out in rounds of ROUND_WORDS,
    each one pass over the recordings, so neither side has to fit a machine.
    ``itself`` keeps matches of equal ids, for queries that were altered.
    """
    spark = prints.sparkSession
    rows, least = prints.count(), spark.sparkContext.defaultParallelism
    dealt: DataFrame | None = None
    found: list[DataFrame] = []
    ids: list[int] = []
    queries: list[np.ndarray] = []

    def send() -> None:
        nonlocal dealt
        if dealt is None:
            dealt = materialize(prints.select("id", "fingerprint").repartition(max(3 * least, min(2_000, rows // 1_000))), "audio-dealt")
        found.append(_compare(dealt, list(ids), list(queries), itself))
        ids.clear()
        queries.clear()

    held = 0
    for row in asked.select("id", "fingerprint").toLocalIterator():
        ids.append(row[0])
        queries.append(np.array(row[1] or [], np.int32).view(np.uint32))
        held += len(queries[-1])
        if held >= ROUND_WORDS:
            send()
            held = 0
    if ids:
        send()
    return functools.reduce(DataFrame.union, found) if found else spark.createDataFrame([], MATCH)


def excerpt(samples: np.ndarray, start: int = 10 * HOP, noise: float = 0.05) -> np.ndarray:
    """The recording from ``start`` on, with fixed noise: what a query of a known recording sounds like."""
    rest = samples[start:].astype(float)
    loud = np.sqrt(np.mean(rest * rest)) if len(rest) else 0.0
    return rest + noise * loud * np.random.default_rng(1).standard_normal(len(rest))


def match_recordings(df: DataFrame, key: str, media: str, decode: Callable = wav_samples, every: int = 20, alter: Callable | None = None) -> DataFrame:
    """Fingerprint all rows and align those whose id is divisible by ``every`` with all others.

    One row for each row of ``df``: key, n_words, class_id (smallest id with an equal
    fingerprint), asked (its class holds a query), n_matches (classes that match it,
    without itself), and the best match: match_id (a class id), offset, overlap, errors.
    With ``alter``, queries are altered samples, and may match their own class.
    Equal fingerprints are compared once, as a class.  Rows without a fingerprint
    match nothing and are classes of their own; null ids have a null class unless an
    equal fingerprint has an id.
    """
    prints = fingerprint(df, key, media, decode).withColumnRenamed(key, "id")
    prints = materialize(prints.withColumn("print_id", F.when(F.size("fingerprint") > 0, F.sha2(F.array_join(F.col("fingerprint").cast("array<string>"), ","), 256))), "audio-prints")
    asks = F.max(F.coalesce(F.col("id") % every == 0, F.lit(False)))
    whole = prints.filter("print_id is not null").groupBy("print_id").agg(F.min("id").alias("class_id"), asks.alias("asked"), F.count("*").alias("n"))
    classes = materialize(whole, "audio-classes")
    named = classes.filter("class_id is not null").select(F.col("class_id").alias("id"), "asked")
    reps = materialize(prints.filter("print_id is not null").join(named, "id").dropDuplicates(["id"]).select("id", "asked", "fingerprint"), "audio-reps")
    asked = reps.filter("asked").select("id", "fingerprint")
    if alter is not None:
        ids = materialize(asked.select(F.col("id").alias(key)), "audio-asked")
        some = df.select(key, media).join(F.broadcast(ids) if fits(ids, ID_ROWS) else ids, key).dropDuplicates([key])
        asked = materialize(fingerprint(some, key, media, lambda v: alter(decode(v))).withColumnRenamed(key, "id"), "audio-queries")
    matches = align(reps.select("id", "fingerprint"), asked, itself=alter is not None)
    best = matches.groupBy("q").agg(F.count("*").alias("n_matches"), F.min(F.struct("errors", F.col("r").alias("match_id"), "offset", "overlap")).alias("best"))
    known = classes.join(best, classes["class_id"] == best["q"], "left").select("print_id", "class_id", "asked", "n_matches", "best", "n")
    known = materialize(known, "audio-known")
    total = known.agg(F.sum("n")).first()[0] or 0
    rows = lookup_join(prints, known, "print_id", "n", total)
    return rows.select(F.col("id").alias(key), F.size("fingerprint").cast("long").alias("n_words"), F.when(F.col("print_id").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("asked", F.lit(False)).alias("asked"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"), "best.match_id", "best.offset", "best.overlap", "best.errors")
