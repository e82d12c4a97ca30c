"""Matches of recordings pair by pair, against all offsets compared one by one."""

import numpy as np
import pytest

from tessella.llm import audio

SCHEMA = "id long, fingerprint array<int>"


def by_brute_force(prints, asked, itself=True):
    """Best (offset, overlap, errors) of each matching (query, recording)."""
    out = {}
    for q, x in asked.items():
        for r, y in prints.items():
            tried = [(e, -n, k) for k in range(-len(y), len(x) + 1) for n, e in [audio.bit_errors(x, y, k)] if n >= audio.LEAST_OVERLAP and e <= audio.MOST_ERRORS]
            if tried and (itself or q != r):
                e, n, k = min(tried)
                out[q, r] = (k, -n, e)
    return out


def aligned(spark, prints, asked, **more):
    frames = [spark.createDataFrame([(i, p.tolist()) for i, p in x.items()], SCHEMA) for x in (prints, asked)]
    got = audio.align(*frames, **more).collect()
    out = {(m.q, m.r): (m.offset, m.overlap, m.errors) for m in got}
    assert len(out) == len(got)
    return out


def with_errors(rng, words, bits):
    """``bits`` different bits of every word flipped."""
    flips = [sum(1 << int(b) for b in rng.choice(32, bits, replace=False)) for _ in words]
    return (words.view(np.uint32) ^ np.array(flips, np.uint32)).view(np.int32)


def test_pairs_without_a_common_word(spark):
    rng = np.random.default_rng(3)
    sizes = [48, 16, 15, 0, 17, 200, 31, 64, 48, 90]
    prints = {i: rng.integers(0, 1 << 32, n, np.uint32).view(np.int32) for i, n in enumerate(sizes)}
    asked = {i: with_errors(rng, prints[i][i % 2 * 9 :], 1 + i % 4) for i in prints}
    prints |= {20 + i: np.concatenate([rng.integers(0, 1 << 32, 7, np.uint32).view(np.int32), prints[i]]) for i in (0, 5)}
    want = by_brute_force(prints, asked)
    assert {(0, 0), (0, 20), (5, 5), (5, 25), (7, 7)} <= set(want)
    assert not any(set(asked[q]) & set(prints[r]) for q, r in want)
    assert aligned(spark, prints, asked, itself=True) == want
    assert aligned(spark, prints, prints) == by_brute_force(prints, prints, itself=False)
    assert aligned(spark, prints, {}) == aligned(spark, {}, asked) == {}


def test_rounds_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(4)
    prints = {i: rng.integers(0, 1 << 32, 40, np.uint32).view(np.int32) for i in range(9)}
    asked = {i: with_errors(rng, p, 3) for i, p in prints.items()}
    monkeypatch.setattr(audio, "ROUND_WORDS", 100, raising=False)
    assert aligned(spark, prints, asked, itself=True) == {(i, i): (0, 40, 3 / 32) for i in prints}


@pytest.mark.parametrize("start", [10 * audio.HOP, 10 * audio.HOP + 200])
def test_all_pairs_of_excerpts(spark, sf_dir, start):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    heard = {i: audio.melody_samples(v) for i, v in vectors.items()}
    word = lambda s: audio.fingerprint_frames(audio.chroma(s)).view(np.int32)
    prints = {i: word(s) for i, s in heard.items()}
    asked = {i: word(audio.excerpt(s, start)) for i, s in heard.items() if i % 20 == 0}
    want = by_brute_force(prints, asked)
    got = aligned(spark, prints, asked, itself=True)
    print(f"start {start}: {len(got.keys() & want.keys())} of {len(want)} pairs, {len(got.keys() - want.keys())} others")
    assert want and got == want
