"""The corpus operators: hard rows, brute force, round trips and held-out accuracy."""

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import compare

from tessella.llm import audio, bpe, chat, common, langid, lm, mixing, neardup, queries, sketch, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, size long, taken int"
LONG = "word " * 30_000
TEXTS = [None, "", "   \n\t ", "!!! 123", "one", "a b c d", "a b c d", LONG, LONG + "end", "Ünïcödé 漢字 😀 \x00 ▁", "The quick brown fox jumps over the lazy dog. " * 9, "The quick brown fox jumps over the lazy dog. " * 9]


@pytest.fixture(scope="session")
def hard(spark):
    """Null, empty, long, tied and repeated rows; null ids and languages; columns whose names clash with results."""
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 2}", None, 0.5, "k", 1, 1) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, "one", "en", None, 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


# ---- byte-level BPE


def tiktoken_encoding():
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_like_tiktoken_and_back():
    ranks, enc = tiktoken_encoding()
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    rng = np.random.default_rng(5)
    texts = [t or "" for t in TEXTS] + ["".join(chr(c) for c in rng.choice([32, 10, 65, 0xE9, 0x4E2D, 0x1F600, 0x3000, 0x2581, 0x85], 80)) for _ in range(200)]
    for t in texts:
        packed = codec.encode(t)
        assert np.frombuffer(packed, "<u4").tolist() == enc.encode_ordinary(t)
        assert codec.decode(packed) == t.encode()


def test_bpe_query(spark, sf_dir, hard, none):
    _, enc = tiktoken_encoding()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = dict((a, (b, c, d)) for a, b, c, d in rows(queries.op1_byte_bpe(spark, sf_dir), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
    for i, t in rows(docs, "doc_id", "text"):
        ids = enc.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    args = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.encode_documents(hard, *args).collect()
    assert len(out) == len(TEXTS) + 4 and all(r.n_tokens == 0 for r in out if r.doc_id in (0, 1))
    assert bpe.encode_documents(none, *args).count() == 0


# ---- audio


def test_audio_fingerprints(spark, sf_dir):
    rng = np.random.default_rng(1)
    a = audio.melody_samples(rng.standard_normal(64).tolist())
    p = audio.fingerprint_frames(audio.chroma(a))
    q = audio.fingerprint_frames(audio.chroma(audio.excerpt(a)))
    overlap, errors = audio.bit_errors(q.view(np.int32), p.view(np.int32), -10)
    assert overlap >= 16 and errors < 0.1
    other = audio.fingerprint_frames(audio.chroma(audio.melody_samples(rng.standard_normal(64).tolist())))
    assert audio.bit_errors(other.view(np.int32), p.view(np.int32), 0)[1] > 0.3
    body = a.astype("<i2").tobytes()
    wav = b"RIFF" + (36 + len(body)).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + bytes(16) + b"data" + len(body).to_bytes(4, "little") + body
    assert (audio.wav_samples(wav) == a).all() and len(audio.wav_samples(b"junk")) == 0
    df = spark.createDataFrame([(1, wav, "x"), (2, wav, "x"), (20, wav, "x"), (3, None, "x"), (4, b"", "x"), (5, b"RIFF", "x"), (None, wav, "x")], "id long, media binary, fingerprint string")
    out = {r["id"]: r for r in audio.match_recordings(df, "id", "media").collect()}
    assert [out[i].class_id for i in (1, 2, 20, 3, 4, None)] == [1, 1, 1, 3, 4, 1] and out[1].asked and out[3].n_words == 0
    assert audio.match_recordings(df.limit(0), "id", "media").count() == 0


def test_audio_recall_by_brute_force(spark, sf_dir):
    vectors = dict(rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"))
    prints = {i: audio.fingerprint_frames(audio.chroma(audio.melody_samples(v))).view(np.int32) for i, v in vectors.items()}
    truth = set()
    for i in [i for i in vectors if i % 20 == 0]:
        q = audio.fingerprint_frames(audio.chroma(audio.excerpt(audio.melody_samples(vectors[i])))).view(np.int32)
        for j, p in prints.items():
            for offset in range(-32, 22):
                overlap, errors = audio.bit_errors(q, p, offset)
                if overlap >= audio.LEAST_OVERLAP and errors <= audio.MOST_ERRORS:
                    truth.add(i)
    found = {r.vec_id for r in queries.op2_chroma_fingerprints(spark, sf_dir).collect() if r.n_matches and r.vec_id % 20 == 0}
    assert truth and len(found & truth) >= 0.9 * len(truth)


# ---- language


def test_language_held_out(spark, hard, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    out = langid.identify(docs, model, carry=("lang",)).filter("crc32(cast(doc_id as string)) % 5 = 0").collect()
    assert sum(r.lang == r.lang_pred for r in out) > 0.95 * len(out)
    both = " ".join(docs.filter(f"lang = '{x}' and n_chars > 1500").first().text[:1500] for x in ("en", "fr"))
    assert set(model.mixture(both)) == {"en", "fr"}
    seen = {r.doc_id: r for r in langid.identify(hard, model).collect()}
    assert [seen[i].lang_pred for i in (0, 1, 2, 3)] == ["und"] * 4 and seen[0].score == 0
    assert all(langid.trigram_counts(t) is None for t in ("½", "²", "①", "Ⅷ", "12_3", "。")) and langid.trigram_counts("½ é") is not None
    odd = langid.identify(spark.createDataFrame([(1, "½"), (2, "Ⅷ ① 7"), (3, "ª")], "doc_id long, text string"), model).collect()
    assert [(r.lang_pred, r.score) for r in odd[:2]] == [("und", 0.0)] * 2 and odd[2].lang_pred != "und"
    # the proportions are those of the greatest likelihood, by trying all of them
    counts = langid.trigram_counts(both)
    at = np.flatnonzero(counts)
    p = model.prob[[model.langs.index(x) for x in ("en", "fr")]][:, at]
    best = max(np.arange(0.005, 1, 0.005), key=lambda x: np.log(x * p[0] + (1 - x) * p[1]) @ counts[at])
    assert abs(model.mixture(both)["en"] - best) < 0.02
    assert langid.fit(none).langs == [] and langid.identify(hard, langid.fit(none)).filter("lang_pred <> 'und'").count() == 0
    assert langid.identify(none, model).count() == 0


# ---- WARC


def test_warc(spark, sf_dir):
    compare(queries.op4_warc_revisits(spark, sf_dir), warc.ORACLE, sf_dir)
    a = "é" * 600
    data = [(i, "http://x/1\r\nX: y", a, 1) for i in range(5)] + [(4, "u", a, 1), (9, None, None, 1), (7, "u", "", 1), (8, "u", "WARC/1.1\r\n\r\n\r\n", 1), (None, "u", a, 1), (10, "u", "s" * 999, 1), (11, "u", "s" * 999, 1)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, payload_bytes int")
    out = sorted(rows(warc.round_trip(pages), "page_id", "payload_bytes", "record_type", "refers_to"), key=str)
    want = [(i, 1200, "revisit", 4) for i in (0, 1, 2, 3, None)] + [(4, 1200, "response", None)] * 2 + [(7, 0, "response", None), (9, 0, "response", None), (8, 14, "response", None), (10, 999, "response", None), (11, 999, "response", None)]
    assert out == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_long_pages(spark, monkeypatch):
    """Pages beyond a file's bytes get files of their own."""
    monkeypatch.setattr(warc, "FILE_BYTES", 4_000_000)
    sizes = [10, 5_000, 70_000, 3_000_000, 9_000_000]
    pages = spark.createDataFrame([(i, "u", "é" * (n // 2) + str(i)) for i, n in enumerate(sizes)], "page_id long, url string, html string")
    out = sorted(rows(warc.round_trip(pages), "page_id", "payload_bytes", "record_type"))
    assert out == [(i, n + 1, "response") for i, n in enumerate(sizes)]


def test_warc_payloads_come_back(spark):
    pages = spark.createDataFrame([(i, "u", f"text {i} \r\n\r\n é" * 100) for i in range(20)], "page_id long, url string, html string")
    path = common.scratch_path(spark, "test")
    warc.write_archives(pages, path)
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, path, payloads=True).collect()}
    assert got == {r.page_id: r.html for r in pages.collect()}
    assert warc.hex_digest("sha1:" + "A" * 32) == "00" * 20


def test_lookup_join_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    left = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 0 else id end as k")
    table = common.materialize(spark.sql("select id as k, id * 2 as v, if(id = 0, 1000, 1) as n from range(2500)"), "t")
    out = common.lookup_join(left, table, "k", "n", 3000).collect()
    assert len(out) == 3000 and all(r.v == (r.k * 2 if r.k < 2500 else None) for r in out)
    hollow = spark.range(3000).selectExpr("id", "if(id % 30 = 0, id, null) as k").repartition(5)
    joined = common.lookup_join(hollow, table, "k", "n", 3000)
    assert sorted((r.id, r.v) for r in joined.collect()) == [(i, (i * 2 if i < 2500 else None) if i % 30 == 0 else None) for i in range(3000)]
    # null keys stay where they are: no task gets them all
    sizes = [len(x) for x in joined.rdd.glom().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 1500


# ---- mixing


def test_mixing(spark, sf_dir, hard, none):
    compare(queries.op5_source_mix(spark, sf_dir), mixing.ORACLE, sf_dir)
    out = mixing.mix(hard).collect()
    assert len(out) == hard.count() and all(r.taken <= 3 * r["size"] for r in out)
    totals = {}
    for r in out:
        totals.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= 1 for t, n in totals.values())
    assert mixing.mix(none).count() == 0
    assert mixing.targets([10, 0, 90], [5.0, 2.0, 1.0]) == [30.0, 0.0, 70.0]
    again = mixing.mix(hard.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mix_whole_comes_near_its_targets(spark, hard, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    goal = {r.source: (r.target, r.source_size) for r in mixing.mix(docs).collect()}
    out = mixing.mix_whole(docs)
    assert out.columns == docs.columns
    got, largest, copies = {}, {}, {}
    for r in out.select("doc_id", "source", mixing.words(out.text).alias("n")).collect():
        got[r.source] = got.get(r.source, 0) + r.n
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    for r in docs.select("source", mixing.words(docs.text).alias("n")).collect():
        largest[r.source] = max(largest.get(r.source, 0), r.n)
    assert all(abs(got[s] - t) <= largest[s] / 2 + 1 for s, (t, _) in goal.items()) and max(copies.values()) <= 3
    assert mixing.mix_whole(hard).columns == hard.columns and mixing.mix_whole(none).count() == 0


# ---- chat


def test_chat(spark, sf_dir):
    compare(queries.op6_chat_format(spark, sf_dir), chat.ORACLE, sf_dir)
    texts = ["", None, "\\", "</s>", "<\\/s>", "[SEP]", "[ROLE]x[/ROLE]", "a[\\INST]", "<s>\n", "é😀"]
    data = [(1, i, r, t, "x") for i, (r, t) in enumerate((r, t) for t in texts for r in ("user", "assistant", "assistant", "[ROLE]", None))]
    data += [(2, 0, "assistant", "b", "x"), (2, 0, "assistant", "b", "x"), (None, None, None, None, None)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string")
    chats = chat.format_conversations(df)
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chats.select("conv_id", chat.read_turns(chats.formatted).alias("turns")).collect()}
    assert back[1] == [(r or "", t or "") for _, _, r, t, _ in data if _ == "x"][: len(back[1])]
    assert back[2] == [("assistant", "b")] * 2 and back[None] == [("", "")]
    for r in chats.collect():
        learned = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert len(learned) == sum(role == "assistant" for role, _ in back[r.conv_id])
        assert r.formatted.count("</s>") == len([1 for i, x in enumerate(back[r.conv_id]) if not i or x[0] != back[r.conv_id][i - 1][0]])
        raw = r.formatted.encode()
        assert [raw[s.byte_start : s.byte_start + s.byte_length].decode() for s in r.loss_spans] == learned
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


def test_long_conversation(spark):
    import time

    df = spark.range(16_000).selectExpr("1L as conv_id", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "repeat('é[SEP]x ', 20) as text").repartition(4)
    began = time.time()
    r = chat.digest(chat.format_conversations(df)).first()
    said = "é[SEP]x " * 20
    assert r.loss_sha256 == hashlib.sha256((said * 10_666).encode()).hexdigest() and r.n_turns == 16_000
    assert time.time() - began < 30
    sums = spark.range(1).select(chat.running_sum(chat.F.sequence(chat.F.lit(1).cast("long"), chat.F.lit(37).cast("long"))).alias("s")).first().s
    assert sums == [k * (k + 1) // 2 for k in range(1, 38)]


# ---- toxicity


def test_toxicity_held_out(spark, hard, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 5 = 0").collect()
    pos, neg = [r.score for r in out if r.toxic], [r.score for r in out if not r.toxic]
    assert np.mean([[a > b for b in neg] for a in pos]) > 0.95
    assert all(r.offending for r in out if r.predicted)
    bad = toxicity.score(spark.createDataFrame([(1, "Good day to you. You idiot moron. All fine here.")], "doc_id long, text string"), model).first()
    assert bad.predicted == 1 and [s.sentence for s in bad.offending] == ["You idiot moron."]
    seen = toxicity.score(hard, model).collect()
    assert len(seen) == hard.count() and all(0 <= r.score <= 1 for r in seen)
    assert toxicity.score(none, model).count() == 0
    assert 0 <= toxicity.score(hard, toxicity.fit(none, labels)).first().score <= 1
    assert not toxicity.fit(docs, labels.limit(0)).weights.any()


def test_toxicity_is_a_noisy_or(spark):
    model = toxicity.Model(bias=-3.0)
    for w, x in (("bad", 2.5), ("worse", 1.25), ("fine", -1.0)):
        model.weights[toxicity.features(w)[0]] = x
    texts = {1: "Bad bad fine. Worse!\nunknown words only", 2: "fine", 3: "", 4: None, 5: "... !", 6: "bad worse. " * 9}
    logit = {1: [-1.5, -1.75, -3.0], 2: [-4.0], 3: [-3.0], 4: [-3.0], 5: [-3.0], 6: [0.75] * 9}
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()}
    for i, z in logit.items():
        assert math.isclose(got[i].score, 1 - math.prod(1 - 1 / (1 + math.exp(-x)) for x in z), rel_tol=1e-6), i
    assert [len(got[i].offending) for i in (1, 6)] == [0, 9]


def test_toxicity_of_rare_words(spark):
    """Four toxic documents of 300 give their words weight, and texts of unknown words score low."""
    rng = np.random.default_rng(0)
    texts = [". ".join(" ".join(f"w{k:03d}" for k in rng.integers(0, 500, 12)) for _ in range(5)) for _ in range(300)]
    texts = [t + (". you idiot moron." if i < 4 else ".") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, held_out=-1)
    score = lambda t: model.noisy_or(model.scores(t, model.memo()))
    assert score("you idiot moron. hello") > 0.5 > 0.1 > max(map(score, ("hello there", "something else. entirely", "", texts[200])))


# ---- language model


def brute_base(docs, folds=10):
    import collections

    count = collections.Counter()
    tokens = lambda t: (t or "").encode().lower().split() + [b" "]
    for i, t in docs:
        if i is not None and zlib.crc32(str(i).encode()) % folds:
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    base = lambda t: sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
    return [(i, len(tokens(t)), sum(w in count for w in tokens(t)), n, base(t)) for i, t in docs]


@pytest.mark.parametrize("which", ["table", "hard"])
def test_lm_base(spark, sf_dir, hard, which):
    docs = hard if which == "hard" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(brute_base(rows(docs, "doc_id", "text")), key=str)
    got = sorted(rows(lm.score_documents(docs), "doc_id", "n_tokens", "n_known", "train_tokens", "base_score"), key=str)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert np.allclose([x[4] for x in got], [x[4] for x in want])


def brute_trigrams(docs, folds=10):
    """log10 probability of each text, from counts in dictionaries; the weights by the same EM over all held-out tokens."""
    import collections

    tokens = lambda t: (t or "").encode().lower().split() + ["end"]
    uni, bi, tri = (collections.Counter() for _ in range(3))
    learned = [(zlib.crc32(str(i).encode()) % folds, tokens(t)) for i, t in docs if i is not None]

    def grams(t):
        for k, w in enumerate(t):
            v = t[k - 1] if k else "end"
            yield w, (v, w), (t[k - 2] if k > 1 else "end", v, w) if k else None

    def count(t, uni, bi, tri):
        for w, vw, uvw in grams(t):
            uni[w] += 1
            bi[vw] += 1
            if uvw:
                tri[uvw] += 1

    for f, t in learned:
        if f:
            count(t, uni, bi, tri)
    total, distinct = sum(uni.values()), len(uni)

    def estimates(t, uni, bi, tri, total):
        for w, (v, _), uvw in grams(t):
            pairs = (bi[v, w], uni[v]) if uvw is None else (tri[uvw], bi[uvw[:2]])
            yield (uni[w], total), (bi[v, w], uni[v]), pairs

    bucket = lambda c: int(math.log2(c)) + 1 if c > 0 else 0
    weights = []

    def mix(e):
        p = 1 / (distinct + 1)
        for a, (n, c) in zip(weights, e, strict=False):
            p = a[bucket(c)] * n / max(c, 1) + (1 - a[bucket(c)]) * p
        return p

    held = []
    for f, t in learned:
        if f == 1:
            own = [collections.Counter() for _ in range(3)]
            count(t, *own)
            rest = [x - y for x, y in zip((uni, bi, tri), own, strict=True)]
            held += estimates(t, *rest, total - len(t))
    for order in range(3):
        events = collections.Counter()
        for e in held:
            n, c = e[order]
            events[bucket(c), round(8 * math.log2(n / c / mix(e))) if n > 0 < c else -9999] += 1
        weights.append(lm.learn_weights(np.array([(*k, n) for k, n in events.items()]).reshape(-1, 3)))
    return {i: sum(math.log10(mix(e)) for e in estimates(tokens(t), uni, bi, tri, total)) for i, t in docs}


def test_lm_score_by_brute_force(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_trigrams(rows(docs, "doc_id", "text"))
    monkeypatch.setattr(lm, "RANGE_TOKENS", 7_000)
    out = lm.score_documents(docs.repartition(3, "source"))
    # still to be run when others have run, whatever the session's settings
    langid.identify(docs, langid.fit(docs)).count()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = dict(rows(out, "doc_id", "score"))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys()
    assert np.allclose([got[i] for i in want], list(want.values()), rtol=1e-3)


def test_lm_learns(spark, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = lm.score_documents(docs).filter("held_out").collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm.score_documents(none).count() == 0
    weights = lm.learn_weights(np.array([[3, 40, 100], [3, lm.NEVER, 100]]))
    assert 0.3 < weights[3] < 0.6 and weights[0] == 0 and weights[1] == 0.5 and weights[9] == weights[3]


def test_lm_is_a_distribution():
    """Over all words that may follow a context, and the unknown one, the probabilities sum to 1."""
    texts = [b"a b a c a b b a", b"b a b c", b"a b", b"c c a b"]
    t = lm.Tokens(*lm.tokenize(texts))
    total, distinct = len(t.word), t.size
    model = lm.Weights(total, distinct)
    model.by_order = [np.full(lm.BUCKETS, x) * (np.arange(lm.BUCKETS) > 0) for x in (0.7, 0.6, 0.5)]
    counts = t.spread(t.counts(np.ones(len(texts), bool)))
    at = [i for i in t.later if t.pair_at[i - 1] == t.pair_at[1]]  # what follows the second token's pair
    seen = {int(t.word[i]): i for i in at}
    uni = np.bincount(t.word, minlength=t.size)
    v, uv = counts[1][at[0]], counts[3][at[0]]
    pair = {int(w): int(((t.context == t.context[at[0]]) & (t.word == w)).sum()) for w in range(t.size)}
    p = [model.probability(*(np.array([x]) for x in (uni[w], v, pair[w], uv, counts[4][seen[w]] if w in seen else 0)))[0] for w in range(t.size)]
    p.append(model.probability(*(np.array([x]) for x in (0, v, 0, uv, 0)))[0])
    assert math.isclose(sum(p), 1)


# ---- near duplicates


def brute_groups(docs, percent=75):
    sets = []
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted(((i, len(s), None if i is None else least[find(x)]) for x, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("which", ["table", "hard", "chain"])
def test_near_duplicates(spark, sf_dir, hard, which, monkeypatch):
    if which == "chain":  # neighbours alike, ends apart, with copies and a hub that links to few
        for name, size in (("BLOCK", 5), ("WIDE", 7), ("SET_BYTES", 3_000)):
            monkeypatch.setattr(neardup, name, size)
        words = [f"w{k}" for k in range(400)]
        data = [(k, " ".join(words[3 * k : 3 * k + 60])) for k in range(60)] + [(100 + k, " ".join(words[:60] + [f"x{k}"] * 4)) for k in range(12)]
        rng = np.random.default_rng(3)
        for k in range(80):
            w = list(words[200:300])
            for at in rng.choice(100, 3, replace=False):
                w[at] = f"y{k}-{at}"
            data.append((200 + k, " ".join(w)))
        docs = spark.createDataFrame(data, "doc_id long, text string")
    else:
        docs = hard if which == "hard" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = neardup.group_documents(docs)
    got = sorted(rows(out, "doc_id", "n_shingles", "component_id"), key=str)
    want = brute_groups(rows(docs, "doc_id", "text"))
    if which == "hard":  # a null id is counted but never linked
        got, want = [x for x in got if x[0] is not None], [x for x in want if x[0] is not None]
    assert got == want
    assert all(r.kept == (r.component_id is None or r.doc_id == r.component_id) for r in out.collect())


def test_blocks_let_each_pair_of_like_size_meet(spark):
    rng = np.random.default_rng(4)
    sizes = {int(i): int(n) for i, n in enumerate(rng.integers(1, 60, 90))}
    members = spark.createDataFrame([(i % 2, i, i, n) for i, n in sizes.items()], "bucket long, doc_id long, component long, n_shingles long")
    blocks, met = {}, {}
    for r in neardup.in_blocks(members, 4).collect():
        blocks.setdefault((r.bucket, r["class"], r.i, r.j), []).append((r.doc_id, r.part))
    for (_, _, i, j), some in blocks.items():
        for k, (a, x) in enumerate(some):
            for b, y in some[:k]:
                if i == j or x != y:
                    met[min(a, b), max(a, b)] = met.get((min(a, b), max(a, b)), 0) + 1
    assert max(map(len, blocks.values())) < 30 and set(met.values()) == {1}
    assert all((a, b) in met for a in sizes for b in sizes if a < b and (a - b) % 2 == 0 and 100 * min(sizes[a], sizes[b]) >= 75 * max(sizes[a], sizes[b]))


@pytest.mark.parametrize("broadcast", [True, False])
def test_near_duplicates_of_mostly_empty_rows(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    text = "one two three four five six seven eight nine ten"
    data = [(i, None if i % 9 else text + (" eleven" if i % 2 else "")) for i in range(180)]
    out = rows(neardup.group_documents(spark.createDataFrame(data, "doc_id long, text string")), "doc_id", "component_id")
    assert dict(out) == {i: i if t is None else 0 for i, t in data}


def test_near_duplicates_empty(spark, none):
    assert neardup.group_documents(none).count() == 0


def test_bayes_bounds():
    assert neardup.least_matches(128) < 96
    assert all(neardup.least_matches(n) <= n * 0.75 for n in (16, 64, 128))


# ---- sketches


def brute_sketch(text, k=sketch.K):
    """By the definition of the hash: XXH64 of a word, then of five of these, each seeded by the one before."""
    import struct

    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split("[\\x20\\x09-\\x0D]+", (text or "").lower()) if w]
    out = set()
    for i in range(len(words) - 4):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(struct.pack("<q", w), h)
        out.add(signed(h))
    if 0 < len(words) < 5:
        out.add(signed(xxhash.xxh64_intdigest(" ".join(map(str, words)).encode(), 42)))
    return sorted(out)[:k]


def brute_resemblance(a, b, k=sketch.K):
    u = sorted({*a, *b})[:k]
    return len({*u} & {*a} & {*b}) / len(u) if u else 1.0


def test_sketch_estimates(spark):
    words = [f"w{k}" for k in range(4000)]
    df = spark.createDataFrame([(" ".join(words[:3000]), " ".join(words[1000:]), "a b c", "", None)], "a string, b string, c string, d string, e string")
    a, b, c, d, e = (sketch.sketch(df[x]) for x in "abcde")
    r = df.select(sketch.resemblance(a, b).alias("r"), sketch.containment(a, b).alias("k"), sketch.distinct_count(a).alias("n"), sketch.distinct_count(c).alias("m"), sketch.resemblance(d, e).alias("z"), sketch.resemblance(a, d).alias("o"), sketch.to_string(sketch.sketch(df.e)).alias("s"), (sketch.from_string(sketch.to_string(b)) == b).alias("t")).first()
    assert abs(r.r - 0.5) < 0.15 and abs(r.k - 0.667) < 0.2 and abs(r.n - 2996) < 600 and r.m == 1 and r.z == 1 and r.o == 0 and r.s == "" and r.t
    back = spark.createDataFrame([("",), (None,), ("00000000000000FFFFFFFFFFFFFFFFFF",)], "s string").select(sketch.from_string(sketch.F.col("s")).alias("a")).collect()
    assert [r.a for r in back] == [[], None, [255, -1]]
    parts = spark.createDataFrame([("x", "a b c d e f g"), ("x", "h i j k l m"), (None, "q"), ("y", None)], "k string, text string").withColumn("s", sketch.sketch(sketch.F.col("text")))
    merged = {q.k: q.s for q in sketch.merge_groups(parts, "k", "s").collect()}
    assert len(merged["x"]) == 5 and len(merged[None]) == 1 and merged["y"] == []


@pytest.mark.parametrize("which", ["table", "hard"])
def test_sketch_query(spark, sf_dir, hard, none, which):
    docs = hard if which == "hard" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = sorted(((i, t or "") for i, t in rows(docs, "doc_id", "text")), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = []
    for at, (i, t) in enumerate(table):
        half, after = len(t) // 2, table[(at + 1) % len(table)][1]
        edited = t[: len(t) - half] + after[:half]
        a, b, c = map(brute_sketch, (t, edited, after))
        hexes = ["".join(f"{x % (1 << 64):016X}" for x in y) for y in (a, b)]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *hexes, brute_resemblance(a, b), brute_resemblance(a, c)))
    out = sketch.compare_with_edited(docs).collect()
    got = ((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in out)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sketch.compare_with_edited(none).count() == 0


# ---- pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(common.materialize(stage(spark, seen[-1], sf_dir), "test"))
        assert seen[-1].columns == columns, name
    kept = [r.doc_id for r in seen[3].collect()]
    assert len(kept) == len(set(kept)) < docs.count()
    groups = {i: c for i, _, c in brute_groups(rows(seen[2], "doc_id", "text"))}
    assert sorted(kept) == sorted(set(groups.values()))
    out = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in seen[4].collect())


def test_stages_take_hard_rows(spark, sf_dir, hard, none):
    """Null, empty and repeated rows, and columns named like the stages' own."""
    import corpus_pipeline

    for docs in (hard, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = common.materialize(stage(spark, docs, sf_dir), "hard")
            assert out.columns == docs.columns, name
            assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
    kept = [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, hard, sf_dir).collect()]
    assert kept.count(None) == 2 and 6 not in kept and 11 not in kept and 0 in kept
    assert {r.doc_id for r in corpus_pipeline.toxicity_stage(spark, hard, sf_dir).collect()} == {r.doc_id for r in hard.collect()}
