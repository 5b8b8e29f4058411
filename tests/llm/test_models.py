"""Toxicity, language model, quality rules and encoding, against brute force, held-out rows and the library."""

import math
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

sys.path.insert(0, str(Path(__file__).parent))
from helpers import ODD, documents, empty, lowered, odd_documents, words

from rasterloom.llm import language_model as L
from rasterloom.llm import pieces as P
from rasterloom.llm import quality as Q
from rasterloom.llm import toxicity as T
from rasterloom.llm.kernels import grouped

SF = "/root/testdata/sf0.1"
RNG = np.random.default_rng(8)
VOCABULARY = ["".join(chr(97 + k) for k in RNG.integers(0, 26, RNG.integers(2, 9))) for _ in range(400)]


def prose(n, extra=()):
    w = [VOCABULARY[k] for k in RNG.zipf(1.4, n) % 400]
    for x in extra:
        w.insert(int(RNG.integers(0, len(w) + 1)), x)
    return " ".join(w)


# Toxicity


def features_of(text):
    return {k: set(T.features(g)[0].tolist()) for k, g in enumerate(grouped(pa.array([text])))}[0]


def test_features_ignore_case_and_punctuation_but_not_order():
    assert features_of("Some words, here!") == features_of("some WORDS here")
    assert features_of("a b c") != features_of("c b a") and len(features_of("a b c")) == 6 and len(features_of("x")) == 1
    assert features_of("") == set() and features_of(None) == set() and len(features_of("x x x")) == 3


def test_features_stay_within_texts():
    index, bounds = T.features(next(grouped(pa.array(["a b", "c", "", "a b"]))))
    parts = [set(index[i:j].tolist()) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    assert parts[0] == parts[3] == features_of("a b") and parts[1] == features_of("c") and parts[2] == set()


def test_ftrl_is_sparse_and_learns():
    m = T.Ftrl(10)
    for k in range(400):
        m.learn(np.array([1, 2 + k % 500 if k < 100 else 3]), 0)
        m.learn(np.array([1, 7]), 1)
    at, w = m.sparse()
    assert len(at) < 20 and dict(zip(at.tolist(), w, strict=True))[7] > 1


def test_ftrl_equals_a_scalar_one():
    """Against the update rule written coordinate by coordinate."""
    rng = np.random.default_rng(4)
    model, z, n = T.Ftrl(6, l1=0.3), [0.0] * 65, [0.0] * 65

    def weight(i):
        l1 = 0.3 if i < 64 else 0.0
        return 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((1 + math.sqrt(n[i])) / 1.0 + 0.5)

    for _ in range(300):
        at = np.unique(rng.integers(0, 64, 5))
        label = int(3 in at or rng.random() < 0.1)
        model.learn(at, label)
        own = [*at.tolist(), 64]
        w = {i: weight(i) for i in own}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in own:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 1.0 * w[i]
            n[i] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n)
    at, w = model.sparse()
    assert dict(zip(at.tolist(), w, strict=True)) == pytest.approx({i: weight(i) for i in range(65) if weight(i)})


def test_one_text_a_doc_id_is_learned(spark):
    docs = documents(spark, [(k, prose(20, ["bad"] if k % 2 else [])) for k in range(60)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    one, many = (T.fit(d, labels) for d in (docs, docs.union(docs).union(docs)))
    assert np.array_equal(one[0], many[0]) and np.array_equal(one[1], many[1])
    assert T.without_toxic(docs, labels.limit(0)).count() == 60 and T.without_toxic(empty(spark), labels).count() == 0


def test_toxicity_held_out(spark):
    docs = documents(spark, [(k, prose(60, ["scumword"] if k % 5 == 0 else [])) for k in range(600)])
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(600)], "doc_id long, toxic int")
    rows = T.toxicity(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    right = [r.predicted == (r.doc_id % 5 == 0) for r in rows if r.held_out]
    assert np.mean(right) > 0.97
    left = T.without_toxic(docs, labels)
    assert left.columns == docs.columns and left.count() == sum(r.predicted == 0 for r in rows)


def test_held_out_labels_are_not_read(spark):
    docs = documents(spark, [(k, prose(30, ["bad"] if k % 2 else [])) for k in range(80)])
    made = lambda flip: spark.createDataFrame([(k, (k % 2) ^ int(flip and zlib.crc32(str(k).encode()) % 4 == 2)) for k in range(80)], "doc_id long, toxic int")
    one, two = (sorted((r.doc_id, r.score) for r in T.toxicity(docs, made(f)).collect()) for f in (False, True))
    assert one == two


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(-5, 1), (-5, 1), (1, 0), (4, None), (None, 1), (10, 1)], "doc_id long, toxic int")
    docs = odd_documents(spark)
    rows = T.toxicity(docs, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect()) and all(0 <= r.score <= 1 for r in rows)
    none = T.toxicity(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert T.toxicity(empty(spark), labels).count() == 0 and T.without_toxic(docs, labels).columns == docs.columns


def test_toxicity_on_the_tables(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    rows = T.toxicity(read("documents"), read("labels")).join(read("labels"), "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    toxic = rows.toxic == 1
    assert (rows.predicted[toxic] == 1).mean() > 0.75 and (rows.predicted[~toxic] == 0).mean() > 0.98
    assert (rows.score.rank()[toxic].mean() - toxic.sum() / 2) / (~toxic).sum() > 0.97


# Language model


def reference_scores(rows, order=2):
    """The model in dictionaries of tuples of words: scores by doc_id, the probability, and the counts of words."""
    toks = {i: [*[w.lower() for w in words(t)], "END"] for i, t in rows}
    train = [i for i, _ in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    one = Counter(w for i in train for w in toks[i])
    total, types = sum(one.values()), len(one)

    def history(t, k):
        return tuple(["BEGIN"] * (order - 1) + t)[k : k + order - 1]

    counts = {order: Counter((*history(toks[i], k), w) for i in train for k, w in enumerate(toks[i]))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    follow, d = defaultdict(lambda: [0, 0, 0, 0]), {}
    for n, grams in counts.items():
        of = Counter(grams.values())
        d[n] = L.discounts([0, *(of[k] for k in (1, 2, 3, 4))])
        for g, c in grams.items():
            if n > 1:
                follow[g[:-1]][0] += c
                follow[g[:-1]][min(c, 3)] += 1
    more = Counter(min(c, 3) for c in counts[1].values())
    pairs = len(counts[2])
    left = sum(d[1][k - 1] * more[k] for k in (1, 2, 3)) / pairs if pairs else 1

    def p(h, w):
        n = len(h) + 1
        c = counts[n][(*h, w)]
        own = max(c - d[n][min(c, 3) - 1], 0) if c else 0
        if n == 1:
            return own / max(pairs, 1) + left / (types + 1)
        if h not in follow:
            return p(h[1:], w)
        return own / follow[h][0] + float(np.dot(follow[h][1:], d[n])) / follow[h][0] * p(h[1:], w)

    out = {}
    for i, _ in rows:
        score = sum(math.log10(p(history(toks[i], k), w)) for k, w in enumerate(toks[i]))
        base = sum(math.log10((one[w] + 0.5) / (total + 0.5 * (types + 1))) for w in toks[i])
        out[i] = (len(toks[i]), sum(one[w] > 0 for w in toks[i]), total, base, score)
    return out, p, one


@pytest.mark.parametrize(("order", "flush"), [(2, 200), (2, 1_250_000), (3, 150), (4, 1_250_000)])
def test_language_model(spark, monkeypatch, order, flush):
    monkeypatch.setattr(L, "FLUSH_TOKENS", flush)
    rows = [(k, prose(int(RNG.integers(0, 120)))) for k in range(150)] + [(k + 1000, t) for k, t in enumerate(ODD)]
    want, p, one = reference_scores(rows, order)
    got = {r.doc_id: r for r in L.lm_scores(documents(spark, rows).repartition(4), order, shard_bytes=3000).collect()}
    for i, (n, known, total, base, score) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    for h in ("BEGIN", next(iter(one))):
        h = ("BEGIN",) * (order - 2) + (h,)
        assert sum(p(h, w) for w in one) + p(h, "unheard") == pytest.approx(1, rel=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_many_shards_in_few_files(spark, monkeypatch, order):
    monkeypatch.setattr(L, "FILE_BITS", 1)
    monkeypatch.setattr(L, "MOST_HOT", 8)
    rows = [(k, prose(30)) for k in range(60)]
    want, _, _ = reference_scores(rows, order)
    for r in L.lm_scores(documents(spark, rows), order, shard_bytes=40).collect():
        assert r.score == pytest.approx(want[r.doc_id][4], rel=1e-9)


def test_regular_words_are_told_apart(spark):
    """Words whose letters cancel in sums of powers (Thue-Morse), of 1024 bytes and more."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    rows = [(0, a), (2, f"{a} x"), (7, b)]
    held = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5 == 1][0]
    rows = [(k, t) for k, t in rows if zlib.crc32(str(k).encode()) % 5 != 1 and t != b] + [(held, b)]
    got = {r.doc_id: r.n_known for r in L.lm_scores(documents(spark, rows)).collect()}
    assert got[held] == 1  # the end alone


def test_language_model_counts_beyond_a_byte(spark):
    rows = [(k, "the cat " * 40) for k in range(60)]
    want, _, _ = reference_scores(rows)
    for r in L.lm_scores(documents(spark, rows)).collect():
        assert r.score == pytest.approx(want[r.doc_id][4], rel=1e-9)


def test_language_model_odd_rows(spark):
    docs = odd_documents(spark)
    rows = L.lm_scores(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect()) and all(np.isfinite(r.score) for r in rows)
    assert L.lm_scores(empty(spark)).count() == 0


def test_nothing_to_learn_from(spark):
    held = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5 == 1][:5]
    rows = L.lm_scores(documents(spark, [(k, "a b") for k in held])).collect()
    assert {(r.n_known, r.train_tokens, r.score) for r in rows} == {(0, 0, 0.0)}


def test_model_beats_unigrams_on_held_out_texts(spark):
    rows = L.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").toPandas()
    assert rows.score.sum() > rows.base_score.sum()


# Quality


def counts_of(text):
    text = text or ""
    import re

    w, seen, lines = re.findall(r"[^\x20\x09-\x0D]+", text), set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), lines, len(covered)


def test_rule_counts():
    texts = [*ODD, "a b\na b\n\na b\n", "x " * 40, prose(50) + " " + " ".join(VOCABULARY[:9]) + " q " + " ".join(VOCABULARY[:9])]
    for most in (50, 1 << 21):
        got = [x for g in grouped(pa.array(texts), most) for x in zip(*(Q.rule_counts(g)[0][c].tolist() for c in Q.COUNTS), strict=True)]
        assert got == [counts_of(t) for t in texts]


def test_regular_lines_are_told_apart():
    a, b = "x", "yz"
    for _ in range(10):
        a, b = a + b, b + a
    assert len(a) == len(b) and a != b
    counts = Q.rule_counts(next(grouped(pa.array([f"{a}\n{b}", f"{a}\n{b}\n{a}"]))))[0]
    assert counts["n_dup_lines"].tolist() == [0, 1]


def test_statistics_have_their_number():
    assert Q.rule_counts(next(grouped(pa.array(["a b c"]))))[1].shape == (1, Q.STATISTICS)


def test_forest_sets_outliers_apart():
    points = RNG.normal(0, 1, (2000, 4))
    points[:, 3] = 0  # constant where clean
    box = (points.min(0) - 1, points.max(0) + np.array([1, 1, 1, 9]))
    forest = Q.IsolationForest(points, box)
    odd = points[:200] + np.array([0, 0, 0, 8])
    assert np.median(forest.path_length(odd)) < np.quantile(forest.path_length(points), 0.02)


def test_calibration():
    length, good = np.arange(100.0), np.arange(100) >= 10
    assert 9 < Q.calibrated(length, good, 0.01) <= 10
    assert Q.calibrated(length, np.ones(100, bool)) == Q.calibrated(np.zeros(0), np.zeros(0, bool)) == -1


def test_quality(spark):
    junk = lambda k: " ".join(w + "$$$" for w in prose(80).split())
    texts = [(k, junk(k) if k % 6 == 0 else prose(80)) for k in range(900)]
    docs, labels = documents(spark, texts), spark.createDataFrame([(k, int(k % 6 > 0)) for k in range(0, 900, 2)], "doc_id long, quality int")
    rows = Q.quality(docs, labels).collect()
    unlabelled = [r for r in rows if r.doc_id % 2]
    assert np.mean([r.kept for r in unlabelled]) > 0.95 and not any(r.kept for r in rows if r.doc_id % 6 == 0)


def test_quality_odd_rows(spark):
    docs, labels = odd_documents(spark), spark.createDataFrame([(-5, 1), (None, 0), (1, None)], "doc_id long, quality int")
    rows = Q.quality(docs, labels).collect()
    want = Counter((d.doc_id, *counts_of(d.text)) for d in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    assert Q.quality(empty(spark), labels).count() == 0


# Encoding


@pytest.fixture(scope="module")
def bpe():
    return P.load(P.MODEL_PATH), sentencepiece.SentencePieceProcessor(model_file=P.MODEL_PATH)


TEXTS = [t or "" for t in ODD if len(t or "") < 10000] + [
    "Hello  world\n foo\tbar", " ", "  a", "a▁b ▁▁ c", "emoji 😀😀 x \x00\x7f", "supercalifragilistic" * 9, " " * 70 + "x", "x" + " " * 300, "a" * 3000 + "b" * 50,
    "antidisestablishmentarianism's déjà-vu; naïve, 12345.678", "ああああ" * 30, "<s> </s> <unk> <0x41>",
]


def test_bpe_equals_the_library(bpe):
    model, library = bpe
    texts = TEXTS + [prose(200) for _ in range(20)]
    ids, bounds = model.encode(texts)
    assert [ids[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:], strict=True)] == library.encode(texts)
    back = [x.decode() for x in model.decode(ids, bounds)]
    assert back == [t.replace("▁", " ") for t in texts]


def test_bpe_by_heap_equals_matrices(bpe, monkeypatch):
    model, _ = bpe
    segments = model.segments(" ".join(TEXTS[:12]))
    one = [x.tolist() for x in model.encode_segments(segments)]
    monkeypatch.setattr(P, "LONG", 0)
    assert [x.tolist() for x in model.encode_segments(segments)] == one


def unigram(byte_fallback):
    """A hand-made model: nothing is trained."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    add = lambda piece, score, kind: m.pieces.add(piece=piece, score=score, type=kind)
    add("<unk>", 0, P.UNKNOWN)
    if byte_fallback:
        for b in range(256):
            add(f"<0x{b:02X}>", 0, P.BYTE)
    for k, piece in enumerate(["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab", "▁▁", "bca"]):
        add(piece, -2.0 - 0.37 * k % 3.1, P.NORMAL)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, byte_fallback
    m.trainer_spec.unk_id, m.trainer_spec.bos_id, m.trainer_spec.eos_id, m.trainer_spec.pad_id = 0, -1, -1, -1
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = "identity", True, False, True
    return m.SerializeToString()


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_unigram_viterbi_equals_the_library(byte_fallback):
    data = unigram(byte_fallback)
    model, library = P.Model(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["".join(RNG.choice(list("abc  "), 40)) for _ in range(200)] + ["abc", "xaby", "zz", "é a", ""]
    ids, bounds = model.encode(texts)
    got = [ids[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    score = lambda x: sum(library.get_score(k) for k in x)
    for t, x, y in zip(texts, got, library.encode(texts), strict=True):
        assert x == y or (score(x) == pytest.approx(score(y), abs=1e-4) and library.decode(x) == library.decode(y)), t


def test_other_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(unigram(True))
    m.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        P.Model(m.SerializeToString())


def test_encode_and_decode_tables(spark, bpe):
    docs = odd_documents(spark)
    made = P.encode_table(docs)
    rows = made.collect()
    assert Counter(r.doc_id for r in rows) == Counter(d.doc_id for d in docs.collect()) and all(r.decoded for r in rows)
    assert Counter(r.n_bytes for r in rows) == Counter(len((d.text or "").encode()) for d in docs.collect())
    back = Counter((r.doc_id, r.text) for r in P.decode_table(made).collect())
    assert back == Counter((d.doc_id, d.text or "") for d in docs.collect())
    assert P.encode_table(empty(spark)).count() == 0 and P.decode_table(made.limit(0)).count() == 0
    null = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.text for r in P.decode_table(null).orderBy("doc_id").collect()] == [None, ""]
