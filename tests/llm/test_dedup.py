"""Exact and near duplicates, and removal of repeats, against brute force."""

import hashlib
import itertools
import sys
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).parent))
from helpers import ODD, documents, empty, lowered, odd_documents

from rasterloom.llm import exact_dedup as E
from rasterloom.llm import repeats as R
from rasterloom.llm import simhash as S
from rasterloom.llm.kernels import grouped, xxh64

import pyarrow as pa


# Exact copies


@pytest.mark.parametrize("handle", [E._handle, lambda block: E.F.length(block)])
def test_exact_dedup_odd_rows(spark, handle):
    """Also with a handle that distinct blocks share: names alone decide."""
    rows = E.exact_dedup(odd_documents(spark), block_chars=7, handle=handle).collect()
    docs = odd_documents(spark).collect()
    assert len(rows) == len(docs)
    groups = {}
    for d in docs:
        groups.setdefault(hashlib.sha256(lowered(d.text)).hexdigest(), []).append(d.doc_id)
    for r in rows:
        own = groups[r.text_sha256]
        known = [x for x in own if x is not None]
        assert r.keep_id == (max(known) if known else None) and r.group_size == len(own) and r.kept == (r.doc_id == r.keep_id)
    assert Counter(r.doc_id for r in rows) == Counter(d.doc_id for d in docs)


@pytest.mark.parametrize("handle", [E._handle, lambda block: E.F.lit(0)])
def test_names_tell_texts_apart(spark, handle):
    texts = ["aaaabbbbcc", "aaaabbbbcd", "aaaabbbbcc", "bbbbaaaacc", "aaaa", "aaaabbbb", "", "aaaabbbbccccdddde", "aaaabbbbccccdddde", "aaaabbbbccccddddf", "日本語テ日本語"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows, names = E.block_names(docs, 4, handle)
    names = {r.doc_id: (r.n_blocks, r.name) for r in rows.join(names, "row").collect()}
    assert len(names) == len(texts)
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            assert (names[i] == names[j]) == (x == y), (x, y)


def test_ascii_lower_leaves_other_letters(spark):
    row = spark.createDataFrame([("ÀAzZ",), ("AZ[",)], "t string").select(E.ascii_lower(E.F.col("t"))).collect()
    assert [r[0] for r in row] == ["Àazz", "az["]


def test_one_of_equal_rows_stays(spark):
    docs = odd_documents(spark)
    left = E.without_exact_copies(docs)
    assert left.columns == docs.columns
    texts = [lowered(r.text) for r in left.collect()]
    assert sorted(texts) == sorted({lowered(r.text) for r in docs.collect()})


def test_exact_dedup_is_native(spark):
    plan = E.exact_dedup(documents(spark, [(1, "a"), (2, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# Fingerprints


def fingerprint(text):
    w = lowered(text).split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    ones = np.zeros(64, int)
    for s in shingles:
        ones += [(xxhash.xxh64_intdigest(s, 42) >> b) & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_hashes():
    rng = np.random.default_rng(0)
    buf = rng.integers(0, 256, 3000).astype(np.uint8)
    start = rng.integers(0, 2800, 400)
    end = start + rng.integers(0, 150, 400)
    want = [xxhash.xxh64_intdigest(buf[i:j].tobytes(), 42) for i, j in zip(start, end, strict=True)]
    assert xxh64(buf, start, end).tolist() == want


@pytest.mark.parametrize("most", [10, 1 << 21])
def test_fingerprints(most):
    texts = [t for t in ODD if len(t or "") < 10000] + ["x" * 200 + " y z  w v", "A b\tc\x0bD"]
    got = np.concatenate([S.fingerprints(g) for g in grouped(pa.array(texts), most)])
    assert got.tolist() == [fingerprint(t) for t in texts]


def near(f, distance=2):
    return np.bitwise_count(f[:, None] ^ f[None, :]) <= distance


@pytest.mark.parametrize("distance", [0, 1, 2, 4])
@pytest.mark.parametrize("top", [0, 20])
def test_trie_pairs(distance, top):
    rng = np.random.default_rng(distance)
    a = np.unique(rng.integers(0, 3000, 800).astype(np.uint64) << np.uint64(42))
    i, j = (np.concatenate(x) for x in zip(*S.trie_pairs(a, distance, top), strict=True))
    want = np.triu(near(a, distance), 1)
    if top:
        want &= (a[:, None] >> np.uint64(64 - top)) == (a[None, :] >> np.uint64(64 - top))
    assert len(i) == len(set(zip(i.tolist(), j.tolist(), strict=True))) == want.sum() and want[i, j].all()


def test_trie_of_nothing():
    assert not list(S.trie_pairs(np.zeros(0, np.uint64), 2, 21)) and not len(S.forest(np.zeros(0, np.uint64)))


def test_dense_buckets_take_bounded_memory():
    """20,000 fingerprints, each within 2 bits of hundreds of others."""
    bits = np.uint64(1) << np.arange(40, dtype=np.uint64)
    few = [np.bitwise_or.reduce(bits[list(k)]) for n in range(4) for k in itertools.combinations(range(40), n)]
    a = np.sort(np.array(few, np.uint64))
    a = np.unique(np.concatenate([a, a | np.uint64(1 << 63)]))
    assert len(a) > 20_000
    tracemalloc.start()
    root = S.forest(a, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (root == 0).all() and peak < 200e6


@pytest.mark.parametrize("hot", [50_000, 1])
def test_components(spark, hot):
    rng = np.random.default_rng(3)
    f = rng.integers(0, 2**63, 60).astype(np.uint64)
    for _ in range(4):  # chains of near fingerprints
        bits = np.uint64(1) << rng.integers(0, 64, (2, 60)).astype(np.uint64)
        f = np.unique(np.concatenate([f, f[rng.integers(0, len(f), 60)] ^ bits[0] ^ bits[1]]))
    label, d = f.view(np.int64).copy(), near(f)
    while True:
        least = np.where(d, label[None, :], 2**63 - 1).min(1)
        if (least == label).all():
            break
        label = least
    links = S.near_links(spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long"), 2, hot)
    got = {r.node: r.component for r in S.components(links).collect()}
    assert all(got.get(int(x), int(x)) == int(c) for x, c in zip(f.view(np.int64), label, strict=True))


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)], "u long, v long")
    assert {r.component for r in S.components(links).collect()} == {0}


def test_simhash_odd_rows(spark):
    docs = odd_documents(spark).collect()
    rows = S.simhash_dedup(odd_documents(spark)).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in rows) == Counter((d.doc_id, f"{fingerprint(d.text):016x}") for d in docs)
    f = np.array([int(r.fingerprint, 16) for r in rows], np.uint64)
    ids = np.array([2**62 if r.doc_id is None else r.doc_id for r in rows])
    d, label = near(f), ids.copy()
    for _ in range(len(f)):
        label = np.where(d, label[None, :], 2**62).min(1)
    assert [2**62 if r.component_id is None else r.component_id for r in rows] == label.tolist()


# Repeats


def cut(rows):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        off = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                off[i] += 1
                off[i + 100] -= 1
            seen.add(w)
        m = np.cumsum(off[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~m].tobytes()
        out[d] = (len(b), int(m.sum()), int((m & ~np.concatenate([[False], m])[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


def passages():
    rng = np.random.default_rng(5)
    text = lambda n: "".join("abcdefgh "[k] for k in rng.integers(0, 9, n))
    shared = [text(int(n)) for n in rng.integers(60, 400, 6)]
    rows = []
    for d in range(250):
        t = text(int(rng.integers(0, 200)))
        for _ in range(int(rng.integers(0, 4))):
            p, a = shared[int(rng.integers(0, 6))], int(rng.integers(0, 30))
            t += p[a : len(p) - int(rng.integers(0, 30))] + text(int(rng.integers(0, 150)))
        rows.append((d * 7, t))
    ends = ["a" * 500, "ab" * 300, "a" * 99, "a" * 100, "", None, "é" * 120, "xyz" * 100 + "é" * 60 + "a" * 150, "\0" * 250]
    return rows + [(5000 + k, t) for k, t in enumerate(ends)]


@pytest.mark.parametrize(("frequent", "shard_bytes", "parts"), [(64, 15000, 1 << 16), (3, 15000, 1 << 16), (3, 300, 5)])
def test_repeats(spark, monkeypatch, frequent, shard_bytes, parts):
    monkeypatch.setattr(R, "FREQUENT", frequent)
    monkeypatch.setattr(R, "MOST_PARTS", parts)
    rows = passages()
    got = {r[0]: tuple(r[1:5]) for r in R.remove_repeats(documents(spark, rows).repartition(5), shard_bytes=shard_bytes).collect()}
    assert got == cut(rows)


def test_repeats_odd_rows(spark):
    docs = odd_documents(spark)
    rows = R.remove_repeats(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d.doc_id for d in docs.collect())
    # Documents in order: null first, then by id; which of rows with one id comes first is free, so compare totals.
    ordered = sorted(docs.collect(), key=lambda d: (d.doc_id is not None, d.doc_id or 0, len(d.text or "")))
    want = cut([(k, d.text) for k, d in enumerate(ordered)])
    assert sum(r.n_removed for r in rows) == sum(v[1] for v in want.values())
    for r in rows:
        assert len(r.kept) == r.n_bytes - r.n_removed and sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


@pytest.mark.parametrize("depth", [1, 7, 20, 100])
def test_suffix_array(depth):
    rng = np.random.default_rng(depth)
    text = np.concatenate([rng.integers(1, 3, 300), np.ones(150), rng.integers(1, 3, 50), [0]]).astype(np.int16)
    text = np.concatenate([text, text])
    sa = R.suffix_array(text, depth)
    heads = [tuple(text[i : i + depth]) for i in sa]
    assert sorted(sa) == list(range(len(text))) and heads == sorted(heads)


def test_common_prefixes():
    rng = np.random.default_rng(2)
    size = np.array([40, 90, 5, 200])
    text = np.concatenate([x for n in size for x in (rng.integers(1, 3, n), [0])]).astype(np.int16)
    start = np.cumsum(size + 1) - size - 1
    for depth in (10, 300):
        sa = R.suffix_array(text, depth)
        got = R.common_prefixes(text, sa, start, size, 12)
        for a, b in zip(sa[:-1], sa[1:], strict=True):
            n = 0
            while n < 12 and max(a, b) + n < len(text) and text[a + n] == text[b + n] != 0:
                n += 1
            if text[b]:
                assert got[b] == n


def test_empty_tables(spark):
    assert E.exact_dedup(empty(spark)).count() == 0 and S.simhash_dedup(empty(spark)).count() == 0 and R.remove_repeats(empty(spark)).count() == 0
    assert E.without_exact_copies(empty(spark)).count() == 0
