"""Near copies by similarity, against brute force."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import documents, empty, lowered, odd_documents, words

import corpus_pipeline
from rasterloom.llm import similar as N


def shingles(text):
    w = words(lowered(text).decode())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def kept(rows):
    """Indexes of (doc_id, text) that stay: the first, by id, of each component of similar pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    order = sorted(root, key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    for at, i in enumerate(order):
        for j in order[:at]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    seen, out = set(), []
    for i in order:
        if root[i] not in seen:
            seen.add(root[i])
            out.append(i)
    return out


def corpus():
    """Texts, and copies of them with words replaced or a tail added, down to far below 0.8; a line that many have."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(400)]
    line = "this very common line of a page stands in many of its texts".split()
    rows = []
    for base in range(24):
        w = [vocabulary[k] for k in rng.integers(0, 400, int(rng.integers(4, 260)))]
        for copy in range(int(rng.integers(1, 9))):
            c = list(w)
            for _ in range(int(rng.integers(0, 1 + len(w) // 45))):
                c[int(rng.integers(0, len(c)))] = f"new{rng.integers(0, 1 << 40)}"
            c += [vocabulary[k] for k in rng.integers(0, 400, int(rng.integers(0, 1 + len(w) // 12)))]
            text = " ".join(line + c if base % 3 == 0 else c)
            rows.append((int(rng.integers(0, 10**9)), text.upper() if copy % 3 == 2 else text))
    return rows


@pytest.mark.parametrize(("pairs", "rounds"), [(4, 6), (0, 1)])
def test_similar_against_brute_force(spark, monkeypatch, pairs, rounds):
    monkeypatch.setattr(N.similar_links, "__defaults__", (pairs, rounds))
    monkeypatch.setattr(N, "SAMPLE", 2)
    rows = corpus()
    want = sorted(rows[k][0] for k in kept(rows))
    assert len(want) < len(rows) - 20
    assert sorted(r.doc_id for r in N.without_similar(documents(spark, rows).repartition(5)).collect()) == want


def test_stage_drops_near_copies(spark):
    rng = np.random.default_rng(1)
    w = [f"w{k}" for k in rng.integers(0, 500, 88)]
    copy = " ".join([*w[:44], "other", *w[45:]])  # 79 of 89 shingles: 0.888
    far = " ".join([*w[:20], "a", *w[21:44], "b", *w[45:70], "c", *w[71:]])
    docs = documents(spark, [(1, " ".join(w)), (2, copy), (3, far)])
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()) == [1, 3]


def test_similarity_is_inclusive():
    a = np.arange(9, dtype=np.uint64)
    assert N.similar(a, np.append(a[1:], np.uint64(50))) and not N.similar(a, np.append(a[2:], np.uint64(50)))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    left = N.without_similar(docs)
    assert left.columns == docs.columns
    got = [shingles(r.text) for r in left.collect()]
    assert sorted(map(sorted, got)) == sorted(sorted(shingles(rows[k][1])) for k in kept(rows))
    assert N.without_similar(empty(spark)).count() == 0


def test_pairs_of_a_large_group_of_near_copies(spark, monkeypatch):
    """Many edits of one text, a part of them similar: all copies go, without comparing the square of the group."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 300, 150)]
    rows = []
    for k in range(300):
        w = list(base)
        for at in rng.integers(0, len(w), int(rng.integers(0, 16))):
            w[at] = f"w{rng.integers(0, 300)}"
        rows.append((k, " ".join(w)))
    compared, verified = [], N._Sets.verified

    def counting(self, pairs):
        compared.append(pairs.count())
        return verified(self, pairs)

    monkeypatch.setattr(N._Sets, "verified", counting)
    want = kept(rows)
    assert 10 < len(want) < 290
    assert sorted(r.doc_id for r in N.without_similar(documents(spark, rows).repartition(3)).collect()) == sorted(rows[k][0] for k in want)
    assert sum(compared) < 20 * len(rows), compared


def test_order_of_shingles(spark):
    """Shingles of one text stand first, then those of few texts; what stands before a shingle is counted."""
    rows = documents(spark, [(k, "one two three four five " + ("six " if k < 2 else "") + f"own{k}") for k in range(9)])
    counts = N._Counted(rows, 1)
    table = lambda name, column, kind: N.mapped(counts.folder, f"{name}.{column}", kind)
    group = next(N.grouped(N.pa.array([r.text for r in rows.where("doc_id = 0").collect()])))
    h, bounds = N.shingle_sets(group)
    late = counts.late(h, table)
    assert sorted(late.tolist()) == [0, 2, 4]  # of 1, 2 and 9 texts
    at, before = N.prefixes(h, bounds, late)
    assert late[at].tolist() == [0] and before.tolist() == [0]
