import random

import numpy as np
import pyarrow as pa
import pytest

from postlens.llm import near_dup
from postlens.llm.components import connected_components
from tests.llm.conftest import texts_of


def plain(texts, width, percent=80):
    """doc_id: (set size, component), by comparing all pairs."""
    def sets(text):
        w = (text or "").encode().lower().split()
        return frozenset(zip(*(w[i:] for i in range(width)))) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()

    have = [(k, sets(t)) for k, t in texts]
    root = {k: k for k, _ in have}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(have):
        for b, t in have[i + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in have}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("width", [2, 5])
def test_documents(spark, sf_dir, width):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = near_dup.near_duplicates(docs, near_dup.Setting(width=width))
    assert result(rows) == plain(texts_of(spark, sf_dir), width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows.collect())


def family(n, seed=1):
    """Copies of one text with few or many changed words, and texts that share a passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)]
    out = []
    for i in range(n):
        own = list(words)
        for _ in range(rng.randint(0, 14)):
            own[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        out.append((i, " ".join(own)))
    shared = " ".join(f"p{i}" for i in range(60))
    out += [(n + i, shared + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randint(5, 40)))) for i in range(n)]
    return out


@pytest.mark.parametrize("block_rows", [1024, 16])
def test_large_group_in_one_or_many_blocks(spark, block_rows):
    texts = family(150)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert result(near_dup.near_duplicates(docs, near_dup.Setting(width=2, block_rows=block_rows))) == plain(texts, 2)


def test_hot_copies_are_one_node(spark):
    texts = [(i, "the very same words in each of these many documents") for i in range(300)] + [(1000 + i, f"text number {i} has words of its own here") for i in range(5)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    assert result(near_dup.near_duplicates(docs)) == plain(texts, 5)


def test_odd_rows(spark, odd_docs, no_docs):
    assert near_dup.near_duplicates(no_docs).count() == 0
    rows = near_dup.near_duplicates(odd_docs, near_dup.Setting(width=2)).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for r in by[14] + by[15] + by[16]} == {14}
    assert all(r.kept and r.component_id is None for r in by[None])
    assert by[0][0].n_shingles == 0 and by[0][0].component_id == 0 and by[1][0].component_id == 1
    assert by[3][0].n_shingles == 1 and by[5][0].n_shingles == 1


@pytest.mark.parametrize("turn", range(4))
def test_repeated_id_with_an_empty_text(spark, turn):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, ""), (2, text + " more"), (3, "less " + text), (1, None)]
    docs = spark.createDataFrame(rows[turn:] + rows[:turn], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, near_dup.Setting(width=2)).collect())
    assert got == [(1, 0, 1), (1, 0, 1), (1, 59, 1), (2, 60, 1), (3, 60, 1)]


def test_multi_index_guarantee():
    """Any two signatures that differ in at most the guaranteed number of components share a key."""
    s, rng = near_dup.Setting(), np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 256, s.components, dtype=np.uint8)
        b = a.copy()
        places = rng.permutation(s.components)[: s.guaranteed]
        b[places] ^= np.uint8(1)
        keys = near_dup.chunk_keys(np.stack([a, b]), s)
        assert (keys[0] == keys[1]).any()
    exact = near_dup.Setting(chunks=3, chunk=4, errors=2)
    assert exact.guaranteed == 8 and near_dup.chunk_keys(a[None, :12], exact).shape == (1, 3 * 6)


def test_signatures_estimate_similarity():
    base = [f"w{i}" for i in range(400)]
    other = base[:300] + [f"v{i}" for i in range(100)]
    owner, x = near_dup.shingles(pa.array([" ".join(base), " ".join(other)], pa.large_string()), 2)
    _, sig = near_dup.signatures(owner, x, 2000)
    assert abs((sig[0] == sig[1]).mean() - 299 / 499) < 0.05


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(1, 200)] + [(1, None), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}
    for a, b in pairs:
        if b is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    change = True
    while change:
        change = False
        for a, b in pairs:
            if a in root and b in root and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                change = True
    assert got == root
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
