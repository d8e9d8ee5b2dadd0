"""Treaps against their cells, searches against scores of all documents."""

import collections
import math
import re
import tracemalloc
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from postlens.llm import lexical_search as search
from postlens.llm.common import terms
from tests.llm.conftest import ODD_TEXTS, texts_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=20):
    """docs: (doc_id, text); items: (item_id, text). Rows of every item, best first."""
    words = [(i, collections.Counter(split(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(w.total() for _, w in words)
    df = collections.Counter(t for _, w in words for t in w)
    rows = []
    for item, text in items:
        scored = []
        for i, w in words:
            m = 75 + (25 * w.total() * n_docs) // max(n_terms, 1)
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * w[t] // (1000 * w[t] + 12 * m)) for t, n in collections.Counter(split(text)).items() if t in w)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        rows += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return rows


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_terms():
    texts = [t or "" for t in ODD_TEXTS] + ["A-b_C9 ÄÖ x\x00y", "…", "ΣΑΣ İ"]
    owner, codes, distinct = terms(pa.array(["", *texts], pa.large_string())[1:])
    names = distinct.to_pylist()
    for i, t in enumerate(texts):
        assert [names[c] for c in codes[owner == i]] == split(t), repr(t)


@pytest.mark.parametrize("size", [1, 2, 7, 300])
def test_cells_come_back(size):
    rng = np.random.default_rng(size)
    cells = {(int(r), int(c)): int(v) for r, c, v in zip(rng.integers(0, size, 4 * size), rng.integers(0, size // 2 + 1, 4 * size), rng.integers(1, 1_000_000, 4 * size), strict=True)}
    rows, columns, impacts = (np.array(x, np.int64) for x in (*zip(*cells, strict=True), list(cells.values())))
    tree = search.Treap.build(rows, columns, impacts)
    assert np.array_equal(search.from_planes(search.planes(tree.drops)), tree.drops)
    opened = tree.open()
    for row in range(size):
        got = dict(zip(*(x.tolist() for x in opened.best(np.array([row]), np.array([3]), 10**6)), strict=True))
        assert got == {c: 3 * v for (r, c), v in cells.items() if r == row}


@pytest.mark.parametrize("top", [1, 5])
def test_best_first_keeps_ties(top):
    rng = np.random.default_rng(top)
    grid = rng.integers(0, 4, (40, 500)) * (rng.random((40, 500)) < 0.3)
    rows, columns = np.nonzero(grid)
    opened = search.Treap.build(rows, columns, grid[rows, columns]).open()
    for _ in range(20):
        chosen, weights = rng.choice(40, 6, replace=False), rng.integers(1, 5, 6)
        total = weights @ grid[chosen]
        least = max(1, np.sort(total)[-top])
        got = dict(zip(*(x.tolist() for x in opened.best(chosen, weights, top)), strict=True))
        assert got == {c: int(total[c]) for c in np.flatnonzero(total >= least)}


def test_opens_few_ranges(monkeypatch):
    rows, columns = (x.ravel() for x in np.meshgrid(np.arange(8), np.arange(4096), indexing="ij"))
    impacts = np.where(columns == 1234, 900_000, 1000 + rows * 7 + columns % 13)
    cells = search.Treap.build(rows, columns, impacts).open()
    opened = []
    count = np.bincount
    monkeypatch.setattr(search.np, "bincount", lambda x, *a: opened.append(a[-1]) or count(x, *a))
    columns, scores = cells.best(np.arange(8), np.ones(8, np.int64), 1)
    assert columns.tolist() == [1234] and scores.tolist() == [7_200_000] and sum(opened) < 1000  # of 8,191 ranges


@pytest.mark.parametrize("block_docs,batch_bytes", [(search.BLOCK_DOCS, search.BATCH_BYTES), (16, 3000)])
def test_documents(spark, sf_dir, block_docs, batch_bytes):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = search.rank_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), block_docs=block_docs, batch_bytes=batch_bytes)
    assert dict(got.dtypes)["rank"] == "int" and rows_of(got) == sorted(plain(texts_of(spark, sf_dir), items), key=str)


def test_odd_rows(spark, odd_docs, no_docs):
    items = [(1, "same text of a few words"), (2, None), (3, ""), (4, "tie TIE 1234"), (4, "nothing like it, a null id"), (None, "w5 w5 w59999"), (6, "été Ünïcode ß")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert rows_of(search.rank_documents(odd_docs, bench)) == sorted(plain(docs, items), key=str)
    assert search.rank_documents(no_docs, bench).collect() == []
    assert search.rank_documents(odd_docs, bench.limit(0)).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert search.rank_documents(nothing, bench).collect() == []


def many_words():
    rng = np.random.default_rng(0)
    return [" ".join(f"w{i}" for i in rng.zipf(1.3, 2000) % 5000) for _ in range(900)]


def test_a_large_block_is_a_row_group(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(many_words())), "doc_id long, text string").coalesce(1)
    search.index(docs, str(tmp_path / "treaps"), search.Corpus(900, 1_800_000), block_docs=300)
    found = [pq.ParquetFile(f).metadata for f in (tmp_path / "treaps").glob("*.parquet")]
    assert [[m.row_group(i).num_rows for i in range(m.num_row_groups)] for m in found] == [[1, 1, 1]]


def test_words_of_a_block_are_not_held_at_once():
    texts = many_words()
    size = sum(map(len, texts))
    docs = MagicMock()
    search.index(docs, "", search.Corpus(900, 1_800_000))
    blocks = docs.select.return_value.mapInArrow.call_args.args[0]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(900), pa.int64()), "text": texts})
    tracemalloc.start()
    built = list(blocks(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(built) == 1 and size > 3 * search.SLICE_BYTES and most < 8 * size


def test_a_search_gets_blocks_one_at_a_time(spark, sf_dir, monkeypatch):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"item_id": pa.array([0], pa.int64()), "rank": pa.array([1], pa.int32()), "doc_id": pa.array([0], pa.int64()), "score": pa.array([batch.num_rows], pa.int64())})

    monkeypatch.setattr(search, "search", lambda blocks, *_: blocks.mapInArrow(sizes, "item_id long, rank int, doc_id long, score long"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(1)
    got = [r.score for r in search.rank_documents(docs, spark.createDataFrame([(7, "a")], "item_id long, text string"), block_docs=16).collect()]
    assert len(got) > 10 and set(got) == {1} and spark.conf.get(key) == before
    with pytest.raises(ValueError), search.row_by_row(spark):
        raise ValueError
    assert spark.conf.get(key) == before
