"""Alignments against a plain walk over both libraries' tokens; counts over all documents; both ways to join them."""

import collections
import hashlib

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from postlens.llm import alignment
from postlens.llm.pieces import tokenizer_path
from tests.llm.conftest import ODD_TEXTS, texts_of
from tests.llm.test_tokens import noise

LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def plain():
    left, right, letters = Tokenizer.from_file(tokenizer_path(LEFT)), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(RIGHT)), alignment.byte_alphabet()
    left.encode_special_tokens = True

    def walk(text):
        """Ids of both sides, links in order and the groups."""
        whole = (" " + (text or "")).encode()
        a, b = left.encode(" " + (text or ""), add_special_tokens=False).ids, right.encode(text or "")
        spelled = [[bytes(letters[c] for c in left.id_to_token(i)) for i in a], [alignment.piece_bytes(right.id_to_piece(i)) for i in b]]
        if not text or any(b"".join(s) != whole for s in spelled):
            return [], [], [], ""
        owners = [[k for k, t in enumerate(s) for _ in t] for s in spelled]
        links = sorted(set(zip(*owners, strict=True)))
        groups, ids_a, ids_b = [], [], []
        for at in range(len(whole)):
            ends = [at + 1 == len(whole) or o[at + 1] != o[at] for o in owners]
            if ends[0]:
                ids_a.append(str(a[owners[0][at]]))
            if ends[1]:
                ids_b.append(str(b[owners[1][at]]))
            if all(ends):
                groups.append(f"{','.join(ids_a)}|{','.join(ids_b)}")
                ids_a, ids_b = [], []
        return a, b, [(a[i], b[j]) for i, j in links], ";".join(groups)

    return walk


@pytest.mark.parametrize("most", [300_000, 40])
def test_every_text(plain, most):
    both = alignment.Aligner(LEFT, RIGHT)
    both.windows.most = most
    texts = [t or "" for t in ODD_TEXTS if len(t or "") < 1000] + noise(300) + ["▁ mark", "a" * 300, "<0x41> <s>", "é漢 🙂 x", "�", " "]
    for low in range(0, len(texts), 53):
        part = texts[low : low + 53]
        got, at = both.align(pa.array(part, pa.large_string())), 0
        for k, text in enumerate(part):
            a, b, links, groups = plain(text)
            n = int(got["n_pairs"][k])
            pairs = dict(zip(got["pairs"][at : at + n].tolist(), got["pair_links"][at : at + n].tolist(), strict=True))
            at += n
            assert (len(a), len(b), len(links), groups) == (got["n_a"][k], got["n_b"][k], got["n_links"][k], got["groups"][k]), repr(text)
            assert got["n_groups"][k] == (groups.count(";") + 1 if groups else 0)
            assert pairs == collections.Counter(x * len(both.right.tokens) + y for x, y in links)


def digests(rows, plain):
    """rows: (doc_id, text) of all documents."""
    walked = [(i, *plain(t)) for i, t in rows]
    counts = collections.Counter(p for *_, links, _ in walked for p in set(links))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(n, most.get(a, 0))
    return sorted(
        ((i if i is not None else -9, len(a), len(b), g.count(";") + 1 if g else 0, len(l), sum(counts[p] == most[p[0]] for p in l), sum(counts[p] for p in l), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, a, b, l, g in walked)
    )


def result(df):
    return sorted((r.doc_id if r.doc_id is not None else -9, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.mark.parametrize("most_pairs", [alignment.MOST_PAIRS, 0])
def test_documents(spark, sf_dir, odd_docs, no_docs, plain, most_pairs, monkeypatch):
    monkeypatch.setattr(alignment, "SUMS_HELD", 100)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    short = docs.where("length(text) < 1500")
    assert result(alignment.align_documents(short, most_pairs=most_pairs)) == digests([r for r in texts_of(spark, sf_dir) if len(r[1] or "") < 1500], plain)
    odd = odd_docs.where("coalesce(length(text), 0) < 1000")
    assert result(alignment.align_documents(odd, most_pairs=most_pairs)) == digests([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], plain)
    assert alignment.align_documents(odd_docs, most_pairs=most_pairs).count() == odd_docs.count()
    assert alignment.align_documents(no_docs, most_pairs=most_pairs).collect() == []


def test_groups_spell_the_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    texts = {r.doc_id: r.text for r in docs.collect()}
    library = Tokenizer.from_file(tokenizer_path(LEFT))
    for r in alignment.groups_of(docs, LEFT, RIGHT).collect():
        assert library.decode([int(i) for g in r.groups.split(";") for i in g.split("|")[0].split(",")], skip_special_tokens=False) == " " + texts[r.doc_id]
