"""Cross-tokenizer alignment: two token sequences of each text, cut at shared ends into windows whose alignments repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import HELD, distinct_sorted, ragged, shared_path, starts_of, text_bytes, text_slices
from postlens.llm.pieces import JsonTokenizer, PieceTokenizer, tokenizer_path

SLICE, MOST_WINDOWS, MOST_PIECES, MOST_PAIRS, SUMS_HELD = 2 << 20, 80_000, 600_000, 4_000_000, 1_000_000
MARK = "▁"


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(MARK, " ").encode("utf-8", "surrogatepass")


class Side:
    """One tokenizer: ids of texts, and by id a token's bytes, their number and whether they begin with a space."""

    def __init__(self, tokens: list[bytes], encode):
        self.tokens, self.encode = tokens, encode
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.spaced = np.array([t[:1] == b" " for t in tokens])
        self.flat, self.start = np.frombuffer(b"".join(tokens), np.uint8), starts_of(self.length)
        self.names = pa.array(range(len(tokens))).cast(pa.string())

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.start[ids], self.length[ids])]


class Windows:
    """Alignments of token-id windows, remembered by their ids: groups, links, the groups as text, linked id pairs.

    Two generations of at most `most` windows: those in use move from the old one to the new one, the rest go."""

    def __init__(self, left: Side, right: Side, most: int = MOST_WINDOWS):
        self.left, self.right, self.most = left, right, most
        self.new: dict[bytes, tuple[int, int, str, np.ndarray]] = {}
        self.old: dict[bytes, tuple[int, int, str, np.ndarray]] = {}

    def get(self, keys: list[bytes]) -> list[tuple[int, int, str, np.ndarray]]:
        if len(self.new) + len(keys) > self.most:
            self.old, self.new = self.new, {}
        found = [self.new.get(k) or self.old.get(k) for k in keys]
        missing = [k for k, f in zip(keys, found, strict=True) if f is None]
        made = dict(zip(missing, self._align(missing), strict=True))
        found = [made[k] if f is None else f for k, f in zip(keys, found, strict=True)]
        self.new.update(zip(keys, found, strict=True))
        return found

    def _align(self, keys: list[bytes]) -> list[tuple[int, int, str, np.ndarray]]:
        """All windows at once: their tokens' ends on one line, one window after another."""
        if not keys:
            return []
        flat, size = np.frombuffer(b"".join(keys), np.uint32).astype(np.int64), np.fromiter(map(len, keys), np.int64, len(keys)) // 4
        first = starts_of(size)
        n_a = flat[first]
        n_b = size - 1 - n_a
        a, b = flat[ragged(first + 1, n_a)], flat[ragged(first + 1 + n_a, n_b)]
        end_a, end_b = np.cumsum(self.left.length[a]), np.cumsum(self.right.length[b])
        # A stretch between neighbouring ends lies in one token on each side: these are the links.
        ends = distinct_sorted(np.concatenate([end_a, end_b]))
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        pairs = a[at_a] * len(self.right.tokens) + b[at_b]
        links = np.diff(np.searchsorted(ends, np.concatenate([[0], end_a[np.cumsum(n_a) - 1]]), side="right"))
        both = (end_a[at_a] == ends) & (end_b[at_b] == ends)
        shared_a, shared_b = at_a[both] + 1, at_b[both] + 1  # tokens up to the end of each group
        groups = np.diff(np.searchsorted(shared_a, np.concatenate([[0], np.cumsum(n_a)]), side="right"))
        joined = [pc.binary_join(_lists(side.names.take(pa.array(x)), shared), ",") for side, x, shared in ((self.left, a, shared_a), (self.right, b, shared_b))]
        named = pc.binary_join(_lists(pc.binary_join_element_wise(*joined, "|"), np.cumsum(groups)), ";").to_pylist()
        ends = np.cumsum(links).tolist()
        return [(g, n, text, pairs[e - n : e]) for g, n, text, e in zip(groups.tolist(), links.tolist(), named, ends, strict=True)]


def _lists(flat: pa.Array, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), flat)


class Aligner:
    """Both tokenizers, with what they and their windows have given so far."""

    def __init__(self, left: str, right: str):
        coder, counter = JsonTokenizer(tokenizer_path(left)), PieceTokenizer(tokenizer_path(right))
        coder.library.encode_special_tokens = True
        coder.cache.most = counter.cache.most = MOST_PIECES
        letters, library = byte_alphabet(), counter.library
        names = [coder.library.id_to_token(i) for i in range(coder.library.get_vocab_size())]
        self.left = Side([bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names], coder.encode)
        self.right = Side([piece_bytes(library.id_to_piece(i)) for i in range(library.get_piece_size())], counter.encode)
        self.windows = Windows(self.left, self.right)

    def align(self, texts: pa.Array) -> dict[str, list | np.ndarray]:
        """By text: n_a, n_b, n_groups, n_links, groups (as text, empty without tokens), and its distinct linked pairs with how
        many links each has, flat, with their number by text."""
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
        size = text_bytes(spaced)
        n_a, a = self.left.encode(texts, True)
        n_b, b = self.right.encode(texts)
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = (text_bytes(texts) > 0) & self._spelled(self.left, n_a, a, spaced, size) & self._spelled(self.right, n_b, b, spaced, size)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b, size = np.where(good, n_a, 0), np.where(good, n_b, 0), np.where(good, size, 0)
        out = {"n_a": n_a, "n_b": n_b}
        owner, lists, code = self._windows(a, b, n_a, n_b, size)
        groups, links = np.array([w[0] for w in lists], np.int64), np.array([w[1] for w in lists], np.int64)
        out["n_groups"] = np.bincount(owner, groups[code], len(size)).astype(np.int64) if len(code) else np.zeros(len(size), np.int64)
        out["n_links"] = np.bincount(owner, links[code], len(size)).astype(np.int64) if len(code) else np.zeros(len(size), np.int64)
        strings, codes, ends = [w[2] for w in lists], code.tolist(), np.cumsum(np.bincount(owner, minlength=len(size))).tolist()
        out["groups"] = [";".join(map(strings.__getitem__, codes[s:e])) for s, e in zip([0, *ends[:-1]], ends, strict=True)]
        out["pairs"], out["pair_links"], out["n_pairs"] = self._pairs(owner, code, lists, links, len(size))
        return out

    @staticmethod
    def _spelled(side: Side, n: np.ndarray, ids: np.ndarray, spaced: pa.Array, size: np.ndarray) -> np.ndarray:
        """Whether each text's tokens spell it; where lengths agree for all, bytes are compared all at once."""
        first = starts_of(n)
        length = np.add.reduceat(np.append(side.length[ids], 0), first) * (n > 0)
        data = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)
        ends = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset :]
        same = length == size
        if same.all() and np.array_equal(side.spell(ids), data[ends[0] : ends[len(size)]]):
            return same
        for i in np.flatnonzero(same).tolist():
            same[i] = np.array_equal(side.spell(ids[first[i] : first[i] + n[i]]), data[ends[i] : ends[i + 1]])
        return same

    def _windows(self, a, b, n_a, n_b, size) -> tuple[np.ndarray, list, np.ndarray]:
        """Windows between anchors in order: their text, the distinct ones' alignments, and which of these each is.

        An anchor is an end that both sides share, before a space-marked token on both, or a text's end."""
        if not len(a):
            return np.zeros(0, np.int64), [], np.zeros(0, np.int64)
        end_a, end_b = np.cumsum(self.left.length[a]), np.cumsum(self.right.length[b])
        text_end = np.zeros(int(size.sum()) + 1, bool)
        text_end[np.cumsum(size)] = True
        open_b = np.append(self.right.spaced[b[1:]], True) | text_end[end_b]
        ends = np.zeros(len(text_end), bool)
        ends[end_b[open_b]] = True
        last_a = np.flatnonzero((np.append(self.left.spaced[a[1:]], True) | text_end[end_a]) & ends[end_a])
        at = end_a[last_a]
        last_b = np.searchsorted(end_b, at)
        from_a, from_b = np.concatenate([[0], last_a[:-1] + 1]), np.concatenate([[0], last_b[:-1] + 1])
        len_a, len_b = last_a + 1 - from_a, last_b + 1 - from_b
        # A window as bytes: the number of its left ids, these, then its right ids, 32 bits each.
        total = 1 + len_a + len_b
        start = starts_of(total)
        flat = np.empty(int(total.sum()), np.uint32)
        flat[start] = len_a
        flat[ragged(start + 1, len_a)] = a
        flat[ragged(start + 1 + len_a, len_b)] = b
        offsets = np.append(start, len(flat)) * 4
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(total), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()
        owner = np.searchsorted(np.cumsum(size), at)
        return owner, self.windows.get(coded.dictionary.to_pylist()), coded.indices.to_numpy().astype(np.int64)

    @staticmethod
    def _pairs(owner, code, lists, links, n) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(code):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
        key = np.sort(owner * len(lists) + code)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times, text, window = np.diff(np.append(first, len(key))), key[first] // len(lists), key[first] % len(lists)
        flat, start = np.concatenate([w[3] for w in lists]), starts_of(links)
        pair, times, text = flat[ragged(start[window], links[window])], np.repeat(times, links[window]), np.repeat(text, links[window])
        # Pairs below 2^32 and their text in one number, as those of public vocabularies are.
        wide = int(flat.max()) + 1
        if wide > 1 << 40:
            raise ValueError("vocabularies too large")
        order = np.argsort(text * wide + pair)
        key = (text * wide + pair)[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[first] % wide, np.add.reduceat(times[order], first), np.bincount(key[first] // wide, minlength=n)


@lru_cache(maxsize=1)
def aligner(left: str, right: str) -> Aligner:
    """One per worker process."""
    return Aligner(left, right)



HELD.append(aligner.cache_clear)

ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, pair_links binary"
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def groups_of(docs: DataFrame, left: str, right: str) -> DataFrame:
    """doc_id, groups: the alignment itself, `a1,a2|b1;a3|b2,b3` with decimal ids, '' where a text has no tokens."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(left, right)
        for batch, texts in text_slices(batches, limit=SLICE, keep_held=True):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(both.align(texts)["groups"], pa.string())], names=["doc_id", "groups"])

    return docs.select("doc_id", "text").mapInArrow(align, "doc_id long, groups string")


def aligned(docs: DataFrame, left: str, right: str, path: str) -> DataFrame:
    """The alignment of every text, written to `path`; pairs are coded left id x right vocabulary + right id."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, row = aligner(left, right), TaskContext.get().partitionId() << 40
        for batch, texts in text_slices(batches, limit=SLICE, keep_held=True):
            r = both.align(texts)
            ends = np.concatenate([[0], np.cumsum(r["n_pairs"])])
            binary = [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends * width), pa.py_buffer(x.astype(kind))]).cast(pa.binary()) for x, kind, width in ((r["pairs"], np.int64, 8), (r["pair_links"], np.uint32, 4))]
            digest = pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in r["groups"]])
            rows = pa.array(row + np.arange(len(texts)))
            row += len(texts)
            yield pa.RecordBatch.from_arrays([rows, batch.column("doc_id"), *(pa.array(r[c]) for c in ("n_a", "n_b", "n_groups", "n_links")), digest, *binary], names=[x.split()[0] for x in ALIGNED.split(", ")])

    docs.select("doc_id", "text").mapInArrow(align, ALIGNED).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(ALIGNED).parquet(path)


def _flat(batch: pa.RecordBatch, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), kind)


def pair_counts(rows: DataFrame, right_size: int) -> DataFrame:
    """pair, n (documents that hold it linked), best (whether no other pair of its left id has more)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            new = _flat(batch, "pairs", np.int64)
            both, times = np.concatenate([pairs, new]), np.concatenate([n, np.ones(len(new), np.int64)])
            order = np.argsort(both, kind="stable")
            both, times = both[order], times[order]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
            pairs, n = both[first], np.add.reduceat(times, first) if len(first) else n
            if len(pairs) > SUMS_HELD:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])
                pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

    sums = rows.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    most = sums.groupBy(F.expr(f"pair div {right_size}").alias("left")).agg(F.max("n").alias("most"))
    return sums.withColumn("left", F.expr(f"pair div {right_size}")).join(most, "left").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(rows: DataFrame, counts: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """rows with n_best and count_sum. Up to most_pairs pairs (17 bytes each) are sent to tasks; more are joined to the
    documents' pairs, one row each."""
    spark = rows.sparkSession
    if counts.count() > most_pairs:

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = pc.binary_length(batch.column("pairs")).to_numpy(zero_copy_only=False) // 8
                at = pa.array(np.repeat(np.arange(batch.num_rows), n))
                yield pa.RecordBatch.from_arrays([batch.column("row").take(at), pa.array(_flat(batch, "pairs", np.int64)), pa.array(_flat(batch, "pair_links", np.uint32).astype(np.int64))], names=["row", "pair", "links"])

        each = rows.select("row", "pairs", "pair_links").mapInArrow(spread, "row long, pair long, links long").join(counts, "pair")
        sums = each.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
        return rows.join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})
    table = counts.toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in batches:
            size = pc.binary_length(batch.column("pairs")).to_numpy(zero_copy_only=False) // 8
            at, links = np.searchsorted(pair, _flat(batch, "pairs", np.int64)), _flat(batch, "pair_links", np.uint32).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(size)])
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (links * best[at], links * n[at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums)], names=[*names, "n_best", "count_sum"])

    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return rows.mapInArrow(look, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def align_documents(docs: DataFrame, left: str = "byte_bpe_50k.json", right: str = "piece_bpe_32k.model", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every whole text.

    Null and empty texts, and those whose tokens on either side do not spell a space and the text, have zeros and ''. Rows that
    repeat are documents of their own, in the result and in the counts; a null doc_id stays null. Alignments are
    written to the shared folder once, then counted and read again. Other columns are not read; an empty table gives no
    rows."""
    rows = aligned(docs, left, right, shared_path(docs.sparkSession, "aligned"))
    counts = pair_counts(rows, _vocabulary(right))
    return with_counts(rows, counts, most_pairs).select(*(x.split()[0] for x in DIGEST.split(", ")))


def _vocabulary(name: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name)).get_piece_size()
