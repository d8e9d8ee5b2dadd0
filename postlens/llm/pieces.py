"""Token ids of whole texts from a public tokenizer that sees every distinct piece of a worker's texts once.

A text is cut where no token can span the cut, so the ids of its pieces, one after another, are the ids of the text:
at white space after a character that is none (`tokenizers` files), or at a space after another character
(SentencePiece, whose leading space marker stands for that space). Pieces repeat far more than texts do."""

from __future__ import annotations

import gc
import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from postlens.llm.common import HELD, ragged, starts_of

CHUNK = re.compile(r"\s*\S+|\s+")


def _stop_letters() -> str:
    """Digits and letters below U+0250 as a pattern's class, without those that lower-casing turns into several characters
    (a dotted capital I gets a mark, which then joins what follows)."""
    points = [c for c in range(0x250) if chr(c).isalnum() and (c < 0x80 or c >= 0xC0) and len(chr(c).lower()) == 1]
    breaks = [i for i in range(1, len(points)) if points[i] != points[i - 1] + 1]
    runs = zip([0, *breaks], [*breaks, len(points)], strict=True)
    return "".join(rf"\x{{{points[a]:x}}}-\x{{{points[b - 1]:x}}}" for a, b in runs)


# A letter or digit before a full stop or comma ends a pre-token in both vocabularies, as does any character before a
# line end. The mark says that no space was there.
STOP = (rf"([{_stop_letters()}])([.,])", "\\1 \x1f\\2")
LINE = (r"([^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}])\n", "\\1 \x1f\n")
ODD = re.compile("[\x1c-\x1f\x85]")
CUT = re.compile(r"(?<=[^ ]) (?= *[^ ])")
# Pieces with white space at an end, none at all, or control characters that the libraries take differently.
_SPACE = r"[\s\x0b\x1c-\x1e\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ODD_EDGE = rf"\A\z|\A{_SPACE}|{_SPACE}\z"
MOST_PIECES = 2_000_000


class HashTable:
    """64-bit hashes (not 0) and a number for each: open addressing, many at a time. A few tens of bytes an entry."""

    def __init__(self, bits: int = 16):
        self.keys, self.values, self.size = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it is not there."""
        mask = np.uint64(len(self.keys) - 1)
        out, left, slot = np.full(len(h), -1, np.int64), np.arange(len(h)), h & mask
        while len(left):
            key = self.keys[slot]
            hit = key == h[left]
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & (key != 0)
            left, slot = left[on], (slot[on] + np.uint64(1)) & mask
        return out

    def add(self, h: np.ndarray, values: np.ndarray):
        """New hashes, each once."""
        self.size += len(h)
        if 2 * self.size > len(self.keys):
            old, numbers = self.keys[self.keys != 0], self.values[self.keys != 0]
            bits = int(2 * self.size).bit_length()
            self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
            self._put(old, numbers)
        self._put(h, values)

    def _put(self, h: np.ndarray, values: np.ndarray):
        mask = np.uint64(len(self.keys) - 1)
        slot = h & mask
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]  # of several for one slot, one stays
            won = free & (self.keys[slot] == h)
            self.values[slot[won]] = values[won]
            h, values, slot = h[~won], values[~won], (slot[~won] + np.uint64(1)) & mask


class PieceCache:
    """Ids of pieces, kept flat. `encode` gives the ids of a list of pieces.

    A piece is known by a 64-bit hash and by its length, not by its characters: two of ten million pieces are taken for one
    another with a chance of about one in a million. At most `most` pieces (MOST_PIECES if None), but for those of one
    call, in two generations: when the new one is half of that, it becomes the old one, whose pieces move to the new
    one as they are met again."""

    def __init__(self, encode, most: int | None = None):
        self.encode, self.most, self.old = encode, most, None
        self.clear()

    def clear(self):
        self.table = HashTable()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.used = 0

    def places(self, pieces: list[str]) -> np.ndarray:
        """A place per piece, for `start` and `length`; missing pieces are encoded, all at once."""
        n = len(pieces)
        h = np.fromiter(map(hash, pieces), np.int64, n).view(np.uint64) + np.fromiter(map(len, pieces), np.uint64, n) * np.uint64(0x9E3779B97F4A7C15)
        h[h == 0] = 1
        found = self.table.find(h)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            if self.table.size and 2 * (self.table.size + len(missing)) > (self.most or MOST_PIECES):
                self.old = self.table, self.flat, self.start, self.length
                self.clear()
                missing = np.arange(n)
            new, first = np.unique(h[missing], return_index=True)
            first = missing[first]
            if self.old:
                table, flat, start, length = self.old
                at = table.find(new)
                held = at >= 0
                self._store(new[held], length[at[held]], flat[ragged(start[at[held]], length[at[held]])])
                new, first = new[~held], first[~held]
            self._add(new, [pieces[i] for i in first.tolist()])
            found = self.table.find(h)
        return found

    def _add(self, h: np.ndarray, pieces: list[str]):
        gc.disable()  # many small lists live for a moment only
        rows = self.encode(pieces)
        gc.enable()
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        self._store(h, lengths, np.fromiter(chain.from_iterable(rows), np.uint32, int(lengths.sum())))

    def _store(self, h: np.ndarray, lengths: np.ndarray, ids: np.ndarray):
        n, total = self.table.size, len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(h) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used : self.used + total] = ids
        self.start[n : n + len(h)] = self.used + starts_of(lengths)
        self.length[n : n + len(h)] = lengths
        self.used += total
        self.table.add(h, np.arange(n, n + len(h)))

    def text_places(self, texts: pa.Array, spaced: bool, odd: str, split, folded: bool = False, after_space: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each text: their number per text, and the place of every piece.

        after_space: a space stands before each text.

        spaced: a piece carries the space before it, and there are cuts at line ends and before stops, too. odd: a
        pattern of pieces beside which a cut might not be safe; their texts go to `split`, which cuts by rule. folded: the tokenizer lower-cases and drops white space, so
        pieces that differ in these only are one; special tokens keep their case."""
        whole = texts
        texts = pc.ascii_lower(texts) if folded else texts
        marked = pc.replace_substring_regex(pc.replace_substring_regex(texts, *STOP), *LINE) if spaced else texts
        lists = pc.split_pattern(marked, " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(lists).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = coded.dictionary
        flagged = pc.match_substring_regex(distinct, odd).to_numpy(zero_copy_only=False)
        first = starts_of(counts)
        strange = np.logical_or.reduceat(flagged[codes], first) if len(codes) else np.zeros(len(counts), bool)
        if spaced:
            strange |= pc.match_substring_regex(whole, ODD.pattern).to_numpy(zero_copy_only=False)
        if folded:
            strange |= pc.match_substring(whole, "<|").to_numpy(zero_copy_only=False)
        own = {int(i): split(" " * after_space + whole[int(i)].as_py()) for i in np.flatnonzero(strange)}
        lead = np.zeros(len(codes), bool)
        lead[first] = spaced and not after_space
        normal = ~np.repeat(strange, counts)
        names, where = [], []
        blank = pa.scalar(" ", distinct.type)
        inner = pc.replace_substring(pc.binary_join_element_wise(pa.scalar("", distinct.type), distinct, blank), " \x1f", "") if spaced else distinct
        if folded:
            inner = pc.utf8_trim_whitespace(inner)
        for group, form in ((normal & ~lead, inner), (normal & lead, distinct)):
            used = np.flatnonzero(np.bincount(codes[group], minlength=len(distinct)))
            to = np.zeros(len(distinct), np.int64)
            to[used] = len(names) + np.arange(len(used))
            names += form.take(pa.array(used)).to_pylist()
            where.append((group, to))
        place = self.places(names + [p for parts in own.values() for p in parts])
        placed = np.zeros(len(codes), np.int64)
        for group, to in where:
            placed[group] = place[to[codes[group]]]
        if not own:
            return counts, placed
        number = counts.copy()
        for i, pieces in own.items():
            number[i] = len(pieces)
        out = np.empty(int(number.sum()), np.int64)
        to = starts_of(number)
        calm = np.flatnonzero(~strange)
        out[ragged(to[calm], counts[calm])] = placed[normal]
        at = len(names)
        for i, pieces in own.items():
            out[to[i] : to[i] + len(pieces)] = place[at : at + len(pieces)]
            at += len(pieces)
        return number, out

    def ids(self, number: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token counts per text, and all ids, one text after another."""
        lengths = self.length[place]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.concatenate([[0], np.cumsum(number)])
        return np.diff(ends[bounds]), self.flat[ragged(self.start[place], lengths)]


class JsonTokenizer:
    """Ids of texts by a `tokenizers` file, without added special tokens, truncation or padding."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cache = PieceCache(self._encode)
        made = json.loads(self.library.to_str())
        kinds = [x["type"] for x in (made["normalizer"] or {}).get("normalizers", [])]
        cuts = [x for x in (made["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        # Words of any case, and nothing of the white space between them.
        self.folded = "Lowercase" in kinds and [(x["behavior"], x["invert"]) for x in cuts] == [("Removed", True)]

    def _encode(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(parts), 4096) for e in self.library.encode_batch_fast(parts[i : i + 4096], add_special_tokens=False)]

    @staticmethod
    def _split(text: str) -> list[str]:
        if not text:
            return []
        return [text] if ODD.search(text) else CHUNK.findall(text)

    def encode(self, texts: pa.Array, after_space: bool = False) -> tuple[np.ndarray, np.ndarray]:
        return self.cache.ids(*self.cache.text_places(texts, True, ODD_EDGE, self._split, self.folded, after_space))


class PieceTokenizer:
    """Token counts of texts by a SentencePiece model, without begin and end tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spans = re.compile("[^▁]▁")
        self.safe = not any(spans.search(self.library.id_to_piece(i)) for i in range(self.library.get_piece_size()))
        self.cache = PieceCache(self._encode)

    def _encode(self, parts: list[str]) -> list[list[int]]:
        return [x for i in range(0, len(parts), 4096) for x in self.library.encode(parts[i : i + 4096], num_threads=1)]

    def _split(self, text: str) -> list[str]:
        if not text:
            return []
        return CUT.split(text) if self.safe and "▁" not in text else [text]

    def _places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.cache.text_places(texts, False, r"\A\z|▁" if self.safe else "", self._split)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.cache.ids(*self._places(texts))

    def count(self, texts: pa.Array) -> np.ndarray:
        number, place = self._places(texts)
        ends = np.concatenate([[0], np.cumsum(self.cache.length[place])])
        return np.diff(ends[np.concatenate([[0], np.cumsum(number)])])


@lru_cache(maxsize=4)
def json_tokenizer(path: str) -> JsonTokenizer:
    """One per worker process, with its pieces."""
    return JsonTokenizer(path)


@lru_cache(maxsize=4)
def piece_tokenizer(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


HELD += [json_tokenizer.cache_clear, piece_tokenizer.cache_clear]


def tokenizer_path(name: str) -> str:
    """Where the worker at hand has a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
