"""Token ids of whole texts by the tokenizers library, the distinct words of a part of the texts at a time."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

_encoders: dict[str, Encoder] = {}
#: Bytes of text that are split to words at a time; a longer text is cut at spaces.
PART = 1 << 20
#: The steps before the model of a tokenizer that never joins what a space or a line feed separates.
APART = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
#: What the model must be for its merges to be all there is to it.
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False, "ignore_merges": False}
#: Longer pieces go through the library, as do words with other characters than ASCII and Latin-1 letters.
LONGEST = 48
#: Kinds of bytes: letters (2-byte ones by both bytes), digits, marks; 0 is none of them.
LETTER, DIGIT, MARK = 1, 2, 3


def _byte_names() -> dict[int, str]:
    """The character by which byte-level BPE names each byte."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(same)]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``size`` elements of ``flat`` from each ``start``, one after another."""
    shift = start - (np.cumsum(size) - size)
    return flat[np.repeat(shift, size) + np.arange(int(size.sum()))]


class Merges:
    """The merges of a byte-level BPE model, applied to many pieces at once."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        names = _byte_names()
        self.inner = np.array([vocab[names[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[names[b] + suffix] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.new = np.array([vocab[a + b] for a, b in pairs], np.int64)
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, len(keys), np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # open addressing: those that find their slot taken move on
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]
            mine = left[self.keys[at[left]] == keys[left]]
            self.ranks[at[mine]] = mine
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; the number of merges if there is none."""
        keys = left << 32 | right
        at = self._slot(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.ranks[at], len(self.new))
        open_ = np.flatnonzero((got != keys) & (got != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            got = self.keys[at[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
        return out

    def apply(self, raw: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that begin at ``start`` and fill ``raw``, and each piece's count.

        In each round every piece makes one merge, that of the least rank, the leftmost of equal ones, as the model does.
        """
        none, n = len(self.new), len(start)
        size = np.diff(np.concatenate([start, [len(raw)]]))
        sym = self.inner[raw]
        sym[start + size - 1] = self.last[raw[start + size - 1]]
        count = np.zeros(n, np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        piece, rank = np.arange(n), np.full(len(raw), none, np.int64)
        inner = np.ones(len(raw), bool)
        inner[start + size - 1] = False
        at = np.flatnonzero(inner)
        rank[at] = self.rank(sym[at], sym[at + 1])
        while len(piece):
            best = np.minimum.reduceat((rank << 32) | np.arange(len(sym)), start)
            place, least = best & 0xFFFFFFFF, best >> 32
            over = least == none
            if over.any():  # nothing left to merge in these
                of = np.repeat(over, size)
                count[piece[over]] = size[over]
                done.append((piece[over], size[over], sym[of]))
                shift = np.cumsum(of)
                sym, rank, keep = sym[~of], rank[~of], ~over
                piece, size, place, least = piece[keep], size[keep], place[keep], least[keep]
                place -= shift[place]
                start = np.cumsum(size) - size
                if not len(piece):
                    break
            sym[place] = self.new[least]
            last = place + 1 == start + size - 1
            stay = np.ones(len(sym), bool)
            stay[place + 1] = False
            first = place == start
            size = size - 1
            start = np.cumsum(size) - size
            sym, rank = sym[stay], rank[stay]
            place = place - np.arange(len(place))
            rank[place[last]] = none
            a, b = place[~last], place[~first] - 1
            rank[a] = self.rank(sym[a], sym[a + 1])
            rank[b] = self.rank(sym[b], sym[b + 1])
        ids = np.empty(int(count.sum()), np.uint32)
        begin = np.cumsum(count) - count
        for which, k, found in done:
            ids[np.repeat(begin[which] - (np.cumsum(k) - k), k) + np.arange(len(found))] = found
        return ids, count


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[33:127] = MARK
    kind[48:58] = DIGIT
    kind[65:91] = kind[97:123] = LETTER
    return kind


_KIND = _kinds()


class Encoder:
    """Ids of ``Tokenizer.encode(text, add_special_tokens=False)`` as unsigned 32-bit integers, for whole texts.

    Where the tokenizer's file says that it treats what spaces and line feeds separate apart (``APART``) and that its
    model is merges alone (``MODEL``), the distinct words of a part of the texts are encoded once each and their ids
    gathered: those of ASCII and Latin-1 letters, digits and marks by the file's merges, all together, other words by the
    library. Nothing is kept from one part to the next. Any other tokenizer gets the whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.checked = Tokenizer.from_file(path), False
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        added, model = form.get("added_tokens") or [], form["model"]
        # all that is added holds "<|", and words with that go to the library
        plain = all("<|" in t["content"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])) for t in added)
        self.apart = plain and all(form.get(k) == v for k, v in APART.items()) and all(model.get(k) == v for k, v in MODEL.items())
        self.merges = Merges(model["vocab"], model["merges"], "</w>") if self.apart else None

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all ``words``, and each word's start and count among them."""
        raw, at = common.text_bytes(words)
        raw, n = raw.copy(), len(words)
        kind = _KIND[raw]
        # letters of two bytes, but for the signs of multiplication and division
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        upper = lead[raw[lead + 1] < 0x9F] + 1
        raw[upper] += 0x20
        raw[(raw >= 65) & (raw <= 90)] += 0x20
        word = np.repeat(np.arange(n), np.diff(at))
        # the second byte counts for both: 0xC3 0x9F is lower case already
        odd = np.zeros(n, bool)
        odd[word[kind == 0]] = True
        odd[word[np.flatnonzero((raw[:-1] == 39) & (kind[1:] == LETTER) & (word[:-1] == word[1:]))]] = True
        odd[word[np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))]] = True
        new = np.ones(len(raw), bool)
        new[1:] = (word[1:] != word[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        start = np.flatnonzero(new)
        size = np.diff(np.concatenate([start, [len(raw)]]))
        odd[word[start[size > LONGEST]]] = True
        use = ~odd[word]
        start = (np.cumsum(use) - 1)[start[use[start]]]
        own = word[use][start]
        ids, count = self.merges.apply(raw[use], start) if len(start) else (np.empty(0, np.uint32), np.empty(0, np.int64))
        counts = np.bincount(own, count, n).astype(np.int64) if len(own) else np.zeros(n, np.int64)
        starts = np.cumsum(counts) - counts
        rest = np.flatnonzero(odd)
        if len(rest):
            more, size = self._odd(words.take(pa.array(rest)).to_pylist())
            starts[rest], counts[rest] = len(ids) + np.cumsum(size) - size, size
            ids = np.concatenate([ids, more])
        return ids, starts, counts

    def _odd(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``words`` by the whole tokenizer, and each word's count."""
        ids, size = [], np.zeros(len(words), np.int64)
        for i in range(0, len(words), 4096):
            some = words[i : i + 4096]
            got = self.tokenizer.encode("\n".join(some), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in some])
            owner = np.searchsorted(ends, np.fromiter((o[0] for o in got.offsets), np.int64, len(got.ids)), side="right")
            size[i : i + len(some)] = np.bincount(owner, minlength=len(some))
            ids.append(np.array(got.ids, "<u4"))
        return np.concatenate(ids), size

    def _part(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        ids, start, count = self._words(words.dictionary)
        which = words.indices.to_numpy()
        size = count[which]
        before = np.concatenate([[0], np.cumsum(size)])
        return _gather(ids, start[which], size), before[split.offsets.to_numpy()]

    def _checked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``_part``; once in each worker the shortest text of some length is compared with the library's ids."""
        ids, at = self._part(texts)
        if not self.checked and (some := [k for k in range(len(texts)) if at[k + 1] - at[k] > 20]):
            k = min(some, key=lambda k: at[k + 1] - at[k])
            if self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids != ids[at[k] : at[k + 1]].tolist():
                raise RuntimeError("the tokenizers library gives other ids than the file's merges")
            self.checked = True
        return ids, at

    def encode(self, texts: pa.Array | pa.ChunkedArray):
        """Yield (first row, row after the last, ids, offsets of the rows' ids), in order, for parts of a string column."""
        raw, at = common.text_bytes(texts)
        for i, j in common.parts(at, PART):
            own = raw[at[i] : at[j]]
            if not self.apart:
                got = self.tokenizer.encode_batch([t.decode() for t in _rows(own, at[i : j + 1] - at[i])], add_special_tokens=False)
                yield i, j, np.fromiter((x for g in got for x in g.ids), "<u4"), np.concatenate([[0], np.cumsum([len(g.ids) for g in got])])
            elif len(own) <= 2 * PART:
                yield i, j, *self._checked(_strings(own, at[i : j + 1] - at[i]))
            else:
                done = [self._part(_strings(x, np.array([0, len(x)])))[0] for x in _strips(own)]
                yield i, j, (ids := np.concatenate(done)), np.array([0, len(ids)])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        return [ids[a:b].tobytes() for _, _, ids, at in self.encode(pa.array(texts, pa.string())) for a, b in zip(at, at[1:])]


def _rows(raw: np.ndarray, at: np.ndarray) -> list[bytes]:
    return [raw[a:b].tobytes() for a, b in zip(at.tolist(), at[1:].tolist())]


def _strings(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])


def _strips(raw: np.ndarray):
    """A long text cut after spaces or line feeds, each strip of about ``PART`` bytes or a word."""
    a = 0
    while a < len(raw):
        b = a + PART
        while b < len(raw):  # the first separator from there on
            found = np.flatnonzero((raw[b : b + PART] == 32) | (raw[b : b + PART] == 10))
            if len(found):
                b += int(found[0])
                break
            b += PART
        yield raw[a : min(b, len(raw))]
        a = b


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
