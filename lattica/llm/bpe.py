"""Byte-pair encoding on numpy arrays: vectorised pre-tokens and rank-synchronous merging.

``Bpe`` reads a tokenizer file (byte-level, or with word ends). Pre-tokens of a block of texts come
from runs of code point classes, each distinct pre-token is merged once and remembered by a 64-bit
hash. Merging holds many pre-tokens as one ragged array of symbols; in each round every sequence
finds its lowest-ranked adjacent pair and all of them are applied at once.
"""

from __future__ import annotations

import json

import numpy as np

from lattica.llm.common import U64, mix, powers

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255
#: Distinct pre-tokens that a Python worker remembers; beyond that it starts anew.
MOST_CACHED = 500_000
#: Pre-tokens merged in one ragged array.
MERGE_BATCH = 100_000
_NONE = np.int32(2**31 - 1)


class HashTable:
    """64-bit keys to consecutive int32 places, with open addressing; whole arrays at a time."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys, self.places = np.zeros(1 << bits, U64), np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is absent. Keys are not 0."""
        slot, mask = self._slot(keys), len(self.keys) - 1
        found = self.keys[slot]
        out = np.where(found == keys, self.places[slot], np.int32(-1))
        rest = np.flatnonzero((found != keys) & (found != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & mask
            found = self.keys[slot[rest]]
            same = found == keys[rest]
            out[rest[same]] = self.places[slot[rest[same]]]
            rest = rest[~same & (found != 0)]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Give distinct new keys the next places."""
        places = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        if self.n * 3 > len(self.keys):
            used = self.keys != 0
            old_keys, old_places = self.keys[used], self.places[used]
            while self.n * 3 > 1 << self.bits:
                self.bits += 1
            self.keys, self.places = np.zeros(1 << self.bits, U64), np.zeros(1 << self.bits, np.int32)
            self._put(old_keys, old_places)
        self._put(keys, places)
        return places

    def _put(self, keys: np.ndarray, places: np.ndarray) -> None:
        slot, mask = self._slot(keys), len(self.keys) - 1
        rest = np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[slot[rest]] == 0]
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot[rest]] == keys[rest]
            self.places[slot[rest[won]]] = places[rest[won]]
            rest = rest[~won]
            slot[rest] = (slot[rest] + 1) & mask


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every span, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class RankMerger:
    """Merge rules as arrays; ``merge`` applies them to many symbol sequences at once."""

    def __init__(self, pairs: list[tuple[int, int]], made: list[int]):
        a, b = (np.array([p[i] for p in pairs], U64) for i in (0, 1))
        self.table = HashTable(max(8, (len(pairs) * 5).bit_length()))
        self.table.add(self._key(a, b))
        self.made = np.array(made, np.int32)

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(U64) << U64(32) | b.astype(U64)) + U64(1)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, lengths) after no pair of any sequence has a rule left."""
        n = len(lengths)
        seq = np.repeat(np.arange(n, dtype=np.int32), lengths)
        symbols = symbols.astype(np.int32)
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.full(len(symbols), _NONE)
            if len(symbols) > 1:
                inner = np.flatnonzero(seq[1:] == seq[:-1])
                place = self.table.find(self._key(symbols[inner], symbols[inner + 1]))
                rank[inner] = np.where(place >= 0, place, _NONE)
            heads = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.minimum.reduceat(rank, heads)
            each = np.repeat(best, np.diff(np.r_[heads, len(symbols)]))
            going = each != _NONE
            if not going.all():
                ended.append((symbols[~going], seq[~going]))
            hit = np.flatnonzero(going & (rank == each))
            if not len(hit):
                break
            run = np.r_[True, np.diff(hit) > 1]  # aaa: the pairs at 0 and 1 overlap, the left one counts
            first = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            going[hit + 1] = False
            symbols, seq = symbols[going], seq[going]
        if not ended:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        symbols, seq = np.concatenate([x for x, _ in ended]), np.concatenate([y for _, y in ended])
        order = np.argsort(seq, kind="stable")
        return symbols[order], np.bincount(seq, minlength=n).astype(np.int64)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Bpe:
    """A tokenizer file, with a cache of the tokens of each pre-token met so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.word_end = model["end_of_word_suffix"] or ""
        self.specials = [t["content"] for t in spec["added_tokens"]]
        letters = byte_letters()
        self.inside = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + self.word_end] for c in letters], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merger = RankMerger([(vocab[a], vocab[b]) for a, b in merges], [vocab[a + b] for a, b in merges])
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.lower = np.arange(0x110000, dtype=np.uint32) if self.word_end else None
        self.simple = None
        if self.word_end:  # code points that the normaliser maps one to one, whatever stands beside them
            self.simple = np.zeros(0x110000, bool)
            for c in range(0x250):
                if len(to := self.library.normalizer.normalize_str("a" + chr(c) + "a")) == 3:
                    self.simple[c], self.lower[c] = True, ord(to[1])
        self.reset()

    def reset(self) -> None:
        self.table, self.lengths, self.starts = HashTable(18), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.ids: list[np.ndarray] = []
        self.flat = np.zeros(0, np.int32)

    def _learn_classes(self, codes: np.ndarray) -> None:
        pieces = self.library.pre_tokenizer.pre_tokenize_str
        for c in np.unique(codes[self.classes[codes] == UNKNOWN]):
            x = chr(c)
            joined = [k for k, other in ((LETTER, "a"), (OTHER, "!")) if len(pieces(other + x)) == 1]
            if self.word_end:  # numbers stand alone, white space goes
                kind = SPACE if not pieces(x) else NUMBER if len(pieces(x + x)) == 2 else (joined or [NUMBER])[0] if len(pieces("a" + x)) == 1 or len(pieces("!" + x)) == 1 else NUMBER
            else:
                kind = joined[0] if joined else NUMBER if len(pieces("1" + x)) == 1 else SPACE
            self.classes[c] = kind

    def pretokens(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the pre-tokens of texts that lie one after another in ``codes``."""
        n = len(codes)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = self.classes[codes]
        if (kind == UNKNOWN).any():
            self._learn_classes(codes)
            kind = self.classes[codes]
        start = np.ones(n + 1, bool)
        start[1:n] = kind[1:] != kind[:-1]
        start[bounds[bounds < n]] = True
        if self.word_end:
            start[:n] |= kind == NUMBER
        free = start.copy()  # starts that are not joined to a space before them
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        if not self.word_end:
            last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:n])
            start[last] = True
            joined = last[codes[last] == 0x20] + 1
            start[joined] = free[joined] = False
        quote = np.flatnonzero((codes[:-1] == 0x27) & free[:n - 1] & (kind[1:] == LETTER) & ~edge[1:n])
        if len(quote):
            one, two = codes[quote + 1], codes[np.minimum(quote + 2, n - 1)]
            whole = (quote + 2 < n) & ~edge[np.minimum(quote + 2, n)]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = whole & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
            start[quote[short | long] + 1] = False
            start[quote[short] + 2] = True
            start[quote[long] + 3] = True
        at = np.flatnonzero(start)
        starts, ends = at[:-1], at[1:]
        if self.word_end:
            solid = kind[starts] != SPACE
            starts, ends = starts[solid], ends[solid]
        return starts, ends

    def places(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The cache place of each pre-token; new ones are merged first."""
        if self.table.n > MOST_CACHED:
            self.reset()
        n = len(codes)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum((codes.astype(U64) + U64(1)) * up[:n], out=total[1:])
        key = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)) | U64(1)
        place = self.table.find(key)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            _, first = np.unique(key[missing], return_index=True)
            new = missing[first]
            for a in range(0, len(new), MERGE_BATCH):
                part = new[a:a + MERGE_BATCH]
                self._merge_new(codes, starts[part], ends[part])
                self.table.add(key[part])
            self.flat = np.concatenate([self.flat, *self.ids])
            self.ids = []
            self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
            place[missing] = self.table.find(key[missing])
        return place

    def _merge_new(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        chars = codes[ragged(starts, ends - starts)]
        size = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
        raw = np.frombuffer(chars.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        chars_to = np.r_[0, np.cumsum(size)]
        at = np.r_[0, np.cumsum(ends - starts)]
        lengths = chars_to[at[1:]] - chars_to[at[:-1]]
        symbols = self.inside[raw]
        stops = np.cumsum(lengths) - 1
        symbols[stops] = self.final[raw[stops]]
        ids, n = self.merger.merge(symbols, lengths)
        self.ids.append(ids)
        self.lengths = np.concatenate([self.lengths, n.astype(np.int32)])


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The tokenizer of a file, read once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the rows' offsets in them."""
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    count = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return codes, count[offsets]
