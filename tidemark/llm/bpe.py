"""BPE encoding and decoding by batched numpy merge rounds.

Text is normalised and cut into pieces over one flat code-point array. Pieces already met are found in
an open-addressing table of their 64-bit hashes; the rest are encoded together: the byte symbols of
all of them lie in one flat array, each round finds the lowest-rank pair of every piece, the ranks of
pairs coming from a binary search over the sorted pair keys, and merges it.

Defined cases: a null or empty text gives no ids; texts of any length are encoded whole; a special
token's literal string in a text is that token, as the library has it by default.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import regex

from tidemark.llm.textvec import RangeHash, seeded

#: Fixed values of the vocabulary's format: piece pattern's contractions, white space and word end.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE_SPACE = (0x20, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x09, 0x0E), *range(0x2000, 0x200B))
WORD_END = "</w>"

#: Pieces that a worker remembers; the table starts anew when it is full.
REMEMBERED = 1 << 20
#: Code points that one pass works on, unless a text is longer.
CHUNK_CHARS = 1 << 19

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_NONE = np.int64(1) << np.int64(40)


def _classes() -> np.ndarray:
    """The class of every code point in the piece pattern."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            first, last = ord(m[0][0]), ord(m[0][-1])
            out[first : last + 1] = kind
    out[0xD800:0xE000] = _OTHER
    out[list(WHITE_SPACE)] = _SPACE
    return out


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies have for each byte: itself where it is printable, else the next from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class PieceTable:
    """Hash -> row number, open addressing in numpy."""

    def __init__(self, most: int = REMEMBERED):
        self.mask = np.uint64(2 * most - 1)
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.rows = np.full(int(self.mask) + 1, -1, np.int32)
        self.n = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        rows = self.rows[at]
        left = np.flatnonzero((rows >= 0) & (self.keys[at] != keys))
        while len(left):
            at[left] = (at[left] + np.uint64(1)) & self.mask
            rows[left] = self.rows[at[left]]
            left = left[(rows[left] >= 0) & (self.keys[at[left]] != keys[left])]
        return rows

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Distinct keys that the table doesn't have."""
        at = keys & self.mask
        left = np.arange(len(keys))
        while len(left):
            free = self.rows[at[left]] < 0
            _, first = np.unique(at[left[free]], return_index=True)
            won = left[free][first]
            self.keys[at[won]] = keys[won]
            self.rows[at[won]] = rows[won]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + np.uint64(1)) & self.mask
        self.n += len(keys)


class WordBpe:
    """Encoder and decoder of a word-end BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = np.full(self.size, "", object)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        shown = byte_symbols()
        self.inner = np.array([vocab[c] for c in shown], np.int64)
        self.final = np.array([vocab[c + WORD_END] for c in shown], np.int64)
        pairs = np.array([[vocab[a], vocab[b], vocab[a + b]] for a, b in map(tuple, spec["model"]["merges"])], np.int64)
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks, self.merged = keys[order], order.astype(np.int64), pairs[:, 2]
        # A merge may be done everywhere in a piece at once if no pair with its result ranks before it.
        first_use = np.full(self.size, len(pairs), np.int64)
        np.minimum.at(first_use, pairs[:, 0], np.arange(len(pairs)))
        np.minimum.at(first_use, pairs[:, 1], np.arange(len(pairs)))
        self.at_once = first_use[self.merged] > np.arange(len(pairs))
        self.classes = _classes()
        self.codes = seeded(0x110000, 3)
        self.table = PieceTable()
        self._forget()

    def _forget(self) -> None:
        self.table.clear()
        self.flat = np.zeros(1 << 16, np.int32)
        self.offs = np.zeros(1 << 16, np.int64)
        self.rows = 0

    # -- normalise and cut -------------------------------------------------

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points of the normalised texts, starts and ends of pieces, and the pieces of each text."""
        clean = []
        for text in texts:
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            # Lower case goes by single characters, so a final sigma has no form of its own.
            clean.append(text.replace("Σ", "σ").lower() if not text.isascii() else text.lower())
        cp = np.frombuffer("\n".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in clean])
        kind = self.classes[cp]
        before = np.empty_like(kind)
        before[:1], before[1:] = _SPACE, kind[:-1]
        start = (kind == _NUMBER) | ((kind != before) & (kind != _SPACE))
        apostrophe = np.flatnonzero((cp == 39) & start)
        if len(apostrophe):
            padded = np.append(cp, [0, 0, 0])
            free = np.ones(len(apostrophe), bool)
            for tail in CONTRACTIONS:
                hit = free.copy()
                for k, c in enumerate(tail):
                    hit &= padded[apostrophe + 1 + k] == ord(c)
                free &= ~hit
                at = apostrophe[hit]
                start[at + 1] = False
                after = at + 1 + len(tail)
                after = after[after < len(cp)]
                start[after[kind[after] == _LETTER]] = True
        edge = start | ((kind == _SPACE) & (before != _SPACE))
        at = np.append(np.flatnonzero(edge), len(cp))
        on = start[at[:-1]] if len(cp) else np.zeros(0, bool)
        starts, stops = at[:-1][on], at[1:][on]
        return cp, starts, stops, np.searchsorted(starts, np.append(0, ends))

    # -- merge rounds --------------------------------------------------------

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE)

    def merge(self, symbols: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over the byte symbols of many words: the final symbols, and their offsets."""
        n_words = len(off) - 1
        word = np.repeat(np.arange(n_words), np.diff(off))
        done_words, done_symbols = [], []

        def pair_ranks(symbols, word):
            ranks = np.full(len(symbols), _NONE)
            same = np.flatnonzero(word[1:] == word[:-1])
            ranks[same] = self._ranks(symbols[same], symbols[same + 1])
            return ranks

        ranks = pair_ranks(symbols, word)
        while len(symbols):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            counts = np.diff(np.append(first, len(word)))
            least = np.repeat(np.minimum.reduceat(ranks, first), counts)
            live = least < _NONE
            if not live.all():
                done_words.append(word[~live])
                done_symbols.append(symbols[~live])
                symbols, word, ranks, least = symbols[live], word[live], ranks[live], least[live]
                if not len(symbols):
                    break
            hit = np.flatnonzero(ranks == least)
            # Of the hits in a word the leftmost; all of them, two steps apart in a run, where that can't differ.
            w = word[hit]
            lead = np.append(True, w[1:] != w[:-1])
            chain = np.append(False, (hit[1:] == hit[:-1] + 1) & ~lead[1:])
            head = np.maximum.accumulate(np.where(chain, 0, np.arange(len(hit))))
            even = (np.arange(len(hit)) - head) % 2 == 0
            hit = hit[lead | (even & self.at_once[ranks[hit]])]
            symbols[hit] = self.merged[ranks[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, word, ranks = symbols[keep], word[keep], ranks[keep]
            near = moved[hit]
            near = np.unique(np.append(near, near[near > 0] - 1))
            ranks[near] = _NONE
            near = near[near + 1 < len(symbols)]
            near = near[word[near] == word[near + 1]]
            ranks[near] = self._ranks(symbols[near], symbols[near + 1])
        if not done_words:
            return np.zeros(0, np.int64), np.zeros(n_words + 1, np.int64)
        words, symbols = np.concatenate(done_words), np.concatenate(done_symbols)
        order = np.argsort(words, kind="stable")
        return symbols[order], np.searchsorted(words[order], np.arange(n_words + 1))

    def _encode_new(self, cp: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces given as ranges of code points."""
        sizes = stops - starts
        off = np.append(0, np.cumsum(sizes))
        points = cp[np.repeat(starts - off[:-1], sizes) + np.arange(off[-1])]
        wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        ends = np.append(0, np.cumsum(wide))
        data = np.frombuffer(points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        symbols = self.inner[data]
        symbols[ends[off[1:]] - 1] = self.final[data[ends[off[1:]] - 1]]
        return self.merge(symbols, ends[off])

    def _lookup(self, cp: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Rows of the pieces in the remembered table; new pieces are encoded and added."""
        hashes = RangeHash(self.codes[cp])(starts, stops)
        rows = self.table.find(hashes)
        new = np.flatnonzero(rows < 0)
        if len(new):
            keys, first = np.unique(hashes[new], return_index=True)
            if self.table.n + len(keys) > self.table.most:
                self._forget()
                new = np.arange(len(hashes))
                keys, first = np.unique(hashes, return_index=True)
                if len(keys) > self.table.most:
                    self.table = PieceTable(1 << int(len(keys)).bit_length())
            at = new[first]
            ids, off = self._encode_new(cp, starts[at], stops[at])
            have, n = self.offs[self.rows], len(keys)
            while have + len(ids) > len(self.flat):
                self.flat = np.append(self.flat, np.zeros_like(self.flat))
            while self.rows + n + 1 > len(self.offs):
                self.offs = np.append(self.offs, np.zeros_like(self.offs))
            self.flat[have : have + len(ids)] = ids
            self.offs[self.rows : self.rows + n + 1] = have + off
            self.table.add(keys, np.arange(self.rows, self.rows + n, dtype=np.int32))
            self.rows += n
            rows[new] = self.table.find(hashes[new])
        return rows

    # -- public ----------------------------------------------------------------

    def _plain(self, texts: list[str]) -> Iterator[np.ndarray]:
        cp, starts, stops, bounds = self._pieces(texts)
        if not len(starts):
            yield from (np.zeros(0, np.int32) for _ in texts)
            return
        rows = self._lookup(cp, starts, stops)
        first, sizes = self.offs[rows], self.offs[rows + 1] - self.offs[rows]
        off = np.append(0, np.cumsum(sizes))
        ids = self.flat[np.repeat(first - off[:-1], sizes) + np.arange(off[-1])]
        for a, b in zip(off[bounds[:-1]], off[bounds[1:]], strict=True):
            yield ids[a:b]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Token ids of each text, in order."""
        held: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if self.special and any(s in text for s in self.special):
                yield from self._plain(held) if held else ()
                held, size = [], 0
                parts = [p for p in self.split.split(text) if p]
                plain = iter(list(self._plain([p for p in parts if p not in self.special])))
                yield np.concatenate([np.array([self.special[p]], np.int32) if p in self.special else next(plain) for p in parts])
                continue
            held.append(text)
            size += len(text)
            if size >= CHUNK_CHARS:
                yield from self._plain(held)
                held, size = [], 0
        yield from self._plain(held) if held else ()

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' strings joined by one space: this vocabulary has no decoder of its own."""
        return " ".join(self.tokens[ids])


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One encoder for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
