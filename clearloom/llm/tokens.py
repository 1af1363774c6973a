"""Token ids of whole texts by a tokenizer with the byte-level pattern, piece by piece, in numpy.

A text is cut where the pattern always begins a new match, whatever stands before or after: before a space that something printable in ASCII or a character from U+00C0 to U+07FF follows (a space is only ever the first character of a match, or in a run of white space that gives up its last space), and between two ASCII characters of different kinds (letter, digit, mark), but for an apostrophe before a letter; before a line end that follows a mark, letter or digit, and after it if it stands alone. A piece's ids don't depend on its neighbours, so each distinct piece is encoded once and looked up afterwards: pieces of up to SHORT bytes in a hash table of whole keys (two 64-bit words that hold the bytes and their number, so nothing is taken on trust), longer ones in a dictionary. Both are bounded and start anew when full.

Texts that hold the string of a special token are encoded by the library as they are.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa

from .common import mix, slices, text_buffers

#: Bytes of a piece that the table holds; pieces and ids in it; bytes of longer pieces that are kept.
SHORT, PIECES, IDS, LONG_BYTES = 15, 1 << 20, 1 << 22, 24 << 20
#: Pieces that the library encodes in one call.
TOGETHER = 20_000
END_ID = 2
_encoders: dict[str, "PieceEncoder"] = {}

#: Kinds of bytes: 0 others (white space, controls, above ASCII), 1 letters, 2 digits, 3 marks; line end apart.
_KIND = np.zeros(256, np.uint8)
for _b in range(33, 127):
    _KIND[_b] = 1 if chr(_b).isalpha() else 2 if chr(_b).isdigit() else 3
#: Bytes that begin what is no white space: printable ASCII, and U+00C0 to U+07FF.
_SOLID = _KIND > 0
_SOLID[0xC3:0xE0] = True
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def cuts(raw: np.ndarray) -> np.ndarray:
    """For each byte, whether a piece may begin there (texts' own begins are not looked at)."""
    kind = _KIND[raw]
    out = np.zeros(len(raw), bool)
    if len(raw) < 2:
        return out
    plain = kind > 0
    out[:-1] = (raw[:-1] == 32) & _SOLID[raw[1:]]
    both = plain[:-1] & plain[1:] & (kind[:-1] != kind[1:])
    both &= ~((raw[:-1] == 39) & (kind[1:] == 1))
    out[1:] |= both
    line = raw == 10
    out[1:] |= line[1:] & plain[:-1]
    out[2:] |= line[1:-1] & plain[:-2] & plain[2:]
    return out


class PieceEncoder:
    """encode_buffers and encode give the ids that the tokenizers library gives for each whole text."""

    def __init__(self, path: str, pieces: int = PIECES):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads that wait for work cost as much as it
        self.tokenizer = Tokenizer.from_file(path)
        (self.line_end,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self._begin(pieces, [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()])

    def _begin(self, pieces: int, special: list[bytes]) -> None:
        self.pieces, self.special = pieces, special
        self.bits = max(4, (2 * pieces - 1).bit_length())
        self._anew()

    def _anew(self) -> None:
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.key = np.zeros((2, self.pieces), np.uint64)
        self.at, self.count = np.zeros(self.pieces, np.int32), np.zeros(self.pieces, np.int32)
        self.ids = np.zeros(IDS, np.uint32)
        self.held, self.used = 0, 0
        self.long: dict[bytes, np.ndarray] = {}
        self.long_bytes = 0

    # ---- what encodes a piece
    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text by itself."""
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> list[np.ndarray]:
        """Ids of pieces. Those that are printable and hold no space but a first one go together, parted by line ends (one token of their own that they never yield)."""
        out: list[np.ndarray | None] = [None] * len(new)
        plain = [i for i, p in enumerate(new) if p.isprintable() and len(p) > (p[:1] == " ") and " " not in p[1:]]
        for i in range(0, len(plain), TOGETHER):
            part = plain[i : i + TOGETHER]
            ids = self.whole(["\n".join([new[x] for x in part])])[0]
            ends = np.flatnonzero(ids == self.line_end)
            for x, a, b in zip(part, [0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)], strict=True):
                out[x] = ids[a:b]
        odd = [i for i, p in enumerate(out) if p is None]
        for i, ids in zip(odd, self.whole([new[i] for i in odd])):
            out[i] = ids
        return out

    # ---- the table
    def _find(self, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
        """Place of each key in the table, or -1."""
        out = np.full(len(k0), -1, np.int32)
        todo, step = np.arange(len(k0)), 0
        place = self._hash(k0, k1)
        mask = len(self.slot) - 1
        while len(todo):
            i = self.slot[(place + step) & mask]
            same = (i >= 0) & (self.key[0][i] == k0[todo]) & (self.key[1][i] == k1[todo])
            out[todo[same]] = i[same]
            on = (i >= 0) & ~same
            todo, place, step = todo[on], place[on], step + 1
        return out

    def _hash(self, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(k0 + k1 * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _add(self, k0: np.ndarray, k1: np.ndarray, ids: list[np.ndarray]) -> None:
        """Distinct keys that the table lacks; there is room."""
        n, flat = len(k0), np.concatenate(ids)
        new = np.arange(self.held, self.held + n, dtype=np.int32)
        self.key[0][new], self.key[1][new] = k0, k1
        sizes = np.array([len(x) for x in ids])
        self.at[new], self.count[new] = self.used + np.cumsum(sizes) - sizes, sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.held, self.used = self.held + n, self.used + len(flat)
        mask, place = len(self.slot) - 1, self._hash(k0, k1)
        while len(new):
            at = place & mask
            free = self.slot[at] < 0
            self.slot[at[free]] = new[free]  # of several for one slot, one stays
            out = self.slot[at] != new
            new, place = new[out], place[out] + 1

    def encode_buffers(self, offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; number of ids of each text) of UTF-8 texts given by offsets into raw. Best for about a MB at a time."""
        n = len(offsets) - 1
        if len(raw) == 0:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        begin = cuts(raw)
        begin[offsets[:-1][offsets[:-1] < len(raw)]] = True
        apart = self._special(offsets, raw)
        for i in apart:
            begin[offsets[i] + 1 : offsets[i + 1]] = False
        start = np.flatnonzero(begin)
        size = np.diff(start, append=len(raw))
        short = size <= SHORT
        if len(apart):
            short &= ~np.isin(start, offsets[apart])
        padded = np.concatenate([raw, np.zeros(16, np.uint8)])
        words = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view("<u8"), (len(raw) + 8,), (1,))
        s, z = start[short], size[short]
        k0 = words[s] & _MASKS[np.minimum(z, 8)]
        k1 = (words[s + 8 * (z > 8)] & _MASKS[np.maximum(z - 8, 0)]) | (z.astype(np.uint64) << np.uint64(56))
        place = self._find(k0, k1)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            place = self._learned(k0, k1, place, missing)
        count = np.zeros(len(start), np.int64)
        source = np.zeros(len(start), np.int64)
        count[short], source[short] = self.count[place], self.at[place]
        far = self._long(raw, start, size, np.flatnonzero(~short), {int(offsets[i]) for i in apart})
        count[~short] = [len(x) for x in far]
        ends = np.cumsum(count)
        out = np.zeros(int(ends[-1]), np.uint32)
        # Ids of short pieces by one gather; the long ones' places are written after it.
        source -= ends - count
        near = np.repeat(source, count) + np.arange(len(out))
        if len(far):
            near = np.clip(near, 0, IDS - 1)
        out[:] = self.ids[near]
        for i, x in zip(np.flatnonzero(~short).tolist(), far):
            out[ends[i] - count[i] : ends[i]] = x
        upto = np.concatenate([[0], ends])[np.searchsorted(start, offsets)]
        return out, np.diff(upto)

    def _special(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Texts that hold a special token's string."""
        found, data = [], raw.tobytes() if self.special else b""
        for s in self.special:
            at = data.find(s)
            while at >= 0:
                i = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(s) <= offsets[i + 1]:
                    found.append(i)
                    at = data.find(s, int(offsets[i + 1]))
                else:
                    at = data.find(s, at + 1)
        return np.unique(np.array(found, np.int64))

    def _learned(self, k0: np.ndarray, k1: np.ndarray, place: np.ndarray, missing: np.ndarray) -> np.ndarray:
        def distinct(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = at[np.lexsort((k1[at], k0[at]))]
            new = np.ones(len(order), bool)
            new[1:] = (k0[order[1:]] != k0[order[:-1]]) | (k1[order[1:]] != k1[order[:-1]])
            return k0[order[new]], k1[order[new]]

        a, b = distinct(missing)
        ids = self.learn(_pieces(a, b))
        again = missing
        if self.held + len(a) > self.pieces or self.used + sum(map(len, ids)) > IDS:
            again = np.arange(len(k0))
            if self.held:  # the table begins anew, with all that these texts need
                self._anew()
                a, b = distinct(np.arange(len(k0)))
                ids = self.learn(_pieces(a, b))
            while len(a) > self.pieces or sum(map(len, ids)) > IDS - self.used:  # more than a table holds: a larger one
                self.pieces *= 2
                self.bits += 1
                self._anew()
                if sum(map(len, ids)) > IDS:
                    self.ids = np.zeros(sum(map(len, ids)), np.uint32)
                    break
        self._add(a, b, ids)
        place[again] = self._find(k0[again], k1[again])
        return place

    def _long(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray, apart: set[int]) -> list[np.ndarray]:
        """Ids of the pieces at these places, from the dictionary."""
        keys = [raw[a : a + n].tobytes() for a, n in zip(start[at].tolist(), size[at].tolist())]
        alone = {k for k, a in zip(keys, start[at].tolist()) if a in apart}
        here: dict[bytes, np.ndarray] = {}
        new = list({k for k in keys if k not in self.long} | alone)
        if new:
            cut, odd = [k for k in new if k not in alone], list(alone)
            for k, ids in [*zip(cut, self.learn([k.decode() for k in cut])), *zip(odd, self.whole([k.decode() for k in odd]) if odd else [])]:
                here[k] = ids
        out = [here[k] if k in here else self.long[k] for k in keys]
        for k, ids in here.items():
            if k not in alone:
                self.long[k] = ids.copy()
                self.long_bytes += len(k) + ids.nbytes + 200
        if self.long_bytes > LONG_BYTES:
            self.long, self.long_bytes = {}, 0
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; None is an empty text."""
        out: list[bytes] = []
        for ids, counts, _ in self.encode_column(pa.array(texts, pa.large_string())):
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts).tolist()
            out += [raw[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]
        return out

    def encode_column(self, col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(ids, numbers of ids, first row) of the rows of a string column, about a MB of text at a time."""
        offsets, raw = text_buffers(col)
        for i, j in slices(offsets):
            yield *self.encode_buffers(offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]]), i


def _pieces(k0: np.ndarray, k1: np.ndarray) -> list[str]:
    data = np.stack([k0, k1], 1).astype("<u8").tobytes()
    sizes = (k1 >> np.uint64(56)).tolist()
    return [data[16 * i : 16 * i + n].decode() for i, n in enumerate(sizes)]


def with_ends(ids: np.ndarray, counts: np.ndarray, end: int = END_ID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids with the end id after each text's, their numbers, where each text's begin)."""
    sizes = counts + 1
    ends = np.cumsum(sizes)
    out = np.full(int(ends[-1]) if len(ends) else 0, end, np.uint32)
    own = np.ones(len(out), bool)
    own[ends - 1] = False
    out[own] = ids
    return out, sizes, ends - sizes


def encoder(path: str) -> PieceEncoder:
    """One per process and file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def forget() -> None:
    """Encoders end with the tasks that use them."""
    _encoders.clear()
