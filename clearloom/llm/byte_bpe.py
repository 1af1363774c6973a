"""Byte-level BPE from a rank file, by its own encoder and decoder.

Token bytes are mapped to Latin-1 strings, and a pyahocorasick automaton finds every token in a piece in one pass; the longest token at each place is kept. Encoding goes from left to right: take the longest token; if it isn't compatible with the one before (their joined bytes would be merged otherwise), take its longest proper prefix that is a token; if none is left, step back and mark the place as a dead end. A sequence whose neighbours are all compatible is what the merges yield, and dead ends are met once, so the time is linear in the piece. Compatibility and encoded pieces are memoised, with bounds.

Nulls: a null text is an empty one (no ids). A very long text is one step of numpy, with about 40 bytes of memory for each of its own. Repeated rows, null doc_ids and empty tables pass through row by row. Other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table
from .tokens import PieceEncoder

#: Memoised pairs of tokens per worker process; beyond it they start anew.
PAIRS = 400_000


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocab = [b""] * (max(ranks.values()) + 1)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.vocab[rank] = token
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.size = [len(t) for t in self.vocab]
        self._fits: dict[int, bool] = {}
        self._shorter: dict[int, int] = {}

    @classmethod
    def load(cls, path: str) -> "ByteBpe":
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merged(self, raw: bytes) -> list[int]:
        """The merges themselves, lowest rank first: what compatibility is judged by."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        get = self.ranks.get
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        out = self._fits.get(key)
        if out is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            out = self._fits[key] = self.merged(self.vocab[a] + self.vocab[b]) == [a, b]
        return out

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        out = self._shorter.get(token)
        if out is None:
            raw = self.vocab[token]
            out = self._shorter[token] = next((self.ranks[raw[:n]] for n in range(len(raw) - 1, 0, -1) if raw[:n] in self.ranks), -1)
        return out

    def encode_piece(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        n, size, fits = len(raw), self.size, self.fits
        longest = [0] * n
        for end, (token, width) in self.automaton.iter(raw.decode("latin-1")):
            longest[end - width + 1] = token  # longer ones end later
        out: list[int] = []
        alive = bytearray(b"\x01") * (n + 1)
        at, token = 0, longest[0]
        while True:
            while token >= 0:
                end = at + size[token]
                if alive[end] and (not out or fits(out[-1], token)):
                    break
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            else:
                alive[at] = 0
                token = out.pop()
                at -= size[token]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


class ByteBpeText(PieceEncoder):
    """Whole texts: the pattern's matches one by one. Pieces are cut and kept as PieceEncoder does."""

    def __init__(self, path: str, pieces: int = 1 << 19):
        self.bpe = ByteBpe.load(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self._begin(pieces, [])

    def learn(self, new: list[str]) -> list[np.ndarray]:
        find, piece = self.pattern.findall, self.bpe.encode_piece
        return [np.array([i for match in find(p) for i in piece(match.encode())], np.uint32) for p in new]


_loaded: dict[str, ByteBpeText] = {}


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = ByteBpeText(path)
        enc = _loaded[path]
        for batch in batches:
            for ids, counts, first in enc.encode_column(batch.column(1)):
                ends = np.cumsum(counts).tolist()
                raw, a, b = memoryview(ids.astype("<u4").tobytes()), [], []
                for i, j in zip([0, *ends], ends):
                    a.append(hashlib.sha256(raw[4 * i : 4 * j]).hexdigest())
                    b.append(hashlib.sha256(enc.bpe.decode(ids[i:j].tolist())).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
