"""Byte-level BPE without merging: longest matches, taken back where neighbours do not fit.

Bytes are read as Latin-1, so that an Aho-Corasick automaton over the vocabulary finds, in one
pass, the longest token at every position. Tokens are put one after another; two may be
neighbours only if BPE by rank would not have merged across them, which depends on the two alone and
is remembered. Where none fits, the last token is shortened. A position once left is
never tried again, so the work is linear in the text, and the result is the one that
merging by rank gives.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.pieces import Pieces

FIT_MEMO = 1_000_000


class Codec:
    """``ranks``: token bytes to id, ids in merge order, with all 256 bytes. ``pattern``: its matches are encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.token = dict(map(reversed, ranks.items()))
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}
        self.length = [len(self.token[rank]) for rank in range(len(ranks))]
        self.longest = ahocorasick.Automaton()
        for rank, token in sorted(self.token.items()):
            self.halves[rank] = (rank, rank)
            for i in range(1, len(token)):
                pair = ranks.get(token[:i]), ranks.get(token[i:])
                if None not in pair and max(pair) < rank and self._neighbours(*pair):
                    self.halves[rank] = pair
                    self.pairs[pair] = rank
                    break
            self.shorter[rank] = next((ranks[token[:i]] for i in range(len(token) - 1, 0, -1) if token[:i] in ranks), None)
            self.longest.add_word(token.decode("latin-1"), rank)
        self.longest.make_automaton()
        self.fits.clear()

    def _neighbours(self, left: int, right: int) -> bool:
        """Undo the latest merge on either side, again and again: no merge across the seam may come before it."""
        before = 1 << 62
        while True:
            if self.pairs.get((left, right), before) < before:
                return False
            l_inner, r_inner = self.halves[left][1], self.halves[right][0]
            if l_inner == left and r_inner == right:
                return True
            if r_inner == right or (l_inner != left and left > right):
                before, left = left, l_inner
            else:
                before, right = right + 1, r_inner

    def _fit(self, left: int, right: int) -> bool:
        if len(self.fits) >= FIT_MEMO:
            self.fits.clear()
        known = self.fits[left, right] = self._neighbours(left, right)
        return known

    def match(self, raw: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        size = len(raw)
        length, shorter, fits = self.length, self.shorter, self.fits
        best = [0] * size
        for end, rank in self.longest.iter(raw.decode("latin-1")):
            best[end - length[rank] + 1] = rank  # later ends are longer
        dead: set[int] = set()
        out, at, now = [], 0, best[0]
        while True:
            if out:
                last = out[-1]
                while now is not None:
                    if not dead or at + length[now] not in dead:
                        known = fits.get((last, now))
                        if known is None:
                            known = self._fit(last, now)
                        if known:
                            break
                    now = shorter[now]
            else:
                while now is not None and length[now] in dead:
                    now = shorter[now]
            if now is None:
                dead.add(at)
                now = out.pop()
                at -= length[now]
            else:
                out.append(now)
                at += length[now]
                if at == size:
                    return out
                now = best[at]

    def encode(self, text: str) -> list[int]:
        if text[1:].isalpha() and text[0] == " ":
            return self.match(text.encode())
        return [i for m in self.find(text) for i in self.match(m.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(1)
def _worker(path: str, pattern: str) -> Pieces:
    codec = Codec(read_ranks(path), pattern)

    def both(piece: str) -> tuple[str, bytes]:
        ids = codec.encode(piece)
        return " ".join(map(str, ids)), codec.decode(ids)

    return Pieces(both, lambda a, b: (f"{a[0]} {b[0]}", a[1] + b[1]))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode every text and decode its ids: doc_id, n_tokens, ids_sha256, decoded_sha256, one row per row of ``docs``.

    ids_sha256 is of the decimal ids joined by one space. Null and empty texts: no ids, digests of the
    empty string. Repeated rows and null ids keep their rows; other columns are ignored; an empty table
    gives no rows. ``ranks_path`` must be there on every executor, as installed tokenizer files are.
    """

    def run(batches):
        pieces = _worker(ranks_path, pattern)
        for batch in batches:
            n, ids_sha, decoded_sha = [], [], []
            for text in batch.column("text").to_pylist():
                done = pieces.of(text)
                ids = " ".join([a for a, _ in done])
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded = hashlib.sha256()
                decoded.update(b"".join([b for _, b in done]))
                decoded_sha.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
