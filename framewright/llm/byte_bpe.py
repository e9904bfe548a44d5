"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the whole vocabulary: a pre-token that
is itself a vocabulary entry gets its id from one table slot and one comparison.
Tier two merges the bytes of the others: symbols in a doubly linked list, the
candidate pairs in a heap ordered by (rank, position).  Both tiers run once for
each distinct pre-token that a Python worker meets; a bounded memo keeps the
outcome.  The corpus side is one narrow Spark stage without a shuffle.

Null texts encode as empty texts: no ids, and decoding gives the empty string.
Repeated rows stay repeated; extra columns pass through `encode` untouched.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct pre-tokens a worker remembers before it starts afresh; bounds memory only, never results.
MEMO = 700_000
#: Rows that are held as ids at once inside a worker.
ROWS = 256
#: White space as Unicode's White_Space property has it (the `regex` module's \s adds the separators 1C to 1F).
SPACE = r"\t-\r \x85\xa0  -     　"


def pattern_of(pat: str) -> regex.Pattern:
    """The pre-token pattern with \\s and \\S spelled out, so that it splits where the usual encoder does."""
    return regex.compile(pat.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))


class MinimalPerfectHash:
    """Maps each of n keys to its own slot in 0..n-1 by hash and displacement (buckets placed in order of size)."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.n_buckets = max(1, n // 3)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, n)
        bucket = (h % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.n_buckets)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        self.shift = np.zeros(self.n_buckets, np.int64)  # >= 0: displacement; < 0: -1 - slot
        taken = np.zeros(n, bool)
        for k in np.argsort(-sizes, kind="stable"):
            if sizes[k] < 2:
                break
            own, base, step, at = h[order[starts[k] : starts[k + 1]]], 0, 32, -1
            while at < 0:
                slots = self._mixed(own[None, :], np.arange(base, base + step)[:, None])
                for t in np.flatnonzero(~taken[slots].any(axis=1)):
                    if len(set(slots[t].tolist())) == len(own):
                        taken[slots[t]], at = True, base + int(t)
                        break
                base, step = base + step, min(4096, 2 * step)
            self.shift[k] = at
        free, single = np.flatnonzero(~taken), np.flatnonzero(sizes == 1)
        self.shift[single] = -1 - free[: len(single)]
        self.slot_of_key = self._slots(h)

    def _mixed(self, h: np.ndarray, t: np.ndarray) -> np.ndarray:
        x = h + t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        d = self.shift[(h % np.uint64(self.n_buckets)).astype(np.int64)]
        return np.where(d < 0, -1 - d, self._mixed(h, np.maximum(d, 0)))

    def slots(self, keys: list[bytes]) -> np.ndarray:
        return self._slots(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)))


class ByteBpe:
    """Encoder and decoder over one rank file (`base64 rank` lines)."""

    def __init__(self, path: str, pat: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(k): int(v) for k, v in (x.split() for x in f if x.strip())}
        keys = list(self.ranks)
        self.hash = MinimalPerfectHash(keys)
        self.keys: list[bytes] = [b""] * len(keys)
        self.ids = np.zeros(len(keys), np.int64)
        for k, s in zip(keys, self.hash.slot_of_key.tolist(), strict=True):
            self.keys[s], self.ids[s] = k, self.ranks[k]
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.find = pattern_of(pat).findall
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, bytes] = {}  # ids as packed 32-bit integers

    def merge(self, piece: bytes) -> list[int]:
        """Tier two: always the pair of lowest rank, the leftmost of equals.  A heap entry packs (rank, start, end)."""
        get, n = self.ranks.get, len(piece)
        base = n + 1
        end = list(range(1, base))  # end[i]: where the symbol that starts at i ends; 0: merged away
        left = list(range(-1, n - 1))
        heap = [(r * base + i) * base + i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            rest, e = divmod(pop(heap), base)
            i = rest % base
            mid = end[i]
            if not mid or mid >= e or end[mid] != e:
                continue
            end[i], end[mid] = e, 0
            if e < n:
                left[e] = i
                if (r := get(piece[i : end[e]])) is not None:
                    push(heap, (r * base + i) * base + end[e])
            if (j := left[i]) >= 0 and (r := get(piece[j:e])) is not None:
                push(heap, (r * base + j) * base + e)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def learn(self, pieces: list[str]) -> None:
        """Puts pre-tokens not met so far into the memo, through both tiers."""
        raw = [p.encode() for p in pieces]
        slots = self.hash.slots(raw)
        keys, merge, memo = self.keys, self.merge, self.memo
        for p, b, s, i in zip(pieces, raw, slots.tolist(), self.ids[slots].tolist(), strict=True):
            memo[p] = pack("<i", i) if keys[s] == b else array("i", merge(b)).tobytes()

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.memo) > MEMO:
            self.clear()
        split = [self.find(t) for t in texts]
        if new := set().union(*split).difference(self.memo):
            self.learn(list(new))
        of = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(of, s)), np.int32) for s in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pat: str) -> ByteBpe:
    """One codec for each Python worker and vocabulary."""
    return ByteBpe(path, pat)


def encode(df: DataFrame, path: str, pat: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Adds `out`: the ids of each text (an empty array for null), replacing a column of that name."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pat)
        for batch in batches:
            texts = batch.fillna("").tolist()
            rows: list[np.ndarray] = []
            for i in range(0, len(texts), ROWS):
                rows += own.encode_batch(texts[i : i + ROWS])
            yield pd.Series(rows, dtype=object)

    return df.withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, path: str, pat: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Adds `out`: the bytes that the ids stand for (empty for null)."""

    @F.pandas_udf(T.BinaryType())
    def joined(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, pat)
        for batch in batches:
            yield pd.Series([own.decode(np.asarray(x)) if x is not None else b"" for x in batch], dtype=object)

    return df.withColumn(out, joined(F.col(ids)))


def round_trip(df: DataFrame, path: str, pat: str) -> DataFrame:
    """Encodes and decodes in one pass and returns the digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path, pat)
        names = {i: str(i) for i in own.bytes_of}
        for batch in batches:
            texts, docs = batch["text"].fillna("").tolist(), batch["doc_id"].tolist()
            for i in range(0, len(texts), ROWS):
                coded = own.encode_batch(texts[i : i + ROWS])
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(docs[i : i + ROWS], dtype="Int64"),
                        "n_tokens": [len(x) for x in coded],
                        "ids_sha256": [hashlib.sha256(",".join(map(names.__getitem__, x.tolist())).encode()).hexdigest() for x in coded],
                        "decoded_sha256": [hashlib.sha256(own.decode(x)).hexdigest() for x in coded],
                    }
                )

    return df.select("doc_id", "text").mapInPandas(run, schema)
