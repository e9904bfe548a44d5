"""Hierarchical multi-length sequence packing.

1. Tokenize each document once (one narrow stage).  Equal white-space chunks have
   equal ids, so a block of texts is split and reduced to its distinct chunks in Arrow
   columns, and a worker keeps bounded memos from chunk, and from word, to ids; chunks
   of plain letters and marks go to the tokenizer's merge model by their words.
2. Cut: a document of more than `window` ids gives full windows and one rest, so
   every piece and its checksum come from that single pass.
3. Route: a piece belongs to the smallest context tier (256, 512, 1024, 2048 by
   default) that holds it.  Hash groups of a few thousand pieces are packed
   independently, so the work spreads over any number of tasks.
4. Pack each tier, longest first: a piece opens a sequence of its tier, and the
   gap takes the longest piece of the same or a shorter tier that still fits.
   A sequence that ends exactly at its tier (a power of two) stands as it is; the
   other short-tier sequences become fillers of long windows.
5. Balance: sequences are dealt to step groups by a serpentine order of length.

The string of a special token in a text gives that token's id, as in the tokenizer's own
default.  Null texts count as empty: such a document is the single end id.  Repeated
doc_id rows are separate documents with equal ids.  An empty table packs to an
empty result.  A null doc_id is kept as null.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import cut

TIERS = (256, 512, 1024, 2048)
#: Pieces of a packing group on average.
GROUP = 4_000
#: Sequences of a step group.
STEP = 64
#: Bytes of a memo in a worker; bounds memory only.
MEMO = 16_000_000
#: Bytes of texts that are tokenized together (or one text).
BLOCK = 16_000_000
#: New chunks that are encoded together, as one text.
TOGETHER = 1_024
#: A chunk of letters with one lower-case letter each, which no normal form changes, and the marks behind it: two words
#: to the tokenizer.  The dotted capital I lower-cases to two characters and an apostrophe may join letters; they are left out.
PLAIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-įı-ƺ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"


def lists(lengths: np.ndarray, ids: np.ndarray | pa.Array) -> pa.ListArray:
    """Lists of these lengths over ids that stand one after another."""
    ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.uint32()))


def lengths_of(ids: pa.ListArray) -> np.ndarray:
    return pc.list_value_length(ids).to_numpy().astype(np.int64)


class Memo:
    """Keys and their ids, in columns; beyond MEMO bytes only those of the latest block stay."""

    def __init__(self):
        self.keys, self.ids = pa.array([], pa.string()), lists(np.zeros(0), np.zeros(0, "<u4"))

    def ids_of(self, keys: pa.Array, learn: Callable[[pa.Array], pa.ListArray]) -> pa.ListArray:
        """Ids of distinct keys; learn gives those of the new ones."""
        at = pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy().copy()
        if (new := at < 0).any():
            at[new] = len(self.keys) + np.arange(new.sum())
            fresh = keys.filter(pa.array(new))
            self.ids = pa.concat_arrays([self.ids, learn(fresh)])
            self.keys = pa.concat_arrays([self.keys, fresh])
        got = self.ids.take(pa.array(at))
        if self.keys.nbytes + self.ids.nbytes > MEMO:
            self.keys, self.ids = keys, got
        return got


class ChunkTokenizer:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        # As the library has it, the string of a special token in a text is that token.
        self.plain, self.marking = Tokenizer.from_file(path), Tokenizer.from_file(path)
        special = max(t for t in self.plain.get_added_tokens_decoder())
        self.mark, self.mark_id = self.plain.get_added_tokens_decoder()[special].content, special
        #: The merge model alone, over words as they are spelt in the vocabulary; a word's last token has the model's suffix.
        self.merge = Tokenizer(self.plain.model)
        self.merge.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.last = np.zeros(self.plain.get_vocab_size(), bool)
        self.last[[i for t, i in self.plain.get_vocab().items() if t.endswith(self.plain.model.end_of_word_suffix)]] = True
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: The character that stands for each byte in the vocabulary; letters come as Latin-1 readings of their UTF-8 bytes.
        spelt = {b: level.pre_tokenize_str(chr(b))[0][0] for b in range(33, 127)} | {32: " "}
        self.spelling = spelt | {b: c for x in ("àÀĀǀ") for b, c in zip(x.encode(), level.pre_tokenize_str(x)[0][0], strict=True)}
        self.spelling |= {b: level.pre_tokenize_str(bytes((0xC3, b)).decode())[0][0][1] for b in range(0x80, 0xC0)}
        self.spelling |= {b: level.pre_tokenize_str(bytes((b, 0x80)).decode())[0][0][0] for b in range(0xC3, 0xC8)}
        self.chunks, self.words = Memo(), Memo()

    def merged(self, words: pa.Array) -> pa.ListArray:
        """Ids of words as the tokenizer's own patterns part them, in lower case; the empty word has none."""
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py()
        spelt = joined.encode().decode("latin-1").translate(self.spelling)
        ids = np.array(self.merge.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, "<u4")
        lengths = np.zeros(len(words), np.int64)
        lengths[pc.binary_length(words).to_numpy() > 0] = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
        return lists(lengths, ids)

    def together(self, chunks: list[str]) -> Iterator[bytes]:
        """Ids of other chunks: in one text, parted by a special token; chunks that may hold one themselves, one by one."""
        for i in range(0, len(chunks), TOGETHER):
            own = chunks[i : i + TOGETHER]
            rest = [c for c in own if "<" not in c]
            ids = np.array(self.marking.encode_batch_fast([f" {self.mark} ".join(rest)], add_special_tokens=False)[0].ids, "<u4")
            marks, raw = (4 * np.flatnonzero(ids == self.mark_id)).tolist(), ids.tobytes()
            parts = map(raw.__getitem__, map(slice, [0, *(m + 4 for m in marks)], [*marks, len(raw)]))
            for c in own:
                yield np.array(self.plain.encode(c, add_special_tokens=False).ids, "<u4").tobytes() if "<" in c else next(parts)

    def learn(self, chunks: pa.Array) -> pa.ListArray:
        """Ids of new chunks: plain ones by their words, the others by the whole tokenizer."""
        parted = pc.extract_regex(chunks, PLAIN)
        plain = parted.is_valid().to_numpy(zero_copy_only=False)
        word, marks = parted.drop_null().flatten()
        words = pa.concat_arrays([pc.utf8_lower(word), marks]).dictionary_encode()
        pairs = self.words.ids_of(words.dictionary, self.merged).take(pa.array(words.indices.to_numpy().reshape(2, -1).T.ravel()))
        odd = list(self.together(chunks.filter(pa.array(~plain)).to_pylist()))
        both = [lists(lengths_of(pairs).reshape(-1, 2).sum(1), pairs.flatten()), lists(np.array([len(x) // 4 for x in odd]), np.frombuffer(b"".join(odd), "<u4"))]
        order = np.empty(len(chunks), np.int64)
        order[plain], order[~plain] = np.arange(len(word)), len(word) + np.arange(len(odd))
        return pa.concat_arrays(both).take(pa.array(order))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of each text's."""
        split = pc.ascii_split_whitespace(texts)
        chunks = split.flatten().dictionary_encode()
        ids = self.chunks.ids_of(chunks.dictionary, self.learn).take(chunks.indices)
        ends = np.concatenate(([0], np.cumsum(lengths_of(ids))))
        return ids.flatten().to_numpy(), np.diff(ends[split.offsets.to_numpy()])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed 32-bit ids of each text."""
        ids, n = self.encode(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def pieces(docs: DataFrame, path: str, end_id: int = 1, window: int = TIERS[-1]) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens for each piece of each document (its ids, then end_id)."""
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def of_block(docs: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        ids, n = tokenizer(path).encode(texts)
        coded, n = np.insert(ids, np.cumsum(n), end_id), n + 1
        parts = -(-n // window)
        row = np.repeat(np.arange(len(n)), parts)
        start = window * (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts))
        length = np.minimum(window, n[row] - start)
        first, raw = 4 * ((np.cumsum(n) - n)[row] + start), memoryview(coded.astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([docs.take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, crc, n[row]))], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text").cast(pa.string()).fill_null(""), batch.column("doc_id")
            block = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // BLOCK
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a < b:
                    yield of_block(ids[a:b], texts[a:b])

    schema = ", ".join(f"{c} long" for c in columns)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


class Shelf:
    """Pieces by length; take() gives the longest that fits."""

    def __init__(self, lengths: np.ndarray, which: np.ndarray):
        self.items: dict[int, list[int]] = {}
        for i in which.tolist():
            self.items.setdefault(int(lengths[i]), []).append(i)
        self.sizes = sorted(self.items)

    def take(self, room: int) -> int | None:
        k = bisect_right(self.sizes, room) - 1
        if k < 0:
            return None
        own = self.items[self.sizes[k]]
        i = own.pop()
        if not own:
            del self.items[self.sizes.pop(k)]
        return i


def pack_group(lengths: np.ndarray, tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[int]]]:
    """(tier, indices of pieces in order) for each sequence of one group."""
    window, done, tier_of = tiers[-1], [], np.searchsorted(np.array(tiers), lengths)
    shelves = [Shelf(lengths, np.flatnonzero(tier_of == k)) for k in range(len(tiers))]

    def fill(room: int, top: int) -> tuple[list[int], int]:
        got = []
        for k in range(top, -1, -1):
            while room and (i := shelves[k].take(room)) is not None:
                got.append(i)
                room -= int(lengths[i])
        return got, room

    # The longest tier: each piece opens a window, shorter tiers fill the gap.
    while (i := shelves[-1].take(window)) is not None:
        more, _ = fill(window - int(lengths[i]), len(tiers) - 1)
        done.append((window, [i, *more]))
    # Shorter tiers at their own context size; what isn't exactly full fills long windows.
    loose: list[list[int]] = []
    for k in range(len(tiers) - 2, -1, -1):
        while (i := shelves[k].take(tiers[k])) is not None:
            more, room = fill(tiers[k] - int(lengths[i]), k)
            if room:
                loose.append([i, *more])
            else:
                done.append((tiers[k], [i, *more]))
    total = np.array([int(lengths[x].sum()) for x in loose], np.int64)
    shelf = Shelf(total, np.arange(len(loose)))
    while (i := shelf.take(window)) is not None:
        own, room = [i], window - int(total[i])
        while room and (j := shelf.take(room)) is not None:
            own.append(j)
            room -= int(total[j])
        done.append((window, [p for j in own for p in loose[j]]))
    return done


def pack(cut_pieces: DataFrame, n_groups: int, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Adds sequence_id, offset, tier, sequence_tokens and step_group to pieces, and drops their `row`, a stored number of
    each piece that deals them to groups: so equal pieces (of many empty documents without ids, say) spread too."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        lengths = group["length"].to_numpy(np.int64)
        sequences = pack_group(lengths, tiers)
        totals = np.array([int(lengths[x].sum()) for _, x in sequences], np.int64)
        n_steps = -(-len(sequences) // STEP)
        step = np.empty(len(sequences), np.int64)
        by_length = np.argsort(-totals, kind="stable")
        at = np.arange(len(sequences))
        step[by_length] = np.where(at // n_steps % 2, n_steps - 1 - at % n_steps, at % n_steps)
        order = np.array([i for _, x in sequences for i in x], np.int64)
        seq = np.repeat(np.arange(len(sequences)), [len(x) for _, x in sequences])
        ends = np.cumsum(lengths[order])
        firsts = np.concatenate(([0], np.cumsum(totals)[:-1]))
        out = group.iloc[order].reset_index(drop=True)
        high = int(group["packing_group"].iloc[0]) << 32
        out["sequence_id"], out["offset"] = high + seq, ends - lengths[order] - firsts[seq]
        out["tier"], out["sequence_tokens"] = np.array([t for t, _ in sequences])[seq], totals[seq]
        out["step_group"] = high + step[seq]
        return out.drop(columns=["packing_group", "row"])

    grouped = cut_pieces.withColumn("packing_group", F.pmod(F.xxhash64("row"), F.lit(n_groups)))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, sequence_tokens long, step_group long"
    return grouped.groupBy("packing_group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Tokenizes, cuts and packs documents (doc_id, text): one row for each piece.

    The pieces (a few integers each, never ids) are written to the shared folder
    once; their count sets the number of packing groups."""
    cut_pieces = cut(pieces(docs, path, end_id, tiers[-1]).withColumn("row", F.monotonically_increasing_id()))
    return pack(cut_pieces, max(1, -(-cut_pieces.count() // GROUP)), tiers)
