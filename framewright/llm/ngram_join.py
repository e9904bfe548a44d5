"""N-gram Jaccard self-join by chosen paths.

A document is its set of five-word shingles (lower-cased words; a text of fewer
words is one shingle of all of them, so empty texts equal each other).

1. Equal sets collapse to one node that counts its copies.
2. A node's sketch is 96 tokens sampled from its set by min-hash.  In a run all nodes
   start in one bucket; a bucket is split by one sampled token, in a quarter of the
   paths by two, so a node takes 1 / SIMILARITY branches on average and a pair at
   the threshold is expected to stay together on one path at every depth.  Buckets of
   more than LEAF nodes are split on, up to LEVELS times.
3. Runs are repeated until the chance to miss a pair at the threshold is MISS at most:
   `runs_for` computes it from the branching and the sampling.  All nodes take part in
   the runs that two levels need; those whose buckets are too large even then, in the
   number of runs that the last level needs.
4. Small buckets are compared in full on the sketches (at least NEED equal tokens, and
   compatible sizes).  So is a bucket that a further token hardly splits (its sets are
   alike) or that is too large at the last level, in cells of bounded size.
5. The candidate pairs' components are compared exactly on whole shingle sets, in
   blocks of bounded number and bytes: no pair rows exist, only each node's number of
   links and one edge to its group.
6. Verified edges give the classes.

Copies are never expanded into pairs.  Documents without an id keep a null id.
Extra columns are ignored; repeated rows count as copies; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import cut
from framewright.llm.components import components

WORDS, SIMILARITY = 5, 0.8
#: Chance with which a pair of SIMILARITY may be missed: a third each in the first runs, in the deep ones, in comparing sketches.
MISS = 1e-5
#: Sampled tokens of a sketch; one path in BRANCH splits by two of them.
TOKENS, BRANCH = 96, 4
LEVELS, LEAF = 6, 2_048
#: A bucket of which this share stays together under one more token holds sets that are alike.
ALIKE = 0.75
#: Nodes of a block in which large buckets are compared on sketches.
CELL = 8_192


def meets(depth: int, share: float) -> float:
    """Chance that a pair with this share of equal tokens has a path of the depth in common, in one run."""
    q = 1.0
    for _ in range(depth):
        miss = 1 - share * q
        q = 1 - ((1 - 1 / BRANCH) * miss + miss * miss / BRANCH)
    return q


def shares(similarity: float) -> list[tuple[float, float]]:
    """(share of equal tokens, its probability) of two sets of the similarity."""
    return [(k / TOKENS, comb(TOKENS, k) * similarity**k * (1 - similarity) ** (TOKENS - k)) for k in range(TOKENS + 1)]


def runs_for(depth: int, similarity: float = SIMILARITY, miss: float = MISS / 3) -> int:
    """Runs after which a pair of the similarity is missed at a depth with the chance `miss` at most."""
    each, runs = [(p, 1 - meets(depth, share)) for share, p in shares(similarity)], 1
    while sum(p * q**runs for p, q in each) > miss:
        runs += 1
    return runs


def need(similarity: float = SIMILARITY, miss: float = MISS / 3) -> int:
    """Equal tokens that a pair of the similarity falls short of with the chance `miss` at most."""
    total, k = 0.0, -1
    for k, (_, p) in enumerate(shares(similarity)):
        total += p
        if total > miss:
            break
    return k


#: Nodes of a block in exact comparison, and its shingles on average; the same of a task's group of small components.
BLOCK, WEIGHT = 2_048, 3_000_000
GROUP, GROUP_WEIGHT = 1_000, 1_000_000
MEMO = 150_000
#: Multiplications up to which intersections are counted by a dense product.
DENSE = 2e10
FIND = re.compile(r"\w+").findall
SALT = np.random.default_rng(20).integers(1, 2**63, (2, TOKENS), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: For an id that is null: it comes last.
NO_ID = 2**63 - 1


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit shingle hashes of a text, sorted."""
    found = FIND((text or "").lower())
    h = np.fromiter(map(word_hashes().__getitem__, found), np.uint64, len(found))
    size = min(words, len(h))
    count = len(h) - size + 1
    out = np.full(count, size, np.uint64)
    for k in range(size):
        out = mixed(out + h[k : k + count])
    return np.unique(out)


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, key (hash of the text), size, s1, s2 (128 bits that name the set) and the sketch of each document."""
    schema = "doc_id long, key long, size long, s1 long, s2 long, sketch array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids, keys = batch["text"].tolist(), batch["doc_id"].tolist(), batch["key"].to_numpy()
            for i in range(0, len(texts), 256):
                sets = [shingles(t, words) for t in texts[i : i + 256]]
                flat = np.concatenate(sets)
                size = np.array([len(s) for s in sets])
                starts = np.concatenate(([0], np.cumsum(size)[:-1]))
                sketch = np.empty((len(sets), SALT.shape[1]), np.int32)
                for k in range(SALT.shape[1]):
                    low = np.minimum.reduceat((flat ^ SALT[0, k]) * SALT[1, k], starts)
                    sketch[:, k] = (low >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(ids[i : i + 256], dtype="Int64"),
                        "key": keys[i : i + 256],
                        "size": size,
                        "s1": np.add.reduceat(flat, starts).view(np.int64),
                        "s2": np.add.reduceat(mixed(flat), starts).view(np.int64),
                        "sketch": list(sketch),
                    }
                )

    return texts_of(docs).select("doc_id", "text", "key").mapInPandas(run, schema)


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, id (never null), text and key of each document: id and key together name a text."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NO_ID)).alias("id"), text.alias("text"), F.xxhash64(text).alias("key"))


def labels_of(near: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component, for a symmetric adjacency matrix."""
    n = len(near)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] < 0:
            label[i], front = i, np.array([i])
            while len(front):
                reached = near[front].any(axis=0) & (label < 0)
                label[reached] = i
                front = np.flatnonzero(reached)
    return label


def linked(nodes: np.ndarray, size: np.ndarray, sketch: np.ndarray, needed: int, similarity: float) -> np.ndarray:
    """(node, smallest node of its component) for the pairs with enough equal tokens; a node is compared with what isn't reached yet."""
    rest, pool, pairs = np.arange(len(nodes)), sketch, []
    while len(rest):
        own, front = [rest[0]], [rest[0]]
        rest, pool = rest[1:], pool[1:]
        while front and len(rest):
            x = front.pop()
            near = (pool == sketch[x]).sum(axis=1) >= needed
            near &= np.minimum(size[rest], size[x]) >= similarity * np.maximum(size[rest], size[x]) - 1e-9
            if near.any():
                hit = rest[near]
                own.extend(hit)
                front.extend(hit)
                rest, pool = rest[~near], pool[~near]
        if len(own) > 1:
            ids = np.sort(nodes[own])
            pairs.append(np.stack([ids[1:], np.full(len(ids) - 1, ids[0])], axis=1))
    return np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)


def candidate_edges(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): every node that a run put beside a similar one, with the smallest node of its group there."""
    first, runs, needed = runs_for(2, similarity), runs_for(LEVELS, similarity), need(similarity)
    rng = np.random.default_rng(21)
    order = [rng.permutation(TOKENS)[: 2 * LEVELS].tolist() for _ in range(max(first, runs))]  # a run's tokens: two for each level

    def children(path: Column, one: Column, two: Column) -> Column:
        both = F.when(F.pmod(F.xxhash64(path), F.lit(BRANCH)) == 0, F.xxhash64(path, F.lit(2), two))
        return F.explode(F.filter(F.array(F.xxhash64(path, one), both), lambda x: x.isNotNull())).alias("path")

    def started(part: DataFrame, own: range) -> DataFrame:
        runs_ = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.get("sketch", order[r][0]).alias("one"), F.get("sketch", order[r][1]).alias("two")) for r in own])).alias("x")
        rows = part.select("node", runs_).select("node", "x.*")
        return rows.select("node", "run", F.lit(None).cast("long").alias("up"), children(F.col("run").cast("long"), F.col("one"), F.col("two")))

    def split(big: DataFrame, level: int) -> DataFrame:
        rows = big.join(nodes.select("node", "sketch"), "node")
        token = lambda k: F.get("sketch", F.get(F.array(*[F.lit(o[2 * level + k]) for o in order]), F.col("run")))
        return rows.select("node", "run", F.col("n").alias("up"), children(F.col("path"), token(0), token(1)))

    def counted(rows: DataFrame) -> DataFrame:
        # The counts are written first: then both sides of the join come straight from a shuffle, and Spark splits a hot bucket.
        many = cut(rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"))
        return cut(rows.join(many, "path"))

    alike = F.coalesce(F.col("n") >= ALIKE * F.col("up"), F.lit(False))
    small, large = (F.col("n") <= LEAF) | alike, (F.col("n") > LEAF) & ~alike
    met = counted(started(nodes, range(first)))
    compared, big = [met.where(small)], met.where(large)
    if not big.isEmpty():
        met = counted(split(big, 1))
        compared, big = [*compared, met.where(small)], met.where(large)
    if not big.isEmpty():
        if runs > first:
            deep = cut(big.select("node").distinct())
            more = counted(started(nodes.join(deep, "node", "left_semi"), range(first, runs)))
            then = counted(split(more.where(large), 1))
            compared += [more.where(small), then.where(small)]
            big = big.unionByName(then.where(large))
        for level in range(2, LEVELS):
            met = counted(split(big, level))
            compared, big = [*compared, met.where(small)], met.where(large)
            if big.isEmpty():
                break
        compared.append(big)  # what is too large at the last level
    rows = compared[0]
    for c in compared[1:]:
        rows = rows.unionByName(c)
    blocks = F.ceil(F.col("n") / CELL).cast("int")
    rows = rows.select("node", "path", blocks.alias("blocks"), F.pmod(F.hash("node"), blocks).alias("block"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("path", F.least("block", "other"), F.greatest("block", "other"))
    # No cell has many more than 2 * CELL nodes, so these lists are bounded.
    grouped = rows.select("node", cell.alias("cell")).join(nodes.select("node", "size", "sketch"), "node").groupBy("cell").agg(
        F.collect_list("node").alias("nodes"), F.collect_list("size").alias("sizes"), F.flatten(F.collect_list("sketch")).alias("sketches")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [np.zeros((0, 2), np.int64)]
            for own, size, flat in zip(batch["nodes"], batch["sizes"], batch["sketches"], strict=True):
                out.append(linked(np.asarray(own), np.asarray(size), np.asarray(flat).reshape(len(own), -1), needed, similarity))
            yield pd.DataFrame(np.concatenate(out), columns=["a", "b"])

    return grouped.mapInPandas(run, "a long, b long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of different sets."""
    m = len(sets)
    flat, doc = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[token] > 1
    new = np.cumsum(count > 1) - 1
    token, doc, width = new[token[shared]], doc[shared], int((count > 1).sum())
    if m * m * width <= DENSE and m * width <= 2.5e7:
        table = np.zeros((m, width), np.float32)
        table[doc, token] = 1
        return table @ table.T  # whole numbers, far below 2^24
    # Many alike: what most sets hold is counted by who lacks it, the rest by who holds it.
    order = np.argsort(token, kind="stable")
    ends = np.cumsum(np.bincount(token, minlength=width))
    out, lacks, common = np.zeros((m, m), np.int32), np.zeros(m, np.int32), 0
    everyone = np.ones(m, bool)
    for t in range(width):
        who = doc[order[ends[t - 1] if t else 0 : ends[t]]]
        if 2 * len(who) > m:
            absent = everyone.copy()
            absent[who] = False
            who = np.flatnonzero(absent)
            common += 1
            lacks[who] += 1
        out[np.ix_(who, who)] += 1
    return out + (common - lacks[:, None] - lacks[None, :])


def exact_links(docs: DataFrame, members: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """node, root, links: partial results of exact comparison, block by block.

    members: node, id and key of a document that has it, s1, s2, size, copies, comp, size_of_comp, weight_of_comp."""
    count, weight = members.agg(F.count("*"), F.sum("size")).first()
    n_groups = max(1, -(-count // GROUP), -(-(weight or 0) // GROUP_WEIGHT))
    blocks = F.greatest(F.ceil(F.col("size_of_comp") / BLOCK), F.ceil(F.col("weight_of_comp") / WEIGHT)).cast("int")
    placed = members.withColumns({"blocks": blocks, "block": F.pmod(F.hash("node"), blocks)}).drop("size")
    # Members grow with the corpus, so this is a shuffle join at every size, never a broadcast.
    rows = placed.hint("merge").join(texts_of(docs).select("id", "key", "text").hint("merge"), ["id", "key"])
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    rows = rows.withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(n_groups))).otherwise(F.xxhash64("comp", "i", "j")))

    def compare(nodes: np.ndarray, copies: np.ndarray, side: np.ndarray | None, sets: list[np.ndarray]) -> np.ndarray:
        size = np.array([len(s) for s in sets])
        both = overlaps(sets)
        near = np.empty(both.shape, bool)
        for k in range(0, len(size), 256):
            near[k : k + 256] = both[k : k + 256] * (1 + similarity) >= similarity * (size[k : k + 256, None] + size[None, :]) - 1e-9
        np.fill_diagonal(near, False)
        if side is not None:
            near &= side[:, None] != side[None, :]
        label = labels_of(near)
        low = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(low, label, nodes)
        return np.stack([nodes, low[label], near @ copies], axis=1)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 3), np.int64)]
        for (_, i, j), own in group.groupby(["comp", "i", "j"], sort=False):
            own = own.drop_duplicates(["node", "text"])
            sets = [shingles(t, words) for t in own["text"]]
            names = [(int(s.sum(dtype=np.uint64).view(np.int64)), int(mixed(s).sum(dtype=np.uint64).view(np.int64))) for s in sets]
            right = [n == (a, b) for n, a, b in zip(names, own["s1"], own["s2"], strict=True)]  # hashes of texts may agree
            seen: dict[int, int] = {}
            for k, node in enumerate(own["node"]):
                if right[k]:
                    seen.setdefault(node, k)
            take = list(seen.values())
            if take:
                part = own.iloc[take]
                out.append(compare(part["node"].to_numpy(), part["copies"].to_numpy(), part["block"].to_numpy() if i != j else None, [sets[k] for k in take]))
        return pd.DataFrame(np.concatenate(out), columns=["node", "root", "links"])

    # A diagonal cell of a large component compares one block, another cell two: only pairs across its blocks count there.
    return rows.select("task", "comp", "i", "j", "block", "node", "s1", "s2", "copies", "text").groupBy("task").applyInPandas(run, "node long, root long, links long")


def classed(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """The sketches of all documents, and for each set: s1, s2, size, its class, its number of links, and the smallest id and name in its class."""
    each = cut(sketches(docs, words))
    name = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "key")
    nodes = each.groupBy("s1", "s2", "size").agg(F.min(name).alias("name"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    comps = cut(components(cut(candidate_edges(nodes, similarity).distinct())))
    members = comps.join(nodes.select("node", "name.*", "s1", "s2", "size", "copies"), "node")
    sizes = members.groupBy("label").agg(F.count("*").alias("size_of_comp"), F.sum("size").alias("weight_of_comp"))
    members = cut(members.join(sizes, "label").withColumnRenamed("label", "comp"))
    partial = cut(exact_links(docs, members, similarity, words))
    final = components(partial.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = partial.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.drop("sketch").join(links, "node", "left").join(final, "node", "left")
    known = cut(known.withColumns({"links": F.coalesce("links", F.lit(0)), "label": F.coalesce("label", "node")}))
    named = known.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min("name").alias("keeper"))
    return each, cut(known.join(named, "label").select("s1", "s2", "size", "label", "class_id", "keeper", (F.col("links") + F.col("copies") - 1).alias("n_links")))


def classes(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """doc_id, class_id (smallest id of its class) and n_links (other documents at or above the similarity)."""
    each, per_set = classed(docs, similarity, words)
    return each.select("doc_id", "s1", "s2", "size").join(per_set, ["s1", "s2", "size"]).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """The documents, one of each class: the one with the smallest id (a null one comes last), then text hash, then hash of all columns."""
    _, per_set = classed(docs, similarity, words)
    keepers = per_set.select(F.col("keeper.id").alias("__id"), F.col("keeper.key").alias("__key")).distinct()
    named = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__key": F.xxhash64(F.col("text").cast("string")), "__row": F.xxhash64(*docs.columns)})
    kept = named.join(keepers, ["__id", "__key"], "left_semi")
    first = F.row_number().over(Window.partitionBy("__id", "__key").orderBy("__row"))
    return kept.withColumn("__n", first).where("__n = 1").select(*docs.columns)


def sql() -> str:
    """The same classes in SQL: every pair that shares a shingle, then the smallest reachable id."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) < {WORDS} THEN [array_to_string(words, ' ')]
      ELSE list_distinct(list_transform(range(1, len(words) - {WORDS - 2}), lambda i: array_to_string(list_slice(words, i, i + {WORDS - 1}), ' '))) END AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) * {1 + SIMILARITY} >= {SIMILARITY} * (a.n + b.n) - 1e-9),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT r.doc_id, min(reach) AS class_id, (SELECT count(*) FROM e WHERE e.a = r.doc_id) AS n_links FROM r GROUP BY r.doc_id"""
