"""Quality rules, centroid clustering and importance resampling: brute force, known properties and awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import pairwise
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.llm import centroids, common, importance, quality
from tests.conftest import SF
from tests.llm.test_llm import AWKWARD, CLASHING, SCHEMA, same

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# ---------------------------------------------------------------- 11 quality rules

def counted(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by definition."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    places = {i + k for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(places)


def test_counts_against_brute_force(spark):
    r = random.Random(11)
    texts = [" ".join(r.choice("ab cd E# é 中|文 x".split() + ["\n", "\t"]) for _ in range(r.randrange(60))) for _ in range(150)]
    texts += ["a b c d e a b c d e", "a a a a a", "a a a a a a", "a b c d e", "\n\n \n", "x\ny\nx\nx", "<|>#", " ".join(f"w{i}" for i in range(5000)) * 2] + [t for _, t, _ in AWKWARD]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r[1:6]) for r in quality.counts(rows).collect()}
    assert got == {i: counted(t) for i, t in enumerate(texts)}


def test_hash_collisions_change_nothing(spark, monkeypatch):
    """All windows share one hash: the texts of the windows decide."""
    monkeypatch.setattr(quality.F, "xxhash64", lambda w: quality.F.length(w).cast("long") * 0)
    rows = spark.createDataFrame([(0, "a b c d e f a b c d e"), (1, "a b c d e f g h i j k"), (2, "a b c d e f g")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality.counts(rows).collect()} == {0: 10, 1: 0, 2: 0}


def test_estimation_finds_accuracies():
    """Votes drawn from a known mixture: the estimated log-odds come close to the true ones, and verdicts are mostly right."""
    g = np.random.default_rng(3)
    good = g.random(40_000) < 0.8
    chances = [({True: (0.02, 0.18, 0.8), False: (0.7, 0.25, 0.05)}), ({True: (0.05, 0.45, 0.5), False: (0.5, 0.3, 0.2)}), ({True: (0.01, 0.09, 0.9), False: (0.4, 0.2, 0.4)}), ({True: (0.1, 0.6, 0.3), False: (0.6, 0.3, 0.1)})]
    votes = np.array([[g.choice((-1, 0, 1), p=c[bool(z)]) for c in chances] for z in good])
    weights = quality.estimate(Counter(map(tuple, votes.tolist())), 4, 200)
    assert weights.before == pytest.approx(math.log(4), abs=0.25)
    for j, c in enumerate(chances):
        for v in (-1, 0, 1):
            assert weights.adds[j][v] == pytest.approx(math.log(c[True][v + 1] / c[False][v + 1]), abs=0.5)
    verdicts = np.array([weights.posterior(tuple(v)) >= 0.5 for v in votes.tolist()])
    assert (verdicts == good).mean() > 0.93


def test_one_bad_vote_need_not_reject():
    """The posterior replaces all-must-pass: a rule that disagrees with all others does little harm."""
    patterns = {(1, 1, 1, 1): 700, (-1, 1, 1, 1): 100, (1, -1, -1, -1): 90, (-1, -1, -1, -1): 10}
    weights = quality.estimate(patterns, 4)
    assert weights.posterior((-1, 1, 1, 1)) > 0.5 > weights.posterior((1, -1, -1, -1))


def test_verdicts_on_labelled_documents(spark):
    """Labels are never used; they show that junk goes and clean documents stay."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs).join(labels.select("doc_id", labels["quality"].alias("label")), "doc_id").where("NOT base_failed").collect()
    kept = {k: [r["kept"] for r in rows if r["label"] == k] for k in (0, 1)}
    assert len(kept[0]) > 10 and np.mean(kept[0]) < 0.05
    assert len(kept[1]) > 100 and np.mean(kept[1]) > 0.97


def test_quality_on_awkward_rows(spark):
    docs, clashing, none = spark.createDataFrame(AWKWARD, SCHEMA), spark.createDataFrame([(*r, 1, "x", "x", "x", "x", "x") for r in AWKWARD], CLASHING), spark.createDataFrame([], SCHEMA)
    out = quality.judge(docs)
    assert same(out, quality.judge(clashing)) and quality.judge(none).count() == 0
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(out.collect()) == len(AWKWARD) and rows[3]["base_failed"] and not rows[3]["kept"] and rows[3]["n_words"] == 0
    kept = quality.keep_good(clashing)
    assert kept.columns == clashing.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in out.where("kept").collect()}
    assert quality.keep_good(none).count() == 0


# ---------------------------------------------------------------- 12 centroid clustering

def lloyd(rows, k, rounds, seed):
    """By definition, in Python integers; rows are (id, list of int)."""
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    points = [list(v) for _, v in sorted(rows, key=key)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda: [min((dist(v, c), j) for j, c in enumerate(points)) for _, v in rows]
    for _ in range(rounds):
        own = near()
        for j in range(len(points)):
            mine = [v for (_, v), (_, c) in zip(rows, own, strict=True) if c == j]
            if mine:
                points[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, c, d, hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(rows, near(), strict=True)]


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("kind", ["spread", "copies", "few", "odd"])
def test_clusters_against_lloyd(spark, kind):
    r = random.Random(kind)
    if kind == "spread":
        rows = [(i, [r.gauss(i % 5, 1) for _ in range(4)]) for i in range(300)]
    elif kind == "copies":
        rows = [(i, [0.5, -0.25, 0, 1] if i % 3 else [float(r.randrange(3)) for _ in range(4)]) for i in range(200)]
    elif kind == "few":
        rows = [(5, [1.0, 2, 3, 4]), (9, [1.0, 2, 3, 4]), (7, [-1.0, 0, 0, 0.0009])]
    else:
        rows = [(i if i % 4 else 8, [r.uniform(-1e5, 1e5) for _ in range(4)]) for i in range(60)] + [(None, [3.0, 3, 3, 3])] * 2
    bad = [(1000, None), (1001, []), (1002, [1.0] * 3), (1003, [1.0, None, 1, 1]), (1004, [float("nan"), 1, 1, 1]), (1005, [float("inf"), 1, 1, 1]), (1006, [1e30, 1, 1, 1])]
    df = spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], 0) for i, v in rows + bad], VECTORS)
    out = centroids.clusters(df, 8, 4, 3, 4)
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows]
    want = lloyd(whole, 8, 4, 3)
    assert Counter((x["vec_id"], x["cluster"], x["distance"], x["centroid_sha256"]) for x in out.collect()) == Counter(want)
    total = Counter()
    for _, c, d, _ in want:
        total[c] += d
    assert {(x["cluster"], x["cluster_inertia"], x["inertia"]) for x in out.collect()} == {(c, t, sum(total.values())) for c, t in total.items()}
    assert centroids.clusters(df.where("vec_id >= 1000"), 8, 4, 3, 4).count() == 0
    clash = df.selectExpr("*", "'x' AS cluster", "'x' AS v", "'x' AS distance", "'x' AS inertia")
    assert same(out, centroids.clusters(clash, 8, 4, 3, 4))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(0, 2**32 - 1), st.sampled_from([2, 3, 40]))
def test_scan_is_exact(k, seed, spread):
    """From any previous assignment, ties included, and with equal centroids."""
    g = np.random.default_rng(seed)
    x, points = g.integers(0, spread, (50, 3)), g.integers(0, spread, (k, 3))
    cluster, best = centroids.nearest(x, g.integers(0, k, 50), points)
    every = centroids.squared(x[:, None], points[None])
    assert (best == every.min(1)).all() and (cluster == every.argmin(1)).all()


def test_scan_stops(monkeypatch):
    """Far centroids are never measured."""
    seen = []
    exact = centroids.squared
    monkeypatch.setattr(centroids, "squared", lambda a, b: seen.append(np.broadcast(a, b).shape) or exact(a, b))
    points = np.array([[0, 0], [100, 0], [1000, 0], [1000, 1000]])
    centroids.nearest(np.array([[1, 1]] * 10), np.zeros(10, int), points)
    assert sum(s[0] for s in seen if len(s) == 2) == 10  # only their own


def test_old_tables_are_removed(spark):
    """Two tables at most stay on disk, however many rounds."""
    folder = Path(common.shared_dir(spark).removeprefix("file://"), spark.sparkContext.applicationId)
    before = set(folder.glob("cut-*"))
    out = centroids.clusters(spark.read.parquet(f"{SF}/embeddings.parquet"), rounds=3)
    assert len(set(folder.glob("cut-*")) - before) <= 2 and out.count() > 0


# ---------------------------------------------------------------- 13 importance resampling

def features(text, longest=1):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def drawn(docs, target, buckets, longest, seed, share, least):
    own, s, t, rows = {}, Counter(), Counter(), []
    for k, (_, text) in enumerate(docs):
        own[k] = features(text, longest)
        s.update(b % buckets for b in own[k][0])
    for (text,) in target:
        t.update(b % buckets for b in features(text, longest)[0])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    for k, (i, _) in enumerate(docs):
        weight = sum(gain[b % buckets] for b in own[k][0]) // len(own[k][0]) if own[k][0] else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own[k][0]), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), own[k][1]))
    order = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return rows, order[: share * len(order) // 100]


@pytest.mark.parametrize(("longest", "share"), [(1, 10), (2, 35), (3, 100)])
def test_resampling_against_brute_force(spark, longest, share):
    r = random.Random(longest)
    docs = [(i if i % 9 else None, " ".join(r.choice(["river", "Bank", "élan", "fox", "x1", "中文", "the"]) for _ in range(r.randrange(12)))) for i in range(200)]
    docs += [(1, "fox fox fox fox")] * 3 + [(i, t) for i, t, _ in AWKWARD]
    target = [("the river bank",), (None,), ("",), ("fox and river",)]
    out = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(target, "text string"), 50, longest, 7, share, 4)
    rows, order = drawn(docs, target, 50, longest, 7, share, 4)
    got = out.collect()
    assert Counter((x["doc_id"], x["n_features"], x["weight"], x["score"]) for x in got) == Counter(x[:4] for x in rows)
    ranked = sorted((x for x in got if x["rank"] is not None), key=lambda x: x["rank"])
    assert [x["rank"] for x in ranked] == list(range(1, len(order) + 1))
    assert [(x["score"], x["doc_id"]) for x in ranked] == [(x[3], x[0]) for x in order]
    assert all(a["score"] >= b["score"] for a, b in pairwise(ranked))


def test_resampling_on_awkward_rows(spark):
    docs, clashing, none = spark.createDataFrame(AWKWARD, SCHEMA), spark.createDataFrame([(*r, 1, "x", "x", "x", "x", "x") for r in AWKWARD], CLASHING), spark.createDataFrame([], SCHEMA)
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    out = importance.resample(docs, target)
    assert out.count() == len(AWKWARD) and same(out, importance.resample(clashing, target))
    assert importance.resample(none, target).count() == 0 and importance.resample(docs, target.limit(0)).count() == len(AWKWARD)
    own = importance.draw(clashing, target, share=100, least_words=1)
    assert set(own.columns) == {*clashing.columns, "rank"} and {r["doc_id"] for r in own.collect()} >= {1, 2, 5, 6, 7}


def test_no_row_but_drawn_ones_is_shuffled(spark):
    """The scoring plan is narrow: no exchange, no generator."""
    plan = importance.scored(spark.read.parquet(f"{SF}/documents.parquet"), [1] * 100)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Python" not in plan


def test_crc_in_sql():
    """The checksum that the SQL form computes from a table is the usual one."""
    text = importance.sql()
    head = text[: text.index("d AS MATERIALIZED")]
    got = duckdb.sql(head.rstrip().rstrip(",") + " SELECT t FROM tab").fetchall()[0][0]
    assert got == [zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF ^ (0xFFFFFFFF >> 8) for i in range(256)] or got[1] == 0x77073096
