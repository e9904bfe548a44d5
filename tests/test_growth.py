"""What must not grow: rows that are shuffled, tasks, and values held, on inputs a few times a block's size."""

import json
import math
import pickle
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import discovery, evaluation, lsh, matching, order, pairing
from framewright.sources import ranged, sinks, stores


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_triangle_shuffles_cells(spark):
    """The pairs are unfolded above the join of cells; cells of any size give every pair once."""
    items = random.Random(1).sample(range(1_000), 57)
    df = pairing.triangle(spark.createDataFrame([(x,) for x in [*items, items[0], None]], "k long"), "k", 10)
    assert sorted(map(tuple, df.collect())) == sorted((a, b) for a in items for b in items if a <= b)
    text = plan(df)
    assert -1 < text.find("explode(y") < text.find("HashJoin")
    assert pairing.triangle(spark.createDataFrame([], "k long"), "k").count() == 0


def test_small_ranges_share_partitions(spark, tmp_path, monkeypatch):
    """Files of few rows: ranges stay as small as asked, but tasks don't grow with them, nor does what a task is sent."""
    x = np.arange(60, dtype="<f4")
    for k in range(20):
        (tmp_path / f"a,b {k:02}.raw").write_bytes((x[: 6 * (k % 5)] + k).tobytes())
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "_no.raw").write_bytes(b"?")
    monkeypatch.setattr(ranged, "TASKS", 7)
    options = {"kind": "raw", "width": "2", "part_bytes": "16", "files": json.dumps(stores.found(spark, f"{tmp_path}/*.raw"))}
    reader = ranged.Reader(options)
    lots = reader.partitions()
    assert len(lots) == 7 and max(b - a for lot in lots for p in lot.parts for a, b in p.stretches) == 2
    assert len(pickle.dumps(reader)) < len(options["files"])
    got = sorted((r["path"][-6:-4], r["frame_no"], *r["features"]) for r in ranged.scan(spark, "raw", [f"{tmp_path}/*.raw", f"{tmp_path}/in"], width=2, part_bytes=16).collect())
    assert got == [(f"{k:02}", i, 2.0 * i + k, 2.0 * i + 1 + k) for k in range(20) for i in range(3 * (k % 5))]


def test_files_are_encoded_across_batches(spark):
    """A file whose frames lie in several batches, and several files in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(s, i, [float(s), float(i)]) for s in range(40) for i in range(1 + s % 23)]
        random.Random(3).shuffle(rows)
        df = sinks.encoded(spark.createDataFrame(rows, "seg_id long, frame_no long, features array<double>"), F.col("seg_id"), sinks.raw_bytes())
        got = {r["name"]: np.frombuffer(bytes(r["content"]), "<f4").reshape(-1, 2).tolist() for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {str(s): [[float(s), float(i)] for i in range(1 + s % 23)] for s in range(40)}
    assert "FlatMapGroups" not in plan(df)


@pytest.mark.parametrize("width", [11, 64])
def test_matches_without_dots(spark, width):
    """Pieces far smaller than a file give the rows and runs that a table of dots gives: runs across pieces, gaps, several signatures of a frame, long silent stretches."""
    r = random.Random(7)
    base = [r.getrandbits(8) for _ in range(70)]
    frames = [(f, i, base[i % 23 if f else i]) for f in range(2) for i in range(70) if f or i % 9]
    frames += [(1, i, r.getrandbits(8)) for i in range(0, 70, 5)] + [(2, i, 5) for i in range(40)] + [(3, 1_000 * i, 1) for i in range(3)] + [(None, 1, 1), (1, 3, None)]
    df = spark.createDataFrame(frames, "file long, frame_no long, sig long").cache()
    dots = discovery.dots(df, 8, 0.25)
    for dx, dy in ((2, 3), (3, 2), (1, 1)):
        cells = discovery.median_filter(dots, dx).cache()
        squares = discovery.Squares(df, 8, 0.25, dx, dy, width=width)
        rows = cells.groupBy("file", "yp").agg(F.count("*").alias("n")).collect()
        assert sorted(map(tuple, squares.counts().collect())) == sorted(map(tuple, rows))
        peak = discovery.peaks(discovery.hough(cells, dy), 1.0).cache()
        want = sorted(map(tuple, discovery.runs(cells, peak, dy, 2).collect()))
        assert want and sorted(map(tuple, squares.runs(peak, 2).collect())) == want


@pytest.mark.parametrize("width", [9, 1_000])
def test_distances_are_counted(spark, width):
    """Counts of all pairs as a join of all pairs has them: blocks smaller than the table, repeated keys, nulls, an odd number of pairs."""
    r = random.Random(5)
    rows = [(r.randrange(60), r.getrandbits(12), r.choice([0, 1, 2]), r.choice([0, 1])) for _ in range(53)]
    rows += [(7, None, 1, 1), (9, 3, None, 0), (11, 5, 2, None), (13, None, None, None), (7, 100, 1, 1), (70, 4095, 900, 0)]
    df = spark.createDataFrame(rows, "k long, sig long, label int, speaker int")
    got = lsh.distances(df, "k", 12, width)
    none = lambda a, b: None if a is None or b is None else a == b
    want = Counter((None if a[1] is None or b[1] is None else (a[1] ^ b[1]).bit_count() / 12, none(a[2], b[2]), none(a[3], b[3])) for a in rows for b in rows if a[0] < b[0])
    assert {tuple(x[:3]): x[3] for x in map(tuple, got.collect())} == want
    pairs = lsh.pairs(df, "k").select((lsh.hamming(F.col("a.sig"), F.col("b.sig")) / 12).alias("dist"), (F.col("a.label") == F.col("b.label")).alias("same"), (F.col("a.speaker") == F.col("b.speaker")).alias("same_speaker"))
    for report in (evaluation.average_precision, evaluation.breakeven):
        assert report(got).first()[-1] == pytest.approx(report(pairs).first()[-1])
    assert "Join" not in plan(got)


def test_tally_in_strips():
    x, y = (np.random.default_rng(k).integers(0, 1 << 32, n, dtype=np.uint32) for k, n in ((1, 517), (2, 613)))
    want = np.bincount(np.bitwise_count(x[:, None] ^ y).ravel(), minlength=33)
    assert (lsh.tally(x, y, 32, 1_000) == want).all() and (lsh.tally(x, y, 32) == want).all()


def test_diagonal_join_stores_no_pairs(spark):
    """What the probe along diagonals finds from the exact join's pairs, repeated keys and all."""
    r = random.Random(2)
    df = spark.createDataFrame([(i % 40, r.getrandbits(8)) for i in range(50)] + [(3, None)], "k long, sig long")
    for threshold in (0.2, 0.6):
        found = lsh.exact_join(df, "k", 8, threshold)
        own = lsh.diagonal_join(df, "k", 8, threshold, 3)
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, lsh.diagonal_probe(found, df, "k", 8, threshold, 3).collect()))
        assert "Aggregate" not in plan(own)


@pytest.mark.parametrize("width", [7, 100])
def test_sparse_products_store_no_terms(spark, width):
    """Blocks smaller than a file, repeated postings, negative values, infinite ones, a threshold below 0."""
    r = random.Random(4)
    rows = [(2 * i + f, f, r.randrange(12), r.uniform(-1, 1)) for i in range(30) for f in range(2) for _ in range(4)]
    rows += [(0, 0, 5, math.inf), (2, 0, 5, 0.5), (4, 0, 7, math.nan), (6, 0, 7, 1.0), (8, 0, None, 1.0), (10, 0, 3, None)]
    df = spark.createDataFrame(rows, "id long, file int, dim int, x double")
    for least in (0.3, -0.4):
        both = order.paired(df.select("file", "dim", "id", "x"), ["file", "dim"], "id")
        want = both.groupBy(F.col("a.id").alias("i"), F.col("b.id").alias("j")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("val")).where(F.col("val") > least)
        got = matching.sparse_products(df, least, width)
        tell = lambda d: sorted((x["i"], x["j"], f"{x['val']:.9f}") for x in d.collect())
        assert tell(got) == tell(want) and got.count() > 20
        assert plan(got).rfind("Aggregate") > plan(got).find("Join")  # below the join: nothing is summed by pairs


def test_merging_nearby_first(spark):
    """Merging in the tasks first gives the fixed point of merging one pair after the other."""
    r = random.Random(9)
    boxes = [(f, a, a + r.randrange(6), b, b + r.randrange(6), 1.0) for f in range(3) for a, b in ((r.randrange(120 + 150 * f), r.randrange(120)) for _ in range(150))]
    boxes += [(None, 1, 2, 1, 2, 1.0), (None, 1, 2, 1, 2, 1.0), (0, None, 2, 1, 2, 1.0), (5, 1, 4, 1, 4, None), (5, 2, 6, 2, 6, 2.0)]
    want = [list(x) for x in boxes]
    near = lambda p, q, a: None not in (*p, *q[:5]) and max(p[a + 1], q[a + 1]) - min(p[a], q[a]) < p[a + 1] - p[a] + q[a + 1] - q[a] + 2
    while pair := next(((p, q) for k, p in enumerate(want) for q in want[k + 1 :] if p[0] == q[0] and near(p[:5], q, 1) and near(p[:5], q, 3)), None):
        p, q = pair
        want = [x for x in want if x is not p and x is not q]
        want.append([p[0], min(p[1], q[1]), max(p[2], q[2]), min(p[3], q[3]), max(p[4], q[4]), (p[5] or 0) + (q[5] or 0)])
    df = spark.createDataFrame(boxes, "file long, xa int, xb int, ya int, yb int, rho double")
    order_ = lambda rows: sorted((tuple(x) for x in rows), key=str)
    assert order_(matching.merged(df, 2).select("file", "xa", "xb", "ya", "yb", "rho").collect()) == order_(want)
    assert matching.merged_nearby(df, 2, 64).count() < len(boxes)
    few = matching.merged_nearby(df, 2, 64, most=3)
    assert few.agg(F.sum("rho")).first()[0] == pytest.approx(sum(x[5] or 0 for x in boxes))


def test_frames_meet_matches_in_tiles(spark):
    """Sides across tiles, missing and repeated frames, a side without frames, sides that are too long."""
    r = random.Random(6)
    frames = [(f, i, [float(i), float(f)]) for f in range(2) for i in range(60) if i % 7] + [(0, 9, [-1.0, 0.0])]
    found = [(r.randrange(2), k, a, a + r.randrange(12), b, b + r.randrange(12)) for k, (a, b) in enumerate((r.randrange(70), r.randrange(70)) for _ in range(80))]
    got = matching.with_frames(spark.createDataFrame(found, "file long, yp long, xa int, xb int, ya int, yb int"), spark.createDataFrame(frames, "file long, frame_no long, features array<double>"), 10, 8)
    side = lambda f, a, b: [v for _, v in sorted((i, v) for g, i, v in frames if g == f and a <= i <= b)]
    want = [(*m, x, y) for m in found if m[3] - m[2] < 10 and m[5] - m[4] < 10 and (x := side(m[0], *m[2:4])) and (y := side(m[0], *m[4:6]))]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) < 80
    assert "explode(sequence(cast(xa" not in plan(got)


def test_match_lines_by_ranges(spark):
    r = random.Random(8)
    df = spark.createDataFrame([(f"f{r.randrange(3)}", "g", *(r.randrange(12) for _ in range(4))) for _ in range(200)], "f1 string, f2 string, xa int, xb int, ya int, yb int")
    columns = ["xa", "xb", "ya", "yb"]
    want = sinks.match_lines(df, columns).select("pair", F.posexplode("lines").alias("at", "line"))
    got = sinks.numbered_match_lines(df, columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and "collect_list" not in plan(got)
