import math
import struct
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import codecs
from framewright.operators import align, archive, discovery, evaluation, frontend, graph, lsh, network, stats, windows
from framewright.sources import files

FRAMES = "seg_id long, frame_no int, features array<double>, label int"


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame([(s, t, [float(s), float(t), float(s * t)], t % 2) for s in range(3) for t in range(s + 2)], FRAMES)


def rows(df, *keys):
    return [tuple(r) for r in df.orderBy(*keys).collect()]


def test_archive_algebra(frames):
    keys = ("seg_id", "frame_no")
    n = {s: s + 2 for s in range(3)}
    padded = archive.pad(frames, 2).groupBy("seg_id").count()
    assert dict(rows(padded, "seg_id")) == {s: k + 4 for s, k in n.items()}
    assert rows(archive.trim(frames, 1, 1).select(*keys, "features"), *keys) == [(1, 0, [1.0, 1.0, 1.0]), (2, 0, [2.0, 1.0, 2.0]), (2, 1, [2.0, 2.0, 4.0])]
    assert archive.merge(frames, frames).select(F.max(F.size("features"))).first()[0] == 6
    assert archive.diff(frames, frames, 0.0).count() == 0
    assert archive.mismatched(frames, frames.where("seg_id < 2")).collect()[0]["seg_id"] == 2
    assert archive.concat(frames, frames).agg(F.max("seg_id"), F.count("*")).first() == (5, 18)
    assert rows(archive.merge_segments(frames).select("frame_no"), "frame_no") == [(i,) for i in range(9)]
    assert rows(archive.set_length(frames, F.lit(4)).groupBy("seg_id").count(), "seg_id") == [(s, 4) for s in range(3)]
    division = archive.combo(frames, frames, "div").where("seg_id = 0 AND frame_no = 1").first()["features"]
    assert math.isnan(division[0]) and division[1] == 1
    assert archive.info(frames).first() == (3, 9, 3, 4)
    assert archive.info(frames.limit(0)).first()["n_segs"] == 0


def test_statistics(frames):
    x = np.array([r["features"] for r in frames.collect()])
    s = stats.summary(frames).orderBy("dim").collect()
    assert [r["mean"] for r in s] == pytest.approx(x.mean(0)) and [r["sd"] for r in s] == pytest.approx(x.std(0))
    c = {(r["i"], r["j"]): r["cov"] for r in stats.covariance(frames, 3).collect()}
    assert c[(0, 2)] == pytest.approx(np.cov(x.T, bias=True)[0, 2])
    white = np.array([r["features"] for r in stats.klt(frames, 3, whiten=True).collect()])
    assert np.cov(white.T, bias=True) == pytest.approx(np.eye(3), abs=1e-6)
    u = [r["u"] for r in stats.uniformise(frames, 5).collect()]
    assert 0 <= min(u) and max(u) <= 1
    assert stats.kmeans(frames, 2).select("cluster").distinct().count() == 2


def test_windows(spark, frames):
    assert windows.double_delta_weights(5) == [1.0, 0.0, -2.0, 0.0, 1.0]
    d = windows.weighted(frames, windows.delta_weights(3), 3).where("seg_id = 2").orderBy("frame_no").collect()
    assert [r["features"][1] for r in d] == [1.0, 2.0, 2.0, 1.0]
    assert windows.context(frames, 3).count() == 3
    start = datetime(2020, 1, 1)
    values = [0, 9, 9, 0, 9, 9, 9, 0, 0, 9]
    e = spark.createDataFrame([(1, start + timedelta(seconds=i), i, float(v)) for i, v in enumerate(values)], "user_id long, ts timestamp, event_id long, value double")
    runs = windows.islands(e, ["user_id"], ["ts"], F.col("value") > 5)
    assert rows(runs.select("start_frame", "end_frame", "n"), "start_frame") == [(1, 2, 2), (4, 6, 3), (9, 9, 1)]
    assert rows(windows.bridged(runs, ["user_id"], 1, 3).select("start_frame", "end_frame"), "start_frame") == [(1, 6)]
    streamed, m, v, want = [r["y"] for r in windows.online_norm_events(e).orderBy("event_id").collect()], 0.0, 1.0, []
    for x in values:
        m = 0.9 * m + 0.1 * x
        v = 0.9 * v + 0.1 * (x - m) ** 2
        want.append((x - m) / v**0.5)
    assert streamed == pytest.approx(want)


def test_similarity_joins(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base, base + 0.01 * rng.standard_normal(base.shape), np.zeros((1, 16))])
    df = lsh.signature(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>"), lsh.projection(16, 32))
    sigs = {r["id"]: r["sig"] for r in df.collect()}
    assert sigs[80] is None
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if math.cos(math.pi * bin(sigs[i] ^ sigs[j]).count("1") / 32) > 0.9}
    assert {(r["i"], r["j"]) for r in lsh.exact_join(df, "id", 32, 0.9).collect()} == want
    found = {(r["i"], r["j"]) for r in lsh.beam_join(df, "id", 32, 0.9, beam=20).collect()}
    assert found <= want and len(found) >= 0.9 * len(want)


def test_discovery_finds_a_repeat(spark):
    cells = spark.createDataFrame([(1, 10, xp, 0.9) for xp in range(20, 60, 2)], "file long, yp long, xp long, val double")
    full = discovery.median_filter(cells, 2)
    peak = discovery.peaks(discovery.hough(full, 3), 1.0)
    assert [r["yp"] for r in peak.collect()] == [10]
    m = discovery.runs(full, peak, 3, 5).first()
    assert (m["xa"], m["ya"]) == (5, 15) and m["xb"] - m["xa"] == m["yb"] - m["ya"]


def test_graph(spark):
    nodes = spark.createDataFrame([(1, 1, 0, 10), (2, 1, 1, 10), (3, 1, 100, 110), (4, 2, 0, 10), (5, 1, 2, 11)], "node long, file long, start long, end long")
    edges = graph.overlap_edges(nodes, 8, 0.5)
    assert rows(edges.select("a", "b"), "a", "b") == [(1, 2), (1, 5), (2, 5)]
    assert rows(graph.components(nodes.select("node"), edges), "node") == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 1)]
    kept = graph.greedy_dedup(nodes.withColumn("cluster", F.lit(0).cast("long")), 0.8)
    assert rows(kept.select("node"), "node") == [(1,), (3,), (4,), (5,)]
    chain = spark.range(200).select(F.col("id").alias("node"))
    path = spark.range(199).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graph.components(chain, path).select("component").distinct().count() == 1


def test_evaluation(spark):
    p = [(0.1, True), (0.2, False), (0.2, True), (0.3, False), (0.9, True)]
    df = spark.createDataFrame([(d, s, s) for d, s in p], "dist double, same boolean, same_speaker boolean")
    assert evaluation.average_precision(df).first()["ap"] == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    assert evaluation.false_alarms(df, 0.5).first()["false_alarm"] == pytest.approx(0.5)
    rng = np.random.default_rng(2)
    items = [(i, int(rng.integers(3)), int(rng.integers(2)), int(rng.integers(20))) for i in range(30)]
    d = [(x, px, sx, a, pa, sa, abs(vx - va)) for x, px, sx, vx in items for a, pa, sa, va in items if a != x]
    cells = evaluation.discrimination(spark.createDataFrame(d, "x long, p_x int, s_x int, a long, p_a int, s_a int, d int"))
    got = {(r["s_a"], r["s_x"], r["p_x"], r["p_b"]): r["score"] for r in cells.collect()}
    want: dict = {}
    for x, px, sx, vx in items:
        for a, pa, sa, va in items:
            for b, pb, sb, vb in items:
                if a != x and pa == px and pb != px and sb == sa:
                    want.setdefault((sa, sx, px, pb), []).append(1.0 if abs(vx - va) < abs(vx - vb) else 0.5 if abs(vx - va) == abs(vx - vb) else 0.0)
    assert got == pytest.approx({k: np.mean(v) for k, v in want.items()})


def test_alignment():
    x = np.array([[1.0, 0], [0, 1], [1, 1]])
    assert align.dtw(align.cosine_costs(x, x)) == pytest.approx(0)
    assert align.dtw(np.zeros((0, 0))) == 0 and align.dtw(np.zeros((0, 3))) == math.inf
    costs = np.random.default_rng(3).random((5, 6))
    best = {(0, 0): costs[0, 0]}
    for i in range(5):
        for j in range(6):
            if (i, j) != (0, 0):
                best[i, j] = costs[i, j] + min(best.get((i - 1, j), math.inf), best.get((i, j - 1), math.inf), best.get((i - 1, j - 1), math.inf))
    assert align.dtw(costs, normalised=False) == pytest.approx(best[4, 5])
    assert align.token_distance("a b c".split(), "a b c".split()) == 0 and align.token_distance([], ["a"]) == 1
    assert align.cast(np.zeros((4, 4))) == (3, 3, 0.0) and align.cast(np.full((4, 4), 9.0)) == (-1, -1, 0.0)


def test_front_end(spark):
    rate, t = 8000, np.arange(256) / 8000
    x = np.sin(2 * np.pi * 1000 * t)[None, :]
    assert frontend.power(x, 256)[0].argmax() == 32
    assert frontend.cepstra(x, 256, rate, 20, 13).shape == (1, 13)
    r = frontend.autocorrelation(np.random.default_rng(4).standard_normal(500), 4)
    a, error = frontend.lpc(r)
    assert a[1:] == pytest.approx(np.linalg.solve(np.array([[r[abs(i - j)] for j in range(4)] for i in range(4)]), -r[1:])) and error > 0
    assert frontend.rasta(np.ones((10, 1)))[-1, 0] == pytest.approx(0, abs=1e-9)


def test_codecs_and_network(spark):
    x = np.array([0, 1, -1, 1000, -1000, 32767, -32768])
    back = codecs.mulaw_samples(codecs.mulaw_bytes(x))
    assert (np.abs(back - x) <= np.maximum(8, np.abs(x) // 16)).all()
    assert (codecs.mulaw_bytes(codecs.mulaw_samples(np.arange(127))) == np.arange(127)).all()
    df = spark.createDataFrame([(1, [0.5] * 4), (2, [-0.5] * 4)], "id long, features array<double>")
    p = [r["p"] for r in network.forward(df, network.integer_weights(3, 4), network.integer_weights(2, 3)).orderBy("id").collect()]
    assert all(sum(v) == pytest.approx(1) for v in p) and p[0] != p[1]


def test_files(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(4, 3)
    (tmp_path / "a.raw").write_bytes(x.tobytes())
    assert [r["features"] for r in files.raw_matrix(spark, str(tmp_path / "a.raw"), 3).orderBy("frame_no").collect()] == x.tolist()
    (tmp_path / "b.htk").write_bytes(struct.pack(">iihh", 4, 100000, 12, 9) + x.astype(">f4").tobytes())
    assert files.htk(spark, str(tmp_path / "b.htk")).count() == 4
    seg = np.array([0, 0, 1, 1])
    (tmp_path / "c.pf").write_bytes(files.archive_bytes(seg, np.array([0, 1, 0, 1]), x.astype(float), np.array([[1], [2], [3], [4]])))
    got = files.archive(spark, str(tmp_path / "c.pf")).orderBy("seg_id", "frame_no").collect()
    assert [(r["seg_id"], r["frame_no"], r["features"], r["labels"]) for r in got] == [(int(s), i % 2, x[i].tolist(), [i + 1]) for i, s in enumerate(seg)]
    (tmp_path / "d.txt").write_text("0.01 1 2\n0.02 3 4\n\n")
    assert rows(files.timed_text(spark, str(tmp_path / "d.txt")), "time") == [("d.txt", 0.01, [1.0, 2.0]), ("d.txt", 0.02, [3.0, 4.0])]
    (tmp_path / "m.txt").write_text("a b\n1 2 3 4 0.5 9\n5 6 7 8 0.25 3\na c\n1 1 1 1 1 1\n")
    assert [(r["f2"], r["xa"]) for r in files.matches_text(spark, str(tmp_path / "m.txt")).orderBy("f2", "xa").collect()] == [("b", 1), ("b", 5), ("c", 1)]


def test_streaming(spark, tmp_path):
    from framewright.streaming import online

    start = datetime(2024, 1, 1)
    data = [(1 + i % 2, start + timedelta(seconds=i), float(i * i % 7)) for i in range(40)]
    schema = "key long, ts timestamp, value double"
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = online.online_norm(stream, 0.1, 0.1).writeStream.format("memory").queryName("normed").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    want = []
    for key in (1, 2):
        m, v = 0.0, 1.0
        for k, ts, x in data:
            if k == key:
                m = 0.9 * m + 0.1 * x
                v = 0.9 * v + 0.1 * (x - m) ** 2
                want.append((key, ts, (x - m) / v**0.5))
    got = [tuple(r) for r in spark.table("normed").orderBy("key", "ts").collect()]
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])
    assert online.segments(spark.createDataFrame(data, schema), 3.0, "3 seconds", "1 minute").count() > 0


def test_archives_that_differ(frames):
    """Joins of archives fail where the frames don't line up."""
    for join in (lambda a, b: archive.merge(a, b), lambda a, b: archive.diff(a, b, 0.0), lambda a, b: archive.combo(a, b, "add"), lambda a, b: archive.with_labels(a, b)):
        for a, b in ((frames, frames.where("seg_id < 2")), (frames.where("frame_no < 2"), frames)):
            with pytest.raises(Exception, match="archives differ"):
                join(a, b).collect()
    with pytest.raises(Exception, match="different widths"):
        archive.concat(frames, archive.project(frames, [0])).collect()
    with pytest.raises(Exception, match="no variance"):
        stats.normalise_to(frames, [F.col("seg_id")], 0.0, 1.0).collect()


def alone(costs, longest=None):
    """DTW by a dictionary of cells, one pair at a time."""
    n, m = costs.shape
    best = {(0, 0): (0.0, 0)} | {(i, 0): (math.inf, i) for i in range(1, n + 1)} | {(0, j): (math.inf, j) for j in range(1, m + 1)}
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            ways = []
            for rank, (a, b) in enumerate(((i - 1, j - 1), (i, j - 1), (i - 1, j))):  # of two equal bends the one along the second sequence
                value, run = best[(a, b)]
                run = 0 if rank == 0 else run + 1
                if longest is not None and rank and run >= longest:
                    value = math.inf
                ways.append((value, rank, run))
            value, _, run = min(ways)
            best[(i, j)] = (value + costs[i - 1, j - 1], run)
    return best[(n, m)][0] / (n + m)


def test_dtw_of_batches_against_single_pairs(spark):
    r = np.random.default_rng(11)
    pairs = [(r.random((r.integers(1, 9), 4)).tolist(), r.random((r.integers(1, 9), 4)).tolist()) for _ in range(60)] + [([], []), ([], [[1.0, 2.0, 3.0, 4.0]])]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, x array<array<double>>, y array<array<double>>")
    got = df.select("i", align.dtw_of(F.col("x"), F.col("y")).alias("d"), align.rescored(F.col("x"), F.col("y"), longest=3).alias("s")).orderBy("i").collect()
    for row, (x, y) in zip(got, pairs, strict=True):
        if not x or not y:
            assert row["d"] == (0.0 if len(x) == len(y) else math.inf) and row["s"] is None
            continue
        x, y = np.array(x), np.array(y)
        assert row["d"] == pytest.approx(alone(align.cosine_costs(x, y)))
        d = alone(2 * align.cosine_costs(align.whitened(x), align.whitened(y)), 3)
        assert row["s"] == (pytest.approx(1 - d / 2) if d <= 2 else None)


def test_cast_in_both_directions():
    r = np.random.default_rng(12)
    base = r.standard_normal((30, 8))
    x, y = np.concatenate([r.standard_normal((9, 8)), base, r.standard_normal((8, 8))]), np.concatenate([r.standard_normal((5, 8)), base, r.standard_normal((12, 8))])
    xa, xb, ya, yb = align.cast_both(align.cosine_costs(x, y), 24, 20, limit=1.0)
    assert (xa, ya) == (9, 5) and (xb, yb) == (38, 34)
    end, cost = align.keyword_end(align.cosine_costs(x[9:], base[:10]))
    assert end == 9 and cost == pytest.approx(0, abs=1e-9)


def test_au_and_lists(spark, tmp_path):
    data = np.array([0, 1000, -1000, 32767], ">i2").tobytes()
    (tmp_path / "a.au").write_bytes(struct.pack(">4sIIIII", b".snd", 24, len(data), 3, 8000, 2) + data)
    (tmp_path / "b.au").write_bytes(struct.pack(">4sIIIII", b".snd", 24, 4, 1, 8000, 1) + bytes([0xFF, 0x7F, 0x00, 0x80]))
    got = files.read(spark, "au", str(tmp_path / "a.au")).orderBy("sample_no").collect()
    assert [r["channels"] for r in got] == [[0.0, 1000.0], [-1000.0, 32767.0]] and got[0]["rate"] == 8000
    (tmp_path / "list.txt").write_text(f"{tmp_path / 'b.au'}\n\n")
    assert [r["channels"][0] for r in files.read(spark, "au", files.listed(spark, str(tmp_path / "list.txt"))).orderBy("sample_no").collect()] == [0, 0, -32124, 32124]
    (tmp_path / "m.txt").write_text("1 2\n3.5 4\n")
    assert [r["features"] for r in files.read(spark, "text", str(tmp_path / "m.txt")).orderBy("frame_no").collect()] == [[1.0, 2.0], [3.5, 4.0]]
    (tmp_path / "s.sig").write_bytes(np.array([5, -6, 7], "<i8").tobytes())
    assert [(r["frame_no"], r["sig"]) for r in files.read(spark, "signatures", str(tmp_path / "s.sig"), first=1).orderBy("frame_no").collect()] == [(1, -6), (2, 7)]
    with pytest.raises(ValueError):
        files.read(spark, "nothing", "x")


def test_training(spark):
    """Summed gradients are those of one batch, and a few epochs learn what can be learnt."""
    r = np.random.default_rng(13)
    x = r.standard_normal((200, 5))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y, strict=True)], "features array<double>, label int").repartition(3).cache()
    weights = [r.standard_normal((5, 4)), r.standard_normal((4, 2))]
    g, loss, n, _ = network.gradients(df, weights)

    def cost(w):
        h = 1 / (1 + np.exp(-(x @ w[0])))
        z = h @ w[1]
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(200), y]).sum())

    assert n == 200 and loss == pytest.approx(cost(weights))
    for k, at in ((0, (2, 1)), (0, (0, 0)), (1, (3, 1))):
        up, down = [w.copy() for w in weights], [w.copy() for w in weights]
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert g[k][at] == pytest.approx((cost(up) - cost(down)) / 2e-5, rel=1e-4)
    _, seen = network.train(df, [6], 2, df, epochs=12, rate=4.0)
    assert seen[-1]["loss"] < seen[0]["loss"] and seen[-1]["accuracy"] > 0.85
    assert network.schedule(1.0, [0.5, 0.1]) == 1.0 and network.schedule(1.0, [0.5, 0.001]) == 0.5 and network.schedule(1.0, [0.5, 0.001, 0.2]) == 0.25


def test_streams_of_rows(spark, tmp_path):
    """Values beside the one three rows on, and windows of four rows, over two micro-batches."""
    from framewright.streaming import online

    start, schema = datetime(2024, 1, 1), "key long, ts timestamp, value double"
    data = [(1 + i % 2, start + timedelta(seconds=i), float(i)) for i in range(30)]
    for k, part in enumerate((data[:13], data[13:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    for name, op in (("later", lambda s: online.ahead(s, 3)), ("fours", lambda s: online.counted(s, 4))):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        q = op(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    series = {k: [v for a, _, v in data if a == k] for k in (1, 2)}
    got = [tuple(r) for r in spark.table("later").select("key", "value", "later").orderBy("key", "ts").collect()]
    assert got == [(k, v[i], v[i + 3]) for k, v in series.items() for i in range(len(v) - 3)]
    got = [tuple(r) for r in spark.table("fours").orderBy("key", "number").collect()]
    assert got == [(k, i, 4, sum(v[4 * i : 4 * i + 4]) / 4) for k, v in series.items() for i in range(len(v) // 4)]


def test_matches_merge_until_none_meet(spark):
    from framewright.operators import matching

    r = np.random.default_rng(14)
    boxes = []
    for f in range(3):
        for _ in range(25):
            a, c, n, m = (int(v) for v in (r.integers(0, 300), r.integers(0, 300), r.integers(3, 25), r.integers(3, 25)))
            boxes.append((f, a, a + n, c, c + m, 1.0))
    got = [tuple(x) for x in matching.merged(spark.createDataFrame(boxes, "file long, xa int, xb int, ya int, yb int, rho double"), 2).select("file", "xa", "xb", "ya", "yb", "rho").collect()]

    def meet(p, q):
        return p[0] == q[0] and all(max(p[j], q[j]) - min(p[i], q[i]) < p[j] - p[i] + q[j] - q[i] + 2 for i, j in ((1, 2), (3, 4)))

    own = list(boxes)
    while True:  # whole components at once, round by round
        group = list(range(len(own)))
        for i in range(len(own)):
            for j in range(i):
                if meet(own[i], own[j]) and group[i] != group[j]:
                    group = [group[j] if g == group[i] else g for g in group]
        if len(set(group)) == len(own):
            break
        parts = [[b for b, g in zip(own, group, strict=True) if g == k] for k in sorted(set(group))]
        own = [(p[0][0], min(b[1] for b in p), max(b[2] for b in p), min(b[3] for b in p), max(b[4] for b in p), sum(b[5] for b in p)) for p in parts]
    assert sorted(got) == sorted(own) and len(own) < len(boxes)


def test_front_end_operators(spark):
    r = np.random.default_rng(15)
    x = r.random((2, 9, 3))
    df = spark.createDataFrame([(u, t, x[u, t].tolist()) for u in range(2) for t in range(9)], "user_id long, frame_no int, bands array<double>")
    got = frontend.rasta_of(df, "user_id").orderBy("user_id", "frame_no").collect()
    assert np.array([v["bands"] for v in got]).reshape(2, 9, 3) == pytest.approx(np.stack([frontend.rasta(s) for s in x]))
    s = r.standard_normal(64)
    a = np.array(spark.createDataFrame([(s.tolist(),)], "s array<double>").select(frontend.predictors_of(F.col("s"), 4).alias("a")).first()["a"])
    q = frontend.autocorrelation(s, 4)
    assert a[0] == 1 and a[1:] == pytest.approx(np.linalg.solve([[q[abs(i - j)] for j in range(4)] for i in range(4)], -q[1:]))


def test_segmental_means(spark):
    """Equal slices, the rest in the last; means from a plain loop."""
    r = np.random.default_rng(16)
    data = [(s, t, r.random(2).tolist(), s % 2) for s in range(12) for t in range(3 + s % 4)]
    df = spark.createDataFrame(data, FRAMES)
    got = {(x["label"], x["part"], x["cluster"]): (x["n"], x["centre"]) for x in stats.segmental_kmeans(df, 2, 2, 3).collect()}
    cells = {}
    for s, t, v, label in data:
        n = 3 + s % 4
        cells.setdefault((label, min(t // (n // 2), 1)), []).append(np.array(v))
    want = {}
    for cell, rows_ in cells.items():
        means = {0: rows_[0], 1: rows_[1]}
        for _ in range(3):
            near = [min((float(((v - m) ** 2).sum()), k) for k, m in means.items())[1] for v in rows_]
            means = {k: np.mean([v for v, c in zip(rows_, near, strict=True) if c == k], axis=0) for k in set(near)}
        want |= {(*cell, k): (near.count(k), m) for k, m in means.items()}
    assert set(got) == set(want) and all(got[k][0] == n and got[k][1] == pytest.approx(m) for k, (n, m) in want.items())


def test_sides_of_matches(spark):
    from framewright.operators import matching

    frames_ = spark.createDataFrame([(1, t, [float(t), 1.0]) for t in range(20)], "file long, frame_no long, features array<double>")
    found = spark.createDataFrame([(1, 2, 5, 9, 11), (1, 0, 19, 0, 3)], "file long, xa int, xb int, ya int, yb int")
    got = matching.with_frames(found, frames_, most_frames=10).collect()
    assert len(got) == 1 and [v[0] for v in got[0]["x"]] == [2, 3, 4, 5] and [v[0] for v in got[0]["y"]] == [9, 10, 11]


def test_pre_codes(spark):
    from statistics import NormalDist

    values = [-9.0, -1.0, 0.0, 0.3, 2.5, 9.0]
    got = spark.createDataFrame([(values,)], "x array<double>").select(codecs.to_pre8("x").alias("c")).select("c", codecs.from_pre8("c").alias("v")).first()
    assert list(got["c"]) == [min(255, int(256 * NormalDist().cdf(v))) for v in values]
    assert got["v"] == pytest.approx([NormalDist().inv_cdf((c + 0.5) / 256) for c in got["c"]])
