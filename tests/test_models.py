"""Ranged scans, index search, as-of joins, mixtures, slices, noise, word likeness and training: by brute force and known properties."""

import itertools
import math
import random
import re
import struct
import uuid
import wave

import numpy as np
import pytest

from framewright.functions import codecs
from framewright.operators import align, archive, frontend, lsh, matching, mixtures, nearest, network, order, segmental, sound, words
from framewright.operators.graph import shared_folder, written
from framewright.sources import files, ranged, sinks, stores

# ---------------------------------------------------------------- ranged scans


@pytest.fixture(scope="module")
def archives(tmp_path_factory):
    """Two archives with an index, one of them of a long segment, and one without an index."""
    top = tmp_path_factory.mktemp("archives")
    r = np.random.default_rng(4)
    for name, lengths in (("a", [3, 1, 40, 2, 5, 5, 5, 1]), ("b", [7, 2]), ("c", [4, 6, 1])):
        seg = np.repeat(np.arange(len(lengths)), lengths)
        frame = np.concatenate([np.arange(n) for n in lengths])
        content = files.archive_bytes(seg, frame, r.normal(size=(len(seg), 3)), r.integers(0, 9, (len(seg), 2)))
        (top / f"{name}.pfile").write_bytes(content if name != "c" else content[: -4 * (len(lengths) + 1)])
    return str(top)


def rows_of(df):
    return sorted((r["path"][-7:], r["seg_id"], r["frame_no"], tuple(r["features"]), tuple(r["labels"])) for r in df.collect())


def test_ranges_of_archives(spark, archives):
    """The same rows as reading files whole, from several partitions of one file."""
    whole = rows_of(files.archive(spark, f"{archives}/*.pfile"))
    for part in (28, 28 * 8, 1 << 20):  # a row, eight rows, everything
        df = ranged.scan(spark, "archive", f"{archives}/*.pfile", part_bytes=part)
        assert rows_of(df) == whole
    assert ranged.scan(spark, "archive", f"{archives}/a.pfile", part_bytes=28 * 8).rdd.getNumPartitions() > 4
    assert ranged.scan(spark, "archive", f"{archives}/a.pfile").rdd.getNumPartitions() == 1


@pytest.mark.parametrize("condition", ["seg_id = 2", "seg_id IN (0, 2, 7, 40)", "seg_id > 1 AND seg_id <= 5", "frame_no BETWEEN 2 AND 3", "seg_id = 2 AND frame_no >= 30", "seg_id < 0", "features[0] > 0 AND frame_no < 2"])
def test_filters_come_down(spark, archives, condition):
    want = rows_of(files.archive(spark, f"{archives}/*.pfile").where(condition))
    assert rows_of(ranged.scan(spark, "archive", f"{archives}/*.pfile", part_bytes=28 * 4).where(condition)) == want


def test_filters_prune_partitions(archives):
    """Segments that the index rules out are no partition, and only asked frames are a stretch."""
    from pyspark.sql import datasource as ds

    reader = ranged.Reader({"kind": "archive", "files": f'[["{archives}/a.pfile", 100000]]', "part_bytes": str(28 * 8)})
    every = reader.partitions()
    assert sum(b - a for p in every for a, b in p.stretches) == 62 and max(sum(b - a for a, b in p.stretches) for p in every) <= 8
    assert list(reader.pushFilters([ds.EqualTo(("seg_id",), 2), ds.GreaterThanOrEqual(("frame_no",), 35)])) != []
    few = reader.partitions()
    assert [p.stretches for p in few] == [[(39, 44)]]


def test_options_and_long_segments(spark, archives):
    whole = rows_of(files.archive(spark, f"{archives}/*.pfile"))
    df = ranged.scan(spark, "archive", f"{archives}/*.pfile", segments="0,^0", first=1, last=3, part_bytes=56)
    last = {p: max(r[1] for r in whole if r[0] == p) for p in {r[0] for r in whole}}
    assert rows_of(df) == [r for r in whole if r[1] in (0, last[r[0]]) and 1 <= r[2] <= 3]


def test_ranges_of_other_kinds(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(50, 3)).astype("<f4")
    (tmp_path / "x.raw").write_bytes(b"head" + x.tobytes())
    (tmp_path / "x.sized").write_bytes(struct.pack("<i", 3) + x.tobytes())
    (tmp_path / "x.htk").write_bytes(struct.pack(">iihh", 50, 100_000, 12, 9) + x.astype(">f4").tobytes())
    (tmp_path / "x.sig").write_bytes(np.arange(50, dtype="<i8").tobytes())
    with wave.open(str(tmp_path / "x.wav"), "wb") as w:
        w.setparams((2, 2, 8000, 0, "NONE", ""))
        w.writeframes(np.arange(100, dtype="<i2").tobytes())
    (tmp_path / "empty.raw").write_bytes(b"")
    want = [(i, tuple(map(float, v))) for i, v in enumerate(x)]
    for kind, options in (("raw", {"width": 3, "skip": 4}), ("sized", {}), ("htk", {})):
        df = ranged.scan(spark, kind, f"{tmp_path}/x.{kind}", part_bytes=100, **options)
        assert sorted((r["frame_no"], tuple(r["features"])) for r in df.collect()) == want and df.rdd.getNumPartitions() > 3
    assert [tuple(r) for r in ranged.scan(spark, "raw", f"{tmp_path}/x.raw", width=3, skip=4, first=5, last=6).select("frame_no").orderBy("frame_no").collect()] == [(5,), (6,)]
    assert [r["sig"] for r in ranged.scan(spark, "signatures", f"{tmp_path}/x.sig", part_bytes=80).orderBy("frame_no").collect()] == list(range(50))
    sound = ranged.scan(spark, "sound", f"{tmp_path}/x.wav", part_bytes=40).orderBy("frame_no").collect()
    assert [(r["rate"], tuple(r["channels"])) for r in sound] == [(8000, (2.0 * i, 2.0 * i + 1)) for i in range(50)]
    assert ranged.scan(spark, "raw", f"{tmp_path}/empty.raw", width=3).count() == 0
    with pytest.raises(FileNotFoundError):
        ranged.scan(spark, "raw", f"{tmp_path}/none*", width=3)
    (tmp_path / "cut.htk").write_bytes((tmp_path / "x.htk").read_bytes()[:-1])
    with pytest.raises(Exception, match="before its 50 rows"):
        ranged.scan(spark, "htk", f"{tmp_path}/cut.htk").count()


def test_paths_are_resolved(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f").write_bytes(b"x")
    assert stores.resolved(spark, str(tmp_path / "in")) == f"file:{tmp_path}/in"
    assert stores.resolved(spark, str(tmp_path / "new" / "er")) == f"file:{tmp_path}/new/er"
    assert [(p[-5:], n) for p, n in stores.found(spark, str(tmp_path / "in"))] == [("/in/f", 1)]
    system, path = stores.opened(f"file://{tmp_path}/in/f")
    assert system.open_input_file(path).read() == b"x"


# ---------------------------------------------------------------- places, as-of, index


def test_places_with_one_value_for_most_rows(spark):
    """Each value of `by` by itself; a key that most rows share is split by the rest of the order."""
    r = random.Random(2)
    rows = [(r.randrange(2), 7 if r.random() < 0.8 else r.randrange(20), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "p int, key int, id int")
    got = order.places(df, ["p"], ["key", "id"])
    for p in (0, 1):
        assert [(x["key"], x["id"]) for x in got.where(f"p = {p}").orderBy("place").collect()] == sorted(x[1:] for x in rows if x[0] == p)
        assert sorted(x["place"] for x in got.where(f"p = {p}").collect()) == list(range(sum(x[0] == p for x in rows)))
    assert order.places(df.limit(0), [], ["id"]).count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which puts small ranges together
    try:
        got = order.places(df, ["p"], ["key", "id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(x["count"] for x in spark.read.parquet(got.inputFiles()[0].rpartition("/")[0]).groupBy("__range").count().collect()) < 1500


def test_asof(spark):
    r = random.Random(3)
    right = [(k, t, f"{k}:{t}") for k in range(4) for t in r.sample(range(-50, 300), 12)]
    left = [(i, r.randrange(5) if i % 10 else None, r.randrange(-60, 320)) for i in range(300)]
    got = nearest.asof(spark.createDataFrame(left, "id int, k int, t long"), spark.createDataFrame(right, "k int, t long, v string").withColumn("since", nearest.F.col("t")), ["k"], "t", 16, ["since", "v"])
    for x in got.where("k IS NOT NULL").collect():
        want = max(((t, v) for k, t, v in right if k == x["k"] and t <= x["t"]), default=(None, None))
        assert (x["since"], x["v"]) == want
    assert got.where("k IS NOT NULL").count() == sum(x[1] is not None for x in left)


@pytest.mark.parametrize("named", [2_000, 0])
def test_index_search(spark, named):
    """The rows around each query's place, with keys that many rows share and with few or many parts; files of other parts aren't read."""
    r = random.Random(5)
    bits, perms, beam, part = 12, 3, 8, 16
    sigs = [(i, 1234 if i % 3 == 0 else r.randrange(1 << bits)) for i in range(200)] + [(900, None)]
    queries = [(i, s) for i, s in sigs if i % 7 == 0] + [(1000, 1234), (1001, 0), (1002, (1 << bits) - 1), (1003, None)]
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    nearest.build(spark.createDataFrame(sigs, "id long, sig long"), "id", bits, perms, path, part)
    q = spark.createDataFrame(queries, "id long, sig long")
    got = {(x["query"], x["id"], x["h"]) for x in nearest.search(spark, path, q, "id", bits, -1.1, perms, beam, part, named).collect()}
    want = set()
    step = bits // perms
    turned = lambda s, p: (s >> p * step) | (s << (bits - p * step)) & ((1 << bits) - 1)
    for p in range(perms):
        index = sorted((turned(s, p), i, s) for i, s in sigs if s is not None)
        for k, s in queries:
            if s is not None:
                at = sum(x[0] < turned(s, p) for x in index)
                want |= {(k, i, (s ^ o).bit_count()) for _, i, o in index[max(0, at - beam // 2) : at + beam // 2]}
    assert got == want
    if named:
        one = nearest.search(spark, path, q.where("id = 1001"), "id", bits, -1.1, perms, beam, part, named)
        spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
        plan = one._jdf.queryExecution().executedPlan().toString()
        filters = re.findall(r"PartitionFilters: \[([^\]]*)", plan)
        named_parts = {int(x) for f in filters for y in re.findall(r"part#\d+L? (?:IN \(|= )([-\d,]+)", f) for x in y.split(",")}
        assert named_parts and max(named_parts) <= 1 and spark.read.parquet(f"{path}/rows").agg({"part": "max"}).first()[0] > 10


# ---------------------------------------------------------------- mixtures


def em_by_hand(x, k, rounds):
    """A mixture for one pair, all rows at once."""
    mean, cov = x.mean(0), np.cov(x.T, bias=True)
    s = np.sqrt(np.diag(cov)) * [1, np.sign(cov[0, 1]) or 1]
    mu = [mean + ((2 * c + 1) / k - 1) * s for c in range(k)]
    var, w, out = [np.diag(np.diag(cov))] * k, np.full(k, 1 / k), []
    for _ in range(rounds + 1):
        d = np.stack([w[c] * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - mu[c], np.linalg.inv(var[c]), x - mu[c])) / (2 * np.pi * np.sqrt(np.linalg.det(var[c]))) for c in range(k)], 1)
        out.append(np.log(d.sum(1)).sum())
        if len(out) > rounds:
            break
        r = d / d.sum(1, keepdims=True)
        w = r.mean(0)
        mu = [(r[:, c, None] * x).sum(0) / r[:, c].sum() for c in range(k)]
        var = [(r[:, c, None, None] * np.einsum("ni,nj->nij", x - mu[c], x - mu[c])).sum(0) / r[:, c].sum() for c in range(k)]
    return w, mu, var, out


def test_mixtures_against_one_machine(spark):
    g = np.random.default_rng(6)
    x = np.concatenate((g.multivariate_normal([0, 0, 5], [[1, 0.8, 0], [0.8, 1, 0], [0, 0, 1]], 300), g.multivariate_normal([4, -3, 5], [[0.5, 0, 0], [0, 0.5, 0.2], [0, 0.2, 2]], 200)))
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [([1.0, None, 2.0],), ([float("nan"), 0.0, 0.0],)], "features array<double>")
    found, likelihoods = mixtures.pair_mixtures(df, 3, 2, 6)
    for (i, j), cs in found.items():
        w, mu, var, seen = em_by_hand(x[:, [i, j]], 2, 6)
        assert [lk[i, j] for lk in likelihoods] == pytest.approx(seen, rel=1e-8)
        assert all(b >= a - 1e-6 for a, b in itertools.pairwise([lk[i, j] for lk in likelihoods]))
        for c, m in enumerate(cs):
            assert (m.weight, m.mx, m.my, m.xx, m.yy, m.xy) == pytest.approx((w[c], *mu[c], var[c][0, 0], var[c][1, 1], var[c][0, 1]), rel=1e-6, abs=1e-8)
    assert mixtures.mixture_information(df.limit(0), 3, 2, 2).count() == 0
    constant = df.selectExpr("array(features[0], 1.0D) AS features")
    assert mixtures.mixture_information(constant, 2, 2, 2).count() == 0


@pytest.mark.parametrize("rho", [0.0, 0.5, -0.9])
def test_information_of_one_normal(rho):
    """A single component has the information of its correlation."""
    c = mixtures.Normal2(1.0, 3.0, -2.0, 4.0, 0.25, rho * 2 * 0.5)
    assert mixtures.information([c], 200, 5) == pytest.approx(-0.5 * math.log2(1 - rho**2), abs=2e-3)


def test_thresholds_against_direct_fit(spark):
    """The histogram's mixture parts loud frames from the rest as a fit to all frames does."""
    g = np.random.default_rng(8)
    rows, truth = [], {}
    for file, (a, b, c) in {"x": (-6, -2, 3), "y": (-1, 0.5, 6)}.items():
        e = np.concatenate((g.normal(a, 0.6, 3000), g.normal(b, 0.5, 2000), g.normal(c, 0.7, 1500)))
        rows += [(file, float(v)) for v in np.exp(e)]
        mean, var, weight = np.quantile(e, [1 / 6, 1 / 2, 5 / 6]), np.full(3, e.var() / 3), np.full(3, 1 / 3)
        for _ in range(200):
            d = weight * np.exp(-((e[:, None] - mean) ** 2) / 2 / var) / np.sqrt(var)
            r = d / d.sum(1, keepdims=True)
            mean, weight = (r * e[:, None]).sum(0) / r.sum(0), r.mean(0)
            var = (r * (e[:, None] - mean) ** 2).sum(0) / r.sum(0)
        truth[file] = mixtures.line(weight, mean, var)
    rows += [("flat", 2.0)] * 5 + [("x", 0.0), ("x", -1.0), ("none", 0.0)]
    energy = spark.createDataFrame(rows, "file string, energy double")
    got = {r["file"]: r["threshold"] for r in mixtures.speech_thresholds(energy).collect()}
    assert got.pop("flat") == pytest.approx(math.log(2)) and set(got) == {"x", "y"}
    assert all(got[f] == pytest.approx(truth[f], abs=0.15) for f in truth)
    marked = {r["file"]: (r["n"], r["s"]) for r in mixtures.speech_frames(energy).groupBy("file").agg({"speech": "count", "energy": "count"}).toDF("file", "n", "s").collect()}
    assert marked["none"][0] == 1 and not mixtures.speech_frames(energy).where("file = 'none' AND speech").count()
    assert abs(mixtures.speech_frames(energy).where("file = 'x' AND speech").count() - 1500) < 60


def test_noise_levels_by_hand(spark):
    r = random.Random(9)
    rows = [(s, t, [r.choice([0.0, 1.0, 2.0, 5.0]) * r.random(), float(r.randrange(4))]) for s in range(3) for t in range([25, 4, 11][s])]
    got = {(x["seg_id"], x["band"], x["frame_no"]): x["level"] for x in mixtures.noise_levels(spark.createDataFrame(rows, "seg_id int, frame_no int, magnitudes array<double>"), 2, 5, 6).collect()}
    want = {}
    for s in range(3):
        own = [m for k, _, m in rows if k == s]
        for w in range((len(own) - 1) // 5 + 1):
            for band in (0, 1):
                v = [m[band] for m in own[max(0, (w - 1) * 5) : (w + 1) * 5]]
                top = max(v)
                bins = [min(math.floor(x * 6 / top), 5) if top else 0 for x in v]
                common = min(set(bins), key=lambda b: (-bins.count(b), b))
                want[s, band, w * 5 + 4] = top * (common + 0.5) / 6
    assert got == pytest.approx(want)


# ---------------------------------------------------------------- sound, pairs and chains


@pytest.mark.parametrize(("rate", "to"), [(2, 3), (3, 2), (8000, 8000), (44_100, 16_000)])
def test_resampling_in_chunks(spark, rate, to):
    """Chunks give what filtering the whole signal gives; gaps, nulls and repeats are as stated."""
    g = np.random.default_rng(15)
    x = g.normal(size=500)
    rows = [("a", i, float(v)) for i, v in enumerate(x) if not 200 <= i < 330] + [("a", 5, -99.0), ("b", 0, 1.0), ("c", 3, None)]
    df = spark.createDataFrame(rows, "by string, sample_no long, value double")
    got = {by: [r["value"] for r in sound.resampled(df, rate, to, 40, 4).where(f"by = '{by}'").orderBy("sample_no").collect()] for by in "abc"}
    up, down = to // math.gcd(rate, to), rate // math.gcd(rate, to)
    x[200:330] = 0
    taps, reach = sound.polyphase(up, down, 4)
    assert got["a"] == pytest.approx(sound.filtered(x, 0, 0, math.ceil(500 * up / down), up, down, taps, reach))
    assert len(got["b"]) == math.ceil(up / down) and len(got["c"]) == math.ceil(4 * up / down) and not any(got["c"])


def test_resampling_keeps_a_tone(spark):
    """A tone below both limits is the same tone at the new rate."""
    df = spark.createDataFrame([("t", i, math.sin(2 * math.pi * 440 * i / 8000)) for i in range(2000)], "by string, sample_no long, value double")
    y = [r["value"] for r in sound.resampled(df, 8000, 12_000, 500, 16).orderBy("sample_no").collect()]
    assert y[200:2800] == pytest.approx([math.sin(2 * math.pi * 440 * i / 12_000) for i in range(200, 2800)], abs=0.01)


def test_known_tones(spark):
    tones = {f: [math.sin(2 * math.pi * f * i / 8000) + 0.3 * math.sin(4 * math.pi * f * i / 8000) for i in range(400)] for f in (100.0, 160.0, 250.0, 400.0)}
    g = np.random.default_rng(16)
    rows = [(f, v) for f, v in tones.items()] + [(0.0, g.normal(size=400).tolist()), (-1.0, [0.0] * 400), (-2.0, None), (-3.0, []), (-4.0, [1.0, 2.0])]
    got = {r["f"]: (r["pitch"], r["periodicity"]) for r in sound.pitched(spark.createDataFrame(rows, "f double, features array<double>"), 8000, 80, 500).collect()}
    for f in tones:
        assert got[f][0] == pytest.approx(f, rel=0.03) and got[f][1] > 0.95
    assert got[0.0][0] == 0 and all(got[f] == (0, 0) for f in (-1.0, -2.0, -3.0, -4.0))


def test_longest_chains_by_hand(spark):
    r = random.Random(17)
    dots = [(f, r.randrange(12), r.randrange(12)) for f in "ab" for _ in range(60)] + [("one", 1, 1), ("none", None, 3), (None, 1, 1)]
    want = {}
    for f in ("a", "b", "one"):
        own, length = sorted({d[1:] for d in dots if d[0] == f}), {}
        for x, y in own:
            length[x, y] = 1 + max((n for (u, v), n in length.items() if u < x and v < y), default=0)
        want[f] = max(length.values())
    df = spark.createDataFrame(dots, "file string, x long, y long")
    assert {r["file"]: r["length"] for r in matching.longest_chains(df).collect()} == want
    assert matching.longest_chains(df.limit(0)).count() == 0


def test_pairs_of_a_group_that_holds_most_rows(spark):
    """Every pair once, a's key the smaller; no cell holds more than two blocks."""
    rows = [("big", i, str(i)) for i in range(300)] + [("small", i, "x") for i in (3, 1, 2)] + [("one", 1, "y"), ("twice", 5, "p"), ("twice", 5, "q")]
    got = order.paired(spark.createDataFrame(rows, "g string, k int, v string"), ["g"], "k", 20).select("g", "a.k", "a.v", "b.k", "b.v").collect()
    want = {(g, k, v, m, w) for g, k, v in rows for h, m, w in rows if g == h and k < m}
    assert len(got) == len(want) and set(map(tuple, got)) == want


# ---------------------------------------------------------------- words in slices


def test_cuts_against_all_cuts():
    g = np.random.default_rng(10)
    for n, k in ((1, 3), (3, 3), (7, 3), (9, 4), (6, 1), (8, 2)):
        for _ in range(15):
            d = g.integers(0, 5, (n, k)).astype(float)
            used = min(n, k)
            every = [sum(d[a:b, s].sum() for s, (a, b) in enumerate(itertools.pairwise((0, *c, n)))) for c in itertools.combinations(range(1, n), used - 1)]
            cost, firsts = segmental.cuts_of(d[:, :used])
            assert cost == min(every)
            assert sum(d[a:b, s].sum() for s, (a, b) in enumerate(itertools.pairwise((*firsts, n)))) == cost and all(a < b for a, b in itertools.pairwise((*firsts, n)))


def test_viterbi_kmeans_finds_slices(spark):
    """Words of three stretches, of uneven lengths: the cost never rises and the stretches are found."""
    g = np.random.default_rng(11)
    rows = []
    for run in range(30):
        label, t = run % 2, 0
        for s in range(3):
            for _ in range(g.integers(2, 9)):
                rows.append((run, label, t, [float(10 * s + 3 * label + g.normal()), float(-5 * s + g.normal())]))
                t += 1
    rows += [(99, 1, 0, [0.0, 0.0]), (98, 0, 0, None), (97, 0, 0, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "seg_id int, label int, frame_no int, features array<double>")
    means, cuts, costs = segmental.viterbi_kmeans(df, ["seg_id"], ["frame_no"], 2, 3, 5)
    assert all(b <= a + 1e-6 for a, b in itertools.pairwise(costs)) and len(costs) == 5
    for r in means.collect():
        assert r["centre"] == pytest.approx([10 * r["slice"] + 3 * r["label"], -5 * r["slice"]], abs=1.0)
    assert cuts.where("run = '99'").count() == 1 and cuts.where("run IN ('98', '97')").count() == 0
    assert cuts.groupBy("run").sum("n").agg({"sum(n)": "sum"}).first()[0] == len(rows) - 2
    assert segmental.viterbi_kmeans(df.limit(0), ["seg_id"], ["frame_no"], 2, 3, 2)[0].count() == 0


# ---------------------------------------------------------------- word likeness


def change_by_hand(costs, fx, fy):
    n, m = costs.shape
    total = {(0, 0): 0.0}
    came = {}
    at = lambda i, j: total.get((i, j), math.inf)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            s, a, d = at(i - 1, j - 1), at(i, j - 1), at(i - 1, j)
            came[i, j] = (1, 1) if s <= a and s <= d else (0, 1) if a <= d else (1, 0)
            total[i, j] = min(s, a, d) + costs[i - 1, j - 1]
    i, j, num, den, steps, plain = n, m, 0.0, 0.0, 0, 0.0
    while i and j:
        f = math.hypot(fx[i - 1], fy[j - 1])
        num, den, steps, plain = num + costs[i - 1, j - 1] * f, den + f, steps + 1, plain + costs[i - 1, j - 1]
        di, dj = came[i, j]
        i, j = i - di, j - dj
    return (num / den if den else plain / steps) * steps / (n + m)


def flux_by_hand(costs, flux):
    n, m = costs.shape
    total, came = {(0, 0, 0): flux[0] * costs[0, 0]}, {}
    at = lambda k, i, j: total.get((k, i, j), math.inf)
    for k in range(len(flux)):
        for i in range(n):
            for j in range(m):
                if (k, i, j) == (0, 0, 0):
                    continue
                ways = [(at(k - q, i - a, j - b), (k - q, i - a, j - b)) for q in (1, 0) for a, b in ((1, 1), (0, 1), (1, 0))]
                best, where = min(ways, key=lambda w: w[0])
                total[k, i, j], came[k, i, j] = best + flux[k] * costs[i, j], where
    k, i, j = len(flux) - 1, n - 1, m - 1
    if not math.isfinite(at(k, i, j)):
        return math.nan
    value, a, b = total[k, i, j], 0.0, 0.0
    while i and j and k:
        k, i, j = came[k, i, j]
        a, b = (a, b + flux[k]) if i > n // 2 else (a + flux[k], b)
    p = (a + 1e-3) / (a + b + 2e-3)
    return value / max(1, (len(flux) - 1) // 2) / (-p * math.log2(p) - (1 - p) * math.log2(1 - p))


def test_likeness_by_hand():
    g = np.random.default_rng(12)
    shapes = [(1, 1), (1, 4), (5, 1), (4, 6), (6, 6), (7, 3)]
    each = [np.where(c > 0.8, words.FAR, c) for c in (g.random(s) for s in shapes)]
    fx, fy = [g.random(s[0]) for s in shapes], [g.random(s[1]) for s in shapes]
    fx[3][:], fy[3][:] = 0, 0
    n, m = np.array([s[0] for s in shapes]), np.array([s[1] for s in shapes])
    costs = words.filled(each, (7, 6))
    got = words.change_weighted(costs, words.filled(fx, (7,)), words.filled(fy, (6,)), n, m)
    assert got == pytest.approx([change_by_hand(c, a, b) for c, a, b in zip(each, fx, fy, strict=True)])
    for depth, every in ((1, 1), (3, 2), (6, 2), (9, 3)):
        flux = words.flux_pattern(depth, every)
        assert words.third_axis(costs, flux, n, m) == pytest.approx([flux_by_hand(c, flux) for c in each], nan_ok=True)


def test_likeness_of_columns(spark):
    g = np.random.default_rng(13)
    pairs = [(i, g.random((g.integers(0, 5), 6)).tolist(), g.random((g.integers(0, 5), 6)).tolist()) for i in range(20)]
    df = spark.createDataFrame(pairs, "id int, x array<array<double>>, y array<array<double>>")
    for r in df.select("*", words.change_distance(df["x"], df["y"], 2, 4).alias("d")).collect():
        if r["x"] and r["y"]:
            x, y = np.array(r["x"]), np.array(r["y"])
            assert r["d"] == pytest.approx(change_by_hand(words.cosine_costs(x, y), words.changes(x, 2, 4), words.changes(y, 2, 4)))
        else:
            assert r["d"] == (0.0 if not r["x"] and not r["y"] else None)


# ---------------------------------------------------------------- training


def learnable(spark, n=400, soft=False):
    g = np.random.default_rng(14)
    x = g.normal(size=(n, 4))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.8).astype(int)
    rows = [(v.tolist(), int(k), [0.9, 0.1] if k == 0 else [0.1, 0.9]) for v, k in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "features array<double>, label int, target array<double>").repartition(3)
    return written(df if soft else df.drop("target"))


@pytest.mark.parametrize("soft", [False, True])
def test_bunches_learn_and_restart(spark, soft):
    """Training that was broken off and called again gives the same weights as training in one go."""
    df = learnable(spark, soft=soft)
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    once, seen = network.train_in_bunches(df, [8], 2, df, f"{folder}-a", epochs=6, rate=0.5, bunch=16)
    network.train_in_bunches(df, [8], 2, df, f"{folder}-b", epochs=2, rate=0.5, bunch=16)
    again, both = network.train_in_bunches(df, [8], 2, df, f"{folder}-b", epochs=6, rate=0.5, bunch=16)
    assert all((a == b).all() for a, b in zip(once, again, strict=True)) and both == seen
    assert seen[-1]["loss"] < seen[0]["loss"] and seen[-1]["accuracy"] > 0.75


def test_bunches_average_copies(spark):
    """One task and bunches as large as the data: one descent step."""
    df = learnable(spark, 50).coalesce(1)
    weights = [np.random.default_rng(1).normal(size=s) for s in ((4, 3), (3, 2))]
    g, loss, n, _ = network.gradients(df, weights, np.float64)
    after, before, m = network.bunches(df, weights, 0.3, 1000, np.float64)
    assert (n, m) == (50, 50) and before == pytest.approx(loss)
    assert all(np.allclose(a, w - 0.3 * d / n) for a, w, d in zip(after, weights, g, strict=True))
    same, _, none = network.bunches(df.limit(0), weights, 0.3, 10)
    assert none == 0 and all((a == b).all() for a, b in zip(same, weights, strict=True))


def test_beam_join_with_copies(spark):
    """Most rows share one signature: windows still hold the rows beside each other in the order of (key, id)."""
    sigs = [(i, 5 if i % 4 else i * 37 % 256) for i in range(300)]
    got = {(r["i"], r["j"]) for r in lsh.beam_join(spark.createDataFrame(sigs, "id long, sig long"), "id", 8, -1.1, 2, 6).collect()}
    want = set()
    for p in (0, 4):
        ids = [i for _, i in sorted(((s >> p) | (s << (8 - p)) & 255, i) for i, s in sigs)]
        want |= {(min(a, b), max(a, b)) for k, a in enumerate(ids) for b in ids[k + 1 : k + 4]}
    assert got == want


# ---------------------------------------------------------------- silence, flags, weights, cepstra, error function


def test_silence_around_segments(spark):
    """Made-up frames follow the statistics of the ends, take the ends' labels, and are the same in every run."""
    g = np.random.default_rng(20)
    rows = [(s, t, [float(g.normal(10 if t < 20 else -5, 2)), 3.0], t // 20) for s in range(40) for t in range(40)]
    df = spark.createDataFrame(rows, "seg_id long, frame_no long, features array<double>, label int")
    out = archive.with_silence(df, 2, 30, 5, 20, (1.0, 0.5), (0.5, 0.0), 3).orderBy("seg_id", "frame_no").collect()
    again = archive.with_silence(df.repartition(7), 2, 30, 5, 20, (1.0, 0.5), (0.5, 0.0), 3).orderBy("seg_id", "frame_no").collect()
    assert [r["features"] for r in again] == [pytest.approx(r["features"]) for r in out]  # but for the rounding of sums
    one = [r for r in out if r["seg_id"] == 7]
    assert [r["frame_no"] for r in one] == list(range(75)) and [r["label"] for r in one] == [0] * 30 + [t // 20 for t in range(40)] + [1] * 5
    assert [tuple(r["features"]) for r in one[30:70]] == [tuple(x[2]) for x in rows if x[0] == 7]
    ahead = np.array([r["features"] for r in out if r["frame_no"] < 30])
    expected = np.mean([r[2][0] for r in rows if r[1] < 20]) + 0.5
    assert ahead[:, 0].mean() == pytest.approx(expected, abs=0.1) and ahead[:, 0].std() == pytest.approx(1.0, abs=0.15) and (ahead[:, 1] == 3.5).all()
    assert archive.with_silence(df, 2, 0, 0, 5).count() == len(rows) and archive.with_silence(df.limit(0), 2, 3, 3, 5).count() == 0


def test_flagged_rows(spark, tmp_path):
    """Segments follow from the flags wherever ranges and blocks end; numbers and codes."""
    import pandas as pd

    lengths = [3, 1, 9, 4, 1]
    g = np.random.default_rng(21)
    frames = pd.DataFrame([(s, t, g.integers(0, 256, 3)) for s, n in enumerate(lengths) for t in range(n)], columns=["seg_id", "frame_no", "features"])
    (tmp_path / "a.codes").write_bytes(sinks.flagged_bytes()(frames))
    (tmp_path / "b.numbers").write_bytes(sinks.flagged_bytes(">f4")(frames))
    want = [(s, t, tuple(map(float, f))) for s, t, f in frames.itertuples(index=False)]
    for name, dtype in (("a.codes", "u1"), ("b.numbers", ">f4")):
        for block in (2, 5, 1000):
            got = ranged.segmented(ranged.scan(spark, "flagged", str(tmp_path / name), width=3, dtype=dtype, part_bytes=30), block)
            assert sorted((r["seg_id"], r["frame_no"], tuple(r["features"])) for r in got.collect()) == want
    (tmp_path / "c.codes").write_bytes(b"12345")
    with pytest.raises(Exception, match="aren't rows"):
        ranged.scan(spark, "flagged", str(tmp_path / "c.codes"), width=3).count()


def test_weight_files(spark, tmp_path):
    (tmp_path / "w").write_text("weigvec 6\n1\n-2.5\n3e-3\n4 5\n6\nbiasvec 2\n 0.5 -1E+2\n")
    got = [tuple(r)[1:] for r in files.weights_text(spark, str(tmp_path / "w"), {"weigvec": 3}).orderBy("section", "row", "column").collect()]
    assert got == [("biasvec", 0, 0, 0.5), ("biasvec", 1, 0, -100.0), *[("weigvec", k // 3, k % 3, v) for k, v in enumerate((1, -2.5, 0.003, 4, 5, 6))]]
    (tmp_path / "x").write_text("weigvec 3\n1\n2\n")
    with pytest.raises(Exception, match="its size"):
        files.weights_text(spark, str(tmp_path / "x"), {}).collect()


def test_cepstral_features(spark):
    """The driver's parts, computed on the whole signal at once."""
    g = np.random.default_rng(22)
    x = g.normal(size=300)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "by string, sample_no long, value double")
    got = np.array([r["features"] for r in frontend.cepstral_features(df, 8000, 8000, 40, 20, 64, 10, 6).orderBy("frame_no").collect()])
    first = frontend.cepstra(np.stack([x[k : k + 40] for k in range(0, 261, 20)]), 64, 8000.0, 10, 6)
    slope = lambda c: sum(k * c[np.clip(np.arange(len(c)) + k, 0, len(c) - 1)] for k in range(-2, 3))
    assert np.allclose(got, np.concatenate((first, slope(first), slope(slope(first))), axis=1))
    half = frontend.cepstral_features(df, 8000, 4000, 20, 10, 32, 6, 4)
    assert half.count() == (150 - 20) // 10 + 1 and len(half.first()["features"]) == 12


def test_error_functions(spark):
    x = [-2.0, -0.3, 0.0, 1e-3, 1.5]
    df = spark.createDataFrame([(x,), ([],), (None,)], "x array<double>").withColumn("e", codecs.error_function("x"))
    rows = df.withColumn("back", codecs.inverse_error_function("e")).collect()
    assert rows[0]["e"] == pytest.approx([math.erf(v) for v in x]) and rows[0]["back"] == pytest.approx(x, abs=1e-9)
    assert rows[1]["back"] == [] and rows[2]["back"] is None
    edge = spark.createDataFrame([([1.0, -1.0, 2.0],)], "e array<double>").select(codecs.inverse_error_function("e").alias("x")).first()["x"]
    assert edge == [math.inf, -math.inf, None]


def test_batches_are_single_pairs():
    """Casts, keywords, tokens and predictors of a batch of uneven pairs are those of each pair by itself, and of plain loops."""
    g = np.random.default_rng(23)
    costs = [g.random((g.integers(1, 15), g.integers(1, 15))) for _ in range(40)]
    assert align.casts(costs, 4, 2.5, 0.4) == [align.cast(c, 4, 2.5, 0.4) for c in costs]
    assert align.keyword_ends(costs) == [align.keyword_end(c) for c in costs]
    centres = [(c.shape[0] // 2, c.shape[1] // 2) for c in costs]
    assert align.casts_both(costs, centres, 4, 2.5, 0.4) == [align.cast_both(c, *p, 4, 2.5, 0.4) for c, p in zip(costs, centres, strict=True)]

    def cast_by_hand(c, band, limit, trim):
        total, came, best, where = {}, {}, -1, (-1, -1)
        for i in range(c.shape[0]):
            for j in range(max(0, i - band), min(c.shape[1], i + band + 1)):
                ways = [total.get((i - 1, j - 1), math.inf if i or j else 0.0), total.get((i - 1, j), math.inf), total.get((i, j - 1), math.inf)]
                if min(ways) + c[i, j] <= limit:
                    total[i, j], came[i, j] = min(ways) + c[i, j], ways.index(min(ways))
                    if i * i + j * j > best:
                        best, where = i * i + j * j, (i, j)
        i, j = where
        while i > 0 and j > 0 and c[i, j] >= trim:
            i, j = [(i - 1, j - 1), (i - 1, j), (i, j - 1)][came[i, j]]
        return (i, j, total[i, j]) if best >= 0 else (-1, -1, 0.0)

    assert np.allclose(align.casts(costs, 4, 2.5, 0.4), [cast_by_hand(c, 4, 2.5, 0.4) for c in costs])
    words_ = [([str(x) for x in g.integers(0, 3, g.integers(0, 7))], [str(x) for x in g.integers(0, 3, g.integers(0, 7))]) for _ in range(40)]

    def tokens_by_hand(a, b):
        if not a or not b:
            return 0.0 if not a and not b else 1.0
        t = np.full((len(a) + 1, len(b) + 1), np.inf)
        t[0, 0] = 0
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            t[i, j] = min(t[i - 1, j - 1] + (a[i - 1] != b[j - 1]), t[i - 1, j] + 1, t[i, j - 1] + 1)
        return t[-1, -1] / (len(a) + len(b))

    assert align.token_distances(words_) == pytest.approx([tokens_by_hand(a, b) for a, b in words_])
    x = g.normal(size=(5, 40))
    x[2] = 0
    a, error = frontend.lpc_rows(frontend.autocorrelation(x, 4))
    for k in (0, 1, 3, 4):
        r = np.array([(x[k, : 40 - q] * x[k, q:]).sum() for q in range(5)])
        assert a[k, 1:] == pytest.approx(-np.linalg.solve([[r[abs(p - q)] for q in range(4)] for p in range(4)], r[1:]))
    assert a[2].tolist() == [1, 0, 0, 0, 0] and error[2] == 0
