import re
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandwise.config import CodecConfig
from strandwise.functions import intcode
from strandwise.operators import dictionary, entropy, features, harmonic, islands, scan, signal, similarity, wavelet
from strandwise.plans import codec
from strandwise.sources import wav

EDGE = [0, -1, 1, 2, 2**63 - 1, -(2**63), 12345]


def rows(spark, series):
    """(series, idx, v) of a dict of lists."""
    return spark.createDataFrame([(k, i, int(x)) for k, xs in series.items() for i, x in enumerate(xs)], "series long, idx long, v long")


def lists(df):
    out = {}
    for r in df.select("series", "idx", "v").collect():
        out.setdefault(r.series, {})[r.idx] = r.v
    return {k: [x[i] for i in range(len(x))] for k, x in out.items()}


def random_series(seed, *lengths, top=1_000_000):
    rng = np.random.default_rng(seed)
    return {i: rng.integers(-top, top, n).tolist() for i, n in enumerate(lengths)}


def test_zigzag_and_buckets(spark):
    df = spark.createDataFrame([(x,) for x in EDGE], "v long").withColumn("z", intcode.zigzag(F.col("v")))
    df = df.withColumn("b", intcode.bucket(F.col("z"))).withColumn("m", intcode.mantissa(F.col("z")))
    got = df.select("v", "z", intcode.unzigzag(F.col("z")).alias("u"), "b", intcode.join_bucket(F.col("b"), F.col("m")).alias("j")).collect()
    for r in got:
        z = r.z & (2**64 - 1)
        assert r.u == r.v and z == (2 * r.v if r.v >= 0 else -2 * r.v - 1) and r.b == z.bit_length() and r.j == r.z


@pytest.mark.parametrize("levels", [1, 3])
def test_wavelet_restores(spark, levels):
    data = random_series(13, 1, 2, 3, 5, 7, 17, 99, 257)
    df = rows(spark, data)
    assert lists(wavelet.compose(scan.cut(wavelet.decompose(df, levels)), levels)) == data


def test_wavelet_across_slices(spark):
    data = random_series(7, 4096 * 2 + 3)
    bands = wavelet.forward(rows(spark, data))
    assert lists(wavelet.inverse(bands)) == data
    block = spark.createDataFrame([(data[0],)], "samples array<long>").select(wavelet.decompose_blocks(1)("samples").alias("b")).first().b
    assert [r.v for r in bands.filter("band = 1").orderBy("idx").collect()] == block[1]


def test_constant_has_no_details(spark):
    assert wavelet.decompose(rows(spark, {0: [12345] * 512}), 5).filter("band > 0 and v <> 0").isEmpty()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=70), st.integers(0, 6))
def test_block_wavelet_any_pattern(x, levels):
    # The kernels behind the column functions, without a session.
    rest, details = np.array(x, np.int64), []
    for _ in range(levels):
        even, odd = rest[::2], rest[1::2]
        if len(odd):
            odd = odd - ((even[: len(odd)] + even[np.minimum(np.arange(len(odd)) + 1, len(even) - 1)]) >> 1)
            b, a = wavelet._near(odd, len(even))
            even = even + ((b + a + 2) >> 2)
        details.append(odd)
        rest = even
    for odd in details[::-1]:
        if len(odd):
            b, a = wavelet._near(odd, len(rest))
            even = rest - ((b + a + 2) >> 2)
            y = np.empty(len(even) + len(odd), np.int64)
            y[::2], y[1::2] = even, odd + ((even[: len(odd)] + even[np.minimum(np.arange(len(odd)) + 1, len(even) - 1)]) >> 1)
            rest = y
    assert rest.tolist() == x


@pytest.mark.parametrize(("x", "runs"), [([0, 0, 0, 5, 0, 0, -3, 0, 0, 0, 0, 7, 0], [3, 2, 4, 1]), ([0] * 100, [100]), ([1, 2, 3, 4, 5], [0] * 6)])
def test_islands(spark, x, runs):
    coded = islands.encode(rows(spark, {0: x}))
    assert [r.run for r in coded.orderBy("pos").collect()] == runs
    assert lists(islands.decode(coded)) == {0: x}


def test_planes(spark):
    z = spark.createDataFrame([(0, i, int(x)) for i, x in enumerate([0, 1, 2, 255, 77])] + [(1, 0, 0)], "series long, pos long, z long")
    bits = islands.planes(z, ["series"])
    assert bits.filter("series = 0").agg(F.max("plane")).first()[0] == 7 and bits.filter("series = 1").count() == 1
    assert sorted(islands.from_planes(bits, ["series"]).collect()) == sorted(z.select("series", "pos", "z").collect())


def test_scans_over_slices(spark):
    df = rows(spark, {0: list(range(100)), 1: [1]})
    got = scan.running_sum(df, ["series"], F.col("v"), "s", size=8)
    assert got.filter("series = 0 and s <> idx * (idx - 1) / 2").isEmpty() and got.count() == 101
    got = scan.last_before(df, ["series"], F.when(F.col("v") % 30 == 0, F.col("v")), "l", size=8)
    assert [r.l for r in got.filter("series = 0").orderBy("idx").collect()] == [None] + [(i - 1) // 30 * 30 for i in range(1, 100)]
    got = scan.neighbours(df, ["series"], lambda w: {"p": F.lag("v", 3).over(w), "n": F.lead("v", 2).over(w)}, 3, 2, size=8)
    assert got.filter("series = 0 and idx >= 3 and p <> idx - 3").isEmpty() and got.filter("series = 0 and idx < 98 and n <> idx + 2").isEmpty()
    assert got.filter("p is null").count() == 4 and got.filter("n is null").count() == 3


def test_scans_keep_clashing_columns(spark):
    names = ["_s", "_v", "_b", "_i", "_t", "_p", "_own", "_n", "_cuts"]
    df = spark.createDataFrame([(k, i, i, *["x"] * len(names)) for k in (0, 1) for i in range(20)] + [(None, 0, 0, *["x"] * len(names))], "series long, idx long, v long, " + ", ".join(f"{n} string" for n in names))
    for out in (
        scan.running_sum(df, ["series"], F.col("v"), "o", size=4), scan.last_before(df, ["series"], F.col("v"), "o", size=4), scan.number(df, ["series"], "v", "o"),
        scan.neighbours(df, ["series"], lambda w: {"o": F.lag("v").over(w)}, before=1, size=4).filter("series is not null"),
    ):
        got = out.collect()
        assert out.columns == [*df.columns, "o"] and len(got) == 40 and all(r[n] == "x" for r in got for n in names)
    assert scan.running_sum(df.limit(0), ["series"], F.col("v"), "o").isEmpty() and scan.number(df.limit(0), ["series"], "v", "o").isEmpty()


def test_number_spreads_an_outlier(spark):
    """One id far from all others mustn't put these into one part."""
    df = spark.createDataFrame([(0, i, 0) for i in range(5000)] + [(0, 10**15, 0), (1, 3, 0), (0, None, 0)], "series long, id long, _s long")
    df = df.select("series", "id")
    got = {(r.series, r.id): r.idx for r in scan.number(df, ["series"], "id").collect()}
    assert got == {(0, i): i for i in range(5000)} | {(0, 10**15): 5000, (0, None): 5001, (1, 3): 0}
    cuts = df.agg(F.percentile_approx("id", F.array(*[F.lit(i / 64) for i in range(1, 64)]), F.lit(1280)).alias("_cuts"))
    sizes = df.crossJoin(cuts).groupBy(scan._part(F.col("id"), F.col("_cuts"), 0, 63)).count().collect()
    assert max(r["count"] for r in sizes) < 300


def test_autocorrelation_by_slices(spark):
    data = random_series(2, 1000, 5, 1)
    got = {(r.series, r.lag): r.r for r in harmonic.autocorrelation(rows(spark, data), 2, 40, size=64).collect()}
    for k, x in data.items():
        x = np.array(x, float)
        for lag in range(2, 41):
            if lag < len(x):
                a, b = x[:-lag], x[lag:]
                assert got.pop((k, lag)) == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)))
    assert not got


def test_references_as_all_pairs(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(5, 8))[rng.integers(0, 5, 120)] + rng.normal(0, 0.2, (120, 8)), 4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [1.0])], "id long, vec array<double>")
    signed = scan.cut(similarity.signatures(df, 3, 4, 8))
    buckets = {(r.id, r.tbl): r.hash for r in signed.collect()}
    assert len(buckets) == 360
    got = {r.tgt: (r.ref, r.similarity) for r in similarity.references(signed, df, 0.8, block=16).collect()}
    want = {}
    for t in range(120):
        pairs = [(round(float(x[r] @ x[t] / np.sqrt((x[r] @ x[r]) * (x[t] @ x[t]))), 9), -min(k for k in range(3) if buckets[r, k] == buckets[t, k]), -r) for r in range(t) if any(buckets[r, k] == buckets[t, k] for k in range(3))]
        if pairs and max(pairs)[0] >= 0.8:
            want[t] = (-max(pairs)[2], max(pairs)[0])
    assert got == want and want


@pytest.mark.parametrize("scored", [False, True])
@pytest.mark.parametrize("bits, copies", [(1, 0), (3, 30)])
def test_candidates_once_each(spark, scored, bits, copies):
    """Buckets of many parts, copies and a zero vector: each pair once, at its first table, without gathering pairs."""
    rng = np.random.default_rng(bits)
    x = rng.normal(0, 1, (90, 5)).round(2)
    x[60 : 60 + copies], x[7] = x[60], 0
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    signed = similarity.signatures(vectors, 3, bits, 5).withColumn("g", F.when(F.col("id") % 2 == 0, "x").otherwise("y"))
    signed = signed.union(signed.filter("id < 9"))
    found = similarity.candidates(signed, ["g"], vectors if scored else None, block=8)
    assert found.columns == ["g", "ref", "tgt", "first_table", *(["similarity"] if scored else [])]
    assert "ref" not in "".join(line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line)
    held = {}
    for r in signed.collect():
        held.setdefault((r.g, r.id), set()).add((r.tbl, r.hash))
    want = {(g, a, b): min(both)[0] for g, a in held for h, b in held if g == h and a < b and (both := held[g, a] & held[h, b])}
    rows = found.collect()
    assert len(rows) == len(want) and {(r.g, r.ref, r.tgt): r.first_table for r in rows} == want
    for r in rows if scored else []:
        long = np.sqrt((x[r.ref] @ x[r.ref]) * (x[r.tgt] @ x[r.tgt]))
        assert abs(r.similarity - (x[r.ref] @ x[r.tgt] / long if long else 0.0)) < 1e-12


def test_candidates_of_repeated_ids(spark):
    signed = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("b", 0, 2), ("b", 0, 1), ("b", 1, 5), ("c", 1, 5), ("d", 0, 9), ("e", None, 1)], "id string, tbl int, hash long")
    assert sorted(map(tuple, similarity.candidates(signed).collect())) == [("a", "b", 0), ("b", "c", 1)]


@pytest.mark.parametrize(("counts", "n"), [([1] * 10, 10), ([9000, *[1] * 30], 31), ([0, 0, 0, 100], 4), ([10**9, *[1] * 300], 301), ([0, 0], 2)])
def test_frequencies(counts, n):
    f = entropy.frequencies(counts)
    assert sum(f) == 1 << entropy.BITS and len(f) == n
    assert all((x > 0) == (c > 0) for x, c in zip(f, counts, strict=True)) or not any(counts)


def plain_frequencies(counts, scale=16_384):
    """Step by step: what lacks or is over goes one by one to or from the largest."""
    total = sum(counts)
    if not total:
        return [scale // len(counts) + (i < scale % len(counts)) for i in range(len(counts))]
    f = [max(1, c * scale // total) if c else 0 for c in counts]
    while sum(f) != scale:
        f[f.index(max(f))] += 1 if sum(f) < scale else -1
    return f


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(1, 3), st.integers(0, 10**6)), min_size=1, max_size=60))
def test_frequencies_step_by_step(counts):
    assert entropy.frequencies(counts) == plain_frequencies(counts)


def test_frequencies_known():
    assert entropy.frequencies([10, 0, 0, 10]) == [8192, 0, 0, 8192] and entropy.frequencies([0, 0, 0, 100]) == [0, 0, 0, 16_384]
    assert entropy.frequencies([0, 0, 0]) == [5462, 5461, 5461] and entropy.frequencies([]) == []


@pytest.mark.parametrize(("seed", "n", "top"), [(1, 10_000, 10), (3, 100, 1), (9, 1, 1)])
def test_rans(seed, n, top):
    x = np.random.default_rng(seed).integers(0, top, n).tolist()
    f = entropy.frequencies(np.bincount(x).tolist())
    assert entropy.rans_decode(entropy.rans_encode(x, f), f, n) == x


def test_rans_detects_damage():
    x = [0, 1, 2, 3] * 50
    f = entropy.frequencies([50] * 4)
    data = bytearray(entropy.rans_encode(x, f))
    data[1] ^= 255
    with pytest.raises(ValueError):
        entropy.rans_decode(bytes(data), f, 200)


def test_skewed_symbols_shrink(spark):
    rng = np.random.default_rng(42)
    x = np.where(rng.random(5000) < 0.9, 0, rng.integers(1, 31, 5000))
    df = spark.createDataFrame([(0, i, int(s)) for i, s in enumerate(x)], "k long, pos long, symbol int")
    coded = entropy.encode(df, ["k"], 2048)
    assert coded.count() == 3 and coded.agg(F.sum(F.length("payload"))).first()[0] < 5000
    assert [r.symbol for r in entropy.decode(coded, ["k"], 2048).orderBy("pos").collect()] == x.tolist()


def test_segments_cover(spark):
    x = random_series(3, 1000, 64, 1)
    df, cfg = rows(spark, x), CodecConfig(min_block=64, max_block=256, energy_threshold=0.5)
    seg = features.segments(features.boundaries(df, cfg), df.groupBy("series").agg(F.count("*").alias("n")), cfg)
    for k, v in x.items():
        own = sorted((r.offset, r.length) for r in seg.filter(f"series = {k}").collect())
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) == len(v)
        assert all(n <= 256 for _, n in own) and all(n >= 64 for _, n in own[:-1])


def test_segments_run_once_without_arrays(spark):
    """The choice isn't run again where it is exploded, and no row of a segment carries its series' array."""
    edges = spark.createDataFrame([(0, w, w % 3 == 0) for w in range(9)] + [(1, 0, False)], "series long, win long, edge boolean")
    lengths = spark.createDataFrame([(0, 600), (1, 5), (2, 0)], "series long, n long")
    seg = features.segments(edges, lengths, CodecConfig(min_block=64, max_block=256))
    plan = seg._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    carried = re.search(r"Generate posexplode\(.*\), \[([^]]*)\], false", plan)[1]
    assert [c.split("#")[0] for c in carried.split(", ")] == ["series"]
    want = [(0, i, o, n) for i, (o, n) in enumerate([(0, 192), (192, 192), (384, 216)])] + [(1, 0, 0, 5)]
    assert sorted(map(tuple, seg.collect())) == want


def test_transform_runs_once_and_in_pieces(spark, monkeypatch):
    """Exploding the result doesn't run the functions again, and pieces of a batch are the whole."""
    monkeypatch.setattr(features, "PIECE", 8)
    data = [(i, list(map(float, range(i % 7))), [0.0] * (i % 7)) for i in range(40)] + [(99, None, None)]
    blocks = spark.createDataFrame(data, "id long, re array<double>, im array<double>")
    back = features.transform(features.transform(blocks), inverse=True).select("id", F.posexplode("re").alias("pos", "x"))
    assert back._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2
    got = {(r.id, r.pos): r.x for r in back.collect()}
    want = {(i, p): float(p) if p < i % 7 else 0.0 for i in range(40) if i % 7 for p in range(1 << (i % 7 - 1).bit_length())}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_streams_leave_a_worker_in_pieces(spark, monkeypatch):
    """A batch's streams, many times its samples, are never held whole."""
    held = []
    monkeypatch.setattr(pd, "DataFrame", lambda out, columns: held.append(sum(len(r[-1]) for r in out)) or out)
    monkeypatch.setattr(codec, "PIECE", 100)
    bands = [[np.arange(50) * 10**9] for _ in range(20)]

    class Blocks:
        schema = {"series": spark.range(1).schema["id"], "seg": spark.range(1).schema["id"]}

        def select(self, *_):
            return self

        def mapInPandas(self, run, shape):
            return list(run([type("Batch", (), {"series": range(20), "seg": range(20), "bands": bands})]))

    pieces = codec.streams(Blocks(), CodecConfig.best())
    assert max(held) < 200 and sum(held) > 20 * 50 * 30 and len({r[0] for p in pieces for r in p}) == 20


def test_models_and_signatures_run_once(spark):
    """Exploding samples or signatures doesn't run their functions again."""
    df = spark.createDataFrame([(0, [(i * i) % 97 for i in range(64)]), (1, [5])], "id long, samples array<long>")
    back = harmonic.reconstruct(harmonic.residual(harmonic.analyse(df, 4, 1000))).select("id", F.posexplode("samples").alias("pos", "v"))
    assert back._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 3
    assert {(r.id, r.pos): r.v for r in back.collect()} == {(0, i): (i * i) % 97 for i in range(64)} | {(1, 0): 5}
    vectors = df.filter("id = 0").select("id", F.transform("samples", lambda x: x.cast("double")).alias("vec"))
    signed = similarity.signatures(vectors, 2, 6, 64)
    assert signed._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(r.tbl for r in signed.collect()) == [0, 1]


def test_chains_restore(spark):
    base = random_series(5, *[16] * 9)
    blocks = spark.createDataFrame([(k, v) for k, v in base.items()], "id long, samples array<long>")
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 9)], "tgt long, ref long")
    assert {r.id: r.samples for r in similarity.restore(similarity.differences(blocks, edges)).collect()} == base


def test_harmonic_restores_and_helps(spark):
    n = np.arange(1000)
    tone = np.round(8000 * np.cos(2 * np.pi * n / 100 + 0.3) + 2000 * np.cos(4 * np.pi * n / 100)).astype(int).tolist()
    noise = random_series(1, 200)[0]
    df = spark.createDataFrame([(0, tone), (1, noise), (2, [5])], "id long, samples array<long>")
    res = harmonic.residual(harmonic.analyse(df, 8, 44_100)).cache()
    left = {r.id: r.samples for r in res.collect()}
    assert sum(x * x for x in left[0]) < 0.01 * sum(x * x for x in tone)
    assert {r.id: r.samples for r in harmonic.reconstruct(res).collect()} == {0: tone, 1: noise, 2: [5]}


def test_dictionary(spark):
    rng = np.random.default_rng(2)
    atoms = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    x = [(i, (rng.normal() * atoms[i % 8] + 0.5 * atoms[(i + 1) % 8]).tolist()) for i in range(64)]
    df = spark.createDataFrame([*x, (99, [0.0] * 8)], "id long, vec array<double>")
    table = dictionary.learn(df, 8, 2, 2)
    assert all(abs(np.linalg.norm(r.vec) - 1) < 1e-9 for r in table.collect()) and table.count() == 8
    exact = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(atoms)], "atom int, vec array<double>")
    back = {r.id: r.vec for r in dictionary.decode(dictionary.encode(df, exact, 2), exact).collect()}
    assert all(np.allclose(back[i], v) for i, v in x) and back[99] == [0.0] * 8
    coded = dictionary.encode(df, exact, 1)
    rough, whole = ({r.id: r.vec for r in dictionary.decode(coded, exact, with_left=w).collect()} for w in (False, True))
    assert all(np.allclose(whole[i], v) for i, v in x) and not all(np.allclose(rough[i], v) for i, v in x)


def voice(n, channels, rate=44_100, depth=16):
    """Tones with noise, silent for a third of the time."""
    rng, i, top = np.random.default_rng(1), np.arange(n), 2 ** (depth - 1) - 1
    out = [np.trunc(np.sin(2 * np.pi * 220 * (c + 1) * i / rate) * 0.5 * top).astype(int) + rng.integers(-50, 51, n) for c in range(channels)]
    return {c: np.where(i // 500 % 3 == 0, 0, x).tolist() for c, x in enumerate(out)}


NONE = {"graph": False, "harmonic": False, "bitplane": False}
SETTINGS = {
    "mono_basic": (1, 16, "fast", NONE), "stereo_basic": (2, 16, "fast", NONE), "24bit_basic": (2, 24, "fast", NONE), "stereo_bitplane": (2, 16, "fast", NONE | {"bitplane": True}),
    "stereo_blockgraph": (2, 16, "fast", NONE | {"graph": True, "min_block": 256, "max_block": 1024}), "mono_harmonic": (1, 16, "fast", NONE | {"harmonic": True, "max_harmonics": 4}),
    "stereo_full": (2, 16, "best", {"min_block": 256, "max_block": 2048, "max_harmonics": 4}), "mono_no_wavelet": (1, 16, "fast", NONE | {"wavelet_levels": 0}),
}


@pytest.mark.parametrize("name", SETTINGS)
def test_codec_restores(spark, name, tmp_path):
    channels, depth, preset, changes = SETTINGS[name]
    cfg, data, told = replace(getattr(CodecConfig, preset)(), **changes), voice(2500, channels, depth=depth), []
    frames = codec.encode(rows(spark, data), cfg, progress=lambda share, phase: told.append((share, phase)))
    frames.write(f"{tmp_path}/frames")
    frames = codec.Frames.read(spark, f"{tmp_path}/frames")
    assert lists(codec.decode(frames, cfg)) == data
    for r in codec.sizes(frames).collect():
        assert r.total_bytes == r.payload_bytes + r.extra_bytes + r.table_bytes + r.meta_bytes + r.model_bytes < 2500 * depth / 8
    assert [s for s, _ in told] == sorted(s for s, _ in told) and told[0] == (0.0, "segmentation") and told[-1] == (1.0, "done")


def test_codec_any_pattern(spark):
    """Shortest, longest and extreme values, contexts of several slices, planes past the shared one."""
    rng = np.random.default_rng(4)
    data = {0: rng.integers(-(2**63), 2**63 - 1, 300).tolist() + [2**63 - 1, -(2**63)], 1: [7], 2: [0] * 200, 3: rng.integers(-3, 4, 700).tolist()}
    for bitplane in (False, True):
        cfg = CodecConfig(min_block=64, max_block=128, wavelet_levels=0, harmonic=False, graph=False, slice_len=100, bitplane=bitplane)
        assert lists(codec.decode(codec.encode(rows(spark, data), cfg), cfg)) == data
    assert codec.decode(codec.encode(rows(spark, {}), cfg), cfg).isEmpty()


def test_codec_sees_damage(spark):
    cfg = CodecConfig(min_block=64, max_block=128, wavelet_levels=1, harmonic=False, graph=False)
    frames = codec.encode(rows(spark, {0: random_series(4, 130)[0]}), cfg)
    worse = replace(frames, codes=frames.codes.withColumn("payload", F.expr("concat(substring(payload, 1, 1), x'ff00', substring(payload, 4, 1000000))")))
    with pytest.raises(Exception, match="corrupt|fit|index"):
        codec.decode(worse, cfg).collect()


def test_files_restore(spark, tmp_path):
    """WAV to frames to identical WAV."""
    data, cfg = voice(1500, 2, depth=24), replace(CodecConfig.fast(), min_block=256)
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    body = wav.pack(np.stack([data[0], data[1]], 1).ravel(), "int24")
    for name in ("a.wav", "b#1.wav"):
        (tmp_path / "in" / name).write_bytes(wav.header(48_000, 2, 1500, "int24") + body)
    codec.encode_files(spark, f"{tmp_path}/in", f"{tmp_path}/frames", cfg)
    done = codec.decode_files(spark, f"{tmp_path}/frames", f"{tmp_path}/out", cfg).collect()
    assert sorted(r.bytes for r in done) == [44 + len(body)] * 2
    for name in ("a.wav", "b#1.wav"):
        assert (tmp_path / "out" / name).read_bytes() == (tmp_path / "in" / name).read_bytes()


def test_wav_read_by_ranges(spark, tmp_path, monkeypatch):
    """Only headers are probed, and blocks are read apart: a file that lacks its samples has a header still."""
    n = 65_536 * 2 + 10
    v = np.arange(n) % 30_000
    (tmp_path / "a.wav").write_bytes(wav.header(8000, 1, n, "int16") + wav.pack(v, "int16"))
    got = {r.block: r for r in wav.read(spark, f"{tmp_path}/a.wav").collect()}
    assert sorted(got) == [0, 1, 2] and got[2].offset == 65_536 * 2 and np.concatenate([got[i].samples for i in range(3)]).tolist() == v.tolist()
    big = tmp_path / "big.wav"
    with big.open("wb") as f:  # 5 GB that take no room
        f.write(wav.header(8000, 2, 1_250_000_000, "int16"))
        f.truncate(f.tell() + 5_000_000_000)
    r = wav.probe(spark, str(big)).first()
    assert (r.container, r.frames, r.truncated) == ("RF64", 1_250_000_000, False)
    assert wav.read(spark, f"{tmp_path}/big.wav").filter("block = 19000").count() == 2


@pytest.mark.parametrize("fmt", ["int16", "int24", "int32", "float32", "float64"])
def test_wav_files(spark, tmp_path, fmt):
    top = {"int16": 2**15, "int24": 2**23, "int32": 2**31, "float32": 2**31, "float64": 2**62}[fmt]
    rng = np.random.default_rng(1)
    want = rng.integers(-top, top, (2, 101))
    df = spark.createDataFrame([("x/a", c, 0, want[c].tolist()) for c in range(2)] + [("b", 0, i, [i] * 3) for i in range(2)], "path string, channel int, block int, samples array<long>")
    files = spark.createDataFrame([("x/a", 48_000, 2, 101, fmt), ("b", 8000, 1, 6, fmt)], "path string, sample_rate long, channels int, frames long, format string")
    (tmp_path / "w").mkdir()
    (tmp_path / "r").mkdir()
    assert {r.path.rsplit("/", 1)[1] for r in wav.write(df, files, f"{tmp_path}/w").collect()} == {"a", "b"}
    content = (tmp_path / "w" / "a").read_bytes()
    assert len(content) % 2 == 0 and sorted(p.name for p in (tmp_path / "w").iterdir() if p.suffix != ".crc") == ["a", "b"]
    (tmp_path / "w" / "cut.wav").write_bytes(content[:-20])
    facts = {r.path.rsplit("/", 1)[1]: r for r in wav.probe(spark, f"{tmp_path}/w").collect()}
    assert facts["a"].frames == 101 and facts["a"].format == fmt and not facts["a"].truncated and facts["cut.wav"].truncated
    got = {r.channel: r.samples for r in wav.read(spark, f"{tmp_path}/w/a").collect()}
    assert got == {0: want[0].tolist(), 1: want[1].tolist()}
    wav.write(df, files, f"{tmp_path}/r", raw=True)
    assert {r.channel: r.samples for r in wav.read_raw(spark, f"{tmp_path}/r/a", 2, fmt).collect()} == got
    with pytest.raises(Exception, match="lacks samples"):
        wav.write(df.filter("channel = 0"), files, f"{tmp_path}/r")


def test_bad_files():
    whole = wav.header(1, 1, 0, "int16")
    for data in (b"", b"RIFF0000WAVE", whole.replace(b"\x10\0data", b"\x08\0data"), whole[:30], b"RIFF0000WAVEfmt \x04\0\0\0\1\0\1\0", b"RF640000WAVEds64\x1c\0\0\0\0\0"):
        with pytest.raises(ValueError):
            wav.parse(data)
    assert wav.parse(wav.header(44_100, 2, 2**31, "int16"))["container"] == "RF64"


def test_streams(spark, tmp_path):
    from strandwise.streaming import features as stream

    ts = pd.to_datetime("2024-01-01") + pd.to_timedelta(np.arange(60), unit="min")
    spark.createDataFrame(pd.DataFrame({"event_type": "a", "user_id": 1, "ts": ts, "value": 1.0})).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    q = stream.energy(live).writeStream.format("memory").queryName("energies").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.n, r.energy) for r in spark.table("energies").collect()] == [(10, 10_000.0)] * 6


def test_sessions(spark, tmp_path):
    from strandwise.streaming import features as stream

    at = [0, 10, 25, 70, 80, 200]
    ts = pd.to_datetime("2024-01-01") + pd.to_timedelta(at, unit="min")
    spark.createDataFrame(pd.DataFrame({"user_id": [1] * 5 + [2], "ts": ts})).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    q = stream.sessions(live).writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    minutes = lambda t: int((t - pd.Timestamp("2024-01-01").to_pydatetime()).total_seconds() / 60)
    assert sorted((r.user_id, minutes(r.start), minutes(r.stop), r.n) for r in spark.table("sessions").collect()) == [(1, 0, 55, 3), (1, 70, 110, 2), (2, 200, 230, 1)]


def test_streamed_segments(spark, tmp_path):
    from strandwise.streaming import features as stream

    wins = spark.createDataFrame([(1, i, 64, i in (2, 5, 6)) for i in range(10)], "series long, win long, n long, edge boolean")
    wins.coalesce(1).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(wins.schema).parquet(f"{tmp_path}/in")
    q = stream.segments(live, 128, 256).writeStream.format("memory").queryName("closed").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.offset, r.length) for r in spark.table("closed").collect()) == [(0, 128), (128, 192), (320, 256)]


def test_config():
    assert CodecConfig.fast().window == 256 and CodecConfig.best().window == 64
    for bad in ({"min_block": 0}, {"max_harmonics": 300}, {"min_block": 10, "max_block": 5}):
        with pytest.raises(ValueError):
            CodecConfig(**bad)


def test_signal_reshapes(spark):
    frames = spark.createDataFrame([(i, i * 3) for i in range(10)], "pos long, v long")
    assert sorted(signal.interleaved(signal.planar(frames, 3), 3).collect()) == sorted(frames.collect())
    data = random_series(8, 100, 1)
    assert lists(signal.scatter(signal.blocks(rows(spark, data), 16))) == data
    assert signal.synthetic(spark, 30_000).filter("idx > 20000 and idx < 25000 and v <> 0").isEmpty()
