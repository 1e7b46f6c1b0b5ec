"""Every query of the library by name, with the SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CodecConfig
from ..functions import arrays, intcode
from ..operators import dictionary, entropy, features, harmonic, islands, scan, signal, similarity, wavelet
from . import codec

SMALL = CodecConfig(min_block=64, max_block=512, energy_threshold=0.5, zcr_threshold=0.2, flux_threshold=4000.0, wavelet_levels=3, max_harmonics=4, slice_len=4096, lsh_tables=2, lsh_bits=6)
ATOMS = 16
BATCH = 4 << 20


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table, in a session whose Arrow batches are BATCH bytes unless the caller has chosen a limit: a Python worker holds
    each batch whole, several times over, and blocks of samples are long rows. Only queries set this."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit) == "67108864b":  # Spark's default
        spark.conf.set(limit, str(BATCH))
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events")


def _signal(spark: SparkSession, d: str, key: str = "user_id") -> DataFrame:
    return signal.from_events(_events(spark, d), key)


def _delta(spark: SparkSession, d: str, key: str = "user_id") -> DataFrame:
    """First differences, 0 for a series' first sample."""
    rows = scan.neighbours(_signal(spark, d, key), ["series"], lambda w: {"p": F.lag("v").over(w)}, before=1)
    return rows.select("series", "idx", F.coalesce(F.col("v") - F.col("p"), F.lit(0)).cast("long").alias("v"))


def _sparse(spark: SparkSession, d: str) -> DataFrame:
    """Differences with the small ones set to zero."""
    return _delta(spark, d).withColumn("v", F.when(F.abs("v") < 5000, F.lit(0)).otherwise(F.col("v")).cast("long"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _atoms(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).filter(F.col("id") < ATOMS).select(F.col("id").cast("int").alias("atom"), arrays.normalise(F.col("vec").cast("array<double>"), 1e-12).alias("vec"))


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    """Bit lengths of one wavelet level's coefficients, by series and band."""
    rows = wavelet.forward(_signal(spark, d, "event_type"))
    return rows.select("series", "band", F.col("idx").alias("pos"), intcode.bucket(intcode.zigzag(F.col("v"))).alias("symbol"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return entropy.histogram(_symbols(spark, d), ["series", "band"])


def zigzag(spark, d):
    return _delta(spark, d).withColumn("z", intcode.zigzag(F.col("v")))


def unzigzag(spark, d):
    return zigzag(spark, d).select("series", "idx", intcode.unzigzag(F.col("z")).alias("v"))


def bit_length(spark, d):
    return zigzag(spark, d).groupBy(intcode.bit_len(F.col("z")).alias("bits")).agg(F.count("*").alias("n"))


def bucket_split(spark, d):
    rows = zigzag(spark, d).withColumn("bucket", intcode.bucket(F.col("z"))).withColumn("m", intcode.mantissa(F.col("z")))
    return rows.select("series", "idx", "bucket", "m", intcode.join_bucket(F.col("bucket"), F.col("m")).alias("z"))


def varint_size(spark, d):
    return zigzag(spark, d).groupBy("series").agg(F.sum(intcode.varint_bytes(F.col("z"))).alias("bytes"), F.max(intcode.plane_clamp(intcode.bit_len(F.col("z")))).alias("planes"))


def format_widths(spark, d):
    rows = spark.createDataFrame([("int16",), ("int24",), ("int32",), ("float32",), ("float64",)], "format string")
    return rows.select("format", intcode.bytes_per_sample(F.col("format")).alias("bytes"), intcode.bit_depth(F.col("format")).alias("bits"))


def next_power(spark, d):
    return _signal(spark, d).groupBy("series").agg(F.count("*").alias("n")).select("series", intcode.next_pow2(F.col("n")).alias("size"))


def dwt_level1(spark, d):
    return wavelet.forward(_signal(spark, d))


def idwt_level1(spark, d):
    return wavelet.inverse(dwt_level1(spark, d))


def subband_sizes(spark, d):
    rows = _signal(spark, d).groupBy("series").agg(F.count("*").alias("n"))
    return rows.select("series", F.posexplode(wavelet.band_sizes(F.col("n"), 3)).alias("band", "size"))


def dwt_multi(spark, d):
    return wavelet.decompose(_signal(spark, d), 3)


def idwt_multi(spark, d):
    return wavelet.compose(dwt_multi(spark, d), 3)


def zero_runs(spark, d):
    """The row after a series' last value has v 0."""
    return islands.encode(_sparse(spark, d)).withColumn("v", F.coalesce("v", F.lit(0)).cast("long"))


def island_roundtrip(spark, d):
    return islands.decode(islands.encode(_sparse(spark, d)))


def _unsigned(spark, d):
    return zigzag(spark, d).select("series", F.col("idx").alias("pos"), "z")


def bitplanes(spark, d):
    return islands.planes(_unsigned(spark, d), ["series"])


def bitplane_roundtrip(spark, d):
    return islands.from_planes(bitplanes(spark, d), ["series"])


def mono_mix(spark, d):
    return signal.mono(_delta(spark, d, "event_type"))


def planar(spark, d):
    rows = _events(spark, d).select(F.col("event_id").alias("pos"), F.round(F.col("value") * 100).cast("long").alias("v"))
    return signal.planar(rows, 4)


def interleave_roundtrip(spark, d):
    return signal.interleaved(planar(spark, d), 4)


def window_features(spark, d):
    return features.window_features(_delta(spark, d), 16)


def local_entropy(spark, d):
    return features.local_entropy(_signal(spark, d, "event_type"), 64).withColumn("entropy", F.round("entropy", 6))


def feature_changes(spark, d):
    rows = features.changes(window_features(spark, d))
    return rows.select("series", "win", F.round("energy_change", 6).alias("energy_change"), F.round("zcr_change", 6).alias("zcr_change"))


def magnitude_spectrum(spark, d):
    return features.spectrum(_delta(spark, d), 16).withColumn("magnitude", F.round("magnitude", 3))


def spectral_flux(spark, d):
    return features.flux(_delta(spark, d), 16).withColumn("flux", F.round("flux", 3))


def boundaries(spark, d):
    return features.boundaries(_delta(spark, d, "event_type"), SMALL)


def segments(spark, d):
    lengths = _signal(spark, d, "event_type").groupBy("series").agg(F.count("*").alias("n"))
    return features.segments(boundaries(spark, d), lengths, SMALL)


def segment_offsets(spark, d):
    return signal.offsets(segments(spark, d).drop("offset"))


def _blocks(spark, d):
    return signal.blocks(_delta(spark, d, "event_type"), 64)


def block_slices(spark, d):
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + x)
    return _blocks(spark, d).select("series", "block", "offset", F.size("samples").alias("length"), total.alias("total"))


def scatter_roundtrip(spark, d):
    return signal.scatter(_blocks(spark, d))


def block_features(spark, d):
    rows = similarity.block_features(_blocks(spark, d))
    return rows.select("series", "block", "length", F.posexplode("vec").alias("bin", "x")).withColumn("x", F.round("x", 6))


def lsh_hash(spark, d):
    return similarity.signatures(_vectors(spark, d), 4, 10, 64)


def lsh_candidates(spark, d):
    return similarity.candidates(lsh_hash(spark, d))


def cosine_pairs(spark, d):
    rows = similarity.candidates(lsh_hash(spark, d), vectors=_vectors(spark, d))
    return rows.select("ref", "tgt", F.round("similarity", 5).alias("similarity"))


def block_graph(spark, d):
    return similarity.references(lsh_hash(spark, d), _vectors(spark, d), 0.3).withColumn("similarity", F.round("similarity", 5))


def _named_blocks(spark, d):
    return _blocks(spark, d).select(F.concat_ws("/", "series", F.lpad("block", 6, "0")).alias("id"), "series", "samples")


def _chain(spark, d):
    """Each block refers to the one before, when both have the same length: chains as long as a series."""
    rows = _blocks(spark, d).select("series", "block", F.size("samples").alias("n"))
    name = lambda b: F.concat_ws("/", "series", F.lpad(b.cast("string"), 6, "0"))
    return rows.filter("n = 64 and block > 0").select(name(F.col("block")).alias("tgt"), name(F.col("block") - 1).alias("ref"))


def graph_delta(spark, d):
    rows = similarity.differences(_named_blocks(spark, d).select("id", "samples"), _chain(spark, d))
    return rows.select("id", "ref", F.posexplode("samples").alias("pos", "v"))


def graph_restore(spark, d):
    rows = similarity.differences(_named_blocks(spark, d).select("id", "samples"), _chain(spark, d))
    return similarity.restore(rows).select("id", F.posexplode("samples").alias("pos", "v"))


def context_entropy(spark, d):
    keys = ["series", "band"]
    return entropy.entropy_bits(flagship(spark, d), keys).withColumn("bits", F.round("bits", 4))


def prob_table(spark, d):
    return entropy.tables(flagship(spark, d), ["series", "band"])


def adaptive_counts(spark, d):
    return entropy.adaptive_counts(_symbols(spark, d), ["series", "band"], 512)


def rans_roundtrip(spark, d):
    keys = ["series", "band"]
    return entropy.decode(entropy.encode(_symbols(spark, d), keys, 512), keys, 512)


def block_metadata(spark, d):
    rows = dwt_multi(spark, d)
    return rows.groupBy("series", "band").agg(F.sum((F.col("v") != 0).cast("long")).alias("num_values"), F.max(intcode.bit_len(intcode.zigzag(F.col("v")))).alias("num_planes"))


def context_report(spark, d):
    """Totals by series and band, by series, and of all; what a total leaves out is named * or -1."""
    rows = _symbols(spark, d).rollup("series", "band").agg(F.count("*").alias("n"), F.max("symbol").alias("top"))
    return rows.select(F.coalesce("series", F.lit("*")).alias("series"), F.coalesce("band", F.lit(-1)).alias("band"), "n", "top")


def autocorr_f0(spark, d):
    return harmonic.fundamental(harmonic.autocorrelation(_delta(spark, d), 2, 12), 0.05).withColumn("r", F.round("r", 6))


def goertzel(spark, d):
    rows = harmonic.goertzel(_delta(spark, d), 10.0, 4)
    return rows.select("series", "k", F.round("amplitude", 3).alias("amplitude"), F.round("phase", 6).alias("phase"))


def harmonic_roundtrip(spark, d):
    blocks = harmonic.residual(harmonic.analyse(_named_blocks(spark, d).select("id", "samples"), 4, 1000))
    return harmonic.reconstruct(blocks).select("id", F.posexplode("samples").alias("pos", "v"))


def mp_step1(spark, d):
    return dictionary.first_atom(_vectors(spark, d).withColumn("vec", F.col("vec").cast("array<double>")), _atoms(spark, d)).withColumn("coef", F.round("coef", 5))


def sparse_roundtrip(spark, d):
    """Each vector from its terms and what they left."""
    coded = dictionary.encode(_vectors(spark, d), _atoms(spark, d), 2)
    back = dictionary.decode(coded, _atoms(spark, d), with_left=True).select("id", F.posexplode("vec").alias("pos", "x"))
    return back.select("id", "pos", F.round("x", 6).alias("x"))


def sparse_error(spark, d):
    """The length of what one atom leaves of each vector."""
    coded = dictionary.encode(_vectors(spark, d), _atoms(spark, d), 1)
    return coded.select("id", F.size("terms").alias("terms"), F.round(F.sqrt(arrays.dot("left", "left")), 6).alias("length"))


def ksvd_learn(spark, d):
    rows = dictionary.learn(_vectors(spark, d), ATOMS, 2, 2)
    return rows.select("atom", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.round("x", 4))


def encode_decode_fast(spark, d):
    return codec.decode(codec.encode(_signal(spark, d, "event_type"), CodecConfig.fast(), 1000), CodecConfig.fast())


def encode_decode_best(spark, d):
    return codec.decode(codec.encode(_signal(spark, d, "event_type"), CodecConfig.best(), 1000), CodecConfig.best())


def compression_ratio(spark, d):
    return codec.sizes(codec.encode(_signal(spark, d, "event_type"), SMALL, 1000))


def context_tables(spark, d):
    """Tables of an alphabet of 24 symbols; contexts are bands 0 to 2 of each series, of which band 2 has no counts."""
    counts = flagship(spark, d)
    contexts = counts.select("series", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("band"))
    return entropy.tables(counts, ["series", "band"], 24, contexts)


def inverse_transform(spark, d):
    """The samples of each block of 64, padded with zeros, back from its Fourier transform."""
    blocks = _blocks(spark, d).select("series", "block", F.transform("samples", lambda x: x.cast("double")).alias("re"), F.transform("samples", lambda x: F.lit(0.0)).alias("im"))
    back = features.transform(features.transform(blocks), inverse=True)
    return back.select("series", "block", F.posexplode("re").alias("pos", "x")).withColumn("x", F.round("x", 3))


def _sig(key: str = "user_id") -> str:
    return f"""sig AS (SELECT {key} AS series, row_number() OVER (PARTITION BY {key} ORDER BY event_id) - 1 AS idx, CAST(round(value * 100) AS BIGINT) AS v FROM events)"""


def _del(key: str = "user_id") -> str:
    return _sig(key) + ", delta AS (SELECT series, idx, coalesce(v - lag(v) OVER (PARTITION BY series ORDER BY idx), 0) AS v FROM sig)"


_SPARSE = _del() + ", sparse AS (SELECT series, idx, CASE WHEN abs(v) < 5000 THEN 0 ELSE v END AS v FROM delta)"
_Z = _del() + ", zz AS (SELECT series, idx, v, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS z FROM delta), bits AS (SELECT *, CASE WHEN z = 0 THEN 0 ELSE length(bin(z)) END AS b FROM zz)"


def _dwt(source: str, name: str) -> str:
    """CTEs of one level: name has series, band, idx and v."""
    return f"""
        {name}_d AS (SELECT series, idx, v, CASE WHEN idx % 2 = 1 THEN v - ((lag(v) OVER w + coalesce(lead(v) OVER w, lag(v) OVER w)) >> 1) END AS d
            FROM {source} WINDOW w AS (PARTITION BY series ORDER BY idx)),
        {name} AS (SELECT series, CAST(idx % 2 AS INTEGER) AS band, idx // 2 AS idx, CASE WHEN idx % 2 = 1 THEN d ELSE
            v + ((coalesce(lead(d) OVER w, lag(d) OVER w, 0) + coalesce(lag(d) OVER w, lead(d) OVER w, 0) + 2) >> 2) END AS v
            FROM {name}_d WINDOW w AS (PARTITION BY series ORDER BY idx))"""


def _dwt3() -> str:
    return ", ".join([_sig(), _dwt("sig", "l1"), "a1 AS (SELECT * FROM l1 WHERE band = 0)", _dwt("a1", "l2"), "a2 AS (SELECT * FROM l2 WHERE band = 0)", _dwt("a2", "l3")]) + """,
        bands AS (SELECT series, 1 AS band, idx, v FROM l1 WHERE band = 1 UNION ALL SELECT series, 2, idx, v FROM l2 WHERE band = 1
            UNION ALL SELECT series, 3, idx, v FROM l3 WHERE band = 1 UNION ALL SELECT series, 0, idx, v FROM l3 WHERE band = 0)"""


_SYMBOLS = _sig("event_type") + "," + _dwt("sig", "l1") + """, sym AS (SELECT series, band, idx AS pos, CASE WHEN v = 0 THEN 0 ELSE
    length(bin(CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END)) END AS symbol FROM l1), hist AS (SELECT series, band, symbol, count(*) AS n FROM sym GROUP BY ALL)"""
_FEATURES = """, signs AS (SELECT *, lag(v) OVER (PARTITION BY series ORDER BY idx) AS p FROM delta),
    feat AS (SELECT series, idx // {w} AS win, count(*) AS n, sum(CAST(v AS DOUBLE) * v) / count(*) AS energy,
        CASE WHEN count(*) > 1 THEN sum(CASE WHEN idx % {w} > 0 AND (v < 0) <> (p < 0) THEN 1 ELSE 0 END) / (count(*) - 1) ELSE 0.0 END AS zcr FROM signs GROUP BY ALL),
    chg AS (SELECT *, abs(energy - lag(energy) OVER o) / greatest(lag(energy) OVER o, 1.0) AS energy_change, abs(zcr - lag(zcr) OVER o) AS zcr_change
        FROM feat WINDOW o AS (PARTITION BY series ORDER BY win))"""
_SPECTRUM = """, spec AS (SELECT series, win, bin, sqrt(re * re + im * im) AS magnitude FROM (
    SELECT series, idx // {w} AS win, bin, sum(v * cos(2 * pi() * bin * (idx % {w}) / {w})) AS re, sum(v * sin(2 * pi() * bin * (idx % {w}) / {w})) AS im
    FROM delta, (SELECT unnest(range(0, {w} // 2 + 1)) AS bin) GROUP BY ALL))"""
_FLUX = _SPECTRUM + """, wins AS (SELECT series, idx // {w} AS win, count(*) AS n FROM delta GROUP BY ALL),
    gap AS (SELECT b.series, b.win, sqrt(sum((b.magnitude - a.magnitude) ** 2)) / {w} AS flux FROM spec b JOIN spec a ON a.series = b.series AND a.win = b.win - 1 AND a.bin = b.bin GROUP BY ALL),
    flux AS (SELECT s.series, s.win, CASE WHEN s.n >= 2 AND p.n >= 2 THEN g.flux ELSE 0.0 END AS flux
        FROM wins s LEFT JOIN wins p ON p.series = s.series AND p.win = s.win - 1 LEFT JOIN gap g ON g.series = s.series AND g.win = s.win)"""
_EDGES = _del("event_type") + (_FEATURES + _FLUX).format(w=64) + """, edges AS (SELECT series, win, coalesce(CAST(energy_change AS FLOAT) > CAST(0.5 AS FLOAT) OR CAST(zcr_change AS FLOAT) > CAST(0.2 AS FLOAT)
    OR CAST(flux AS FLOAT) > CAST(4000 AS FLOAT), false) AS edge FROM chg JOIN flux USING (series, win))"""
_SEGMENTS = "WITH RECURSIVE " + _EDGES + """, size AS (SELECT series, count(*) AS n FROM sig GROUP BY series),
    seg AS (
        SELECT series, 0 AS seg, CAST(0 AS BIGINT) AS "offset", n FROM size
        UNION ALL
        SELECT s.series, s.seg + 1, least(coalesce((SELECT min(e.win) * 64 FROM edges e WHERE e.series = s.series AND e.edge AND e.win * 64 >= s."offset" + 64), s.n), s."offset" + 512), s.n
        FROM seg s WHERE least(coalesce((SELECT min(e.win) * 64 FROM edges e WHERE e.series = s.series AND e.edge AND e.win * 64 >= s."offset" + 64), s.n), s."offset" + 512) < s.n
    ), segs AS (SELECT series, seg, "offset", coalesce(lead("offset") OVER (PARTITION BY series ORDER BY seg), n) - "offset" AS length FROM seg)"""
_BLOCKS = _del("event_type") + ", rows_ AS (SELECT series, idx // 64 AS block, idx % 64 AS pos, v FROM delta), named AS (SELECT series || '/' || lpad(CAST(block AS VARCHAR), 6, '0') AS id, series, block, pos, v, count(*) OVER (PARTITION BY series, block) AS n FROM rows_)"
_LSH = """vecs AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 10000) AS BIGINT)) AS w FROM embeddings),
    comp AS (SELECT id, unnest(w) AS x, unnest(range(0, 64)) AS dim FROM vecs),
    plane AS (SELECT t AS tbl, b AS bit, i AS dim, ((((t * 7919 + b * 104729 + i * 1299709 + 12345) % 1000003) * ((t * 7919 + b * 104729 + i * 1299709 + 12345) % 1000003)) % 2001) - 1000 AS p
        FROM (SELECT unnest(range(0, 4)) AS t), (SELECT unnest(range(0, 10)) AS b), (SELECT unnest(range(0, 64)) AS i)),
    dots AS (SELECT id, tbl, bit, sum(x * p) AS s FROM comp JOIN plane USING (dim) GROUP BY ALL),
    hashed AS (SELECT id, tbl, CAST(sum(CASE WHEN s >= 0 THEN 1 << bit ELSE 0 END) AS BIGINT) AS hash FROM dots GROUP BY ALL),
    cand AS (SELECT a.id AS ref, b.id AS tgt, min(a.tbl) AS first_table FROM hashed a JOIN hashed b ON a.tbl = b.tbl AND a.hash = b.hash AND a.id < b.id GROUP BY ALL),
    dbl AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings),
    cos_ AS (SELECT ref, tgt, first_table, list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec) * list_dot_product(b.vec, b.vec)) AS similarity
        FROM cand JOIN dbl a ON a.id = ref JOIN dbl b ON b.id = tgt)"""

_ALL = {
    "signal": (_signal, f"WITH {_sig()} SELECT series, idx, v FROM sig"),
    "symbol_histogram": (flagship, f"WITH {_SYMBOLS} SELECT series, band, symbol, n FROM hist"),
    "zigzag": (zigzag, f"WITH {_Z} SELECT series, idx, v, z FROM zz"),
    "unzigzag": (unzigzag, f"WITH {_del()} SELECT series, idx, v FROM delta"),
    "bit_length": (bit_length, f"WITH {_Z} SELECT b AS bits, count(*) AS n FROM bits GROUP BY b"),
    "bucket_split": (bucket_split, f"WITH {_Z} SELECT series, idx, b AS bucket, CASE WHEN b <= 1 THEN 0 ELSE z - (CAST(1 AS BIGINT) << (b - 1)) END AS m, z FROM bits"),
    "varint_size": (varint_size, f"WITH {_Z} SELECT series, CAST(sum(greatest(1, (b + 6) // 7)) AS BIGINT) AS bytes, max(least(b, 24)) AS planes FROM bits GROUP BY series"),
    "format_widths": (format_widths, "SELECT * FROM (VALUES ('int16', 2, 16), ('int24', 3, 24), ('int32', 4, 32), ('float32', 4, 32), ('float64', 8, 64)) t(format, bytes, bits)"),
    "next_power": (next_power, f"WITH {_sig()} SELECT series, CAST(2 ** ceil(log2(count(*))) AS BIGINT) AS size FROM sig GROUP BY series"),
    "dwt_level1": (dwt_level1, f"WITH {_sig()}, {_dwt('sig', 'l1')} SELECT series, band, idx, v FROM l1"),
    "idwt_level1": (idwt_level1, f"WITH {_sig()} SELECT series, idx, v FROM sig"),
    "subband_sizes": (subband_sizes, f"""WITH {_sig()}, c AS (SELECT series, count(*) AS n FROM sig GROUP BY series)
        SELECT series, 1 AS band, n // 2 AS size FROM c UNION ALL SELECT series, 2, (n - n // 2) // 2 FROM c
        UNION ALL SELECT series, 3, ((n - n // 2) - (n - n // 2) // 2) // 2 FROM c
        UNION ALL SELECT series, 0, ((n - n // 2) - (n - n // 2) // 2) - ((n - n // 2) - (n - n // 2) // 2) // 2 FROM c"""),
    "dwt_multi": (dwt_multi, f"WITH {_dwt3()} SELECT series, band, idx, v FROM bands"),
    "idwt_multi": (idwt_multi, f"WITH {_sig()} SELECT series, idx, v FROM sig"),
    "zero_runs": (zero_runs, f"""WITH {_SPARSE}, r AS (SELECT series, idx, v FROM sparse WHERE v <> 0 UNION ALL SELECT series, max(idx) + 1, NULL FROM sparse GROUP BY series)
        SELECT series, row_number() OVER o - 1 AS pos, idx - coalesce(lag(idx) OVER o, -1) - 1 AS run, coalesce(v, 0) AS v FROM r WINDOW o AS (PARTITION BY series ORDER BY idx)"""),
    "island_roundtrip": (island_roundtrip, f"WITH {_SPARSE} SELECT series, idx, v FROM sparse"),
    "bitplanes": (bitplanes, f"""WITH {_Z}, most AS (SELECT series, greatest(1, max(b)) AS n FROM bits GROUP BY series)
        SELECT series, plane, idx AS pos, CAST((z >> (n - 1 - plane)) & 1 AS INTEGER) AS bit FROM (SELECT *, unnest(range(0, n)) AS plane FROM bits JOIN most USING (series))"""),
    "bitplane_roundtrip": (bitplane_roundtrip, f"WITH {_Z} SELECT series, idx AS pos, z FROM zz"),
    "mono_mix": (mono_mix, f"WITH {_del('event_type')} SELECT idx, CAST(sum(v) AS BIGINT) // count(*) AS v FROM delta GROUP BY idx"),
    "planar": (planar, "SELECT CAST(event_id % 4 AS INTEGER) AS channel, event_id // 4 AS idx, CAST(round(value * 100) AS BIGINT) AS v FROM events"),
    "interleave_roundtrip": (interleave_roundtrip, "SELECT event_id AS pos, CAST(round(value * 100) AS BIGINT) AS v FROM events"),
    "window_features": (window_features, f"WITH {_del()}{_FEATURES.format(w=16)} SELECT series, win, n, energy, zcr FROM feat"),
    "local_entropy": (local_entropy, f"""WITH {_sig('event_type')}, w AS (SELECT series, idx // 64 AS win, v FROM sig), e AS (SELECT series, win, min(v) AS lo, max(v) AS hi, count(*) AS n FROM w GROUP BY ALL),
        b AS (SELECT series, win, n, CASE WHEN hi > lo THEN least(CAST(floor((v - lo) / (hi - lo) * 64) AS BIGINT), 63) ELSE 0 END AS bin, count(*) AS c FROM w JOIN e USING (series, win) GROUP BY ALL)
        SELECT series, win, round(sum(-(c / n) * log2(c / n)), 6) AS entropy FROM b GROUP BY ALL"""),
    "feature_changes": (feature_changes, f"WITH {_del()}{_FEATURES.format(w=16)} SELECT series, win, round(energy_change, 6) AS energy_change, round(zcr_change, 6) AS zcr_change FROM chg"),
    "magnitude_spectrum": (magnitude_spectrum, f"WITH {_del()}{_SPECTRUM.format(w=16)} SELECT series, win, bin, round(magnitude, 3) AS magnitude FROM spec"),
    "spectral_flux": (spectral_flux, f"WITH {_del()}{_FLUX.format(w=16)} SELECT series, win, round(flux, 3) AS flux FROM flux"),
    "boundaries": (boundaries, f"WITH {_EDGES} SELECT series, win, edge FROM edges"),
    "segments": (segments, f'{_SEGMENTS} SELECT series, seg, "offset", length FROM segs'),
    "segment_offsets": (segment_offsets, f'{_SEGMENTS} SELECT series, seg, length, CAST(sum(length) OVER (PARTITION BY series ORDER BY seg) AS BIGINT) - length AS "offset" FROM segs'),
    "block_slices": (block_slices, f'WITH {_BLOCKS} SELECT series, block, block * 64 AS "offset", count(*) AS length, CAST(sum(v) AS BIGINT) AS total FROM rows_ GROUP BY series, block'),
    "scatter_roundtrip": (scatter_roundtrip, f"WITH {_del('event_type')} SELECT series, idx, v FROM delta"),
    "block_features": (block_features, f"""WITH {_BLOCKS}, parts AS (SELECT series, block, n, greatest(1, n // 32) AS part, pos, v FROM named),
        rms AS (SELECT series, block, n, pos // part AS bin, sqrt(sum(CAST(v AS DOUBLE) * v) / count(*)) AS x FROM parts WHERE pos // part < 32 GROUP BY ALL),
        norm AS (SELECT series, block, n, sqrt(sum(x * x)) AS l FROM rms GROUP BY ALL)
        SELECT b.series, b.block, b.n AS length, CAST(b.bin AS INTEGER) AS bin, round(CASE WHEN l > 1e-9 THEN coalesce(x, 0.0) / l ELSE coalesce(x, 0.0) END, 6) AS x
        FROM (SELECT *, unnest(range(0, 32)) AS bin FROM norm) b LEFT JOIN rms r ON r.series = b.series AND r.block = b.block AND r.bin = b.bin"""),
    "lsh_hash": (lsh_hash, f"WITH {_LSH} SELECT id, tbl, hash FROM hashed"),
    "lsh_candidates": (lsh_candidates, f"WITH {_LSH} SELECT ref, tgt, first_table FROM cand"),
    "cosine_pairs": (cosine_pairs, f"WITH {_LSH} SELECT ref, tgt, round(similarity, 5) AS similarity FROM cos_"),
    "block_graph": (block_graph, f"""WITH {_LSH}, ranked AS (SELECT *, row_number() OVER (PARTITION BY tgt ORDER BY round(similarity, 9) DESC, first_table, ref) AS r FROM cos_)
        SELECT tgt, ref, round(similarity, 5) AS similarity FROM ranked WHERE r = 1 AND round(similarity, 9) >= 0.3"""),
    "graph_delta": (graph_delta, f"""WITH {_BLOCKS} SELECT a.id, b.id AS ref, CAST(a.pos AS INTEGER) AS pos, a.v - coalesce(b.v, 0) AS v FROM named a
        LEFT JOIN named b ON b.series = a.series AND b.block = a.block - 1 AND b.pos = a.pos AND a.n = 64"""),
    "graph_restore": (graph_restore, f"WITH {_BLOCKS} SELECT id, CAST(pos AS INTEGER) AS pos, v FROM named"),
    "context_entropy": (context_entropy, f"WITH {_SYMBOLS}, t AS (SELECT series, band, sum(n) AS t FROM hist GROUP BY ALL) SELECT series, band, CAST(sum(n) AS BIGINT) AS n, round(sum(-n * log2(n / t)), 4) AS bits FROM hist JOIN t USING (series, band) GROUP BY ALL"),
    "prob_table": (prob_table, f"""WITH {_SYMBOLS}, t AS (SELECT series, band, CAST(sum(n) AS BIGINT) AS t, max(symbol) AS top FROM hist GROUP BY ALL),
        dense AS (SELECT d.series, d.band, d.symbol, CASE WHEN n > 0 THEN greatest(1, n * 16384 // t) ELSE 0 END AS f FROM (SELECT *, unnest(range(0, top + 1)) AS symbol FROM t) d LEFT JOIN hist h ON h.series = d.series AND h.band = d.band AND h.symbol = d.symbol),
        fixed AS (SELECT *, f + CASE WHEN row_number() OVER (PARTITION BY series, band ORDER BY f DESC, symbol) = 1 THEN 16384 - CAST(sum(f) OVER (PARTITION BY series, band) AS BIGINT) ELSE 0 END AS freq FROM dense)
        SELECT series, band, CAST(symbol AS INTEGER) AS symbol, freq, CAST(sum(freq) OVER (PARTITION BY series, band ORDER BY symbol) AS BIGINT) - freq AS start FROM fixed"""),
    "adaptive_counts": (adaptive_counts, f"WITH {_SYMBOLS} SELECT series, band, pos, symbol, row_number() OVER (PARTITION BY series, band, symbol ORDER BY pos) - 1 AS seen FROM sym"),
    "rans_roundtrip": (rans_roundtrip, f"WITH {_SYMBOLS} SELECT series, band, pos, symbol FROM sym"),
    "block_metadata": (block_metadata, f"""WITH {_dwt3()} SELECT series, band, CAST(sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS num_values,
        max(CASE WHEN v = 0 THEN 0 ELSE length(bin(CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END)) END) AS num_planes FROM bands GROUP BY ALL"""),
    "context_report": (context_report, f"WITH {_SYMBOLS} SELECT coalesce(series, '*') AS series, coalesce(band, -1) AS band, count(*) AS n, max(symbol) AS top FROM sym GROUP BY ROLLUP (series, band)"),
    "autocorr_f0": (autocorr_f0, f"""WITH {_del()}, c AS (SELECT a.series, l AS lag, sum(CAST(a.v AS DOUBLE) * b.v) AS xy, sum(CAST(a.v AS DOUBLE) * a.v) AS xx, sum(CAST(b.v AS DOUBLE) * b.v) AS yy
            FROM (SELECT *, unnest(range(2, 13)) AS l FROM delta) a JOIN delta b ON b.series = a.series AND b.idx = a.idx + a.l GROUP BY ALL),
        r AS (SELECT series, lag, round(CASE WHEN xx > 0 AND yy > 0 THEN xy / sqrt(xx * yy) ELSE 0.0 END, 9) AS r FROM c),
        b AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY r DESC, lag) AS o FROM r)
        SELECT series, CASE WHEN r >= 0.05 THEN lag ELSE 0 END AS lag, round(r, 6) AS r FROM b WHERE o = 1"""),
    "goertzel": (goertzel, f"""WITH {_del()}, s AS (SELECT series, k, sum(v * cos(2 * pi() * k * idx / 10)) AS re, sum(v * sin(2 * pi() * k * idx / 10)) AS im, count(*) AS n
        FROM (SELECT *, unnest(range(1, 5)) AS k FROM delta) GROUP BY ALL) SELECT series, CAST(k AS INTEGER) AS k, round(sqrt(re * re + im * im) * 2 / n, 3) AS amplitude, round(atan2(-im, re), 6) AS phase FROM s"""),
    "harmonic_roundtrip": (harmonic_roundtrip, f"WITH {_BLOCKS} SELECT id, CAST(pos AS INTEGER) AS pos, v FROM named"),
    "mp_step1": (mp_step1, f"""WITH dbl AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings),
        d AS (SELECT s.id, CAST(a.id AS INTEGER) AS atom, list_dot_product(s.vec, a.vec) / sqrt(list_dot_product(a.vec, a.vec)) AS d FROM dbl s, dbl a WHERE a.id < {ATOMS}),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(abs(d), 6) DESC, atom) AS o FROM d) SELECT id, atom, round(d, 5) AS coef FROM r WHERE o = 1"""),
    "sparse_roundtrip": (sparse_roundtrip, "SELECT vec_id AS id, CAST(pos AS INTEGER) AS pos, round(CAST(embedding[pos + 1] AS DOUBLE), 6) AS x FROM (SELECT *, unnest(range(0, len(embedding))) AS pos FROM embeddings)"),
    "sparse_error": (sparse_error, f"""WITH dbl AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings),
        d AS (SELECT s.id, list_dot_product(s.vec, s.vec) AS l, list_dot_product(s.vec, a.vec) / sqrt(list_dot_product(a.vec, a.vec)) AS d FROM dbl s, dbl a WHERE a.id < {ATOMS})
        SELECT id, 1 AS terms, round(sqrt(greatest(0.0, l - max(d * d))), 6) AS length FROM d GROUP BY id, l"""),
    "inverse_transform": (inverse_transform, f"""WITH {_BLOCKS}, size AS (SELECT DISTINCT series, block, n FROM named),
        places AS (SELECT series, block, unnest(range(0, CAST(2 ** ceil(log2(n)) AS BIGINT))) AS pos FROM size)
        SELECT p.series, p.block, CAST(p.pos AS INTEGER) AS pos, round(CAST(coalesce(v, 0) AS DOUBLE), 3) AS x FROM places p LEFT JOIN named n ON n.series = p.series AND n.block = p.block AND n.pos = p.pos"""),
    "context_tables": (context_tables, f"""WITH {_SYMBOLS}, t AS (SELECT series, band, CAST(sum(n) AS BIGINT) AS t FROM hist WHERE symbol < 24 GROUP BY ALL),
        c AS (SELECT *, unnest(range(0, 24)) AS symbol FROM (SELECT DISTINCT series, unnest([0, 1, 2]) AS band FROM hist)),
        dense AS (SELECT c.series, c.band, c.symbol, CASE WHEN t IS NULL THEN 16384 // 24 + CASE WHEN c.symbol < 16384 % 24 THEN 1 ELSE 0 END WHEN n > 0 THEN greatest(1, n * 16384 // t) ELSE 0 END AS f
            FROM c LEFT JOIN t USING (series, band) LEFT JOIN hist h ON h.series = c.series AND h.band = c.band AND h.symbol = c.symbol),
        fixed AS (SELECT *, f + CASE WHEN row_number() OVER (PARTITION BY series, band ORDER BY f DESC, symbol) = 1 THEN 16384 - CAST(sum(f) OVER (PARTITION BY series, band) AS BIGINT) ELSE 0 END AS freq FROM dense)
        SELECT series, band, CAST(symbol AS INTEGER) AS symbol, freq, CAST(sum(freq) OVER (PARTITION BY series, band ORDER BY symbol) AS BIGINT) - freq AS start FROM fixed"""),
    "ksvd_learn": (ksvd_learn, None),
    "encode_decode_fast": (encode_decode_fast, f"WITH {_sig('event_type')} SELECT series, idx, v FROM sig"),
    "encode_decode_best": (encode_decode_best, f"WITH {_sig('event_type')} SELECT series, idx, v FROM sig"),
    "compression_ratio": (compression_ratio, None),
}

QUERIES = {name: query for name, (query, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
