"""Relations, sources, streams, native kernels, and the registered queries against SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from rasterloom.functions import pixels as P
from rasterloom.functions.binary import i32le, samples, u16be, u16le, u32be, u32le
from rasterloom.functions.dispatch import codec, extension_hash, sniffed
from rasterloom.names import extension_hash as plain_hash
from rasterloom.operators import decode as D
from rasterloom.operators.decode import decode_images, file_pixels, jpeg_segments, png_chunks, to_pixels
from rasterloom.plans import queries as plans
from rasterloom.plans import rasters as R
from rasterloom.sources.images import from_base64, from_hex, read_headers, read_images, register
from rasterloom.streaming.images import stream_images

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("images")
    v = np.arange(48).reshape(4, 4, 3) * 5
    for name, data in {"a.png": R.png(v, 2), "b.QOI": R.qoi(v), "c.ppm": R.pnm(v), "d.txt": b"text", "e.png": R.png(v, 2)[:50], "f.heic": b"x"}.items():
        (base / name).write_bytes(data)
    return str(base), v


def test_read_images(spark, folder):
    path, v = folder
    rows = {r.path[-5:]: r for r in read_images(spark, path).collect()}
    assert {k: r.status for k, r in rows.items()} == {"a.png": 0, "b.QOI": 0, "c.ppm": 0, "d.txt": -1, "e.png": -1, ".heic": -2}
    assert all(bytes(rows[k].data) == v.astype(np.uint8).tobytes() for k in ("a.png", "b.QOI", "c.ppm"))
    head = read_images(spark, path, glob="*.png", openIntent="readonly_header").where("status = 0").collect()
    assert [(r.width, r.data) for r in head] == [(4, None)]


def test_filters_reach_the_scan_and_selections_the_map(spark, folder):
    path, _ = folder
    wide = read_images(spark, path, where="length < 150", fields=["width", "status"])
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(length), LessThan(length,150)]" in plan or "LessThan(length,150)" in plan.split("PushedFilters")[1].split("]")[0]
    assert wide.columns == ["path", "modificationTime", "length", "status", "width"]
    assert {r.path[-5:]: (r.status, r.width) for r in wide.where("path like '%.png'").collect()} == {"a.png": (0, 4), "e.png": (-1, None)}


def test_headers_decode_no_samples(spark, folder):
    path, v = folder
    broken = {r.path[-5:]: r for r in read_headers(spark, path, glob="*.{ppm,QOI}").collect()}
    assert [(broken[k].status, broken[k].width, broken[k].height) for k in ("c.ppm", "b.QOI")] == [(0, 4, 4)] * 2
    assert "data" not in read_headers(spark, path).columns
    short = spark.createDataFrame([("x.png", bytearray(R.png(v, 2, parts=1)[:-20] + R.chunk(b"IEND", b"")))], "path string, content binary")
    whole = spark.createDataFrame([("x.qoi", bytearray(R.qoi(v)[:26]))], "path string, content binary")
    assert decode_images(whole, fields=["width", "status"]).first().width == 4
    assert decode_images(short).first().status == -1


def test_content_tells_the_codec_where_the_name_does_not(spark):
    v = np.arange(12).reshape(2, 2, 3)
    files = {"x": R.png(v, 2), "y.gif": R.qoi(v), "z.": R.pnm(v), "none": b"what", "w.dat": R.flat_jpeg(*[np.zeros((1, 1), int)] * 3)}
    rows = spark.createDataFrame([(k, bytearray(x)) for k, x in files.items()], "path string, content binary")
    got = {r.path: (r.status, r.codec) for r in decode_images(rows).collect()}
    assert got == {"x": (0, "png"), "y.gif": (0, "qoi"), "z.": (0, "ppm"), "none": (-1, None), "w.dat": (0, "jpeg")}


def test_headers_of_any_length(spark):
    long = b"P5\n#" + b"c" * 2000 + b"\n12 # more\n 34\n#x\n255\n"
    rows = spark.createDataFrame([(bytearray(long),), (bytearray(b"P4 7 9\n"),), (bytearray(b"P9 1 1"),), (None,)], "b binary")
    from rasterloom.functions.headers import pnm_header

    got = [tuple(r) for r in rows.select(*[v.alias(k) for k, v in pnm_header(F.col("b")).items()]).collect()]
    assert got[:3] == [(True, 12, 34, 255), (True, 7, 9, None), (False, None, None, None)]


def test_special_floats(spark):
    import struct

    from rasterloom.functions.binary import f32be, f64le

    values = [0.0, -0.0, 1.5, 5e-324, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan"), -3.4028234663852886e38]
    rows = spark.createDataFrame([(k, bytearray(struct.pack("<d", v) + struct.pack(">f", v if abs(v) < 1e39 or v - v != 0 else 0.0))) for k, v in enumerate(values)], "k int, b binary")
    for r in rows.select("k", f64le(F.col("b"), 0).alias("d"), f32be(F.col("b"), 8).alias("f")).collect():
        want = values[r.k]
        assert struct.pack("<d", r.d) == struct.pack("<d", want) or want != want and r.d != r.d
        small = struct.unpack(">f", struct.pack(">f", want if abs(want) < 1e39 or want - want != 0 else 0.0))[0]
        assert r.f == small or want != want and r.f != r.f


def test_pixels(spark, folder):
    path, v = folder
    px = to_pixels(read_images(spark, path, glob="a.png")).orderBy("y", "x", "c").collect()
    assert [r.v for r in px] == v.ravel().tolist() and (px[-1].y, px[-1].x, px[-1].c) == (3, 3, 2)


def test_data_source_and_sql_function(spark, folder):
    path, v = folder
    register(spark)
    rows = spark.read.format("rasterloom").option("filesPerPartition", "2").load(path).where("status = 0").collect()
    assert len(rows) == 3 and all(bytes(r.data) == v.astype(np.uint8).tobytes() for r in rows)
    got = spark.sql(f"SELECT decode_image(content, 'png').width AS w FROM binaryFile.`{path}/a.png`").first()
    assert got.w == 4


def test_stream(spark, folder, tmp_path):
    path, _ = folder
    query = stream_images(spark, path).select("path", "status").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_text_loaders(spark):
    data = R.pnm(np.arange(4).reshape(2, 2, 1))
    import base64

    rows = spark.createDataFrame([(1, data.hex(), base64.b64encode(data).decode(), "pgm"), (2, "zz", "?", "pgm"), (3, None, None, "pgm")], "id int, h string, b string, codec string")
    for got in (from_hex(rows, "h", "codec"), from_base64(rows, "b", "codec")):
        assert [r.status for r in got.orderBy("id").collect()] == [0, -1, -1000] or [r.status for r in got.orderBy("id").collect()] == [0, -1000, -1000]


def test_clashing_columns_nulls_and_empty(spark):
    rows = spark.createDataFrame([("x.pgm", None, 1, "k"), ("y.pgm", bytearray(b"P5 1 1 255\n\7"), 2, None)], "path string, content binary, width int, note string")
    got = {r.path: r for r in decode_images(rows).collect()}
    assert got["x.pgm"].status == -1000 and got["y.pgm"].width == 1 and got["x.pgm"].note == "k"
    assert decode_images(rows.limit(0)).count() == 0 and to_pixels(decode_images(rows.limit(0))).count() == 0


def test_chunk_relations_stop_at_damage(spark):
    png, one = R.png(np.zeros((1, 1, 1), int), 0), np.zeros((1, 1), int)
    rows = spark.createDataFrame([("a", bytearray(png)), ("b", bytearray(png[:40])), ("c", bytearray(b"no")), ("d", None)], "path string, content binary")
    assert {r.path: r.n for r in png_chunks(rows).groupBy("path").agg(F.count("*").alias("n")).collect()}["a"] == 4
    jpg = spark.createDataFrame([("a", bytearray(R.flat_jpeg(one, one, one)))], "path string, content binary")
    assert [r.marker for r in jpeg_segments(jpg).orderBy("seq").collect()] == [0xE0, 0xDB, 0xC0, 0xC4, 0xC4, 0xDA]


def test_dispatch(spark):
    names = ["png", "JPG", "jpegx", "a", "", "webp", "q9_x"]
    rows = spark.createDataFrame([(n,) for n in names], "ext string")
    assert [r.h for r in rows.select(extension_hash(F.col("ext")).alias("h")).collect()] == [plain_hash(n) for n in names]
    paths = spark.createDataFrame([("s3://a.b/c",), ("x.TGA",), ("noext",), (None,)], "path string")
    assert [r.c for r in paths.select(codec(F.col("path")).alias("c")).collect()] == [None, "tga", None, None]
    head = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\n.."),), (bytearray(b"P7 .."),), (bytearray(b""),)], "b binary")
    assert [r.s for r in head.select(sniffed(F.col("b")).alias("s")).collect()] == ["png", "pam", None]


def test_numbers_in_binaries(spark):
    b = F.col("b")
    row = spark.createDataFrame([(bytearray(b"\x01\x02\xfe\xff\xff\xff"),)], "b binary").select(
        u16be(b, 0).alias("a"), u16le(b, 0).alias("b"), u32be(b, 0).alias("c"), u32le(b, 2).alias("d"), i32le(b, 2).alias("e"), samples(b).alias("f")
    ).first()
    assert row[:5] == (0x0102, 0x0201, 0x0102FEFF, 0xFFFFFFFE, -2) and row.f == [1, 2, 254, 255, 255, 255]


def test_native_kernels_match_codecs(spark):
    from rasterloom.codecs.bmp import masked
    from rasterloom.codecs.jpeg import to_rgb

    rng = np.random.default_rng(1)
    v = rng.integers(0, 256, (500, 3))
    rows = spark.createDataFrame(pd.DataFrame(v, columns=list("abc")))
    rgb = P.ycbcr_to_rgb(F.col("a"), F.col("b"), F.col("c"))
    got = rows.select(*[c.alias(n) for c, n in zip(rgb, "rgb", strict=True)], P.masked_component(F.col("a") * 256 + F.col("b"), 0x7E0).alias("m")).toPandas()
    assert (got[["r", "g", "b"]].to_numpy() == to_rgb(v[:, 0], v[:, 1], v[:, 2])).all()
    assert (got["m"].to_numpy() == masked(v[:, 0] * 256 + v[:, 1], 0x7E0)).all()


def test_plans_prune_and_stay_native(spark, folder):
    path, _ = folder
    lean = plans.QUERIES["png_headers"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in lean and "o_totalprice" not in lean
    joined = plans.QUERIES["adam7_map"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in joined and "CartesianProduct" not in joined


@pytest.fixture(scope="module")
def several(spark):
    """Files of several formats and sizes, some of them broken, foreign or missing."""
    rng = np.random.default_rng(2)
    px = lambda k, c: rng.integers(0, 256, (k % 3 + 1, k % 4 + 1, c))
    kinds = [("png", lambda k: R.png(px(k, 3), 2)), ("qoi", lambda k: R.qoi(px(k, 4))), ("ppm", lambda k: R.pnm(px(k, 3), ascii_=True)), ("pgm", lambda k: R.pnm(px(k, 1) * 9, maxval=65535)), ("jpg", lambda k: R.flat_jpeg(*[rng.integers(-9, 9, (1, 1))] * 3))]
    files = [(f"{k}.{name}", bytearray(make(k)) if k % 9 else None if k % 2 else bytearray(make(k)[:-3])) for name, make in kinds for k in range(40)]
    return spark.createDataFrame([*files, ("x.txt", bytearray(b"text"))], "path string, content binary").repartition(3)


def test_pixels_in_one_map(several, monkeypatch):
    want = sorted(map(tuple, to_pixels(decode_images(several)).collect()))
    assert sorted(map(tuple, file_pixels(several).collect())) == want and len(want) > 1000
    wide = file_pixels(several, channels={"a": 3, "g": 1})
    long = {r[:4]: r[4] for r in want}
    assert {tuple(r[:3]): (r.a, r.g) for r in wide.collect()} == {(p, y, x): (long.get((p, y, x, 3)), long.get((p, y, x, 1))) for p, y, x, _ in long}


def test_bounded_parts_are_the_whole():
    import pyarrow as pa

    sizes = [0, 5, 30, 7, 0, 0, 90, 1]
    b = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array([None if k == 4 else b"x" * n for k, n in enumerate(sizes)], pa.binary())], ["k", "content"])
    D.CONTENT_BYTES, before = 35, D.CONTENT_BYTES
    try:
        parts = [p.column(0).to_pylist() for p in D.bounded(b.slice(1), 1)]
    finally:
        D.CONTENT_BYTES = before
    assert parts == [[1, 2], [3, 4, 5], [6], [7]]


def test_large_and_small_images_share_a_batch(monkeypatch):
    """Parts are cut by samples; what is cut comes out whole."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from rasterloom.options import ReadOptions

    monkeypatch.setattr(D, "SAMPLES", 50)
    rng = np.random.default_rng(4)
    made = [rng.integers(0, 256, (h, w, 3)) for h, w in [(2, 3)] * 30 + [(20, 30), (1, 1), (160, 120)]]
    for channels in (None, {"r": 0, "b": 2}):
        schema = D.pixel_schema(T.StructField("k", T.LongType()), channels)
        parts = list(D.pixel_batches(iter([(pa.array(range(len(made))), [R.pnm(v) for v in made], ["ppm"] * len(made))]), schema, ReadOptions(), channels))
        assert max(map(len, parts)) <= 100
        got = sorted(zip(*(sum((p.column(i).to_pylist() for p in parts), []) for i in range(5)), strict=True))
        if channels:
            assert got == [(k, y, x, v[y, x, 0], v[y, x, 2]) for k, v in enumerate(made) for y in range(v.shape[0]) for x in range(v.shape[1])]
        else:
            assert got == [(k, y, x, c, v[y, x, c]) for k, v in enumerate(made) for y in range(v.shape[0]) for x in range(v.shape[1]) for c in range(3)]


@pytest.mark.parametrize("name", ["png_color_metadata", "bmp_16_555", "jpeg_420", "bmp_565_bitfields", "bmp_32_alpha", "bmp_32_bitfields", "png_rgb_trns_key", "bmp_24", "bmp_rle4", "ppm_p6_stats", "qoi_roundtrip", "pgm_p2_pixels", "png_rgb", "jpeg_baseline_flat", "bmp_rle24", "png_metadata", "ppm_scaled_maxval", "qoi_rgba", "pam_rgb", "ppm_p3_stats"])
def test_files_are_made_and_decoded_in_one_map(spark, name):
    """No join, and no record that goes to Spark and back: a task has one worker."""
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


@pytest.mark.parametrize("name", ["jpeg_420", "png_rgb_trns_key", "jpeg_baseline_flat"])
def test_pixels_are_not_grouped_again(spark, name):
    """A pixel's channels are columns of one row, as decoded: there is nothing to sort or group by pixel."""
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == {"jpeg_420": 0}.get(name, 2)


@pytest.mark.parametrize("name, small", [("jpeg_ac", 1), ("palette_join", 0), ("upsample_nearest", 0)])
def test_relations_that_grow_are_not_broadcast(spark, name, small):
    """Only the table of the transform, 4,096 rows for any input, may go through the driver."""
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == small and "SortMergeJoin" in plan


def _canonical(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object).where(lambda d: d.notna(), None)
    fix = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(int(x) if isinstance(x, float) and x.is_integer() else fix(x) for x in r) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, con, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), con.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _canonical(got) == _canonical(want)


@pytest.fixture(scope="module")
def flat(tmp_path_factory):
    """Embeddings whose samples are all 128: no coefficient is other than zero in any block."""
    base = tmp_path_factory.mktemp("flat")
    pd.DataFrame({"vec_id": [1, 2], "embedding": [np.full(64, 0.005, np.float32), np.linspace(-1, 1, 64, dtype=np.float32)]}).to_parquet(base / "embeddings.parquet")
    return str(base)


@pytest.mark.parametrize("name", ["jpeg_idct_by_sum", "jpeg_ac", "jpeg_coefficients"])
def test_blocks_without_coefficients_have_samples(spark, flat, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{flat}/embeddings.parquet'")
    assert _canonical(plans.QUERIES[name](spark, flat).toPandas()) == _canonical(con.execute(plans.SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
