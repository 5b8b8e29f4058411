"""Decoding a relation of files, and the relations that follow from it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..codecs.jpeg import BASIS, BASIS_BITS, ZIGZAG, coefficients, segments
from ..codecs.many import decode_many
from ..codecs.png import ADAM7, chunks
from ..functions.dispatch import codec, sniffed
from ..options import ReadOptions
from ..schema import FIELDS, IMAGE, ImageError

#: Decoded bytes that are held before a batch is handed on: a row may be megabytes.
BATCH_BYTES = 32 << 20
#: Bytes of files that are decoded together at most.
CONTENT_BYTES = 16 << 20
#: Samples of a batch of pixels.
SAMPLES = 1 << 18


#: Fields of the record that need samples.
SAMPLED = ("data", "len")


def decode_images(files: DataFrame, options: ReadOptions | None = None, content: str = "content", codec_col: str | None = None, path: str = "path", fields: list[str] | None = None) -> DataFrame:
    """Adds the image record (schema.IMAGE), or those of its fields that are named, to files; content goes. Rows that can't
    be decoded have a status and reason.

    The codec comes from codec_col, or else from the path's extension; where neither names one, from the content's first
    bytes. Without fields that need samples none are decoded, so damage behind the header shows no status. A column of
    files with the name of a field is replaced. One map, no shuffle; batches stay small however large the images are.
    """
    options = options or ReadOptions()
    fields = FIELDS if fields is None else [n for n in FIELDS if n in fields]
    if not set(SAMPLED) & set(fields) and not options.header_only:
        options = replace(options, open_intent="readonly_header")
    kept = [c for c in files.columns if c != content and c not in FIELDS]
    named = F.coalesce(F.col(codec_col) if codec_col else codec(F.col(path)), sniffed(F.col(content)))
    source = files.select(*kept, F.col(content).alias("_content"), named.alias("_codec"))
    record = T.StructType([IMAGE[n] for n in fields])
    schema = T.StructType([*files.select(*kept).schema.fields, *record.fields])
    types = [f.type for f in to_arrow_schema(record)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in bounded(whole, len(kept))):
            own = b.select(range(len(kept)))
            for places, columns in record_columns(b.column(len(kept)).to_pylist(), b.column(len(kept) + 1).to_pylist(), options, fields):
                made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*own.take(pa.array(places)).columns, *made], [*kept, *fields])

    return source.mapInArrow(run, schema)


def bounded(b: pa.RecordBatch, content: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices, each of CONTENT_BYTES of its column of contents at most, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(content)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(b):
        end = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CONTENT_BYTES, "right")))
        yield b.slice(first, end - first)
        first = end


def record_columns(files: list[bytes | None], codecs: list[str | None], options: ReadOptions, fields: list[str]) -> Iterator[tuple[list[int], list[list]]]:
    """The places of files and a list of values for each field, a bounded part of the files at a time, each part in order."""
    held, places, columns = 0, [], [[] for _ in fields]

    def part() -> tuple[list[int], list[list]]:
        order = np.argsort(places).tolist()
        return [places[k] for k in order], [[c[k] for k in order] for c in columns]

    for own, shared, differing in decode_many(files, codecs, options):
        places.extend(own)
        for name, column in zip(fields, columns, strict=True):
            values = differing.get(name)
            column.extend([shared[name]] * len(own) if values is None else [v.tobytes() for v in values] if isinstance(values, np.ndarray) else values)
        held += len(own) * (len(shared["data"] or b"") + 1000)
        if held > BATCH_BYTES:
            yield part()
            held, places, columns = 0, [], [[] for _ in fields]
    if places:
        yield part()


#: A batch of files in a map: an array of keys, contents, and the names of codecs.
Files = tuple[pa.Array, list[bytes | None], list[str | None]]


def pixel_schema(key: T.StructField, channels: dict[str, int] | None) -> T.StructType:
    names = ["y", "x", *(["c", "v"] if channels is None else channels)]
    return T.StructType([T.StructField(key.name, key.dataType), *[T.StructField(n, T.IntegerType()) for n in names]])


def pixel_batches(batches: Iterator[Files], schema: T.StructType, options: ReadOptions, channels: dict[str, int] | None) -> Iterator[pa.RecordBatch]:
    """The relation of file_pixels, in the map: samples of many small images make a batch, a large one is cut into several."""
    names = schema.fieldNames()
    for keys, files, codecs in batches:
        held: list[tuple] = []
        n = 0

        def batch() -> pa.RecordBatch:
            own, *numbers = zip(*held, strict=True)
            rows = [len(x) for x in own]
            made = [pa.array(np.concatenate([np.zeros(k, np.int32) if x is None else x for x, k in zip(c, rows, strict=True)]), mask=np.concatenate([np.full(k, x is None) for x, k in zip(c, rows, strict=True)]) if any(x is None for x in c) else None) for c in numbers]
            return pa.RecordBatch.from_arrays([keys.take(pa.array(np.concatenate(own))), *made], names)

        for places, shared, differing in decode_many(files, codecs, options):
            data = differing.get("data", [shared["data"]] * len(places))
            if shared["status"] or data[0] is None:
                continue
            width, height, pad, size = shared["width"], shared["height"], shared["row_pad"], 2 if shared["bits_per_component"] == 16 else 1
            comps = shared["components"] or 1
            row = width * comps * size
            if len(data[0]) != (row + pad) * height:
                continue
            v = data if isinstance(data, np.ndarray) else np.frombuffer(b"".join(data), np.uint8)
            v = v.reshape(len(places), height, row + pad)[:, :, :row]
            if size == 2:
                v = np.ascontiguousarray(v).view("<u2" if shared["byte_order"] in (0, 1) else ">u2")
            v = v.reshape(len(places), -1) if channels is None else v.reshape(len(places), -1, comps)
            here, per = np.array(places), v.shape[1]
            images, part = max(1, SAMPLES // (per * (1 if channels is None else comps))), SAMPLES // (1 if channels is None else comps) or 1
            for i in range(0, len(here), images):
                for j in range(0, per, part):
                    some = v[i : i + images, j : j + part].astype(np.int32)
                    at = np.arange(j, j + some.shape[1], dtype=np.int32)
                    times = len(some)
                    if channels is None:
                        numbers = [np.tile(at // (width * comps), times), np.tile(at // comps % width, times), np.tile(at % comps, times), some.ravel()]
                    else:
                        numbers = [np.tile(at // width, times), np.tile(at % width, times), *(some[:, :, c].ravel() if c < comps else None for c in channels.values())]
                    held.append((np.repeat(here[i : i + images], some.shape[1]), *numbers))
                    n += some.size
                    if n >= SAMPLES:
                        yield batch()
                        held, n = [], 0
        if held:
            yield batch()


def file_pixels(files: DataFrame, options: ReadOptions | None = None, key: str = "path", content: str = "content", codec_col: str | None = None, channels: dict[str, int] | None = None) -> DataFrame:
    """to_pixels(decode_images(files)) in one map: samples aren't handed to Spark and back as records. channels: (key, y, x,
    names), a row a pixel with a column for each of these channels, null where the image has no such channel."""
    named = F.coalesce(F.col(codec_col) if codec_col else codec(F.col("path")), sniffed(F.col(content)))
    schema = pixel_schema(files.schema[key], channels)
    own = options or ReadOptions()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pixel_batches(((b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()) for whole in batches for b in bounded(whole, 1)), schema, own, channels)

    return files.select(F.col(key).alias(key), F.col(content).alias("_content"), named.alias("_codec")).mapInArrow(run, schema)


def to_pixels(images: DataFrame, key: str = "path") -> DataFrame:
    """(key, y, x, c, v) of decoded images: a row a sample, row padding left out, 16-bit samples as one number. Images
    whose samples are packed below 8 bits or that failed give no rows."""
    kind = images.schema[key].dataType
    rows = images.where("status = 0 and data is not null").select(key, "data", "width", "height", "components", "bits_per_component", "row_pad", "byte_order")
    schema = T.StructType([T.StructField(key, kind), *[T.StructField(n, T.IntegerType()) for n in "yxcv"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Samples of many small images make a batch; a large one is cut into several.
            held: list[tuple[np.ndarray, ...]] = []
            n = 0

            def batch() -> pa.RecordBatch:
                own, *numbers = (np.concatenate(x) for x in zip(*held, strict=True))
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), *(pa.array(x, pa.int32()) for x in numbers)], [key, *"yxcv"])

            for k, fields in enumerate(zip(*(b.column(i).to_pylist() for i in range(2, 8)), strict=True)):
                width, height, comps, depth, pad, order = fields
                data = b.column(1)[k].as_buffer()
                comps = comps or 1
                size = 2 if depth == 16 else 1
                row = width * comps * size
                if len(data) != (row + pad) * height:
                    continue
                v = np.frombuffer(data, np.uint8).reshape(height, row + pad)[:, :row]
                if size == 2:
                    v = np.ascontiguousarray(v).view("<u2" if order in (0, 1) else ">u2")
                v = v.reshape(-1).astype(np.int32)
                for i in range(0, len(v), SAMPLES):
                    part = v[i : i + SAMPLES]
                    at = np.arange(i, i + len(part))
                    held.append((np.full(len(part), k), at // (width * comps), at // comps % width, at % comps, part))
                    n += len(part)
                    if n >= SAMPLES:
                        yield batch()
                        held, n = [], 0
            if held:
                yield batch()

    return rows.mapInArrow(run, schema)


def sorted_join(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """A join of two relations that both grow with the input. Spark takes what a map or an explosion makes to be as large as
    what it gets, and would broadcast a side many times larger through the driver; so it is told to sort and merge."""
    return left.join(right.hint("merge"), on)


def _exploded(files: DataFrame, key: str, content: str, parts, names: list[str], types: list[str]) -> DataFrame:
    schema = T.StructType([files.schema[key], *T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    for row in parts(bytes(data or b"")):
                        rows.append(dict(zip([key, *names], (own, *row), strict=True)))
                except ImageError:
                    pass  # what comes before the damage
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.select(key, content).mapInArrow(run, schema)


def png_chunks(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, seq, type, len, data) of PNG files, as far as they are sound."""
    parts = lambda data: ((k, t.decode("latin-1"), len(d), d) for k, (t, d) in enumerate(chunks(data)))
    return _exploded(files, key, content, parts, ["seq", "type", "len", "data"], ["int", "string", "int", "binary"])


def jpeg_segments(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, seq, marker, len, data) of JPEG files, up to the first scan."""
    parts = lambda data: ((k, m, len(d), d) for k, (m, _, d) in enumerate(segments(data)))
    return _exploded(files, key, content, parts, ["seq", "marker", "len", "data"], ["int", "int", "int", "binary"])


def jpeg_coefficients(files: DataFrame, key: str = "path", content: str = "content", every_block: bool = False) -> DataFrame:
    """(key, component, block, pos, value) of baseline JPEG files: the coefficients that aren't zero, dequantised, prediction
    undone. Blocks are numbered in the order of the scan, pos is the place in the block, row by row. every_block: the first
    coefficient is there even if it is zero, so a block without others has a row too."""

    def parts(data: bytes) -> Iterator[tuple]:
        for c, (blocks, _) in enumerate(coefficients(data)):
            there = blocks != 0
            there[:, 0] |= every_block
            block, pos = np.nonzero(there)
            yield from zip([c] * len(block), block.tolist(), pos.tolist(), blocks[block, pos].tolist(), strict=True)

    return _exploded(files, key, content, parts, ["component", "block", "pos", "value"], ["int", "int", "int", "int"])


def inverse_dct_by_sum(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x, v): the samples of blocks of coefficients (keys, pos, value), by the definition: sums over the
    coefficients of value times basis, a table of 4,096 rows in fixed point. Rounded, shifted by 128, and clamped. A block
    without any row has no samples: values should have every block (jpeg_coefficients with every_block)."""
    table = values.sparkSession.createDataFrame([(p, x, int(BASIS[p, x])) for p in range(64) for x in range(64)], "pos int, at int, basis long")
    sums = values.join(F.broadcast(table), "pos").groupBy(*keys, "at").agg(F.sum(F.col("value") * F.col("basis")).alias("s"))
    level = F.shiftright(F.col("s") + (1 << (BASIS_BITS - 1)), BASIS_BITS) + 128
    return sums.select(*keys, F.floor(F.col("at") / 8).cast("int").alias("y"), (F.col("at") % 8).alias("x"), F.greatest(F.least(level, F.lit(255)), F.lit(0)).cast("int").alias("v"))


def palette_rows(images: DataFrame, key: str = "path") -> DataFrame:
    """(key, idx, r, g, b, a) of images with a palette of three bytes an entry."""
    at = F.posexplode(F.sequence(F.lit(0), F.col("palette.count") - 1)).alias("idx", "entry")
    byte = lambda k: F.conv(F.hex(F.substring(F.col("palette.bytes"), F.col("entry") * 3 + 1 + k, F.lit(1))), 16, 10).cast("int")
    alpha = F.coalesce(F.conv(F.hex(F.substring(F.col("trns.alpha"), F.col("entry") + 1, F.lit(1))), 16, 10).cast("int"), F.lit(255))
    rows = images.where("palette.count > 0").select(key, "palette", "trns", at)
    return rows.select(key, "idx", byte(0).alias("r"), byte(1).alias("g"), byte(2).alias("b"), alpha.alias("a"))


def expand_palette(indexes: DataFrame, palette: DataFrame, key: str = "path") -> DataFrame:
    """Joins indexes (key, y, x, v) with palette rows; an index beyond the palette gives no row."""
    return sorted_join(indexes, palette, (indexes[key] == palette[key]) & (indexes["v"] == palette["idx"])).select(indexes[key], "y", "x", "r", "g", "b", "a")


def adam7_table(spark) -> DataFrame:
    """(pass, xs, ys, dx, dy): seven rows."""
    return spark.createDataFrame([(k, *p) for k, p in enumerate(ADAM7)], "pass int, xs int, ys int, dx int, dy int")


def deinterlaced(pass_pixels: DataFrame, spark) -> DataFrame:
    """Places (pass, px, py, ...) of Adam7 passes in the image: adds x and y. The table has seven rows, so it is broadcast."""
    joined = pass_pixels.join(F.broadcast(adam7_table(spark)), "pass")
    return joined.withColumns({"x": F.col("px") * F.col("dx") + F.col("xs"), "y": F.col("py") * F.col("dy") + F.col("ys")}).drop("xs", "ys", "dx", "dy")


def zigzag_table(spark) -> DataFrame:
    """(k, pos): the place in the block of the k-th coefficient; 64 rows."""
    return spark.createDataFrame([(k, int(p)) for k, p in enumerate(ZIGZAG)], "k int, pos int")


def unfilter_sub(raw: DataFrame, keys: list[str], bpp: int) -> DataFrame:
    """Undoes PNG's SUB filter on (keys, x, raw): a running sum of each channel, modulo 256."""
    w = Window.partitionBy(*keys, F.col("x") % bpp).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("v", (F.sum("raw").over(w) % 256).cast("int"))


def unfilter_up(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Undoes PNG's UP filter on (keys, y, x, raw) where all rows have it."""
    w = Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("v", (F.sum("raw").over(w) % 256).cast("int"))


def dc_prediction(blocks: DataFrame, keys: list[str], order: str, diff: str = "diff") -> DataFrame:
    """Adds dc: the running sum of differences in scan order."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("dc", F.sum(diff).over(w))


def upsampled(plane: DataFrame, grid: DataFrame, key: str, factor_x: tuple[int, int], factor_y: tuple[int, int]) -> DataFrame:
    """Nearest-neighbour samples of plane (key, y, x, v) for grid (key, y, x); a factor is (component, largest)."""
    source = plane.withColumnsRenamed({"y": "sy", "x": "sx"})
    at = grid.withColumns({"sx": F.floor(F.col("x") * factor_x[0] / factor_x[1]).cast("int"), "sy": F.floor(F.col("y") * factor_y[0] / factor_y[1]).cast("int")})
    return sorted_join(at, source, [key, "sy", "sx"]).select(key, "y", "x", "v")
