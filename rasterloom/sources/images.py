"""Reading images: folders of files, hex and base64 text, and a data source by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.decode import decode_images
from ..options import ReadOptions
from ..schema import FIELDS, HEADER, IMAGE


def read_images(
    spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = False, where: Column | str | None = None, fields: list[str] | None = None, **options: object
) -> DataFrame:
    """(path, modificationTime, length, image record) of the files: see options.ReadOptions.

    Spark moves no filter and no selection through the decoding map, so both are told here: `where`, on path,
    modificationTime and length, reaches the scan, and files that it leaves out aren't read; of the record only `fields`
    are made, and without data no samples are decoded. glob filters names. Names that tell no codec are judged by content.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    return decode_images(files if where is None else files.where(where), ReadOptions.parse(**options), fields=fields)


def read_headers(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = False, where: Column | str | None = None, **options: object) -> DataFrame:
    """(path, modificationTime, length, schema.HEADER) of the files: sizes and kinds, without decoding samples."""
    return read_images(spark, path, glob, recursive, where, HEADER.fieldNames(), **options)


def from_hex(rows: DataFrame, column: str, codec_col: str, **options: object) -> DataFrame:
    """Decodes hexadecimal text; text that isn't gives a failed row."""
    return decode_images(rows.withColumn("content", F.unhex(column)), ReadOptions.parse(**options), codec_col=codec_col)


def from_base64(rows: DataFrame, column: str, codec_col: str, **options: object) -> DataFrame:
    """Decodes base64 text; text that isn't gives a failed row."""
    return decode_images(rows.withColumn("content", F.try_to_binary(F.col(column), F.lit("base64"))), ReadOptions.parse(**options), codec_col=codec_col)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k: v for k, v in options.items() if k not in ("path", "filesperpartition")}
        self.path, self.per = options.get("path", ""), int(options.get("filesperpartition", "32"))

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        from urllib.parse import urlparse

        known = urlparse(self.path).scheme not in ("", "file")
        store, base = fs.FileSystem.from_uri(self.path) if known else (fs.LocalFileSystem(), urlparse(self.path).path)
        info = store.get_file_info(base)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        names = sorted(f.path for f in found if f.type == fs.FileType.File)
        return [_Files(names[k : k + self.per]) for k in range(0, len(names), self.per)]

    def read(self, partition: _Files):
        from pyarrow import fs

        from urllib.parse import urlparse

        from ..codecs import decode
        from ..names import codec_of

        known = urlparse(self.path).scheme not in ("", "file")
        store = fs.FileSystem.from_uri(self.path)[0] if known else fs.LocalFileSystem()
        options = ReadOptions.parse(**self.options)
        for name in partition.paths:
            with store.open_input_file(name) as f:
                got = decode(f.read(), codec_of(name), options)
            yield (name, *(_plain(got[n], IMAGE[n].dataType) for n in FIELDS))


def _plain(value, kind):
    """A record's value as the row reader takes it: sub-records in the order of their fields."""
    return tuple(value.get(n) for n in kind.fieldNames()) if isinstance(value, dict) else value


class ImageDataSource(DataSource):
    """spark.read.format("rasterloom").load(folder): files are listed once, and read by partitions of filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "rasterloom"

    def schema(self):
        from pyspark.sql import types as T

        return T.StructType([T.StructField("path", T.StringType()), *IMAGE.fields])

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Registers the data source, and decode_image(content, codec) for SQL."""
    from pyspark.sql.functions import pandas_udf

    from ..codecs import decode

    spark.dataSource.register(ImageDataSource)

    @pandas_udf(IMAGE)
    def decode_image(content, codec):
        import pandas as pd

        return pd.DataFrame([decode(c, k) for c, k in zip(content, codec, strict=True)], columns=FIELDS)

    spark.udf.register("decode_image", decode_image)
