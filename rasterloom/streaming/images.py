"""Images that arrive in a folder, decoded as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.decode import decode_images
from ..options import ReadOptions

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_images(spark: SparkSession, path: str, max_files: int = 1000, glob: str | None = None, **options: object) -> DataFrame:
    """A streaming relation like sources.images.read_images: new files are decoded once each, at most max_files a batch."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", str(max_files))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return decode_images(reader.load(path), ReadOptions.parse(**options))
