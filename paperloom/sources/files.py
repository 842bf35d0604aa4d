"""File sources: the library scan, whole-file text, page text and page images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import NOT_WS

BINARY = "path string, modificationTime timestamp, length long, content binary"
#: Characters that a page must have more of to count as text, and pages looked at.
PAGE_CHARS, PAGES = 100, 5


def _globs(root: str, kinds: tuple[str, ...]) -> str:
    return f"{root.rstrip('/')}/*/*.{{{','.join(kinds)}}}"


def library(spark: SparkSession, root: str, kinds: tuple[str, ...] = ("pdf",), limit: int | None = None, content: bool = False) -> DataFrame:
    """Files one folder below the root: ``path, mtime, length`` (``, content``); no rows where none match.

    Contents are read only where asked for. A limit takes the first paths in order.
    """
    from pyspark.errors import AnalysisException

    columns = ["path", F.col("modificationTime").alias("mtime"), "length", *["content"] * content]
    try:
        found = spark.read.format("binaryFile").load(_globs(root, kinds))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], BINARY)
    found = found.select(*columns)
    return found if limit is None else found.orderBy("path").limit(limit)


def library_stream(spark: SparkSession, root: str, kinds: tuple[str, ...] = ("md",), files_per_trigger: int = 1000) -> DataFrame:
    """The same scan as a stream of new files, with their contents."""
    found = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", files_per_trigger).load(_globs(root, kinds))
    return found.select("path", F.col("modificationTime").alias("mtime"), "length", "content")


def file_text(content: Column) -> Column:
    """UTF-8 text of a file; malformed bytes become replacement characters."""

    @F.pandas_udf("string")
    def decode(x):
        return x.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))

    return decode(content)


def is_scanned(pages: Column) -> Column:
    """Whether none of the first pages (an array of texts) has more than ``PAGE_CHARS`` characters."""
    return ~F.exists(F.slice(pages, 1, PAGES), lambda p: F.coalesce(F.length(F.trim(p)), F.lit(0)) > PAGE_CHARS)


def join_pages(pages: Column, ocr: Column | None = None) -> Column:
    """Pages that are not blank, with an empty line between; a scanned file's short pages take the text of ``ocr``."""
    if ocr is not None:
        short = is_scanned(pages)
        pages = F.zip_with(pages, ocr, lambda p, o: F.when(short & (F.coalesce(F.length(F.trim(p)), F.lit(0)) < PAGE_CHARS), o).otherwise(p))
    return F.array_join(F.filter(pages, lambda p: p.rlike(NOT_WS)), "\n\n")


def page_images(images: DataFrame, per_page: int = 5, least: int = 100) -> DataFrame:
    """Of ``path, page, idx, width, height, ext, data``: large enough images, the first few of each page, as data URIs."""
    large = images.where((F.col("width") >= least) & (F.col("height") >= least))
    first = large.withColumn("_rn", F.row_number().over(W.partitionBy("path", "page").orderBy("idx"))).where(F.col("_rn") <= per_page)
    return first.select("path", "page", "idx", F.concat(F.lit("data:image/"), "ext", F.lit(";base64,"), F.base64("data")).alias("uri"))
