"""Pieces that several operators share: columns on text, row keys, and tables kept between steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space between words: space, and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
SPACES_RE = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


def strip_spaces(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def space_words(text: Column) -> Column:
    """Words between white space, as an array; none for null or blank text."""
    core = strip_spaces(F.coalesce(text, F.lit("")))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SPACES_RE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two longs that name a row by its content. Rows with equal id and text share them, and so share every result that depends on the text."""
    return [F.xxhash64(F.col(doc_id)).alias("_k1"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_k2")]


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local master gets one of its own; a cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="terrane-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables written between steps, in the shared folder the cluster names; they cut the lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def path(self, name: str = "part") -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str = "part") -> DataFrame:
        """Writes df and reads it back."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that keep() returned, once nothing reads it any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(conf).delete(folder, True)
