"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts list it: space and \t \n \v \f \r.
ASCII_WS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names.

    Every operator starts with this, so further columns of the input, whatever they are called,
    never meet the operator's own.
    """
    return df.select(*[df[f"`{src}`"].alias(name) for name, src in columns.items()])


def let(value: Column, body) -> Column:
    """Binds an expression once: ``body`` may use it many times without evaluating it again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is read from ``spark.checkpoint.dir``. Only where that is unset and Spark runs in this one process, as in
    tests, a temporary folder is made and set; a cluster without that setting raises ValueError.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.sparkContext.getCheckpointDir()
        if not where and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = where.rsplit("/", 1)[0] if where else "file://" + tempfile.mkdtemp(prefix="quietlake-")
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder; it is not created."""
    return f"{shared_dir(spark)}/quietlake/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes a table in the shared folder and reads it back: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = new_dir(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(name: str) -> int:
    """The number at the end of a part's name, to sort parts by; as text, part-100000 would stand before part-99999."""
    return int(name.rsplit("-", 1)[1])


def drop_written(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class SharedFiles:
    """Plain files below a shared URI, from the driver or a Python worker.

    ``file:`` and bare paths use the operating system, so readers can map the files; other schemes
    go through ``pyarrow.fs``, which needs that store's client library.
    """

    def __init__(self, uri: str):
        self.uri = uri
        scheme, _, rest = uri.partition("://")
        self.local = not rest or scheme == "file"
        if self.local:
            self.root = rest or uri
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(uri)

    def write(self, name: str, chunks) -> int:
        """Writes the chunks under a name of this attempt, then renames: a task that runs again or twice leaves one whole file."""
        size, temp = 0, f"{self.root}/.{name}.{uuid.uuid4().hex}"
        if self.local:
            os.makedirs(self.root, exist_ok=True)
            out = open(temp, "wb")
        else:
            self.fs.create_dir(self.root, recursive=True)
            out = self.fs.open_output_stream(temp)
        with out:
            for chunk in chunks:
                out.write(chunk)
                size += len(chunk)
        if self.local:
            os.replace(temp, f"{self.root}/{name}")
        else:
            self.fs.move(temp, f"{self.root}/{name}")
        return size

    def open(self, name: str):
        if self.local:
            return open(f"{self.root}/{name}", "rb")
        return self.fs.open_input_file(f"{self.root}/{name}")

    def read_range(self, name: str, start: int, length: int) -> bytes:
        with self.open(name) as f:
            f.seek(start)
            return f.read(length)
