"""Files by line: numbered and strict scans, shards, nested JSON, one-document reports, digests, settings, versioned tables."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_VARIABLE = re.compile(r"\$(?:\{([A-Z_][A-Z0-9_]*)\}|([A-Z_][A-Z0-9_]*))")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; without that setting a temporary folder, in one local process only."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quietlake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/files/{name}-{uuid.uuid4().hex}"


def materialised(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: what is read more than once is computed once, and a lost executor costs no more than reading."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1, blank lines counted, files in order of their names) and value.

    Only the number of lines of each stretch of a file goes over the network: a line's number is its place in its stretch plus the lines
    of the stretches before it.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select("value", at.alias("at"), F.monotonically_increasing_id().alias("id"))
    sizes = lines.groupBy("at").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("at", (before - F.col("first") + 1).alias("shift"))
    return lines.join(offsets, "at").select((F.col("id") + F.col("shift")).alias("line_no"), "value")


def read_records(spark: SparkSession, path: str, schema: str, first_lines: int | None = None, strict: bool = False) -> DataFrame:
    """line_no and the fields of every line that is not blank; ``first_lines`` limits physical lines, blank ones counted.

    A strict scan raises at a blank line or one that is no JSON object; else such a line has null fields and stands in ``bad_line``.
    """
    lines = numbered_lines(spark, path)
    if first_lines is not None:
        lines = lines.where(F.col("line_no") <= first_lines)
    record = F.from_json("value", schema)
    broken = F.try_parse_json("value").isNull() | ~F.ltrim("value").startswith("{")
    if strict:
        error = F.raise_error(F.concat(F.lit("no record in line "), F.col("line_no").cast("string")))
        return lines.select(
            "line_no",
            F.when(broken, error.cast(record_type(schema))).otherwise(record).alias("r"),
        ).select("line_no", "r.*")
    lines = lines.where(F.btrim("value", F.lit(" \t\r\n\x0b\x0c")) != "")
    return lines.select("line_no", record.alias("r"), F.when(broken, F.col("value")).alias("bad_line")).select("line_no", "r.*", "bad_line")


def record_type(schema: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).simpleString()


def write_lines(rows: DataFrame, path: str, order: list[str], line: str = "value") -> None:
    """Lines in order over files whose names follow the order: range partitions, each sorted; one line is one row of ``rows``."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(line).write.text(path)


def write_shards(spark: SparkSession, source: str, path: str, n: int) -> None:
    """Line i of the source, from 0, goes to the folder shard=(i mod n), in order."""
    lines = numbered_lines(spark, source).withColumn("shard", F.pmod(F.col("line_no") - 1, F.lit(n)))
    lines.repartitionByRange(F.col("shard"), F.col("line_no")).sortWithinPartitions("shard", "line_no").select("value", "shard").write.partitionBy("shard").text(path)


def read_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """piece (which path), line_no in it and value of all lines that are not blank, one path after the other."""
    parts = [numbered_lines(spark, p).select(F.lit(k).alias("piece"), "line_no", "value") for k, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.btrim("value", F.lit(" \t\r\n\x0b\x0c")) != "")


def write_report(row: DataFrame, path: str) -> None:
    """A table of one row as one JSON document; nulls are written."""
    row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.text(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, sha256 of every file. A file is a row, so one larger than 2 GB does not fit."""
    return spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("file"),
        F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


def walk_json(lines: DataFrame, key: str, value: str = "value") -> DataFrame:
    """key, path, name, kind, text: every object, list and string of JSON documents, at any depth.

    ``path`` is like ``$.a[0].b``; ``name`` is the nearest field name, lists hand theirs on; ``text`` is a string's value, else null. Documents that
    are no JSON give nothing. A recursion of unknown depth has no column expression, so Arrow batches are walked in Python.
    """
    import pyarrow as pa

    def visit(node, path: str, name: str) -> Iterator[tuple]:
        if isinstance(node, str):
            yield path, name, "string", node
        elif isinstance(node, dict):
            yield path, name, "object", None
            for k, child in node.items():
                yield from visit(child, f"{path}.{k}", k)
        elif isinstance(node, list):
            yield path, name, "list", None
            for i, child in enumerate(node):
                yield from visit(child, f"{path}[{i}]", name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                try:
                    own = list(visit(json.loads(text), "$", "")) if text else []
                except (ValueError, RecursionError):
                    own = []
                at += [i] * len(own)
                found += own
            if found:
                columns = [pa.array(c, pa.string()) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), *columns],
                    names=["key", "path", "name", "kind", "text"],
                )

    rows = lines.select(F.col(key).alias("key"), F.col(value).alias("value"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, path string, name string, kind string, text string")


def settings(
    text: str,
    keys: list[str],
    sections: list[tuple[str, str]],
    overrides: dict[str, str],
    environment: dict[str, str] | None = None,
) -> dict:
    """Settings from YAML, or from JSON where no YAML reader is installed.

    The named keys, and (section, key) pairs, may be a ``$NAME`` or ``${NAME}`` and then take that variable's value, empty if unset.
    ``overrides`` maps a key, or ``section.key``, to a variable that wins over the file where it is set.
    """
    environment = dict(os.environ) if environment is None else environment
    try:
        import yaml

        found = yaml.safe_load(text) or {}
    except ImportError:
        found = json.loads(text or "{}")

    def resolved(value):
        match = _VARIABLE.fullmatch(value.strip()) if isinstance(value, str) else None
        return environment.get(match[1] or match[2], "") if match else value

    places = [(found, k) for k in keys] + [(found.setdefault(s, {}), k) for s, k in sections]
    for owner, key in places:
        owner[key] = resolved(owner.get(key, ""))
    for name, variable in overrides.items():
        section, _, key = name.rpartition(".")
        if environment.get(variable):
            (found.setdefault(section, {}) if section else found)[key] = environment[variable]
    return found


class VersionedTable:
    """A table that is replaced as a whole: each save is a folder of its own and only then becomes the current one, so readers never meet a half-written table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        return sorted(int(n[2:]) for n in names if re.fullmatch(r"v-\d+", n) and self._fs.exists(self._at(f"{self.path}/{n}/_SUCCESS")))

    def read(self, schema: str | None = None) -> DataFrame:
        """The current version; an empty table by ``schema`` before the first save."""
        if not (found := self.versions()):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.path}/v-{found[-1]}")

    def save(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/v-{max(self.versions(), default=0) + 1}")
