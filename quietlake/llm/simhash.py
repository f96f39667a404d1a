"""SimHash near-duplicate groups by multi-index hashing.

A 64-bit fingerprint is read as two segments of 32 bits. Fingerprints that differ in at most two
bits differ in at most one bit of some segment, so each one enumerates the Hamming ball of radius one
around each of its segments, fetches what the segment table holds there, and verifies the complete distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import only, read_table, written
from .graph import components

#: Different fingerprints in a segment's bucket beyond which its members are linked through shared
#: neighbours instead of pairs; both ways find the same links.
BUCKET = 48


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash of the words of a text; zero where it has none."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] - 1 if len(words) >= shingle else ends[-1:] - 1
    digest = xxhash.xxh64_intdigest
    out = np.zeros(64, np.int64)
    first, last = starts[:n].tolist(), last.tolist()
    for i in range(0, n, 65_536):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(first[i : i + 65_536], last[i : i + 65_536], strict=True)], np.uint64)
        out += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * out > n, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, shingle: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit integer) and the text's MD5; one row per input row, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            texts = batch.column(1).to_pylist()
            fp = np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)
            digests = [hashlib.md5((t or "").encode("utf-8", "replace")).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fp), pa.array(digests, pa.binary())],
                names=["doc_id", "fp", "digest"],
            )

    rows = only(documents, doc_id=doc_id, text=text)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long, digest binary")


def _segments(fps: DataFrame) -> DataFrame:
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    pair = F.array(
        F.struct(F.lit(0).alias("seg"), low.alias("val")),
        F.struct(F.lit(1).alias("seg"), F.shiftrightunsigned("fp", 32).alias("val")),
    )
    return fps.select("fp", F.inline(pair))


def _probes(table: DataFrame) -> DataFrame:
    """The ball of radius one around each segment, halved: of two values that differ in one bit, the one that has it set clears it."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    is_set = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("val").bitwiseAND(bit(i)) != 0)
    cleared = F.transform(is_set, lambda i: F.col("val").bitwiseXOR(bit(i)))
    return table.select("fp", "seg", F.explode(F.concat(F.array("val"), cleared)).alias("val"))


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between different fingerprints, enough to connect all that differ in two bits or fewer.

    ``fps`` has distinct values in column fp. Buckets of up to ``BUCKET`` members are verified pair by
    pair. What probes a larger bucket is linked exactly without pairs: two values are within two bits
    just if some value is within one bit of both, so each lists its 65 values of the full ball of radius one, and
    all that list the same value, 65 at most, are linked to the smallest of them. Both sides of the joins grow with
    the corpus, so they are merge joins at every size.
    """
    table = _segments(fps)
    sizes = table.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n"))
    probes = _probes(table)
    matched = probes.join(sizes.hint("merge"), ["seg", "val"])
    hot = matched.where(F.col("n") > BUCKET).select("fp").distinct()
    cold = matched.where(F.col("n") <= BUCKET).select("seg", "val", F.col("fp").alias("a"))
    far = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = cold.join(
        table.select("seg", "val", F.col("fp").alias("b")).hint("merge"),
        ["seg", "val"],
    ).where((F.col("a") != F.col("b")) & (far <= 2)).select("a", "b")
    ball = F.concat(
        F.array("fp"),
        F.transform(
            F.sequence(F.lit(0), F.lit(63)),
            lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)),
        ),
    )
    near = hot.select("fp", F.explode(ball).alias("mid")).withColumn("least", F.min("fp").over(Window.partitionBy("mid")))
    return pairs.union(near.where(F.col("fp") != F.col("least")).select("fp", "least"))


def group(documents: DataFrame, shingle: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, digest, component_id (the smallest document id reachable over links of at most two bits), component_fp.

    Fingerprints are reduced to different ones before any search, so copies cost nothing. Null and
    wordless texts have fingerprint zero and are linked like any other. Null ids get a component as well but
    never name one, unless all ids of the component are null. Repeated rows stay; further columns are ignored.
    """
    fps = written(fingerprints(documents, shingle, seed, doc_id, text), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("root"))
    parts = components(links(nodes.select("fp")))
    linked = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left")
    least = linked.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("root").alias("least"))
    names = linked.join(least, "component", "left").select(
        "fp",
        F.coalesce("least", "root").alias("component_id"),
        F.coalesce("component", "fp").alias("component_fp"),
    )
    return fps.join(names.hint("merge"), "fp").select("doc_id", "fp", "digest", "component_id", "component_fp")


def one_each(documents: DataFrame, groups: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows, all columns, less all but one document of each group; ``groups`` has doc_id, digest, component_id, component.

    The document with the group's smallest id stays. Where rows share that id, the one whose text has the smallest MD5 does; rows
    without id stay only in groups without any id, once for each group.
    """
    own = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    name = lambda key, digest: F.concat(F.coalesce(key.cast("string"), F.lit("-")), F.lit(":"), F.hex(digest))
    best = own.groupBy("component").agg(F.min("digest").alias("digest"), F.min("doc_id").alias("doc_id"))
    winners = best.select(name(F.col("doc_id"), F.col("digest")).alias("name"))
    digest = F.unhex(F.md5(F.coalesce(documents[f"`{text}`"], F.lit("")).cast("binary")))
    rows = documents.select(
        F.struct("*").alias("row"),
        name(documents[f"`{doc_id}`"], digest).alias("name"),
    ).join(winners, "name", "left_semi")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("name"))).where("n = 1").select("row.*")


def keep_one(documents: DataFrame, shingle: int = 5, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group that ``group`` finds."""
    return one_each(documents, group(documents, shingle, seed, doc_id, text).withColumnRenamed("component_fp", "component"), doc_id, text)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = group(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
