"""Flat token-id files with document offsets, written and read in parallel.

Format, one folder per dataset:

* ``part-NNNNN.ids``: the token ids of the part's documents, end ids included, as little-endian
  unsigned integers of 2 or 4 bytes (2 where the vocabulary fits), nothing else.
* ``part-NNNNN.idx``: for its n documents n+1 little-endian 64-bit offsets, counted in ids from
  the part's beginning, then n little-endian 64-bit document ids, then n bytes that are 1 where the
  document id is null.
* ``manifest.json``: id width, and per part its numbers of documents and ids and the base, that is the
  ids in all parts before; bases are prefix sums over parts, so writers need no common counter.

Parts follow one another in ascending document id.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SharedFiles, new_dir, numbered, only, read_table
from .tokens import chunks, id_encoder, ranks_prove, tokenizer_path


def write_token_files(
    documents: DataFrame,
    path: str,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    partitions: int | None = None,
) -> list[dict]:
    """Writes the dataset below ``path`` and returns the manifest's parts.

    Documents are range-partitioned and sorted by id before they are encoded, so each is encoded once. The
    driver gets one row per part, and parts follow one another by number, of however many digits. A null text is an empty document; rows with null ids come first; repeated ids stay
    together in order of their texts. An empty table gives a manifest without documents.
    """
    spark = documents.sparkSession
    vocabulary = tokenizer_path(tokenizer)
    by_rank = ranks_prove(vocabulary)
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(vocabulary).get_vocab_size(), end_id + 1)
    width = 2 if size <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        encoder, files = id_encoder(vocabulary, by_rank), SharedFiles(path)
        name = f"part-{TaskContext.get().partitionId():05d}"
        keys, lengths, end = [], [0], end_id.to_bytes(4, "little")

        def ids():
            for batch in chunks(batches):
                keys.extend(batch.column(0).to_pylist())
                for x in encoder.encode(t or "" for t in batch.column(1).to_pylist()):
                    x = np.frombuffer(x + end, "<u4")
                    lengths.append(len(x))
                    yield x.astype(f"<u{width}").tobytes()

        files.write(f"{name}.ids", ids())
        offsets = np.cumsum(np.asarray(lengths, "<i8"))
        files.write(
            f"{name}.idx",
            [offsets.astype("<i8").tobytes(), np.asarray([k or 0 for k in keys], "<i8").tobytes(), bytes(k is None for k in keys)],
        )
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([name]), "n_docs": pa.array([len(keys)], pa.int64()), "n_ids": pa.array([int(offsets[-1])], pa.int64())}
        )

    rows = only(documents, doc_id=doc_id, text=text)
    ordered = rows.repartitionByRange(
        *[x for x in [partitions] if x],
        F.col("doc_id").asc_nulls_first(),
    ).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    parts, base = [], 0
    for row in sorted(ordered.mapInArrow(run, "part string, n_docs long, n_ids long").collect(), key=lambda r: numbered(r.part)):
        parts.append(row.asDict() | {"base": base})
        base += row.n_ids
    SharedFiles(path).write("manifest.json", [json.dumps({"width": width, "parts": parts}).encode()])
    return parts


class TokenReader:
    """Random access to one part; on a file system of this machine the files are mapped, not read."""

    def __init__(self, path: str, part: str, n_docs: int, width: int):
        import numpy as np

        files = SharedFiles(path)
        if files.local:
            index = np.memmap(f"{files.root}/{part}.idx", dtype="u1", mode="r")
            self.ids = np.memmap(f"{files.root}/{part}.ids", dtype=f"<u{width}", mode="r")
        else:
            with files.open(f"{part}.idx") as f, files.open(f"{part}.ids") as g:
                index, self.ids = np.frombuffer(f.read(), "u1"), np.frombuffer(g.read(), f"<u{width}")
        self.offsets = index[: 8 * (n_docs + 1)].view("<i8")
        self.keys = index[8 * (n_docs + 1) : 8 * (2 * n_docs + 1)].view("<i8")
        self.null = index[8 * (2 * n_docs + 1) :]

    def __getitem__(self, i: int):
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    with SharedFiles(path).open("manifest.json") as f:
        manifest = json.loads(f.read())
    width = manifest["width"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                if not part["n_docs"]:
                    continue
                r = TokenReader(path, part["part"], part["n_docs"], width)
                for a in range(0, part["n_docs"], 10_000):
                    b = min(a + 10_000, part["n_docs"])
                    crc = [zlib.crc32(r[i].astype("<u4").tobytes()) for i in range(a, b)]
                    keys = pa.array(r.keys[a:b].tolist(), pa.int64(), mask=r.null[a:b].astype(bool))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": keys,
                            "start": pa.array(r.offsets[a:b] + part["base"], pa.int64()),
                            "n_tokens": pa.array(r.offsets[a + 1 : b + 1] - r.offsets[a:b], pa.int64()),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )

    rows = [(p["part"], p["n_docs"], p["n_ids"], p["base"]) for p in manifest["parts"]]
    parts = spark.createDataFrame(rows, "part string, n_docs long, n_ids long, base long")
    return parts.repartition(max(1, len(rows)), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "token-files")
    write_token_files(read_table(spark, sf_dir, "documents"), path, tokenizer="word_bpe_49k.json", end_id=2)
    return read_token_files(spark, path)
