"""Best-fit packing of documents into fixed-length training sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, read_table, written
from .tokens import chunks, id_encoder, ranks_prove, tokenizer_path


class OpenBins:
    """Bounded-space online best-fit.

    Open bins are kept by their free space: one stack per size, and a bitset in which bit f is set
    while some bin has f free places. The best fit for n is the lowest set bit from n up; when more
    than ``bound`` bins are open, the fullest one closes, which is the lowest set bit of all.
    """

    def __init__(self, capacity: int, bound: int):
        self.capacity, self.bound = capacity, bound
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.n_open = self.n_bins = 0
        #: Numbers of the bins that have closed; who reads them clears them.
        self.closed: list[int] = []

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """Bin number and offset for a piece of 1 to capacity tokens."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.n_bins
            self.n_bins += 1
        if left := free - length:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.n_open += 1
            if self.n_open > self.bound:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
        else:
            self.closed.append(number)
        return number, self.capacity - free


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones of ``capacity``, the first takes what is left over."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


_PIECE = (pa.int32(), *[pa.int64()] * 3)
_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


class Packer:
    """Packs pieces (key, piece, start, length, crc) as they come and gives those of a bin when it closes, so it holds the open bins' pieces alone."""

    def __init__(self, capacity: int, bound: int, base: int, done: int):
        self.bins, self.base, self.least = OpenBins(capacity, bound), base, capacity - done
        self.held: dict[int, list[tuple]] = {}
        self.fill: dict[int, int] = {}

    def place(self, pieces: list[tuple]) -> list[tuple]:
        """Places some pieces, the longest first; gives the rows of the bins that closed."""
        out: list[tuple] = []
        for piece in sorted(pieces, key=lambda r: -r[3]):
            number, offset = self.bins.place(piece[3])
            self.held.setdefault(number, []).append((*piece, offset))
            self.fill[number] = offset + piece[3]
            for closed in self.bins.closed:
                out += self.rows(closed)
            self.bins.closed.clear()
        return out

    def rows(self, number: int) -> list[tuple]:
        """A bin's rows; those of a bin with room left have no sequence."""
        fill = self.fill.pop(number)
        name = self.base + number if fill >= self.least else None
        return [(*piece, name, offset) for *piece, offset in self.held.pop(number)]

    def rest(self) -> list[tuple]:
        return [r for number in list(self.held) for r in self.rows(number)]


def _batches(rows: list[tuple], key: pa.DataType) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 20_000):
        columns = zip(*rows[i : i + 20_000], strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (key, *_PIECE, pa.int64(), pa.int64()), strict=True)],
            names=_NAMES,
        )


def pack(
    documents: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 0,
    capacity: int = 2048,
    open_bins: int = 8192,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row per piece.

    First each input partition packs its own documents as they stream by: no shuffle, and a state of ``open_bins`` bins whatever the
    partition's size. Within an Arrow batch longer pieces are placed first. Bins that end with under 1/256 of room are sequences. The
    pieces of all others, which are narrow rows in a table by then, are dealt over as many tasks as ``open_bins`` sequences each
    ask for and packed again, the longest first, so how the input was cut into partitions leaves at most a few part-full
    sequences for each of those tasks. Sequence ids are a task's number and a running number; the lowest bits tell the two packings apart.

    A null text is an empty document: its end id alone. Very long texts are cut; an empty table gives no rows. Ids may be null or
    repeated, and repeated rows are packed each. Further columns are ignored.
    """
    path = tokenizer_path(tokenizer)
    by_rank = ranks_prove(path)
    end, spark = end_id.to_bytes(4, "little"), documents.sparkSession
    rows = only(documents, doc_id=doc_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, packer, key = id_encoder(path, by_rank), Packer(
            capacity,
            open_bins,
            TaskContext.get().partitionId() << 41,
            capacity // 256,
        ), None
        for whole in batches:
            key, pieces = whole.schema.field(0).type, []
            for batch in chunks(iter([whole])):
                for name, ids in zip(
                    batch.column(0).to_pylist(),
                    encoder.encode(t or "" for t in batch.column(1).to_pylist()),
                    strict=True,
                ):
                    ids += end
                    for i, (start, length) in enumerate(cut_pieces(len(ids) // 4, capacity)):
                        pieces.append((name, i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            yield from _batches(packer.place(pieces), key)
        if key is not None:
            yield from _batches(packer.rest(), key)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, key = Packer(capacity, 2 * open_bins, (TaskContext.get().partitionId() << 41) + (1 << 40), capacity), None
        for batch in batches:
            key = batch.schema.field(0).type
            yield from _batches(packer.place(list(zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True))), key)
        if key is not None:
            yield from _batches(packer.rest(), key)

    placed = written(rows.mapInArrow(first, schema), "pieces")
    loose = placed.where("sequence_id IS NULL")
    tokens = loose.agg(F.sum("length")).first()[0] or 0
    dealt = loose.repartition(max(1, -(-tokens // (capacity * open_bins)))).sortWithinPartitions(F.desc("length"))
    return placed.where("sequence_id IS NOT NULL").union(dealt.mapInArrow(again, schema))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
