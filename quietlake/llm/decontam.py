"""Benchmark decontamination by latent semantic retrieval.

The corpus is tokenised once: of every text, the places of the benchmark's words go to a table, from which all that follows is
counted. Passages are overlapping windows of a text's words. Their TF-IDF vectors over the items' rarest words get a low-rank
basis by a distributed randomised SVD; passages near an item in that space are candidates. A candidate
counts where a longest common subsequence shows most of the item's words in order and the item's answer words are there too, so
verbatim copies and paraphrases are found while texts that merely share words are not.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, new_dir, only, read_table, written

WINDOW, STRIDE = 64, 32
#: So many of an item's words, those of least document frequency, stand for each ``WINDOW`` words of it in the space, and as its answer where none is given.
RAREST = 12
#: Benchmark items of a round; each round searches the table of all documents' hits.
BLOCK_ITEMS = 256
#: Different words of the benchmark that one scan of the documents looks for, which bounds what the driver and the workers hold.
VOCABULARY = 200_000
COSINE, LCS_SHARE = 0.25, 0.6
#: Shares of the answer's words that must stand in the passage: of a given answer, and of the rarest words that stand for one.
ANSWER_SHARE, STAND_IN_SHARE = 0.5, 1 / 3
_OVERSAMPLE = 64
_FIXED = float(1 << 24)
#: Hits that a worker handles at once.
_HITS = 1 << 19
#: ASCII bytes other than letters and digits part words; so do Unicode's general punctuation and no-break spaces.
_FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_MARKS = re.compile(rb"\xe2[\x80\x81].|\xe3\x80[\x80-\x9f]|\xc2[\xa0-\xbf]", re.DOTALL)


def words_of(text: str | None) -> list[bytes]:
    data = (text or "").lower().encode("utf-8", "replace")
    if b"\xe2" in data or b"\xe3\x80" in data or b"\xc2" in data:
        data = _MARKS.sub(b" ", data)
    return data.translate(_FOLD).split()


def _rows(item: list) -> dict:
    at: dict = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    return at


def _common(at: dict, n: int, b) -> int:
    full = (1 << n) - 1
    row = full
    for w in b:
        if m := at.get(w):
            u = row & m
            row = (row + u | row - u) & full
    return n - row.bit_count()


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence by one machine-word-parallel row per word of b."""
    return _common(_rows(a), len(a), b)


def verify(item: list, answer: list, passage: list) -> tuple[float, float]:
    """Share of the item's words in the common subsequence with the passage, and of its answer words in the passage."""
    return lcs_length(item, passage) / max(1, len(item)), len(set(answer) & set(passage)) / max(1, len(set(answer)))


@dataclass
class Item:
    """A benchmark item; words are numbers in the scan's vocabulary."""

    key: int | None
    words: list[int]
    answer: list[int]
    given: bool
    rows: dict[int, int] = field(default_factory=dict)
    wanted: frozenset[int] = frozenset()


@dataclass
class Space:
    """Vocabulary, weights and items of a round. ``local`` numbers the scan's words that the space has, else -1.

    ``near`` has for each word of the space its cosine with each part of an item after both went through the basis; a passage's
    cosines are the sum of its words', by their weights.
    """

    local: np.ndarray
    idf: np.ndarray
    near: np.ndarray
    items: list[Item]
    parts: np.ndarray


@dataclass
class Hits:
    """Of some texts their numbers of words, and of each benchmark word in them its text, place and number."""

    sizes: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    word: np.ndarray


def hit_table(rows: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """key, size (words), words and gaps of every row of ``rows`` (key, text).

    words are the numbers of its words that ``ids`` has, gaps their distances in words from one to the next, as little-endian 32-bit integers. No shuffle.
    """
    shared = rows.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                lists = [words_of(t) for t in part.column(1).to_pylist()]
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                found = np.fromiter(map(known, chain.from_iterable(lists), repeat(-1)), np.int32, int(sizes.sum()))
                at = np.flatnonzero(found >= 0)
                ends = np.cumsum(sizes)
                cuts = np.concatenate(([0], np.searchsorted(at, ends))).astype(np.int32) * 4
                gaps = np.diff(at, prepend=0)
                firsts = cuts[:-1][cuts[1:] > cuts[:-1]] // 4
                gaps[firsts] = at[firsts] - (ends - sizes)[cuts[1:] > cuts[:-1]]
                column = lambda x: pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(x.astype("<i4").tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes), column(found[at]), column(gaps)],
                    names=["key", "size", "words", "gaps"],
                )

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, size long, words binary, gaps binary")


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Hits]]:
    """Rows of a hit table, about ``_HITS`` hits at a time."""
    for batch in batches:
        words, gaps = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        counts = np.fromiter(map(len, words), np.int64, len(words)) // 4
        cuts = np.searchsorted(np.cumsum(counts), np.arange(_HITS, int(counts.sum()) + 1, _HITS))
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(words)], strict=True):
            if a == b:
                continue
            some = counts[a:b]
            owner = np.repeat(np.arange(b - a), some)
            total = np.cumsum(np.frombuffer(b"".join(gaps[a:b]), "<i4"), dtype=np.int64)
            before = np.concatenate(([0], total))[np.cumsum(some) - some]
            yield batch.slice(a, b - a), Hits(
                batch.column(1).slice(a, b - a).to_numpy(),
                owner,
                total - before[owner],
                np.frombuffer(b"".join(words[a:b]), "<i4").astype(np.int64),
            )


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    out = np.ones(len(keys), bool)
    out[1:] = keys[1:] != keys[:-1]
    return out


def _windows(h: Hits, local: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts: (passage, word, count), and each passage's text and window.

    Window k of a text has its words from k strides on. Windows without a word of the space are left out: their vectors are zero.
    """
    word = local[h.word]
    here = word >= 0
    owner, word = h.owner[here], word[here]
    block = h.place[here] // STRIDE
    last = np.maximum(0, -(-(h.sizes - STRIDE) // STRIDE) - 1)
    first = np.cumsum(last + 1) - (last + 1)
    size = np.int64(local.max(initial=0) + 1)
    own, other = block <= last[owner], block > 0
    keys = np.concatenate((((first[owner] + block) * size + word)[own], ((first[owner] + block - 1) * size + word)[other]))
    keys.sort()
    starts = np.flatnonzero(_firsts(keys))
    count = np.diff(np.concatenate((starts, [len(keys)])))
    passage, word = np.divmod(keys[starts], size)
    new = _firsts(passage)
    passages = passage[new]
    row = np.searchsorted(first, passages, side="right") - 1
    return np.cumsum(new) - 1, word, count, row << 32 | passages - first[row]


def _weighted(where: np.ndarray, word: np.ndarray, count: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights, each passage's of length one."""
    weight = (1 + np.log(count)) * idf[word]
    return weight / np.maximum(np.sqrt(np.bincount(where, weight * weight, n)), 1e-12)[where]


def _add_products(gram: np.ndarray, where: np.ndarray, word: np.ndarray, weight: np.ndarray) -> None:
    """Adds each passage's products of two words' weights, in fixed point, to the words' table: passages have few words of the space, so these are few."""
    sizes = np.bincount(where)
    each = sizes[where]
    left = np.repeat(np.arange(len(where)), each)
    right = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each) + np.repeat((np.cumsum(sizes) - sizes)[where], each)
    np.add.at(gram.ravel(), word[left] * len(gram) + word[right], np.rint(weight[left] * weight[right] * _FIXED).astype(np.int64))


def document_frequencies(table: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Stretches of ``STRIDE`` words that hold each of the ``size`` words, and all stretches, over the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(size, np.int64), 0
        for _, h in _hits(batches):
            blocks = np.maximum(1, -(-h.sizes // STRIDE))
            here = (np.cumsum(blocks) - blocks)[h.owner] + h.place // STRIDE
            keys = here * size + h.word
            keys.sort()
            df += np.bincount(keys[_firsts(keys)] % size, minlength=size)
            n += int(blocks.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *df.nonzero()[0].tolist()], pa.int64()), pa.array([n, *df[df > 0].tolist()], pa.int64())],
            names=["word", "n"],
        )

    df, n = np.zeros(size, np.int64), 0
    for r in table.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        if r.word < 0:
            n = r.n
        else:
            df[r.word] = r.n
    return df, n


def randomised_svd(table: DataFrame, local: np.ndarray, idf: np.ndarray, items: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Right singular vectors of the TF-IDF matrix of all passages and the items, from one pass.

    With a random matrix R, tasks sum A'AR row by row, each from the products A'A of its own passages; the driver gets one row for each
    word of the space. The Nystrom form of A'A = (A'AR)(R'A'AR)^-1(A'AR)' then gives the basis. Sums are in fixed point, so they do
    not depend on the order in which tasks finish. Items weigh as much as all passages together.
    """
    rank = min(len(idf), len(items) + _OVERSAMPLE)
    random = np.random.default_rng(seed).standard_normal((len(idf), rank)).astype(np.float32)
    shared = table.sparkSession.sparkContext.broadcast((local, idf, random))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, start = shared.value
        gram = np.zeros((len(weights), len(weights)), np.int64)
        for _, h in _hits(batches):
            where, word, count, passages = _windows(h, known)
            if len(where):
                _add_products(gram, where, word, _weighted(where, word, count, len(passages), weights))
        total = np.rint((gram / _FIXED) @ start * _FIXED).astype(np.int64)
        used = np.abs(total).sum(axis=1).nonzero()[0]
        for i in range(0, len(used), 256):
            some = used[i : i + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["word", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for w, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[w] = sums.get(w, 0) + row.values.to_numpy()
        for w, row in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([w], pa.int64()), pa.array([row.tolist()], pa.list_(pa.int64()))],
                names=["word", "row"],
            )

    product = np.zeros((len(idf), rank))
    for r in table.mapInArrow(run, "word long, row array<long>").repartition("word").mapInArrow(add, "word long, row array<long>").collect():
        product[r.word] = np.array(r.row) / _FIXED
    product += max(1.0, n / max(1, len(items))) * (items.T @ (items @ random))
    core = random.T @ product
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > values.max(initial=0) * 1e-9
    root = product @ (vectors[:, keep] / np.sqrt(values[keep]))
    left, size, _ = np.linalg.svd(root, full_matrices=False)
    return left[:, size > size.max(initial=0) * 1e-6].astype(np.float32)


def fit(table: DataFrame, items: list[Item], df: np.ndarray, n: int) -> Space:
    """The space of a round. An item of more than ``WINDOW`` words is several parts in it, each with its own rarest words; those that no document has are left out."""
    rarest = lambda own: sorted({w for w in own if df[w]}, key=lambda w: (df[w], w))[:RAREST]
    parts = []
    for k, item in enumerate(items):
        pieces = -(-len(item.words) // WINDOW)
        parts += [(k, item.words[len(item.words) * i // pieces : len(item.words) * (i + 1) // pieces]) for i in range(pieces)]
    known = sorted({w for _, own in parts for w in rarest(own)} | {w for item in items if item.given for w in item.answer})
    local = np.full(len(df), -1, np.int64)
    local[known] = np.arange(len(known))
    idf = np.log((1 + n) / (1 + df[known])) + 1
    for item in items:
        item.answer = item.answer if item.given else rarest(item.words)
        item.rows, item.wanted = _rows(item.words), frozenset(item.answer)
    matrix = np.zeros((len(parts), len(known)))
    for i, (k, own) in enumerate(parts):
        for w, c in Counter([*own, *(items[k].answer if items[k].given else ())]).items():
            if local[w] >= 0:
                matrix[i, local[w]] = (1 + np.log(c)) * idf[local[w]]
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    basis = randomised_svd(table, local, idf, matrix, n)
    latent = matrix @ basis
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    return Space(local, idf, (basis @ latent.T).astype(np.float32), items, np.array([k for k, _ in parts], np.int64))


def _matches(
    s: Space,
    h: Hits,
    cosine: float,
    lcs_share: float,
    answer_share: float,
    stand_in_share: float,
) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(text, item) -> (lcs, answer, cosine) of the best verified passage. All words of an item are in the hits, so they alone show its common subsequences."""
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    where, word, count, passages = _windows(h, s.local)
    weight = _weighted(where, word, count, len(passages), s.idf)
    begins = np.searchsorted(h.owner, np.arange(len(h.sizes) + 1))
    sizes = np.bincount(where, minlength=len(passages))
    alone = np.flatnonzero(sizes == 1)
    likely = s.near >= cosine
    for p, part, c in chain(
        _alone(alone, word[(np.cumsum(sizes) - sizes)[alone]], s.near, likely),
        _together(where, word, weight, sizes, s.near, cosine),
    ):
        row, a, k = int(passages[p] >> 32), int(passages[p] & 0xFFFFFFFF) * STRIDE, int(s.parts[part])
        item = s.items[k]
        first, last = begins[row] + np.searchsorted(
            h.place[begins[row] : begins[row + 1]],
            (a - len(item.words), a + WINDOW + len(item.words)),
        )
        passage = h.word[first:last].tolist()
        hit = len(item.wanted.intersection(passage)) / max(1, len(item.wanted))
        if hit < (answer_share if item.given else stand_in_share):
            continue
        lcs = _common(item.rows, len(item.words), passage) / len(item.words)
        if lcs >= lcs_share:
            best[row, k] = max(best.get((row, k), (0.0, 0.0, 0.0)), (lcs, hit, float(c)))
    return best


def _alone(passages: np.ndarray, word: np.ndarray, near: np.ndarray, likely: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(passage, part, cosine) of passages with one word of the space, which the word decides."""
    keep = likely.any(axis=1)[word]
    for p, w in zip(passages[keep].tolist(), word[keep].tolist(), strict=True):
        for part in likely[w].nonzero()[0].tolist():
            yield p, part, near[w, part]


def _together(
    where: np.ndarray,
    word: np.ndarray,
    weight: np.ndarray,
    sizes: np.ndarray,
    near: np.ndarray,
    cosine: float,
) -> Iterator[tuple[int, int, float]]:
    """The same for passages with several; those with the most words come first, so the k-th words of all that have one are added at once."""
    starts, weight = np.cumsum(sizes) - sizes, weight.astype(np.float32)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 1]
    for i in range(0, len(order), 2048):
        some = order[i : i + 2048]
        found = near[word[starts[some]]] * weight[starts[some], None]
        for k in range(1, int(sizes[some[0]])):
            at = starts[some[: np.searchsorted(-sizes[some], -k)]] + k
            found[: len(at)] += near[word[at]] * weight[at, None]
        for p, part in zip(*(found >= cosine).nonzero(), strict=True):
            yield int(some[p]), int(part), found[p, part]


def search(
    table: DataFrame,
    space: Space,
    cosine: float = COSINE,
    lcs_share: float = LCS_SHARE,
    answer_share: float = ANSWER_SHARE,
    stand_in_share: float = STAND_IN_SHARE,
) -> DataFrame:
    """key, item_id, cosine, lcs, answer: the best verified passage of each row of a hit table and item."""
    shared = table.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for part, h in _hits(batches):
            if best := _matches(s, h, cosine, lcs_share, answer_share, stand_in_share):
                keys = part.column(0).to_pylist()
                out = [(keys[row], s.items[k].key, c, lcs, hit) for (row, k), (lcs, hit, c) in sorted(best.items())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (part.schema.field(0).type, pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["key", "item_id", "cosine", "lcs", "answer"])

    return table.mapInArrow(
        run,
        f"key {table.schema['key'].dataType.simpleString()}, item_id long, cosine double, lcs double, answer double",
    )


def scans_of(
    benchmark: DataFrame,
    item_id: str,
    item: str,
    answer: str | None,
    vocabulary: int,
) -> Iterator[tuple[dict[bytes, int], list[Item]]]:
    """The benchmark's items of two and more different words and the numbers of their words, as many at a time as ``vocabulary`` different words allow."""
    queries = benchmark.select(
        benchmark[f"`{item_id}`"].cast("long"),
        benchmark[f"`{item}`"],
        (benchmark[f"`{answer}`"] if answer else F.lit(None).cast("string")),
    )
    ids: dict[bytes, int] = {}
    items: list[Item] = []
    for key, body, right in queries.toLocalIterator():
        own, given = words_of(body), words_of(right)
        if len(set(own)) < 2:
            continue
        if items and len(ids) + len({*own, *given}.difference(ids)) > vocabulary:
            yield ids, items
            ids, items = {}, []
        number = lambda ws: [ids.setdefault(w, len(ids)) for w in ws]
        items.append(Item(key, number(own), number(given), bool(given)))
    if items:
        yield ids, items


def _found(
    rows: DataFrame,
    benchmark: DataFrame,
    item_id: str,
    item: str,
    answer: str | None,
    block_items: int,
    vocabulary: int,
) -> DataFrame:
    """Matches of rows (key, text): one scan of the texts for each vocabulary, then two passes over the hits for each block of items."""
    spark = rows.sparkSession
    found = spark.createDataFrame(
        [],
        f"key {rows.schema['key'].dataType.simpleString()}, item_id long, cosine double, lcs double, answer double",
    )
    for ids, items in scans_of(benchmark, item_id, item, answer, vocabulary):
        path = new_dir(spark, "hits")
        made = hit_table(rows, ids)
        made.write.option("compression", "zstd").parquet(path)
        table = spark.read.schema(made.schema).parquet(path)
        df, n = document_frequencies(table, len(ids))
        for i in range(0, len(items), block_items):
            found = found.union(written(search(table, fit(table, items[i : i + block_items], df, n)), "leaks"))
        drop_written(spark, path)
    return found


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item: str = "text",
    answer: str | None = None,
    block_items: int = BLOCK_ITEMS,
    vocabulary: int = VOCABULARY,
) -> DataFrame:
    """The input's rows, all columns, that hold no benchmark item, by the rules of ``contaminated``.

    Texts are named by their MD5, so ids and further columns play no part whatever they hold, and repeated rows all stay or all go. Rows with
    a null, empty or wordless text stay.
    """
    name: Column = F.md5(F.coalesce(documents[f"`{text}`"], F.lit("")).cast("binary"))
    rows = documents.select(name.alias("key"), documents[f"`{text}`"].alias("text"))
    bad = written(_found(rows, benchmark, item_id, item, answer, block_items, vocabulary).select("key").distinct(), "leaking")
    return documents.select(F.struct("*").alias("row"), name.alias("key")).join(bad, "key", "left_anti").select("row.*")


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item: str = "text",
    answer: str | None = None,
    block_items: int = BLOCK_ITEMS,
    vocabulary: int = VOCABULARY,
) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer: one row for each document row and item that it holds.

    Whole texts are searched, in windows of 64 words. ``answer`` names a benchmark column with answers; without it, or where it has no word, an
    item's rarest words serve. The driver holds the items of one ``vocabulary``. Null or wordless texts and items of fewer than two different words match nothing; an empty benchmark or
    table gives no rows. Repeated rows and null ids each give their own rows; further columns are ignored.
    """
    rows = only(documents, doc_id=doc_id, text=text).withColumnRenamed("doc_id", "key")
    return _found(rows, benchmark, item_id, item, answer, block_items, vocabulary).withColumnRenamed("key", "doc_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
