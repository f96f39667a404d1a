"""Repeated substrings across a corpus by suffix arrays.

A byte goes where a string of ``length`` bytes around it also starts anywhere else. The work is
divided by content: every window of that length has an anchor, chosen by its own bytes alone, and equal windows have
their anchors at equal places. So all windows of an anchor can only equal windows of anchors with the same
core, the bytes that all of them hold. Cores that occur once are done; for the others a
suffix array over the bytes that flank the core shows which windows are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import only, read_table, written
from .tokens import chunks

#: Repeated cores are sent to the workers as a bitmap of ``ROOMY`` bits each, up to 2 ** ``SKETCH_BITS`` bits in all (32 MB) and down to
#: ``TIGHT`` bits each. Where there are more of them, each text gets its own repeated cores by a join instead; both ways give the same result.
SKETCH_BITS, ROOMY, TIGHT = 28, 64, 8
#: Different contexts of one core that one suffix array takes; cores with more have each window counted by
#: its hash instead, spread over all tasks.
CONTEXTS = 512

_GRAM = 16
_SEGMENT = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array by linear grouping.

    First, suffixes are put in groups that share a Lyndon prefix. Groups start as the different symbols and are taken
    in descending order. For each member its previous smaller suffix is the nearest place to the left in a group
    not yet taken. Places that are such for l members leave their group for a new one right above it, more
    members higher. Second, suffixes are emitted from the smallest: after a suffix comes its left neighbour's place
    in the neighbour's group, and then, along previous-smaller pointers, those that wait for it. Nothing is renamed
    or recursed into.
    """
    n = len(text)
    if not n:
        return []
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    symbols = sorted(by_symbol)
    members = [set(by_symbol[c]) for c in symbols]
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    below, above = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
    previous, taken_to = [-1] * n, list(range(n))
    descending: list[int] = []
    current = len(symbols) - 1
    while current >= 0:
        descending.append(current)
        own = members[current]
        for i in own:
            taken_to[i] = i - 1
        hits: dict[int, int] = {}
        for i in own:
            j, path = i - 1, []
            while j >= 0 and taken_to[j] != j:
                path.append(j)
                j = taken_to[j]
            for k in path:
                taken_to[k] = j
            taken_to[i] = previous[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        leaving: dict[tuple[int, int], list[int]] = {}
        for j, times in hits.items():
            leaving.setdefault((times, group[j]), []).append(j)
        for times, g in sorted(leaving, reverse=True):
            moved = leaving[times, g]
            if len(moved) == len(members[g]):
                continue
            fresh = len(members)
            members[g].difference_update(moved)
            members.append(set(moved))
            for j in moved:
                group[j] = fresh
            above.append(above[g])
            below.append(g)
            if above[g] >= 0:
                below[above[g]] = fresh
            above[g] = fresh
        current = below[current]
    start, at = [0] * len(members), 0
    for g in reversed(descending):
        start[g] = at
        at += len(members[g])
    out, placed = [-1] * n, [False] * n
    suffix = n - 1
    for i in range(n):
        while suffix >= 0 and not placed[suffix]:
            placed[suffix] = True
            g = group[suffix]
            out[start[g]] = suffix
            start[g] += 1
            suffix = previous[suffix]
        suffix = out[i] - 1
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of the hash base and of its inverse, as far as they were needed so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, _BASE))))
            cls.down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, _INVERSE))))
        return cls.up, cls.down


class Plan:
    """What follows from the length of a repeat: ``reach`` hashes of 16-byte grams have an anchor among them."""

    def __init__(self, length: int):
        if length < 64:
            raise ValueError("repeats of fewer than 64 bytes have no sound anchors")
        self.length = length
        self.reach = min(96, (length - _GRAM) // 3)
        self.margin = self.reach - 1
        self.core = length - self.margin


class Anchors:
    """Anchors of a buffer of joined documents, with the windows that each stands for.

    Among ``reach`` grams in a row the one of least hash, the last of equals, is an anchor. A window's own anchor is the first one
    that lies at least ``margin`` after its start: it depends on the window's bytes alone. ``low``
    and ``high`` are the first and last window start of an anchor, within its document.
    """

    def __init__(self, plan: Plan, buffer: bytes, starts: np.ndarray, ends: np.ndarray, limits: np.ndarray):
        data = np.frombuffer(buffer, np.uint8)
        n, w, length = len(data), plan.reach, plan.length
        up, down = _Powers.to(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])
        self.down = down
        grams = n - _GRAM + 1
        keys = _mix((self.sums[_GRAM:] - self.sums[:-_GRAM]) * down[:grams])
        keys = (keys & ~np.uint64(0xFFFFFF)) | (np.uint64(0xFFFFFF) - np.arange(grams, dtype=np.uint64))
        blocks = np.full(-(-grams // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        blocks[:grams] = keys
        blocks = blocks.reshape(-1, w)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(right[: grams - w + 1], left[w - 1 : grams])
        least = least[np.concatenate(([True], least[1:] != least[:-1]))]
        at = np.unique((np.uint64(0xFFFFFF) - (least & np.uint64(0xFFFFFF))).astype(np.int64))
        owner = np.searchsorted(starts, at - plan.margin, side="right") - 1
        keep = owner >= 0
        before = np.concatenate(([-1 - w], at[:-1]))[keep]
        at, owner = at[keep], owner[keep]
        low = np.maximum(starts[owner], before - plan.margin + 1)
        high = np.minimum(np.minimum(at - plan.margin, ends[owner] - length), limits[owner] - 1)
        keep = low <= high
        self.at, self.owner, self.low, self.high = at[keep], owner[keep], low[keep], high[keep]
        self.first = self.at - plan.margin
        self.core = self.range_hash(self.first, self.first + plan.core)

    def range_hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.down[a])


def _buffers(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[
    tuple[bytes, list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]
]:
    """Different texts of a partition (the first column), joined to buffers of about a megabyte.

    Yields the buffer, and for each piece its text's digest, start, end, limit, place in its text, and what a second column says of the text.
    Longer texts come in overlapping pieces, each of which owns the windows that start before its limit. Of equal texts of one
    partition only the first comes.
    """
    seen: set[bytes] = set()
    parts, size = [], 0

    def joined():
        lengths = np.array([len(p[1]) for p in parts], np.int64)
        ends = np.cumsum(lengths)
        return b"".join(p[1] for p in parts), [p[0] for p in parts], ends - lengths, ends, ends - lengths + np.array([p[3] for p in parts], np.int64), np.array([p[2] for p in parts], np.int64), [p[4] for p in parts]

    for batch in batches:
        for text, own in zip(batch.column(0), batch.column(1) if batch.num_columns > 1 else repeat(None)):
            text = (text.as_py() or "").encode()
            if len(text) < plan.length or (digest := hashlib.md5(text).digest()) in seen:
                continue
            seen.add(digest)
            for at in range(0, len(text) - plan.length + 1, _SEGMENT):
                piece = text[at : at + _SEGMENT + plan.length]
                parts.append((digest, piece, at, _SEGMENT, own))
                size += len(piece)
                if size >= _SEGMENT:
                    yield joined()
                    parts, size = [], 0
    if parts:
        yield joined()


def _occurrence(digests: list[bytes], owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A 64-bit name for a place in a text; equal texts give equal names."""
    names = np.frombuffer(b"".join(d[:8] for d in digests), np.uint64)
    return _mix(names[owner] ^ _mix(place.astype(np.uint64) + np.uint64(1))).view(np.int64)


def repeated_cores(rows: DataFrame, plan: Plan) -> DataFrame:
    """Cores that stand at two different places or in two different texts; minima and maxima combine before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buffer, digests, starts, ends, limits, places, _ in _buffers(batches, plan):
            a = Anchors(plan, buffer, starts, ends, limits)
            where = _occurrence(digests, a.owner, a.at - starts[a.owner] + places[a.owner])
            yield pa.RecordBatch.from_arrays([pa.array(a.core.view(np.int64)), pa.array(where)], names=["core", "place"])

    found = rows.select("text").mapInArrow(run, "core long, place long")
    return found.groupBy("core").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b").select("core")


def sketch(cores: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the cores' last bits."""
    slot = F.col("core").bitwiseAND(F.lit((1 << bits) - 1))
    words = cores.groupBy(F.shiftright(slot, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("mask")
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    table = words.toArrow()
    out[table.column("word").to_numpy()] = table.column("mask").to_numpy()
    return out.view(np.uint64)


def with_cores(rows: DataFrame, plan: Plan, cores: DataFrame) -> DataFrame:
    """text and its repeated cores, an array; texts without one are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buffer, digests, starts, ends, limits, _, _ in _buffers(batches, plan):
            a = Anchors(plan, buffer, starts, ends, limits)
            yield pa.RecordBatch.from_arrays(
                [pa.array([digests[i] for i in a.owner.tolist()], pa.binary()), pa.array(a.core.view(np.int64))],
                names=["digest", "core"],
            )

    own = rows.select("text").mapInArrow(run, "digest binary, core long").join(cores, "core", "left_semi").groupBy("digest").agg(F.collect_set("core").alias("cores"))
    return rows.select("text", F.unhex(F.md5("text")).alias("digest")).join(own, "digest").select("text", "cores")


_CONTEXT = "text binary, at long, low long, high long, core long, context long, place long, before binary, after binary"


def contexts(rows: DataFrame, plan: Plan, cores: DataFrame, n_cores: int) -> DataFrame:
    """One row for each anchor whose core may be repeated; ``cores`` has the ``n_cores`` repeated ones.

    text is the text's digest, at the anchor, low and high the first and last window start; context names the bytes of all the
    windows, before and after are those of them that flank the core.
    """
    bits = min(SKETCH_BITS, max(16, (ROOMY * n_cores).bit_length()))
    small = TIGHT * n_cores <= 1 << bits
    rows = rows.select("text") if small else with_cores(rows, plan, cores)
    shared = rows.sparkSession.sparkContext.broadcast(sketch(cores, bits) if small else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for buffer, digests, starts, ends, limits, places, own in _buffers(batches, plan):
            a = Anchors(plan, buffer, starts, ends, limits)
            if known is None:
                hit = np.isin(a.core.view(np.int64), np.concatenate([x.values.to_numpy() for x in own])).nonzero()[0]
            else:
                slot = a.core & np.uint64((1 << bits) - 1)
                hit = ((known[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool).nonzero()[0]
            if not len(hit):
                continue
            at, owner, low, high, first = a.at[hit], a.owner[hit], a.low[hit], a.high[hit], a.first[hit]
            shape = _mix((at - low).astype(np.uint64) * np.uint64(1 << 20) + (at - high).astype(np.uint64))
            context = _mix(a.range_hash(low, high + plan.length) ^ shape).view(np.int64)
            shift = places[owner] - starts[owner]
            before = [buffer[x:y] for x, y in zip(low.tolist(), first.tolist(), strict=True)]
            after = [buffer[x:y] for x, y in zip((first + plan.core).tolist(), (high + plan.length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([digests[i] for i in owner.tolist()], pa.binary()),
                    pa.array(at + shift),
                    pa.array(low + shift),
                    pa.array(high + shift),
                    pa.array(a.core[hit].view(np.int64)),
                    pa.array(context),
                    pa.array(_occurrence(digests, owner, at + shift)),
                    pa.array(before, pa.binary()),
                    pa.array(after, pa.binary()),
                ],
                names=["text", "at", "low", "high", "core", "context", "place", "before", "after"],
            )

    return rows.mapInArrow(run, _CONTEXT)


def equal_windows(plan: Plan, group: list[dict]) -> list[list[int]]:
    """For contexts of one core, the starts of each one's windows that another one also has, by one suffix array.

    Each context is written as the bytes before the core, one symbol for the core, and the bytes after it. A window is then a string
    of ``reach`` symbols that holds the core's symbol, and equal windows are neighbours among the sorted suffixes.
    """
    symbols: list[int] = []
    starts: dict[int, tuple[int, int]] = {}
    for k, c in enumerate(group):
        first = c["at"] - plan.margin
        for s in range(c["low"], c["high"] + 1):
            starts[len(symbols) + len(c["before"]) - (first - s)] = (k, s)
        symbols += [*(b + 1 for b in c["before"]), 257, *(b + 1 for b in c["after"]), 0]
    line = "".join(map(chr, symbols))
    found: list[list[int]] = [[] for _ in group]
    last, last_window, marked = -1, None, False
    for i in suffix_array(symbols):
        if i not in starts:
            continue
        window = line[i : i + plan.reach]
        if window == last_window:
            if not marked:
                k, s = starts[last]
                found[k].append(s)
            k, s = starts[i]
            found[k].append(s)
            marked = True
        else:
            last_window, marked = window, False
        last = i
    return found


def _spans(starts: list[int], length: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + length)
        else:
            out.append((s, s + length))
    return out


_SPAN = "text binary, start long, end long"


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
        names=["text", "start", "end"],
    )


def _sorted_groups(chosen: DataFrame, plan: Plan) -> DataFrame:
    """Spans of contexts that occur once, from the suffix array of their core's contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        out: list[tuple] = []

        def close():
            for c, starts in zip(group, equal_windows(plan, group), strict=True):
                if not c["copied"]:
                    out.extend((c["text"], a, b) for a, b in _spans(starts, plan.length))

        for batch in batches:
            for c in batch.to_pylist():
                if group and group[0]["core"] != c["core"]:
                    close()
                    group = []
                group.append(c)
            if out:
                yield _span_batch(out)
                out = []
        if group:
            close()
            yield _span_batch(out)

    return chosen.repartition("core").sortWithinPartitions("core", "context").mapInArrow(run, _SPAN)


def _counted_windows(chosen: DataFrame, plan: Plan) -> DataFrame:
    """The same for cores with very many contexts: every window is counted by its bytes' hash, which spreads over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                rows = []
                for c in part.to_pylist():
                    first, n = c["at"] - plan.margin, len(c["before"])
                    for s in range(c["low"], c["high"] + 1):
                        k = first - s
                        window = c["before"][n - k :] if k else b""
                        h = xxhash.xxh3_128_digest(k.to_bytes(2, "little") + window + c["after"][: plan.margin - k])
                        rows.append((c["core"], h, None if c["copied"] else c["text"], s, c["place"]))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)],
                    names=["core", "window", "text", "start", "place"],
                )

    windows = chosen.mapInArrow(run, "core long, window binary, text binary, start long, place long")
    more = windows.groupBy("core", "window").agg(
        F.min("place").alias("a"),
        F.max("place").alias("b"),
    ).where("a <> b").select("core", "window")
    return windows.where(F.col("text").isNotNull()).join(more, ["core", "window"], "left_semi").select(
        "text",
        "start",
        (F.col("start") + plan.length).alias("end"),
    )


def repeats(rows: DataFrame, length: int = 400, contexts_at_once: int = CONTEXTS) -> DataFrame:
    """text (digest), start, end: spans that cover all repeated bytes of texts that occur once. ``rows`` has a column text."""
    plan = Plan(length)
    cores = written(repeated_cores(rows, plan), "cores")
    table = written(contexts(rows, plan, cores, cores.count()), "contexts")
    each = table.groupBy("core", "context").agg(F.min("place").alias("place"), (F.min("place") != F.max("place")).alias("copied"))
    cores = each.groupBy("core").agg(F.count(F.lit(1)).alias("n"))
    each = written(each.join(cores, "core"), "context-counts")
    copied = table.select("text", "low", "high", "core", "context").join(
        each.where("copied").select("core", "context"),
        ["core", "context"],
        "left_semi",
    ).select("text", F.col("low").alias("start"), (F.col("high") + length).alias("end"))
    several = each.where("n > 1").select("core", "context", F.col("place").alias("least"), "copied", "n")
    chosen = table.join(several, ["core", "context"]).where(F.col("place") == F.col("least")).dropDuplicates(["core", "context"]).select(*table.columns, "copied", "n")
    few = _sorted_groups(chosen.where(F.col("n") <= contexts_at_once), plan)
    many = _counted_windows(chosen.where(F.col("n") > contexts_at_once), plan)
    return copied.union(few).union(many)


def remove_repeats(documents: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text", others: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, and with ``others`` the struct others; one row per input row.

    Texts are UTF-8 bytes. Each byte goes that is covered by a string of ``length`` bytes that also starts
    anywhere else in the table, judged on the input; matches never cross documents. Texts that occur twice or more
    lose everything if they are long enough. A character that loses some of its bytes is dropped from
    kept_text as a whole. A null text is empty; very long ones are read in overlapping pieces; an empty table gives no rows. Null ids and
    repeated rows are documents of their own. Further columns are ignored; ``others`` holds all of the input's columns but the text, whatever their names.
    """
    rest = [documents[f"`{c}`"].alias(c) for c in documents.columns if c != text]
    rows = documents.select(
        documents[f"`{doc_id}`"].alias("doc_id"),
        F.coalesce(documents[f"`{text}`"], F.lit("")).alias("text"),
        *([F.struct(*rest).alias("others")] if others else []),
    )
    spans = repeats(rows, length).groupBy("text").agg(
        F.collect_set(F.struct("start", "end")).alias("spans")
    ).select(F.col("text").alias("digest"), "spans")
    named = rows.withColumn("digest", F.unhex(F.md5("text")))
    copies = named.where(F.octet_length("text") >= length).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    what = copies.join(spans, "digest", "left").where(
        (F.col("copies") > 1) | F.col("spans").isNotNull()
    ).select("digest", F.col("copies") > 1, "spans").toDF("digest", "copied", "spans")
    joined = named.join(what, "digest", "left").select("doc_id", "text", "copied", "spans", *named.columns[2:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out = []
            for text, copied, spans in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                data = text.encode()
                merged: list[list[int]] = [[0, len(data)]] if copied else []
                for s in [] if copied or not spans else sorted((x["start"], x["end"]) for x in spans):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                left, at = [], 0
                for a, b in merged:
                    left.append(data[at:a])
                    at = b
                left = b"".join([*left, data[at:]])
                out.append(
                    (len(data), len(data) - len(left), len(merged), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore"))
                )
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)),
                    *batch.columns[4:],
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", *batch.schema.names[4:]],
            )

    kind = joined.schema["doc_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return joined.mapInArrow(run, StructType([*schema.fields, *joined.schema.fields[4:]]))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))
