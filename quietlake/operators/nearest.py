"""The nearest vectors by cosine, exact: products of whole blocks find what can be among them, and only values near a rounding edge are computed anew, term by term."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A similarity is an integer here, in units of the last of nine decimals. Null is below all, not-a-number above, as Spark sorts them; an empty place is below null.
UNIT, NULL, NAN, EMPTY = 1e9, -(1 << 61), 1 << 61, -(1 << 62)
#: What a block's product may be off by: some 64 rounding errors of 1e-16 each are below it by far, and it is far below a unit.
SLACK = 1e-12
#: Queries that meet a batch of memories at a time.
ROWS = 512


class Vectors:
    """A column of vectors: ids, sums of squares' roots summed term by term, and for each length a matrix. Null vectors and vectors with nulls are of no length."""

    def __init__(self, ids: pa.Array, column: pa.Array):
        self.ids = ids.to_numpy(zero_copy_only=False).astype(np.int64) if pa.types.is_integer(ids.type) else np.array(ids.to_pylist() + [None], dtype=object)[:-1]
        lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(lengths[lengths >= 0]).tolist():
            at = np.flatnonzero(lengths == n)
            flat = column.take(pa.array(at)).flatten()
            rows = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)
            if flat.null_count:
                whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), n).any(axis=1)
                at, rows = at[whole], rows[whole]
            with np.errstate(all="ignore"):
                self.by_length[n] = at, rows, np.sqrt(in_order(rows, rows))


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed term by term from the first, as Spark's aggregate does."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def units(similarity: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Exact similarities in units: half a unit is rounded away from zero in the shortest decimal form, as by Spark's round."""
    real = np.isfinite(similarity) & ~null
    size = np.abs(np.where(real, similarity, 0.0)) * UNIT
    whole = np.floor(size + 0.5)
    for i in np.flatnonzero(np.abs(size - np.floor(size) - 0.5) < 1e-5):
        whole[i] = int((abs(Decimal(repr(float(similarity[i])))) * 10**9).quantize(Decimal(1), ROUND_HALF_UP))
    out = np.where(similarity < 0, -whole, whole).astype(np.int64)
    return np.where(null, NULL, np.where(real, out, NAN))


def exact(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        whole = size_a * size_b
        return units(in_order(a, b) / whole, whole == 0)


class Best:
    """The k best memories of each query so far, by similarity and then the smaller id."""

    def __init__(self, queries: np.ndarray, k: int, kind: np.dtype):
        self.queries, self.k = queries, k
        self.units = np.full((len(queries), k), EMPTY, dtype=np.int64)
        self.ids = np.zeros((len(queries), k), dtype=kind)

    def add(self, q: np.ndarray, u: np.ndarray, ids: np.ndarray) -> None:
        """Pairs of a query's place, units and a memory's id; a query is no memory of itself."""
        last, last_id = self.units[q, -1], self.ids[q, -1]
        tie = np.flatnonzero((u == last) & (last != EMPTY))
        good = u > last
        good[tie] = ids[tie] < last_id[tie]
        good &= ids != self.queries[q]
        q, u, ids = q[good], u[good], ids[good]
        if not len(q):
            return
        own = np.unique(q)
        held = self.units[own] != EMPTY
        q = np.concatenate([np.repeat(own, held.sum(axis=1)), q])
        u = np.concatenate([self.units[own][held], u])
        ids = np.concatenate([self.ids[own][held], ids])
        rank = ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1]
        order = np.lexsort((rank, -u, q))
        q, u, ids = q[order], u[order], ids[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = place < self.k
        self.units[q[keep], place[keep]] = u[keep]
        self.ids[q[keep], place[keep]] = ids[keep]


def _kinds(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors a block's product does justice to, and which are odd: tiny or without end. The rest are zero."""
    plain = (size > 1e-100) & (size < 1e100)
    return plain, ~plain & (size != 0)


def meet(asked: Vectors, told: Vectors, best: Best) -> None:
    """Compares all queries with a batch of memories."""
    for n, (q_at, q_rows, q_size) in asked.by_length.items():
        m_at, m_rows, m_size = told.by_length.get(n, (np.zeros(0, np.int64), np.zeros((0, n)), np.zeros(0)))
        (plain_q, odd_q), (plain_m, odd_m) = _kinds(q_size), _kinds(m_size)
        _blocks(asked, told, best, (q_at[plain_q], q_rows[plain_q], q_size[plain_q]), (m_at[plain_m], m_rows[plain_m], m_size[plain_m]))
        for i in np.flatnonzero(odd_q):
            u = exact(m_rows, m_size, np.broadcast_to(q_rows[i], m_rows.shape), q_size[i])
            best.add(np.full(len(m_at), q_at[i]), u, told.ids[m_at])
        rest = np.flatnonzero(~odd_q)
        for i in np.flatnonzero(odd_m):
            u = exact(q_rows[rest], q_size[rest], np.broadcast_to(m_rows[i], (len(rest), n)), m_size[i])
            best.add(q_at[rest], u, told.ids[np.full(len(rest), m_at[i])])
        for own, void in ((plain_q, m_at[m_size != 0]), (q_size == 0, m_at[odd_m]), (odd_q, m_at)):
            _nulls(told, best, q_at[own], void)
    whole = np.concatenate([np.zeros(0, np.int64), *(at for at, _, _ in asked.by_length.values())])
    _nulls(told, best, np.setdiff1d(np.arange(len(asked.ids)), whole), np.zeros(0, np.int64))


def _blocks(asked: Vectors, told: Vectors, best: Best, queries: tuple, memories: tuple) -> None:
    q_at, q_rows, q_size = queries
    m_at, m_rows, m_size = memories
    if not len(q_at) or not len(m_at):
        return
    unit_m, m_ids = m_rows / m_size[:, None], told.ids[m_at]
    for begin in range(0, len(q_at), ROWS):
        at, rows, size = (x[begin : begin + ROWS] for x in (q_at, q_rows, q_size))
        s = (rows / size[:, None]) @ unit_m.T
        both = np.flatnonzero(np.isin(m_ids, asked.ids[at]))
        s[:, both] = np.where(m_ids[both][None, :] == asked.ids[at][:, None], -np.inf, s[:, both])
        last = best.units[at, -1]
        least = np.where(last > NULL, (last - 0.5) / UNIT - SLACK, -np.inf)
        open_ = np.flatnonzero(last <= NULL)
        if len(open_) and len(m_at) > best.k:
            kth = np.partition(s[open_], len(m_at) - best.k, axis=1)[:, len(m_at) - best.k]
            least[open_] = kth - 2 / UNIT
        i, j = np.nonzero(s >= np.maximum(least, -2.0)[:, None])
        if not len(i):
            continue
        x = s[i, j] * UNIT
        u = np.where(x < 0, -np.floor(0.5 - x), np.floor(x + 0.5)).astype(np.int64)
        near = np.flatnonzero(np.abs(np.abs(x) - np.floor(np.abs(x)) - 0.5) < 2 * SLACK * UNIT)
        u[near] = exact(m_rows[j[near]], m_size[j[near]], rows[i[near]], size[i[near]])
        best.add(at[i], u, m_ids[j])


def _nulls(told: Vectors, best: Best, at: np.ndarray, compared: np.ndarray) -> None:
    """Gives queries that have not yet k memories with a similarity those without: all but the compared ones, of which the smallest ids are enough."""
    at = at[best.units[at, -1] <= NULL]
    if len(at):
        void = np.ones(len(told.ids), dtype=bool)
        void[compared] = False
        ids = np.sort(told.ids[void])
        if len(ids):
            ids = ids[: best.k + np.unique(ids, return_counts=True)[1].max()]
            best.add(np.repeat(at, len(ids)), np.full(len(at) * len(ids), NULL), np.tile(ids, len(at)))


def search(asked: tuple[bytes, int], batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A task's best k for each query. ``asked``: the queries in Arrow's stream format, and k; ``schema``: query_id, vec_id, similarity."""
    table, k = pa.ipc.open_stream(asked[0]).read_all().combine_chunks(), asked[1]
    column = lambda name: pa.concat_arrays(table.column(name).chunks) if table.num_rows else pa.array([], table.schema.field(name).type)
    queries, best = Vectors(column("query_id"), column("query")), None
    for batch in batches:
        told = Vectors(batch.column(0), batch.column(1))
        best = best or Best(queries.ids, k, told.ids.dtype)
        meet(queries, told, best)
    for begin in range(0, len(queries.ids) if best else 0, 4096):
        own = slice(begin, begin + 4096)
        u, full = best.units[own], best.units[own] != EMPTY
        ids, who = best.ids[own][full], np.repeat(queries.ids[own], full.sum(axis=1))
        value = np.where(u[full] == NAN, np.nan, u[full] / UNIT)
        columns = [pa.array(who.tolist(), schema.field(0).type), pa.array(ids.tolist(), schema.field(1).type), pa.array(value, pa.float64(), mask=u[full] == NULL)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)
