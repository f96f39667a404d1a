"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text tells, at every place of another text, how far
the text goes on as some substring of the labelled text. Reading greedily, a text falls apart
into phrases of longest matches; fewer phrases for each character mean less cross entropy, so the language that needs fewest wins.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, read_table

#: Characters of labelled text for each language, and a quarter of the labelled rows that are looked at for it: the documented
#: bounds of the sample that models are fitted on.
SAMPLE_CHARS = 20_000
SAMPLE_ROWS = 48
#: Texts are parsed in blocks of so many symbols, all blocks of a batch side by side; the result does not depend on it.
BLOCK = 256

_PAD, _OTHER, _FIRST = range(3)
_SPACE = 0x20


@functools.cache
def _written_signs() -> np.ndarray:
    """For every code point whether it is part of written words: a letter, or a mark that letters carry."""
    return np.array([chr(c).isalpha() or unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)])


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of the sequence; state 0 is its root."""
    move: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        cur = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = cur
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return move


def symbols(text: str) -> np.ndarray:
    """UTF-8 bytes of a lower-cased text, every run of anything but letters and their marks as one space, so layout tells nothing."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    points = np.where(_written_signs()[points], points, _SPACE).astype("<u4")
    space = points == _SPACE
    if len(points):
        points = points[np.concatenate(([True], ~(space[1:] & space[:-1])))]
    return np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)


@dataclass
class Models:
    """All languages' automata in one table.

    The symbols are UTF-8 bytes, so every script has them and no letter is lost. ``codes`` numbers those that a language's sample
    has; all others share one number. ``table[state + code]`` holds the next state, where states are places in the table, doubled,
    plus 1 where no transition exists and a new phrase begins with this symbol. A symbol that the sample lacks is a phrase of its own.
    """

    langs: list[str]
    roots: np.ndarray
    table: np.ndarray
    codes: np.ndarray

    @classmethod
    def fit(cls, texts: dict[str, str]) -> Models:
        langs, roots, tables, codes, base = sorted(texts), [], [], [], 0
        for lang in langs:
            own = symbols(texts[lang])
            known = np.unique(own)
            code = np.full(256, _OTHER, np.int32)
            code[known] = np.arange(_FIRST, _FIRST + len(known))
            width, move = _FIRST + len(known), suffix_automaton(code[own].tolist())
            n = len(move) + 1
            table = np.full((n, width), -1, np.int64)
            for state, out in enumerate(move):
                for c, to in out.items():
                    table[state, c] = to
            between = n - 1
            again = np.where(table[0] >= 0, table[0], between)
            table = np.where(table >= 0, (table * width + base) * 2, ((again * width + base) * 2 + 1)[None, :])
            table[:, _PAD] = (np.arange(n) * width + base) * 2
            roots.append((between * width + base) * 2)
            tables.append(table.ravel())
            codes.append(code)
            base += n * width
        kind = np.int32 if base * 2 < 2**31 else np.int64
        return cls(
            langs,
            np.asarray(roots, kind),
            np.concatenate(tables).astype(kind) if tables else np.empty(0, kind),
            np.asarray(codes, kind).reshape(len(langs), 256),
        )

    def _breaks(self, columns: np.ndarray, first: np.ndarray, root: int) -> np.ndarray:
        """For every block, one per column, how many phrases begin in it when texts are read from their beginning.

        All blocks are first read as if each began a phrase. Then each is read again from where the block before it really ended, until
        it meets its first reading, from where on both agree; blocks whose end has changed hand that on.
        """
        steps = np.empty(columns.shape, self.table.dtype)
        state = np.full(columns.shape[1], root, self.table.dtype)
        for i, column in enumerate(columns):
            state = steps[i] = self.table[(state >> 1) + column]
        came = np.full(columns.shape[1], root >> 1, self.table.dtype)
        while True:
            want = np.where(first, root >> 1, np.concatenate((came[:1], steps[-1, :-1] >> 1)))
            at = np.flatnonzero(want != came)
            if not len(at):
                return (steps & 1).sum(axis=0)
            came = want
            state = want[at] << 1
            for i, column in enumerate(columns):
                state = self.table[(state >> 1) + column[at]]
                other = state >> 1 != steps[i, at] >> 1
                steps[i, at] = state
                at, state = at[other], state[other]
                if not len(at):
                    break

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases that each text needs under each language, one row per text."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        coded = [symbols(t) for t in texts]
        counts = [-(-len(c) // BLOCK) for c in coded]
        owner = np.repeat(np.arange(len(texts)), counts)
        if not len(owner):
            return out
        blocks, filled, at = np.zeros((len(owner), BLOCK), np.uint8), np.zeros((len(owner), BLOCK), bool), 0
        for c, n in zip(coded, counts, strict=True):
            blocks[at : at + n].ravel()[: len(c)] = c
            filled[at : at + n].ravel()[: len(c)] = True
            at += n
        first = np.concatenate(([True], owner[1:] != owner[:-1]))
        for k, root in enumerate(self.roots.tolist()):
            columns = np.ascontiguousarray(np.where(filled, self.codes[k][blocks], _PAD).T)
            np.add.at(out[:, k], owner, self._breaks(columns, first, root))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text.

        The score is the second best language's phrases less the best one's, as a share of the former; ties
        go to the language first in the alphabet. Null texts and texts without a letter are ``und`` with score 0.
        """
        has = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        n = self.phrases([t if h else "" for t, h in zip(texts, has, strict=True)])
        langs, scores = [], []
        for row, ok in zip(n, has, strict=True):
            if not ok or not self.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            best = int(row.argmin())
            rest = np.delete(row, best)
            langs.append(self.langs[best])
            scores.append(float(1 - row[best] / rest.min()) if len(rest) else 1.0)
        return langs, scores


def sample_texts(labelled: DataFrame, chars: int = SAMPLE_CHARS, rows: int = SAMPLE_ROWS) -> dict[str, str]:
    """Text for each language: at most ``chars`` characters, from about four times ``rows`` different labelled texts.

    Rows are taken in order of a hash, so the sample does not depend on the table's order or partitions.
    A first pass counts labels; the second one reads only rows whose hash falls below a bound that leaves about
    four times ``rows`` of them for each language, wherever a hot source may lie. Null texts and labels are left out; an
    empty table gives no language.
    """
    texts = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64(F.lit("sample"), "text"))
    counts = {r.lang: r.n for r in texts.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return {}
    near = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 4.0 * rows / max(n, 1))))])
    bounded = texts.where((F.col("h").cast("double") / 2.0**64 + 0.5) <= near[F.col("lang")])
    first = bounded.groupBy("lang", "h").agg(F.min(F.substring("text", 1, chars)).alias("text"))
    out: dict[str, str] = {}
    for r in sorted(first.toLocalIterator(), key=lambda r: (r.lang, r.h)):
        room = chars - len(out.get(r.lang, ""))
        if room > 0:
            out[r.lang] = out.get(r.lang, "") + r.text[: max(0, room - 1)] + "\n"
    return out


def identify(documents: DataFrame, models: Models, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text; one row per input row, no shuffle.

    Texts are read whole, very long ones too. Null texts and texts without a letter are ``und`` with score 0, as is all where no
    language was learned. Repeated rows and null ids stay as they are; an empty table gives no rows. Further columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                n, size = 0, 0
                texts = []
                while at + n < whole.num_rows and (not n or size < 1 << 20):
                    t = whole.column(1)[at + n].as_py()
                    texts.append(t)
                    size += len(t or "")
                    n += 1
                langs, scores = model.predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [whole.column(0).slice(at, n), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )
                at += n

    rows = only(documents, doc_id=doc_id, text=text)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the four fifths of documents whose id's CRC-32 is no multiple of 5 and predicts all."""
    documents = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    models = Models.fit(sample_texts(documents.where(~held_out).select("text", "lang")))
    found = identify(documents, models)
    return found.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )
