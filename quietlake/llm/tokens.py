"""Token ids and token counts as the tokenizers library gives them.

* ``IdEncoder`` joins the ids of a text's pieces, which are cut where the library's own pre-tokenizer is sure to cut. Merging by the rank of
  the joined bytes, which is much faster, stands in for the library wherever ``ranks_prove`` shows that both must agree.
* ``WholeTokens`` proves which vocabulary strings encode alone as one token. Pre-tokens among them
  count one without any merging; only the rest go through the merges.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import only, read_table

#: Unicode White_Space, which is what ``\s`` means to the library's pattern engine.
_WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Pieces of a byte-level text: they end before white space, and a run of white space leaves its last
#: character to the word that follows, as in the pre-tokenizer.
_BYTE_PIECES = re.compile(f"[{_WS}]+(?![^{_WS}])| ?[^{_WS}]+|[{_WS}]+")
#: Pieces where white space is dropped anyway.
_WORD_PIECES = re.compile(r"[^ \t\n\r]+")
#: The byte-level pre-tokenizer's pattern, a fixed value of this public family of tokenizers.
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The normalizer and pre-tokenizer settings that the patterns above stand for.
_BYTE_SHAPE = (None, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True})
_WORD_SHAPE = (
    {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
        ],
    },
)

#: Different pieces that a worker remembers before it starts anew; bounds its memory, not the result.
CACHE_PIECES = 300_000
_CHUNK = 256


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _specials(path: str) -> tuple[dict, re.Pattern | None]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    tokens = {t["content"]: t["id"] for t in spec["added_tokens"]}
    found = re.compile("(" + "|".join(re.escape(t) for t in sorted(tokens, key=len, reverse=True)) + ")") if tokens else None
    return spec | {"special": tokens}, found


def _shape(spec: dict) -> str | None:
    """``byte`` or ``word`` where a tokenizer file has just the settings that the piece patterns were written for, else None. Offsets play no part in ids."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items() if k != "trim_offsets"}
        return [plain(v) for v in x] if isinstance(x, list) else x

    if spec.get("truncation") or spec.get("padding"):
        return None
    found = plain(spec["normalizer"]), plain(spec["pre_tokenizer"])
    return "byte" if found == _BYTE_SHAPE else "word" if found == _WORD_SHAPE else None


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


def rank_table(spec: dict) -> dict[bytes, int] | None:
    """Token bytes -> id. A token that ends a word has the byte 255, which no text has, at its end; None if this isn't possible."""
    letters, end = _byte_letters(), spec["model"].get("end_of_word_suffix") or ""
    out: dict[bytes, int] = {}
    for token, number in spec["model"]["vocab"].items():
        last = bool(end) and token.endswith(end)
        body = token[: -len(end)] if last else token
        if not body or any(c not in letters for c in body):
            return None
        out[bytes(letters[c] for c in body) + b"\xff" * last] = number
    return out


@functools.cache
def ranks_prove(path: str) -> bool:
    """Whether merging by rank of the joined bytes must give what the tokenizer's pre-tokens and list of merges give.

    The pre-tokens are those of the patterns here only if the file's normalizer and pre-tokenizer are the ones they stand for.
    It must if ids follow the list's order and every listed token is what its own letters merge to. For then, whenever
    two neighbours join to a token, their letters have merged as if that token stood alone, and there the last two
    parts before the end are the listed pair.
    """
    spec, _ = _specials(path)
    model = spec["model"]
    if _shape(spec) is None or model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or rank_table(spec) is None:
        return False
    end, vocab = model.get("end_of_word_suffix") or "", model["vocab"]
    pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    rank = {pair: i for i, pair in enumerate(pairs)}
    ids = [vocab[a + b] for a, b in pairs]
    if any(x >= y for x, y in zip(ids, ids[1:], strict=False)) or min(ids, default=0) < len(vocab) - len(set(ids)) or len(set(ids)) != len(ids):
        return False
    for a, b in pairs:
        token = a + b
        body = token[: -len(end)] if end and token.endswith(end) else token
        parts = [*body[:-1], body[-1] + token[len(body) :]]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), len(rank)))
            if (parts[best], parts[best + 1]) not in rank:
                return False
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return True


#: Runs without a sure cut that are left to the library, which takes them in good time whatever their length.
_LONG_RUN = re.compile(f"[^{_WS}]{{1000}}|[{_WS}]{{1000}}")
#: Lower-case words that end before ASCII; such a piece is one pre-token of a word vocabulary. Then anything else.
_LATIN_PIECES = re.compile(f"[a-z\xe0-\xf6\xf8-\xff]+(?=[\\x00-`{{-\x7f]|\\Z)|[^ \\t\\n\\r]+")
_LATIN_WORD = re.compile("[a-z\xe0-\xf6\xf8-\xff]+").fullmatch
_BEYOND_LATIN = re.compile("[^\x00-\xff]").search


class IdEncoder:
    """``encode(texts)`` -> little-endian unsigned 32-bit ids of each text, without added specials.

    Special strings inside a text become their ids first, as in the library; what lies between them
    is encoded on its own.
    """

    def __init__(self, path: str, by_rank: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec, self.found = _specials(path)
        self.special = {k: v.to_bytes(4, "little") for k, v in spec["special"].items()}
        self.shape = _shape(spec)
        self.bytes_only = self.shape == "byte"
        self.merge = None
        if by_rank:
            import tiktoken

            self.merge = tiktoken.Encoding("ranks", pat_str=_PRE_TOKENS, mergeable_ranks=rank_table(spec), special_tokens={})
        self.cache: dict[str, bytes] = {}

    def _pieces(self, text: str) -> list[str]:
        if self.shape is None:
            return [text]
        if self.bytes_only:
            return _BYTE_PIECES.findall(text)
        if self.merge is not None and not _BEYOND_LATIN(text):
            return _LATIN_PIECES.findall(text.lower())
        return _WORD_PIECES.findall(text)

    def _join(self, cut: list[list[str]]) -> list[bytes]:
        import numpy as np

        if len(self.cache) > CACHE_PIECES:
            self.cache = {}
        cache = self.cache
        new = list(set(chain.from_iterable(cut)).difference(cache))
        if self.merge is not None and not self.bytes_only:
            merge = self.merge._core_bpe.encode_single_piece
            words = [p for p in new if len(p) < 200 and _LATIN_WORD(p)]
            for p in words:
                cache[p] = array("I", merge(p.encode() + b"\xff")).tobytes()
            new = list(set(new).difference(words))
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            for piece, e in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                cache[piece] = np.asarray(e.ids, dtype="<u4").tobytes()
        get = cache.__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        texts = list(texts)
        out: list[bytes | None] = [None] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if self.found is not None and "<" in text and self.found.search(text):
                parts = [p for p in self.found.split(text) if p]
                plain = iter(self.encode(p for p in parts if p not in self.special))
                out[i] = b"".join(self.special.get(p) or next(plain) for p in parts)
            elif self.merge is not None and self.bytes_only and not _LONG_RUN.search(text):
                out[i] = array("I", self.merge.encode_ordinary(text)).tobytes()
            else:
                rest.append(i)
        for i, ids in zip(rest, self._join([self._pieces(texts[i]) for i in rest]), strict=True):
            out[i] = ids
        return out


class WholeTokens:
    """Token counts of a byte-level tokenizer through the set of proven whole tokens."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec, self.found = _specials(path)
        if _shape(spec) != "byte":
            raise ValueError("the whole-token count needs a byte-level tokenizer without normalizer")
        self.special = spec["special"]
        self.pre_tokens = regex.compile(
            _PRE_TOKENS.replace("\\s", f"[{_WS}]").replace(f"[^[{_WS}]", f"[^{_WS}").replace("\\S", f"[^{_WS}]")
        ).findall
        self.whole = self.prove()
        self.rest: dict[str, int] = {}

    def prove(self) -> dict[str, int]:
        """Vocabulary strings that are valid text, one pre-token, and encode as one token."""
        strings = [
            s for i in range(self.library.get_vocab_size(with_added_tokens=False)) if (
                s := self.library.decode([i], skip_special_tokens=False)
            ) and "�" not in s and s not in self.special
        ]
        encoded = self.library.encode_batch_fast(strings, add_special_tokens=False)
        return {s: 1 for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1 and self.pre_tokens(s) == [s]}

    def count(self, texts: Iterable[str]) -> list[int]:
        cut, n_special = [], []
        for text in texts:
            if "<" in text and self.found is not None and self.found.search(text):
                parts = self.found.split(text)
                cut.append([p for part in parts if part not in self.special for p in self.pre_tokens(part)])
                n_special.append(sum(part in self.special for part in parts))
            else:
                cut.append(self.pre_tokens(text))
                n_special.append(0)
        if len(self.rest) > CACHE_PIECES:
            self.rest = {}
        rest, whole = self.rest, self.whole
        new = list(set(chain.from_iterable(cut)).difference(rest, whole))
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            rest.update(zip(some, map(len, self.library.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        size = lambda p: whole.get(p) or rest[p]
        return [n + sum(map(size, pieces)) for n, pieces in zip(n_special, cut, strict=True)]


@functools.cache
def id_encoder(path: str, by_rank: bool = False) -> IdEncoder:
    """One encoder for each Python worker, which Spark uses for many tasks. The driver proves ``by_rank`` once."""
    return IdEncoder(path, by_rank)


@functools.cache
def whole_tokens(path: str) -> WholeTokens:
    return WholeTokens(path)


def chunks(batches: Iterator[pa.RecordBatch], n: int = _CHUNK) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, n):
            yield batch.slice(i, n)


def count_tokens(
    documents: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    limit: int = 1024,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; one row per input row, no shuffle.

    A null text counts as empty: no bytes, no tokens. Very long texts are counted whole; an empty table gives no rows. Ids may be
    null or repeated. Further columns are ignored.
    """
    path = tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = whole_tokens(path)
        for batch in chunks(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n]),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = only(documents, doc_id=doc_id, text=text)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))
