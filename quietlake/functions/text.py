"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is an ASCII word run (in Java's patterns ``\w`` is no more than that, and is faster than its ranges) or a single other character.
TOKEN = r"\w+|[^\x00-\x7F]"
#: Words that carry no answer.
STOPWORDS = [
    "the",
    "a",
    "an",
    "and",
    "or",
    "to",
    "of",
    "in",
    "is",
    "was",
    "it",
    "for",
    "on",
    "what",
    "how",
    "when",
    "where",
    "who",
    "which",
]
_STRIP = r"(?U)^\s+|\s+$"


def let(value: Column, body) -> Column:
    """Binds an expression once for use in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def estimate_tokens(text: Column, least: int = 0) -> Column:
    n = F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)))
    return F.greatest(F.lit(least), n).cast("long")


def normalize_public_text(text: Column) -> Column:
    """Collapses blanks, pulls punctuation to its word, keeps at most one empty line, strips. The patterns are fixed values."""
    text = F.regexp_replace(text, r" [ \t]+|\t[ \t]*", " ")
    text = F.regexp_replace(text, " ([,.;:!?，。；：！？])", "$1")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), _STRIP, "")


def split_units(text: Column, by_line: bool = True) -> Column:
    """Sentences with their closing quotes; without ``by_line`` a stretch that meets a line end before a terminator is lost."""
    pattern = F.lit("(?dU).+?(?:[.!?。！？；;]+[\"'”’]*|$)(?:\\s+|$)")
    ends = "[.!?。！？；;][\"'”’]*$"
    of = lambda x: F.filter(F.transform(F.regexp_extract_all(x, pattern, F.lit(0)), lambda u: F.regexp_replace(u, _STRIP, "")), lambda u: u != "")
    if by_line:
        return F.flatten(F.transform(F.split(text, "\r\n|[\n\r\\x0B\f\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"), of))
    # Line by line as well, since one pattern over the whole text would try every place of a lost stretch anew.
    whole = lambda units, last: F.when(last | (F.size(units) == 0) | F.element_at(units, F.greatest(F.size(units), F.lit(1))).rlike(ends), units).otherwise(F.slice(units, 1, F.greatest(F.size(units) - 1, F.lit(0))))
    return let(
        F.split(text, "\n"),
        lambda lines: F.flatten(F.transform(lines, lambda x, i: let(of(x), lambda units: whole(units, i == F.size(lines) - 1)))),
    )


def utility_tokens(text: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))), F.array(*map(F.lit, STOPWORDS)))


def attack_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z_][a-z0-9_]+|[0-9]{2,}|[一-鿿]+"), F.lit(0))


def mixed_tokenize(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[぀-ヿ一-鿿]|[^\s぀-ヿ一-鿿]+"), F.lit(0))


def normalize_type(kind: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(kind, "[_-]+", " ")))


def mask_prefix(kind: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(kind, "[^A-Za-z0-9]+", "_"), F.lit("_")), F.lit("")), F.lit("Privacy"))


def private_fragments(value: Column) -> Column:
    """Parts of a value, four characters or more, that must not show in public text. The patterns are fixed values."""
    trimmed = lambda t: F.btrim(t, F.lit(".,;:!?()[]{}<>，。；：！？（）【】"))
    after = lambda t: F.substring(t, F.instr(t, "@") + 1, F.length(t))

    def every(value: Column, tokens: Column) -> Column:
        mails = F.filter(tokens, lambda t: t.contains("@"))
        halves = F.transform(mails, lambda t: F.concat(F.array(F.split_part(t, F.lit("@"), F.lit(1)), after(t)), F.split(after(t), "\\.")))
        digits = lambda d: F.concat(F.array(value), tokens, F.flatten(halves), F.array(d, F.right(d, F.lit(4))))
        return F.array_sort(F.array_distinct(F.filter(let(F.regexp_replace(value, "[^0-9]+", ""), digits), lambda x: F.length(x) >= 4)))

    def of(value: Column) -> Column:
        tokens = F.transform(F.regexp_extract_all(value, F.lit("[A-Za-z0-9][A-Za-z0-9_@.+-]{2,}"), F.lit(0)), trimmed)
        return let(tokens, lambda own: every(value, own))

    return let(F.regexp_replace(value, _STRIP, ""), of)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC of a string. The key is part of the plan: for tests and derived, non-secret keys."""
    block = key.ljust(64, b"\0")
    pad = lambda b: F.lit(bytes(x ^ b for x in block))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "utf-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def has_boundary(text: Column, at: Column, length: Column) -> Column:
    """Whether neither neighbour of the span is a letter or digit; ``at`` counts from 1."""
    before = F.when(at > 1, F.substring(text, at - 1, F.lit(1))).otherwise("")
    return ~before.rlike(r"[\p{L}\p{N}]") & ~F.substring(text, at + length, F.lit(1)).rlike(r"[\p{L}\p{N}]")
