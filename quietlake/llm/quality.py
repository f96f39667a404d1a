"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit
per rule; a policy is a versioned mask over those bits, so verdicts of any policy and the effect of
leaving a rule out come from the ledger by integer operations, without reading a text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_WS, let, only, read_table

_SPLIT = "[ \\x09-\\x0D]+"
_SYMBOLS = "#*$%&|<>"

#: Rule name -> predicate over the measurements that is true where a document fails. The position in
#: this list is the rule's bit; new rules go to the end so that stored ledgers stay valid.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars > 16 * n_words or word_chars < 2 * n_words"),
    ("shouting", "2 * n_exclaims > n_words"),
    ("empty", "n_words = 0"),
]
BIT = {name: i for i, (name, _) in enumerate(RULES)}
BASE_RULES = ("few_words", "repeated_words")

#: Version -> the rules it enforces. ``v2`` lets short documents pass: of the labelled ones that fail ``few_words`` alone, none is of poor quality.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE_RULES,
    "v1": (*BASE_RULES, "symbols", "duplicate_lines", "word_length", "shouting"),
    "v2": ("repeated_words", "symbols", "duplicate_lines", "word_length", "shouting", "empty"),
}


def policy_mask(version: str) -> int:
    return sum(1 << BIT[name] for name in POLICIES[version])


def _removed(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c))
    return text


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, from the array of window hashes.

    Windows are sorted with their places; a window equal to a neighbour is repeated. Their places,
    sorted again, each add the words up to the next place, three at most.
    """

    def places(s: Column) -> Column:
        same = lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))
        return F.sort_array(F.filter(F.transform(s, lambda x, i: F.when(same(x, i), x["p"])), lambda p: p.isNotNull()))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.sort_array(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(0), F.size(hashes) - 1).alias("p")))
    return let(pairs, lambda s: let(places(s), covered))


def measure(text: Column) -> Column:
    """Struct of a text's measurements. A null text measures as an empty one."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(ASCII_WS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPLIT))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(ASCII_WS)) != "")

    def of_words(w: Column) -> Column:
        n = F.size(w) - 2
        windows = F.transform(F.arrays_zip(F.slice(w, 1, n), F.slice(w, 2, n), F.slice(w, 3, n)), lambda x: F.xxhash64(x))
        repeat = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_repeat_words(h)))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.when(n > 0, repeat).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        )

    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    size = F.length(text)
    return F.struct(
        let(words, of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.length(_removed(text, ASCII_WS)).cast("long").alias("word_chars"),
        (size - F.length(_removed(text, _SYMBOLS))).cast("long").alias("n_symbols"),
        (size - F.length(_removed(text, "!"))).cast("long").alias("n_exclaims"),
    )


def _bits() -> Column:
    return sum((F.expr(f"({rule})").cast("long") * F.lit(1 << i) for i, (_, rule) in enumerate(RULES)), F.lit(0).cast("long"))


def keep_documents(documents: DataFrame, version: str = "v1", text: str = "text") -> DataFrame:
    """The input's rows, all columns, that a policy version keeps.

    Null and empty texts have zero words. Texts are measured whole; repeated rows and null ids pass or go like any others; further columns pass
    through whatever their names; an empty table gives an empty one. No shuffle.
    """
    rows = documents.select(F.struct("*").alias("row"), measure(documents[f"`{text}`"]).alias("m"))
    rows = rows.select("row", "m.w.*", "m.l.*", "m.word_chars", "m.n_symbols", "m.n_exclaims").withColumn("fail_bits", _bits())
    return apply_policy(rows, version).where("kept").select("row.*")


def ledger(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, all measurements and ``fail_bits``; one row per input row.

    Null and empty texts have zero words and so fail ``few_words``. Null ids and repeated rows pass
    through unchanged; further columns of the input are ignored. No shuffle.
    """
    rows = only(documents, doc_id=doc_id, text=text).select("doc_id", measure(F.col("text")).alias("m"))
    rows = rows.select(
        "doc_id",
        "m.w.n_words",
        "m.word_chars",
        "m.n_symbols",
        "m.l.n_dup_lines",
        "m.w.n_repeat_words",
        "m.l.n_lines",
        "m.n_exclaims",
    )
    return rows.withColumn("fail_bits", _bits())


def apply_policy(rows: DataFrame, version: str = "v1") -> DataFrame:
    """Adds ``base_failed`` and ``kept`` under a policy version."""
    base = F.lit(policy_mask("base")).cast("long")
    return rows.withColumns(
        {
            "base_failed": F.col("fail_bits").bitwiseAND(base) != 0,
            "kept": F.col("fail_bits").bitwiseAND(F.lit(policy_mask(version)).cast("long")) == 0,
        }
    )


def ablation(rows: DataFrame, version: str = "v1") -> DataFrame:
    """Per rule of a policy: documents that fail it, and documents that only this rule rejects.

    The ledger is first counted by its bit patterns (2^rules groups at most), all else is bitwise.
    """
    mask = F.lit(policy_mask(version)).cast("long")
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(
        F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << BIT[name]).cast("long").alias("bit")) for name in POLICIES[version]])
    )
    x = patterns.select("bits", "n", rules.alias("r"))
    hit = x.bits.bitwiseAND(x.r.bit) != 0
    return x.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, x.n).otherwise(0)).alias("n_failed"),
        F.sum(F.when(x.bits == x.r.bit, x.n).otherwise(0)).alias("n_only"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(read_table(spark, sf_dir, "documents")), "v1")
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "fail_bits",
        "n_lines",
        "n_exclaims",
    )
