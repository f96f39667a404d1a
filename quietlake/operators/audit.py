"""Leakage and linkability audits, and the attribute attack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietlake.functions.text import attack_tokens
from quietlake.sources.files import materialised, scratch

#: Fixed value: phrases of an injected prompt.
INJECTION = r"(?i)(?:^|[^\p{L}\p{N}_])(?:ignore (?:all )?(?:previous|prior) instructions|reveal (?:the )?(?:system|developer) prompt|system prompt|developer message|exfiltrate|bypass (?:the )?(?:policy|safety)|send .*secret|dump .*memory)(?:[^\p{L}\p{N}_]|$)"
ALIAS = r"<MPM_[A-Za-z0-9_]+_[0-9]+_[a-f0-9]{12}>"


def with_sum_before(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before a row, by unique ``order``.

    Rows are dealt into ranges of the order; each range sums up for itself, and only the ranges' totals, a row for each task, are summed in one place.
    The dealt rows are a table in the shared folder, since ranges come from a sample and would differ if they were drawn twice.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "ranges")
    dealt = rows.select(F.struct("*").alias("row")).repartitionByRange(F.col("row").getField(order)).withColumn("range", F.spark_partition_id())
    dealt.write.parquet(path)
    table = spark.read.schema(dealt.schema).parquet(path).select(
        "row",
        "range",
        F.col("row").getField(order).alias("key"),
        F.col("row").getField(value).alias("part"),
    )
    first = table.groupBy("range").agg(F.sum("part").alias("total"))
    before = first.select(
        "range",
        F.coalesce(F.sum("total").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"),
    )
    inside = F.coalesce(F.sum("part").over(Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return table.withColumn("inside", inside).join(before, "range").select("row.*", (F.col("earlier") + F.col("inside")).alias(name))


def rate(part: Column, whole: Column) -> Column:
    """0.0 on an empty whole."""
    return F.when(whole == 0, 0.0).otherwise(part.cast("double") / F.when(whole != 0, whole))


def optional_rate(part: Column, whole: Column) -> Column:
    """Null on an empty whole: not applicable."""
    return F.when(whole != 0, part.cast("double") / F.when(whole != 0, whole))


def leakage_report(
    records: DataFrame,
    items: DataFrame,
    max_recovery: float = 0.0,
    max_retention: float = 0.0,
    min_reduction: float = 0.0,
) -> DataFrame:
    """One row. ``records``: message_id, public_text, source_tokens, public_tokens; ``items`` of the same messages."""
    joined = items.join(records.select("message_id", "public_text"), "message_id")
    shown = F.col("public_text").contains(F.col("original_text"))
    leak = joined.agg(
        F.count(F.lit(1)).alias("sensitive_items"),
        F.count_if(shown).alias("exact_recovered"),
        F.count_if(F.col("privacy_level") == "PL4").alias("pl4_items"),
        F.count_if((F.col("privacy_level") == "PL4") & shown).alias("pl4_public"),
    )
    size = records.agg(
        F.sum("source_tokens").alias("source_tokens"),
        F.sum("public_tokens").alias("public_tokens"),
        F.avg(
            F.when(F.col("source_tokens") == 0, 0.0).otherwise(1 - F.try_divide("public_tokens", "source_tokens"))
        ).alias("mean_reduction"),
    )
    row = leak.join(size, F.lit(True), "cross").withColumns(
        {
            "recovery_rate": rate(F.col("exact_recovered"), F.col("sensitive_items")),
            "retention_rate": rate(F.col("pl4_public"), F.col("pl4_items")),
            "corpus_reduction": F.when(F.col("source_tokens") > 0, 1 - F.try_divide("public_tokens", "source_tokens")).otherwise(0.0),
        }
    )
    failed = F.array_compact(
        F.array(
            F.when(F.col("recovery_rate") > max_recovery, "exact_recovery"),
            F.when(F.col("retention_rate") > max_retention, "pl4_public_retention"),
            F.when(F.col("corpus_reduction") < min_reduction, "token_reduction"),
        )
    )
    return row.withColumn("failed", F.array_join(failed, ",")).withColumn("passed", F.size(failed) == 0)


def linkability(observations: DataFrame) -> DataFrame:
    """Pairs of observations of one fingerprint in different scopes, and how many of them share an alias.

    ``observations``: fingerprint, scope, alias. Counted from group sizes, so no pairs are made.
    """
    seen = observations.distinct()
    square = lambda c: F.sum(c * (c - 1) / 2)

    def pairs(*keys: str) -> DataFrame:
        return seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(square(F.col("c")), F.lit(0.0)).alias("p"))

    total, scope, alias, both = (pairs(*k).select(F.col("p").alias(n)) for k, n in ((["fingerprint"], "t"), (["fingerprint", "scope"], "s"), (["fingerprint", "alias"], "a"), (["fingerprint", "scope", "alias"], "b")))
    row = total.join(scope, F.lit(True), "cross").join(alias, F.lit(True), "cross").join(both, F.lit(True), "cross")
    return row.select(
        (F.col("t") - F.col("s")).cast("long").alias("cross_scope_pairs"),
        (F.col("a") - F.col("b")).cast("long").alias("linked_pairs"),
    ).withColumn("linkability", optional_rate(F.col("linked_pairs"), F.col("cross_scope_pairs")))


def alias_reuse(strings: DataFrame) -> DataFrame:
    """Aliases at more than one path: a warning each."""
    seen = strings.select(
        "artifact",
        "path",
        F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(ALIAS), F.lit(0)))).alias("alias"),
    )
    return seen.groupBy("alias").agg(F.count_distinct("artifact", "path").alias("places")).where("places > 1")


def split_last(labelled: DataFrame, ratio: float) -> DataFrame:
    """``labelled``: doc_id, label, text. The last k of each class by doc_id are the test set, k at least 1.

    Where a class is cut is found from counts by doc_id alone, over ranges; then each row is told from its own doc_id, and no task has a class's texts.
    Only rows that share the doc_id of a cut which divides them are numbered.
    """
    counts = labelled.where("label is not null").groupBy("label", "doc_id").agg(F.count(F.lit(1)).alias("n")).select(F.struct("label", "doc_id").alias("key"), "n")
    placed = materialised(with_sum_before(counts, "key", "n", "below"), "places")
    size = placed.groupBy("key.label").agg(F.sum("n").alias("size"), F.min("below").alias("start"))
    k = F.least(F.greatest(F.lit(1), F.bround(F.col("size") * ratio)).cast("long"), F.col("size"))
    after = F.col("start") + F.col("size") - F.col("below") - F.col("n")
    cuts = placed.join(F.broadcast(size), F.col("key.label") == F.col("label")).where((after < k) & (k <= after + F.col("n"))).select(
        "label",
        F.col("key.doc_id").alias("cut"),
        (k - after).alias("take"),
        (F.col("n") > k - after).alias("divided"),
    )
    cuts = materialised(cuts, "cuts")
    rows = labelled.join(F.broadcast(cuts), "label")
    # Nulls are the smallest.
    test = F.coalesce(F.col("doc_id") >= F.col("cut"), F.col("cut").isNull())
    if cuts.where("divided").isEmpty():
        return rows.withColumn("test", test).drop("cut", "take", "divided")
    torn = F.col("divided") & F.col("doc_id").eqNullSafe(F.col("cut"))
    at = F.row_number().over(Window.partitionBy("label").orderBy("doc_id"))
    parts = rows.where(~torn).withColumn("test", test), rows.where(torn).withColumn("test", at <= F.col("take"))
    return parts[0].unionByName(parts[1]).drop("cut", "take", "divided")


def token_counts(train: DataFrame) -> DataFrame:
    """token, n0, n1: occurrences in each class."""
    words = train.select("label", F.explode(attack_tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))


def naive_bayes(split: DataFrame) -> DataFrame:
    """doc_id, label, score: probability of class 1 for each test document, add-one smoothing throughout."""
    train, test = split.where(~F.col("test")), split.where("test")
    counts = token_counts(train)
    total = counts.agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.count(F.lit(1)).alias("v"))
    prior = train.agg(F.count_if(F.col("label") == 0).alias("d0"), F.count_if(F.col("label") == 1).alias("d1"))
    model = total.join(prior, F.lit(True), "cross")
    words = test.select(
        "doc_id",
        "label",
        F.explode_outer(attack_tokens(F.col("text"))).alias("token"),
    ).groupBy("doc_id", "label", "token").agg(F.count(F.lit(1)).alias("c"))
    rows = words.join(counts, "token", "left").join(model, F.lit(True), "cross")
    each = lambda k: F.when(F.col("token").isNull(), 0.0).otherwise(F.col("c") * F.ln((F.coalesce(F.col(f"n{k}"), F.lit(0)) + 1.0) / (F.col(f"t{k}") + F.col("v"))))
    sums = rows.groupBy("doc_id", "label").agg(
        F.sum(each(0)).alias("l0"),
        F.sum(each(1)).alias("l1"),
        *[F.first(c).alias(c) for c in ("d0", "d1")],
    )
    logit = lambda k: F.col(f"l{k}") + F.ln((F.col(f"d{k}") + 1.0) / (F.col("d0") + F.col("d1") + 2.0))
    return sums.select("doc_id", "label", (1.0 / (1.0 + F.exp(F.least(logit(0) - logit(1), F.lit(700.0))))).alias("score"))


def auc(scores: DataFrame) -> DataFrame:
    """One row: positives, negatives, auc (null where a class is empty), from mid-ranks."""
    by_score = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("p"))
    ranked = with_sum_before(by_score, "score", "n", "below").withColumn("mid", F.col("below") + (F.col("n") + 1) / F.lit(2.0))
    sums = ranked.agg(
        F.sum("p").alias("positives"),
        F.sum(F.col("n") - F.col("p")).alias("negatives"),
        F.sum(F.col("p") * F.col("mid")).alias("r"),
    )
    area = F.try_divide(
        F.col("r") - F.col("positives") * (F.col("positives") + 1) / F.lit(2.0),
        F.col("positives").cast("double") * F.col("negatives"),
    )
    return sums.select("positives", "negatives", area.alias("auc"))
