"""What public memory still answers: questions, the private facts they turn on, and the words of their answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlake.functions.checks import answer_text
from quietlake.functions.text import utility_tokens
from quietlake.operators import audit
from quietlake.operators.privacy import contains_join


def unique_items(items: DataFrame) -> DataFrame:
    """Of a user's items with one text: the highest level, then the smallest type."""
    order = F.struct(F.col("privacy_level").alias("level"), "privacy_type")
    rows = items.where(
        F.coalesce("original_text", F.lit("")) != ""
    ).groupBy("user_id", "original_text", "privacy_level").agg(F.min("privacy_type").alias("privacy_type"))
    return rows.groupBy("user_id", "original_text").agg(F.max(order).alias("m")).select(
        "user_id",
        "original_text",
        F.col("m.level").alias("privacy_level"),
        "m.privacy_type",
    )


def referenced(questions: DataFrame, items: DataFrame) -> DataFrame:
    """user_id, question_id and the unique items whose text stands in the question's answer or evidence. ``questions``: user_id, question_id, answer, evidence, all_options."""
    rows = questions.select(
        "user_id",
        "question_id",
        F.concat_ws("\n", answer_text(F.col("answer"), F.col("all_options")), F.coalesce("evidence", F.lit(""))).alias("body"),
    )
    return contains_join(rows, items, "user_id", ["question_id"], "body", "original_text").drop("body")


def utility_report(questions: DataFrame, items: DataFrame, public: DataFrame, local: DataFrame) -> DataFrame:
    """One row of counts and three rates.

    ``public``: user_id, public_text; ``local``: user_id, privacy_type, original_text of the local store. Recoverability: of the referenced facts below
    PL4, those that the store has under their type. Recall: of the answers' words, without their private facts, those that the user's public
    texts have; words count once per question. Retention: of the PL4 facts, those in the store. The first two are null where nothing counts.
    """
    facts = unique_items(items)
    kept = local.select("user_id", "privacy_type", "original_text").distinct().withColumn("kept", F.lit(1))
    shown = referenced(questions, facts).join(kept, ["user_id", "privacy_type", "original_text"], "left")
    below = F.col("privacy_level") != "PL4"
    of_facts = shown.agg(
        F.count(F.lit(1)).alias("referenced_facts"),
        F.count_distinct("user_id", "question_id").alias("questions_with_facts"),
        F.count_if(below).alias("eligible_facts"),
        F.count_if(below & F.col("kept").isNotNull()).alias("recoverable_facts"),
    )
    own = shown.groupBy("user_id", "question_id").agg(
        F.array_sort(F.collect_set(F.struct((-F.length("original_text")).alias("n"), "original_text"))).alias("own")
    )
    answers = questions.select(
        "user_id",
        "question_id",
        answer_text(F.col("answer"), F.col("all_options")).alias("answer"),
    ).join(own, ["user_id", "question_id"], "left")
    bare = F.when(F.col("own").isNull(), F.col("answer")).otherwise(
        F.aggregate("own", F.col("answer"), lambda t, x: F.replace(t, x["original_text"], F.lit("")))
    )
    words = answers.select("user_id", "question_id", F.explode(utility_tokens(bare)).alias("token"))
    seen = public.select("user_id", F.explode(utility_tokens(F.col("public_text"))).alias("token")).distinct().withColumn("seen", F.lit(1))
    of_words = words.join(seen, ["user_id", "token"], "left").agg(
        F.count(F.lit(1)).alias("answer_tokens"),
        F.count("seen").alias("recovered_tokens"),
    )
    secret = facts.where("privacy_level = 'PL4'").join(kept, ["user_id", "privacy_type", "original_text"], "left").agg(
        F.count(F.lit(1)).alias("pl4_facts"),
        F.count("kept").alias("pl4_kept"),
    )
    row = questions.agg(F.count(F.lit(1)).alias("questions"))
    for part in (of_facts, of_words, secret):
        row = row.join(part, F.lit(True), "cross")
    return row.withColumns(
        {
            "recoverability": audit.optional_rate(F.col("recoverable_facts"), F.col("eligible_facts")),
            "token_recall": audit.optional_rate(F.col("recovered_tokens"), F.col("answer_tokens")),
            "pl4_retention": audit.rate(F.col("pl4_kept"), F.col("pl4_facts")),
        }
    )
