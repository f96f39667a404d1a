"""Dialogue datasets in JSON lines, their checks, and the tables behind the named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlake.functions.checks import missing
from quietlake.operators.audit import with_sum_before

_ITEM = "array<struct<original_text: string, privacy_type: string, privacy_level: string>>"
SCHEMA = f"uuid string, metadata struct<user_name: string, language: string>, dialogues array<struct<role: string, date: string, content: string, privacy_info: {_ITEM}, privacy_info_llm: {_ITEM}>>, questions array<struct<question: string, answer: string, evidence: string, all_options: array<string>, question_type: string>>"
REQUIRED = ["dialogues", "questions", "uuid"]
FORBIDDEN = [
    "privacy_info",
    "privacy_info_llm",
    "source_fingerprint",
    "source_message_id",
    "source_item_index",
    "scope_id",
    "provenance_id",
    "items",
]


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """Users of a JSON-lines file; blank lines are skipped, lines that are no JSON keep their text in ``bad_line``."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", SCHEMA).alias("u"), "value")
    return parsed.select("u.*", F.when(F.col("u.uuid").isNull(), F.col("value")).alias("bad_line"))


def read_messages(users: DataFrame, annotation: str = "privacy_info") -> DataFrame:
    rows = users.select(F.col("uuid").alias("user_id"), F.posexplode("dialogues").alias("message_index", "d"))
    return rows.select(
        "user_id",
        F.concat_ws(":", "user_id", "message_index").alias("message_id"),
        F.col("message_index").cast("long").alias("message_index"),
        F.coalesce("d.role", F.lit("user")).alias("role"),
        "d.date",
        F.coalesce("d.content", F.lit("")).alias("content"),
        F.col(f"d.{annotation}").alias("items"),
    )


def write_users(messages: DataFrame, path: str) -> None:
    """Public messages nested again by user, in order of their indexes."""
    nested = messages.groupBy(F.col("user_id").alias("uuid")).agg(
        F.array_sort(F.collect_list(F.struct("message_index", "role", "content"))).alias("dialogues")
    )
    nested.write.json(path)


def round_robin(lines: DataFrame, order: str, n: int) -> DataFrame:
    """Line i, from 0 in the unique order, goes to shard i mod n."""
    placed = with_sum_before(lines.withColumn("one", F.lit(1).cast("long")), order, "one", "i")
    return placed.withColumn("shard", F.pmod(F.col("i"), F.lit(n)).cast("int")).drop("one", "i")


def dataset_issues(messages: DataFrame) -> DataFrame:
    """Empty spans, and spans that do not stand in their message."""
    rows = messages.select("message_id", "content", F.posexplode("items").alias("pos", "i"))
    issue = F.when(
        F.coalesce(F.trim("i.original_text"), F.lit("")) == "",
        "empty_span",
    ).when(~F.col("content").contains(F.col("i.original_text")), "missing_span")
    return rows.withColumn("issue", issue).where("issue is not null").select("message_id", "pos", "issue")


def cloud_safe_issues(lines: DataFrame) -> DataFrame:
    """line_no, issue: what speaks against a JSON-lines file being public. ``lines``: line_no, value; blank lines don't count, a file without users is an issue of line 0.

    A user must be JSON, have the required keys, an anonymous uuid, an object as metadata with an anonymous user_name if any, no private key at any depth,
    and dialogues that are objects with a content and questions that are objects.
    """
    rows = lines.where(F.btrim("value", F.lit(" \t\r\n\x0b\x0c")) != "")
    v = F.try_parse_json("value")
    text = lambda path: F.try_variant_get("v", path, "string")
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    users = rows.withColumn("v", v).withColumn("object", kind(F.col("v")).startswith("OBJECT"))
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    lacking = missing(REQUIRED, keys)
    meta = F.try_variant_get("v", "$.metadata", "variant")
    name = F.coalesce(text("$.metadata.user_name"), F.lit(""))
    raw = F.array_compact(F.array(*[F.when(F.col("value").rlike(f'"{k}"\\s*:'), F.lit(f"raw key {k}")) for k in FORBIDDEN]))
    whole = F.array_compact(
        F.array(
            F.when(F.size(lacking) > 0, F.concat(F.lit("missing keys "), F.array_join(lacking, ","))),
            F.when(~F.coalesce(text("$.uuid"), F.lit("")).startswith("User-"), "uuid is not anonymous"),
            F.when(
                F.array_contains(keys, "metadata") & ~kind(meta).startswith("OBJECT"),
                "metadata is no object",
            ).when((name != "") & ~name.startswith("User-"), "user_name is not anonymous"),
        )
    )
    of_line = users.select(
        "line_no",
        F.explode(F.when(~F.col("object"), F.array(F.lit("invalid JSON"))).otherwise(F.concat(whole, raw))).alias("issue"),
    )

    def parts(field: str) -> DataFrame:
        return users.where("object").select("line_no", F.posexplode(F.try_variant_get("v", f"$.{field}", "array<variant>")).alias("i", "e"))

    at = lambda field, what: F.concat(F.lit(f"{field}["), F.col("i").cast("string"), F.lit(f"] {what}"))
    turns = parts("dialogues").withColumn(
        "issue",
        F.when(~kind(F.col("e")).startswith("OBJECT"), at("dialogues", "is no object")).when(
            F.try_variant_get("e", "$.content", "variant").isNull(),
            at("dialogues", "has no content"),
        ),
    )
    asked = parts("questions").withColumn("issue", F.when(~kind(F.col("e")).startswith("OBJECT"), at("questions", "is no object")))
    nobody = users.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit(0).cast("long").alias("line_no"),
        F.lit("no users").alias("issue"),
    )
    out = of_line
    for more in (turns, asked):
        out = out.union(more.where(F.col("issue").isNotNull()).select("line_no", "issue"))
    return out.union(nobody)


def guard_unmasked(lines: DataFrame, masked: bool, override: bool = False) -> int | None:
    """The number of issues, 0, of a file that may go out unmasked; None where it is masked or somebody said so. Else raises and names the first ten."""
    if masked or override:
        return None
    found = cloud_safe_issues(lines)
    if first := found.orderBy("line_no", "issue").limit(10).collect():
        raise ValueError("not safe to go out unmasked: " + "; ".join(f"line {r.line_no}: {r.issue}" for r in first))
    return 0


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(
        F.col("doc_id").alias("message_id"),
        F.col("source").alias("user_id"),
        F.lit("user").alias("role"),
        F.coalesce("text", F.lit("")).alias("content"),
    )
