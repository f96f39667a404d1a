"""Dialogue chunks and buckets, retrieval, budgets, training tables, provenance."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from quietlake.functions.text import estimate_tokens
from quietlake.operators import nearest
from quietlake.sources.files import scratch

#: Queries of a search that are broadcast at a time, pairs that make another task worth while (half a second's work), and the most tasks.
BLOCK, PAIRS, PARTS = 10_000, 50_000_000, 64

GATES = [
    ("builtin_audit_failed", "not coalesce(audit_passed, false)"),
    ("cloud_audit_failed", "not coalesce(cloud_audit_passed, true)"),
    ("adversarial_audit_failed", "not coalesce(adversarial_passed, true)"),
    ("exact_recovery_over_budget", "coalesce(exact_recovery_rate, 1.0) > 0.0"),
    ("pl4_retention_over_budget", "coalesce(pl4_public_retention_rate, 1.0) > 0.0"),
    ("adversarial_failures_present", "coalesce(adversarial_failure_count, 0) > 0"),
]


def buckets(messages: DataFrame, session: int = 20, task: int = 5) -> DataFrame:
    at = F.col("message_index")
    return messages.withColumns({"session_id": F.floor(at / session), "task_id": F.floor(at / task)})


def chunk_turns(turns: DataFrame, n: int = 5) -> DataFrame:
    """``turns``: conv_id, turn, role, text. Pairs (2i, 2i+1) in chunks of n pairs; a lone last message has no partner."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = turns.withColumn("at", at).groupBy("conv_id", F.floor(F.col("at") / 2).alias("pair")).agg(
        F.max(F.when(F.col("at") % 2 == 0, F.col("text"))).alias("first"),
        F.max(F.when(F.col("at") % 2 == 1, F.col("text"))).alias("second"),
    )
    return rows.withColumn("chunk", F.floor(F.col("pair") / n))


def chunk_dates(turns: DataFrame, n: int = 5) -> DataFrame:
    """conv_id, chunk, date: the first date that is not null among a chunk's user messages. ``turns``: conv_id, turn, role, date."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    own = F.when((F.col("role") == "user") & F.col("date").isNotNull(), F.struct("turn", "date"))
    return turns.withColumn("chunk", F.floor(at / (2 * n))).groupBy("conv_id", "chunk").agg(F.min(own).getField("date").alias("date"))


def score_summary(records: DataFrame, by_type: bool = True) -> DataFrame:
    """total_score, total_valid, total_num, accuracy and accuracy_valid, for each question_type (``Unknown`` if empty) or over all. ``records``: question_type, score, is_valid."""
    kind = F.coalesce(F.nullif("question_type", F.lit("")), F.lit("Unknown")).alias("question_type")
    groups = records.groupBy(kind) if by_type else records.groupBy()
    rows = groups.agg(
        F.coalesce(F.sum(F.coalesce("score", F.lit(0.0))), F.lit(0.0)).alias("total_score"),
        F.count_if(F.coalesce("is_valid", F.lit(False))).alias("total_valid"),
        F.count(F.lit(1)).alias("total_num"),
    )
    share = lambda n: F.coalesce(F.try_divide("total_score", n), F.lit(0.0))
    return rows.withColumns({"accuracy": share("total_num"), "accuracy_valid": share("total_valid")})


def judged(label: Column) -> Column:
    """Struct of score and is_valid for a judge's label: correct, partial, or anything else; null and none are no judgement."""
    low = F.lower(F.btrim(label))
    return F.struct(
        F.when(low == "correct", 1.0).when(low == "partial", 0.5).otherwise(0.0).alias("score"),
        (label.isNotNull() & (low != "none")).alias("is_valid"),
    )


def context_lines(context: Column, most: int = 250) -> Column:
    """The lines of a context that are list entries (``- ``), as many from the first as ``most`` tokens allow."""
    entries = F.filter(F.transform(F.split(context, "\n"), lambda x: F.btrim(x)), lambda x: x.startswith("- "))
    begin = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("full"))

    def step(a: Column, line: Column) -> Column:
        after = a["used"] + estimate_tokens(line)
        fits = ~a["full"] & (after <= most)
        return F.when(
            fits,
            F.struct(F.array_append(a["kept"], line).alias("kept"), after.alias("used"), F.lit(False).alias("full")),
        ).otherwise(F.struct(a["kept"].alias("kept"), a["used"].alias("used"), F.lit(True).alias("full")))

    return F.array_join(F.aggregate(entries, begin, step, lambda a: a["kept"]), "\n")


def neighbours(turns: DataFrame) -> DataFrame:
    """Each turn with the texts of the turn before and after, joined by a bar."""
    window = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-1, 1)
    return turns.select("conv_id", "turn", F.array_join(F.collect_list("text").over(window), "|").alias("context"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(memories: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, vec_id, similarity, rank over all memories, for any number of queries; equal similarities, to nine decimals, go by vec_id. As ``cosine`` has it, rounded.

    Every query meets every memory: the work grows with the product of both, in products of matrices. Queries go to the tasks in blocks of about ``BLOCK``, and each task of
    the memories keeps its own best k of a query before the final ranking. With more than one block each block's best are written to the shared folder, so the driver holds one at a time.
    """
    memories = memories.select("vec_id", "embedding").where("vec_id is not null")
    queries = queries.select("query_id", "query").where("query_id is not null")
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    dealt = memories.repartition(min(PARTS, 1 + memories.count() * n // PAIRS))
    if blocks == 1:
        local = _local(dealt, queries, k)
    else:
        path = scratch(memories.sparkSession, "nearest")
        for i in range(blocks):
            found = _local(dealt, queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), k)
            found.write.mode("append").parquet(path)
        local = memories.sparkSession.read.schema(found.schema).parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("vec_id"))
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _local(memories: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, similarity: what each task of the memories has nearest to the queries, which go to all tasks."""
    import pyarrow as pa

    asked, sink = queries.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, asked.schema) as out:
        out.write_table(asked)
    shared = memories.sparkSession.sparkContext.broadcast((sink.getvalue().to_pybytes(), k))
    kinds = queries.schema["query_id"].dataType, memories.schema["vec_id"].dataType
    schema = pa.schema([("query_id", to_arrow_type(kinds[0])), ("vec_id", to_arrow_type(kinds[1])), ("similarity", pa.float64())])
    return memories.mapInArrow(
        lambda batches: nearest.search(shared.value, batches, schema),
        f"query_id {kinds[0].simpleString()}, vec_id {kinds[1].simpleString()}, similarity double",
    )


def gates(runs: DataFrame) -> DataFrame:
    failed = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in GATES]))
    return runs.withColumn("failed", F.array_join(failed, ","))


def pareto(runs: DataFrame) -> DataFrame:
    """Runs that no other run dominates in utility, local recoverability and public tokens, by budget and tokens.

    Equal runs stand for one another, so different triples are compared. Each task first drops what its own triples dominate, reading them from the best on: a
    triple can only be dominated by one read before it. What is left of all tasks is compared once more.
    """
    goods = ["utility", "local", "public_token_count"]
    rows = runs.withColumns(
        {
            "utility": F.coalesce("utility", F.lit(0.0)),
            "local": F.coalesce("local", F.lit(0.0)),
            "public_token_count": F.coalesce("public_token_count", F.lit(0)),
        }
    )
    points = rows.select(*goods).distinct()

    def frontier(batches):
        import pyarrow as pa

        kept: list[tuple] = []
        for batch in batches:
            kept += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if len(kept) > 1 << 16:
                kept = undominated(kept)
        kept = undominated(kept)
        if kept:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), batch.schema, strict=True)],
                names=goods,
            )

    local = points.mapInArrow(frontier, points.schema)
    best = local.coalesce(1).mapInArrow(frontier, points.schema)
    return rows.join(best, goods).orderBy("max_public_tokens", "public_token_count")


def undominated(points: list[tuple]) -> list[tuple]:
    """(utility, local, tokens) triples that no other one matches in all and beats in one. Read from the best utility on, only the steps of local against tokens are kept."""
    out, steps = [], []
    for u, v, t in sorted(set(points), key=lambda p: (-p[0], -p[1], p[2])):
        at = bisect.bisect_right(steps, (t, float("inf")))
        if at and steps[at - 1][1] >= v:
            continue
        out.append((u, v, t))
        end = at
        while end < len(steps) and steps[end][1] <= v:
            end += 1
        steps[at:end] = [(t, v)]
    return out


def recommend(runs: DataFrame) -> DataFrame:
    """One row: the smallest passing budget, the best one, and how many runs passed."""
    key = F.struct(F.col("utility"), F.col("local"), (-F.col("public_token_count")).alias("t"), (-F.col("max_public_tokens")).alias("b"))
    return gates(runs).where("failed = ''").agg(
        F.min("max_public_tokens").alias("smallest"),
        F.max_by("max_public_tokens", key).alias("best"),
        F.count(F.lit(1)).alias("eligible"),
    )


def distill(examples: DataFrame, min_support: int = 1) -> DataFrame:
    """Templates by type, level and text: mean scores, half-even mean abstraction level, mode of the representation."""
    keys = ["privacy_type", "privacy_level", "text"]
    mode = examples.groupBy(*keys, "representation").agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(
        F.max_by("representation", F.struct("c", "representation")).alias("representation")
    )
    examples = examples.where(F.col("text") != "")
    means = examples.groupBy(*keys).agg(
        F.avg("utility").alias("utility"),
        F.avg("leakage").alias("leakage"),
        F.bround(F.avg("specificity")).cast("long").alias("abstraction_level"),
        F.count(F.lit(1)).alias("support"),
    )
    return means.join(mode, keys).where(F.col("support") >= min_support)


def revoke(provenance: DataFrame, user_id: Column, messages: Column, reason: str) -> DataFrame:
    """The table after revocation: active rows of the user's messages get the reason."""
    hit = (F.col("user_id") == user_id) & messages & F.col("revocation_reason").isNull()
    return provenance.withColumn("revocation_reason", F.when(hit, reason).otherwise(F.col("revocation_reason")))


def attach_cloud_id(provenance: DataFrame, additions: DataFrame) -> DataFrame:
    """Appends cloud ids to records, each once; ``additions``: record_id, cloud_id."""
    more = additions.groupBy("record_id").agg(F.collect_set("cloud_id").alias("more"))
    return provenance.join(more, "record_id", "left").withColumn(
        "cloud_memory_ids",
        F.array_union("cloud_memory_ids", F.coalesce("more", F.array().cast("array<string>"))),
    ).drop("more")
