"""Memory systems under test: what is written to one, and questions answered from it, with private values masked on the way out and restored at home.

A memory system and an answering model are plug-ins: functions that rows are given to. Everything else is a plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlake.functions import spans
from quietlake.operators import dialogue, privacy


def chunks_to_write(
    turns: DataFrame,
    known: DataFrame,
    store: DataFrame | None,
    n: int = 5,
    levels: list[str] = privacy.LEVELS[1:],
) -> DataFrame:
    """conv_id, chunk, date, text: a conversation's masked turns in chunks of n pairs, a line each, in order.

    ``turns``: conv_id, turn, user_id, role, date, text; ``known``: the users' values. Chunks are independent rows, so users are written in parallel.
    """
    named = turns.withColumns({"message_id": F.concat_ws(":", "conv_id", "turn"), "content": F.coalesce("text", F.lit(""))})
    safe = privacy.protect_known(named.select("message_id", "user_id", "content"), known, store, levels)
    masked = named.join(safe.withColumnRenamed("text", "safe"), "message_id").select(
        "conv_id",
        "turn",
        "role",
        F.concat_ws(": ", "role", "safe").alias("text"),
    )
    pairs = dialogue.chunk_turns(masked, n)
    lines = F.array_join(
        F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.struct("pair", "first", "second"))),
                lambda p: F.array_compact(F.array(p["first"], p["second"])),
            )
        ),
        "\n",
    )
    return pairs.groupBy("conv_id", "chunk").agg(lines.alias("text")).join(
        dialogue.chunk_dates(turns, n),
        ["conv_id", "chunk"],
    ).select("conv_id", "chunk", "date", "text")


def write_chunks(chunks: DataFrame, write: Callable[[Iterator], None]) -> None:
    """Gives every partition's rows to a memory system. A task that runs again writes again, so the system should know a chunk by (conv_id, chunk)."""
    chunks.foreachPartition(write)


def answer_questions(
    questions: DataFrame,
    memories: DataFrame,
    known: DataFrame,
    store: DataFrame,
    respond: Callable[[str, str], str],
    judge: Callable[[str, str], str],
    k: int = 20,
    levels: list[str] = privacy.LEVELS[1:],
) -> DataFrame:
    """question_id, answer, label, score, is_valid.

    ``questions``: question_id, user_id, question, reference, query (its embedding); ``memories``: vec_id, text, embedding. The masked question and its ``k`` nearest
    memories go to ``respond``, the masked answer and reference to ``judge``; only then are masks of the user's values undone in the answer.
    """
    asked = questions.select(
        F.concat_ws(":", F.lit("q"), "question_id").alias("message_id"),
        "user_id",
        F.col("question").alias("content"),
    ).union(questions.select(F.concat_ws(":", F.lit("r"), "question_id"), "user_id", "reference"))
    safe = privacy.protect_known(asked, known, store, levels)
    part = lambda kind, name: safe.where(F.col("message_id").startswith(f"{kind}:")).select(F.substring("message_id", 3, 1 << 20).alias("id"), F.col("text").alias(name))
    near = dialogue.top_k(memories, questions.select(F.col("question_id").alias("query_id"), "query"), k)
    told = near.join(memories.select("vec_id", "text"), "vec_id").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("l")
    )
    context = told.select(
        F.col("query_id").alias("question_id"),
        dialogue.context_lines(F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x["text"])), "\n")).alias("context"),
    )
    rows = questions.select(
        "question_id",
        "user_id",
        F.col("question_id").cast("string").alias("id"),
    ).join(part("q", "question"), "id").join(part("r", "reference"), "id").join(context, "question_id", "left")
    rows = rows.select("question_id", "user_id", "question", "reference", F.coalesce("context", F.lit("")).alias("context"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = [respond(q, c) for q, c in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            labels = [judge(a, r) for a, r in zip(answers, batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(answers, pa.string()), pa.array(labels, pa.string())],
                names=["question_id", "user_id", "answer", "label"],
            )

    kinds = rows.schema
    said = rows.mapInArrow(
        run,
        f"question_id {kinds['question_id'].dataType.simpleString()}, user_id {kinds['user_id'].dataType.simpleString()}, answer string, label string",
    )
    held = said.select(
        "question_id",
        F.col("user_id").alias("namespace"),
        F.explode(
            F.array_distinct(F.regexp_extract_all("answer", F.lit(r"<MPM_[A-Za-z0-9_]+_[0-9]+_[a-f0-9]{12}>"), F.lit(0)))
        ).alias("mask"),
    )
    pairs = held.join(store.select("namespace", "mask", "original_text"), ["namespace", "mask"]).groupBy("question_id").agg(
        F.collect_set(F.struct(F.col("original_text").alias("old"), F.col("mask").alias("new"))).alias("pairs")
    )
    home = F.when(F.col("pairs").isNull(), F.col("answer")).otherwise(spans.unmask(F.col("answer"), F.col("pairs")))
    return said.join(pairs, "question_id", "left").select(
        "question_id",
        home.alias("answer"),
        "label",
        dialogue.judged(F.col("label")).alias("j"),
    ).select("question_id", "answer", "label", "j.*")
