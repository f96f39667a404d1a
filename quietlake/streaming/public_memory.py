"""Public memory from a stream of messages: every micro-batch is compiled like a table, and its values join the local store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlake.operators import aliases, privacy
from quietlake.plans import compiler
from quietlake.sources.files import VersionedTable

MESSAGES = "message_id string, user_id string, role string, content string"
STORE = "namespace string, original_text string, privacy_type string, privacy_level string, seq long, fingerprint string, mask string"


def stream_messages(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """A stream of the JSON-lines files that arrive below a path."""
    return spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", files_at_once).json(path)


def compile_stream(messages: DataFrame, target: str, store: str, checkpoint: str, key: bytes, plan: compiler.Plan = compiler.Plan()):
    """Starts the query: public records go to ``target``/batch=N, local values to the versioned table ``store``.

    A batch that runs again after a failure replaces its own folder, and the store's merge of values that it has already changes nothing.
    A message's values are those found in itself: what later messages reveal of a user doesn't change what was published.
    """
    table = VersionedTable(messages.sparkSession, store)

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.withColumn("content", F.coalesce("content", F.lit("")))
        items = privacy.validate(privacy.detect(rows), rows)
        compiled, _ = compiler.compile_items(rows, items, plan, key)
        compiler.compile_messages(rows, compiled, plan.budget).write.mode("overwrite").parquet(f"{target}/batch={number}")
        stored = compiled.where("action <> 'drop'").withColumn("seen", F.struct("message_id", "item_index"))
        table.save(
            aliases.store_local(table.read(STORE), stored.select("user_id", "original_text", "privacy_type", "privacy_level", "seen"), key)
        )

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
