"""A whole dialogue dataset compiled to public memory: records, a cloud-safe copy with its questions, local and provenance tables, and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietlake.functions.text import TOKEN, hmac_sha256
from quietlake.operators import aliases, audit, dialogue, privacy, utility
from quietlake.plans import compiler
from quietlake.sources import files

FIELDS = ["question", "answer", "evidence"]


@dataclass
class Compiled:
    """Tables of a run; each is a plan until somebody reads it."""

    records: DataFrame
    items: DataFrame
    sources: DataFrame
    invalid: DataFrame
    known: DataFrame
    local: DataFrame
    provenance: DataFrame
    questions: DataFrame
    users: DataFrame


def user_items(items: DataFrame, users: DataFrame) -> DataFrame:
    """Different values of each user over all messages, and the user's real name. ``users``: user_id, user_name."""
    name = F.btrim("user_name")
    names = users.where(F.coalesce(name, F.lit("")) != "").select(
        "user_id",
        name.alias("original_text"),
        F.lit("Real Name").alias("privacy_type"),
        F.lit("PL2").alias("privacy_level"),
    )
    return privacy.known_items(items).union(names).distinct()


def invalid_annotations(items: DataFrame, valid: DataFrame) -> DataFrame:
    """message_id, invalid: how many of a message's annotations did not pass, repeated ones included."""
    n = lambda d, name: d.groupBy("message_id").agg(F.count(F.lit(1)).alias(name))
    both = n(items, "given").join(n(valid, "good"), "message_id", "left")
    return both.select("message_id", (F.col("given") - F.coalesce("good", F.lit(0))).alias("invalid")).where("invalid > 0")


def scrubbed(compiled: DataFrame, terms: DataFrame) -> DataFrame:
    """Compiled messages without the sentences that hold a residual term of their user; tokens are counted anew where a text changed."""
    compiled = files.materialised(compiled, "compiled")
    text = compiler.scrub_residual(compiled.select("message_id", "user_id", F.col("public_text").alias("text")), terms)
    rows = compiled.join(text, "message_id")
    count = F.size(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).cast("long")
    return rows.withColumn(
        "public_tokens",
        F.when(F.col("text") == F.col("public_text"), F.col("public_tokens")).otherwise(count),
    ).withColumn("public_text", F.col("text")).drop("text")


def with_scopes(messages: DataFrame, per_session: int = 20, per_task: int = 5) -> DataFrame:
    """Adds turn_id, session_id and task_id from a message's place in its dialogue."""
    rows = dialogue.buckets(messages, per_session, per_task)
    name = lambda kind, at: F.concat_ws(":", "user_id", F.lit(kind), F.col(at).cast("string"))
    return rows.withColumns(
        {"turn_id": name("turn", "message_index"), "session_id": name("session", "session_id"), "task_id": name("task", "task_id")}
    )


def question_fields(questions: DataFrame) -> DataFrame:
    """A row for each text of a question: user_id, message_id, field, nth, content, role and the ids of its scopes. ``questions``: user_id, question_index, question, answer, evidence, all_options."""
    one = lambda field, nth, text: F.struct(F.lit(field).alias("field"), nth.alias("nth"), text.alias("content"))
    fields = F.filter(F.array(*[one(f, F.lit(0), F.col(f)) for f in FIELDS]), lambda x: x["content"].isNotNull())
    options = F.transform(
        F.coalesce("all_options", F.array().cast("array<string>")),
        lambda o, i: F.struct(F.lit("option").alias("field"), i.alias("nth"), o.alias("content")),
    )
    rows = questions.select(
        "user_id",
        "question_index",
        F.explode(F.concat(fields, options)).alias("f"),
    ).select("user_id", "question_index", "f.*")
    task = F.concat_ws(":", "user_id", F.lit("question"), F.col("question_index").cast("string"))
    name = F.concat_ws(":", task, F.col("field"), F.when(F.col("field") == "option", F.col("nth").cast("string")))
    rows = rows.withColumns(
        {
            "message_id": name,
            "role": F.lit("user"),
            "turn_id": name,
            "session_id": F.concat_ws(":", "user_id", F.lit("evaluation")),
            "task_id": task,
        }
    )
    return rows.withColumn("content", F.coalesce("content", F.lit("")))


def sanitize_fields(
    fields: DataFrame,
    known: DataFrame,
    plan: compiler.Plan = compiler.Plan(),
    key: bytes = privacy.TEST_KEY,
) -> tuple[DataFrame, DataFrame]:
    """The fields with public_text and tokens, and the private items that stand in them."""
    present = privacy.propagate(known, fields)
    items, _ = compiler.compile_items(fields, present, plan, key)
    done = scrubbed(compiler.compile_messages(fields, items, plan.budget), compiler.residual_terms(known))
    return fields.join(done.drop("user_id"), "message_id"), present


def nested_questions(fields: DataFrame, questions: DataFrame) -> DataFrame:
    """user_id and its questions in order, each with its public fields and options; further columns of a question pass through."""
    rest = [c for c in questions.columns if c not in ("user_id", "question_index", *FIELDS, "all_options")]
    texts = fields.groupBy("user_id", "question_index").agg(
        *[F.max(F.when(F.col("field") == f, F.col("public_text"))).alias(f) for f in FIELDS],
        F.array_sort(F.collect_list(F.when(F.col("field") == "option", F.struct("nth", "public_text")))).alias("options"),
    )
    rows = questions.select(
        "user_id",
        "question_index",
        *rest,
        F.col("all_options").isNotNull().alias("listed"),
    ).join(texts, ["user_id", "question_index"], "left")
    options = F.when(
        F.col("listed"),
        F.transform(F.coalesce("options", F.array().cast(texts.schema["options"].dataType)), lambda o: o["public_text"]),
    )
    one = F.struct("question_index", *rest, *FIELDS, options.alias("all_options"))
    return rows.groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("questions"))


def public_records(
    compiled: DataFrame,
    key: bytes = privacy.TEST_KEY,
    anonymous: bool = True,
    version: str = "minimal-public-v1",
) -> DataFrame:
    """user_id, message_id, public_text, policy_version, source_tokens, public_tokens, token_reduction; ids are keyed fingerprints unless told otherwise."""
    name = lambda prefix, c, n: F.concat(F.lit(prefix), F.left(hmac_sha256(key, F.col(c).cast("string")), F.lit(n))) if anonymous else F.col(c).cast("string")
    saved = F.when(F.col("source_tokens") > 0, 1 - F.try_divide("public_tokens", "source_tokens")).otherwise(0.0)
    return compiled.select(
        name("User-", "user_id", 12).alias("user_id"),
        name("Message-", "message_id", 16).alias("message_id"),
        "public_text",
        F.lit(version).alias("policy_version"),
        "source_tokens",
        "public_tokens",
        saved.alias("token_reduction"),
    )


def compiled_items(
    users: DataFrame,
    messages: DataFrame,
    items: DataFrame,
    plan: compiler.Plan = compiler.Plan(),
    key: bytes = privacy.TEST_KEY,
    per_session: int = 20,
    per_task: int = 5,
) -> tuple[DataFrame, ...]:
    """The first steps of ``compile_dataset``, for what needs no texts: messages kept, items given, valid ones, known values, where they stand, and what becomes of them."""
    kept = with_scopes(messages.where("annotated"), per_session, per_task)
    given = items.join(kept.select("message_id"), "message_id", "left_semi")
    valid = privacy.validate(given, kept)
    known = files.materialised(user_items(valid, users), "known")
    present = files.materialised(privacy.propagate(known, kept), "present")
    compiled, _ = compiler.compile_items(kept, present, plan, key)
    return kept, given, valid, known, present, compiled


def compile_dataset(
    users: DataFrame,
    messages: DataFrame,
    items: DataFrame,
    questions: DataFrame,
    plan: compiler.Plan = compiler.Plan(),
    key: bytes = privacy.TEST_KEY,
    created_at: Column | None = None,
    per_session: int = 20,
    per_task: int = 5,
) -> Compiled:
    """From users, their messages, annotations and questions to public memory.

    ``users``: user_id, user_name, language; ``messages``: user_id, message_id, message_index, role, content and ``annotated`` (false where the annotation asked
    for is missing: such messages stay out); ``items``: message_id, user_id, pos, original_text, privacy_type, privacy_level; ``questions`` as in ``question_fields``.
    Each user's known values are looked for in all of that user's messages and questions. What several results share is written to the shared folder once. Nothing is collected: users with very many messages are rows like any others.
    """
    kept, given, valid, known, present, compiled = compiled_items(users, messages, items, plan, key, per_session, per_task)
    records = files.materialised(
        scrubbed(compiler.compile_messages(kept, compiled, plan.budget), compiler.residual_terms(known)),
        "records",
    )
    stored = compiled.where("action <> 'drop'").withColumn("seen", F.struct("message_id", "item_index"))
    local = aliases.store_local(None, stored.select("user_id", "original_text", "privacy_type", "privacy_level", "seen"), key)
    provenance = aliases.provenance_records(
        compiled,
        plan.policy.version,
        F.current_timestamp().cast("string") if created_at is None else created_at,
    )
    fields, asked = sanitize_fields(question_fields(questions), known, plan, key)
    turns = records.join(kept.select("message_id", "message_index", "role"), "message_id")
    told = turns.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("message_index", "role", F.col("public_text").alias("content")))).alias("dialogues")
    )
    alias = F.concat(F.lit("User-"), F.left(hmac_sha256(key, F.col("user_id")), F.lit(12)))
    safe = users.join(told, "user_id", "left").join(nested_questions(fields, questions), "user_id", "left").select(
        alias.alias("uuid"), F.struct(alias.alias("user_name"), "language").alias("metadata"), F.transform(
            F.coalesce("dialogues", F.array().cast(told.schema["dialogues"].dataType)),
            lambda d: F.struct(d["role"].alias("role"), d["content"].alias("content")),
        ).alias("dialogues"), F.coalesce("questions", F.array()).alias("questions"),
    )
    return Compiled(records, compiled, present, invalid_annotations(given, valid), known, local, provenance, fields, safe)


def dataset_report(c: Compiled, questions: DataFrame) -> DataFrame:
    """One row: records, invalid annotations, route counts, the leakage audit and the utility audit."""
    leak = audit.leakage_report(c.records, c.sources)
    routes = c.items.agg(
        *[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("public_abstract", "public_reversible", "local_only", "drop")]
    )
    asked = questions.select("user_id", F.col("question_index").alias("question_id"), "answer", "evidence", "all_options")
    useful = utility.utility_report(asked, c.known, c.records, aliases.query_local(c.local))
    row = c.records.agg(F.count(F.lit(1)).alias("records"))
    for part in (c.invalid.agg(F.coalesce(F.sum("invalid"), F.lit(0)).alias("invalid_annotations")), routes, leak, useful):
        row = row.join(part, F.lit(True), "cross")
    return row


def representation_counts(items: DataFrame) -> DataFrame:
    """representation, n over compiled items."""
    return items.groupBy("representation").agg(F.count(F.lit(1)).alias("n"))


def write_dataset(c: Compiled, path: str) -> None:
    """Records and the cloud-safe users as JSON lines below a path."""
    public_records(c.records).write.json(f"{path}/records")
    c.users.write.option("ignoreNullFields", "false").json(f"{path}/users")


def budget_sweep(messages: DataFrame, items: DataFrame, budgets: list[int], plan: compiler.Plan = compiler.Plan()) -> DataFrame:
    """A row for each budget of the stand-ins' tokens: records, rejected items, tokens and exact recovery.

    ``budgets`` is a short list of settings; each is a compilation of all messages.
    """
    from dataclasses import replace

    out = None
    for budget in sorted(set(budgets)):
        compiled, _ = compiler.compile_items(messages, items, replace(plan, tokens=budget))
        done = compiler.compile_messages(messages, compiled, plan.budget)
        leak = audit.leakage_report(done, items)
        rejected = compiled.agg(F.count_if(F.col("representation") == "budget_rejected").alias("rejected_items"))
        row = leak.join(rejected, F.lit(True), "cross").select(
            F.lit(budget).cast("long").alias("max_public_tokens"),
            "sensitive_items",
            "exact_recovered",
            "source_tokens",
            "public_tokens",
            "rejected_items",
            F.col("passed").alias("audit_passed"),
        )
        out = row if out is None else out.unionByName(row)
    return out
