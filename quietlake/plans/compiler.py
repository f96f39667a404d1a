"""Public-memory compilation: from messages and items to minimized public text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlake.functions import spans
from quietlake.functions.text import estimate_tokens, let, normalize_public_text, split_units
from quietlake.operators import aliases, minimize, privacy, selection


#: What becomes of an item that is not abstracted, and the scores of an alias.
REPRESENTATIONS = {"public_reversible": "scoped_reversible_alias", "local_only": "encrypted_local_only", "drop": "dropped"}
ALIAS_UTILITY, ALIAS_LEAKAGE = 1.0, 0.30


@dataclass(frozen=True)
class Plan:
    """What a compilation follows: policy, types that are needed exactly and those consented to, limits of stand-ins, and the minimizer's budget."""

    policy: selection.Policy = selection.Policy()
    required: tuple[str, ...] = ()
    consented: tuple[str, ...] = ()
    tokens: int = 128
    budget: minimize.Budget = minimize.Budget()
    weights: dict[str, float] | None = None


def compile_items(
    messages: DataFrame,
    items: DataFrame,
    plan: Plan = Plan(),
    key: bytes = privacy.TEST_KEY,
    store: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """One row for each different value of a message with what becomes of it, and the alias store after (None where no alias can be needed).

    ``messages``: message_id, user_id, and where aliases are possible turn_id, session_id and task_id. Columns: message_id, user_id, item_index, original_text,
    privacy_type, privacy_level, action, scope, rule_id, representation, public_value, utility, leakage, alias_scope, scope_id.
    """
    kind = F.col("privacy_type")
    required, consented = kind.isin(*plan.required) if plan.required else F.lit(False), kind.isin(*plan.consented) if plan.consented else F.lit(False)
    rows = privacy.best_per_text(items).withColumn("item_index", F.col("pos") if "pos" in items.columns else F.lit(0).cast("long"))
    rows = rows.withColumn("r", plan.policy.route(required, consented)).withColumns(
        {"action": F.col("r.action"), "scope": F.col("r.scope"), "rule_id": F.col("r.rule_id")}
    ).drop("r", "pos")
    made = selection.public_candidates(selection.safe(selection.stand_ins(kind, required), F.col("original_text")))
    rows, options = rows.withColumn("options", F.when(F.col("action") == "public_abstract", made)), F.col("options")
    if plan.weights is None:
        fit = F.filter(options, lambda c: (c["utility"] >= 0.75) & (c["leakage"] <= 0.35) & (estimate_tokens(c["text"], 1) <= plan.tokens))
        order = F.transform(
            fit,
            lambda c: F.struct(
                c["level"].alias("level"),
                c["leakage"].alias("leakage"),
                c["text"].alias("text"),
                c["representation"].alias("representation"),
                c["utility"].alias("utility"),
            ),
        )
        choice = F.array_min(order)
    else:
        choice = selection.decide(
            options,
            F.col("original_text"),
            F.col("privacy_level"),
            plan.weights,
            selection.Limits(tokens=plan.tokens),
        )
    rows = rows.withColumn("c", F.when(F.col("action") == "public_abstract", choice))
    found = F.filter(options, lambda c: (c["text"] == F.col("c.text")) & (c["representation"] == F.col("c.representation")))
    chosen = F.get(found, F.lit(0))
    names = ["message_id", "user_id", "item_index", "original_text", "privacy_type", "privacy_level", "action", "scope", "rule_id"]
    named = F.when(F.col("action") == "public_abstract", F.coalesce("c.representation", F.lit("budget_rejected")))
    for action, name in REPRESENTATIONS.items():
        named = named.when(F.col("action") == action, name)
    reversible = F.col("action") == "public_reversible"
    rows = rows.select(
        *names,
        named.alias("representation"),
        F.col("c.text").alias("public_value"),
        F.when(reversible, ALIAS_UTILITY).otherwise(F.coalesce(chosen["utility"], F.lit(0.0))).alias("utility"),
        F.when(reversible, ALIAS_LEAKAGE).otherwise(F.coalesce(chosen["leakage"], F.lit(0.0))).alias("leakage"),
    )
    possible = bool(set(plan.required) & set(plan.consented)) or any(action == "public_reversible" for action, _ in [*plan.policy.levels.values(), *plan.policy.types.values()])
    if not possible:
        return rows.withColumns({"alias_scope": F.lit(None).cast("string"), "scope_id": F.lit(None).cast("string")}), store
    ids = messages.select("message_id", "turn_id", "session_id", "task_id")
    asked = rows.where("action = 'public_reversible'").join(ids, "message_id").withColumn("seen", F.struct("message_id", "item_index"))
    after, named_rows = aliases.get_aliases(store, asked, F.col("scope"), key)
    alias = named_rows.select("message_id", "original_text", "alias", F.col("scope").alias("alias_scope"), "scope_id")
    rows = rows.join(alias, ["message_id", "original_text"], "left").withColumn(
        "public_value",
        F.coalesce("alias", "public_value"),
    ).drop("alias")
    return rows, after


def replaced(messages: DataFrame, compiled: DataFrame) -> DataFrame:
    """message_id, user_id, role, content, text, protected: public values in place of private ones, sentences around dropped and local values deleted.

    Values that overlap a deletion go with it. ``protected`` are the message's public values.
    """
    gone = F.col("action").isin("drop", "local_only")
    own = compiled.select(
        "message_id",
        F.struct(
            F.col("original_text").alias("old"),
            F.when(gone, "").otherwise(F.coalesce("public_value", F.lit(""))).alias("new"),
            gone.alias("drop"),
        ).alias("p"),
    )
    rows = messages.join(own.groupBy("message_id").agg(F.collect_list("p").alias("pairs")), "message_id", "left")
    text = F.col("content")

    def widen(s):
        start = F.when(s["drop"], spans.sentence_start(text, s["start"])).otherwise(s["start"]).cast("int")
        stop = F.when(s["drop"], spans.sentence_stop(text, s["stop"])).otherwise(s["stop"]).cast("int")
        return F.struct(start.alias("start"), stop.alias("stop"), s["new"].alias("new"), s["drop"].alias("drop"))

    public = let(F.transform(spans.all_spans(text, F.col("pairs")), widen), lambda x: spans.rebuild(text, spans.merge_deletions(x)))
    shown = F.transform(
        F.filter(F.coalesce("pairs", F.array().cast("array<struct<old:string,new:string,drop:boolean>>")), lambda p: p["new"] != ""),
        lambda p: p["new"],
    )
    return rows.select(
        "message_id",
        "user_id",
        "role",
        "content",
        normalize_public_text(F.when(F.col("pairs").isNull(), text).otherwise(public)).alias("text"),
        shown.alias("protected"),
    )


def compile_messages(messages: DataFrame, compiled: DataFrame, budget: minimize.Budget = minimize.Budget()) -> DataFrame:
    """message_id, user_id, public_text, source_tokens, public_tokens: one row for each message. No Python in the plan."""
    rows = replaced(messages, compiled)
    kept = minimize.minimize(F.coalesce("text", F.lit("")), F.coalesce("role", F.lit("user")), F.col("protected"), budget)
    done = rows.select(
        "message_id",
        "user_id",
        normalize_public_text(kept).alias("public_text"),
        estimate_tokens(F.col("content"), 1).alias("source_tokens"),
    )
    return done.withColumn(
        "public_tokens",
        F.when(F.col("public_text") == "", F.lit(0).cast("long")).otherwise(estimate_tokens(F.col("public_text"), 1)),
    )


def compile_public(messages: DataFrame, items: DataFrame, budget: minimize.Budget = minimize.Budget()) -> DataFrame:
    """message_id, public_text, source_tokens, public_tokens under the default policy."""
    return compile_messages(messages, compile_items(messages, items)[0], budget).drop("user_id")


#: Words that tell nothing of a person.
RESIDUAL_STOPWORDS = ["this", "that", "with", "from", "have", "will", "your", "我的", "你的", "我们", "这个", "那个"]


def residual_terms(items: DataFrame) -> DataFrame:
    """user_id, term: values of four characters or more and their telling parts, of all of a user's items of levels PL2 to PL4."""
    value = F.btrim("original_text")
    parts = F.transform(
        F.regexp_extract_all(value, F.lit(r"[A-Za-z][A-Za-z0-9_@.-]{3,}|[0-9]{4,}|[一-鿿]{2,}"), F.lit(0)),
        lambda t: F.btrim(t, F.lit(".,;:!?()[]{}<>，。；：！？（）【】")),
    )
    telling = F.filter(parts, lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(RESIDUAL_STOPWORDS))
    own = F.concat(F.when(F.length(value) >= 4, F.array(value)).otherwise(F.array().cast("array<string>")), telling)
    return items.where(F.col("privacy_level").isin(privacy.LEVELS)).select("user_id", F.explode(own).alias("term")).distinct()


def scrub_residual(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Drops every sentence that holds one of the user's terms. ``rows``: message_id, user_id, text; ``terms``: user_id, term.

    Terms reach only the messages that they stand in, so a message carries its own few and no user's terms are gathered. Texts of users
    without terms stay as they are; others are split into sentences anew even where nothing goes.
    """
    hits = privacy.contains_join(
        rows,
        terms,
        "user_id",
        ["message_id"],
        "text",
        "term",
    ).groupBy("message_id").agg(F.collect_set("term").alias("own"))
    users = terms.select("user_id").distinct().withColumn("known", F.lit(True))
    joined = rows.join(hits, "message_id", "left").join(users, "user_id", "left")
    units = split_units(F.col("text"), by_line=False)
    kept = F.filter(units, lambda u: ~F.coalesce(F.exists("own", lambda t: u.contains(t)), F.lit(False)))
    return joined.select(
        "message_id",
        F.when(F.col("known").isNull() | (F.col("text") == ""), F.col("text")).otherwise(F.array_join(kept, " ")).alias("text"),
    )
