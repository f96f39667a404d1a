"""Scoped aliases: stable names for private values inside a scope, their restoration, query-time references, and provenance of what went public."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietlake.functions import spans
from quietlake.functions.text import hmac_sha256, mask_prefix
from quietlake.operators.audit import ALIAS

#: Scopes from narrow to wide, and the column that names a scope's instance.
SCOPES = {"turn": "turn_id", "session": "session_id", "task": "task_id", "persistent": None}
LOCAL = "local-only"

PROVENANCE = (
    "record_id string, user_id string, source_message_id string, source_item_index long, policy_version string, route_action string, rule_id string, privacy_level string, privacy_type string, representation_type string, "
    "public_text string, alias_scope string, scope_id string, created_at string, expires_at string, cloud_memory_ids array<string>, revoked_at string, revocation_reason string"
)


def scope_id(scope: Column) -> Column:
    """The instance of a scope that a row's turn_id, session_id and task_id name; a missing one raises, since an alias must not fall into a wider scope."""
    lost = F.raise_error(F.concat(F.lit("no id for alias scope "), F.coalesce(scope, F.lit("null")))).cast("string")
    out = F.when(scope == "persistent", "persistent")
    for name, column in SCOPES.items():
        if column:
            out = out.when((scope == name) & (F.coalesce(column, F.lit("")) != ""), F.col(column))
    return out.otherwise(lost)


def namespace(scope: Column) -> Column:
    return F.concat_ws(":", F.col("user_id"), scope, scope_id(scope))


def local_namespace(user: Column) -> Column:
    return F.concat_ws(":", user, F.lit(LOCAL))


def merge_store(store: DataFrame | None, items: DataFrame, key: bytes, typed: bool = True) -> DataFrame:
    """A store with the items' values: namespace, original_text, privacy_type, privacy_level, seq, fingerprint, mask.

    ``items``: namespace, original_text, privacy_type, privacy_level, seen (any order). A value that a namespace has keeps its row, and its level only ever
    rises; new values follow with the next numbers of their type, in order of first sight. One join by value, no row is ever lost.
    """
    names = ["namespace", "original_text", "privacy_type"]
    fresh = items.groupBy(*names).agg(F.max("privacy_level").alias("new_level"), F.min("seen").alias("seen"))
    if store is None:
        joined = fresh.withColumns(
            {
                "privacy_level": F.lit(None).cast("string"),
                "seq": F.lit(None).cast("long"),
                "fingerprint": F.lit(None).cast("string"),
                "mask": F.lit(None).cast("string"),
            }
        )
        last = fresh.select("namespace", "privacy_type").distinct().withColumn("last", F.lit(0).cast("long"))
    else:
        joined = store.join(fresh, names, "full")
        last = store.groupBy("namespace", "privacy_type").agg(F.max("seq").alias("last"))
    joined = joined.join(last, ["namespace", "privacy_type"], "left").withColumn("fresh", F.col("seq").isNull())
    place = F.row_number().over(Window.partitionBy("namespace", "privacy_type", "fresh").orderBy("seen", "original_text"))
    rows = joined.withColumn("seq", F.coalesce("seq", F.coalesce("last", F.lit(0)) + place))
    rows = rows.withColumn("fingerprint", F.coalesce("fingerprint", hmac_sha256(key, F.concat_ws("\0", "namespace", "original_text"))))
    prefix = mask_prefix(F.col("privacy_type")) if typed else F.lit("Private")
    made = F.concat(
        F.lit("<MPM_"),
        prefix,
        F.lit("_"),
        F.col("seq").cast("string"),
        F.lit("_"),
        F.left("fingerprint", F.lit(12)),
        F.lit(">"),
    )
    level = F.greatest("privacy_level", "new_level")
    return rows.select(*names, level.alias("privacy_level"), "seq", "fingerprint", F.coalesce("mask", made).alias("mask"))


def store_local(store: DataFrame | None, items: DataFrame, key: bytes) -> DataFrame:
    """``items``: user_id, original_text, privacy_type, privacy_level, seen. Their values in each user's local namespace."""
    return merge_store(store, items.withColumn("namespace", local_namespace(F.col("user_id"))), key)


def query_local(store: DataFrame, kind: Column | None = None) -> DataFrame:
    """user_id and rows of the local namespaces, of one type if asked."""
    rows = store.where(F.col("namespace").endswith(f":{LOCAL}"))
    rows = rows.withColumn("user_id", F.left("namespace", F.length("namespace") - len(LOCAL) - 1))
    return rows if kind is None else rows.where(F.col("privacy_type") == kind)


def lookup(
    store: DataFrame,
    namespace: str | None = None,
    mask: str | None = None,
    text: str | None = None,
    kind: str | None = None,
    level: str | None = None,
) -> DataFrame:
    """Rows of a store by any of its names; of rows with one text the highest level comes first."""
    rows = store
    for column, value in {
        "namespace": namespace,
        "mask": mask,
        "original_text": text,
        "privacy_type": kind,
        "privacy_level": level,
    }.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc("privacy_level"), "namespace", "privacy_type", "seq")


def migrate(old: DataFrame, namespace: str, key: bytes) -> DataFrame:
    """An older table (original_text, privacy_type, privacy_level, mask) as rows of a store: masks and their numbers stay, values get fingerprints; of a value that stands there twice the highest level and the first number count."""
    number = F.coalesce(F.nullif(F.regexp_extract("mask", "_([0-9]+)_[a-f0-9]+>$", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
    rows = old.withColumn("seq", number).groupBy("original_text", "privacy_type").agg(
        F.max("privacy_level").alias("privacy_level"),
        F.min(F.struct("seq", "mask")).alias("m"),
    )
    name = F.lit(namespace)
    return rows.select(
        name.alias("namespace"),
        "original_text",
        "privacy_type",
        "privacy_level",
        F.col("m.seq").alias("seq"),
        hmac_sha256(key, F.concat_ws("\0", name, "original_text")).alias("fingerprint"),
        F.col("m.mask").alias("mask"),
    )


def get_aliases(store: DataFrame | None, items: DataFrame, scope: Column, key: bytes) -> tuple[DataFrame, DataFrame]:
    """The store after, and the items with their alias and scope_id. ``items`` has user_id, the ids of its scopes, the value's columns and seen."""
    rows = items.withColumns({"scope": scope, "scope_id": scope_id(scope), "namespace": namespace(scope)})
    after = merge_store(store, rows, key)
    names = ["namespace", "original_text", "privacy_type"]
    return after, rows.join(after.select(*names, F.col("mask").alias("alias")), names)


def restore(texts: DataFrame, store: DataFrame, extra: Column | None = None) -> DataFrame:
    """``texts``: text_id, user_id, text and the ids of its scopes. Returns text_id and the text with the aliases of its own scopes restored.

    The aliases that a text holds are looked up by an equi-join, in the namespaces of its turn, session, task and user; ``extra`` is an array of further
    (scope, scope_id) structs. Aliases of other scopes stay as they are.
    """
    named = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat_ws(":", "user_id", F.lit(s), c)) if c else F.concat_ws(":", "user_id", F.lit(s), F.lit("persistent")) for s, c in SCOPES.items()]
    own = F.array_compact(F.array(*named))
    if extra is not None:
        own = F.array_union(
            own,
            F.transform(
                F.coalesce(extra, F.array().cast("array<struct<scope:string,scope_id:string>>")),
                lambda e: F.concat_ws(":", F.col("user_id"), e["scope"], e["scope_id"]),
            ),
        )
    held = texts.select(
        "text_id",
        own.alias("own"),
        F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ALIAS), F.lit(0)))).alias("mask"),
    )
    found = held.select("text_id", "mask", F.explode("own").alias("namespace")).join(
        store.select("namespace", "mask", "original_text"),
        ["namespace", "mask"],
    )
    pairs = found.groupBy("text_id").agg(
        F.collect_set(F.struct(F.col("original_text").alias("old"), F.col("mask").alias("new"))).alias("pairs")
    )
    done = F.when(F.col("pairs").isNull(), F.col("text")).otherwise(spans.unmask(F.col("text"), F.col("pairs")))
    return texts.join(pairs, "text_id", "left").select("text_id", done.alias("text"))


#: Fixed value: what stands before the references of a query.
REFERENCES = "\n\nEdge-provided private references follow. Use the aliases verbatim; do not infer their hidden values.\n"


def prepare_queries(queries: DataFrame, store: DataFrame, key: bytes, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """The store after, and query_id, fingerprint, cloud_query, aliases, missing.

    ``queries``: query_id, user_id, task_id, query, required, exact, consented (arrays of types). A required type that is not both asked for exactly and
    consented to raises, and so does a missing task. Of each type the ``most`` highest local values, never of PL4, get aliases of the query's task; queries
    of one task share them. ``missing`` are the required types without a value. The order of types is that of the request.
    """
    asked = F.array_distinct("required")
    refused = F.array_sort(F.filter(asked, lambda t: ~F.array_contains("exact", t) | ~F.array_contains("consented", t)))
    checked = F.when(F.coalesce("task_id", F.lit("")) == "", F.raise_error(F.lit("a task is required")).cast("array<string>")).when(
        F.size(refused) > 0,
        F.raise_error(F.concat(F.lit("not consented: "), F.array_join(refused, ", "))).cast("array<string>"),
    ).otherwise(asked)
    rows = queries.withColumn("asked", checked)
    wanted = rows.select("query_id", "user_id", "task_id", F.posexplode("asked").alias("nth", "privacy_type"))
    rank = F.row_number().over(Window.partitionBy("user_id", "privacy_type").orderBy(F.desc("privacy_level"), "seq", "original_text"))
    own = query_local(store).where("privacy_level <> 'PL4'").withColumn("rank", rank).where(F.col("rank") <= most)
    items = wanted.join(own.select("user_id", "privacy_type", "original_text", "privacy_level", "rank"), ["user_id", "privacy_type"])
    items = items.withColumns(
        {"turn_id": F.lit(None).cast("string"), "session_id": F.lit(None).cast("string"), "seen": F.struct("nth", "rank", "query_id")}
    )
    after, named = get_aliases(store, items, F.lit("task"), key)
    alias = F.struct("nth", "rank", "privacy_type", "privacy_level", "alias", "scope", "scope_id")
    lists = named.groupBy("query_id").agg(F.array_sort(F.collect_list(alias)).alias("l"))
    l = F.coalesce("l", F.array().cast(lists.schema["l"].dataType))
    lines = F.array_join(F.transform(l, lambda a: F.concat(F.lit("- "), a["privacy_type"], F.lit(": "), a["alias"])), "\n")
    out = rows.join(lists, "query_id", "left").select(
        "query_id", "user_id", "task_id", hmac_sha256(key, F.col("query")).alias("fingerprint"), F.concat(
            "query",
            F.when(F.size(l) > 0, F.concat(F.lit(REFERENCES), lines)).otherwise(""),
        ).alias("cloud_query"),
        F.transform(
            l,
            lambda a: F.struct(
                a["privacy_type"].alias("privacy_type"),
                a["privacy_level"].alias("privacy_level"),
                a["alias"].alias("alias"),
                a["scope"].alias("scope"),
                a["scope_id"].alias("scope_id"),
            ),
        ).alias("aliases"),
        F.array_except("asked", F.transform(l, lambda a: a["privacy_type"])).alias("missing"),
    )
    return after, out


def alias_manifest(prepared: DataFrame) -> DataFrame:
    return prepared.select("query_id", F.inline("aliases"))


def provenance_records(items: DataFrame, policy_version: str, created_at: Column) -> DataFrame:
    """Records of ``PROVENANCE`` for compiled items: user_id, message_id, item_index, action, rule_id, privacy_level, privacy_type, representation, public_value, alias_scope, scope_id.

    The record's id follows from its source, so the same run gives the same ids. No private value is in it.
    """
    name = F.sha2(
        F.concat_ws("\0", "user_id", "message_id", F.col("item_index").cast("string"), F.lit(policy_version), "privacy_type"),
        256,
    )
    nothing = F.lit(None).cast("string")
    return items.select(
        F.left(name, F.lit(32)).alias("record_id"), "user_id", F.col("message_id").cast("string").alias("source_message_id"), F.col("item_index").cast("long").alias("source_item_index"), F.lit(policy_version).alias("policy_version"),
        F.col("action").alias("route_action"), "rule_id", "privacy_level", "privacy_type", F.col("representation").alias("representation_type"), F.col("public_value").alias("public_text"), "alias_scope", "scope_id", created_at.alias("created_at"),
        nothing.alias("expires_at"), F.array().cast("array<string>").alias("cloud_memory_ids"), nothing.alias("revoked_at"), nothing.alias("revocation_reason"),
    )


def add_records(table: DataFrame, records: DataFrame) -> DataFrame:
    """The table with the records; a record whose id is there already raises."""
    clash = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("record exists: "), F.col("record_id"))).cast("long")).otherwise(F.col("n"))
    both = table.unionByName(records)
    return both.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("record_id"))).where(clash == 1).drop("n")


def active_records(table: DataFrame, user: Column | None = None) -> DataFrame:
    """Records that nobody revoked, of one user if asked, the oldest first."""
    rows = table.where(F.col("revoked_at").isNull())
    return (rows if user is None else rows.where(F.col("user_id") == user)).orderBy("created_at", "record_id")


def attach_cloud_ids(table: DataFrame, additions: DataFrame) -> DataFrame:
    """Appends cloud ids, each once; ``additions``: record_id, cloud_id. An unknown record raises."""
    more = additions.groupBy("record_id").agg(F.array_sort(F.collect_set("cloud_id")).alias("more"))
    joined = table.join(more, "record_id", "full")
    known = F.when(
        F.col("user_id").isNull(),
        F.raise_error(F.concat(F.lit("unknown record: "), F.col("record_id"))).cast("array<string>"),
    ).otherwise(F.array_union("cloud_memory_ids", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.withColumn("cloud_memory_ids", known).select(table.columns)


def revoke_by_source(table: DataFrame, sources: DataFrame, reason: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """The table after revoking the active records of ``sources`` (user_id, source_message_id), and user_id with the distinct cloud ids to forget, sorted."""
    hit = sources.select("user_id", "source_message_id").distinct().withColumn("hit", F.lit(True))
    joined = table.join(hit, ["user_id", "source_message_id"], "left").withColumn(
        "gone",
        F.coalesce("hit", F.lit(False)) & F.col("revoked_at").isNull(),
    )
    cloud = joined.where("gone").groupBy("user_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("cloud_memory_ids")))).alias("cloud_ids")
    )
    after = joined.withColumns(
        {
            "revoked_at": F.when(F.col("gone"), now).otherwise(F.col("revoked_at")),
            "revocation_reason": F.when(F.col("gone"), F.lit(reason)).otherwise(F.col("revocation_reason")),
        }
    )
    return after.select(table.columns), cloud
