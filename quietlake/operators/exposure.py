"""What published records give away: signals of the source users, their traces in artifacts, and an attacker that learns an attribute."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietlake.functions.checks import LINKAGE, SEMANTIC, has_part, is_canary, shows_value, type_terms
from quietlake.operators import audit
from quietlake.operators.privacy import contains_join
from quietlake.sources.files import materialised

#: The owner of signals that count for records whose own user is unknown: those of all users.
EVERYONE = "*"


def signals(users: DataFrame, messages: DataFrame, items: DataFrame) -> DataFrame:
    """owner, kind, text, privacy_level, privacy_type, flag of every user and of everyone.

    ``users``: user_id, user_name; ``messages``: user_id, message_index, content; ``items``: user_id, message_index, original_text, privacy_type, privacy_level.
    Kinds: secret, identifier, marker (a message of 24 characters or more; flagged if it is sensitive, the last such message of a user decides),
    canary, and term (a word that a PL3 or PL4 type implies).
    """
    nothing, no = F.lit(None).cast("string"), F.lit(False)
    row = lambda kind, text, level=nothing, type_=nothing, flag=no: [F.col("user_id").alias("owner"), F.lit(kind).alias("kind"), text.alias("text"), level.alias("privacy_level"), type_.alias("privacy_type"), flag.alias("flag")]
    value, level, kind = F.btrim("original_text"), F.col("privacy_level"), F.col("privacy_type")
    own = items.where(F.btrim("original_text") != "")
    content = messages.select("user_id", "message_index", F.btrim("content").alias("content"))
    told = own.join(content, ["user_id", "message_index"]).where(
        F.col("content").contains(value) | level.isin("PL3", "PL4")
    ).select("user_id", "message_index").distinct().withColumn("flag", F.lit(True))
    marked = content.where(F.length("content") >= 24).join(
        told,
        ["user_id", "message_index"],
        "left",
    ).withColumn("flag", F.coalesce("flag", no))
    last = marked.groupBy("user_id", "content").agg(F.max_by("flag", "message_index").alias("flag"))
    found = [
        own.select(*row("secret", value, level, kind)),
        users.select(*row("identifier", F.btrim("user_id"))),
        users.select(*row("identifier", F.btrim("user_name"))),
        last.select(*row("marker", F.col("content"), flag=F.col("flag"))),
        own.where(is_canary(value, kind)).select(*row("canary", value)),
        own.where(level.isin("PL3", "PL4")).withColumn(
            "term",
            F.explode(type_terms(kind, level)),
        ).select(*row("term", F.col("term"), level, kind)),
    ]
    mine = reduce(DataFrame.unionByName, found).where(F.coalesce("text", F.lit("")) != "").distinct()
    others = mine.where("kind <> 'marker'").withColumn("owner", F.lit(EVERYONE)).distinct()
    markers = mine.where("kind = 'marker'").groupBy("kind", "text").agg(F.max_by("flag", "owner").alias("flag")).select(
        F.lit(EVERYONE).alias("owner"),
        "kind",
        "text",
        nothing.alias("privacy_level"),
        nothing.alias("privacy_type"),
        "flag",
    )
    return mine.unionByName(others).unionByName(markers)


def owners(records: DataFrame, sources: DataFrame, lost: Column) -> DataFrame:
    """artifact, identity, owner: the k-th different identity of an artifact, by first line, is the k-th source user; further ones are ``lost``.

    ``records``: artifact, line_no, identity (empty if the record names no user); ``sources``: nth (from 1), user_id.
    """
    first = records.where(F.coalesce("identity", F.lit("")) != "").groupBy("artifact", "identity").agg(F.min("line_no").alias("first"))
    placed = first.withColumn("nth", F.row_number().over(Window.partitionBy("artifact").orderBy("first", "identity")).cast("long"))
    return placed.join(
        sources.select(F.col("nth").cast("long").alias("nth"), "user_id"),
        "nth",
        "left",
    ).select("artifact", "identity", F.coalesce("user_id", lost).alias("owner"))


def exposures(strings: DataFrame, known: DataFrame, aliases: bool = True) -> DataFrame:
    """artifact, line_no, path, exposure_type, exposed, privacy_level, privacy_type, severity.

    ``strings``: artifact, line_no, owner, path, value; ``known``: the rows of ``signals``. Values are found by ``contains_join`` on the owner, markers by an
    equi-join on the whole text, so the strings of a record meet only signals that they show. An alias at more than one place is a warning.
    """
    place = ["artifact", "line_no", "path"]
    hit = contains_join(strings, known.where("kind in ('secret', 'identifier', 'canary')"), "owner", place, "value", "text")
    hit = hit.where((F.col("kind") == "identifier") | shows_value(F.col("value"), F.col("text"), F.col("path")))
    names = F.create_map(*map(F.lit, ("secret", "exact_secret", "identifier", "user_identifier", "canary", "canary_exposure")))
    nothing = F.lit(None).cast("string")
    out = lambda rows, kind, text, severity, level=nothing, type_=nothing: rows.select(*place, kind.alias("exposure_type"), text.alias("exposed"), level.alias("privacy_level"), type_.alias("privacy_type"), severity.alias("severity"))
    fail, warn = F.lit("failure"), F.lit("warning")
    low = strings.withColumn("value", F.lower("value"))
    terms = contains_join(low, known.where("kind = 'term'").withColumn("text", F.lower("text")), "owner", place, "value", "text")
    tells = F.lower("path").rlike(r"\.privacy_(?:type|level)$")
    markers = strings.join(
        known.where("kind = 'marker'").select("owner", F.col("text").alias("marker"), "flag"),
        "owner",
    ).where(F.btrim("value") == F.col("marker"))
    found = [
        out(hit, names[F.col("kind")], F.col("text"), fail, F.col("privacy_level"), F.col("privacy_type")),
        out(markers, F.lit("membership_marker"), F.left("marker", F.lit(160)), F.when(F.col("flag"), fail).otherwise(warn)),
        out(
            terms,
            F.lit("sensitive_attribute"),
            F.col("text"),
            F.when(tells, fail).otherwise(warn),
            F.col("privacy_level"),
            F.col("privacy_type"),
        ),
        out(strings.where(F.col("value").rlike(audit.INJECTION)), F.lit("prompt_injection_risk"), F.left("value", F.lit(160)), fail),
        out(
            strings.where(has_part(F.col("path"), LINKAGE) & (F.btrim("value") != "")),
            F.lit("linkage_metadata"),
            F.left("value", F.lit(96)),
            fail,
        ),
    ]
    if aliases:
        seen = strings.select(
            *place,
            F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(audit.ALIAS), F.lit(0)))).alias("alias"),
        )
        again = seen.groupBy("alias").agg(F.count_distinct(*place).alias("n")).where("n > 1")
        again = again.select(
            F.lit("<cross-artifact>").alias("artifact"),
            F.lit(0).cast("long").alias("line_no"),
            F.concat(F.col("n").cast("string"), F.lit(" places")).alias("path"),
            "alias",
        )
        found.append(out(again, F.lit("cross_record_alias_reuse"), F.col("alias"), warn))
    return reduce(DataFrame.unionByName, found)


#: Counts of a report, and the exposure types that each adds up.
COUNTS = {
    "exact_exposures": ["exact_secret"], "identifier_exposures": ["user_identifier"], "attribute_exposures": ["sensitive_attribute"], "linkage_exposures": [
        "linkage_metadata",
        "cross_record_alias_reuse",
    ],
    "membership_exposures": ["membership_marker"], "canary_exposures": ["canary_exposure"], "injection_risks": ["prompt_injection_risk"],
}


def report(found: DataFrame) -> DataFrame:
    """One row of counts by type and severity, and whether nothing failed."""
    kind, severity = F.col("exposure_type"), F.col("severity")
    counts = [F.count_if(kind.isin(types)).alias(name) for name, types in COUNTS.items()]
    row = found.agg(
        *counts,
        F.count_if((kind == "exact_secret") & (F.col("privacy_level") == "PL4")).alias("pl4_exposures"),
        F.count_if(severity == "warning").alias("warnings"),
        F.count_if(severity == "failure").alias("failures"),
    )
    return row.withColumn("passed", F.col("failures") == 0)


def source_labels(items: DataFrame, users: DataFrame, terms: list[str], levels: list[str]) -> DataFrame:
    """user_id, label: 1 if some item of the user, of one of the levels (any if none are named), has a term in its type or text, letters' case aside."""
    words = F.lower(F.concat_ws(" ", F.coalesce("privacy_type", F.lit("")), F.coalesce("original_text", F.lit(""))))
    hit = reduce(lambda a, b: a | b, (words.contains(t.lower()) for t in terms), F.lit(False))
    if levels:
        hit = hit & F.col("privacy_level").isin(levels)
    found = items.groupBy("user_id").agg(F.max(hit.cast("int")).alias("label"))
    return users.select("user_id").join(found, "user_id", "left").select("user_id", F.coalesce("label", F.lit(0)).alias("label"))


def attack_documents(strings: DataFrame, sources: DataFrame) -> DataFrame:
    """nth, text: for each source user the strings of meaning of its records in all artifacts, in order, a line each.

    ``strings``: artifact, line_no, identity, path, name, value; ``sources``: nth (from 1), user_id. Records without identity belong to the first
    user; identities beyond the last user belong to nobody.
    """
    told = strings.where(F.col("name").isin(SEMANTIC))
    own = owners(told, sources, F.lit(None).cast("string"))
    first = sources.where("nth = 1").select(F.col("user_id").alias("first"))
    rows = told.join(own, ["artifact", "identity"], "left").join(first, F.lit(True), "cross")
    owner = F.when(F.coalesce("identity", F.lit("")) == "", F.col("first")).otherwise(F.col("owner"))
    texts = rows.withColumn("user_id", owner).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("artifact", "line_no", "path", "value"))).alias("l")
    )
    joined = sources.join(texts, "user_id", "left")
    return joined.select("nth", "user_id", F.coalesce(F.array_join(F.transform("l", lambda x: x["value"]), "\n"), F.lit("")).alias("text"))


def attack_report(labelled: DataFrame, ratio: float = 0.4) -> DataFrame:
    """One row: counts, whether the attack applies, its accuracy and auc on the held-out documents, and the accuracy of always naming the majority.

    ``labelled``: doc_id, label, text. The attack applies if each class has two documents and both are on both sides of the split; else its figures are null.
    """
    if not 0 < ratio < 1:
        raise ValueError("the ratio of test documents must lie between 0 and 1")
    split = audit.split_last(labelled, ratio)
    one = lambda test, label: F.count_if((F.col("test") == test) & (F.col("label") == label))
    sizes = split.agg(*[one(t, k).alias(f"{name}{k}") for t, name in ((False, "train"), (True, "test")) for k in (0, 1)])
    scores = materialised(audit.naive_bayes(split), "scores")
    hits = scores.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("double")).alias("accuracy"))
    row = sizes.join(hits, F.lit(True), "cross").join(audit.auc(scores).select("auc"), F.lit(True), "cross")
    applies = (F.col("train0") + F.col("test0") >= 2) & (F.col("train1") + F.col("test1") >= 2) & (
        F.least("train0", "train1", "test0", "test1") > 0
    )
    majority = F.when(2 * F.col("train1") >= F.col("train0") + F.col("train1"), F.col("test1")).otherwise(F.col("test0"))
    only = lambda x: F.when(F.col("applicable"), x)
    row = row.withColumn("applicable", applies)
    return row.select(
        (F.col("train0") + F.col("train1")).alias("train_users"), (F.col("test0") + F.col("test1")).alias("test_users"), (F.col("train1") + F.col("test1")).alias("positive_users"), (F.col("train0") + F.col("test0")).alias("negative_users"),
        "applicable", only(F.col("accuracy")).alias("accuracy"), only(F.col("auc")).alias("auc"), only(
            F.try_divide(majority, F.col("test0") + F.col("test1"))
        ).alias("baseline_accuracy"),
    )
