"""Named queries over policies, stand-ins, aliases, provenance, the compiler and the scoring of extractors, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlake.functions import spans, text
from quietlake.operators import aliases, audit, dialogue, exposure, minimize, privacy, scoring, selection
from quietlake.plans import compiler, dataset, memory_eval
from quietlake.plans.catalogue import _CAT, _TOKENS, _line_units, _query, _table
from quietlake.plans.dialogue_queries import _KNOWN, _LOCAL, _OWN, _PREFIX, _TALK, _fingerprint, _named, _questions, _talk, _users

# --- the minimizer


def _hits(family: str, low: str) -> str:
    return " + ".join(
        f"CAST(regexp_matches({low}, '{minimize.portable(p).replace(chr(39), chr(39) * 2)}') AS INTEGER)" for p in minimize.PATTERNS[family]
    )


def _some(family: str, low: str) -> str:
    return f"({_hits(family, low)} > 0)"


def _unit(unit: str, role: str) -> str:
    low = f"lower({unit})"
    return f"(CASE WHEN {role} = 'user' THEN 1 ELSE 0 END + 2 * ({_hits('facts', low)}) - 2 * ({_hits('questions', low)}) - CASE WHEN {_some('memory_control', low)} THEN 8 ELSE 0 END - CASE WHEN {_some('ephemeral', low)} THEN 5 ELSE 0 END - 3 * ({_hits('boilerplate', low)}) - CASE WHEN length({unit}) < 12 THEN 0.5 ELSE 0 END)::DOUBLE"


def _must(unit: str, role: str) -> str:
    low = f"lower({unit})"
    return f"({role} = 'user' AND NOT {_some('memory_control', low)} AND NOT {_some('ephemeral', low)} AND {_some('must_keep', low)})"


_UNITS = f"units AS (SELECT message_id, role, content, unnest(u) AS unit, generate_subscripts(u, 1) - 1 AS i, len(u) AS n FROM (SELECT message_id, role, content, {_line_units('content')} AS u FROM msg))"
_SCORED = f"scored AS MATERIALIZED (SELECT message_id, role, content, unit, i, n, {_unit('unit', 'role')} AS score, {_must('unit', 'role')} AS must, greatest(1, {_TOKENS.format('unit')}) AS size FROM units)"


@_query(f"WITH {_TALK}, {_UNITS}, {_SCORED} SELECT message_id, CAST(i AS INTEGER) AS unit, score, must FROM scored")
def unit_scores(spark, sf_dir):
    m = _talk(spark, sf_dir).select("message_id", "role", F.posexplode(text.split_units(F.col("content"))).alias("unit", "text"))
    return m.select(
        "message_id",
        "unit",
        minimize.marks(F.col("text"), F.col("role"), F.array().cast("array<string>")).alias("m"),
    ).select("message_id", "unit", "m.score", "m.must")


_STEP = "CASE WHEN x.turn = 1 THEN len(a.taken) = 0 OR a.used + x.size <= 128 ELSE NOT a.fin AND (len(a.taken) = 0 OR (x.score > 0 AND a.used + x.size <= x.target)) END AND NOT list_contains(a.taken, x.i)"
_MINIMIZED = f"""queue AS (SELECT message_id, 1 AS turn, i, size, score, must FROM scored WHERE must UNION ALL SELECT message_id, 2, i, size, score, must FROM scored),
goals AS (SELECT message_id, any_value(content) AS content, any_value(role) AS role, any_value(n) AS n, least(128, greatest(8, CAST(floor({_TOKENS.format('any_value(content)')} * 0.65) AS BIGINT))) AS target, list(unit ORDER BY i) AS us FROM scored GROUP BY message_id),
lines AS (SELECT message_id, list({{'turn': turn, 'i': i, 'size': size, 'score': score, 'target': target, 'taken': []::BIGINT[], 'used': 0::BIGINT, 'fin': false}} ORDER BY turn, CASE WHEN turn = 1 THEN i END, -score, size, i) AS q FROM queue JOIN goals USING (message_id) GROUP BY message_id),
done AS (SELECT message_id, list_reduce(list_prepend({{'turn': 0, 'i': -1::BIGINT, 'size': 0::BIGINT, 'score': 0.0::DOUBLE, 'target': 0::BIGINT, 'taken': []::BIGINT[], 'used': 0::BIGINT, 'fin': false}}, q),
 lambda a, x: CASE WHEN {_STEP} THEN {{'turn': x.turn, 'i': x.i, 'size': x.size, 'score': x.score, 'target': x.target, 'taken': list_append(a.taken, x.i), 'used': a.used + x.size, 'fin': x.turn = 2 AND a.used + x.size >= x.target}} ELSE a END).taken AS taken FROM lines),
alone AS (SELECT m.message_id, CASE WHEN {_must('m.content', 'm.role')} OR {_unit('m.content', 'm.role')} > 0 THEN m.content ELSE '' END AS t FROM msg m LEFT JOIN goals g USING (message_id) WHERE coalesce(g.n, 0) <= 1)
SELECT message_id, coalesce(array_to_string(list_filter(us, lambda u, k: list_contains(taken, k - 1)), ' '), '') AS public_text FROM goals JOIN done USING (message_id) WHERE n > 1 UNION ALL SELECT message_id, t FROM alone"""


@_query(f"WITH {_TALK}, {_UNITS}, {_SCORED}, {_MINIMIZED}")
def minimize_context(spark, sf_dir):
    return minimize.minimize_messages(_talk(spark, sf_dir).withColumn("protected", F.array().cast("array<string>")))


# --- policy and stand-ins

_SETTINGS = {
    "public_memory": {
        "policy_version": "v7",
        "policy": {"pl2": "public_abstract", "PL3": "local_only", "pl4": "drop"},
        "alias_scope": {"pl2": "session"},
        "type_overrides": {"Network Identifier": "drop", "Phone Number": {"action": "public_reversible", "alias_scope": "persistent"}},
    }
}


@_query(f"""WITH {_OWN} SELECT message_id, pos, CASE WHEN privacy_level = 'PL4' THEN 'drop' WHEN privacy_type = 'Email' THEN 'public_reversible' WHEN privacy_type = 'Financial Account' THEN 'local_only' WHEN privacy_type = 'Phone Number' THEN 'public_reversible' WHEN privacy_type = 'Network Identifier' THEN 'drop' WHEN privacy_level = 'PL3' THEN 'local_only' ELSE 'public_abstract' END AS action,
CASE WHEN privacy_level = 'PL4' THEN NULL WHEN privacy_type = 'Email' THEN 'session' WHEN privacy_type = 'Phone Number' THEN 'persistent' END AS scope,
CASE WHEN privacy_level = 'PL4' THEN 'mandatory:PL4-drop' WHEN privacy_type = 'Email' THEN 'exact-required-with-consent' WHEN privacy_type = 'Financial Account' THEN 'exact-required-without-consent' WHEN privacy_type IN ('Phone Number', 'Network Identifier') THEN 'type:' || privacy_type ELSE 'level:' || privacy_level END AS rule_id FROM items""")
def policy_routes(spark, sf_dir):
    kind = F.col("privacy_type")
    rule = selection.Policy.of(_SETTINGS).route(kind.isin("Email", "Financial Account"), kind == "Email")
    return privacy.detect(_talk(spark, sf_dir)).select("message_id", "pos", rule.alias("r")).select("message_id", "pos", "r.*")


_K = "privacy_type"
_EVENT_KINDS = "kinds AS (SELECT event_id, ['Email', 'Real Name', 'Medical_Record', 'hobby'][event_id % 4 + 1] AS privacy_type, 'PL' || (2 + event_id % 3) AS privacy_level, ['private@detail.org', 'Ann', 'category', 'contact information'][event_id % 4 + 1] AS original_text FROM events)"
_TEMPLATES = [
    (0, "Email", "PL2", "a way to write", 2, 0.9, 0.1, "learned_a"),
    (1, "*", None, "some detail", 1, 0.8, 0.05, "learned_b"),
    (2, None, "PL3", "Contact Information", 2, 0.7, 0.2, "category_abstract"),
    (3, "hobby", "*", "", 0, 0.0, 0.0, "drop"),
]
_TEMPLATE_SQL = "templates AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in t) + ")" for t in _TEMPLATES
) + ") t(nth, t_type, t_level, text, level, utility, leakage, representation))"
_RULES = f"""rules AS (SELECT unnest([0, 1, 2, 3]) AS nth, event_id, privacy_type, privacy_level, original_text FROM kinds), made AS (SELECT event_id, 100 + nth AS nth, original_text, CASE nth WHEN 0 THEN '' WHEN 1 THEN 'private detail' WHEN 2 THEN {_CAT} ELSE 'private ' || lower(privacy_type) || ' value' END AS text, nth AS level,
 [0.0, 0.68, 0.82, 0.96][nth + 1]::DOUBLE AS utility, [0.0, 0.05, 0.2, 0.45][nth + 1]::DOUBLE AS leakage, ['drop', 'generic_abstract', 'category_abstract', 'typed_abstract'][nth + 1] AS representation FROM rules),
every AS (SELECT k.event_id, t.nth, k.original_text, t.text, t.level, t.utility::DOUBLE AS utility, t.leakage::DOUBLE AS leakage, t.representation FROM kinds k JOIN templates t ON coalesce(t_type, '*') IN ('*', privacy_type) AND coalesce(t_level, '*') IN ('*', privacy_level) UNION ALL SELECT * FROM made),
parts AS (SELECT 'private@detail.org' AS v, ['private@detail.org', 'private', 'detail.org', 'detail'] AS f UNION ALL SELECT 'Ann', [] UNION ALL SELECT 'category', ['category'] UNION ALL SELECT 'contact information', ['contact information', 'contact', 'information']),
good AS (SELECT e.* FROM every e JOIN parts p ON p.v = e.original_text WHERE e.text = '' OR NOT len(list_filter(f, lambda x: contains(lower(e.text), x))) > 0),
safe AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY event_id, lower(text), representation ORDER BY nth) = 1)"""


def _standing(spark, sf_dir) -> DataFrame:
    pick = lambda words: F.get(F.array(*map(F.lit, words)), (F.col("event_id") % 4).cast("int"))
    items = _table(spark, sf_dir, "events").select(
        "event_id",
        pick(["Email", "Real Name", "Medical_Record", "hobby"]).alias("privacy_type"),
        F.concat(F.lit("PL"), (2 + F.col("event_id") % 3).cast("string")).alias("privacy_level"),
        pick(["private@detail.org", "Ann", "category", "contact information"]).alias("original_text"),
    )
    templates = spark.createDataFrame(
        _TEMPLATES,
        "nth int, privacy_type string, privacy_level string, text string, level long, utility double, leakage double, representation string",
    )
    return selection.generator("artifact", templates)(items, F.lit(False))


@_query(
    f"WITH {_EVENT_KINDS}, {_TEMPLATE_SQL}, {_RULES} SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY nth) - 1 AS INTEGER) AS nth, text, CAST(level AS BIGINT) AS level, utility, leakage, representation FROM safe"
)
def artifact_candidates(spark, sf_dir):
    return _standing(spark, sf_dir).select("event_id", F.posexplode("candidates").alias("nth", "c")).select("event_id", "nth", "c.*")


_CHOSEN = f"""told AS (SELECT s.*, k.privacy_level, greatest(1, {_TOKENS.format('s.text')}) AS tokens FROM safe s JOIN kinds k USING (event_id) WHERE s.text <> ''),
judged AS (SELECT *, CASE WHEN privacy_level = 'PL4' THEN 'PL4 public candidate' WHEN utility < 0.75 THEN 'below utility floor' WHEN leakage > 0.35 THEN 'above leakage budget' END AS why,
 round(utility - leakage - 0.01 * ln(1 + tokens) - 0.05 * level - 0.3 * CASE WHEN privacy_level IN ('PL3', 'PL4') THEN 0.4 ELSE 0.1 END, 9) AS score FROM told),
best AS (SELECT * FROM judged WHERE why IS NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY score DESC, level, leakage, tokens, text DESC) = 1),
whys AS (SELECT event_id, count(*) FILTER (why IS NULL) AS feasible, array_to_string(list_sort(list_distinct(list(why) FILTER (why IS NOT NULL))), ', ') AS why FROM judged GROUP BY event_id)"""


@_query(
    f"WITH {_EVENT_KINDS}, {_TEMPLATE_SQL}, {_RULES}, {_CHOSEN} SELECT k.event_id, CASE WHEN b.event_id IS NULL THEN 'drop' ELSE 'select' END AS action, b.text AS text, b.representation AS representation, b.score AS score, CAST(feasible AS INTEGER) AS feasible, CASE WHEN b.event_id IS NULL THEN 'no candidate within the limits (' || w.why || ')' ELSE 'highest score within the limits' END AS reason FROM kinds k JOIN whys w USING (event_id) LEFT JOIN best b USING (event_id)"
)
def learned_choices(spark, sf_dir):
    choose = selection.selector("learned")
    rows = _standing(spark, sf_dir).withColumn(
        "d",
        choose(selection.public_candidates(F.col("candidates")), F.col("original_text"), F.col("privacy_level")),
    )
    return rows.select(
        "event_id",
        "d.action",
        "d.text",
        "d.representation",
        F.when(F.col("d.action") == "select", F.round("d.score", 9)).alias("score"),
        "d.feasible",
        "d.reason",
    )


_EXAMPLES = f"""examples AS (SELECT e.event_id, e.text, e.utility, e.leakage, e.representation, k.privacy_type, k.privacy_level, e.level, greatest(1, len(regexp_extract_all(e.text, '[^\\s\\p{{Z}}]+'))) AS tokens FROM safe e JOIN kinds k USING (event_id)),
labelled AS (SELECT *, utility - leakage - 0.01 * tokens AS s, utility >= 0.75 AND leakage <= 0.35 AS good FROM examples)"""


def _examples(spark, sf_dir) -> DataFrame:
    rows = _standing(spark, sf_dir).select(
        F.lit("u").alias("user_id"),
        F.col("event_id").alias("message_id"),
        F.lit(0).alias("item_index"),
        "privacy_type",
        "privacy_level",
        "original_text",
        "candidates",
    )
    return selection.selector_examples(rows)


@_query(
    f"WITH {_EVENT_KINDS}, {_TEMPLATE_SQL}, {_RULES}, {_EXAMPLES} SELECT event_id AS message_id, text, CAST(tokens AS BIGINT) AS token_count, round(s, 9) AS label_score, good AS label_positive, representation FROM labelled"
)
def selector_examples(spark, sf_dir):
    return _examples(spark, sf_dir).select(
        "message_id",
        "text",
        "token_count",
        F.round("label_score", 9).alias("label_score"),
        "label_positive",
        "representation",
    )


@_query(
    f"WITH {_EVENT_KINDS}, {_TEMPLATE_SQL}, {_RULES}, {_EXAMPLES}, m AS (SELECT avg(utility) FILTER (good) AS pu, avg(utility) FILTER (NOT good) AS nu, avg(leakage) FILTER (good) AS pl, avg(leakage) FILTER (NOT good) AS nl FROM labelled) SELECT round(greatest(0.5, 1 + pu - nu), 9) AS utility_score, round(least(-0.5, -1 - greatest(0, nl - pl)), 9) AS leakage_score FROM m"
)
def fitted_weights(spark, sf_dir):
    return selection.fit_weights(_examples(spark, sf_dir)).select(
        F.round("utility_score", 9).alias("utility_score"),
        F.round("leakage_score", 9).alias("leakage_score"),
    )


@_query(
    f"WITH {_EVENT_KINDS}, {_TEMPLATE_SQL}, {_RULES}, {_EXAMPLES}, g AS (SELECT privacy_type, privacy_level, text, representation, count(*) AS c FROM labelled WHERE text <> '' GROUP BY ALL), top AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY privacy_type, privacy_level, text ORDER BY c DESC, representation DESC) = 1) SELECT privacy_type, privacy_level, l.text AS text, round(avg(utility), 9) AS utility, round(avg(leakage), 9) AS leakage, CAST(round_even(avg(level), 0) AS BIGINT) AS abstraction_level, count(*) AS support, any_value(t.representation) AS representation FROM labelled l JOIN top t USING (privacy_type, privacy_level, text) GROUP BY privacy_type, privacy_level, l.text HAVING count(*) >= 2"
)
def distill_templates(spark, sf_dir):
    found = dialogue.distill(_examples(spark, sf_dir).withColumn("specificity", F.col("level")), 2)
    return found.withColumns({"utility": F.round("utility", 9), "leakage": F.round("leakage", 9)}).select(
        "privacy_type",
        "privacy_level",
        "text",
        "utility",
        "leakage",
        "abstraction_level",
        "support",
        "representation",
    )


@_query(
    f"""WITH {_OWN}, ctx AS (SELECT user_id, message_id, array_to_string(list(content) OVER (PARTITION BY user_id ORDER BY message_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), '|') AS c FROM msg) SELECT message_id, pos, md5(c) AS context, 'Who? How?' AS hints, CASE WHEN privacy_level = 'PL2' OR true THEN 4 END::INTEGER AS candidates FROM items JOIN ctx USING (user_id, message_id)"""
)
def abstraction_examples(spark, sf_dir):
    m = _talk(spark, sf_dir)
    hints = m.select("user_id").distinct().select(
        "user_id",
        F.posexplode(F.array(F.lit("Who?"), F.lit(""), F.lit("How?"))).alias("nth", "question"),
    )
    rows = selection.abstraction_examples(m, privacy.detect(m), hints)
    return rows.select(
        "message_id",
        "pos",
        F.md5(F.array_join("context", "|")).alias("context"),
        F.array_join("hints", " ").alias("hints"),
        F.size("candidates").alias("candidates"),
    )


# --- aliases


def _items(m: DataFrame) -> DataFrame:
    return privacy.detect(m).withColumn("seen", F.struct("message_id", "pos"))


@_query(
    f"WITH {_OWN}, {_LOCAL} SELECT user_id || ':local-only' AS namespace, original_text, privacy_type, privacy_level, seq, {_named(chr(39).join(['user_id || ', ':local-only', '']), 'original_text')} AS fingerprint FROM local"
)
def local_store(spark, sf_dir):
    return aliases.store_local(None, _items(_talk(spark, sf_dir)), privacy.TEST_KEY).drop("mask")


@_query(
    f"WITH {_OWN}, {_LOCAL} SELECT user_id || ':local-only' AS namespace, original_text, privacy_type, CASE WHEN privacy_type = 'Email' THEN 'PL3' ELSE privacy_level END AS privacy_level, seq FROM local UNION ALL SELECT DISTINCT user_id || ':local-only', user_id || '-new', 'Email', 'PL2', 1 + coalesce((SELECT max(seq) FROM local l WHERE l.user_id = m.user_id AND privacy_type = 'Email'), 0) FROM msg m"
)
def merged_store(spark, sf_dir):
    """A second batch raises the level of known e-mail addresses, never lowers one, and adds a value to each user."""
    m = _talk(spark, sf_dir)
    first = aliases.store_local(None, _items(m), privacy.TEST_KEY)
    kind = F.col("privacy_type")
    again = _items(m).withColumn("privacy_level", F.when(kind == "Email", "PL3").otherwise("PL2"))
    new = m.select("user_id").distinct().select(
        "user_id",
        F.concat("user_id", F.lit("-new")).alias("original_text"),
        F.lit("Email").alias("privacy_type"),
        F.lit("PL2").alias("privacy_level"),
        F.struct(F.lit("z").alias("message_id"), F.lit(0).cast("long").alias("pos")).alias("seen"),
    )
    batch = again.select(new.columns).unionByName(new)
    return aliases.store_local(first, batch, privacy.TEST_KEY).select("namespace", "original_text", "privacy_type", "privacy_level", "seq")


_SCOPED = f"""scoped AS (SELECT *, user_id || ':session:' || user_id || ':session:' || (CAST(split_part(message_id, ':', 3) AS BIGINT) // 20) AS ns FROM items WHERE privacy_type = 'Email'),
own AS (SELECT ns, original_text, privacy_type, min({{'a': message_id, 'b': pos}}) AS seen FROM scoped GROUP BY ALL),
al AS (SELECT ns, original_text, '<MPM_' || {_PREFIX} || '_' || row_number() OVER (PARTITION BY ns, privacy_type ORDER BY seen, original_text) || '_' || left({_named('ns', 'original_text')}, 12) || '>' AS alias FROM own)"""


@_query(f"WITH {_OWN}, {_SCOPED} SELECT message_id, pos, original_text, alias FROM scoped JOIN al USING (ns, original_text)")
def scoped_aliases(spark, sf_dir):
    m = dataset.with_scopes(_talk(spark, sf_dir))
    items = _items(m).where("privacy_type = 'Email'").join(m.select("message_id", "turn_id", "session_id", "task_id"), "message_id")
    _, named = aliases.get_aliases(None, items, F.lit("session"), privacy.TEST_KEY)
    return named.select("message_id", "pos", "original_text", "alias")


@_query(f"WITH {_TALK} SELECT message_id AS text_id, content AS text FROM msg")
def restored_texts(spark, sf_dir):
    """Texts with all their values as aliases, given back by the scopes of their messages: the texts themselves."""
    m = dataset.with_scopes(_talk(spark, sf_dir))
    items = privacy.best_per_text(_items(m)).join(m.select("message_id", "turn_id", "session_id", "task_id"), "message_id")
    scope = F.when(F.col("privacy_type") == "Email", "session").when(
        F.col("privacy_type") == "Phone Number",
        "persistent",
    ).when(F.col("privacy_type") == "Token", "turn").otherwise("task")
    store, named = aliases.get_aliases(None, items, scope, privacy.TEST_KEY)
    pairs = named.groupBy("message_id").agg(
        F.collect_list(F.struct(F.col("original_text").alias("old"), F.col("alias").alias("new"), F.lit(False).alias("drop"))).alias("p")
    )
    hidden = m.join(pairs, "message_id", "left").select(
        F.col("message_id").alias("text_id"),
        "user_id",
        "turn_id",
        "session_id",
        "task_id",
        F.when(F.col("p").isNull(), F.col("content")).otherwise(spans.mask(F.col("content"), F.col("p"))).alias("text"),
    )
    return aliases.restore(hidden, store)


_PREPARED = f"""{_OWN}, {_LOCAL}, q AS (SELECT concat('u', conv_id) AS user_id, concat('t', conv_id) AS task_id FROM conversations WHERE turn = 0), kinds AS (SELECT unnest(['Email', 'Passport', 'Financial Account']) AS k, unnest([0, 1, 2]) AS nth),
top AS (SELECT * FROM local WHERE privacy_level <> 'PL4' QUALIFY row_number() OVER (PARTITION BY user_id, privacy_type ORDER BY privacy_level DESC, seq, original_text) <= 5),
hit AS (SELECT q.user_id, q.task_id, k.nth, t.*, row_number() OVER (PARTITION BY q.user_id, t.privacy_type ORDER BY t.privacy_level DESC, t.seq, t.original_text) AS n FROM q JOIN kinds k ON true JOIN top t ON t.user_id = q.user_id AND t.privacy_type = k.k),
al AS (SELECT user_id, nth, n, privacy_type, privacy_level, task_id, '<MPM_' || {_PREFIX} || '_' || n || '_' || left({_named("user_id || ':task:' || task_id", 'original_text')}, 12) || '>' AS alias FROM hit)"""


def _prepared(spark, sf_dir):
    m = _talk(spark, sf_dir)
    store = aliases.store_local(None, _items(m), privacy.TEST_KEY)
    types = F.array(F.lit("Email"), F.lit("Passport"), F.lit("Financial Account"), F.lit("Email"))
    q = _table(spark, sf_dir, "conversations").where("turn = 0").select(
        F.col("conv_id").alias("query_id"),
        F.expr("concat('u', conv_id)").alias("user_id"),
        F.expr("concat('t', conv_id)").alias("task_id"),
        F.lit("Whom shall I write to?").alias("query"),
        types.alias("required"),
        types.alias("exact"),
        types.alias("consented"),
    )
    return aliases.prepare_queries(q, store, privacy.TEST_KEY)


@_query(
    f"WITH {_PREPARED}, l AS (SELECT user_id, string_agg('- ' || privacy_type || ': ' || alias, chr(10) ORDER BY nth, n) AS lines, list(DISTINCT privacy_type) AS ks FROM al GROUP BY user_id) SELECT user_id, 'Whom shall I write to?' || CASE WHEN lines IS NULL THEN '' ELSE '{aliases.REFERENCES.replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}' || lines END AS cloud_query, array_to_string(list_filter(['Email', 'Passport', 'Financial Account'], lambda k: NOT coalesce(list_contains(ks, k), false)), ',') AS missing, {_fingerprint(chr(39) + 'Whom shall I write to?' + chr(39))} AS fingerprint FROM q LEFT JOIN l USING (user_id)"
)
def prepared_queries(spark, sf_dir):
    return _prepared(spark, sf_dir)[1].select("user_id", "cloud_query", F.array_join("missing", ",").alias("missing"), "fingerprint")


@_query(
    f"WITH {_PREPARED} SELECT CAST(substr(user_id, 2) AS BIGINT) AS query_id, privacy_type, privacy_level, alias, 'task' AS scope, task_id AS scope_id FROM al"
)
def alias_manifest(spark, sf_dir):
    return aliases.alias_manifest(_prepared(spark, sf_dir)[1])


@_query(
    f"WITH {_PREPARED} SELECT CAST(substr(user_id, 2) AS BIGINT) AS text_id, string_agg(original_text, ' and ' ORDER BY nth, n) AS text FROM hit GROUP BY user_id"
)
def restored_responses(spark, sf_dir):
    """Answers that repeat a query's aliases, given back by the scopes of its manifest."""
    store, prepared = _prepared(spark, sf_dir)
    said = prepared.where(F.size("aliases") > 0).select(
        F.col("query_id").alias("text_id"),
        "user_id",
        *[F.lit(None).cast("string").alias(c) for c in ("turn_id", "session_id", "task_id")],
        F.array_join(F.transform("aliases", lambda a: a["alias"]), " and ").alias("text"),
        F.transform("aliases", lambda a: F.struct(a["scope"].alias("scope"), a["scope_id"].alias("scope_id"))).alias("extra"),
    )
    return aliases.restore(said, store, F.col("extra"))


@_query(
    f"WITH {_OWN}, {_LOCAL} SELECT user_id, privacy_type, count(*) AS n, max(privacy_level) AS top FROM local WHERE privacy_type = 'Email' GROUP BY ALL"
)
def vault_lookup(spark, sf_dir):
    store = aliases.store_local(None, _items(_talk(spark, sf_dir)), privacy.TEST_KEY)
    return aliases.query_local(store, F.lit("Email")).groupBy("user_id", "privacy_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("privacy_level").alias("top"),
    )


# --- provenance

_LINEAGE = f"""rec AS (SELECT user_id, message_id, pos, privacy_type, privacy_level, CASE privacy_level WHEN 'PL4' THEN 'drop' WHEN 'PL3' THEN 'local_only' ELSE 'public_abstract' END AS route_action, CASE privacy_level WHEN 'PL4' THEN 'mandatory:PL4-drop' ELSE 'level:' || privacy_level END AS rule_id,
 left(sha256(concat_ws(chr(0), user_id, message_id, CAST(pos AS VARCHAR), 'minimal-public-v1', privacy_type)), 32) AS record_id FROM (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY message_id, original_text ORDER BY privacy_level DESC, privacy_type, pos) = 1))"""


def _lineage(spark, sf_dir):
    m = _talk(spark, sf_dir)
    compiled, _ = compiler.compile_items(m, privacy.validate(privacy.detect(m), m))
    return aliases.provenance_records(compiled, "minimal-public-v1", F.lit("2024-01-01T00:00:00Z"))


@_query(
    f"WITH {_OWN}, {_LINEAGE} SELECT record_id, user_id, message_id AS source_message_id, route_action, rule_id, privacy_level, privacy_type FROM rec"
)
def provenance_records(spark, sf_dir):
    table = aliases.add_records(_lineage(spark, sf_dir).where("false"), _lineage(spark, sf_dir))
    return table.select("record_id", "user_id", "source_message_id", "route_action", "rule_id", "privacy_level", "privacy_type")


@_query(
    f"WITH {_OWN}, {_LINEAGE} SELECT user_id, list_sort(list(DISTINCT 'cloud-' || left(record_id, 8))) AS cloud_ids FROM rec WHERE message_id LIKE '%:0' OR message_id LIKE '%:2' GROUP BY user_id"
)
def revoked_messages(spark, sf_dir):
    table = _lineage(spark, sf_dir)
    table = aliases.attach_cloud_ids(
        table,
        table.select("record_id", F.concat(F.lit("cloud-"), F.left("record_id", F.lit(8))).alias("cloud_id")),
    )
    gone = table.where(F.col("source_message_id").rlike(":[02]$")).select("user_id", "source_message_id")
    return aliases.revoke_by_source(table, gone, "asked", F.lit("2024-01-02T00:00:00Z"))[1]


@_query(
    f"WITH {_OWN}, {_LINEAGE} SELECT user_id, count(*) AS active FROM rec WHERE NOT (message_id LIKE '%:0' OR message_id LIKE '%:2') GROUP BY user_id"
)
def active_records(spark, sf_dir):
    table = _lineage(spark, sf_dir)
    after, _ = aliases.revoke_by_source(
        table,
        table.where(F.col("source_message_id").rlike(":[02]$")).select("user_id", "source_message_id"),
        "asked",
        F.lit("2024-01-02T00:00:00Z"),
    )
    return aliases.active_records(after).groupBy("user_id").agg(F.count(F.lit(1)).alias("active"))


@_query(
    f"WITH {_OWN}, m AS (SELECT DISTINCT message_id, user_id, original_text, privacy_type FROM items), a AS (SELECT user_id, original_text, count(DISTINCT message_id) AS places FROM m GROUP BY ALL HAVING count(DISTINCT message_id) > 1) SELECT places, count(*) AS aliases FROM a GROUP BY places"
)
def alias_reuse(spark, sf_dir):
    m = _talk(spark, sf_dir)
    items = privacy.detect(m)
    done = privacy.mask_messages(m, items, privacy.vault(items), privacy.LEVELS)
    found = audit.alias_reuse(
        done.select(F.col("message_id").alias("artifact"), F.lit("content").alias("path"), F.col("masked").alias("value"))
    )
    return found.groupBy("places").agg(F.count(F.lit(1)).alias("aliases"))


# --- the whole dataset


def _compiled(spark, sf_dir) -> tuple[dataset.Compiled, DataFrame]:
    m = _talk(spark, sf_dir).withColumn("annotated", F.lit(True))
    questions = _questions(spark, sf_dir)
    return dataset.compile_dataset(_users(m), m, privacy.detect(m), questions, created_at=F.lit("2024-01-01T00:00:00Z")), questions


@_query()
def public_records(spark, sf_dir):
    return dataset.public_records(_compiled(spark, sf_dir)[0].records)


@_query()
def cloud_safe_users(spark, sf_dir):
    return _compiled(spark, sf_dir)[0].users.select(
        "uuid",
        F.to_json("metadata").alias("metadata"),
        F.to_json("dialogues").alias("dialogues"),
        F.to_json("questions").alias("questions"),
    )


@_query()
def dataset_report(spark, sf_dir):
    return dataset.dataset_report(*_compiled(spark, sf_dir))


@_query(
    f"WITH {_OWN}, {_KNOWN}, here AS (SELECT m.message_id, k.* FROM known k JOIN msg m ON m.user_id = k.user_id AND contains(m.content, k.original_text)), best AS (SELECT * FROM here QUALIFY row_number() OVER (PARTITION BY message_id, original_text ORDER BY privacy_level DESC, privacy_type) = 1) SELECT CASE privacy_level WHEN 'PL4' THEN 'dropped' WHEN 'PL3' THEN 'encrypted_local_only' ELSE 'category_abstract' END AS representation, count(*) AS n FROM best GROUP BY 1"
)
def representation_counts(spark, sf_dir):
    m = _talk(spark, sf_dir).withColumn("annotated", F.lit(True))
    return dataset.representation_counts(dataset.compiled_items(_users(m), m, privacy.detect(m))[-1])


@_query(
    f"WITH {_OWN}, {_KNOWN}, best AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY message_id, original_text ORDER BY privacy_level DESC, privacy_type) = 1), b AS (SELECT unnest([1, 2, 3, 64]) AS budget), c AS (SELECT {_CAT} AS t, * FROM best WHERE privacy_level = 'PL2') SELECT CAST(budget AS BIGINT) AS max_public_tokens, (SELECT count(*) FROM items) AS sensitive_items, CAST(count(*) FILTER ({_TOKENS.format('t')} > budget) AS BIGINT) AS rejected_items FROM b, c GROUP BY budget"
)
def budget_sweep(spark, sf_dir):
    m = _talk(spark, sf_dir)
    return dataset.budget_sweep(m, privacy.detect(m), [1, 2, 3, 64]).select("max_public_tokens", "sensitive_items", "rejected_items")


# --- scoring


def _predictions(spark, sf_dir) -> DataFrame:
    """Every third predicted item is lost, and every message whose number ends in 3 has no prediction."""
    m = _talk(spark, sf_dir)
    items = privacy.best_per_text(privacy.detect(m))
    as_list = lambda d, name: d.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("original_text", "privacy_type", "privacy_level"))).alias(name))
    rows = m.join(
        as_list(items.where("pos % 3 <> 2"), "predicted"),
        "message_id",
        "left",
    ).join(as_list(items, "reference"), "message_id", "left")
    return rows.withColumn("predicted", F.when(F.col("message_index") % 10 == 3, F.lit(None)).otherwise(F.col("predicted")))


_PRF = f"""{_OWN}, best AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY message_id, original_text ORDER BY privacy_level DESC, privacy_type, pos) = 1), lv AS (SELECT unnest(['all', 'PL2', 'PL3', 'PL4']) AS level),
n AS (SELECT m.message_id, level, count(b.pos) AS r, count(b.pos) FILTER (b.pos % 3 <> 2 AND m.message_index % 10 <> 3) AS p FROM msg m CROSS JOIN lv LEFT JOIN best b ON b.message_id = m.message_id AND (level = 'all' OR level = b.privacy_level) GROUP BY m.message_id, level),
s AS (SELECT *, CASE WHEN r = 0 AND p = 0 THEN 1.0 WHEN r = 0 OR p = 0 THEN 0.0 ELSE 1.0 END AS precision, CASE WHEN r = 0 AND p = 0 THEN 1.0 WHEN r = 0 OR p = 0 THEN 0.0 ELSE p / r END AS recall FROM n)"""


@_query(
    f"WITH {_PRF} SELECT message_id, level, CAST(precision AS DOUBLE) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END, 9) AS f1, round(recall, 9) AS text_score, round(recall, 9) AS level_score, round(recall, 9) AS type_score FROM s"
)
def extractor_scores(spark, sf_dir):
    found = scoring.evaluate(_predictions(spark, sf_dir))
    return found.select(
        "message_id",
        "level",
        *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "text_score", "level_score", "type_score")],
    )


@_query(
    f"WITH {_PRF} SELECT level, count(*) AS messages, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END), 9) AS f1 FROM s GROUP BY level"
)
def macro_scores(spark, sf_dir):
    found = scoring.macro_average(scoring.evaluate(_predictions(spark, sf_dir)))
    return found.select("level", "messages", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@_query("SELECT count(*) AS shards, CAST(sum(CASE WHEN n_regionkey % 2 = 0 THEN n_nationkey ELSE 0 END) AS BIGINT) AS failures FROM nation")
def combined_failures(spark, sf_dir):
    return scoring.combined_failures(
        _table(spark, sf_dir, "nation").select(
            F.col("n_nationkey").alias("shard"),
            F.when(F.col("n_regionkey") % 2 == 0, F.col("n_nationkey")).alias("failures"),
        )
    )


_QA = "qa AS (SELECT nullif(event_type, 'error') AS question_type, [1.0, 0.5, 0.0][event_id % 3 + 1]::DOUBLE AS score, event_id % 4 <> 0 AS is_valid FROM events)"


def _qa(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(
        F.nullif("event_type", F.lit("error")).alias("question_type"),
        F.get(F.array(F.lit(1.0), F.lit(0.5), F.lit(0.0)), (F.col("event_id") % 3).cast("int")).alias("score"),
        (F.col("event_id") % 4 != 0).alias("is_valid"),
    )


@_query(
    f"WITH {_QA} SELECT coalesce(question_type, 'Unknown') AS question_type, sum(score) AS total_score, CAST(count(*) FILTER (is_valid) AS BIGINT) AS total_valid, count(*) AS total_num, round(sum(score) / count(*), 9) AS accuracy, round(sum(score) / count(*) FILTER (is_valid), 9) AS accuracy_valid FROM qa GROUP BY 1"
)
def qa_scores_by_type(spark, sf_dir):
    return dialogue.score_summary(_qa(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("accuracy", "accuracy_valid")})


@_query(
    f"WITH {_QA} SELECT sum(score) AS total_score, CAST(count(*) FILTER (is_valid) AS BIGINT) AS total_valid, count(*) AS total_num, round(sum(score) / count(*), 9) AS accuracy, round(sum(score) / count(*) FILTER (is_valid), 9) AS accuracy_valid FROM qa"
)
def qa_totals(spark, sf_dir):
    return dialogue.score_summary(_qa(spark, sf_dir), by_type=False).withColumns({c: F.round(c, 9) for c in ("accuracy", "accuracy_valid")})


@_query(
    "WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, CASE WHEN turn % 3 <> 0 THEN '2024-01-' || lpad(CAST(turn + 1 AS VARCHAR), 2, '0') END AS d FROM conversations) SELECT conv_id, CAST(k // 4 AS BIGINT) AS chunk, arg_min(d, turn) FILTER (role = 'user' AND d IS NOT NULL) AS date FROM t GROUP BY 1, 2"
)
def chunk_dates(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").withColumn(
        "date",
        F.when(F.col("turn") % 3 != 0, F.concat(F.lit("2024-01-"), F.lpad((F.col("turn") + 1).cast("string"), 2, "0"))),
    )
    return dialogue.chunk_dates(turns, 2)


_ATTACK = r"""lab AS (SELECT doc_id, toxic AS label, text FROM labels JOIN documents USING (doc_id)), kk AS (SELECT label, greatest(1, round_even(count(*) * 0.25, 0)) AS k FROM lab GROUP BY label),
spl AS (SELECT lab.*, row_number() OVER (PARTITION BY label ORDER BY doc_id DESC) <= k AS test FROM lab JOIN kk USING (label))"""


@_query(
    f"WITH {_ATTACK} SELECT CAST(count(*) FILTER (NOT test) AS BIGINT) AS train_users, CAST(count(*) FILTER (test) AS BIGINT) AS test_users, CAST(count(*) FILTER (label = 1) AS BIGINT) AS positive_users, CAST(count(*) FILTER (label = 0) AS BIGINT) AS negative_users, true AS applicable, round(CASE WHEN 2 * count(*) FILTER (NOT test AND label = 1) >= count(*) FILTER (NOT test) THEN count(*) FILTER (test AND label = 1) ELSE count(*) FILTER (test AND label = 0) END / count(*) FILTER (test), 9) AS baseline_accuracy FROM spl"
)
def attack_report(spark, sf_dir):
    x = _table(spark, sf_dir, "labels").join(
        _table(spark, sf_dir, "documents").select("doc_id", "text"),
        "doc_id",
    ).select("doc_id", F.col("toxic").alias("label"), "text")
    return exposure.attack_report(x, 0.25).withColumn("baseline_accuracy", F.round("baseline_accuracy", 9)).drop("accuracy", "auc")


# --- memory systems

_SAFE = f"""{_OWN}, known AS (SELECT DISTINCT user_id, original_text FROM items WHERE privacy_level IN ('PL3', 'PL4')), here AS (SELECT m.message_id, list(k.original_text ORDER BY length(k.original_text) DESC, k.original_text) AS l FROM msg m JOIN known k ON k.user_id = m.user_id AND contains(m.content, k.original_text) GROUP BY m.message_id),
safe AS (SELECT m.message_id, m.user_id, m.message_index, m.role, CASE WHEN l IS NULL THEN content ELSE list_reduce(list_prepend(content, l), lambda t, x: replace(t, x, '***')) END AS text FROM msg m LEFT JOIN here USING (message_id))"""


@_query(f"WITH {_SAFE} SELECT message_id, text FROM safe")
def protected_texts(spark, sf_dir):
    m = _talk(spark, sf_dir)
    return privacy.protect_known(m, privacy.known_items(privacy.detect(m)), None)


@_query(
    f"WITH {_SAFE}, t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY message_index) - 1 AS k, CASE WHEN message_index % 3 <> 0 THEN '2024-01-' || lpad(CAST(message_index + 1 AS VARCHAR), 2, '0') END AS d FROM safe) SELECT user_id AS conv_id, CAST(k // 4 AS BIGINT) AS chunk, arg_min(d, message_index) FILTER (role = 'user' AND d IS NOT NULL) AS date, string_agg(role || ': ' || text, chr(10) ORDER BY message_index) AS text FROM t GROUP BY user_id, k // 4"
)
def chunks_to_write(spark, sf_dir):
    m = _talk(spark, sf_dir)
    date = F.when(F.col("message_index") % 3 != 0, F.concat(F.lit("2024-01-"), F.lpad((F.col("message_index") + 1).cast("string"), 2, "0")))
    turns = m.select(
        F.col("user_id").alias("conv_id"),
        F.col("message_index").alias("turn"),
        "user_id",
        "role",
        date.alias("date"),
        F.col("content").alias("text"),
    )
    return memory_eval.chunks_to_write(turns, privacy.known_items(privacy.detect(m)), None, 2)


@_query(f"WITH {_TALK} SELECT message_id, '- ' || user_id || chr(10) || '- ' || role AS context FROM msg")
def context_lines(spark, sf_dir):
    body = F.concat(
        F.lit("Known facts:\n - "),
        F.col("user_id"),
        F.lit("\nno entry\n- "),
        F.col("role"),
        F.lit(" \n- "),
        F.expr("repeat('word ', 300)"),
        F.lit("\n- after"),
    )
    return _talk(spark, sf_dir).select("message_id", dialogue.context_lines(body).alias("context"))


@_query(
    f"WITH {_OWN}, v AS (SELECT DISTINCT original_text, privacy_type FROM items WHERE privacy_type = 'Email'), n AS (SELECT *, row_number() OVER (ORDER BY original_text) AS seq FROM v) SELECT original_text, 'PL3' AS privacy_level, CAST(seq AS BIGINT) AS seq, '<MPM_Email_' || seq || '_0123456789ab>' AS mask, {_named(chr(39) + 'old' + chr(39), 'original_text')} AS fingerprint FROM n"
)
def migrated_store(spark, sf_dir):
    values = privacy.detect(_talk(spark, sf_dir)).where("privacy_type = 'Email'").select("original_text").distinct()
    numbered = audit.with_sum_before(values.withColumn("one", F.lit(1).cast("long")), "original_text", "one", "n")
    old = numbered.select(
        "original_text",
        F.lit("Email").alias("privacy_type"),
        F.explode(F.array(F.lit("PL2"), F.lit("PL3"))).alias("privacy_level"),
        F.concat(F.lit("<MPM_Email_"), (F.col("n") + 1).cast("string"), F.lit("_0123456789ab>")).alias("mask"),
    )
    return aliases.migrate(old, "old", privacy.TEST_KEY).drop("namespace", "privacy_type")


@_query(
    f"WITH {_TALK}, s AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS nth FROM (SELECT DISTINCT user_id FROM msg)), own AS (SELECT CASE WHEN m.message_index % 5 = 4 THEN 1 ELSE s.nth END AS nth, 1000 * s.nth + m.message_index AS line_no, m.content FROM msg m JOIN s USING (user_id) WHERE m.message_index % 4 <> 3) SELECT s.nth, md5(coalesce(string_agg(content, chr(10) ORDER BY line_no), '')) AS digest FROM s LEFT JOIN own USING (nth) GROUP BY s.nth"
)
def attack_documents(spark, sf_dir):
    m = _talk(spark, sf_dir)
    sources = audit.with_sum_before(
        m.select("user_id").distinct().withColumn("one", F.lit(1).cast("long")),
        "user_id",
        "one",
        "n",
    ).select((F.col("n") + 1).alias("nth"), "user_id")
    rows = m.join(sources, "user_id").select(
        F.lit("a").alias("artifact"),
        (1000 * F.col("nth") + F.col("message_index")).alias("line_no"),
        F.when(F.col("message_index") % 5 == 4, "").otherwise(F.col("user_id")).alias("identity"),
        F.lit("$.x").alias("path"),
        F.when(F.col("message_index") % 4 == 3, "other").otherwise("content").alias("name"),
        F.col("content").alias("value"),
    )
    return exposure.attack_documents(rows, sources).select("nth", F.md5("text").alias("digest"))


@_query(
    "WITH q AS (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT q.vec_id AS query_id, m.vec_id, round(list_cosine_similarity(m.embedding::DOUBLE[], x.embedding::DOUBLE[]), 9) AS s FROM q JOIN embeddings x USING (vec_id) JOIN embeddings m ON m.vec_id <> q.vec_id), best AS (SELECT query_id, vec_id FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) = 1) SELECT query_id AS question_id, '- memory ' || vec_id || ' of bo@mail.example.com' AS answer, CASE WHEN vec_id % 2 = 0 THEN 'correct' ELSE 'partial' END AS label, CASE WHEN vec_id % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS score, true AS is_valid FROM best"
)
def answered_questions(spark, sf_dir):
    """Answers that repeat the nearest memory and the question's private value: masked outside, restored at home."""
    e = _table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(
        F.col("vec_id").alias("question_id"),
        F.lit("u").alias("user_id"),
        F.lit("Who is bo@mail.example.com?").alias("question"),
        F.lit("x").alias("reference"),
        F.col("embedding").alias("query"),
    )
    items = spark.createDataFrame(
        [("u", "q", 0, "bo@mail.example.com", "Email", "PL3")],
        "user_id string, message_id string, pos long, original_text string, privacy_type string, privacy_level string",
    )

    def respond(question: str, context: str) -> str:
        assert "bo@" not in question
        return f"{context.splitlines()[0]} of {question[7:-1]}"

    memories = e.select("vec_id", F.concat(F.lit("memory "), F.col("vec_id").cast("string")).alias("text"), "embedding")
    return memory_eval.answer_questions(
        q,
        memories,
        privacy.known_items(items),
        privacy.vault(items),
        respond,
        lambda a, r: "correct" if int(a.split()[2]) % 2 == 0 else "partial",
        1,
    )
