"""Policies from settings, safe stand-ins, learned selection among them, and the tables it is trained on."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietlake.functions.checks import lower_fragments, shows_any, shows_fragment
from quietlake.functions.text import estimate_tokens, let
from quietlake.operators import privacy

#: The four actions and the four scopes.
ACTIONS = ["public_abstract", "public_reversible", "local_only", "drop"]
SCOPES = ["turn", "session", "task", "persistent"]
LEVEL_SCOPES = {"PL2": "task", "PL3": "session", "PL4": "turn"}
#: Names of the rules that go before a policy's own.
RULES = {"dropped": "mandatory:PL4-drop", "consented": "exact-required-with-consent", "refused": "exact-required-without-consent"}
#: Weights of the ranker without training.
WEIGHTS = {
    "bias": 0.0, "utility_score": 1.0, "leakage_score": -1.0, "token_count": -0.01, "abstraction_level": -0.05, "embedding_relevance": 0.25, "lexical_answer_overlap": 0.25,
    "attribute_risk_score": -0.30, "exact_leak_flag": -100.0, "pl4_flag": -100.0, "task_scope_flag": -0.05, "session_scope_flag": -0.15, "persistent_scope_flag": -0.35,
}
CANDIDATE = "struct<text:string,level:long,utility:double,leakage:double,representation:string>"


@dataclass(frozen=True)
class Policy:
    """Rules by level and by type, each (action, scope or None), and the scope of reversible aliases by level."""

    version: str = "minimal-public-v1"
    levels: dict[str, tuple[str, str | None]] = field(
        default_factory=lambda: {"PL2": ("public_abstract", None), "PL3": ("local_only", None), "PL4": ("drop", None)}
    )
    types: dict[str, tuple[str, str | None]] = field(default_factory=dict)
    scopes: dict[str, str] = field(default_factory=lambda: dict(LEVEL_SCOPES))

    def __post_init__(self):
        if not self.version.strip():
            raise ValueError("a policy needs a version")
        if lacking := sorted(set(privacy.LEVELS) - set(self.levels)):
            raise ValueError(f"no rule for {', '.join(lacking)}")
        for name, (action, scope) in {**self.levels, **self.types}.items():
            if action not in ACTIONS or scope not in (None, *SCOPES):
                raise ValueError(f"unknown action or scope for {name}")
            if (action == "public_reversible") != (scope is not None):
                raise ValueError(f"a scope goes with public_reversible and with nothing else: {name}")

    @classmethod
    def of(cls, settings: dict) -> Policy:
        """From settings, whose part ``public_memory`` counts if there is one; levels may be written in lower case."""
        own = settings.get("public_memory", settings)
        by_level = lambda table, level: table.get(level.lower(), table.get(level))
        actions, scopes = own.get("policy", {}), own.get("alias_scope", {})
        given = {level: by_level(actions, level) for level in privacy.LEVELS}
        rules = {level: (a, by_level(scopes, level) if a == "public_reversible" else None) for level, a in given.items() if a is not None}
        types = {kind: (rule, None) if isinstance(rule, str) else (rule["action"], rule.get("alias_scope") or None) for kind, rule in own.get("type_overrides", {}).items()}
        return cls(
            str(own.get("policy_version", "minimal-public-v1")),
            rules,
            types,
            LEVEL_SCOPES | {level: by_level(scopes, level) for level in privacy.LEVELS if by_level(scopes, level)},
        )

    def route(self, required: Column, consented: Column) -> Column:
        """Struct of action, scope and rule_id for a row with privacy_type and privacy_level. PL4 drops whatever else is set; then what is required exactly, then the type's rule, then the level's."""
        kind, level = F.col("privacy_type"), F.col("privacy_level")
        made = lambda action, scope, rule: F.struct(F.lit(action).alias("action"), (scope if isinstance(scope, Column) else F.lit(scope).cast("string")).alias("scope"), F.lit(rule).alias("rule_id"))
        # A rule's own scope goes before the level's.
        scopes = {name: scope for name, (_, scope) in self.types.items() if scope}
        own_scope = F.coalesce(
            *[F.when(kind == name, scope) for name, scope in scopes.items()],
            *[F.when(level == name, self.levels[name][1] or self.scopes[name]) for name in privacy.LEVELS],
        )
        if unscoped := [name for name, (_, scope) in self.types.items() if not scope]:
            own_scope = F.when(
                kind.isin(unscoped),
                F.coalesce(*[F.when(level == name, self.scopes[name]) for name in privacy.LEVELS]),
            ).otherwise(own_scope)
        out = F.when(level == "PL4", made("drop", None, RULES["dropped"])).when(
            required & consented,
            made("public_reversible", own_scope, RULES["consented"]),
        ).when(required, made("local_only", None, RULES["refused"]))
        for name, (action, scope) in self.types.items():
            out = out.when(kind == name, made(action, scope, f"type:{name}"))
        for name, (action, scope) in self.levels.items():
            out = out.when(level == name, made(action, scope, f"level:{name}"))
        return out.otherwise(
            F.raise_error(
                F.concat(F.lit("unknown level "), F.coalesce(level, F.lit("null")))
            ).cast("struct<action:string,scope:string,rule_id:string>")
        )


def stand_ins(kind: Column, required: Column) -> Column:
    """The four rule-based candidates of a type, from nothing to the type's name."""
    rows = privacy.candidates(kind, required, -1)
    return F.transform(
        rows,
        lambda c: F.struct(
            c["text"].alias("text"),
            (c["specificity"] + 1).alias("level"),
            c["utility"].alias("utility"),
            c["leakage"].alias("leakage"),
            c["representation"].alias("representation"),
        ),
    )


def safe(candidates: Column, value: Column) -> Column:
    """Candidates that show no part of the private value; of equal texts and representations, letters' case aside, the first."""
    clean = let(lower_fragments(value), lambda own: F.filter(candidates, lambda c: (c["text"] == "") | ~shows_any(c["text"], own)))
    name = lambda c: F.concat_ws("\0", F.lower(c["text"]), c["representation"])
    first = lambda own, names: F.filter(own, lambda _, i: F.array_position(names, F.get(names, i)) == i + 1)
    return let(clean, lambda own: let(F.transform(own, name), lambda names: first(own, names)))


def with_templates(items: DataFrame, templates: DataFrame, required: Column) -> DataFrame:
    """``items`` with candidates: fitting templates in their order, then the rules' stand-ins, all made safe.

    ``templates``: nth, privacy_type, privacy_level, text, level, utility, leakage, representation; a null or * fits all. Templates are a table of settings
    written by hand or distilled, a row per type, level and text; items find theirs by an equi-join for each of the four ways to fit.
    """
    star = lambda c: F.coalesce(F.col(c), F.lit("*"))
    t = templates.select(
        "nth",
        star("privacy_type").alias("t_type"),
        star("privacy_level").alias("t_level"),
        F.struct("text", F.col("level").cast("long").alias("level"), "utility", "leakage", "representation").alias("c"),
    )
    by_fit = t.groupBy("t_type", "t_level").agg(F.array_sort(F.collect_list(F.struct("nth", "c"))).alias("own"))
    kinds = items.select("privacy_type", "privacy_level").distinct()
    ways = kinds.select(
        "privacy_type",
        "privacy_level",
        F.explode(
            F.array(
                *[
                    F.struct(a.alias("t_type"), b.alias("t_level")) for a in (F.col("privacy_type"), F.lit("*")) for b in (F.col("privacy_level"), F.lit("*"))
                ]
            )
        ).alias("w"),
    ).select("privacy_type", "privacy_level", "w.*")
    learned = ways.join(by_fit, ["t_type", "t_level"]).groupBy("privacy_type", "privacy_level").agg(
        F.array_sort(F.flatten(F.collect_list("own"))).alias("own")
    )
    rows = items.join(learned, ["privacy_type", "privacy_level"], "left")
    first = F.coalesce(F.transform("own", lambda x: x["c"]), F.array().cast(f"array<{CANDIDATE}>"))
    both = F.concat(first.cast(f"array<{CANDIDATE}>"), stand_ins(F.col("privacy_type"), required).cast(f"array<{CANDIDATE}>"))
    return rows.withColumn("candidates", safe(both, F.col("original_text"))).drop("own")


def generator(mode: str, templates: DataFrame | None = None):
    """The way to candidates that a mode names: ``rule`` or ``artifact``; a function of items and the required condition."""
    if mode.lower() in ("rule", "deterministic", "fallback"):
        return lambda items, required: items.withColumn(
            "candidates",
            safe(stand_ins(F.col("privacy_type"), required), F.col("original_text")),
        )
    if mode.lower() in ("artifact", "learned"):
        if templates is None:
            raise ValueError("this mode needs templates")
        return lambda items, required: with_templates(items, templates, required)
    raise ValueError(f"unknown mode {mode}")


def public_candidates(candidates: Column) -> Column:
    """Those with a text."""
    return F.filter(candidates, lambda c: c["text"] != "")


def features(
    c: Column,
    value: Column,
    level: Column,
    scope: Column | None = None,
    relevance: Column | None = None,
    overlap: Column | None = None,
    risk: Column | None = None,
) -> Column:
    """Struct of a candidate's features, by the names of ``WEIGHTS``; the leak flag tells whether its text shows a part of the value."""
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    scope = F.lit("") if scope is None else F.coalesce(scope, F.lit(""))
    made = {
        "bias": F.lit(1.0), "utility_score": c["utility"], "leakage_score": c["leakage"], "token_count": F.log1p(estimate_tokens(c["text"], 1)), "abstraction_level": c["level"].cast("double"),
        "embedding_relevance": F.lit(0.0) if relevance is None else relevance, "lexical_answer_overlap": F.lit(0.0) if overlap is None else overlap,
        "attribute_risk_score": F.when(level.isin("PL3", "PL4"), 0.4).otherwise(0.1) if risk is None else risk, "exact_leak_flag": flag(shows_fragment(c["text"], value)), "pl4_flag": flag(level == "PL4"),
        "task_scope_flag": flag(scope == "task"), "session_scope_flag": flag(scope == "session"), "persistent_scope_flag": flag(scope == "persistent"),
    }
    return F.struct(*[x.alias(name) for name, x in made.items()])


def ranked(f: Column, weights: dict[str, float] | None = None) -> Column:
    """Dot product of features and weights."""
    own = WEIGHTS | (weights or {})
    return sum((f[name] * F.lit(float(w)) for name, w in own.items()), F.lit(0.0))


@dataclass(frozen=True)
class Limits:
    utility: float = 0.75
    leakage: float = 0.35
    tokens: int = 128
    score: float = float("-inf")
    leaks_fail: bool = True
    pl4_fails: bool = True


def decide(candidates: Column, value: Column, level: Column, weights: dict[str, float] | None = None, limits: Limits = Limits()) -> Column:
    """Struct of action, score, reason, text, representation and feasible: the best candidate within the limits, or why there is none.

    Those without a text are none. A candidate falls at the first limit that it breaks. Ties go to the lower level, the lower leakage, fewer tokens, then the later text.
    """

    def judged(c: Column) -> Column:
        tokens = estimate_tokens(c["text"], 1)

        def of(x: Column) -> Column:
            why = F.when(x["leak"] & limits.leaks_fail, "exact leak").when(
                (level == "PL4") & limits.pl4_fails,
                "PL4 public candidate",
            ).when(c["utility"] < limits.utility, "below utility floor")
            why = why.when(c["leakage"] > limits.leakage, "above leakage budget").when(tokens > limits.tokens, "above token budget").when(
                x["score"] < limits.score,
                "below learned score threshold",
            )
            return F.struct(
                why.alias("why"),
                x["score"].alias("score"),
                (-c["level"]).alias("low"),
                (-c["leakage"]).alias("safe"),
                (-tokens).alias("short"),
                c["text"].alias("text"),
                c["representation"].alias("representation"),
            )

        return let(
            let(features(c, value, level), lambda f: F.struct((f["exact_leak_flag"] > 0).alias("leak"), ranked(f, weights).alias("score"))),
            of,
        )

    def choose(rows: Column) -> Column:
        good = F.filter(rows, lambda r: r["why"].isNull())
        why = F.array_sort(F.array_distinct(F.transform(F.filter(rows, lambda r: r["why"].isNotNull()), lambda r: r["why"])))
        none = F.concat(
            F.lit("no candidate within the limits"),
            F.when(F.size(why) > 0, F.concat(F.lit(" ("), F.array_join(why, ", "), F.lit(")"))).otherwise(""),
        )
        keyed = F.transform(
            good,
            lambda r: F.struct(
                r["score"].alias("score"),
                r["low"].alias("low"),
                r["safe"].alias("safe"),
                r["short"].alias("short"),
                r["text"].alias("text"),
                r["representation"].alias("representation"),
            ),
        )
        return let(
            F.array_max(keyed),
            lambda b: F.struct(
                F.when(b.isNull(), "drop").otherwise("select").alias("action"),
                F.when(b.isNull(), F.lit(float("-inf"))).otherwise(b["score"]).alias("score"),
                F.when(b.isNull(), none).otherwise("highest score within the limits").alias("reason"),
                b["text"].alias("text"),
                b["representation"].alias("representation"),
                F.size(good).alias("feasible"),
            ),
        )

    return let(F.transform(public_candidates(candidates), judged), choose)


def selector(mode: str, weights: dict[str, float] | None = None, limits: Limits = Limits()):
    """The selection that a mode names: None where disabled, else a function of candidates, value and level."""
    if mode.lower() in ("disabled", "none", "rule"):
        return None
    if mode.lower() in ("linear", "artifact", "learned"):
        return lambda candidates, value, level: decide(candidates, value, level, weights, limits)
    raise ValueError(f"unknown mode {mode}")


def selector_examples(items: DataFrame) -> DataFrame:
    """A row for each candidate of each item with its label: score, and whether it is good within the default limits. Tokens are counted by white space."""
    shown = lambda c, own: F.struct(c.alias("c"), ((c["text"] != "") & shows_any(c["text"], own)).alias("leak"))
    judged = let(lower_fragments(F.col("original_text")), lambda own: F.transform("candidates", lambda c: shown(c, own)))
    rows = items.select(
        "user_id",
        "message_id",
        "item_index",
        "privacy_type",
        "privacy_level",
        F.posexplode(judged).alias("nth", "j"),
    ).select("user_id", "message_id", "item_index", "privacy_type", "privacy_level", "nth", "j.c", "j.leak")
    tokens = F.greatest(F.lit(1), F.size(F.regexp_extract_all(F.col("c.text"), F.lit(r"[^\s\p{Z}]+"), F.lit(0))))
    leak = F.col("leak")
    score = F.col("c.utility") - F.col("c.leakage") - 0.01 * tokens - F.when(leak, 100.0).otherwise(0.0)
    good = ~leak & (F.col("c.utility") >= 0.75) & (F.col("c.leakage") <= 0.35)
    return rows.select(
        "user_id",
        "message_id",
        "item_index",
        "nth",
        "privacy_type",
        "privacy_level",
        "c.*",
        tokens.cast("long").alias("token_count"),
        score.alias("label_score"),
        good.alias("label_positive"),
    )


def fit_weights(examples: DataFrame) -> DataFrame:
    """One row with the two fitted weights: class means of utility and leakage move them, within bounds; without both classes they stay as they are."""
    mean = lambda c, good: F.avg(F.when(F.col("label_positive") == good, F.col(c)))
    m = examples.agg(
        mean("utility", True).alias("pu"),
        mean("utility", False).alias("nu"),
        mean("leakage", True).alias("pl"),
        mean("leakage", False).alias("nl"),
    )
    utility = F.coalesce(F.greatest(F.lit(0.5), 1.0 + F.col("pu") - F.col("nu")), F.lit(WEIGHTS["utility_score"]))
    risk = F.col("nl") - F.col("pl")
    leakage = F.when(risk.isNull(), F.lit(WEIGHTS["leakage_score"])).otherwise(F.least(F.lit(-0.5), -1.0 - F.greatest(F.lit(0.0), risk)))
    return m.select(utility.alias("utility_score"), leakage.alias("leakage_score"))


def abstraction_examples(messages: DataFrame, items: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Items with their message's text, the texts around it, up to eight question hints of the user, and their safe candidates.

    ``messages``: user_id, message_id, message_index, content; ``hints``: user_id, nth, question, of which empty ones don't count.
    """
    from pyspark.sql.window import Window

    around = Window.partitionBy("user_id").orderBy("message_index").rowsBetween(-1, 1)
    context = messages.select(
        "user_id",
        "message_id",
        F.col("content").alias("message_text"),
        F.collect_list("content").over(around).alias("context"),
    )
    rows = items.join(context, ["user_id", "message_id"])
    if hints is not None:
        first = hints.where(F.coalesce("question", F.lit("")) != "").withColumn(
            "at",
            F.row_number().over(Window.partitionBy("user_id").orderBy("nth")),
        ).where("at <= 8")
        rows = rows.join(
            first.groupBy("user_id").agg(
                F.transform(F.array_sort(F.collect_list(F.struct("at", "question"))), lambda x: x["question"]).alias("hints")
            ),
            "user_id",
            "left",
        )
    else:
        rows = rows.withColumn("hints", F.lit(None).cast("array<string>"))
    made = generator("rule")(rows, F.lit(False))
    return made.withColumn("hints", F.coalesce("hints", F.array().cast("array<string>")))
