"""Detection, validation, propagation, vault, routing and masking of private values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietlake.functions import spans
from quietlake.functions.text import hmac_sha256, mask_prefix, normalize_type

#: Stand-in detector: type, level, pattern, group.
DETECTORS = [
    ("Email", "PL2", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 0),
    ("Phone Number", "PL2", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", 0),
    ("Network Identifier", "PL2", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 0),
    ("Financial Account", "PL3", r"[0-9]{16}", 0),
    ("Token", "PL4", r'token = "([0-9a-f]{40})"', 1),
]
#: What every match of a detector has; texts without it are not searched.
MARKS = {"Email": "@", "Phone Number": "+1 (", "Token": 'token = "'}
LEVELS = ["PL2", "PL3", "PL4"]
#: Keywords of a type, in order of precedence, and its public category.
CATEGORIES = [
    (["email", "phone", "address", "contact", "zip"], "contact information"),
    (["medical", "health", "diagnosis", "prescription", "biometric"], "health constraint relevant to future assistance"),
    (["financial", "transaction", "income", "asset", "debt", "loan", "credit"], "financial constraint relevant to future assistance"),
    (["job", "employer", "company", "school", "identity background"], "professional or educational context"),
    (["location", "itinerary", "trajectory", "accommodation"], "location or itinerary constraint"),
    (["account", "username", "network", "device", "ip"], "account or device reference"),
    (["relationship", "third-party", "real name", "name"], "person relevant to the user"),
]
OTHER_CATEGORY = "private contextual detail"
#: Level -> action of the default policy.
DEFAULT_POLICY = {"PL2": "abstract", "PL3": "local_only", "PL4": "drop"}
TEST_KEY = b"quietlake-test-key"


def detect(messages: DataFrame) -> DataFrame:
    """message_id, user_id, pos, original_text, privacy_type, privacy_level: one row per match, in detector order."""
    def matches(kind: str, level: str, pattern: str, group: int) -> Column:
        found = F.regexp_extract_all("content", F.lit(pattern), F.lit(group))
        if kind in MARKS:
            found = F.when(F.col("content").contains(MARKS[kind]), found).when(F.col("content").isNotNull(), F.array().cast("array<string>"))
        return F.transform(
            found,
            lambda x: F.struct(x.alias("original_text"), F.lit(kind).alias("privacy_type"), F.lit(level).alias("privacy_level")),
        )

    found = F.concat(*[matches(*d) for d in DETECTORS])
    rows = messages.select("message_id", "user_id", F.posexplode(found).alias("pos", "item"))
    return rows.select("message_id", "user_id", F.col("pos").cast("long").alias("pos"), "item.*")


def validate(items: DataFrame, messages: DataFrame, strict: bool = False) -> DataFrame:
    """Items with a known level and a non-blank value that stands in its message; exact triples once, the first. Strict raises instead."""
    rows = items.join(messages.select("message_id", "content"), "message_id")
    ok = F.col("privacy_level").isin(LEVELS) & (F.trim("original_text") != "") & (F.trim("privacy_type") != "") & F.col("content").contains(F.col("original_text"))
    if strict:
        rows = rows.where(
            F.when(F.coalesce(ok, F.lit(False)), True).otherwise(
                F.raise_error(F.concat(F.lit("invalid item in message "), F.col("message_id").cast("string")))
            )
        )
    first = Window.partitionBy("message_id", "original_text", "privacy_type", "privacy_level").orderBy("pos")
    return rows.where(ok).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "content")


def best_per_text(items: DataFrame) -> DataFrame:
    """Of a message's items with one text: the highest level, then the smallest type, then the first ``pos`` if there is one."""
    place = ["pos"] if "pos" in items.columns else []
    order = Window.partitionBy("message_id", "original_text").orderBy(F.desc("privacy_level"), "privacy_type", *place)
    return items.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def known_items(items: DataFrame) -> DataFrame:
    return items.select("user_id", "original_text", "privacy_type", "privacy_level").distinct()


#: Needles up to which they are sent to every task; with some 100 characters each they take tens of megabytes. Beyond, an equi-join on runs finds them.
NEEDLES = 200_000


def contains_join(texts: DataFrame, needles: DataFrame, on: str, keys: list[str], value: str, needle: str) -> DataFrame:
    """Pairs with equal ``on`` where ``needle`` stands in ``value``, with all columns of both; ``keys`` name a row of ``texts``. Empty needles and nulls match nothing.

    Up to ``NEEDLES`` different needles, counted first, go to all tasks as one automaton that reads each text once: no text is shuffled,
    whatever owner it has. More are looked up by ``_by_runs``. Either way only the pairs found meet the texts again.
    """
    wanted = needles.where((F.col(needle) != "") & F.col(on).isNotNull())
    few = wanted.select(needle).distinct().limit(NEEDLES + 1).toArrow().column(0).to_pylist()
    if len(few) > NEEDLES:
        return _by_runs(texts, wanted, on, keys, value, needle)
    found = _by_automaton(texts.select(on, *keys, value), few, needle).join(wanted, [on, needle])
    return texts.join(found, [on, *keys])


def _by_automaton(rows: DataFrame, words: list[str], needle: str) -> DataFrame:
    """The rows less their last column, once for each of the words that stands in it."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        find = ahocorasick.Automaton()
        for word in shared.value:
            find.add_word(word, word)
        find.make_automaton()
        for batch in batches:
            at, hits = [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist() if len(find) else []):
                for word in {w for _, w in find.iter(text)} if text else ():
                    at.append(i)
                    hits.append(word)
            if at:
                yield pa.RecordBatch.from_arrays(
                    [*batch.take(pa.array(at)).columns[:-1], pa.array(hits)],
                    names=[*batch.schema.names[:-1], needle],
                )

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}`{needle}` string")


def _by_runs(texts: DataFrame, needles: DataFrame, on: str, keys: list[str], value: str, needle: str) -> DataFrame:
    """A needle is looked up by one of its letter-digit runs that other characters of the needle enclose, the one that fewest texts have:
    wherever the needle stands, that run is a whole run of the text, so an equi-join on (on, run) finds all. Needles without such a run are
    looked up by the first four characters of their longest run, which stand somewhere in a run of the text; those without four in a row are
    compared with the texts of their ``on``.
    """
    inner = F.array_distinct(F.regexp_extract_all(needle, F.lit(r"(?<=[^A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])"), F.lit(0)))
    longest = F.aggregate(
        F.regexp_extract_all(needle, F.lit("[A-Za-z0-9]{4,}"), F.lit(0)),
        F.lit(""),
        lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a),
    )
    runs = texts.select(on, *keys, F.explode(F.array_distinct(F.regexp_extract_all(value, F.lit("[A-Za-z0-9]+"), F.lit(0)))).alias("run"))
    choices = needles.select(on, needle, F.explode_outer(inner).alias("run")).distinct()
    often = runs.join(
        choices.select(on, "run").distinct(),
        [on, "run"],
        "left_semi",
    ).groupBy(on, "run").agg(F.count(F.lit(1)).alias("often"))
    best = choices.join(often, [on, "run"], "left").groupBy(on, needle).agg(
        F.min_by("run", F.struct(F.coalesce("often", F.lit(0)).alias("o"), F.col("run"))).alias("run")
    )
    keyed = needles.join(best, [on, needle]).withColumn("gram", F.when(F.col("run").isNull(), F.left(longest, F.lit(4))))
    hit = F.col(value).contains(F.col(needle))
    by_run = runs.join(keyed.where("run is not null").drop("gram"), [on, "run"]).drop("run")
    grams = runs.where(F.length("run") >= 4).select(
        on,
        *keys,
        F.explode(
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("run") - 3), lambda i: F.substring("run", i, F.lit(4))))
        ).alias("gram"),
    ).distinct()
    by_gram = grams.join(keyed.where("gram <> ''").drop("run"), [on, "gram"]).drop("gram")
    near = by_run.unionByName(by_gram)
    alone = texts.join(keyed.where("gram = ''").drop("run", "gram"), on).where(hit)
    return texts.join(near, [on, *keys]).where(hit).unionByName(alone)


def propagate(known: DataFrame, messages: DataFrame) -> DataFrame:
    """Known values of a user in all of that user's messages."""
    found = contains_join(messages.select("user_id", "message_id", "content"), known, "user_id", ["message_id"], "content", "original_text")
    return found.select("message_id", "user_id", "original_text", "privacy_type", "privacy_level").distinct()


def vault(items: DataFrame, key: bytes = TEST_KEY, typed: bool = True) -> DataFrame:
    """One row for each namespace, value and type: fingerprint, highest level, running number within the type, and its mask.

    The mask's suffix comes from the fingerprint, so the same value has the same mask whatever the order of writes.
    """
    own = items.groupBy(F.col("user_id").alias("namespace"), "original_text", "privacy_type").agg(
        F.max("privacy_level").alias("privacy_level"),
        F.min(F.struct("message_id", "pos")).alias("seen"),
    )
    rows = own.withColumn(
        "seq",
        F.row_number().over(Window.partitionBy("namespace", "privacy_type").orderBy("seen", "original_text")).cast("long"),
    )
    rows = rows.withColumn("fingerprint", hmac_sha256(key, F.concat_ws("\0", "namespace", "original_text")))
    prefix = mask_prefix(F.col("privacy_type")) if typed else F.lit("Private")
    mark = F.concat(
        F.lit("<MPM_"),
        prefix,
        F.lit("_"),
        F.col("seq").cast("string"),
        F.lit("_"),
        F.left(F.col("fingerprint"), F.lit(12)),
        F.lit(">"),
    )
    return rows.withColumn("mask", mark).drop("seen")


def mask_messages(messages: DataFrame, items: DataFrame, store: DataFrame | None, levels: list[str] = LEVELS[1:]) -> DataFrame:
    """message_id, content, masked, pairs: values of the levels replaced by their masks, or by *** without a store."""
    chosen = best_per_text(items.where(F.col("privacy_level").isin(levels)))
    if store is None:
        chosen = chosen.withColumn("mask", F.lit("***"))
    else:
        chosen = chosen.join(
            store.select(F.col("namespace").alias("user_id"), "original_text", "privacy_type", "mask"),
            ["user_id", "original_text", "privacy_type"],
        )
    pairs = chosen.groupBy("message_id").agg(
        F.collect_list(F.struct(F.col("original_text").alias("old"), F.col("mask").alias("new"), F.lit(False).alias("drop"))).alias("pairs")
    )
    return messages.join(pairs, "message_id").select(
        "message_id",
        "content",
        spans.mask(F.col("content"), F.col("pairs")).alias("masked"),
        "pairs",
    )


def protect_known(texts: DataFrame, known: DataFrame, store: DataFrame | None, levels: list[str] = LEVELS[1:]) -> DataFrame:
    """message_id and text of all rows, with the user's known values of the levels masked where they stand. ``texts``: message_id, user_id, content."""
    here = propagate(known.where(F.col("privacy_level").isin(levels)), texts)
    done = mask_messages(texts, here, store, levels).select("message_id", "masked")
    return texts.join(done, "message_id", "left").select("message_id", F.coalesce("masked", "content").alias("text"))


def detect_and_mask(
    messages: DataFrame,
    levels: list[str] = LEVELS[1:],
    detector=None,
    key: bytes = TEST_KEY,
) -> tuple[DataFrame, DataFrame]:
    """message_id and text of all messages with what a detector finds masked, and the vault of its values.

    ``detector`` takes the messages and returns items like ``detect``, which stands in for a model; an item that does not stand in its message raises.
    """
    items = validate((detector or detect)(messages), messages, strict=True)
    store = vault(items, key)
    done = mask_messages(messages, items, store, levels).select("message_id", "masked")
    return messages.join(done, "message_id", "left").select("message_id", F.coalesce("masked", "content").alias("text")), store


def route(required: Column | None = None, consented: Column | None = None, overrides: dict[str, str] | None = None) -> Column:
    """Action for a row with privacy_type and privacy_level; PL4 drops whatever else is set."""
    action = F.when(F.col("privacy_level") == "PL4", "drop")
    if required is not None:
        action = action.when(required & consented, "reversible").when(required, "local_only")
    for kind, what in (overrides or {}).items():
        action = action.when(F.col("privacy_type") == kind, what)
    for level, what in DEFAULT_POLICY.items():
        action = action.when(F.col("privacy_level") == level, what)
    return action.otherwise(F.raise_error(F.lit("no rule for level")))


def category(kind: Column) -> Column:
    out = F
    for words, text in CATEGORIES:
        out = out.when(F.lower(kind).rlike("|".join(words)), text)
    return out.otherwise(OTHER_CATEGORY)


#: Representation, level, utility (where the type is needed exactly, else), leakage. The category and the type's name stand for the missing texts.
STAND_INS = [("generic_abstract", 0, 0.40, 0.68, 0.05), ("category_abstract", 1, 0.92, 0.82, 0.20), ("typed_abstract", 2, 0.96, 0.96, 0.45)]
NOTHING = ("drop", -1, 0.0, 0.0, 0.0)


def candidates(kind: Column, required: Column, least_level: int = 0) -> Column:
    """Ordered public stand-ins of a type; from level 0 three, with the empty one (level -1 here) four."""
    texts = {
        "drop": F.lit(""),
        "generic_abstract": F.lit("private detail"),
        "category_abstract": category(kind),
        "typed_abstract": F.concat(F.lit("private "), F.lower(kind), F.lit(" value")),
    }

    def one(name: str, level: int, needed: float, else_: float, leakage: float) -> Column:
        utility = F.when(required, needed).otherwise(else_)
        return F.struct(
            texts[name].alias("text"),
            F.lit(level).cast("long").alias("specificity"),
            utility.alias("utility"),
            F.lit(leakage).alias("leakage"),
            F.lit(name).alias("representation"),
        )

    return F.array(*[one(*row) for row in ([NOTHING] if least_level < 0 else []) + STAND_INS])


def select_sufficient(options: Column, tokens, floor: float = 0.75, most_leakage: float = 0.35, most_tokens: int = 128) -> Column:
    """The least specific candidate within the budgets; ties by leakage, tokens, text."""
    fit = F.filter(options, lambda c: (c["utility"] >= floor) & (c["leakage"] <= most_leakage) & (tokens(c["text"]) <= most_tokens))
    order = F.transform(
        fit,
        lambda c: F.struct(
            c["specificity"].alias("specificity"),
            c["leakage"].alias("leakage"),
            tokens(c["text"]).alias("tokens"),
            c["text"].alias("text"),
            c["representation"].alias("representation"),
        ),
    )
    return F.array_min(order)


def matches_type(kind: Column, template: Column) -> Column:
    return template.isNull() | (template == "*") | (normalize_type(kind) == normalize_type(template))
