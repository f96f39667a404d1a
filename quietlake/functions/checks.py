"""Predicates and small parsers over answers, types, paths, addresses and settings, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietlake.functions.text import let, normalize_type, private_fragments

#: Words of a type whose values are canaries, and words of a type that name a sensitive attribute.
CRITICAL_WORDS = [
    "password",
    "passcode",
    "otp",
    "verification code",
    "recovery code",
    "api key",
    "access token",
    "secret key",
    "private key",
    "credential",
]
SENSITIVE_WORDS = [
    "medical", "health", "diagnosis", "prescription", "financial", "bank", "income", "debt", "loan", "credit", "religion", "ethnicity", "precise location", "address", "biometric", "password",
    "verification code", "recovery code", "api key", "token",
]
#: What a canary looks like.
CANARY = [
    "CANARY[-_:]?[A-Za-z0-9]+",
    "RC[-_ ]?[0-9]{3,}",
    "(?:sk|pk|api)[-_][A-Za-z0-9]{12,}",
    r"(?:^|[^\p{L}\p{N}_])[0-9]{6,8}(?:[^\p{L}\p{N}_]|$)",
]
#: Parts of a path that hold meaning, and parts that link records.
SEMANTIC = ["public_text", "content", "question", "answer", "evidence", "all_options"]
LINKAGE = ["source_fingerprint", "source_message_id", "scope_id", "provenance_id"]
#: Hosts of this machine, and ends of the names of settings that are secret.
LOCAL_HOSTS = ["localhost", "127.0.0.1", "::1"]
SECRET_KEYS = ["api_key", "apikey", "secret", "token", "password"]

_OPTION = r"^\s*\(?([A-Za-z])\)\s*([^\n]*)$"
_LABEL = r"^\s*\(?([A-Za-z])\)?[.)]?\s*$"
_CHOICE = r"(?i)^[(<{]?([abcd])[)>}]?$"


def option(text: Column) -> Column:
    """Struct of an option's label, lower-case or null, and its text."""
    label = F.nullif(F.lower(F.regexp_extract(text, _OPTION, 1)), F.lit(""))
    return F.struct(label.alias("label"), F.btrim(F.when(label.isNull(), text).otherwise(F.regexp_extract(text, _OPTION, 2))).alias("text"))


def answer_text(answer: Column, options: Column) -> Column:
    """What an answer says: for a mere label the text of the first option with that label, else the answer."""
    answer = F.btrim(F.coalesce(answer, F.lit("")))
    label = F.lower(F.regexp_extract(answer, _LABEL, 1))
    first = F.get(
        F.filter(F.transform(F.coalesce(options, F.array().cast("array<string>")), option), lambda o: o["label"] == label),
        F.lit(0),
    )
    return F.when(label == "", answer).otherwise(F.coalesce(F.nullif(first["text"], F.lit("")), answer))


def mcq_answer(response: Column, answer: Column) -> Column:
    """Struct of correct and valid for a choice of one letter a to d, with or without brackets."""
    said, right = (F.lower(F.regexp_extract(F.btrim(x), _CHOICE, 1)) for x in (response, answer))
    valid = F.coalesce((said != "") & (right != ""), F.lit(False))
    return F.struct((valid & (said == right)).alias("correct"), valid.alias("valid"))


def model_json(raw: Column, schema: str) -> Column:
    """A model's answer parsed by a schema: thoughts, a code fence and trailing commas go first; null where it is still no JSON."""
    body = F.regexp_replace(raw, "(?is)<think>.*?</think>", "")
    body = F.regexp_replace(F.regexp_replace(F.btrim(body), r"(?i)^```(?:json)?\s*|\s*```$", ""), r",\s*([\]}])", "$1")
    return F.from_json(body, schema)


def as_number(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def type_terms(kind: Column, level: Column) -> Column:
    """Words that a sensitive type and level imply, sorted."""
    name, high = normalize_type(kind), level.isin("PL3", "PL4")
    words = [
        F.when(F.length(name) >= 4, name),
        F.when(high, F.lower(level)),
        *[F.when(name.contains(w), F.lit(w)) for w in dict.fromkeys([*SENSITIVE_WORDS, *CRITICAL_WORDS])],
    ]
    return F.array_sort(F.array_distinct(F.filter(F.array_compact(F.array(*words)), lambda t: (F.length(t) >= 4) | t.rlike("^pl[0-9]$"))))


def is_canary(value: Column, kind: Column) -> Column:
    name = normalize_type(kind)
    critical = reduce(lambda a, b: a | b, (name.contains(w) for w in CRITICAL_WORDS))
    return F.coalesce(critical, F.lit(False)) | value.rlike("(?i)" + "|".join(f"(?:{p})" for p in CANARY))


def contains_any_case(text: Column, value: Column) -> Column:
    return F.lower(text).contains(F.lower(value))


def has_part(path: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (path.contains(p) for p in parts))


def shows_value(text: Column, value: Column, path: Column) -> Column:
    """Whether a place of meaning shows a value: four characters or more anywhere, shorter ones between characters that are no letters or digits."""
    wordly = lambda c: c.rlike(r"[\p{L}\p{N}]")
    n = F.length(value)
    alone = F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))),
        lambda i: (F.substring(text, i, n) == value) & ~wordly(
            F.when(i > 1, F.substring(text, i - 1, F.lit(1))).otherwise("")
        ) & ~wordly(F.substring(text, i + n, F.lit(1))),
    )
    return has_part(path, SEMANTIC) & (n > 0) & text.contains(value) & F.when(n >= 4, F.lit(True)).otherwise(alone)


def shows_fragment(text: Column, value: Column) -> Column:
    """Whether a text shows a part of a private value."""
    return shows_any(text, lower_fragments(value))


def lower_fragments(value: Column) -> Column:
    """The parts of a private value in lower case, to be bound once where several texts are looked at."""
    return F.transform(private_fragments(value), F.lower)


def shows_any(text: Column, fragments: Column) -> Column:
    """Whether a text shows one of ``lower_fragments``."""
    return let(F.struct(F.lower(text).alias("low"), fragments.alias("own")), lambda x: F.exists(x["own"], lambda f: x["low"].contains(f)))


def is_local(address: Column) -> Column:
    """Whether an address points to this machine."""
    host = F.lower(F.btrim(F.try_parse_url(address, F.lit("HOST")), F.lit("[]")))
    return F.coalesce(host.isin(LOCAL_HOSTS), F.lit(False))


def endpoint(address: Column, allow_remote: Column) -> Column:
    """local, remote where that is allowed, else an error: private text must not leave the machine by mistake."""
    refused = F.raise_error(F.concat(F.lit("refusing to send private text to "), F.coalesce(address, F.lit("nowhere"))))
    return F.when(is_local(address), "local").when(
        F.coalesce(allow_remote, F.lit(False)) & (F.btrim(address) != ""),
        "remote",
    ).otherwise(refused.cast("string"))


def is_literal_secret(key: Column, value: Column) -> Column:
    """A setting by a secret's name whose value is written out instead of naming a variable."""
    name = F.regexp_replace(F.lower(key), "-", "_")
    return reduce(lambda a, b: a | b, (name.endswith(k) for k in SECRET_KEYS)) & let(
        F.btrim(F.coalesce(value, F.lit(""))),
        lambda v: (v != "") & ~v.startswith("$"),
    )


def missing(required: list[str], present: Column) -> Column:
    """The required names that are not there, sorted."""
    return F.array_sort(F.array_except(F.array(*map(F.lit, required)), present))
