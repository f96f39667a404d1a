"""The minimizer and the compiler's scrubbing against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quietlake.operators import minimize, privacy
from quietlake.plans import compiler

SENTENCES = [
    "I live in Oslo now.", "My address changed to 12 Long Street!", "Could you help me?", "Please forget that.", "Here are some ideas.", "ok.", "I prefer tea, not coffee.",
    "What is the best time?", "Certainly, happy to help.", "I paid $ 300 in 2024-01-05.", "The sky was grey and the road was long, and nobody said anything of note for a while.",
    "我喜欢喝茶。", "你能解释一下吗？", "请忘记这个。", "Remember the meeting, it is booked.", "émy dog is here.", "I will remember it.", "Don't remember my code.", "keep it private!", "Numbers 42 and 7.",
]
TOKEN = re.compile(r"[A-Za-z0-9_]+|[^\x00-\x7F]")


def count(text, family):
    return sum(bool(re.search(p, text.lower(), re.IGNORECASE)) for p in minimize.PATTERNS[family])


def weigh(text, role, protected):
    """What each rule gives, added up; whether it is protected; whether it must stay."""
    held = any(f and f in text for f in protected)
    calls_off = count(text, "memory_control") > 0 or count(text, "ephemeral") > 0
    gains = [10 * held, role == "user", 2 * count(text, "facts")]
    losses = [2 * count(text, "questions"), 8 * (count(text, "memory_control") > 0), 5 * (count(text, "ephemeral") > 0), 3 * count(text, "boilerplate"), 0.5 * (len(text) < 12)]
    return sum(gains) - sum(losses), held, role == "user" and not calls_off and count(text, "must_keep") > 0


def expected(units, whole, role, protected, b):
    """The rules of the budget, each as a pass over what is not chosen yet."""
    if len(units) < 2:
        total, held, must = weigh(whole, role, protected)
        return whole if held or must or total > 0 else ""
    info = {i: (max(1, len(TOKEN.findall(u))), *weigh(u, role, protected)) for i, u in enumerate(units)}
    goal = min(b.most, max(b.least, int(len(TOKEN.findall(whole)) * b.ratio)))
    keep = {i for i, x in info.items() if x[2]}
    spent = lambda: sum(info[i][0] for i in keep)
    for i, x in info.items():
        if x[3] and i not in keep and (not keep or spent() + x[0] <= b.most):
            keep.add(i)
    for i in sorted(set(info) - keep, key=lambda i: (-info[i][1], info[i][0], i)):
        if not keep or (info[i][1] > 0 and spent() + info[i][0] <= goal):
            keep.add(i)
            if spent() >= goal:
                break
    return " ".join(u for i, u in enumerate(units) if i in keep)


@pytest.mark.parametrize("budget", [minimize.Budget(), minimize.Budget(ratio=0.3, most=20, least=4)])
def test_minimizer_equals_the_rules(spark, budget):
    rng = random.Random(4)
    rows = []
    for k in range(250):
        units = [rng.choice(SENTENCES) for _ in range(rng.randint(0, 9))]
        rows.append((k, rng.choice(["user", "assistant"]), units, rng.sample(["Oslo", "tea", "", "grey"], rng.randint(0, 2))))
    frame = spark.createDataFrame([(k, r, " ".join(u) if k % 2 else "\n".join(u), p) for k, r, u, p in rows], "message_id long, role string, content string, protected array<string>")
    got = {r.message_id: r.public_text for r in minimize.minimize_messages(frame, budget).collect()}
    for k, role, units, protected in rows:
        whole = " ".join(units) if k % 2 else "\n".join(units)
        assert got[k] == expected(units, whole, role, protected, budget), (role, units, protected)


def test_minimizer_plan_has_no_python(spark):
    frame = spark.createDataFrame([(1, None, None, None)], "message_id long, role string, content string, protected array<string>")
    done = minimize.minimize_messages(frame)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert done.first().public_text == ""
    assert minimize.minimize_messages(frame, minimize.Budget(enabled=False)).first().public_text == ""


def test_contains_join_ways_agree(spark, monkeypatch):
    rng = random.Random(3)
    words = ["anna", "bo", "c.d@mail5.example.com", "4111111111111111", "x-9 (zz) 7", "京都", "é", "aa", "longertoken99", "19@mail5"]
    texts = [(k % 3, k, " ".join(rng.choice(words + ["and", "or", "xanna!", "9941111111111111112"]) + rng.choice(["", ",", "z"]) for _ in range(rng.randint(0, 12)))) for k in range(120)] + [(None, 500, "anna"), (0, 501, None)]
    needles = [(o, w, f"k{o}") for o in range(3) for w in words if rng.random() < 0.7] + [(0, "", "none"), (None, "anna", "none")]
    t = spark.createDataFrame(texts, "owner long, id long, value string")
    n = spark.createDataFrame(needles, "owner long, needle string, kind string")
    want = sorted((i, w, k) for o, i, v in texts for p, w, k in needles if o is not None and o == p and v is not None and w and w in v)
    for limit in (200_000, 0):
        monkeypatch.setattr(privacy, "NEEDLES", limit)
        got = privacy.contains_join(t, n, "owner", ["id"], "value", "needle")
        assert sorted((r.id, r.needle, r.kind) for r in got.collect()) == want
    assert privacy.contains_join(t, n.where("false"), "owner", ["id"], "value", "needle").count() == 0


def test_residual_terms_and_scrub(spark):
    items = spark.createDataFrame([("u", "Anna-Marie with Lee", "Real Name", "PL2"), ("u", "12345", "Code", "PL3"), ("u", "京都", "City", "PL2"), ("v", "ab", "x", "PL2"), ("v", "public", "x", "PL1")], "user_id string, original_text string, privacy_type string, privacy_level string")
    terms = compiler.residual_terms(items)
    assert {(r.user_id, r.term) for r in terms.collect()} == {("u", "Anna-Marie with Lee"), ("u", "Anna-Marie"), ("u", "12345"), ("u", "京都")}
    rows = spark.createDataFrame([(1, "u", "Anna-Marie left. I stayed. Code 12345!"), (2, "v", "Kept as  is. public"), (3, "u", ""), (4, "u", "nothing here")], "message_id long, user_id string, text string")
    assert {r.message_id: r.text for r in compiler.scrub_residual(rows, terms).collect()} == {1: "I stayed.", 2: "Kept as  is. public", 3: "", 4: "nothing here"}


def test_long_messages_stay_linear(spark):
    frame = spark.range(1).select(F.lit(1).alias("message_id"), F.lit("user").alias("role"), F.expr("repeat('I like long days and short nights. ', 3000)").alias("content"), F.array().cast("array<string>").alias("protected"))
    assert len(minimize.minimize_messages(frame).first().public_text) < 1500


def split(text):
    found = []
    for line in re.split("\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]", text):
        found += [m[0].strip() for m in re.finditer("[^\n]+?(?:[.!?。！？；;]+[\"'”’]*|$)(?:\\s+|$)", line)]
    return [u for u in found if u]


def tidy(text):
    text = re.sub(r"[ \t]+", " ", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+([,.;:!?，。；：！？])", r"\1", text)).strip()


def compiled(text, role):
    """A message's public text: what its values become, in the order of their lengths, deletions swallowing what they meet."""
    items = {}
    for kind, level, pattern, group in privacy.DETECTORS:
        for m in re.finditer(pattern, text):
            items[m[group]] = min(items.get(m[group], (9, "")), (-int(level[2]), kind))
    spans, shown = [], []
    for value in sorted(items, key=lambda v: (-len(v), text.find(v))):
        level, kind = items[value]
        words = next((t for ws, t in privacy.CATEGORIES if any(w in kind.lower() for w in ws)), privacy.OTHER_CATEGORY)
        if level == -2:
            shown.append(words)
        at = text.find(value)
        while at >= 0:
            a, b = at, at + len(value)
            if level != -2:
                a -= len(re.search(r"[^.!?。！？；;\n]*\Z", text[:at])[0])
                b += len(re.match(r"[^.!?。！？；;\n]*[.!?。！？；;\n]?\s*", text[b:])[0])
            spans.append((-len(value), at, a, b, words if level == -2 else "", level != -2))
            at = text.find(value, at + len(value))
    kept = [s[2:] for s in sorted(spans)]
    for _ in range(2):
        queue, kept = kept, []
        for a, b, new, drop in queue:
            hit = [k for k in kept if k[0] < b and a < k[1]]
            if not hit:
                kept.append((a, b, new, drop))
            elif drop or any(k[3] for k in hit):
                kept = [k for k in kept if k not in hit] + [(min(a, *(k[0] for k in hit)), max(b, *(k[1] for k in hit)), "", True)]
    for a, b, new, _ in sorted(kept, reverse=True):
        text = text[:a] + new + text[b:]
    text = tidy(text)
    return tidy(expected(split(text), text, role, shown, minimize.Budget()))


def test_compiled_messages_equal_plain_python(spark):
    docs = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rng = random.Random(8)
    values = ["bo@mail1.example.com", "4111111111111111", "+1 (555) 010-1234", "10.0.0.1", f'token = "{"ab" * 20}"']
    made = [" ".join(rng.choice([*SENTENCES, f"Mine is {rng.choice(values)}, and {rng.choice(values)}.", f"{rng.choice(values)}!", f"see {rng.choice(values)}\n\n\nthen  go ."]) for _ in range(rng.randint(1, 8))) for _ in range(150)]
    rows = [(i, f"u{i}", rng.choice(["user", "assistant"]), t) for i, t in enumerate(docs + made)]
    m = spark.createDataFrame(rows, "message_id long, user_id string, role string, content string")
    got = {r.message_id: r.public_text for r in compiler.compile_public(m, privacy.validate(privacy.detect(m), m)).collect()}
    for i, _, role, text in rows:
        assert got[i] == compiled(text, role), text
