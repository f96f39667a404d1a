"""Operators of the privacy and public-memory engine: behaviour, and differential tests of the span functions."""

import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quietlake.functions import spans, text
from quietlake.operators import audit, dialogue, minimize, privacy, scoring
from quietlake.plans import compiler
from quietlake.sources import dialogues


def greedy(t, pairs):
    hits = []
    for old, new in pairs:
        at = t.find(old)
        while old and at >= 0:
            hits.append((-len(old), at, at + len(old), new))
            at = t.find(old, at + len(old))
    kept = []
    for h in sorted(hits):
        if all(h[2] <= k[1] or k[2] <= h[1] for k in kept):
            kept.append(h)
    for _, a, b, new in sorted(kept, key=lambda k: -k[1]):
        t = t[:a] + new + t[b:]
    return t


def test_mask_equals_plain_greedy(spark):
    rng, rows = random.Random(1), []
    for _ in range(300):
        t = "".join(rng.choice("ab\\EQ*(.🙂") for _ in range(rng.randint(0, 25)))
        rows.append((t, [(v, f"<{i}>", False) for i, v in enumerate({"".join(rng.choice("ab\\EQ*(.🙂") for _ in range(rng.randint(1, 3))) for _ in range(3)})]))
    df = spark.createDataFrame(rows, "t string, p array<struct<old string, new string, drop boolean>>")
    for r in df.select("t", "p", spans.mask(F.col("t"), F.col("p")).alias("m")).collect():
        assert r.m == greedy(r.t, [(p.old, p.new) for p in sorted(r.p, key=lambda p: p.new)]), r


def messages(spark, *texts):
    return spark.createDataFrame([(i, "u", "user", t) for i, t in enumerate(texts)], "message_id long, user_id string, role string, content string")


def items(spark, *rows):
    return spark.createDataFrame([(m, "u", i, *r) for i, (m, *r) in enumerate(rows)], "message_id long, user_id string, pos long, original_text string, privacy_type string, privacy_level string")


def test_validation_drops_or_raises(spark):
    m = messages(spark, "call me at 555", "nothing")
    i = items(spark, (0, "555", "Phone", "PL2"), (0, "555", "Phone", "PL2"), (0, "777", "Phone", "PL2"), (0, "me", "Name", "PL1"), (0, "", "Name", "PL2"))
    assert [r.original_text for r in privacy.validate(i, m).collect()] == ["555"]
    with pytest.raises(Exception, match="invalid item"):
        privacy.validate(i, m, strict=True).collect()


def test_best_level_wins_whatever_the_order(spark):
    i = items(spark, (0, "x", "B", "PL2"), (0, "x", "A", "PL4"), (0, "x", "C", "PL4"))
    assert [(r.privacy_type, r.privacy_level) for r in privacy.best_per_text(i).collect()] == [("A", "PL4")]


def test_of_equal_items_the_first_is_best(spark):
    i = items(spark, *[(0, "x", "A", "PL2")] * 9)
    assert [r.pos for r in privacy.best_per_text(i.orderBy(F.desc("pos")).coalesce(1)).collect()] == [0]


def test_deletions_merge_and_take_overlaps(spark):
    m = messages(spark, "Hi there. My pin is 4321 at a@b.org now. Bye.")
    i = items(spark, (0, "4321", "Token", "PL4"), (0, "a@b.org", "Email", "PL2"))
    r = compiler.compile_public(m, i).first()
    assert "4321" not in r.public_text and "a@b.org" not in r.public_text
    assert compiler.replaced(m, compiler.compile_items(m, items(spark, (0, "a@b.org", "Email", "PL2")))[0]).first().text == "Hi there. My pin is 4321 at contact information now. Bye."


def test_vault_masks_restore_and_stay_apart_by_namespace(spark):
    m = messages(spark, "mail a@b.org and c@d.org", "again a@b.org")
    i = privacy.detect(m)
    v = privacy.vault(i)
    done = privacy.mask_messages(m, i, v, privacy.LEVELS)
    assert all(r.back == r.content and "@" not in r.masked for r in done.withColumn("back", spans.unmask(F.col("masked"), F.col("pairs"))).collect())
    other = privacy.vault(i.withColumn("user_id", F.lit("other")))
    assert not {r.fingerprint for r in v.collect()} & {r.fingerprint for r in other.collect()}


def test_route_precedence(spark):
    i = items(spark, (0, "a", "Email", "PL4"), (1, "a", "Email", "PL2"), (3, "a", "Email", "PL2"), (5, "a", "Phone", "PL3"))
    got = i.select("message_id", privacy.route(F.col("privacy_type") == "Email", F.col("message_id") == 1).alias("a")).collect()
    assert {r.message_id: r.a for r in got} == {0: "drop", 1: "reversible", 3: "local_only", 5: "local_only"}


def test_propagation_equals_plain_contains(spark):
    m = messages(spark, "key ab-cd-ef, 12345", "xab-cd-efx 9912345", "none")
    known = spark.createDataFrame([("u", v, "T", "PL3") for v in ("ab-cd-ef", "12345", "cd")], "user_id string, original_text string, privacy_type string, privacy_level string")
    got = {(r.message_id, r.original_text) for r in privacy.propagate(known, m).collect()}
    assert got == {(0, "ab-cd-ef"), (0, "12345"), (0, "cd"), (1, "ab-cd-ef"), (1, "12345"), (1, "cd")}


def test_minimizer_keeps_facts_and_order(spark):
    cases = [
        ("Here are some ideas. I prefer tea in the morning. The sky has a colour. Could you explain rain?", "user", [], 0.5, "I prefer tea in the morning."),
        ("Please forget my address. I like cats.", "user", [], 0.65, "I like cats."),
        ("Of course, here is the list", "assistant", [], 0.65, ""),
        ("The secret word is blue. It rained.", "assistant", ["secret word"], 0.65, "The secret word is blue."),
    ]
    for text, role, protected, ratio, want in cases:
        row = spark.createDataFrame([(1, role, text, protected)], "message_id long, role string, content string, protected array<string>")
        assert minimize.minimize_messages(row, minimize.Budget(ratio=ratio)).first().public_text == want


def test_assignment_is_optimal_not_greedy():
    pairs = scoring.assign([[0.9, 0.8], [0.85, 0.1]])
    assert sorted(pairs) == [(0, 1), (1, 0)]
    from itertools import permutations

    rng = random.Random(2)
    for _ in range(200):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        w = [[rng.random() for _ in range(m)] for _ in range(n)]
        best = max(sum(w[i][j] for i, j in zip(range(n), p, strict=False)) for p in permutations(range(m), n)) if n <= m else max(sum(w[i][j] for i, j in zip(p, range(m), strict=False)) for p in permutations(range(n), m))
        assert abs(sum(w[i][j] for i, j in scoring.assign(w)) - best) < 1e-9


def test_both_sides_empty_score_one():
    assert scoring.Judge().match([], [], "x", "mean") == (1.0,) * 6


def test_auc_with_ties_and_one_class(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 5) / 5, rng.randint(0, 1)) for _ in range(60)]
    p, n = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))
    assert abs(audit.auc(spark.createDataFrame(rows, "score double, label int")).first().auc - want) < 1e-12
    assert audit.auc(spark.createDataFrame([(0.5, 1)], "score double, label int")).first().auc is None


def test_pareto_and_gates(spark):
    rows = [(1, True, None, None, 0.0, 0.0, 0, 0.5, 0.5, 10), (2, True, False, None, 0.0, 0.0, 0, 0.9, 0.5, 10), (3, None, True, None, 0.1, 0.0, 1, 0.4, 0.5, 20)]
    runs = spark.createDataFrame(rows, "max_public_tokens long, audit_passed boolean, cloud_audit_passed boolean, adversarial_passed boolean, exact_recovery_rate double, pl4_public_retention_rate double, adversarial_failure_count long, utility double, local double, public_token_count long")
    assert {r.max_public_tokens: r.failed for r in dialogue.gates(runs).collect()} == {1: "", 2: "cloud_audit_failed", 3: "builtin_audit_failed,exact_recovery_over_budget,adversarial_failures_present"}
    assert [r.max_public_tokens for r in dialogue.pareto(runs).collect()] == [2]
    assert tuple(dialogue.recommend(runs).first()) == (1, 1, 1)


def test_units_and_fragments(spark):
    df = spark.createDataFrame([("One. Two” lost\nThree! four", "jane.doe@mail.example.org 12-345")], "t string, v string")
    r = df.select(text.split_units(F.col("t")).alias("a"), text.split_units(F.col("t"), by_line=False).alias("b"), text.private_fragments(F.col("v")).alias("f")).first()
    assert r.a == ["One.", "Two” lost", "Three!", "four"] and r.b == ["One.", "Three!", "four"]
    assert {"jane.doe", "mail.example.org", "example", "mail", "12345", "2345"} <= set(r.f)


def test_dialogue_files_round_trip(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"uuid": "u1", "dialogues": [{"role": "user", "content": "hé", "privacy_info": []}, {"content": "b"}]}\n\nnot json\n')
    users = dialogues.read_users(spark, str(path))
    assert users.where("bad_line is not null").count() == 1
    m = dialogues.read_messages(users.where("bad_line is null"))
    assert [(r.message_id, r.role, r.content) for r in m.orderBy("message_index").collect()] == [("u1:0", "user", "hé"), ("u1:1", "user", "b")]
    dialogues.write_users(m, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().dialogues[0].content == "hé"


def test_scoped_joins_have_no_cross_product(spark):
    m = messages(spark, "a@b.org")
    plan = privacy.propagate(privacy.known_items(privacy.detect(m)), m)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_entry_works_without_the_pipeline_operators(tmp_path):
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/quietlake", tmp_path / "quietlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout.split()[0]) > 40, done.stderr


def test_search_takes_more_queries_than_a_block(spark):
    memories = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(3)], "vec_id long, embedding array<float>")
    queries = spark.range(10, 10_030).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("query"))
    found = dialogue.top_k(memories, queries, 2)
    assert found.count() == 2 * 10_020 and found.select("query_id").distinct().count() == 10_020
    few = queries.where("query_id % 1000 = 10")
    key = lambda df: sorted(map(tuple, df.select("query_id", "vec_id", "similarity", "rank").collect()))
    assert key(found.where("query_id % 1000 = 10")) == key(dialogue.top_k(memories, few, 2))


def test_search_equals_the_cosine_of_every_pair(spark):
    rng = random.Random(3)
    vector = lambda n: [float(rng.randint(-3, 3)) if rng.random() < 0.5 else rng.gauss(0, 1) for _ in range(n)]
    odd = [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0], [float("inf"), 1.0, 0.0, 0.0], [1e-160, 1e-160, 0.0, 0.0], [1e160, -1e160, 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, vector(4)) for i in range(300)] + [(300 + i, v) for i, v in enumerate(odd + odd + [[1.0, 1.0, 0.0, 0.0]] * 40)] + [(7, vector(4)), (7, [1.0, 1.0, 0.0, 0.0])]
    for kind in ("long", "string"):
        m = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("vec_id", F.col("vec_id").cast(kind)).repartition(5)
        q = m.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
        s = F.round(dialogue.cosine(F.col("embedding"), F.col("query")), 9)
        pairs = {}
        for r in m.crossJoin(q).where("vec_id <> query_id").select("query_id", "vec_id", s.alias("s")).collect():
            key = (2, 0.0) if r.s is None else (0, 0.0) if r.s != r.s else (1, -r.s)
            pairs.setdefault(r.query_id, []).append((*key, r.vec_id))
        for k in (1, 20, 400):
            got = {}
            for r in dialogue.top_k(m, q, k).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append((*((2, 0.0) if r.similarity is None else (0, 0.0) if r.similarity != r.similarity else (1, -r.similarity)), r.vec_id))
            assert got == {i: sorted(own)[:k] for i, own in pairs.items()}
    assert dialogue.top_k(m.where("false"), q, 3).count() == 0 and dialogue.top_k(m, q.where("false"), 3).count() == 0


def test_search_makes_no_pairs_in_the_plan(spark):
    m = spark.range(50).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    plan = dialogue.top_k(m, m.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_questions_make_no_pairs_with_memories_in_the_plan(spark, sf):
    from quietlake.plans import memory_queries

    plan = memory_queries.answered_questions(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_split_by_doc_id_has_no_class_in_one_task(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(-40, 400)]), rng.choice([0, 0, 0, 1, 2, None]), f"t{i}") for i in range(600)] + [(9, 3, "a"), (9, 3, "b"), (9, 3, "c"), (1, 4, "d")]
    frame = spark.createDataFrame(rows, "doc_id long, label int, text string").repartition(6)
    for some in (rows, [r for r in rows[:600] if r[0] is not None and r[1] == 2][:1], []):
        have = frame if some is rows else spark.createDataFrame(some, frame.schema)
        for ratio in (0.25, 0.5):
            split = audit.split_last(have, ratio)
            got = [tuple(r) for r in split.select("doc_id", "label", "text", "test").collect()]
            assert sorted(map(repr, (r[:3] for r in got))) == sorted(repr(r) for r in some if r[1] is not None)
            for label in {r[1] for r in got}:
                own = [r for r in got if r[1] == label]
                k = max(1, round(len(own) * ratio))
                last = sorted((-(1 << 40) if r[0] is None else r[0] for r in own), reverse=True)[:k]
                assert sorted((-(1 << 40) if r[0] is None else r[0] for r in own if r[3]), reverse=True) == last
    plan = audit.split_last(frame.dropDuplicates(["doc_id"]), 0.3)._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan


@pytest.mark.parametrize("name", ["attack_report", "attack_auc", "nb_scores", "top_positive_tokens", "nb_token_counts"])
def test_attack_queries_number_no_class_in_one_task(spark, sf, name):
    from quietlake.plans import catalogue, memory_queries  # noqa: F401

    assert "row_number" not in catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_sentences_of_long_texts_take_no_square_of_time(spark):
    import time

    n = 200_000
    rows = spark.createDataFrame([("One. " + "x " * n + "y." + "1.2" * n + " end. Z",)], "t string")
    at = F.length("t") - F.lit(3 * n + 8)
    began = time.time()
    r = rows.select(spans.sentence_start(F.col("t"), at).alias("a"), at.alias("at"), text.split_units(F.col("t")).alias("u"), text.estimate_tokens(F.col("t")).alias("n")).first()
    assert r.a == 5 and r.at > 2 * n and [len(u) for u in r.u] == [4, 5 * n + 7, 1] and r.n > n
    assert time.time() - began < 20


def test_parts_of_a_value_are_taken_once_an_item(spark):
    from quietlake.operators import selection

    i = spark.range(3).select(F.lit("Email").alias("privacy_type"), F.lit("PL2").alias("privacy_level"), F.concat(F.lit("bo@x.org"), "id").alias("original_text"))
    rows = selection.generator("rule")(i, F.lit(False)).withColumns({"user_id": F.lit("u"), "message_id": F.lit(1), "item_index": F.lit(0)})
    plan = lambda d: d._jdf.queryExecution().analyzed().toString().count("[A-Za-z0-9][A-Za-z0-9_@.+-]{2,}")
    assert plan(rows) == 1 and plan(selection.selector_examples(rows)) == 2


def test_counting_representations_compiles_no_texts(spark, sf, monkeypatch):
    from quietlake.plans import dataset, memory_queries

    def never(*_):
        raise AssertionError("texts were compiled")

    monkeypatch.setattr(dataset, "scrubbed", never)
    assert memory_queries.representation_counts(spark, sf).count() == 3
