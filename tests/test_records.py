"""Files, checks, policies, aliases, provenance, audits, scoring, whole datasets and the stream, on small tables."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from quietlake.functions import checks
from quietlake.operators import aliases, audit, dialogue, exposure, privacy, scoring, selection
from quietlake.plans import compiler, dataset
from quietlake.sources import dialogues, files
from quietlake.streaming import public_memory

KEY = b"k"


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


# --- files


def test_lines_are_numbered_over_stretches_and_files(spark, tmp_path):
    for name, n in (("b", 40), ("a", 300), ("c", 0)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" if i % 5 else "\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        got = [(r.line_no, r.value) for r in files.numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [f"a{i}" if i % 5 else "" for i in range(300)] + [f"b{i}" if i % 5 else "" for i in range(40)]
    assert got == [(i + 1, v) for i, v in enumerate(want)]


def test_scans_skip_or_raise(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n \t\n{"a"\n{"a": 2}\n')
    path = str(tmp_path / "x.jsonl")
    assert [(r.line_no, r.a, r.bad_line) for r in files.read_records(spark, path, "a long").orderBy("line_no").collect()] == [(1, 1, None), (4, None, '{"a"'), (5, 2, None)]
    assert [r.line_no for r in files.read_records(spark, path, "a long", first_lines=3).collect()] == [1]
    with pytest.raises(Exception, match="no record in line [234]"):
        files.read_records(spark, path, "a long", strict=True).orderBy("line_no").collect()


def test_walk_any_depth(spark):
    deep = "1"
    for _ in range(300):
        deep = f'{{"d": [{deep}, "s"]}}'
    rows = spark.createDataFrame([(1, '{"a": {"content": ["x", {"b": "y"}]}, "n": 3}'), (2, deep), (3, "no"), (4, None), (5, '"top"')], "k long, value string")
    got = files.walk_json(rows, "k").where("kind = 'string'").collect()
    assert {(r.path, r.name, r.text) for r in got if r.key == 1} == {("$.a.content[0]", "content", "x"), ("$.a.content[1].b", "b", "y")}
    assert sum(r.key == 2 for r in got) == 300 and [(r.path, r.text) for r in got if r.key == 5] == [("$", "top")]


def test_settings_and_versions(spark, tmp_path):
    text = json.dumps({"url": "$URL", "key": "${KEY}", "llm": {"key": "plain"}, "n": 1})
    got = files.settings(text, ["url", "key"], [("llm", "key"), ("emb", "key")], {"llm.key": "OWN", "n": "NOPE"}, {"URL": "u", "OWN": "o"})
    assert got == {"url": "u", "key": "", "llm": {"key": "o"}, "emb": {"key": ""}, "n": 1}
    table = files.VersionedTable(spark, f"file://{tmp_path}/t")
    assert table.read("a long").count() == 0
    table.save(spark.range(3).toDF("a"))
    table.save(table.read().where("a > 0"))
    assert table.versions() == [1, 2] and sorted(r.a for r in table.read().collect()) == [1, 2]


# --- checks


def test_small_parsers(spark):
    options = ["(a) water", "(b) tea ", "(c)"]
    for answer, want in {"B": "tea", "(b).": "tea", "c": "c", "tea": "tea", None: "", "d": "d"}.items():
        assert one(spark, checks.answer_text(F.lit(answer), F.array(*map(F.lit, options)))) == want
    assert one(spark, checks.shows_value(F.lit("aaa aa."), F.lit("aa"), F.lit("$.content"))) and not one(spark, checks.shows_value(F.lit("aaa"), F.lit("aa"), F.lit("$.content")))
    assert not one(spark, checks.shows_value(F.lit("abcd"), F.lit("abcd"), F.lit("$.other")))
    assert one(spark, checks.model_json(F.lit("no json"), "array<string>")) is None
    with pytest.raises(Exception, match="refusing"):
        one(spark, checks.endpoint(F.lit("http://example.com"), F.lit(False)))
    with pytest.raises(Exception, match="refusing"):
        one(spark, checks.endpoint(F.lit(""), F.lit(True)))


def test_unmasked_input_is_guarded(spark):
    bad = spark.createDataFrame([(1, '{"uuid": "Ann"}')], "line_no long, value string")
    good = spark.createDataFrame([(1, '{"uuid": "User-1", "dialogues": [], "questions": []}'), (2, " ")], "line_no long, value string")
    assert dialogues.guard_unmasked(good, False) == 0 and dialogues.guard_unmasked(bad, True) is None and dialogues.guard_unmasked(bad, False, True) is None
    with pytest.raises(ValueError, match="line 1: missing keys"):
        dialogues.guard_unmasked(bad, False)
    with pytest.raises(ValueError, match="no users"):
        dialogues.guard_unmasked(good.where("line_no = 2"), False)


# --- policy and selection


def test_policies_are_checked():
    with pytest.raises(ValueError, match="no rule for PL4"):
        selection.Policy.of({"policy": {"pl2": "drop", "pl3": "drop"}})
    with pytest.raises(ValueError, match="scope goes"):
        selection.Policy.of({"policy": {"pl2": "public_reversible", "pl3": "drop", "pl4": "drop"}})
    with pytest.raises(ValueError, match="unknown"):
        selection.Policy.of({"policy": {"pl2": "publish", "pl3": "drop", "pl4": "drop"}})
    with pytest.raises(ValueError, match="version"):
        selection.Policy(version=" ")
    with pytest.raises(ValueError):
        selection.generator("artifact")
    with pytest.raises(ValueError):
        selection.selector("other")
    assert selection.selector("none") is None


def test_unsafe_candidates_fall(spark):
    made = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(1).cast("long").alias("level"), F.lit(0.9).alias("utility"), F.lit(0.1).alias("leakage"), F.lit(r).alias("representation")) for t, r in (("ANN lee here", "a"), ("a person", "b"), ("A Person", "b"), ("a person", "c"), ("", "d"))])
    rows = spark.range(1).select(selection.safe(made, F.lit("Ann Lee")).alias("c"), selection.decide(made, F.lit("Ann Lee"), F.lit("PL2")).alias("d")).first()
    assert [(c.text, c.representation) for c in rows.c] == [("a person", "b"), ("a person", "c"), ("", "d")]
    assert rows.d.action == "select" and rows.d.text == "a person"


def test_candidates_without_text_are_not_chosen(spark):
    made = F.array(F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("level"), F.lit(0.9).alias("utility"), F.lit(0.0).alias("leakage"), F.lit("drop").alias("representation")))
    d = spark.range(1).select(selection.decide(made, F.lit("Ann Lee"), F.lit("PL2")).alias("d")).first().d
    assert (d.action, d.text, d.feasible) == ("drop", None, 0)


# --- aliases and provenance


def items(spark, *rows):
    return spark.createDataFrame([(u, t, k, lv, i) for i, (u, t, k, lv) in enumerate(rows)], "user_id string, original_text string, privacy_type string, privacy_level string, seen long")


def test_store_upgrades_and_never_downgrades(spark):
    first = aliases.store_local(None, items(spark, ("u", "x", "Email", "PL3"), ("u", "y", "Email", "PL2"), ("v", "x", "Email", "PL2")), KEY)
    after = aliases.store_local(first, items(spark, ("u", "z", "Email", "PL2"), ("u", "x", "Email", "PL2"), ("u", "y", "Email", "PL4")), KEY)
    rows = {(r.namespace, r.original_text): (r.privacy_level, r.seq) for r in after.collect()}
    assert rows == {("u:local-only", "x"): ("PL3", 1), ("u:local-only", "y"): ("PL4", 2), ("u:local-only", "z"): ("PL2", 3), ("v:local-only", "x"): ("PL2", 1)}
    masks = {r.original_text: r.mask for r in first.where("namespace = 'u:local-only'").collect()}
    assert all(masks.get(r.original_text, r.mask) == r.mask for r in after.where("namespace = 'u:local-only'").collect())


def test_scopes_fail_closed_and_restore_their_own(spark):
    rows = items(spark, ("u", "secret", "Email", "PL2")).withColumns({"turn_id": F.lit("t1"), "session_id": F.lit(None).cast("string"), "task_id": F.lit("k1")})
    with pytest.raises(Exception, match="no id for alias scope session"):
        aliases.get_aliases(None, rows, F.lit("session"), KEY)[1].collect()
    store, named = aliases.get_aliases(None, rows, F.lit("turn"), KEY)
    mask = named.first().alias
    texts = spark.createDataFrame([(1, "u", "t1", None, None, f"a {mask} b"), (2, "u", "t2", None, None, mask), (3, "v", "t1", None, None, mask), (4, "u", "t1", None, None, None)], "text_id long, user_id string, turn_id string, session_id string, task_id string, text string")
    assert {r.text_id: r.text for r in aliases.restore(texts, store).collect()} == {1: "a secret b", 2: mask, 3: mask, 4: None}


def test_queries_need_consent_and_a_task(spark):
    store = aliases.store_local(None, items(spark, *[("u", f"v{i}", "Email", "PL2") for i in range(8)], ("u", "pin", "Email", "PL4")), KEY)
    q = spark.createDataFrame([(1, "u", "k", "q?", ["Email", "Other"], ["Email", "Other"], ["Email", "Other"])], "query_id long, user_id string, task_id string, query string, required array<string>, exact array<string>, consented array<string>")
    row = aliases.prepare_queries(q, store, KEY)[1].first()
    assert len(row.aliases) == 5 and row.missing == ["Other"] and row.cloud_query.startswith("q?\n\nEdge") and "v0" not in row.cloud_query
    with pytest.raises(Exception, match="not consented: Email"):
        aliases.prepare_queries(q.withColumn("consented", F.array(F.lit("Other"))), store, KEY)[1].collect()
    with pytest.raises(Exception, match="task is required"):
        aliases.prepare_queries(q.withColumn("task_id", F.lit("")), store, KEY)[1].collect()


def test_provenance_is_append_only_and_revocable(spark):
    made = spark.createDataFrame([("u", "m1", 0, "drop", "r", "PL4", "T", "dropped", None, None, None), ("u", "m2", 0, "public_abstract", "r", "PL2", "T", "x", "some", None, None)], "user_id string, message_id string, item_index long, action string, rule_id string, privacy_level string, privacy_type string, representation string, public_value string, alias_scope string, scope_id string")
    records = aliases.provenance_records(made, "v1", F.lit("2024"))
    assert records.schema.simpleString().replace("struct<", "").startswith("record_id:string") and len(records.columns) == 18
    table = aliases.add_records(records.where("false"), records)
    with pytest.raises(Exception, match="record exists"):
        aliases.add_records(table, records).collect()
    ids = [r.record_id for r in table.orderBy("source_message_id").collect()]
    table = aliases.attach_cloud_ids(table, spark.createDataFrame([(ids[0], "c2"), (ids[0], "c1"), (ids[0], "c1")], "record_id string, cloud_id string"))
    with pytest.raises(Exception, match="unknown record"):
        aliases.attach_cloud_ids(table, spark.createDataFrame([("nope", "c")], "record_id string, cloud_id string")).collect()
    gone = spark.createDataFrame([("u", "m1"), ("u", "m1"), ("w", "m2")], "user_id string, source_message_id string")
    after, cloud = aliases.revoke_by_source(table, gone, "asked", F.lit("2025"))
    assert [(r.user_id, r.cloud_ids) for r in cloud.collect()] == [("u", ["c1", "c2"])]
    assert [r.source_message_id for r in aliases.active_records(after, F.lit("u")).collect()] == ["m2"]
    assert aliases.revoke_by_source(after, gone, "again", F.lit("2026"))[1].count() == 0


# --- audits and scoring


def test_owners_by_first_line(spark):
    rows = spark.createDataFrame([("a", 3, "y"), ("a", 1, "x"), ("a", 2, ""), ("a", 9, "z"), ("b", 5, "z"), ("b", 6, None)], "artifact string, line_no long, identity string")
    sources = spark.createDataFrame([(1, "u1"), (2, "u2")], "nth long, user_id string")
    got = {(r.artifact, r.identity): r.owner for r in exposure.owners(rows, sources, F.lit("*")).collect()}
    assert got == {("a", "x"): "u1", ("a", "y"): "u2", ("a", "z"): "*", ("b", "z"): "u1"}


def test_attack_applies_only_with_both_classes(spark):
    rows = [(i, int(i % 2), "red apple" if i % 2 else "blue sky") for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, label int, text string")
    got = exposure.attack_report(frame).first()
    assert got.applicable and got.accuracy == got.auc == 1.0 and got.baseline_accuracy == 0.5
    lone = exposure.attack_report(frame.where("label = 0 OR doc_id = 1")).first()
    assert not lone.applicable and lone.accuracy is None and lone.auc is None


def test_assignment_is_the_best_of_all():
    rng = random.Random(2)
    for _ in range(300):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        w = [[rng.choice([0.0, 0.0, rng.random()]) for _ in range(m)] for _ in range(n)]
        pairs = scoring.assign(w)
        assert len(pairs) == min(n, m) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        wide = w if n <= m else [list(c) for c in zip(*w, strict=True)]
        best = max(sum(wide[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        assert abs(sum(w[i][j] for i, j in pairs) - best) < 1e-9


def test_scores_by_level_and_vectors(spark):
    item = "array<struct<original_text:string,privacy_type:string,privacy_level:string>>"
    rows = [
        (1, "Ann lives at Long Street 12", [("Ann", "Name", "PL2"), ("Street 12", "Document Info", "PL3")], [("Ann", "Real Name", "PL2"), ("Long Street 12", "Document Info", "PL3")]),
        (2, "x", None, [("x", "Name", "PL2")]), (3, "y", [], None),
    ]
    frame = spark.createDataFrame(rows, f"message_id long, content string, predicted {item}, reference {item}")
    got = {(r.message_id, r.level): r for r in scoring.evaluate(frame, "mean", {"Name": [1.0, 0.0], "Real Name": [3.0, 4.0]}).collect()}
    assert got[1, "PL2"].f1 == pytest.approx((1 + 1 + 0.6) / 3) and got[1, "PL3"].text_score == pytest.approx(0.8)
    assert got[1, "PL4"].f1 == got[3, "all"].f1 == 1.0 and got[2, "all"].f1 == 0.0
    macro = {r.level: r for r in scoring.macro_average(scoring.evaluate(frame)).collect()}
    assert macro["all"].messages == 3 and scoring.macro_average(scoring.evaluate(frame.where("false"))).where("f1 <> 0").count() == 0
    with pytest.raises(ValueError):
        scoring.evaluate(frame, "sum")


def test_sums_before_and_frontier(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 9)) for i in rng.sample(range(1000), 400)]
    got = {r.k: r.before for r in audit.with_sum_before(spark.createDataFrame(rows, "k long, v long"), "k", "v", "before").collect()}
    assert got == {k: sum(v for j, v in rows if j < k) for k, _ in rows}
    for _ in range(100):
        points = [(rng.randint(0, 4), rng.randint(0, 4), rng.randint(0, 4)) for _ in range(rng.randint(0, 25))]
        best = {p for p in points if not any(q[0] >= p[0] and q[1] >= p[1] and q[2] <= p[2] and q != p for q in points)}
        assert set(dialogue.undominated(points)) == best


# --- whole datasets


def world(spark):
    users = spark.createDataFrame([("u1", "Ann Lee", "en"), ("u2", None, None)], "user_id string, user_name string, language string")
    m = spark.createDataFrame(
        [("u1", "u1:0", 0, "user", "I am Ann Lee and I prefer tea. My card is 4111111111111111.", True), ("u1", "u1:1", 1, "assistant", "Hello Ann Lee, here are ideas. You like tea.", True), ("u1", "u1:2", 2, "user", "Not annotated: Ann Lee.", False), ("u2", "u2:0", 0, "user", "I live near Ann Lee now. Mail me at bo@mail1.example.com please.", True)],
        "user_id string, message_id string, message_index long, role string, content string, annotated boolean",
    )
    items = privacy.detect(m).unionByName(spark.createDataFrame([("u1:0", "u1", 50, "gone", "T", "PL2"), ("u1:0", "u1", 51, "tea", "T", "PL1")], "message_id string, user_id string, pos long, original_text string, privacy_type string, privacy_level string"))
    q = spark.createDataFrame([("u1", 0, "Which card has Ann Lee?", "(a)", None, ["(a) 4111111111111111", "(b) none of them"], "single", 7)], "user_id string, question_index long, question string, answer string, evidence string, all_options array<string>, question_type string, weight long")
    return users, m, items, q


def test_dataset_end_to_end(spark, tmp_path):
    users, m, items, q = world(spark)
    plan = compiler.Plan(required=("Email",), consented=("Email",))
    c = dataset.compile_dataset(users, m, items, q, plan, KEY, F.lit("2024"))
    public = {r.message_id: r.public_text for r in c.records.collect()}
    assert set(public) == {"u1:0", "u1:1", "u2:0"} and not any("4111" in t or "bo@" in t for t in public.values())
    assert "Ann Lee" not in public["u1:0"] + public["u1:1"] and "Ann Lee" in public["u2:0"]
    assert {(r.message_id, r.invalid) for r in c.invalid.collect()} == {("u1:0", 2)}
    kinds = {(r.message_id, r.privacy_type): (r.action, r.representation) for r in c.items.collect()}
    assert kinds["u1:0", "Financial Account"] == ("local_only", "encrypted_local_only") and kinds["u2:0", "Email"] == ("public_reversible", "scoped_reversible_alias") and kinds["u1:1", "Real Name"][1] == "category_abstract"
    assert c.provenance.count() == c.items.count() and "bo@mail1.example.com" in {r.original_text for r in c.local.collect()}
    dataset.write_dataset(c, f"file://{tmp_path}/out")
    lines = files.numbered_lines(spark, f"file://{tmp_path}/out/users")
    assert dialogues.guard_unmasked(lines, False) == 0
    ann = next(json.loads(r.value) for r in lines.collect() if '"language":"en"' in r.value)
    assert ann["questions"][0]["weight"] == 7 and ann["questions"][0]["answer"] == "(a)" and "4111" not in json.dumps(ann) and "Lee" not in json.dumps(ann) and len(ann["dialogues"]) == 2
    report = dataset.dataset_report(c, q).first()
    assert (report.records, report.invalid_annotations, report.exact_recovered, report.questions, report.recoverable_facts, report.n_local_only) == (3, 2, 0, 1, 1, 1)


def test_dataset_of_nothing(spark):
    users, m, items, q = (d.where("false") for d in world(spark))
    c = dataset.compile_dataset(users, m, items, q, created_at=F.lit("2024"))
    assert c.records.count() == c.users.count() == c.provenance.count() == 0
    assert dataset.dataset_report(c, q).first().records == 0


def test_stream_compiles_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    at = lambda name: f"file://{tmp_path}/{name}"
    for k, text in enumerate(["I like tea and mail bo@mail1.example.com now.", "My card 4111111111111111 is new. I like tea a lot."]):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"message_id": f"m{k}", "user_id": "u", "role": "user", "content": text}) + "\n")
        public_memory.compile_stream(public_memory.stream_messages(spark, at("in")), at("out"), at("store"), at("check"), KEY).awaitTermination()
    out = {r.message_id: r.public_text for r in spark.read.parquet(at("out")).collect()}
    assert set(out) == {"m0", "m1"} and "bo@" not in out["m0"] and "4111" not in out["m1"]
    store = files.VersionedTable(spark, at("store")).read()
    assert {r.original_text for r in store.collect()} == {"bo@mail1.example.com", "4111111111111111"}
