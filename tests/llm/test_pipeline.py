"""The corpus pipeline as a whole against plain Python, stage by stage, over documents with odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quietlake.llm import decontam, quality, queries, tokens  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]")


def keeps(rows):
    """By the SQL of the quality rules."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(rows)), "text": [r[1] for r in rows]}).astype({"text": "object"}))
    sql = f"SELECT doc_id FROM ({queries.ORACLE_SQL['op3_quality_rules']}) WHERE (fail_bits & {quality.policy_mask('v2')}) = 0"
    kept = {r[0] for r in con.execute(sql).fetchall()}
    return [r for i, r in enumerate(rows) if i in kept]


def one_of_each(rows):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    groups = {}
    for r, row in zip(root, rows, strict=True):
        groups.setdefault(r, []).append(row)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def without_repeats(rows, length):
    data = [(r[1] or "").encode() for r in rows]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for r, b in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        if WORD.search(left) or not any(gone):
            out.append((r[0], left, *r[2:4], len(left), *r[5:]))
    return out


def clean(rows, items):
    words = [decontam.words_of(r[1]) for r in rows]
    df = Counter(w for ws in words for i in range(0, max(1, len(ws)), decontam.STRIDE) for w in set(ws[i : i + decontam.STRIDE]))
    out = []
    for r, ws in zip(rows, words, strict=True):
        bad = False
        for item in items:
            n, rare = len(item), sorted({w for w in item if df[w]}, key=lambda w: df[w])[: decontam.RAREST]
            for a in range(0, max(1, len(ws) - decontam.STRIDE), decontam.STRIDE):
                passage = ws[max(0, a - n) : a + decontam.WINDOW + n]
                if len(set(item) & set(passage)) >= 0.4 * len(set(item)):
                    lcs, hit = decontam.verify(item, rare, passage)
                    bad |= lcs >= decontam.LCS_SHARE and hit >= decontam.STAND_IN_SHARE
        if not bad:
            out.append(r)
    return out


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items, rng = bench.collect(), random.Random(6)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1) for r in docs]
    long = [r for r in rows if len(r[1].split()) > 120][:30]
    passage = " ".join(rng.choice(long[0][1].split()) for _ in range(60))
    for k, (_, t, lang, source, _, _) in enumerate(long):
        w = t.split()
        if k % 3 == 0:
            w[rng.randrange(len(w))] = "changed"
        elif k % 3 == 1:
            w = [*rng.sample(w, len(w)), *passage.split(), *rng.sample(w, 50)]
        else:
            w = [*rng.sample(w, len(w)), *items[k].text.split(), *rng.sample(w, 40)]
        made = " ".join(w)
        rows.append((10_000 + k, made, lang, source, len(made), 2))
    rows += [(20_000, None, None, None, None, 3), (20_001, "", "en", "s", 0, 3), rows[0], (None, " ".join(f"w{i} und" for i in range(200)), "de", "s", 1, 3), (20_002, " ".join(f"v{i}" for i in range(30_000)), "en", "s", 1, 3)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_removed long").repartition(3).write.parquet(f"file://{at}/documents.parquet")
    bench.write.parquet(f"file://{at}/benchmark.parquet")
    return f"file://{at}", rows, [decontam.words_of(i.text) for i in items]


def test_every_stage_and_the_run_equal_plain_python(spark, world):
    sf, rows, items = world
    plain = [keeps, one_of_each, lambda x: without_repeats(x, corpus_pipeline.REPEAT_BYTES), lambda x: clean(x, items)]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, want = docs.columns, rows
    for (name, stage), model in zip(corpus_pipeline.STAGES, plain, strict=False):
        found = stage(spark, docs, sf)
        assert found.columns == columns, name
        got = [tuple(r) for r in found.collect()]
        want = model(want)
        assert Counter(got) == Counter(want), name
        assert 0 < len(want) < len(rows)
        docs = spark.createDataFrame(got, docs.schema)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    pieces = Counter()
    for i, t, *_ in want:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        for k, start in enumerate([0, *range(first, len(ids), 2048)]):
            own = ids[start : first if k == 0 else start + 2048]
            pieces[i, k, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    done = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in done) == pieces
    at = Counter()
    for r in sorted(done, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 2048 and len(at) <= 1.02 * -(-sum(at.values()) // 2048) + 1


def test_stages_take_an_empty_table(spark, world):
    sf = world[0]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name
