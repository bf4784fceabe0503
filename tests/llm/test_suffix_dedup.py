import hashlib
import random
import time

import numpy as np
import pytest

from framelark.llm import suffix_dedup


def brute(rows, width):
    docs = {i: (t or "").encode() for i, t in rows}
    seen, out = set(), {}
    for i in sorted(docs):
        b = docs[i]
        gone = bytearray(len(b))
        for a in range(len(b) - width + 1):
            w = b[a : a + width]
            if w in seen:
                gone[a : a + width] = b"\1" * width
            seen.add(w)
        runs = sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1]))
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(rest).hexdigest())
    return out


def got(spark, rows, width):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r[0]: tuple(r)[1:] for r in suffix_dedup.summary(df, width).collect()}


def corpus(seed, n):
    r = random.Random(seed)
    pool = ["".join(r.choice("abé ") for _ in range(r.randint(20, 150))) for _ in range(6)]
    rows = {}
    for i in range(n):
        t = "".join(
            r.choice(pool)[r.randint(0, 20) :] if r.random() < 0.6 else "".join(r.choice("abcdefgh") for _ in range(r.randint(0, 60)))
            for _ in range(r.randint(0, 5))
        )
        t = r.choice([t, t, t, t, "a" * r.randint(0, 400), "ab" * r.randint(0, 200)])
        rows[i * 3 - 20] = t if r.random() > 0.05 else None
    for i in list(rows)[::5]:
        rows[i + 1] = rows[i]
    return list(rows.items())


@pytest.mark.parametrize("seed", range(4))
def test_suffix_arrays(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        a = rng.integers(0, int(rng.choice([1, 2, 3, 256])), int(rng.integers(0, 60))).astype(np.uint8)
        a = np.concatenate([a, a]) if rng.random() < 0.4 else a
        sa = suffix_dedup.suffix_array(a, 2000)
        assert sorted(sa.tolist()) == list(range(len(a)))
        padded = [(a.tobytes()[i:] + bytes(200))[:200] for i in sa]
        assert padded == sorted(padded)
        k = suffix_dedup.words_at(a, 2000)
        for x, y, n in zip(padded[:-1], padded[1:], suffix_dedup.common_prefixes(k, sa[:-1], sa[1:], 40), strict=True):
            assert x[:n] == y[:n] and (n == 40 or x[n] != y[n])


def test_equal_windows_share_an_anchor():
    rng = np.random.default_rng(0)
    window = rng.integers(97, 123, 100).astype(np.uint8)
    found = []
    for _ in range(2):
        a, b = rng.integers(97, 123, 57).astype(np.uint8), rng.integers(97, 123, 90).astype(np.uint8)
        pos, h = suffix_dedup.anchors(np.concatenate([a, window, b]), np.array([247]), 100)
        found.append({(int(p) - 57, int(v)) for p, v in zip(pos, h, strict=True) if 57 <= p <= 57 + 68})
    assert found[0] & found[1]


@pytest.mark.parametrize(("seed", "width"), [(1, 40), (2, 100)])
def test_summary_equals_brute_force(spark, seed, width):
    rows = corpus(seed, 60)
    assert got(spark, rows, width) == brute(rows, width)


@pytest.mark.parametrize(("seed", "width"), [(3, 40), (4, 100)])
def test_frequent_anchors_dealt_over_cells(spark, monkeypatch, seed, width):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    rows = corpus(seed, 60)
    assert got(spark, rows, width) == brute(rows, width)


def test_given_documents(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert got(spark, rows, 100) == brute(rows, 100)


def test_edges(spark):
    assert got(spark, [(1, None), (2, ""), (3, "x" * 99)], 100) == brute([(1, None), (2, ""), (3, "x" * 99)], 100)
    df = spark.createDataFrame([(1, "x" * 300, "k"), (2, None, "k"), (3, "y" * 50, "k"), (4, "x" * 150, "j"), (5, "z" * 20 + "x" * 120, "q")], "doc_id bigint, text string, tie string")
    left = {r.doc_id: (r.text, r.tie) for r in suffix_dedup.cleaned(df).collect()}
    assert left[2] == (None, "k") and left[3] == ("y" * 50, "k") and 4 not in left and left[5] == ("z" * 20, "q")
    assert suffix_dedup.summary(df.limit(0)).count() == 0
    # rows that repeat id and text are one document; other texts of one id are apart; null ids come last
    odd = spark.createDataFrame([(1, "a" * 120), (1, "a" * 120), (1, "b" * 120), (None, "b" * 120)], "doc_id bigint, text string")
    out = sorted((str(r.id), r.n_removed) for r in suffix_dedup.summary(odd).collect())
    assert out == [("1", 119), ("1", 119), ("1", 119), ("None", 120)]


def test_largest_id_and_none(spark):
    last = 2**63 - 1
    odd = spark.createDataFrame([(last, "a" * 120), (None, "a" * 120), (None, "c" * 20), (5, None)], "doc_id bigint, text string")
    assert {(r.id, r.n_bytes, r.n_removed) for r in suffix_dedup.summary(odd).collect()} == {(last, 120, 119), (None, 120, 120), (None, 20, 0), (5, 0, 0)}
    only = suffix_dedup.summary(odd.where("doc_id is not null")).collect()
    assert {(r.id, r.n_removed) for r in only} == {(last, 119), (5, 0)}
    with pytest.raises(TypeError):
        suffix_dedup.summary(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_shuffle_files_of_a_step_go_with_it(spark, monkeypatch):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = lambda: {f for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before, set_to, staged, left = held(), spark.conf.get(name), suffix_dedup.staged, []

    def noted(df):
        out = staged(df)
        until = time.time() + 10
        while held() - before and time.time() < until:
            time.sleep(0.1)
        left.append(len(held() - before))
        return out

    monkeypatch.setattr(suffix_dedup, "staged", noted)
    rows = corpus(5, 60)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    suffix_dedup.cleaned(df, 40)
    assert left == [0] * 5 and spark.conf.get(name) == set_to
    assert got(spark, rows, 40) == brute(rows, 40)
    assert left == [0] * 11 and spark.conf.get(name) == set_to


@pytest.mark.parametrize("few", [100_000, 0])
def test_frequent_anchors_by_broadcast_and_by_salts(spark, monkeypatch, few):
    staged, plans = suffix_dedup.staged, []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df)

    monkeypatch.setattr(suffix_dedup, "staged", noted)
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setattr(suffix_dedup, "FEW", few, raising=False)
    rows = corpus(6, 60)
    assert got(spark, rows, 40) == brute(rows, 40)
    blocks = next(p for p in plans if "found" in p and "bytes" in p)
    # lists, texts and stretches; anchors are dealt by salts only if too many of them are frequent
    dealt = blocks.count("Exchange hashpartitioning(hash") + blocks.count("Exchange hashpartitioning(id")
    assert dealt == (3 if few else 5)
    # rows that repeat an id need the second key
    rows = [(1, "a" * 90), (1, "b" * 90), (2, "a" * 50 + "b" * 60)]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.id, r.n_bytes, r.n_removed) for r in suffix_dedup.summary(odd, 40).collect()) == [(1, 90, 89), (1, 90, 89), (2, 110, 110)]
