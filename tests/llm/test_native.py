"""Shards, preferences, decontamination, and the pipeline as a whole."""

import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from framelark.llm import decontam, hilbert, preference, queries


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3)])
def test_curve_visits_every_cell_by_single_steps(spark, dims, bits):
    c = hilbert.curve(spark, dims, bits).orderBy("h").toPandas()
    x = c[[f"x{i}" for i in range(dims)]].to_numpy()
    assert len(np.unique(x, axis=0)) == 2 ** (dims * bits) and (np.abs(np.diff(x, axis=0)).sum(axis=1) == 1).all()


def check_shards(got, rows, n=8):
    sizes = got.groupby("shard").size()
    assert len(got) == len(rows) and (len(rows) < n or len(sizes) == n) and (not len(rows) or sizes.max() - sizes.min() <= 1)
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard").slot)
    order = got.sort_values(["shard", "slot"]).h if len(got) else got.h
    assert order.is_monotonic_increasing


def test_shards_of_given_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got, texts = hilbert.shard(docs).toPandas(), {r.doc_id: r.text.encode() for r in docs.collect()}
    check_shards(got, texts)
    for r in got.itertuples():
        assert r.text_crc32 == zlib.crc32(texts[r.id]) and r.size == len(texts[r.id]) + 1


def test_shards_equal_a_plain_order(spark, data):
    """Levels by ranks, the curve by its steps, and the ranks along it, all counted anew in Python."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.lang, r.source, len(r.text.encode()) + 1, r.doc_id) for r in docs.collect()]
    n, cells = len(rows), {tuple(c[1:]): c[0] for c in hilbert.curve(spark, 3, 5).collect()}

    def levels(values):
        ordered = sorted(values)
        return {v: ordered.index(v) * 32 // n for v in set(values)}

    lang, source = levels([r[0] for r in rows]), levels([r[1] for r in rows])
    got = {r.id: r for r in hilbert.shard(docs).select("id", "h", "shard", "slot").collect()}
    by_index, sizes = {h: c for c, h in cells.items()}, {}
    for a, b, size, i in rows:
        x, y, z = by_index[got[i].h]
        assert (x, y) == (lang[a], source[b])
        sizes.setdefault(z, []).append(size)
    spans = [(min(s), max(s)) for _, s in sorted(sizes.items())]
    assert all(a[1] < b[0] for a, b in zip(spans[:-1], spans[1:], strict=True)) and len(spans) > 20
    place = sorted(got.values(), key=lambda r: (r.shard, r.slot))
    assert [r.h for r in place] == sorted(r.h for r in place)
    assert [r.shard for r in place] == [k * 8 // n for k in range(n)]


def test_cuts_are_exact(spark):
    from pyspark.sql import functions as F

    values = [None] * 5 + ["b"] * 20 + ["a"] * 3 + list("cdefgh")
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(5)
    v = F.coalesce("v", F.lit(""))
    ordered = sorted(x or "" for x in values)
    want = {}
    for x in sorted(set(ordered)):
        want.setdefault(ordered.index(x) * 8 // len(ordered), x)
    assert hilbert.cuts(df, v, 8) == [c for c in sorted(want.items()) if c[0]]
    assert hilbert.cuts(df.limit(0), v, 8) == []


def test_written_shards_hold_the_rows_and_can_be_skipped(spark, tmp_path):
    rows = [(i, "word " * (i * 7 % 50 + 1), "abcd"[i % 4], f"s{i // 4 % 8}", i * 7 % 50, i) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int, shard int")
    dealt = hilbert.shard(docs, shards=64)
    hilbert.write_shards(dealt, str(tmp_path / "out"), files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in back.select(*docs.columns).collect()) == sorted(rows) and back.select("_shard").distinct().count() == 64
    known = spark.read.parquet(str(tmp_path / "out" / "_ranges")).collect()
    assert sum(r.n_rows for r in known) == 2000 and sum(r.bytes for r in known) == sum(len(r[1]) + 1 for r in rows)
    share = lambda name, value: sum(r[f"min_{name}"] <= value <= r[f"max_{name}"] for r in known) / 64
    assert share("lang", "b") <= 0.5 and share("source", "s3") <= 0.5 and share("n_chars", 20) <= 0.5


@pytest.mark.parametrize("n", [0, 1, 3, 8, 11])
def test_shards_of_few_odd_rows(spark, n):
    rows = [(None if i % 3 == 0 else 1, None if i % 2 else "xé", None, "s" if i % 4 else None, i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, h int")
    got = hilbert.shard(docs).toPandas()
    check_shards(got, rows)
    assert set(got["size"]) <= {1, 4}


TURNS = "conv_id bigint, turn bigint, role string, text string"


def preferences(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, TURNS)
    pair = F.expr("cast(floor(conv_id / 2) as bigint)")
    return df, preference.preferences(df, pair, F.expr("pmod(conv_id, 2) = 0"))


def test_longest_common_prefix_is_the_prompt(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (0, 2, "user", "x"), (0, 3, "assistant", "good"),
            (1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "user", "x"), (1, 3, "assistant", "bad"), (1, 4, "user", "y")]
    got = sorted((r.part, r.turn, r.content, r.train) for r in preferences(spark, rows)[1].collect())
    assert got == [
        ("chosen", 3, "<|assistant|>\ngood\n", 1), ("prompt", 0, "<|user|>\nhi\n", 0), ("prompt", 1, "<|assistant|>\na\n", 0),
        ("prompt", 2, "<|user|>\nx\n", 0), ("rejected", 3, "<|assistant|>\nbad\n", 1), ("rejected", 4, "<|user|>\ny\n", 0),
    ]


def test_preferences_equal_sql_on_odd_rows(spark):
    rows = [(0, None, None, None), (0, 1, "user", None), (1, None, None, None), (1, 1, "user", ""), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, 0, "user", "a"),
            (5, 1, "assistant", "lone"), (None, 0, "user", "z"), (6, 0, "user", "q"), (7, 0, "user", "q"), (-2, 1, "assistant", "m"), (-1, 1, "assistant", "n")]
    df, got = preferences(spark, rows)
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.sql(preference.SQL)
    key = lambda t: tuple(str(v) for v in t)
    assert sorted((tuple(r) for r in got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)
    assert preferences(spark, [])[1].count() == 0


def test_records_of_pairs(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (0, 3, "assistant", "good"), (1, 0, "user", "hi"), (1, 1, "assistant", "b"),
            (1, 1, "assistant", "b"), (1, None, "user", "odd")]
    (r,) = preference.paired(preferences(spark, rows)[1]).collect()
    assert r.prompt == "" and [(e.content, e.train) for e in r.chosen] == [("<|user|>\nhi\n", 0), ("<|assistant|>\na\n", 1), ("<|assistant|>\ngood\n", 1)]
    assert [(e.content, e.train, e.times) for e in r.rejected] == [("<|user|>\nodd\n", 0, 1), ("<|user|>\nhi\n", 0, 1), ("<|assistant|>\nb\n", 1, 2)]
    same = [(c, t, "user", f"t{t}") for c in (4, 5) for t in range(7)]
    (r,) = preference.paired(preferences(spark, same)[1]).collect()
    assert r.prompt == "".join(f"<|user|>\nt{t}\n" for t in range(7)) and r.chosen == r.rejected == []
    hot = [(8, t % 30, "assistant", f"x{t}") for t in range(400)]
    got = preference.paired(preferences(spark, hot)[1], turns=10).collect()
    assert {r.block for r in got} == {0, 1, 2} and sum(len(r.chosen) for r in got) == 400 and max(len(r.chosen) for r in got) < 40
    assert preference.paired(preferences(spark, [])[1]).count() == 0


def test_hot_pairs_and_large_ids(spark, monkeypatch):
    monkeypatch.setattr(preference, "HEAVY_LEAST", 5)
    big = 2**62 + 2
    rows = [(c, t, "user", "z" * 50_000 if t == 3 else f"t{t}") for c in (big, big + 1) for t in range(20)] + [(big, 20, "assistant", "c"), (big + 1, 20, "assistant", "r"), (2, 0, "user", "q")]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], TURNS + ", part string, pair_id int")
    from pyspark.sql import functions as F

    got = preference.preferences(df, F.shiftright("conv_id", 1), F.expr("pmod(conv_id, 2) = 0")).collect()
    assert {r.pair_id for r in got} == {big >> 1, 1} and sum(r.part == "prompt" for r in got) == 20
    assert sorted(r.content for r in got if r.train) == ["<|assistant|>\nc\n", "<|assistant|>\nr\n"]


def test_preference_query_equals_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    want = con.sql(queries.SQL["op9_preference_format"])
    got = queries.op9_preference_format(spark, data).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def contained(docs, items, words=5, threshold=0.8):
    lists = [(i, w) for i, t in items if (w := decontam.words_of(t))]
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    own = [(d, {n: runs(decontam.words_of(t), n) for n in range(1, words + 1)}) for d, t in docs]
    out = set()
    for i, w in lists:
        s = runs(w, min(len(w), words))
        out |= {(d, i) for d, held in own if len(s & held[min(len(w), words)]) >= threshold * len(s) - 1e-9}
    return out


def test_decontamination_equals_brute_force(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    got = queries.op7_benchmark_decontamination(spark, data).collect()
    want = contained([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_damaged_items_are_found_down_to_the_threshold(spark, monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    items, docs = [], []
    for i in range(60):
        w = [word() for _ in range(int(rng.integers(5, 60)))]
        items.append((i, " ".join(w)))
        for cut in range(4):
            v = list(w)
            for at in rng.integers(0, len(v), cut):
                v[at] = word()
            docs.append((len(docs), " ".join([word() for _ in range(80)] + v + [word() for _ in range(80)]).upper()))
    items += [(90, "tiny item"), (91, ""), (92, None), (93, "gamma short item"), (None, "Lonely"), (93, items[3][1])]
    docs += [(900, "Tiny, item!"), (901, None), (902, ""), (None, items[0][1]), (903, "x y gamma, short ITEM z " * 5), (905, "tiny")]
    docs += [(904, "a lonely word " + "filler " * 30_000 + items[1][1])] * 2
    d = spark.createDataFrame([(*r, "c", 1) for r in docs], "doc_id bigint, text string, item_id string, doc int")
    b = spark.createDataFrame([(*r, 1, 2) for r in items], "item_id bigint, text string, doc_id int, matched int")
    want = contained(docs, items)
    assert (903, 93) in want and (904, None) in want and 220 > len(want) > 60
    bad = {i for i, _ in want}
    for most in (decontam.ITEMS, 7):  # sent to the executors, and joined
        monkeypatch.setattr(decontam, "ITEMS", most)
        got = [(r.id, r.item_id) for r in decontam.contained(d, b).collect()]
        assert set(got) == want and got.count((904, 1)) == 2
        assert sorted(map(str, {r.doc_id for r in decontam.clean(d, b).collect()})) == sorted(map(str, {i for i, _ in docs} - bad))
        assert decontam.clean(d, b).columns == d.columns
    assert decontam.contained(d.limit(0), b).count() == 0
    monkeypatch.undo()
    assert decontam.contained(d, b.limit(0)).count() == 0 and decontam.clean(d, b.limit(0)).count() == d.count()


def plain_cut(rows, width=100):
    """(kept text or None, whether it was cut) of each (id, text), by all windows in order."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - width + 1):
            w = raw[at : at + width]
            if w in seen:
                gone[at : at + width] = b"\1" * width
            seen.add(w)
        out[i] = bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore") if any(gone) else t
    return out


def test_pipeline_stages_equal_plain_forms(spark, data):
    from framelark.llm import toxicity
    from framelark.llm._spark import staged
    from tests.llm.test_jaccard import groups

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = staged(stage(spark, docs, data))
        seen[name] = (before, docs)
        assert name == "best_fit_packing" or docs.columns == columns
    rows = lambda df: {r.doc_id: r for r in df.collect()}

    before, after = (rows(x) for x in seen["toxicity"])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    known = [i for i in before if i in labels and zlib.crc32(str(i).encode()) % 3 != 1]
    train = spark.createDataFrame([(before[i].text, int(labels[i] == 1)) for i in known], "text string, toxic int")
    scores = toxicity.learn(train).scores([r.text for r in before.values()])
    assert set(after) == {i for i, s in zip(before, scores, strict=True) if s < 0.7}
    assert all(after[i] == before[i] for i in after)

    before, after = (rows(x) for x in seen["simhash_near_dedup"])
    order = sorted(before)
    assert set(after) == {order[k] for k in groups([before[i].text for i in order])}

    before, after = (rows(x) for x in seen["suffix_array_dedup"])
    want = {i: t for i, t in plain_cut([(i, r.text) for i, r in before.items()]).items() if t != "" or before[i].text == ""}
    assert {i: r.text for i, r in after.items()} == want
    assert all(r.n_chars == len(r.text) and r.lang == before[i].lang for i, r in after.items())

    before, after = (rows(x) for x in seen["benchmark_decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert set(after) == set(before) - {i for i, _ in contained([(i, r.text) for i, r in before.items()], items)}

    before, after = seen["best_fit_packing"]
    ends = {r.doc_id: 0 for r in before.collect()}
    for r in after.collect():
        assert len(r.ids) == r.length <= 2048
        ends[r.doc_id] += r.ids.count(0)
    assert set(ends.values()) == {1}


def test_pipeline_on_odd_documents(spark, data, tmp_path):
    rows = [(None, None, None), (1, "", "s"), (1, "", "s"), (2, "same text of seven words, no more", "s"), (3, "same text of seven words, no more", "t"), (4, "long " * 40_000, None)]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id bigint, text string, source string, row string, key int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {None, 1, 2, 4} and {2, 4} <= {r.doc_id for r in out}
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
