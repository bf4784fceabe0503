import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from framelark.llm import graph, simhash


def classes(fps, radius):
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= radius
    label = np.arange(len(fps))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("radius", [0, 1, 4, 9, 15])
def test_bit_sliced_distances_equal_counted_ones(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    noise = rng.integers(0, 2**63, (3, 120), dtype=np.uint64)
    fps = np.concatenate([base, base ^ (noise[0] & noise[1] & noise[2]), base ^ (noise[0] & noise[1]), base])
    n = len(fps)
    got = set()
    for a, b in simhash.near_lanes(fps, np.arange(1, n + 1), np.full(n, n), radius, slice_items=100):
        got |= set(zip(a.tolist(), b.tolist(), strict=True))
    d = np.bitwise_count(fps[:, None] ^ fps[None])
    assert got == {(i, j) for i, j in zip(*np.nonzero(d <= radius), strict=True) if i < j}


def test_fingerprint_is_the_majority_of_shingle_bits(spark):
    text = "The  Quick\tbrown fox jumps over THE lazy dog. ÉTÉ the quick brown fox"
    words = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))
    assert simhash.fingerprint(text, 4) == want
    assert [simhash.fingerprint(t, 4) for t in (None, "", " \n")] == [0, 0, 0]
    assert simhash.fingerprint("A b", 4) == xxhash.xxh64_intdigest(b"a b", 42)
    assert spark.range(1).select(F.xxhash64(F.lit("a b"))).first()[0] & (2**64 - 1) == simhash.fingerprint("a b", 4)


@pytest.mark.parametrize("cell", [4096, 5])
def test_links_connect_as_brute_force_does(spark, cell):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(6)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    named = graph.components(simhash.links(df, 4, 6, cell=cell))
    got = {r.node: r.label for r in named.collect()}
    want = classes(fps, 4)
    signed = fps.view(np.int64)
    groups: dict = {}
    for x, w in zip(signed.tolist(), want, strict=True):
        groups.setdefault(w, set()).add(got.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({next(iter(g)) for g in groups.values()})


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.label for r in graph.components(edges).collect()}
    assert {got[i] for i in range(201)} == {0} and got[501] == 500 and len(got) == 203
    assert graph.components(edges.limit(0)).count() == 0


def test_query_equals_brute_force(spark, data):
    from framelark.llm import queries

    got = queries.op1_simhash_near_dedup(spark, data).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{data}/documents.parquet").toPandas().sort_values("doc_id")
    fps = np.array([simhash.fingerprint(t, 4) for t in docs.text], np.uint64)
    assert list(got.fingerprint) == [f"{int(x):016x}" for x in fps]
    assert list(got.component_id) == list(docs.doc_id.to_numpy()[classes(fps, 4)])


def test_null_ids_repeats_and_clashing_columns(spark):
    rows = [(3, "x y z", 1), (None, "x y z", 2), (3, "x y z", 3), (None, "only me here", 4), (9, None, 5), (8, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    got = [(r.id, r.component) for r in simhash.near_duplicates(docs).collect()]
    assert set(got) == {(3, 3), (None, 3), (None, None), (9, 8), (8, 8)}
    assert len(got) == 6
    stay = simhash.representatives(docs).collect()
    assert sorted(r.text or "" for r in stay) == ["", "only me here", "x y z"] and stay[0].fp is not None
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.representatives(docs.limit(0)).count() == 0
