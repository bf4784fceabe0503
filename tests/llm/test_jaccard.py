import numpy as np
import pytest

import corpus_pipeline
from framelark.llm import _spark, jaccard, simhash


def sets_of(texts):
    w = [(t or "").lower().split() for t in texts]
    return [{tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in w]


def groups(texts, similarity=0.8):
    """The first text of each text's group, by all pairs."""
    sets = sets_of(texts)
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and len(a & sets[j]) >= similarity * len(a | sets[j]) - 1e-9:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return label


def planted(seed=5):
    """Texts, and copies of them with words exchanged, of which some are repeated in capitals."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    texts = [None, " ", "", "one", "ONE", "one two"]
    for i in range(40):
        base = [word() for _ in range(int(rng.integers(6, 300)))]
        texts.append(" ".join(base))
        for part in (0.005, 0.015, 0.022, 0.03, 0.05):
            copy = list(base)
            for at in rng.choice(len(copy), max(1, int(part * len(copy))), replace=False):
                copy[at] = word()
            texts.append(" ".join(copy))
        texts.append("  ".join(base).upper() if i % 3 else " ".join(base[: int(len(base) * 0.81)]))
    shared = " ".join(word() for _ in range(30))  # one passage that many hold
    return texts + [f"{shared} " + " ".join(word() for _ in range(k % 12)) for k in range(60)]


@pytest.mark.parametrize(("small", "chunk"), [(16, 1024), (4, 3)])
def test_stage_equals_all_pairs(spark, monkeypatch, small, chunk):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    texts = planted()
    sets, want = sets_of(texts), groups(texts)
    shares = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    assert sum(0.8 <= s < 0.95 for s in shares) > 20 and sum(0.6 <= s < 0.75 for s in shares) > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    stay = corpus_pipeline.one_of_near_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in stay) == sorted(set(want))


def test_stage_equals_all_pairs_on_given_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    want = {rows[i].doc_id for i in groups([r.text for r in rows])}
    assert {r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, docs, data).collect()} == want


def test_large_buckets_are_compared_across_all_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 1)  # only the last step can find links
    texts = [" ".join(f"w{i}" for i in range(200)) + f" tail{k}" for k in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, docs, "").collect()] == [0]


def test_bitmaps_never_differ_more_than_sets():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 900)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 2**63, 30, dtype=np.uint64)]))
        differ = (jaccard.bitmap(a) ^ jaccard.bitmap(b)).view(np.uint64)
        assert np.bitwise_count(differ).sum() <= len(np.setxor1d(a, b))


def test_sets_are_made_for_the_texts_of_pairs_that_are_left_alone(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "COMMON", 0)  # as in a large table, of which the sample knows little
    made, staged = [], jaccard.staged

    def noted(df):
        out = staged(df)
        made.append(out.count() if "shingles" in out.columns else 0)
        return out

    monkeypatch.setattr(jaccard, "staged", noted)
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    shared = " ".join(word() for _ in range(60))  # all meet, but next to none are alike
    texts = [f"{shared} " + " ".join(word() for _ in range(1500 if k % 2 else 300)) for k in range(40)]
    texts += [texts[0] + " " + word(), texts[1] + " " + word()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    stay = corpus_pipeline.one_of_near_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in stay) == list(range(40))
    assert 0 < sum(made) <= 8


def test_shuffle_files_go_with_their_query(spark):
    import time

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = lambda: {f for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before, set_to = held(), spark.conf.get(name)
    with _spark.shuffles_removed(spark):
        assert _spark.staged(spark.range(5000).repartition(7, "id")).count() == 5000
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before and spark.conf.get(name) == set_to


def test_simhash_proposes_the_groups_of_linked_fingerprints(spark):
    texts = sorted({" ".join((t or "").lower().split()): t for t in planted()}.values(), key=jaccard.node)
    fps = [simhash.fingerprint(t, 5) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(fps):
        for j in range(i):
            if label[i] != label[j] and (a ^ fps[j]).bit_count() <= 4:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    pairs = jaccard.proposed(jaccard.numbered(docs, 5, "id", "text"), 4, 6).collect()
    group = {np.uint64(jaccard.node(t)).astype(np.int64): g for t, g in zip(texts, label, strict=True)}
    assert len(pairs) == len({(r.a, r.b) for r in pairs}) == len(texts) - len(set(label)) > 20
    assert all(group[r.a] == group[r.b] for r in pairs)


def test_stage_links_by_simhash_and_confirms(spark, monkeypatch):
    none = lambda *_: spark.createDataFrame([], "a bigint, b bigint")
    for search in ("_meeting", "_pairs"):
        monkeypatch.setattr(jaccard, search, none)
    rng = np.random.default_rng(6)
    base = [" ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)) for _ in range(10)]
    texts = base + [t + " end" for t in base]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    stay = corpus_pipeline.one_of_near_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in stay) == list(range(10))
    monkeypatch.setattr(jaccard, "RADIUS", 15)  # proposes texts that are not alike as well
    monkeypatch.setattr(jaccard, "BLOCKS", 16)
    texts = planted()
    wanted = set(groups(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert wanted <= {r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, docs, "").collect()}


def test_what_fingerprints_miss_is_found(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "proposed", lambda *_: spark.createDataFrame([], "a bigint, b bigint"))
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    stay = corpus_pipeline.one_of_near_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in stay) == sorted(set(groups(texts)))
