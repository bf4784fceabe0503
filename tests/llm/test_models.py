"""Language, toxicity, neighbours, pages: held-out quality and odd rows."""

import random
import time
import zlib

import numpy as np

from framelark.llm import ann, html_crf, langid, queries, toxicity


def test_language_on_held_out_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang", "n_chars").toPandas()
    got = queries.op3_language_id(spark, data).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    held = got[got.held_out & (got.n_chars > 20)]
    assert (held.lang_pred == held.lang).mean() > 0.97


def test_language_of_odd_texts(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !?", None), (None, "the dog", None), (103, "\U00010400", None), (104, "und die " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    none = lambda key: key.isNotNull()
    got = {r.id: r for r in langid.identify(docs, none, lambda key: key < 0).collect()}
    assert got[100].lang_pred == got[101].lang_pred == got[102].lang_pred == "und" and got[102].score == 0
    assert got[None].lang_pred == "en" and got[104].lang_pred == "de" and got[103].lang_pred in ("en", "de")
    assert langid.identify(docs.limit(0), none, none).count() == 0


def test_language_query_equals_a_plain_form(spark, data):
    """Prototypes and cosines anew, a trigram at a time."""
    from collections import Counter

    docs = spark.read.parquet(f"{data}/documents.parquet").toPandas()
    base, table = langid.letters().astype(float), langid.alphabet()
    two, one = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)

    def vector(text):
        s = [0, *(int(table[min(ord(c), 0xFFFF)]) for c in text or ""), 0]
        out = np.zeros(langid.SIZE)
        for (a, b, c), n in Counter(t for t in zip(s[:-2], s[1:-1], s[2:], strict=True) if t[1]).items():
            out += n * two[a] * one[b] * base[c]
        return out / (np.linalg.norm(out) or 1)

    docs["v"] = [vector(t) for t in docs.text]
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in docs.doc_id])
    names = sorted(docs.lang.dropna().unique())
    known = {n: np.sum(docs.v[(docs.lang == n) & ~held].tolist(), axis=0) for n in names}
    known = {n: p / np.linalg.norm(p) for n, p in known.items()}
    got = queries.op3_language_id(spark, data).toPandas().set_index("doc_id")
    for i, v, h in zip(docs.doc_id, docs.v, held, strict=True):
        cosine = {n: float(v @ p) for n, p in known.items()}
        assert got.held_out[i] == h and abs(got.score[i] - max(0, min(1, max(cosine.values())))) < 1e-5
        assert not v.any() or cosine[got.lang_pred[i]] > max(cosine.values()) - 1e-6


def test_long_texts_come_in_parts(monkeypatch):
    text = "Ein Satz, aber ein langer; et un autre. " * 40
    whole = langid.vectors([text, "b"])
    monkeypatch.setattr(langid, "CHARACTERS", 37)
    monkeypatch.setattr(langid, "SLICE", 5)
    assert (langid.vectors([text, "b"]) == whole).all()


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "the cat and dog", "en", 0.5, "x"), (1, "the cat and dog", "en", 0.1, "y"), (2, "der hund", "de", 0.2, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double, p string")
    every = lambda key: key.isNotNull()
    got = [(r.id, r.lang_pred) for r in langid.identify(docs, every, every).collect()]
    assert sorted(got) == [(1, "en"), (1, "en"), (2, "de")]
    labels = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.1), (2, None, 1.0)], "doc_id bigint, toxic int, score double")
    assert toxicity.classify(docs, labels, every, every).count() == 3


def test_many_letters_within_memory():
    import tracemalloc

    rng = np.random.default_rng(0)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 20_000))) for _ in range(64)]
    langid.alphabet()
    tracemalloc.start()
    langid.vectors(texts)
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()


def test_vectors_are_bound_and_bundled():
    a = langid.vectors(["abc"])[0]
    v = langid.letters().astype(int)
    at = lambda s, k: np.roll(v[s], k)
    want = at(0, 2) * at(1, 1) * v[2] + at(1, 2) * at(2, 1) * v[3] + at(2, 2) * at(3, 1) * v[0]
    assert (a == want).all() and not langid.vectors([None, "1"]).any()


def toxic_rows(spark):
    r = random.Random(0)
    plain = lambda: " ".join(r.choice("alpha beta gamma delta river stone".split()) for _ in range(30))
    docs, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        extra = r.choice([" moron ", " m0ron, ", " mоrоn! "]) if bad else r.choice([*[""] * 12, " the moron badge "])
        docs.append((i, plain() + extra + plain()))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxicity_folds_and_knows_exceptions(spark):
    docs, labels = toxic_rows(spark)
    even, odd = (lambda key: key % 3 != 1), (lambda key: key % 3 == 1)
    got = toxicity.classify(docs, labels, even, odd).toPandas().merge(labels.toPandas(), left_on="id", right_on="doc_id")
    held = got[got.held_out]
    assert len(held) == 100 and (held.predicted == held.toxic).mean() > 0.95
    assert toxicity.fold("M0RОN@home $tupid$ ｍ") == " moronahome stupid m "
    assert toxicity.fold(None) == " " and toxicity.patterns_of("clown")[0] == " clown "


def test_given_phrases_are_exceptions(spark):
    docs, labels = toxic_rows(spark)
    rows = docs.join(labels, "doc_id").select("text", "toxic")
    for phrases, found in (((), True), (("Moron, gadget",), False)):
        lexicon = toxicity.learn(rows, phrases=phrases)
        assert bool(lexicon.matches(toxicity.fold("a moron gadget"), lexicon.automaton())) == found


def test_matches_equal_all_pairs_of_spans():
    r = random.Random(3)
    for _ in range(300):
        words = [r.choice("ab") * r.randint(1, 3) for _ in range(r.randint(0, 30))]
        folded = toxicity.fold(" ".join(words))
        weights = {f" {w}": r.choice([1.0, -1.0]) for w in {"".join(r.choice("ab ") for _ in range(r.randint(1, 6))).strip() or "a" for _ in range(6)}}
        lexicon = toxicity.Lexicon(weights)
        spans = [(i, i + len(p), p, w) for p, w in weights.items() for i in range(len(folded)) if folded.startswith(p, i)]
        want = sorted(p for a, b, p, w in spans if w > 0 and not any(c <= a and b <= d for c, d, _, v in spans if v < 0))
        assert sorted(p for p, _ in lexicon.matches(folded, lexicon.automaton())) == want


def test_long_texts_of_exceptions_are_linear():
    lexicon = toxicity.Lexicon({" trash": 2.0, " trash bin ": -2.0})
    text, began = "trash bin trash can " * 50_000, time.time()
    assert len(lexicon.matches(toxicity.fold(text), lexicon.automaton())) == 50_000 and time.time() - began < 5


def test_scores_equal_a_plain_form(spark):
    """Scores from the lexicon and the bias, matched by plain search."""
    docs, labels = toxic_rows(spark)
    usable = lambda key: key % 3 != 1
    lexicon = toxicity.learn(toxicity.training_rows(docs, labels, usable, 10_000, "doc_id", "text", "toxic"))
    got = {r.id: r.score for r in toxicity.classify(docs, labels, usable, usable).collect()}
    assert min(lexicon.weights.values()) < 0 < max(lexicon.weights.values())
    for r in docs.collect():
        folded = toxicity.fold(r.text)
        spans = [(i, i + len(p), w) for p, w in lexicon.weights.items() for i in range(len(folded)) if folded.startswith(p, i)]
        total = sum(w for a, b, w in spans if w > 0 and not any(c <= a and b <= d for c, d, v in spans if v < 0))
        z = lexicon.bias[0] + lexicon.bias[1] * np.log1p(total) + lexicon.bias[2] * np.log1p(100 * total / (folded.count(" ") + 10))
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity_without_labels_or_rows(spark):
    docs, labels = toxic_rows(spark)
    every = lambda key: key.isNotNull()
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "moron " * 30_000)], "doc_id bigint, text string")
    assert {r.predicted for r in toxicity.classify(odd, labels.limit(0), every, every).collect()} == {0}
    assert toxicity.classify(odd, labels, every, every).count() == 4
    assert toxicity.classify(docs.limit(0), labels, every, every).count() == 0


def test_toxicity_on_given_documents(spark, data):
    got = queries.op5_toxicity(spark, data).toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_neighbours_recall_and_order(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(rows.embedding.map(lambda v: np.asarray(v, float))), rows.vec_id.to_numpy()
    got = queries.op6_learned_partition_ann(spark, data).toPandas()
    found = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 11)) and list(own.score) == [d[ids == v][0] for v in own.vec_id]
        assert own.score.is_monotonic_increasing
        found += len(set(best) & set(own.vec_id))
    assert found / (10 * (ids % 100 == 0).sum()) >= 0.9


def brute_neighbours(rows, k=10):
    """All ranks of every query row (id divisible by 100) over distinct rows, by plain distances."""
    once = {(i, tuple(v)) for i, v in rows}
    out = []
    for q, v in once:
        if q % 100 == 0:
            d = [(float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in once if (i, w) != (q, v)]
            out += [(q, rank + 1, i, s) for rank, (s, i) in enumerate(sorted(d)[:k])]
    return sorted(out)


def test_neighbours_with_repeats_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3)]) for i in range(260)]
    rows += [(200, [1.0, 2.0, 0.5]), *rows[95:105] * 2, *[(k, [1.0, 1.0, 1.0]) for k in range(300, 340)]]
    rows = [r for r in rows if any(r[1])]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "vec_id bigint, embedding array<double>, score double, part string")
    got = ann.search(df, lambda key: key % 100 == 0, parts=4, probes=4).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_neighbours(rows)
    assert len({(r.query_id, r.query_key) for r in got}) == 5 and len(got) == 50


def test_more_parts_and_fewer_probes_on_grouped_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 64)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((80, 16))[rng.integers(0, 80, 6000)] + 0.1 * rng.standard_normal((6000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    seen = []
    probed = ann.probes_for
    monkeypatch.setattr(ann, "probes_for", lambda router, x, near, parts, target: seen.append((parts, probed(router, x, near, parts, target))) or seen[-1][1])
    got = ann.search(df, lambda key: key % 100 == 0).toPandas()
    (parts, probes) = seen[0]
    assert parts == 128 and probes <= 16
    right = sum(len(set(np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:11]) & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert right / 600 >= 0.9 and len(got) == 600


def test_neighbours_of_odd_vectors(spark):
    same = [(i, [1.0, 1.0]) for i in range(100, 140)]
    rows = [*same, (0, [1.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0]), (None, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.search(df, lambda key: key == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(100, 110)) and {r.score for r in got} == {0.0}
    few = ann.search(df.where("vec_id in (0, 100, 1)"), lambda key: key == 0).collect()
    assert [(r.rank, r.vec_id) for r in few] == [(1, 100)]
    assert ann.search(df.limit(0), lambda key: key == 0).count() == 0


def test_partition_is_balanced():
    x = np.random.default_rng(0).standard_normal((512, 8))
    assert np.bincount(ann.partition(x, 8)).tolist() == [64] * 8


def test_pages_made_anew():
    rng, model, right = random.Random(5), html_crf.field(), 0
    for _ in range(120):
        page, main = html_crf.training_page(rng)
        blocks = html_crf.blocks_of(page)
        right += model.decode(html_crf.features(blocks)) == [int(b.text in main) for b in blocks]
    assert right >= 105


def test_viterbi_is_the_best_labelling():
    from itertools import product

    model = html_crf.field()
    page, _ = html_crf.training_page(random.Random(8))
    rows = html_crf.features(html_crf.blocks_of(page))[:9]
    s = [model.emit[[model.index[w] for w in f if w in model.index]].sum(axis=0) for f in rows]
    score = lambda y: model.start[y[0]] + sum(s[i][k] for i, k in enumerate(y)) + sum(model.move[a, b] for a, b in zip(y[:-1], y[1:], strict=True))
    best = max(product((0, 1), repeat=len(rows)), key=score)
    assert list(best) == model.decode(rows)


def test_given_pages(spark, data):
    import html
    import re

    got = {r.page_id: r for r in queries.op2_html_main_text(spark, data).collect()}
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        inner = re.sub(r"</?b>|<br>", " ", re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1])
        lines = [re.sub(r"\s+", " ", html.unescape(t)).strip() for t in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n".join(t for t in lines if t) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "just text, without any tag."), (3, "u", "<article><p>One &lt;b&gt;&nbsp; two\n three.<script>var x='</p>'</script><p>Four.</article><div class=comments><p>Nice post, thanks a lot.</p></div>"),
            (4, "u", "<article>" + "<p>Some words here.</p>" * 4000 + "</article>"), (5, "u", "<<p <!-- ")]
    got = {r.id: r.text for r in html_crf.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1] == got[2] == "" and got[None] == "just text, without any tag."
    assert got[3] == "One <b> two three.\nFour." and got[4].count("\n") == 3999
    assert html_crf.extracted(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_broken_and_deep_pages_take_linear_time():
    model = html_crf.field()
    pages = ["<a " * 350_000, "<div class=a>x" * 100_000, "<!" * 500_000, "<svg>x" * 150_000, "<div>" * 50_000 + "</section>x" * 50_000, "<" * 1_000_000]
    pages += ["<a '" * 250_000, "".join(f'<div class="c{i} nav{i}">t' for i in range(50_000)), "&#" + "9" * 100_000 + ";"]
    for page in pages:
        began = time.time()
        html_crf.extract(page, model)
        assert time.time() - began < 8, page[:40]


def test_templates_that_training_does_not_make():
    model, t = html_crf.field(), "The quick brown fox jumps over the lazy dog while the cat watches from the fence."
    pages = [
        f"<body><div class='content'><p>{t}</p><div class='cookie-bar'>We use cookies to improve things.</div><p>{t}</p></div></body>",
        f"<div class='post-body'><p>{t}</p><aside class='related-posts'><h3>See also</h3><ul><li><a href=x>Other post</a></li></ul></aside><p>{t}</p></div><div class='reader-comments'><p>Nice post thanks.</p></div>",
        f"<div id='page'><div class='top-nav'><a href=x>A</a></div><div class='entry-content'><p>{t}</p><p>{t}</p><div class='advert_box'>Buy now cheap.</div></div><div class='footer-links'><a href=z>Z</a></div></div>",
        f"<main><p>{t}</p><div id='newsletterSignup'><p>Subscribe to our list.</p></div><p>{t}</p></main><footer>(c) x</footer>",
    ]
    for page in pages:
        assert html_crf.extract(page, model) == f"{t}\n{t}", page
    assert html_crf.extract(f"<article><p>{t} <svg class='i'/>More.</p><select><p>{t}</p><iframe></article>", model) == f"{t} More.\n{t}"


def test_pages_repeated_and_with_clashing_columns(spark):
    rows = [(1, "u", "<p>Hello to all of you.</p>", "x", 3)] * 2
    got = html_crf.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, id int")).collect()
    assert [tuple(r) for r in got] == [(1, "u", "Hello to all of you.", 20)] * 2
