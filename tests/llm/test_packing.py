import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from framelark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def by_one(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_random_texts_in_a_small_memory(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 50)
    whole, words, r = Tokenizer.from_file(PATH), packing.WordIds(PATH), random.Random(2)
    signs = "abXYéÈßÿ'’“—.,!$%*()-_<|>\"01 \t\n\x0b\x1c\x85\xa0\u3000\u0301µﬁ中😀İΣς\x00"
    for _ in range(3000):
        t = "".join(r.choice(signs) for _ in range(r.randint(0, 40)))
        assert words.text(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


@pytest.mark.parametrize("seed", range(60))
def test_plan_equals_best_fit_decreasing_one_by_one(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 20, 64, 100])
    lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 80))] + [r.randint(1, 3)] * r.choice([0, 50])
    bins, ranks = defaultdict(list), Counter()
    for length, rank, count, first, offset in packing.best_fit(Counter(lengths), capacity):
        assert rank == ranks[length]
        ranks[length] += count
        for i in range(count):
            bins[first + i].append((offset, length))
    assert ranks == Counter(lengths)
    rooms = []
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        rooms.append(capacity - at)
    assert sorted(rooms) == by_one(lengths, capacity)


ODD = ["Don't stop.THE<|endoftext|>x <|startoftext|> ABC", "İstanbul ΟΔΟΣ Σ", "é é ﬁ", "a b c\u0085d​e\x1cf",
       "x.,", "Uh... so*** what's.' <|ENDOFTEXT|> that)) (it,) “Él” — él.", "", " \n", "ab12,cd!", "日本語", "IT'S RE're'll", "﻿abc", "Ó, K.", "a" * 300, None]


def test_word_memory_equals_the_tokenizer(spark, data):
    whole, words = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    texts = ODD + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()]
    for t in texts:
        assert words.text(t) == np.array(whole.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), t


def test_pack_covers_every_document(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = packing.pack(docs, PATH).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    whole = Tokenizer.from_file(PATH)
    assert set(out.id) == set(texts)
    for i, g in out.sort_values("piece").groupby("id"):
        ids = np.array([*whole.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        assert list(g.piece) == list(range(len(g))) and list(g.start) == [2048 * k for k in range(len(g))] and g.length.sum() == len(ids)
        for s, n, c, own in zip(g.start, g.length, g.ids_crc32, g.ids, strict=True):
            assert zlib.crc32(ids[s : s + n].tobytes()) == c and (np.asarray(own) == ids[s : s + n]).all()
    rooms = []
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 2048
        rooms.append(2048 - g.length.sum())
    assert sorted(rooms) == by_one(out.length.tolist(), 2048)


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 3), (2, "word " * 5000, 4)], "doc_id bigint, text string, length int")
    out = packing.pack(docs, PATH, capacity=64).toPandas()
    assert sorted(out[out.length < 64].length) == [1, 1, 1, 9] and (out.length == 64).sum() == 78
    assert packing.pack(docs.limit(0), PATH).count() == 0
