"""Benchmark items contained in documents, by containment MinHash.

Items are partitioned by size, the number of their distinct ``words``-word
shingles.  An item keeps the smallest hashes of its shingles (a bottom-k
MinHash sketch), one more than an item of its partition may miss at the
threshold; a document that contains the item must then hold one of them, or
more where the item is smaller than its partition's bound.  Documents are
probed with all their shingles, candidates are verified by counting the item's
shingles that the document holds exactly.

A benchmark of bounded size is sent to the executors, and the documents are
read once.  A larger one never leaves the tables: sketches and the documents'
shingles meet under their hashes, and only candidates meet as texts.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelark.llm._spark import HEAVY_LEAST, HEAVY_SHARE, release, staged, trimmed

WORD = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Items, and characters of their texts, that are sent to the executors; a larger benchmark is joined.
ITEMS, CHARACTERS = 20_000, 32_000_000
#: Tasks that the documents with a very frequent hash are dealt to.
SALTS = 64


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.casefold()) if text else []


def shingles_of(parts: list[str], words: int) -> set[tuple[str, ...]]:
    """The runs of ``words`` words; of fewer there are none."""
    return {tuple(parts[i : i + words]) for i in range(len(parts) - words + 1)}


def width_of(parts: list[str], words: int) -> int:
    """Words of an item's shingles: its own number, if it has fewer than ``words``."""
    return min(len(parts), words)


def _hashes(ids: np.ndarray, words: int) -> np.ndarray:
    """A hash of every run of ``words`` ids; a run with an unknown word (0) gets 0."""
    n = len(ids) - words + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, known = np.full(n, words, np.uint64), np.ones(n, bool)
    with np.errstate(over="ignore"):
        for j in range(words):
            part = ids[j : j + n]
            h = h * BASE + part
            known &= part != 0
        h ^= h >> np.uint64(32)
        h *= MIX
        h ^= h >> np.uint64(29)
    return np.where(known, h | np.uint64(1), np.uint64(0))


def sketch(h: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """The bottom-k sketch of an item's distinct hashes, and how many of it a containing document holds at least."""
    n = len(h)
    bound = 2 ** n.bit_length() - 1  # of the item's size partition
    k = min(n, int((1 - threshold) * bound + 1e-9) + 1)
    return np.sort(h)[:k], max(1, k - int((1 - threshold) * n + 1e-9))


def enough(matched: int, shingles: int, threshold: float) -> bool:
    return matched >= threshold * shingles - 1e-9


@dataclass
class Index:
    """The sketches of a benchmark of bounded size."""

    threshold: float
    vocabulary: dict[str, int]
    ids: list
    widths: list[int]
    shingles: list[set]
    hits: list[int]  # sketch hashes that a containing document holds at least
    keys: dict[int, np.ndarray]  # by width: sorted sketch hashes, and by their place the items that have them
    items: dict[int, list[list[int]]]

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item, shingles found) of every item contained in ``text``."""
        parts = words_of(text)
        if not parts or not self.keys:
            return []
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in parts), np.uint64, len(parts))
        seen: dict[int, int] = defaultdict(int)
        for width, keys in self.keys.items():
            h = _hashes(ids, width)
            h = np.unique(h[h != 0])
            if not len(h):
                continue
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            for a in at[keys[at] == h].tolist():
                for item in self.items[width][a]:
                    seen[item] += 1
        candidates = [i for i, n in seen.items() if n >= self.hits[i]]
        held = {w: shingles_of(parts, w) for w in {self.widths[i] for i in candidates}}
        out = []
        for i in sorted(candidates):
            n = len(self.shingles[i] & held[self.widths[i]])
            if enough(n, len(self.shingles[i]), self.threshold):
                out.append((i, n))
        return out


def build(items: list[tuple], words: int, threshold: float) -> Index:
    """``items`` are (id, text); one without words is never found."""
    found = Index(threshold, {}, [], [], [], [], {}, {})
    tables: dict[int, dict[int, list[int]]] = {}
    for key, text in items:
        parts = words_of(text)
        if not parts:
            continue
        for w in parts:
            found.vocabulary.setdefault(w, len(found.vocabulary) + 1)
        width = width_of(parts, words)
        ids = np.array([found.vocabulary[w] for w in parts], np.uint64)
        own, hits = sketch(np.unique(_hashes(ids, width)), threshold)
        for v in own.tolist():
            tables.setdefault(width, defaultdict(list))[v].append(len(found.ids))
        found.ids.append(key)
        found.widths.append(width)
        found.shingles.append(shingles_of(parts, width))
        found.hits.append(hits)
    for width, table in tables.items():
        keys = sorted(table)
        found.keys[width], found.items[width] = np.array(keys, np.uint64), [table[v] for v in keys]
    return found


def index_of(benchmark: DataFrame, words: int, threshold: float, id_col: str, text_col: str) -> Index | None:
    """The benchmark as an index, if it has at most ``ITEMS`` items and ``CHARACTERS`` characters."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    if n > ITEMS or size > CHARACTERS:
        return None
    return build([tuple(r) for r in rows.collect()], words, threshold)  # of a checked size


def finder(sent, kind: str):
    """A column function: the items of a broadcast index that a text contains; ``kind`` is the type of their ids."""

    @F.pandas_udf(f"array<struct<item_id:{kind},matched:int,shingles:int>>")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        for text in texts:
            yield pd.Series([[(own.ids[i], n, len(own.shingles[i])) for i, n in own.find(t)] for t in text], dtype=object)
        release()

    return find


# --- benchmarks of any size ----------------------------------------------------


def text_hashes(parts: list[str], words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, the same in every task."""
    ids = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) | 1 for w in parts), np.uint64, len(parts))
    return np.unique(_hashes(ids, words))


def _sketches(words: int, threshold: float):
    """(key, text) of items -> (key, width, hits, h), a row for each hash of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = words_of(text)
                if parts:
                    width = width_of(parts, words)
                    own, hits = sketch(text_hashes(parts, width), threshold)
                    rows += [(key, width, hits, h) for h in own.view(np.int64).tolist()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["item", "width", "hits", "h"])

    return trimmed(run)


def _probes(widths: list[int]):
    """(doc, text) -> (doc, h): the hashes of all shingles of the widths that items have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = words_of(text)
                for width in widths:
                    h = text_hashes(parts, width).view(np.int64)
                    if len(h):
                        yield pa.RecordBatch.from_arrays([pa.array([doc] * len(h), pa.binary()), pa.array(h)], ["doc", "h"])

    return trimmed(run)


def _joined(docs: DataFrame, items: DataFrame, words: int, threshold: float) -> DataFrame:
    """``(doc, item, matched, shingles)`` of ``docs(doc, text)`` and ``items(item, text)`` of any size."""
    sketches = staged(items.mapInArrow(_sketches(words, threshold), "item binary, width int, hits int, h bigint"))
    widths = sorted(r.width for r in sketches.select("width").distinct().collect())  # at most ``words`` of them
    probes = docs.mapInArrow(_probes(widths), "doc binary, h bigint")
    wanted = sketches.select("h").distinct()
    probes = staged(probes.join(wanted, "h", "left_semi"))
    most = max(HEAVY_LEAST, probes.count() // HEAVY_SHARE)
    heavy = probes.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > most)
    heavy = F.broadcast(heavy.select("h", F.lit(True).alias("heavy")))  # at most HEAVY_SHARE hashes
    salt = F.when(F.col("heavy"), F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(0)
    salts = F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = probes.join(heavy, "h", "left").select("h", "doc", salt.cast("int").alias("salt"))
    right = sketches.join(heavy, "h", "left").select("h", "item", "hits", F.explode(salts).alias("salt"))
    met = left.join(right, ["h", "salt"]).groupBy("doc", "item", "hits").agg(F.count("*").alias("n"))
    met = staged(met.where("n >= hits").select("doc", "item"))

    @F.pandas_udf("struct<matched:int,shingles:int>")
    def verified(text: pd.Series, item: pd.Series) -> pd.DataFrame:
        rows = []
        for t, i in zip(text, item, strict=True):
            parts = words_of(i)
            own = shingles_of(parts, width_of(parts, words))
            rows.append((len(own & shingles_of(words_of(t), width_of(parts, words))), len(own)))
        return pd.DataFrame(rows, columns=["matched", "shingles"], dtype="int32")

    pairs = met.join(docs.select("doc", F.col("text").alias("t")), "doc").join(items.select("item", F.col("text").alias("i")), "item")
    pairs = pairs.select("doc", "item", verified("t", "i").alias("v")).select("doc", "item", "v.matched", "v.shingles")
    return pairs.where(F.col("matched") >= threshold * F.col("shingles") - 1e-9)


def _content(text: Column) -> Column:
    """128 bits of a hash of a text: what tells documents and items apart here."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def _pairs(docs: DataFrame, benchmark: DataFrame, words: int, threshold: float, text: str, item_id: str, item_text: str) -> tuple:
    """Documents ``(doc, text)`` and items ``(item, key, text)`` by content, and which of them match, by joins."""
    items = benchmark.select(F.col(item_id).alias("key"), F.col(item_text).cast("string").alias("text"))
    items = items.where(F.col("text").isNotNull()).withColumn("item", _content(F.col("text")))
    texts = docs.select(F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    texts = texts.withColumn("doc", _content(F.col("text"))).groupBy("doc").agg(F.first("text").alias("text"))
    once = items.groupBy("item").agg(F.first("text").alias("text"))
    return items, staged(_joined(staged(texts), staged(once), words, threshold))


def contained(
    docs: DataFrame,
    benchmark: DataFrame,
    words: int = 5,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``(id, item_id, matched, shingles, containment)`` of every contained item.

    Words are runs of letters and digits without case; an item is contained if
    at least ``threshold`` of its distinct shingles stand in the document's
    whole text.  An item of fewer than ``words`` words is one shingle of as many
    words as it has.  Null or empty texts contain and are contained in nothing;
    repeated rows and items are each answered; null ids are kept.  Either table
    may be empty; other columns are not looked at.
    """
    index = index_of(benchmark, words, threshold, item_id, item_text)
    share = (F.col("matched") / F.col("shingles")).alias("containment")
    if index is None:
        items, met = _pairs(docs, benchmark, words, threshold, text_col, item_id, item_text)
        keyed = docs.select(F.col(id_col).alias("id"), _content(F.col(text_col).cast("string")).alias("doc"))
        keyed = keyed.join(met, "doc").join(items.select("item", F.col("key").alias("item_id")), "item")
        return keyed.select("id", "item_id", "matched", "shingles", share)
    find = finder(docs.sparkSession.sparkContext.broadcast(index), benchmark.schema[item_id].dataType.simpleString())
    hit = docs.select(F.col(id_col).alias("id"), F.explode(find(F.col(text_col).cast("string"))).alias("h"))
    return hit.select("id", "h.*").select("*", share)


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    words: int = 5,
    threshold: float = 0.8,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that contain no item of ``benchmark`` (see ``contained``), with all their columns."""
    index = index_of(benchmark, words, threshold, item_id, item_text)
    text = F.col(text_col).cast("string")
    if index is not None:
        sent = docs.sparkSession.sparkContext.broadcast(index)
        return docs.where(F.size(finder(sent, benchmark.schema[item_id].dataType.simpleString())(text)) == 0)
    _, met = _pairs(docs, benchmark, words, threshold, text_col, item_id, item_text)
    bad = met.select(F.col("doc").alias("d")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _content(text).alias("doc"))
    return rows.join(bad, F.col("doc") == F.col("d"), "left_anti").select("row.*")
