"""Texts that share shingles, found by SimHash and completed exactly.

Fingerprints that link at a few differing bits (see ``simhash``) propose groups
first; each of their texts is confirmed against the group's first on the whole
sets of shingles.  Texts that are in one group by then are not compared again.
What fingerprints can't tell is found exactly:

Two sets of a Jaccard similarity of ``t`` share one of the first
``n - ceil(t n) + 1`` shingles of each, in any order that all texts use
(prefix filter).  Texts meet in a bucket for each such shingle.  Sizes and
parity bitmaps rule out most pairs there (a bitmap never differs in more bits
than the sets do in shingles); every link is confirmed on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelark.llm._spark import forget, join_unique, kept, shuffles_removed, staged, trimmed
from framelark.llm.graph import components
from framelark.llm.simhash import SEED, links, majority, shingle_hashes

#: Words of 64 bits in a bitmap.
WORDS = 8
#: Fingerprints link at so many differing bits, found by so many blocks.
RADIUS, BLOCKS = 7, 9
#: About so many texts tell which shingles are common; at most so many of them are kept.
SAMPLE, COMMON = 10_000, 1 << 18
#: Buckets of so many texts are compared at once; larger ones by parts of about PART first.
SMALL, PART = 64, 4
#: Rows of a large bucket that one task reads for the texts that are left.
CHUNK = 1024


def node(text: str | None) -> int:
    """A number for the text; the same for texts that differ only in A-Z's case and white space."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return xxhash.xxh64_intdigest(b" ".join(parts), SEED)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return _distinct(list(shingle_hashes(text, words)))


def _distinct(found: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, by their rank among the common ones (0 for others) and their hash."""
    keep = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1
    if len(common) and len(own):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        own = own[np.argsort(np.where(common[at] == own, rank[at], 0), kind="stable")]
    return own[:keep]


def bitmap(own: np.ndarray) -> np.ndarray:
    """Whether an odd number of the shingles fall on each bit."""
    odd = np.bincount((own >> np.uint64(40)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def numbered(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, node, fp, size, w0, ...)`` of every row: fingerprint, size and bitmap of its text."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, sizes, bits = [], [], [], np.empty((batch.num_rows, WORDS), np.int64)
            for i, t in enumerate(batch.column(1).to_pylist()):
                found = list(shingle_hashes(t, words))
                own = _distinct(found)
                nodes.append(node(t))
                fps.append(majority(found))
                sizes.append(len(own))
                bits[i] = bitmap(own)
            cols = [batch.column(0), _signed(nodes), _signed(fps), pa.array(sizes, pa.int32())]
            cols += [pa.array(bits[:, i]) for i in range(WORDS)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "node", "fp", "size", *_bits(WORDS)])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    given = ", ".join(f"{w} bigint" for w in _bits(WORDS))
    return source.mapInArrow(trimmed(run), f"id {kind.simpleString()}, node bigint, fp bigint, size int, {given}")


def proposed(texts: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Pairs ``(a, b)`` of texts by SimHash: the first of each group of linked fingerprints, and every other of it."""
    prints = staged(texts.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    named = components(links(prints.select("fp"), radius, blocks)).withColumnRenamed("node", "fp")
    rooted = staged(prints.join(named, "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    best = rooted.groupBy("label").agg(F.min("first").alias("a"), F.count("*").alias("m"))
    heads = staged(join_unique(rooted, best, ["label"], "m", rooted.count()).select("fp", "n", "a"))
    pairs = join_unique(texts.select("fp", F.col("node").alias("b")), heads, ["fp"], "n", texts.count())
    return pairs.where("a < b").select("a", "b")


def common_shingles(texts: DataFrame, rows: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several texts of a sample, sorted, and the rank of each by frequency (from 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, words).view(np.int64))], ["h"])

    every = max(1, -(-rows // SAMPLE))
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    counts = some.mapInArrow(trimmed(run), "h bigint").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    found = counts.orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h = np.array([r.h for r in found], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], (len(h) - np.arange(len(h)))[order]


def buckets(texts: DataFrame, words: int, similarity: float, sent) -> DataFrame:
    """``(h, node, size, n)``: the prefix shingles that different texts of like sizes have, these texts and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = sent.value
        for batch in batches:
            nodes, sizes, firsts = [], [], []
            for t in batch.column(0).to_pylist():
                own = shingle_set(t, words)
                firsts.append(prefix(own, common, rank, similarity))
                nodes.append(np.full(len(firsts[-1]), node(t), np.uint64))
                sizes.append(np.full(len(firsts[-1]), len(own), np.int32))
            if nodes:
                h, n = (pa.array(np.concatenate(x).view(np.int64)) for x in (firsts, nodes))
                yield pa.RecordBatch.from_arrays([h, n, pa.array(np.concatenate(sizes))], ["h", "node", "size"])

    held = texts.mapInArrow(trimmed(run), "h bigint, node bigint, size int").repartition("h").distinct()
    order = Window.partitionBy("h").orderBy("size", "node")
    held = held.withColumn("less", F.lag("size").over(order)).withColumn("more", F.lead("size").over(order))
    least = similarity - 1e-9  # sets of less than this share of the other's size are not alike enough
    held = held.where((F.col("less") >= F.col("size") * least) | (F.col("size") >= F.col("more") * least))
    return held.select("h", "node", "size", F.count(F.lit(1)).over(Window.partitionBy("h")).alias("n"))


def described(texts: DataFrame, words: int) -> DataFrame:
    """``(node, shingles)`` of ``(node, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingle_set(t, words).tobytes() for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["node", "shingles"])

    return texts.mapInArrow(trimmed(run), "node bigint, shingles binary")


def jaccard(x: bytes, y: bytes) -> float:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def _jaccard(a: str, b: str) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaccard(v, w) for v, w in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def _bits(words: int) -> list[str]:
    return [f"w{i}" for i in range(words)]


def _near(l: Column, r: Column, words: int, similarity: float) -> Column:
    """Sizes and so many words of the bitmaps do not rule the pair out."""
    differ = F.abs(l["size"] - r["size"])
    if words:
        bits = [F.bit_count(l[w].bitwiseXOR(r[w])) for w in _bits(words)]
        differ = F.greatest(differ, sum(bits[1:], bits[0]))
    return differ * (1 + similarity) <= (l["size"] + r["size"]) * (1 - similarity) + 1e-6


def _pairs(left: DataFrame, right: DataFrame, words: int, similarity: float) -> DataFrame:
    """Texts of different groups in one part of a bucket that may be alike, once each."""
    l, r = F.col("l"), F.col("r")
    pack = lambda df, to: df.select("h", "p", F.struct("node", "label", "size", *_bits(words)).alias(to))
    met = pack(left, "l").join(pack(right, "r").hint("merge"), ["h", "p"])  # an explode may hide a side's size
    met = met.where((l["label"] != r["label"]) & _near(l, r, words, similarity))
    return met.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def _enough(shared: Column, l: Column, r: Column, similarity: float) -> Column:
    """Sets that have at most so many shingles in both of their prefixes may be alike.

    What two sets have in common and not in both prefixes lies behind the prefix
    of one of them.
    """
    behind = F.ceil(F.greatest(l["size"], r["size"]) * F.lit(similarity) - 1e-9) - 1
    return shared + behind >= (l["size"] + r["size"]) * F.lit(similarity / (1 + similarity)) - 1e-6


def _meeting(held: DataFrame, brief: DataFrame, similarity: float) -> DataFrame:
    """Pairs of the small buckets that share enough of their prefixes to be alike, if not in one group.

    Shingles of large buckets are taken as shared.
    """
    l, r = F.col("l"), F.col("r")
    rows = held.where(F.col("n") <= SMALL).select("h", F.struct("node", "size").alias("l"))
    met = rows.join(rows.withColumnRenamed("l", "r"), "h").where((l["node"] < r["node"]) & _near(l, r, 0, similarity))
    met = met.groupBy(l["node"].alias("a"), r["node"].alias("b")).agg(F.count("*").alias("m"))
    for side, to in (("a", "l"), ("b", "r")):
        met = met.join(brief.select(F.col("node").alias(side), F.struct("size", "large", "label").alias(to)), side)
    most = F.col("m") + F.least("l.large", "r.large")
    return met.where((l["label"] != r["label"]) & _enough(most, l, r, similarity)).select("a", "b")


def linked(held: DataFrame, texts: DataFrame, first: DataFrame, fetch, similarity: float) -> DataFrame:
    """``(node, label)`` of the texts that have links, one label a group.

    The pairs ``first`` of texts are confirmed first, then those that meet in
    whole small buckets of ``held(h, node, size, n)`` and parts of the large
    ones, then in other parts of those that still hold several groups, at last
    all pairs across groups in them.  ``texts`` has size and bitmap of each
    text, ``fetch`` the sets of some (see ``described``).
    """
    met = held.groupBy("node").agg(F.count("*").alias("shared"), F.count(F.when(F.col("n") > SMALL, 1)).alias("large"))
    brief = staged(texts.select("node", "size", *_bits(WORDS)).join(met, "node"))  # without a shared one there is no link
    sized = staged(held.where(F.col("n") > SMALL))

    def confirmed(pairs: DataFrame) -> DataFrame:
        l, r = F.col("l"), F.col("r")
        for side, to in (("a", "l"), ("b", "r")):
            pairs = pairs.join(brief.select(F.col("node").alias(side), F.struct("size", "shared", *_bits(WORDS)).alias(to)), side)
        enough = _enough(F.least("l.shared", "r.shared"), l, r, similarity)
        pairs = staged(pairs.where(enough & _near(l, r, WORDS, similarity)).select("a", "b"))
        sets = staged(fetch(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
        often = pairs.groupBy("a").agg(F.count("*").alias("m"))
        firsts = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")).join(often, "a")
        both = join_unique(pairs, firsts, ["a"], "m", pairs.count())
        both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        found = staged(both.where(_jaccard("sa", "sb") >= similarity - 1e-9).select("a", "b"))
        forget(pairs, sets)
        return found

    found = confirmed(first)
    for number in range(3):
        named = components(found).select("node", F.col("label").alias("name"))
        rows = sized.join(named.withColumnRenamed("name", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        counts = rows.groupBy("h", "label").agg(F.count("*").alias("m"))
        most = counts.groupBy("h").agg(F.max_by("label", "m").alias("most"), F.count("*").alias("groups"))
        rows = staged(rows.join(most.where("groups > 1"), "h"))
        if number and rows.isEmpty():
            break
        if number < 2:
            rows = rows.withColumn("p", F.pmod(F.xxhash64("node", "h", F.lit(number)), F.ceil(F.col("n") / PART)))
            pairs = _pairs(rows, rows, 0, similarity)
            if not number:
                grouped = brief.join(named.withColumnRenamed("name", "label"), "node", "left")
                grouped = grouped.withColumn("label", F.coalesce("label", "node"))
                pairs = pairs.union(_meeting(held, grouped, similarity)).distinct()
        else:  # of two texts in different groups one is not in the largest
            chunks = F.ceil(F.col("n") / CHUNK).cast("int")
            rows = rows.join(brief.select("node", *_bits(WORDS)), "node")
            right = rows.withColumn("p", F.pmod(F.xxhash64("node"), chunks).cast("int"))
            left = rows.where(F.col("label") != F.col("most")).withColumn("p", F.explode(F.sequence(F.lit(0), chunks - 1)))
            pairs = _pairs(left, right, WORDS, similarity)
        found = found.unionByName(confirmed(pairs))
    return components(found)


def near_duplicates(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, component)`` for every row: groups linked by a Jaccard similarity of the shingle sets.

    ``component`` is the smallest id of the group.  Ids must differ where texts
    do; texts that differ only in case and white space, and those without a
    word, are copies and compared once.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def grouped() -> DataFrame:
        same = [F.first(c).alias(c) for c in ("fp", "size", *_bits(WORDS))]
        texts = staged(prints.groupBy("node").agg(F.min("id").alias("least"), *same))
        sent = spark.sparkContext.broadcast(common_shingles(source.select("text"), prints.count(), words))
        held = staged(buckets(source.select("text"), words, similarity, sent))

        def fetch(nodes: DataFrame) -> DataFrame:
            needed = texts.select("node", F.col("least").alias("id")).join(nodes, "node", "left_semi")
            named = source.join(needed, "id").select("node", "text")
            return described(named.dropDuplicates(["node"]) if repeated else named, words)

        repeated = prints.count() > prints.select("id").distinct().count()  # rows that repeat id and text
        found = linked(held, texts, proposed(texts, RADIUS, BLOCKS), fetch, similarity)
        rooted = staged(texts.select("node", "least").join(found, "node", "left").withColumn("label", F.coalesce("label", "node")))
        best = rooted.groupBy("label").agg(F.min("least").alias("component"))
        return rooted.join(best, "label").select("node", "component")

    with shuffles_removed(spark):
        prints = staged(numbered(docs, words, id_col, text_col))
        named = kept(grouped)
    return prints.select("id", "node").join(named, "node").select("id", "component")
