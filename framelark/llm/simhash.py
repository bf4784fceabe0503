"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared inside buckets.  By the pigeonhole principle two
fingerprints of ``bits`` bits that differ in at most ``radius`` of them agree
on at least ``blocks - radius`` of ``blocks`` bit blocks; every choice of that
many blocks is one bucket table, so no link is missed.  Inside a bucket the
fingerprints are stored as vertical bit planes, 64 lanes to a word; distances
are counted for 64 lanes at once by carry-save adders, and a word is abandoned
as soon as all its lanes are beyond the radius.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelark.llm._spark import groups_of, join_unique, staged, trimmed
from framelark.llm.graph import components

SEED = 42
BITS = 64
#: Shingles hashed at once: bounds the unpacked bit matrix of a long text.
SHINGLES = 1 << 15
#: Rows of a bucket that one task compares; larger buckets are cut into cells.
CELL = 4096


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of a text, repeats included, some at a time."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return
    if len(parts) < words:
        shingles = [b" ".join(parts)]
    else:
        shingles = [b" ".join(s) for s in zip(*(parts[i:] for i in range(words)), strict=False)]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(shingles), SHINGLES):
        yield np.fromiter((digest(s, SEED) for s in shingles[at : at + SHINGLES]), np.uint64)


def fingerprint(text: str | None, words: int) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; zero without a word."""
    return majority(shingle_hashes(text, words))


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The fingerprint of a text whose shingles have these hashes."""
    total, n = np.zeros(BITS, dtype=np.int64), 0
    for h in hashes:
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
    over = (2 * total > n).astype(np.uint8)
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)``: the signed 64-bit fingerprint of every whole text.

    A-Z are lower-cased, words are runs of other than ASCII white space, and
    repeats of a shingle count.  A text of fewer words is one shingle; a null,
    empty or blank text has fingerprint zero.  Null ids are kept.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(trimmed(run), f"id {kind.simpleString()}, fp bigint")


def bucket_keys(radius: int, blocks: int) -> list:
    """One 64-bit bucket key for every choice of ``blocks - radius`` blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        part = F.col("fp").bitwiseAND(F.lit(signed).cast("bigint"))
        keys.append(F.struct(F.lit(number).alias("t"), part.alias("k")))
    return keys


def _beyond(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is above ``radius``; counters hold bits 1, 2, 4, 8."""
    gt, eq = over.copy(), ~over
    for power in (3, 2, 1, 0):
        bit = counters[power]
        if radius >> power & 1:
            eq &= bit
        else:
            gt |= eq & bit
            eq &= ~bit
    return gt


def near_lanes(
    fps: np.ndarray, first: np.ndarray, end: np.ndarray, radius: int, slice_items: int = 1 << 15
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, lane) at most ``radius`` bits apart, lane in [first, end) of the row.

    ``fps`` are the lanes in order; radius is at most 15.
    """
    n = len(fps)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    words = -(-n // 64)
    lanes = np.zeros((words * 64, BITS), dtype=np.uint8)
    lanes[:n] = bits
    planes = np.ascontiguousarray(np.packbits(lanes.T, axis=1, bitorder="little")).view(np.uint64)
    has = end > first
    rows = np.nonzero(has)[0]
    w0, w1 = first[rows] // 64, (end[rows] - 1) // 64
    count = w1 - w0 + 1
    stop = np.cumsum(count)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    one = np.uint64(1)
    for lo in range(0, int(stop[-1]) if len(stop) else 0, slice_items):
        items = np.arange(lo, min(lo + slice_items, int(stop[-1])))
        at = np.searchsorted(stop, items, side="right")
        row = rows[at]
        word = w0[at] + items - (stop[at] - count[at])
        start = np.clip(first[row] - word * 64, 0, 63).astype(np.uint64)
        left = np.clip(end[row] - word * 64, 1, 64).astype(np.uint64)
        mask = (full << start) & (full >> (np.uint64(64) - left))
        query = fps[row]
        c = [np.zeros(len(row), np.uint64) for _ in range(4)]
        over = np.zeros(len(row), np.uint64)
        for b in range(0, BITS, 3):
            planes_of = [
                planes[j][word] ^ (np.uint64(0) - ((query >> np.uint64(j)) & one))
                for j in range(b, min(b + 3, BITS))
            ]
            x = planes_of[0]
            if len(planes_of) == 3:  # carry-save: three planes give a sum and a carry
                y, z = planes_of[1:]
                u = x ^ y
                low, high = u ^ z, (x & y) | (u & z)
            else:
                low, high = x, np.zeros_like(x)
            carry = c[0] & low
            c[0] = c[0] ^ low
            u = c[1] ^ carry
            four = (c[1] & carry) | (u & high)
            c[1] = u ^ high
            carry = c[2] & four
            c[2] = c[2] ^ four
            over |= c[3] & carry
            c[3] = c[3] ^ carry
            if b % 6 == 3:
                live = (~_beyond(c, over, radius) & mask) != 0
                if live.mean() < 0.75:
                    keep = np.nonzero(live)[0]
                    row, word, query, mask, over = (v[keep] for v in (row, word, query, mask, over))
                    c = [v[keep] for v in c]
                    if not len(keep):
                        break
        if not len(row):
            continue
        near = ~_beyond(c, over, radius) & mask
        keep = np.nonzero(near)[0]
        for part in range(0, len(keep), 4096):
            k = keep[part : part + 4096]
            hit = np.unpackbits(
                near[k].view(np.uint8).reshape(len(k), 8), axis=1, bitorder="little"
            )
            i, lane = np.nonzero(hit)
            yield row[k][i], word[k][i] * 64 + lane


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the trees of ``a`` and ``b`` in place, roots being the smallest."""
    while len(a):
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        if not len(a):
            return
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _link(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, ["t", "k", "lo", "hi"], 1 << 14):
            cols = [t.column(c).to_numpy() for c in ("t", "k", "lo", "hi", "c")]
            fps = t.column("fp").to_numpy().view(np.uint64)
            n = len(fps)
            new = np.ones(n, bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:4]])
            starts = np.nonzero(new)[0]
            ends = np.append(starts[1:], n)
            group = np.cumsum(new) - 1
            end = ends[group]
            first = np.arange(1, n + 1)
            lo, hi, c = cols[2:]
            cross = lo != hi
            if cross.any():  # rows of the first chunk meet the lanes of the second
                inner = np.add.reduceat((c == lo).astype(np.int64), starts)
                first = np.where(cross, (starts + inner)[group], first)
                end = np.where(cross & (c != lo), first, end)
            parent = np.arange(n)
            for a, b in near_lanes(fps, first, end, radius):
                union(parent, a, b)
            moved = np.nonzero(parent != np.arange(n))[0]
            signed = fps.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[parent[moved]])], ["a", "b"])

    return trimmed(run)


def links(distinct: DataFrame, radius: int, blocks: int, cell: int = CELL) -> DataFrame:
    """Edges ``(a, b)`` that connect the distinct ``fp`` within ``radius`` bits.

    Each cell of a bucket gives a spanning forest of its links, never all
    pairs.  A bucket of more than ``cell`` rows is dealt as chunk pairs over as
    many tasks as it needs, and the few largest get their size by broadcast, so
    no task ever holds one of them.
    """
    keyed = distinct.select("fp", F.explode(F.array(*bucket_keys(radius, blocks))).alias("s"))
    keyed = keyed.select("fp", "s.t", "s.k")
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("count")).where("count > 1")
    dealt = join_unique(keyed, sizes, ["t", "k"], "count", distinct.count()).withColumn(
        "n", F.ceil(F.col("count") / F.lit(cell)).cast("int")
    )
    dealt = dealt.withColumn("c", F.pmod(F.xxhash64("fp", "t"), F.col("n")).cast("int"))
    cells = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda j: F.struct(F.least("c", j).alias("lo"), F.greatest("c", j).alias("hi")),
    )
    dealt = dealt.select("t", "k", "c", "fp", F.explode(cells).alias("p"))
    dealt = dealt.select("t", "k", "p.lo", "p.hi", "c", "fp").repartition("t", "k", "lo", "hi")
    ordered = dealt.sortWithinPartitions("t", "k", "lo", "hi", "c")
    ends = ordered.mapInArrow(_link(radius), "a bigint, b bigint")
    return ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    words: int = 4,
    radius: int = 4,
    blocks: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, fp, component)`` for every row: one class per linked fingerprints.

    ``component`` is the smallest id reachable over links of at most ``radius``
    differing bits; copies (equal fingerprints) are compared once.  Null ids
    are kept, and are a component's name only where it has no other (null).
    Repeated rows give equal rows.  An empty table gives an empty result; other
    columns are not looked at.
    """
    if not 0 <= radius <= 15 or blocks <= radius:
        raise ValueError("radius must be 0 to 15 and below blocks")
    prints = staged(fingerprints(docs, words, id_col, text_col))
    distinct = staged(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    named = components(links(distinct.select("fp"), radius, blocks))
    rooted = distinct.join(named.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", "n", F.coalesce("label", "fp").alias("label")
    )
    rooted = staged(rooted)
    best = rooted.groupBy("label").agg(F.min("least").alias("component"), F.count("*").alias("m"))
    classes = join_unique(rooted, best, ["label"], "m", rooted.count()).select("fp", "n", "component")
    return join_unique(prints, classes, ["fp"], "n", prints.count()).select("id", "fp", "component")


def representatives(
    docs: DataFrame,
    words: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = 0.8,
) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each near-duplicate group does.

    A group is linked by at least ``similarity`` of the shingles in common:
    fingerprints within 7 bits propose links, which are confirmed on the whole
    sets, and an exact search adds those that fingerprints miss (see ``jaccard``).
    Of a group the document of the smallest id stays; a null id counts as the
    largest, and different texts of one id are ordered by their hash.  Rows that
    repeat id and text are copies too: one of them stays, whatever its other
    columns hold.
    """
    from framelark.llm import jaccard

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.struct(
        F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.sha2(text.cast("binary"), 256).alias("sha")
    )
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("key"), text.alias("text"))
    found = jaccard.near_duplicates(rows, words, similarity, "key", "text").where(F.col("id") == F.col("component"))
    counted = staged(found.groupBy(F.col("id").alias("k")).agg(F.count("*").alias("n")))
    same = (F.col("key.sha") == F.col("k.sha")) & F.col("key.id").eqNullSafe(F.col("k.id"))
    stay = rows.join(counted.select("k"), same, "left_semi")
    if not counted.where("n > 1").isEmpty():
        stay = stay.dropDuplicates(["key"])
    return stay.select("row.*")
