"""Exact removal of repeated byte strings with suffix arrays.

A byte goes if a string of ``width`` bytes that covers it also starts earlier
in the corpus.  The corpus is never sorted as a whole:

1. Winnowing picks anchors: the smallest hash among the ``GRAM``-byte grams of
   every ``width``-byte window.  Equal windows pick the same gram at the same
   place, so a window can only repeat if its anchor does.
2. Anchors that occur once are dropped.  Every window that is left belongs to
   one anchor, and the stretch of text that an anchor's windows cover goes,
   keyed by the anchor's hash, to one block; equal windows meet in a block.
3. A block's suffix array is made by two-stage sorting: suffixes smaller than
   their successor are sorted directly, the others are induced by scanning the
   buckets in order.  Common prefixes of neighbours give the classes of equal
   windows; all but the earliest of a class are marked.

Stretches with one very frequent anchor are dealt over several blocks; the
earliest window of each class of such a block meets those of the others under
a 128-bit hash of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from framelark.llm._spark import forget, groups_of, join_unique, release, shuffles_removed, staged, trimmed

GRAM = 32
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bytes whose anchors are found at once, and anchors sent at once.
CHUNK, FLUSH = 1 << 20, 600_000
#: Anchors of one bucket, and stretches and bytes of one block, and stretches of one anchor in a block.
BUCKET, BLOCK, BLOCK_BYTES, HOT = 200_000, 12_000, 1_500_000, 10_000
#: Frequent anchors that are broadcast (a few MB); with more of them, tasks that the anchors of one hash are dealt to when they are joined.
FEW, SALTS = 100_000, 64
#: The id of rows without one, which come last; ties tell them from a document of that id.
LAST = 2**63 - 1


# --- suffix arrays -----------------------------------------------------------


def words_at(text: np.ndarray, beyond: int) -> np.ndarray:
    """The 8 bytes from every position as a big-endian number; zeros follow the end."""
    k = np.zeros(len(text) + beyond + 16, dtype=np.uint64)
    k[: len(text)] = text
    for step in (1, 2, 4):
        k[:-step] = (k[:-step] << np.uint64(8 * step)) | k[step:]
    return k


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Positions whose suffix is smaller than the one after it."""
    n = len(text)
    up = np.zeros(n, dtype=bool)
    if n < 2:
        return up
    change = np.nonzero(text[1:] != text[:-1])[0]
    if len(change):
        at = np.searchsorted(change, np.arange(change[-1] + 1))
        rise = text[change + 1] > text[change]
        up[: change[-1] + 1] = rise[at]
    return up


def sort_directly(k: np.ndarray, positions: np.ndarray, depth: int) -> np.ndarray:
    """Order positions by the ``depth`` bytes that follow; ties stay in any order."""
    order = positions[np.argsort(k[positions])]
    if len(order) < 2:
        return order
    key = k[order]
    same = np.empty(len(order), dtype=bool)
    same[0], same[1:] = False, key[1:] == key[:-1]
    for at in range(8, depth, 8):
        tied = same.copy()
        tied[:-1] |= same[1:]
        slots = np.nonzero(tied)[0]
        if not len(slots):
            break
        group = np.cumsum(~same[slots])
        key = k[order[slots] + at]
        rank, first = np.empty(len(slots), dtype=np.int64), np.argsort(key)  # two plain sorts are faster than a stable one
        rank[first] = np.cumsum(np.append(True, np.diff(key[first]) != 0))
        by = np.argsort(group * (len(slots) + 1) + rank)
        order[slots] = order[slots[by]]
        key = key[by]
        differs = np.ones(len(slots), dtype=bool)
        differs[1:] = key[1:] != key[:-1]
        same[slots] &= ~differs
    return order


def suffix_array(text: np.ndarray, depth: int, k: np.ndarray | None = None) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes, by two-stage sorting."""
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    k = words_at(text, depth) if k is None else k
    direct = sort_directly(k, np.nonzero(smaller_than_next(text))[0], depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[n - 1]].append(np.array([n - 1]))  # the empty suffix comes first
    out = []
    for c in range(256):
        wave = np.concatenate(induced[c]) if induced[c] else np.zeros(0, dtype=np.int64)
        whole = []
        while len(wave):  # runs of one byte: each wave puts one more byte before the last
            whole.append(wave)
            wave = wave[wave > 0] - 1
            wave = wave[text[wave] == c]
        bucket = np.concatenate([*whole, direct[bounds[c] : bounds[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = text[before]
        larger = first > c
        before, first = before[larger], first[larger]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        cuts = np.nonzero(np.diff(first))[0] + 1
        for part in np.split(before, cuts):
            if len(part):
                induced[text[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(k: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Equal leading bytes of the suffixes at ``a`` and ``b``, up to ``depth``."""
    length = np.zeros(len(a), dtype=np.int64)
    live = np.arange(len(a))
    for at in range(0, depth, 8):
        differ = k[a[live] + at] ^ k[b[live] + at]
        equal = differ == 0
        length[live[equal]] += 8
        off = live[~equal]
        d = differ[~equal]
        for byte in range(7):
            same = d >> np.uint64(8 * (7 - byte)) == 0
            length[off[same]] += 1
        live = live[equal]
        if not len(live):
            break
    return np.minimum(length, depth)


# --- anchors -----------------------------------------------------------------


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A mixed polynomial hash of the ``GRAM`` bytes from every position."""
    h = text.astype(np.uint64) + np.uint64(1)
    size, power = 1, BASE
    while size < GRAM:
        h = h[:-size] * power + h[size:]
        power = power * power
        size *= 2
    h ^= h >> np.uint64(32)
    h *= MIX
    h ^= h >> np.uint64(29)
    return h


def slide(values: np.ndarray, size: int, best) -> np.ndarray:
    """``best`` over every run of ``size`` values."""
    have = 1
    while have * 2 <= size:
        values = best(values[:-have], values[have:])
        have *= 2
    return best(values[: len(values) - (size - have)], values[size - have :]) if size > have else values


def anchors(text: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of concatenated texts that end at ``ends``."""
    n, grams = len(text), width - GRAM + 1
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = gram_hashes(text)
    least = slide(h, grams, np.minimum)
    inside = np.ones(n, dtype=bool)  # windows that no border cuts
    for end in ends:
        inside[max(0, end - width + 1) : end] = False
    least[~inside[: len(least)]] = 0
    pad = np.zeros(grams - 1, dtype=np.uint64)
    held = slide(np.concatenate([pad, least, pad]), grams, np.maximum)[: len(h)]
    chosen = np.nonzero((held == h) & (h != 0))[0]
    return chosen, h[chosen]


def _planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that the shuffle's compression finds them."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def _values(raw: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind)[:, 0]


FIELDS = (("hash", np.uint64), ("id", np.int64), ("tie", np.int64), ("pos", np.int32), ("known", np.uint8))


def _pack(rows: list[np.ndarray]) -> bytes:
    return b"".join(_planes(np.ascontiguousarray(r)) for r in rows)


def _unpack(raw: bytes) -> list[np.ndarray]:
    each = sum(np.dtype(t).itemsize for _, t in FIELDS)
    n, at, out = len(raw) // each, 0, []
    for _, t in FIELDS:
        size = n * np.dtype(t).itemsize
        out.append(_values(raw[at : at + size], n, t))
        at += size
    return out


def _find_anchors(width: int, buckets: int):
    """(id, tie, text) -> (bucket, kind, rows): kind 1 holds anchors known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, flushed = TaskContext.get().partitionId(), 0
        held: list[list[np.ndarray]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, count, flushed
            h, i, t, p = (np.concatenate(c) for c in zip(*held, strict=True))
            by = np.argsort(h)
            h, i, t, p = h[by], i[by], t[by], p[by]
            new = np.ones(len(h), dtype=bool)
            new[1:] = h[1:] != h[:-1]
            start = np.nonzero(new)[0]
            many = np.diff(np.append(start, len(h))) > 1
            repeat = np.repeat(many, np.diff(np.append(start, len(h))))
            out: list[tuple[int, int, bytes]] = []
            if repeat.any():
                one = np.ones(int(repeat.sum()), np.uint8)
                rows = _pack([h[repeat], i[repeat], t[repeat], p[repeat], one])
                out.append(((task * 7919 + flushed) % buckets, 1, rows))
            h, i, t, p, known = h[start], i[start], t[start], p[start], many.astype(np.uint8)
            bucket = h % np.uint64(buckets)
            by = np.argsort(bucket, kind="stable")
            bucket = bucket[by]
            cuts = np.append(0, np.nonzero(np.diff(bucket))[0] + 1)
            for lo, hi in zip(cuts, np.append(cuts[1:], len(by)), strict=True):
                s = by[lo:hi]
                out.append((int(bucket[lo]), 0, _pack([h[s], i[s], t[s], p[s], known[s]])))
            held, count, flushed = [], 0, flushed + 1
            b, k, r = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(r, pa.binary())],
                ["bucket", "kind", "rows"],
            )

        def add(raws: list[bytes], ids: list[int], ties: list[int]) -> None:
            nonlocal count
            text = np.frombuffer(b"".join(raws), np.uint8)
            ends = np.cumsum([len(r) for r in raws])
            at, h = anchors(text, ends, width)
            doc = np.searchsorted(ends, at, side="right")
            base = np.append(0, ends)[doc]
            held.append([h, np.array(ids, np.int64)[doc], np.array(ties, np.int64)[doc], (at - base).astype(np.int32)])
            count += len(at)

        for batch in batches:
            raws, ids, ties, size = [], [], [], 0
            for i, t, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = x.encode("utf-8", "surrogatepass")
                raws.append(raw)
                ids.append(i)
                ties.append(t)
                size += len(raw)
                if size >= CHUNK:
                    add(raws, ids, ties)
                    raws, ids, ties, size = [], [], [], 0
            if raws:
                add(raws, ids, ties)
            if count >= FLUSH:
                yield flush()
                release()
        if count:
            yield flush()

    return trimmed(run)


@trimmed
def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, kind, rows) sorted by bucket -> anchors whose hash occurs again."""

    def batch_of(rows: list[np.ndarray]) -> pa.RecordBatch:
        h, i, t, p, _ = rows
        return pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(i), pa.array(t), pa.array(p)], ["hash", "id", "tie", "pos"]
        )

    def matched(parts: list[bytes]) -> pa.RecordBatch:
        rows = [np.concatenate(c) for c in zip(*map(_unpack, parts), strict=True)]
        by = np.argsort(rows[0])
        rows = [r[by] for r in rows]
        same = rows[0][1:] == rows[0][:-1]
        keep = np.zeros(len(by), dtype=bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep &= rows[4] == 0
        return batch_of([r[keep] for r in rows])

    now, parts = None, []
    for batch in batches:
        for bucket, kind, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind:
                yield batch_of(_unpack(raw))
                continue
            if bucket != now and parts:
                yield matched(parts)
                parts = []
            now = bucket
            parts.append(raw)
    if parts:
        yield matched(parts)


# --- blocks ------------------------------------------------------------------


def owned(pos: list[int], hashes: list[int], n: int, width: int) -> list[tuple[int, int]]:
    """For each anchor (by position) the window starts whose smallest anchor it is."""
    grams = width - GRAM + 1
    lows, highs, stack = [], [n - width] * len(pos), []
    for i, (p, h) in enumerate(zip(pos, hashes, strict=True)):
        while stack and hashes[stack[-1]] > h:
            j = stack.pop()
            highs[j] = min(highs[j], p - grams)
        lows.append(max(0, p - grams + 1, pos[stack[-1]] + 1 if stack else 0))
        stack.append(i)
    return [(lo, min(hi, p)) for lo, hi, p in zip(lows, highs, pos, strict=True)]


def _stretches(width: int):
    """(id, tie, text, found) -> the text that each repeated anchor's windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for i, t, x, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = x.encode("utf-8", "surrogatepass")
                found = sorted({(f["pos"], f["hash"] & (2**64 - 1), f["cell"]) for f in found})
                spans = owned([f[0] for f in found], [f[1] for f in found], len(raw), width)
                for (_, h, cell), (lo, hi) in zip(found, spans, strict=True):
                    if lo > hi:
                        continue
                    row = (h - (1 << 64) if h >> 63 else h, cell, i, t, lo, raw[lo : hi + width])
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                ["hash", "cell", "id", "tie", "lo", "bytes"],
            )

    return trimmed(run)


def repeats(spans: list[bytes], ids, ties, lows, cells, width: int):
    """Marks and open classes of one block of stretches.

    Returns ``(row, start, end)`` arrays of marked bytes, as rows of the input
    and places in their texts, and for stretches dealt over several cells
    ``(row, start, h1, h2)`` of the earliest window of every class.
    """
    entry = pa.array(spans, pa.binary()).dictionary_encode()
    code = entry.indices.to_numpy()
    texts = entry.dictionary
    by = np.lexsort((lows, ties, ids, code))  # the earliest copy of a stretch stands for all
    head = np.ones(len(by), dtype=bool)
    head[1:] = code[by][1:] != code[by][:-1]
    best = np.zeros(len(texts), dtype=np.int64)
    best[code[by[head]]] = by[head]
    copies = by[~head]
    other = best[code[copies]]  # but a repeated row is the same document
    copies = copies[(ids[copies] != ids[other]) | (ties[copies] != ties[other]) | (lows[copies] != lows[other])]
    size = np.array([len(s) for s in spans], dtype=np.int64)
    marks = [(copies, lows[copies], lows[copies] + size[copies])]

    length = size[best]
    start = np.append(0, np.cumsum(length))
    text = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
    k = words_at(text, width)
    sa = suffix_array(text, width, k)
    owner_all = np.repeat(np.arange(len(best)), length)
    offset_all = np.arange(len(text)) - np.repeat(start[:-1], length)
    window = offset_all <= np.repeat(length, length) - width
    sa = sa[window[sa]]
    lcp = common_prefixes(k, sa[:-1], sa[1:], width)
    first = np.append(True, lcp < width)
    group = np.cumsum(first) - 1
    owner, offset = owner_all[sa], offset_all[sa]
    row = best[owner]
    place = lows[row] + offset
    docs = np.lexsort((ties[best], ids[best]))
    rank = np.zeros(len(best), dtype=np.int64)
    change = np.ones(len(best), dtype=bool)
    change[1:] = (ids[best[docs]][1:] != ids[best[docs]][:-1]) | (ties[best[docs]][1:] != ties[best[docs]][:-1])
    rank[docs] = np.cumsum(change)
    order = (rank[owner] << 32) + place
    least = np.minimum.reduceat(order, np.nonzero(first)[0])
    later = order != least[group]
    at = np.sort(sa[later])  # neighbouring marked windows of a stretch become one mark
    if len(at):
        o, f = owner_all[at], offset_all[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (o[1:] != o[:-1])
        s = np.nonzero(new)[0]
        e = np.append(s[1:], len(at)) - 1
        r = best[o[s]]
        marks.append((r, lows[r] + f[s], lows[r] + f[e] + width))
    open_ = ~later & (cells[row] >= 0)
    w = sa[open_]
    h = np.zeros((2, len(w)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j, a in enumerate([*range(0, width - 8, 8), width - 8]):
            for m in (0, 1):
                x = (k[w + a] ^ (h[m] >> np.uint64(31))) * (MIX + np.uint64(2 * j + 1000 * m))
                h[m] = h[m] * BASE + (x ^ (x >> np.uint64(29)))
    return [np.concatenate(c) for c in zip(*marks, strict=True)], (row[open_], place[open_], h[0], h[1])


def _blocks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, ["hash", "cell"], BLOCK, BLOCK_BYTES):
            ids, ties, lows, cells = (t.column(c).to_numpy().astype(np.int64) for c in ("id", "tie", "lo", "cell"))
            spans = t.column("bytes").to_pylist()
            (row, start, end), (orow, oplace, h1, h2) = repeats(spans, ids, ties, lows, cells, width)
            both = np.concatenate([row, orow])
            none = np.zeros(len(row), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[both]),
                    pa.array(ties[both]),
                    pa.array(np.concatenate([start, oplace])),
                    pa.array(np.concatenate([end, oplace + width])),
                    pa.array(np.concatenate([none, h1.view(np.int64)])),
                    pa.array(np.concatenate([none, h2.view(np.int64)])),
                    pa.array(np.concatenate([np.ones(len(row), bool), np.zeros(len(orow), bool)])),
                ],
                ["id", "tie", "start", "end", "h1", "h2", "sure"],
            )
            release()

    return run


# --- the operator ------------------------------------------------------------


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, none, text): null ids are ``none`` and come last."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be of an integer type")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.col(id_col).cast("bigint")
    return docs.select(F.coalesce(key, F.lit(LAST)).alias("id"), key.isNull().alias("none"), text.alias("text"))


def _tie(tied: bool, none: Column, text: Column) -> Column:
    """Parts different texts of one id; not below zero only for rows without an id, if there are any."""
    if not tied:
        return F.lit(0).cast("bigint")
    half = F.shiftrightunsigned(F.xxhash64(text), 1)
    return F.when(none, half).otherwise(-1 - half)


def _facts(docs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """The documents with ``tie``, their staged (id, tie, n_bytes, sha), and whether ids repeat or are missing."""
    facts = staged(
        docs.select(
            "id",
            "none",
            _tie(True, F.col("none"), F.col("text")).alias("tie"),
            F.octet_length("text").cast("bigint").alias("n_bytes"),
            F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
        )
    )
    tied = not facts.where("none").isEmpty() or not facts.groupBy("id").count().where("count > 1").isEmpty()
    docs = docs.select("id", _tie(tied, F.col("none"), F.col("text")).alias("tie"), "text")
    facts = facts.drop("none")
    return docs, facts if tied else facts.withColumn("tie", F.lit(0).cast("bigint")), tied


def marked(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text"):
    """What to remove: ``(docs, facts, copies, marks, whether ids repeat)``.

    ``copies(id, tie)`` go whole: their text also stands in an earlier document.
    ``marks(id, tie, spans)`` has the byte spans to remove from the others.
    """
    with shuffles_removed(docs.sparkSession):  # a step's shuffles are as large as the texts
        docs, facts, tied = _facts(_documents(docs, id_col, text_col))
        total, rows = facts.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
        buckets = max(32, int(total) * 2 // ((width - GRAM + 2) * BUCKET))
        long = F.col("n_bytes") >= width
        first = F.min(F.struct("id", "tie")).alias("first")
        firsts = facts.where(long).groupBy("sha").agg(first, F.count("*").alias("n")).where("n > 1")
        later = join_unique(facts.where(long), firsts, ["sha"], "n", rows).where(F.struct("id", "tie") > F.col("first"))
        copies = staged(later.select("id", "tie").distinct())

        pool = docs.where(F.octet_length("text") >= width).select("id", "tie", "text")
        packed = pool.mapInArrow(_find_anchors(width, buckets), "bucket int, kind int, rows binary")
        packed = packed.repartition("bucket").sortWithinPartitions("bucket")
        found = staged(packed.mapInArrow(_repeated, "hash bigint, id bigint, tie bigint, pos int"))
        frequent = found.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
        frequent = staged(frequent.select("hash", F.ceil(F.col("n") / HOT).cast("int").alias("m")))
        if frequent.count() <= FEW:  # the anchors stay where they are
            sized = found.join(F.broadcast(frequent), "hash", "left")
        else:
            every = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            salted = found.withColumn("salt", F.pmod(F.xxhash64("id", "pos"), F.lit(SALTS)).cast("int"))
            sized = salted.join(every.hint("merge"), ["hash", "salt"], "left")
        cell = F.when(F.col("m").isNull(), -1).otherwise(F.pmod(F.xxhash64("pos", "id", "tie"), F.col("m"))).cast("int")
        keys = ["id", "tie"] if tied else ["id"]  # a constant key is left out of the join, and the lists would be dealt again
        lists = sized.withColumn("cell", cell).groupBy(*keys).agg(F.collect_list(F.struct("pos", "hash", "cell")).alias("found"))
        lists = lists.join(copies, keys, "left_anti")
        taken = pool.join(lists.hint("shuffle_hash"), keys)
        spread = taken.select("id", "tie", "text", "found").mapInArrow(
            _stretches(width), "hash bigint, cell int, id bigint, tie bigint, lo bigint, bytes binary"
        )
        spread = spread.repartition("hash", "cell").sortWithinPartitions("hash", "cell")
        out = staged(
            spread.mapInArrow(
                _blocks(width),
                "id bigint, tie bigint, start bigint, end bigint, h1 bigint, h2 bigint, sure boolean",
            )
        )
    sure = out.where("sure").select("id", "tie", "start", "end")
    open_ = out.where("not sure").withColumn("at", F.struct("id", "tie", "start"))
    forget(found)
    least = open_.groupBy("h1", "h2").agg(F.min("at").alias("least"), F.count("*").alias("n")).where("n > 1")
    later = open_.join(least, ["h1", "h2"]).where(F.col("at") != F.col("least"))
    marks = sure.union(later.select("id", "tie", "start", "end"))
    marks = marks.groupBy("id", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return docs, facts, copies, marks, tied


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted disjoint runs of bytes; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((s["start"], s["end"]) for s in spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for s, e in runs:
        parts.append(raw[at:s])
        at = e
    return b"".join([*parts, raw[at:]])


@trimmed
def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        out = []
        for text, found in zip(texts, spans, strict=True):
            raw, runs = text.encode("utf-8", "surrogatepass"), merged(found)
            rest = kept(raw, runs)
            out.append((len(raw), len(raw) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
        a, b, c, d, e = zip(*out, strict=True) if out else ([],) * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string()), pa.array(e, pa.string())],
            ["id", "tie", "n_bytes", "n_removed", "n_spans", "sha", "kept"],
        )


APPLIED = "id bigint, tie bigint, n_bytes bigint, n_removed bigint, n_spans bigint, sha string, kept string"


def summary(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row.

    Texts are UTF-8 bytes; a null text is empty.  Rows that repeat both id and
    text are one document and give equal rows; different texts of one id are
    ordered by their hash; a null id comes after all others.  Texts shorter
    than ``width`` stay whole.  An empty table gives an empty result.  Ids must
    be integers, as their order decides; other columns are not looked at.
    """
    documents, facts, copies, marks, tied = marked(docs, width, id_col, text_col)
    cut = documents.select("id", "tie", "text").join(marks.hint("shuffle_hash"), ["id", "tie"])
    done = cut.select("id", "tie", "text", "spans").mapInArrow(_apply, APPLIED).drop("kept")
    with shuffles_removed(docs.sparkSession):
        done = staged(done)
    gone = F.col("copy").isNotNull()
    rest = facts.join(done.select("id", "tie"), ["id", "tie"], "left_anti").join(
        copies.withColumn("copy", F.lit(1)), ["id", "tie"], "left"
    )
    rest = rest.select(
        "id",
        "tie",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"),
        F.when(gone, 1).otherwise(0).cast("bigint").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("sha")).alias("sha"),
    )
    own = F.when(F.col("tie") < 0, F.col("id")) if tied else F.col("id")
    return done.unionByName(rest).select(
        own.alias("id"), "n_bytes", "n_removed", "n_spans", F.col("sha").alias("kept_sha256")
    )


def cleaned(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated bytes taken out of the text; emptied documents go.

    Characters cut in half are dropped with their bytes.  Rows of which nothing
    is removed keep their text as it was, null included.  Ids, ties, repeated
    rows and empty tables are as in ``summary``; the other columns travel with
    their row, whatever their names.
    """
    _, _, copies, marks, tied = marked(docs, width, id_col, text_col)
    flags = marks.withColumn("copy", F.lit(False)).unionByName(
        copies.select("id", "tie", F.expr("cast(null as array<struct<start:bigint,end:bigint>>)").alias("spans"), F.lit(True).alias("copy"))
    )
    text = F.col(text_col).cast("string")
    keyed = docs.select(  # the rows travel as structs, so no column of theirs can clash
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("id"),
        _tie(tied, F.col(id_col).isNull(), F.coalesce(text, F.lit(""))).alias("tie"),
    )
    joined = keyed.join(flags.hint("shuffle_hash"), ["id", "tie"], "left").where(~F.coalesce("copy", F.lit(False)))

    @F.pandas_udf("string")
    def without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, spans in batches:
            yield pd.Series(
                [
                    x if s is None else kept(x.encode("utf-8", "surrogatepass"), merged(s)).decode("utf-8", "ignore")
                    for x, s in zip(text, spans, strict=True)
                ],
                dtype=object,
            )
        release()

    without = without.asNondeterministic()  # else it would run twice, for the filter and for the result
    text = F.col("row")[text_col].cast("string")  # of the row, so that it travels once
    new = F.when(F.col("spans").isNull(), text).otherwise(without(text, F.col("spans")))
    out = joined.withColumn("new", new).where(F.col("spans").isNull() | (F.col("new") != ""))
    return out.select(F.col("row").withField(text_col, F.col("new")).alias("row")).select("row.*")
