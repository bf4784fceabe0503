"""Best-fit-decreasing packing of token pieces into fixed-length sequences.

Pieces have one of ``capacity`` lengths, so pieces of one length are
interchangeable: the packing is decided on the histogram of lengths, whose
size depends on the capacity alone, and then dealt to the pieces by their rank
among those of equal length.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelark.llm._spark import staged

#: Words whose ids a worker remembers: so many of late, and as many from before.
MEMORY = 150_000
#: What no normalisation joins or splits: Latin letters and common signs (no combining marks).
ODD = re.compile("[^\x00-\xff\u2010-\u2027\u2030-\u205e]")
SEPARATORS = re.compile("[\x1c-\x1f]")
LETTERS = re.compile("[a-zà-öø-ÿ]+")
#: Signs behind a word, without the apostrophe: they are a token run of their own.
TAIL = re.compile(r"([!-&(-/:-@\[-`{-~])(?<=[a-zà-öø-ÿ][!-&(-/:-@\[-`{-~])([!-&(-/:-@\[-`{-~]*)(?!\S)")
SPACE = re.compile(r"[ \t-\r]+")
#: Bytes of token ids that a task sends at once.
SENT = 1 << 23


class WordIds(dict):
    """Token ids of a white-space-free chunk as little-endian bytes.

    The tokenizer drops white space and never joins characters across it, so a
    text's ids are the ids of its chunks in order.  The memory has two
    generations: a full one becomes the old one, of which words in use return.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.encode, self.merge = whole.encode, whole.model.tokenize
        self.old: dict[str, bytes] = {}
        # the printable stand-ins of single bytes, as the byte-level step writes them
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        stand_in = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.stand_in = [stand_in[b] for b in range(256)]

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if LETTERS.fullmatch(word):  # one token run, and its own normal form
                raw = word if word.isascii() else "".join(map(self.stand_in.__getitem__, word.encode()))
                found = [t.id for t in self.merge(raw)]
            else:
                found = self.encode(word, add_special_tokens=False).ids if word else []
            ids = struct.pack(f"<{len(found)}I", *found)
            if len(word) > 40:
                return ids
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def text(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" not in text and (text.isascii() or not ODD.search(text)):  # no special token either
            text = TAIL.sub(r" \1\2", text.lower())
        # str.split also cuts at the separators, which are no white space to the tokenizer
        return b"".join(map(self.__getitem__, SPACE.split(text) if SEPARATORS.search(text) else text.split()))


@functools.cache
def word_ids(path: str) -> WordIds:
    """One memory for all tasks of a worker."""
    return WordIds(path)


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str, keep_ids: bool = False
) -> DataFrame:
    """Cut every document into pieces: ``(id, piece, start, length, ids_crc32, task, rank)``.

    A document is its ids and ``end_id``; only one longer than ``capacity`` is
    cut.  ``rank`` counts the pieces of equal length within one task; with
    ``keep_ids`` the pieces carry their ``ids``.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(tokenizer)
        task = TaskContext.get().partitionId()
        seen: Counter = Counter()
        tail = np.array([end_id], "<u4").tobytes()

        def sent(ids: pa.Array, rows: list[tuple], parts: list[bytes]) -> pa.RecordBatch:
            at, piece, start, length, crc, rank = zip(*rows, strict=True)
            cols = [ids.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32())]
            cols += [pa.array(c, pa.int64()) for c in (start, length, crc)]
            cols += [pa.array([task] * len(at), pa.int32()), pa.array(rank, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32", "task", "rank"]
            if keep_ids:
                values = np.frombuffer(b"".join(parts), "<i4")
                ends = np.cumsum([0, *length]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
                names.append("ids")
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            rows, parts, size = [], [], 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = known.text(text) + tail
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    n = len(part) // 4
                    rows.append((i, k // (4 * capacity), k // 4, n, zlib.crc32(part), seen[n]))
                    seen[n] += 1
                    if keep_ids:
                        parts.append(part)
                        size += len(part)
                if size >= SENT:
                    yield sent(batch.column(0), rows, parts)
                    rows, parts, size = [], [], 0
            if rows:
                yield sent(batch.column(0), rows, parts)

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shape = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint"
    return source.mapInArrow(run, shape + ", ids array<int>" * keep_ids)


class OpenBins:
    """A segment tree over remaining capacities; a leaf holds runs of open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = np.zeros(2 * self.size, dtype=np.int64)
        self.runs: dict[int, deque] = defaultdict(deque)

    def _add(self, leaf: int, by: int) -> None:
        node = leaf + self.size
        while node:
            self.any[node] += by
            node //= 2

    def push(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.runs[room].append((first, count))
            self._add(room, 1)

    def pop(self, room: int) -> tuple[int, int]:
        self._add(room, -1)
        return self.runs[room].popleft()

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of at least ``need`` that has a bin."""
        node = need + self.size
        if self.any[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.size:
                    node *= 2
                    if not self.any[node]:
                        node += 1
                return node - self.size
            node //= 2
        return None


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing: ``(length, first_rank, count, first_bin, offset)`` rows.

    Row by row: pieces of that length with ranks ``first_rank + i`` go to bin
    ``first_bin + i`` at ``offset``.  A bin that just took a piece is the
    tightest for the next of equal length as long as that fits, so it is
    filled before the next one.
    """
    bins, opened, plan = OpenBins(capacity), 0, []
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = bins.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, count = opened, -(-left // each)
                opened += count
            else:
                first, count = bins.pop(room)
            each = room // length
            full = min(count, left // each)
            for k in range(each if full else 0):
                plan.append((length, rank, full, first, capacity - room + k * length))
                rank += full
            left -= full * each
            bins.push(room - each * length, first, full)
            first, count = first + full, count - full
            if left and count:
                for k in range(left):
                    plan.append((length, rank, 1, first, capacity - room + k * length))
                    rank += 1
                bins.push(room - left * length, first, 1)
                first, count, left = first + 1, count - 1, 0
            bins.push(room, first, count)
    return plan


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = True,
) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    Returns ``(id, piece, start, length, ids_crc32, sequence_id, offset, ids)``,
    one row per piece: ``ids`` are its tokens, which ``keep_ids=False`` leaves
    out.  A null or empty text is its end id alone; null ids and
    repeated rows are packed like any other row; an empty table gives an empty
    result.  A full piece is a sequence of its own, with a negative number.
    Only the histogram (at most ``capacity`` rows) and the plan it gives, whose
    size depends on the capacity alone, pass the driver.  Only the columns named
    above are used and returned, so others can't clash.
    """
    spark = docs.sparkSession
    cut = staged(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, keep_ids))
    part = cut.where(F.col("length") < capacity)
    counts = part.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        "task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    histogram = {r["length"]: r["n"] for r in part.groupBy("length").agg(F.count("*").alias("n")).collect()}
    names = ["plan_length", "first_rank", "many", "first_bin", "offset"]
    rows = best_fit(histogram, capacity) or [(0, 0, 0, 0, 0)]
    plan = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names))
    place = F.col("base") + F.col("rank")
    dealt = (
        part.join(bases, ["task", "length"])
        .withColumn("place", place)
        .join(
            F.broadcast(plan),
            (F.col("length") == F.col("plan_length"))
            & (F.col("place") >= F.col("first_rank"))
            & (F.col("place") < F.col("first_rank") + F.col("many")),
        )
        .withColumn("sequence_id", F.col("first_bin") + F.col("place") - F.col("first_rank"))
    )
    names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids]
    full = cut.where(F.col("length") == capacity).withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")}
    )
    return dealt.select(*names).unionByName(full.select(*names))
