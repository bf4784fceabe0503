"""Language identification with hyperdimensional n-gram profiles.

Every letter has a random vector of +1 and -1.  A trigram is the product of its
letters' vectors, rotated by their place; a text is the sum of its trigrams'
vectors, a language the sum of its training texts'.  A text gets the language
whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelark.llm._spark import hash_sample, release, trimmed

SIZE = 1024
SEED = 20240
#: Texts whose vectors are made at once, their characters, and the trigrams expanded at once.
BLOCK, CHARACTERS, SLICE = 64, 1 << 19, 8192


@functools.cache
def alphabet() -> np.ndarray:
    """A symbol for each code point of the basic plane: 0 for all but letters."""
    table = np.zeros(1 << 16, dtype=np.uint32)
    for point in range(1 << 16):
        letter = chr(point)
        if letter.isalpha():
            low = ord(letter.lower()[0])
            table[point] = low - 96 if 97 <= low <= 122 else 27 + low % 229
    return table


@functools.cache
def letters() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (256, SIZE))


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    base = letters()
    a, b, c = codes >> 16, codes >> 8 & 255, codes & 255
    return np.roll(base, 2, axis=1)[a] * np.roll(base, 1, axis=1)[b] * base[c]


def trigrams(text: str, at: int = 0, end: int | None = None) -> np.ndarray:
    """The trigram codes around the characters from ``at`` to ``end``; runs of other characters part words."""
    end = len(text) if end is None else end
    near = text[max(0, at - 1) : end + 1].encode("utf-32-le", "surrogatepass")
    symbols = alphabet()[np.minimum(np.frombuffer(near, np.uint32), 0xFFFF)]
    symbols = np.concatenate([[0] * (at == 0), symbols, [0] * (end >= len(text))]).astype(np.uint32)
    codes = symbols[:-2] << 16 | symbols[1:-1] << 8 | symbols[2:]
    return codes[symbols[1:-1] != 0]


def pieces(texts: list[str | None]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(text, trigram codes) in blocks of some texts and characters; long texts come in parts."""
    block, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text or ""), CHARACTERS):
            end = min(at + CHARACTERS, len(text))
            if block and (len(block) == BLOCK or size + end - at > CHARACTERS):
                yield block
                block, size = [], 0
            block.append((i, trigrams(text, at, end)))
            size += end - at
    if block:
        yield block


def vectors(texts: list[str | None]) -> np.ndarray:
    """One row of ``SIZE`` sums for each text; zero for one without letters."""
    out = np.zeros((len(texts), SIZE))
    for block in pieces(texts):
        rows = np.array([i for i, _ in block])
        sizes = [len(c) for _, c in block]
        if not sum(sizes):
            continue
        part = np.repeat(np.arange(len(block), dtype=np.int64), sizes)
        codes = np.concatenate([c for _, c in block]).astype(np.int64)
        pairs, counts = np.unique(codes * BLOCK + part, return_counts=True)  # by code, then by text
        known = np.unique(pairs // BLOCK)
        for lo in range(0, len(known), SLICE):
            own = known[lo : lo + SLICE]
            s = slice(*np.searchsorted(pairs, (own[0] * BLOCK, (own[-1] + 1) * BLOCK)))
            table = np.zeros((len(block), len(own)), dtype=np.float32)
            table[pairs[s] % BLOCK, np.searchsorted(own, pairs[s] // BLOCK)] = counts[s]
            np.add.at(out, rows, (table @ trigram_vectors(own).astype(np.float32)).astype(np.float64))
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1, norm)


@dataclass
class Profiles:
    names: list[str]
    prototypes: np.ndarray  # unit rows

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and cosine (at least 0); ``und`` for a text without letters."""
        v = unit(vectors(texts))
        none = ~v.any(axis=1)
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        cosine = v @ self.prototypes.T
        best = cosine.argmax(axis=1)
        named = [self.names[b] for b in best]
        for i in np.nonzero(none)[0]:
            if not any(c.isalpha() for c in texts[i] or ""):
                named[i] = "und"
        return named, np.clip(cosine.max(axis=1), 0, 1).astype(np.float64)


def learn(rows: DataFrame) -> Profiles:
    """Prototypes from ``(lang, text)`` rows, each text with equal weight.

    Tasks send one sum per language; names are in alphabetical order.  Without
    rows there are no profiles, and every text is ``und``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, v in zip(names, unit(vectors(texts)), strict=True):
                sums[name] = sums.get(name, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
            ["lang", "v"],
        )

    parts = rows.select("lang", "text").mapInArrow(trimmed(run), "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    found = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v")).collect()
    found = sorted((r["lang"], [p["x"] for p in r["v"]]) for r in found)
    names = [n for n, _ in found]
    return Profiles(names, unit(np.array([v for _, v in found])).astype(np.float32) if found else np.zeros((0, SIZE)))


def identify(
    docs: DataFrame,
    usable,
    held_out,
    bound: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``(id, held_out, lang_pred, score)`` for every row.

    Profiles are learned from at most ``bound`` rows that are ``usable`` and
    have a language, chosen by a hash of the id; a prediction looks at the
    whole text alone.  Null texts and those without a letter are ``und`` with
    score 0; null ids are kept; repeated rows give equal rows; an empty table
    gives an empty result; other columns are not looked at.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & usable(F.col(id_col)))
    ids = hash_sample(known.select(F.col(id_col).alias("key")).distinct(), ["key"], bound)
    rows = known.select(F.col(id_col).alias("key"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    profiles = learn(rows.join(F.broadcast(ids), "key"))  # at most ``bound`` ids

    @F.pandas_udf("struct<lang:string,score:double>")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in texts:
            names, scores = profiles.predict(text.tolist())
            yield pd.DataFrame({"lang": names, "score": scores})
        release()

    found = docs.select(F.col(id_col).alias("id"), predict(F.col(text_col).cast("string")).alias("p"))
    return found.select("id", held_out(F.col("id")).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
