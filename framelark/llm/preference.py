"""Preference formatting of paired conversations.

The two conversations of a pair, chosen and rejected, are compared turn by
turn.  The turns before the first difference are the prompt, given once; what
follows on either side is its completion, in which only the assistant's turns
are trained on.  ``preferences`` gives a row per turn, ``paired`` one record per
pair.  Built from DataFrame functions only; no conversation of unbounded length
is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelark.llm._spark import HEAVY_LEAST, HEAVY_SHARE, staged


def rendered(role: Column, text: Column) -> Column:
    """One turn as text; a null role or text is empty."""
    none = F.lit("")
    return F.concat(
        F.lit("<|"), F.coalesce(role, none), F.lit("|>\n"), F.coalesce(text, none), F.lit("\n")
    )


def preferences(
    turns: DataFrame,
    pair: Column,
    chosen: Column,
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``(pair_id, part, turn, role, content, train)``: the pairs, a row per turn.

    ``pair`` names the pair of a row and ``chosen`` tells its side.  ``part``
    is prompt, chosen or rejected.  Two sides agree on a turn number if they
    hold the same rows there, repeats counted; the prompt ends before the first
    turn on which they don't.  A side without its partner shares no turn, so
    all of it is completion; sides that agree throughout are all prompt.  A
    null turn comes before all numbers; null roles and texts equal each other;
    rows with a null pair form one pair.  ``train`` is 1 for assistant turns of
    a completion, else 0.

    The first difference is a minimum over counts that are summed on the map
    side.  Pairs that hold more than a thousandth of all rows (there are at most
    a thousand) get it by broadcast, so no task ever holds all rows of one.
    """
    rows = turns.select(
        pair.alias("pair_id"),
        F.coalesce(chosen, F.lit(True)).alias("is_chosen"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("text"),
    ).withColumn("at", F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("n")))
    sides = rows.groupBy("pair_id", "at", "role", F.xxhash64("text").alias("x"), F.sha2("text", 256).alias("y"))
    sides = sides.agg(F.sum(F.when(F.col("is_chosen"), 1).otherwise(-1)).alias("d"), F.count("*").alias("n"))
    ends = sides.groupBy(F.col("pair_id").alias("pair")).agg(F.min(F.when(F.col("d") != 0, F.col("at"))).alias("end"), F.sum("n").alias("n"))
    ends = staged(ends)
    most = max(HEAVY_LEAST, (ends.agg(F.sum("n")).first()[0] or 0) // HEAVY_SHARE)
    same = F.col("pair_id").eqNullSafe(F.col("pair"))
    heavy = F.broadcast(ends.where(F.col("n") > most).select("pair", "end"))  # at most HEAVY_SHARE pairs
    rest = rows.join(heavy, same, "left_anti").join(ends.where(F.col("n") <= most).select("pair", "end"), same)
    marked = rows.join(heavy, same).unionByName(rest)
    shared = F.col("end").isNull() | (F.col("at") < F.col("end"))
    part = F.when(shared, "prompt").when(F.col("is_chosen"), "chosen").otherwise("rejected")
    return marked.where(~shared | F.col("is_chosen")).select(
        "pair_id",
        part.alias("part"),
        "turn",
        "role",
        rendered(F.col("role"), F.col("text")).alias("content"),
        (~shared & F.coalesce(F.col("role") == "assistant", F.lit(False))).cast("int").alias("train"),
    )


def paired(formatted: DataFrame, turns: int = 1000) -> DataFrame:
    """``(pair_id, block, piece, prompt, chosen, rejected)``: the pairs of ``preferences``, a record each.

    ``prompt`` is the text before the completions, once; ``chosen`` and
    ``rejected`` are their turns in order as ``(content, train, times)``:
    ``train`` is the mask, and ``times`` tells how often a turn number holds
    the same row.  A pair with turn numbers from ``turns`` on has a record for
    each ``turns`` of them, by ``block``; records of a block that holds more
    than ``turns`` different rows are told by ``piece``, so a record never has
    more than about ``turns`` entries.  Null turns are in the first block.
    """
    rows = formatted.groupBy(
        "pair_id", F.coalesce(F.expr(f"turn div {turns}"), F.lit(0)).alias("block"), "part", "turn", "content", "train"
    ).agg(F.count("*").alias("times"))
    key = ["pair_id", "block"]
    full = rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 3 * turns)
    full = full.select(F.col("pair_id").alias("p"), F.col("block").alias("b"), F.ceil(F.col("n") / turns).alias("pieces"))
    same = F.col("pair_id").eqNullSafe(F.col("p")) & (F.col("block") == F.col("b"))
    piece = F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("part", "turn", "content"), F.col("pieces")))
    rows = rows.join(full, same, "left").withColumn("piece", piece.cast("int"))
    entry = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "content", "train", "times")
    side = lambda name: F.sort_array(F.collect_list(F.when(F.col("part") == name, entry))).alias(name)
    out = rows.groupBy("pair_id", "block", "piece").agg(side("prompt"), side("chosen"), side("rejected"))
    text = F.array_join(F.transform("prompt", lambda e: F.repeat(e["content"], e["times"].cast("int"))), "")
    masked = lambda c: F.transform(c, lambda e: F.struct(e["content"], e["train"], e["times"])).alias(c)
    return out.select("pair_id", "block", "piece", text.alias("prompt"), masked("chosen"), masked("rejected"))


#: The same for a table ``conversations`` whose even and odd ids are pairs.
SQL = """
WITH r AS (
  SELECT CASE WHEN conv_id >= 0 THEN conv_id // 2 ELSE (conv_id - 1) // 2 END AS pair_id,
         coalesce(conv_id % 2 = 0, true) AS c, turn, role, text, coalesce(turn, -9e18::BIGINT) AS spot
  FROM conversations),
d AS (
  SELECT pair_id, spot, role, text FROM r GROUP BY ALL
  HAVING sum(CASE WHEN c THEN 1 ELSE -1 END) <> 0),
e AS (SELECT pair_id, min(spot) AS stop FROM d GROUP BY pair_id),
m AS (
  SELECT r.*, e.stop IS NULL OR r.spot < e.stop AS shared
  FROM r LEFT JOIN e ON r.pair_id IS NOT DISTINCT FROM e.pair_id)
SELECT pair_id, CASE WHEN shared THEN 'prompt' WHEN c THEN 'chosen' ELSE 'rejected' END AS part,
       turn, role, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS content,
       CASE WHEN NOT shared AND role = 'assistant' THEN 1 ELSE 0 END AS train
FROM m WHERE NOT shared OR c
"""
