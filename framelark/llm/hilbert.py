"""Shards as runs along a Hilbert curve over document metadata.

Several dimensions are quantised to a few bits by their rank, each document gets its index
on the curve through that grid, and the order along the curve is cut into runs
of equal row counts, so that a shard covers a compact box of every dimension
and shards can be skipped on any of them (``ranges``, ``write_shards``).  Built
from DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelark.llm._spark import forget, staged


def curve(spark: SparkSession, dims: int, bits: int) -> DataFrame:
    """The cells of the curve in order: ``(h, x0, x1, ...)``; 2 ** (dims * bits) rows.

    Skilling's transform (AIP Conf. Proc. 707, 2004) from index to axes.
    """
    index = F.col("id").cast("int")

    def spread(i: int) -> Column:
        out = F.lit(0)
        for b in range(bits):
            out = out.bitwiseOR(
                F.shiftleft(F.shiftright(index, b * dims + dims - 1 - i).bitwiseAND(F.lit(1)), b)
            )
        return out

    plain = F.array(*[spread(i) for i in range(dims)])
    gray = F.transform(
        F.col("x"),
        lambda v, i: F.when(i == 0, v.bitwiseXOR(F.shiftright(F.col("x")[dims - 1], 1))).otherwise(
            v.bitwiseXOR(F.element_at("x", F.greatest(i, F.lit(1))))
        ),
    )
    steps = F.array(
        *[
            F.struct(F.lit(1 << q).alias("q"), F.lit(i).alias("i"))
            for q in range(1, bits)
            for i in reversed(range(dims))
        ]
    )

    def undo(x: Column, s: Column) -> Column:
        first, own, low = x[0], F.element_at(x, s["i"] + 1), s["q"] - 1
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        return F.transform(
            x,
            lambda v, j: F.when(
                own.bitwiseAND(s["q"]) != 0, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v)
            ).otherwise(F.when((j == 0) | (j == s["i"]), F.when(s["i"] == 0, v).otherwise(v.bitwiseXOR(swap))).otherwise(v)),
        )

    cells = spark.range(1 << (dims * bits)).withColumn("x", plain).withColumn("x", gray)
    cells = cells.withColumn("x", F.aggregate(steps, F.col("x"), undo))
    return cells.select(
        F.col("id").alias("h"), *[F.element_at("x", i + 1).alias(f"x{i}") for i in range(dims)]
    )


def cuts(docs: DataFrame, value: Column, levels: int) -> list[tuple[int, str]]:
    """(level, value), in order, of the values from which on another of ``levels`` equal shares of the rows begins.

    Exact, from counts by value: these are ordered by ranges, summed by range,
    and only the cuts (below ``levels``) come to the driver.
    """
    counts = docs.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    ranged = staged(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum("n").alias("m"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = sums.select("part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"), F.sum("m").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    level = F.floor(first * levels / F.col("total"))
    starts = ranged.join(F.broadcast(sums), "part").select("value", level.alias("level")).groupBy("level").agg(F.min("value").alias("value"))
    found = sorted((r["level"], r["value"]) for r in starts.collect())
    forget(ranged)
    return [c for c in found if c[0]]


def shard(
    docs: DataFrame,
    shards: int = 8,
    bits: int = 5,
    categories: tuple[str, ...] = ("lang", "source"),
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 256,
) -> DataFrame:
    """``(row, id, size, text_crc32, h, shard, slot)`` for every row, by row counts.

    ``row`` is the whole row as a struct, so no column of it can clash; it costs
    nothing where it is not used.  ``size`` is the UTF-8 length plus one (null
    text: one).  The dimensions are the ``categories`` (by the order of their
    values, in levels of about equal counts; null comes first) and the size (by
    its quantiles), over all rows, so that a run of the curve holds few values
    of each.  Counts of the shards differ by at most one; ``slot`` runs from 0
    without gaps.  Rows of one curve cell follow each other by a hash, then by
    id; null ids and repeated rows are rows like any other.  An empty table
    gives none.

    No task needs the rows of a whole cell: ranks are prefix sums of counts by
    (cell, salt), of which there are at most 2 ** (dims * bits) * ``salts``.
    """
    spark, dims = docs.sparkSession, len(categories) + 1
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    levels = 1 << bits
    named = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in categories]
    size = (F.octet_length(text) + 1).cast("bigint")
    marks = [i / levels for i in range(1, levels)]
    total, quantiles = docs.agg(F.count("*"), F.percentile_approx(size, F.array(*map(F.lit, marks)), 10000)).first()

    def level(v: Column, at: list[tuple], below: int = 0) -> Column:
        """The level of the last cut that the value has reached, by halving, so that long lists stay cheap."""
        if not at:
            return F.lit(below)
        mid = len(at) // 2
        reached, value = at[mid]
        return F.when(v < F.lit(value), level(v, at[:mid], below)).otherwise(level(v, at[mid + 1 :], reached))

    found = [level(v, cuts(docs, v, levels)) for v in named]
    last = {q + 1: i for i, q in enumerate(quantiles or [], 1)}  # of equal quantiles the last
    found.append(level(size, [(i, q) for q, i in sorted(last.items())]))
    facts = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.col(id_col).alias("id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[x.cast("int").alias(f"x{i}") for i, x in enumerate(found)],
    )
    facts = facts.join(F.broadcast(curve(spark, dims, bits)), [f"x{i}" for i in range(dims)])
    facts = facts.withColumn("salt", F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(salts)).cast("int"))
    counts = staged(facts.groupBy("h", "salt").agg(F.count("*").alias("n")))
    before = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)  # bounded: cells
    cells = counts.groupBy("h").agg(F.sum("n").alias("m"))
    cells = cells.select("h", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("cell_base"))
    inside = Window.partitionBy("h").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("h", "salt", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("salt_base"))
    bases = bases.join(cells, "h").select("h", "salt", (F.col("cell_base") + F.col("salt_base")).alias("base"))
    order = Window.partitionBy("h", "salt").orderBy("id", "size", "text_crc32")
    rank = F.col("base") + F.row_number().over(order) - 1
    ranked = facts.join(bases, ["h", "salt"]).withColumn("rank", rank)
    exact = F.expr(f"(rank * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        ranked.withColumn("shard", exact.cast("int"))
        .withColumn("slot", F.col("rank") - first)
        .select("row", "id", "size", "text_crc32", "h", "shard", "slot")
    )


def ranges(dealt: DataFrame, dimensions: tuple[str, ...] = ("lang", "source", "n_chars")) -> DataFrame:
    """``(shard, n_rows, bytes, min_x, max_x, nulls_x, ...)``: what a reader needs to skip shards.

    ``dimensions`` are columns of the rows.
    """
    own = [F.col("row")[c] for c in dimensions]
    figures = [f(c).alias(f"{n}_{name}") for name, c in zip(dimensions, own, strict=True) for n, f in (("min", F.min), ("max", F.max))]
    nulls = [F.count_if(c.isNull()).alias(f"nulls_{name}") for name, c in zip(dimensions, own, strict=True)]
    return dealt.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("bytes"), *figures, *nulls)


def write_shards(dealt: DataFrame, folder: str, dimensions: tuple[str, ...] = ("lang", "source", "n_chars"), files: int = 4) -> None:
    """Write the rows as Parquet, a folder ``_shard=k`` each, and the shards' ranges under ``_ranges``.

    Each shard is written as ``files`` runs of its slots, in order, so that the
    files' own statistics are narrow too.
    """
    most = dealt.groupBy("shard").agg((F.max("slot") + 1).alias("rows"))
    runs = dealt.join(F.broadcast(most), "shard").withColumn("run", F.expr(f"(slot * {files}) div rows"))  # a row a shard
    runs = runs.select("row", "shard", "run", "slot").repartition("shard", "run").sortWithinPartitions("shard", "run", "slot")
    runs.select("row.*", F.col("shard").alias("_shard")).write.mode("overwrite").partitionBy("_shard").parquet(folder)
    ranges(dealt, dimensions).write.mode("overwrite").parquet(f"{folder}/_ranges")
