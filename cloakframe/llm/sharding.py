"""Shards of equal row counts along a Hilbert curve over quantised metadata."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.session import materialize

BITS = 5
#: A sort key has the curve index, 32 bits of checksum and bits of the id's hash; a cell is its first bits.
ID_BITS = 15
KEY_BITS = 3 * BITS + 32 + ID_BITS
CELL_BITS = 18
#: Ranges beyond this number grow instead.
MAX_RANGES = 1 << 18


def logarithmic(value: Column, per_octave: float = 1.3, bits: int = BITS) -> Column:
    """A non-negative number on a logarithmic scale of 2**bits steps; NULL is 0."""
    step = F.floor(F.log2(F.coalesce(value, F.lit(0)).cast("double") + 1) * per_octave)
    return F.least(step, F.lit(2**bits - 1)).cast("int")


def named(value: Column, bits: int = BITS) -> Column:
    """A step for a name, by its checksum; NULL is 0. Names that meet in a step only share pruning."""
    return F.when(value.isNull(), 0).otherwise(F.crc32(value.cast("string").cast("binary")) % (2**bits - 1) + 1).cast("int")


def hilbert(df: DataFrame, axes: Sequence[Column], name: str, bits: int = BITS) -> DataFrame:
    """``df`` with the Hilbert index of ``axes`` (each in 0 .. 2**bits - 1), in plain integer columns.

    The axes are turned into the transposed index by Skilling's inverse undo and Gray steps. Each step is a projection
    of its own, so that expressions don't grow by substitution.
    """
    x = [f"_x{k}" for k in range(len(axes))]
    kept = df.columns
    df = df.select(*kept, *[a.cast("int").alias(c) for a, c in zip(axes, x, strict=True)])

    def step(**new: Column) -> None:
        nonlocal df
        df = df.select(*kept, *[new.get(c, F.col(c)).alias(c) for c in x])

    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for c in x:
            first, this = F.col(x[0]), F.col(c)
            swap = first.bitwiseXOR(this).bitwiseAND(F.lit(low))
            on = this.bitwiseAND(F.lit(q)) != 0
            new = {x[0]: F.when(on, first.bitwiseXOR(F.lit(low))).otherwise(first.bitwiseXOR(swap))}
            if c != x[0]:
                new[c] = F.when(on, this).otherwise(this.bitwiseXOR(swap))
            step(**new)
        q >>= 1
    for before, c in zip(x, x[1:], strict=False):
        step(**{c: F.col(c).bitwiseXOR(F.col(before))})
    flip = F.lit(0)
    for b in range(1, bits):
        flip = flip.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(F.lit(1 << b)) != 0, (1 << b) - 1).otherwise(0))
    step(**{c: F.col(c).bitwiseXOR(flip) for c in x})
    index = F.lit(0).cast("bigint")
    for b in reversed(range(bits)):
        for c in x:
            index = index * 2 + F.shiftright(F.col(c), b).bitwiseAND(F.lit(1))
    return df.select(*kept, index.alias(name))


def ranges(keys: DataFrame, range_bytes: int) -> tuple[DataFrame, int]:
    """Where each of the rows ``(_key, _size)`` stands: ``(_cell, _bounds, _ranges)``, and the number of rows.

    Ranges of keys hold about ``range_bytes`` of ``_size``. A row's cell is the head of its key; the number of the cell's
    bounds up to the row's key gives, by the map ``_ranges``, its range and the place at which this one begins. Only keys
    are dealt and counted here, so that what belongs to them can be dealt once. There are 2**CELL_BITS cells and MAX_RANGES
    ranges at most, which bounds this table.
    """
    held = keys.agg(F.count("*").alias("n"), F.sum((F.col("_size") + 1).cast("double")).alias("bytes")).first()
    wanted = min(max(math.ceil((held["bytes"] or 0) / range_bytes), 1), MAX_RANGES)
    cell = F.shiftright("_key", KEY_BITS - CELL_BITS)
    bounds = materialize(
        keys.repartitionByRange(wanted, "_key").groupBy(F.spark_partition_id()).agg(F.min("_key").alias("_key")), "bounds")
    own = bounds.groupBy(cell.alias("_at")).agg(F.array_sort(F.collect_list("_key")).alias("_bounds"))
    in_order = Window.orderBy("_cell")
    cells = materialize(
        keys.select(cell.alias("_cell")).distinct().join(own, F.col("_cell") == F.col("_at"), "left")
        .select("_cell", F.coalesce("_bounds", F.array().cast("array<bigint>")).alias("_bounds"))
        .withColumn("_before", F.sum(F.size("_bounds")).over(in_order) - F.size("_bounds")), "cells")
    counts = keys.withColumn("_cell", cell).join(F.broadcast(cells), "_cell").groupBy(
        "_cell", _bounds_up_to("_key").alias("_within")).agg(F.first("_before").alias("_before"), F.count("*").alias("n"))
    upto = Window.orderBy("_cell", "_within").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        counts.withColumn("range", F.col("_before") + F.col("_within")).withColumn("_start", F.sum("n").over(upto) - F.col("n"))
        .withColumn("start", F.min("_start").over(Window.partitionBy("range"))))
    maps = placed.groupBy("_cell").agg(F.map_from_entries(F.collect_list(F.struct("_within", F.struct("range", "start")))).alias("_ranges"))
    return materialize(cells.join(maps, "_cell").select("_cell", "_bounds", "_ranges"), "places"), held["n"]


def _bounds_up_to(key: str) -> Column:
    return F.size(F.filter("_bounds", lambda b: b <= F.col(key)))


def shards(
    docs: DataFrame, n: int = 16, carry: Sequence[str] | None = None, text: str = "text", range_bytes: int = 16 << 20,
) -> DataFrame:
    """``carry`` (default: all columns of ``docs``) with size, text_crc32, law, shard, slot and grown_shard.

    Language, UTF-8 size and number of lines are quantised to 32 steps each and put on a Hilbert curve; rows are sorted
    by curve index, text checksum, a hash of doc_id, size and doc_id and cut into ``n`` runs, so a shard's files cover a
    compact region of the three dimensions. The law is ``rows``: counts of shards differ by one at most. Equal texts of one
    language stand together. ``slot`` numbers a shard's rows from 0; grown_shard is NULL.

    The sort keys alone are dealt into ranges and counted. Whole rows are then dealt by range in one exchange and numbered
    inside it; a range holds ``range_bytes`` or, with more than MAX_RANGES of them, its share of all bytes. Only rows equal
    in text and doc_id can't be parted into several ranges.

    NULL texts count as empty; NULL languages are a step of their own; repeated rows are interchangeable neighbours;
    fewer rows than shards leave shards empty; an empty table gives no rows. Columns named as a result are replaced.
    """
    results = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    keep = [c for c in (docs.columns if carry is None else carry) if c not in results]
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.length(whole) - F.length(F.translate(whole, "\n", ""))
    rows = docs.select(
        *keep, F.col("doc_id").alias("_id"), F.octet_length(whole).cast("bigint").alias("_size"),
        F.crc32(whole.cast("binary")).alias("_crc"), named(F.col("lang")).alias("_lang"), lines.alias("_lines"))
    steps = F.col("_lang") * 2 ** (2 * BITS) + logarithmic(F.col("_size")) * 2**BITS + logarithmic(F.col("_lines"))
    # The curve of all combinations of steps is a table of fixed size, made once.
    axes = [F.shiftright("id", k * BITS).bitwiseAND(F.lit(2**BITS - 1)) for k in (2, 1, 0)]
    curve = materialize(hilbert(docs.sparkSession.range(2 ** (3 * BITS)), axes, "_curve"), "curve")
    curved = rows.withColumn("_steps", steps.cast("bigint")).join(
        F.broadcast(curve.withColumnRenamed("id", "_steps")), "_steps", "left")
    key = F.shiftleft("_curve", KEY_BITS - 3 * BITS).bitwiseOR(F.shiftleft("_crc", ID_BITS)).bitwiseOR(
        F.pmod(F.xxhash64("_id"), F.lit(2**ID_BITS)))
    keyed = curved.withColumn("_key", key)
    places, count = ranges(materialize(keyed.select("_key", "_size"), "keys"), range_bytes)
    cell = F.shiftright("_key", KEY_BITS - CELL_BITS)
    placed = keyed.withColumn("_cell", cell).join(F.broadcast(places), "_cell", "left").withColumn(
        "_place", F.col("_ranges")[_bounds_up_to("_key")]).select(
        *keep, "_id", "_size", "_crc", "_key", F.col("_place.range").alias("_range"), F.col("_place.start").alias("_start"))
    inside = Window.partitionBy("_range").orderBy("_key", "_size", "_id")
    ranked = placed.withColumn("_rank", F.col("_start") + F.row_number().over(inside) - 1)
    return ranked.withColumn("_shard", F.expr(f"(_rank * {n}) div {max(count, 1)}")).select(
        *keep, (F.col("_size") + 1).alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_rank") - F.expr(f"(_shard * {max(count, 1)} + {n - 1}) div {n}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
