"""Hard negatives: for an anchor and each of its nearest rows of the same label, the nearest rows of other labels in a band.

Rows lie in buckets of similar length, each with its coordinates sorted. A score that an anchor looks for and a bucket's
greatest length give the least cosine; the anchor's largest (focus) coordinates then have ranges outside of which no row
reaches it, and only rows inside all ranges are multiplied out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.session import materialize

#: Stands for a missing vec_id, which comes last among ties.
NO_ID = 2**63 - 1
NOTHING = float("-inf")
#: Numbers that a row has in a bucket besides its components.
PER_ROW = 8
INDEX = "bucket int, dim int, low double, high double, item int, vectors binary, labels binary, ids binary, orders binary"
SCORES = "cls bigint, band bigint, score bigint, id bigint"


@dataclass(frozen=True)
class HardNegatives:
    """Parameters.

    Components become floor(``scale`` * x). An anchor has ``positives`` positives; a negative's score is within ``low`` to
    ``high`` percent of the positive's, and ``negatives`` of them are returned. ``focus`` coordinates have ranges. A task
    meets one bucket of about ``bucket_values`` numbers with one block of about ``block_rows`` anchors, and the results of
    equal anchors are dealt in ``shares``.
    """

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: float = 256
    focus: int = 4
    bucket_values: int = 1 << 20
    block_rows: int = 512
    shares: int = 8


# ------------------------------------------------------------------ rows and index


def quantised(embeddings: DataFrame, anchor: Column, p: HardNegatives) -> DataFrame:
    """``(id, label, vector, square, anchor)`` of the rows that take part; ``square`` is the squared length."""
    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = embeddings.where(F.col("label").isNotNull() & x.isNotNull() & whole).select(
        F.coalesce(F.col("vec_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.col("label").cast("bigint").alias("label"),
        F.transform(x, lambda v: F.floor(v.cast("double") * float(p.scale))).alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"))
    square = F.aggregate("vector", F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double"))
    return rows.withColumn("square", square).where(F.col("square") < 2.0**62)


def classes(rows: DataFrame, p: HardNegatives) -> DataFrame:
    """``(label, vector, square, ids)``: equal vectors of one label once, with the smallest ids.

    Equal vectors score alike, so only an anchor's own row and ``positives`` others can ever be returned. They are cut
    off before the shuffle already, so a vector of very many rows costs a few of them for each task.
    """
    first = Window.partitionBy("label", "vector").orderBy("id")
    few = rows.select("id", "label", "vector", "square").withColumn("_place", F.row_number().over(first)).where(
        F.col("_place") <= max(p.positives + 1, p.negatives))
    return few.groupBy("label", "vector").agg(F.first("square").alias("square"), F.array_sort(F.collect_list("id")).alias("ids"))


def smallest(low: int, high: int) -> np.dtype:
    return next(np.dtype(t) for t in ("i2", "i4", "i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and each list's length."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def index(found: DataFrame, buckets: int, p: HardNegatives) -> DataFrame:
    """The buckets, numbered from 0, of ``classes``: dealt by dimension and falling length, with sorted coordinate lists.

    A range that is larger than meant is cut into several records of the same number.
    """

    def record(bucket: int, dim: int, vectors: list[np.ndarray], squares: list[float], labels: list[int], ids: list[np.ndarray]) -> tuple:
        matrix = np.stack(vectors) if dim else np.zeros((len(vectors), 0), dtype=np.int64)
        kind = smallest(int(matrix.min(initial=0)), int(matrix.max(initial=0)))
        lengths = np.sqrt(np.maximum(np.array(squares), 1))
        orders = np.argsort(matrix / lengths[:, None], axis=0, kind="stable").astype("u4").T
        width = max(p.positives + 1, p.negatives)
        padded = np.full((len(ids), width + 1), NO_ID, dtype=np.int64)
        for k, some in enumerate(ids):
            padded[k, 0], padded[k, 1 : len(some) + 1] = len(some), some
        return (bucket, dim, math.sqrt(min(squares)), math.sqrt(max(squares)), kind.itemsize, matrix.astype(kind).tobytes(),
                np.array(labels, dtype=np.int64).tobytes(), padded.tobytes(), np.ascontiguousarray(orders).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = TaskContext.get().partitionId()
        dim, held = -1, ([], [], [], [])

        def out() -> pa.RecordBatch:
            row = record(bucket, dim, *held)
            types = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])

        for batch in batches:
            values, sizes = _numbers(batch.column(1))
            all_ids, counts = _numbers(batch.column(3))
            at, id_at = 0, 0
            for label, size, square, n in zip(batch.column(0).to_pylist(), sizes.tolist(), batch.column(2).to_pylist(), counts.tolist(), strict=True):
                if held[0] and (size != dim or len(held[0]) * (dim + PER_ROW) >= 2 * p.bucket_values):
                    yield out()
                    held = ([], [], [], [])
                dim = size
                for part, value in zip(held, (values[at : at + size], square, label, all_ids[id_at : id_at + n]), strict=True):
                    part.append(value)
                at, id_at = at + size, id_at + n
        if held[0]:
            yield out()

    order = [F.size("vector"), F.desc("square"), F.xxhash64("vector", "label")]
    dealt = found.select("label", "vector", "square", "ids").repartitionByRange(buckets, *order).sortWithinPartitions(*order)
    return materialize(dealt.mapInArrow(run, INDEX), "index")


# ------------------------------------------------------------------ one bucket


class Bucket:
    """Rows of similar length with sorted lists of their normalised coordinates."""

    def __init__(self, row: dict):
        self.dim, self.low, self.high = row["dim"], row["low"], row["high"]
        self.labels = np.frombuffer(row["labels"], dtype=np.int64)
        n = len(self.labels)
        self.exact = np.frombuffer(row["vectors"], dtype=f"i{row['item']}").reshape(n, self.dim)
        self.vectors = self.exact.astype(np.float64)
        padded = np.frombuffer(row["ids"], dtype=np.int64).reshape(n, -1)
        self.copies, self.ids = padded[:, 0], padded[:, 1:]
        self.orders = np.frombuffer(row["orders"], dtype="u4").reshape(self.dim, n)
        self.lengths = np.sqrt((self.vectors**2).sum(axis=1))
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def column(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Normalised coordinate ``f`` of all rows, and sorted."""
        if f not in self.lists:
            unit = self.vectors[:, f] / np.maximum(self.lengths, 1)
            self.lists[f] = unit, unit[self.orders[f]]
        return self.lists[f]

    def candidates(self, anchor: np.ndarray, length: float, least: float, focus: int) -> np.ndarray | None:
        """Rows whose focus coordinates allow a score of ``least``; None for all rows.

        With unit vectors, a cosine of t or more and an anchor's coordinate cos(a), a row's is within cos(a + arccos t) and
        cos(a - arccos t).
        """
        if least <= 0 or not length:
            return None
        cosine = least / (length * self.high) if self.high else 2.0
        if cosine > 1 + 1e-9:
            return np.empty(0, dtype=np.int64)
        reach = math.acos(min(cosine, 1.0))
        unit = anchor / length
        ranges = []
        for f in np.argsort(-np.abs(unit), kind="stable")[:focus].tolist():
            angle = math.acos(max(-1.0, min(1.0, unit[f])))
            low, high = math.cos(min(math.pi, angle + reach)) - 1e-7, math.cos(max(0.0, angle - reach)) + 1e-7
            begin, end = np.searchsorted(self.column(f)[1], [low, high], side="left").tolist()
            ranges.append((end - begin, f, begin, end, low, high))
        ranges.sort()
        _, f, begin, end, _, _ = ranges[0]
        rows = self.orders[f][begin:end]
        for n, f, _, _, low, high in ranges[1:]:
            if n < len(self.labels) and len(rows):
                unit_f = self.column(f)[0][rows]
                rows = rows[(unit_f >= low) & (unit_f < high)]
        return rows

    def scores(self, rows: np.ndarray | slice, anchors: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Exact inner products of ``rows`` and anchors: as doubles where these hold a hundredfold, else as Python's integers."""
        if float(lengths.max(initial=0)) * self.high < 2.0**46:
            return self.vectors[rows] @ anchors.T.astype(np.float64)
        return self.exact[rows].astype(object).dot(anchors.T.astype(object))

    def met(self, anchors: np.ndarray, lengths: np.ndarray, least: np.ndarray, focus: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each anchor's number, the candidates that do reach ``least``, and their scores.

        Few candidates are multiplied out one by one; anchors with many are multiplied with the bucket at once, and their
        candidates picked from that.
        """
        many = []
        for k in range(len(anchors)):
            rows = self.candidates(anchors[k], float(lengths[k]), float(least[k]), focus)
            if rows is None or 8 * len(rows) > len(self.labels):
                many.append((k, rows))
            elif len(rows):
                got = self.scores(rows, anchors[k : k + 1], lengths[k : k + 1])[:, 0]
                reach = got >= least[k]
                yield k, rows[reach], got[reach]
        for part in (many[n : n + 128] for n in range(0, len(many), 128)):
            picked = [k for k, _ in part]
            table = self.scores(slice(None), anchors[picked], lengths[picked]).T
            for (k, rows), got in zip(part, table, strict=True):
                reach = np.flatnonzero(got >= least[k]) if rows is None else rows[got[rows] >= least[k]]
                yield k, reach, got[reach]

    def best(self, rows: np.ndarray, scores: np.ndarray, n: int) -> list[tuple[int, int]]:
        """The first ``n`` ``(score, id)`` of classes by falling score and id, their copies counted."""
        if len(rows) > n:
            cut = np.sort(scores)[-n] if scores.dtype == object else np.partition(scores, len(scores) - n)[len(scores) - n]
            rows, scores = rows[scores >= cut], scores[scores >= cut]
        out = []
        for row, score in zip(rows.tolist(), scores.tolist(), strict=True):
            out += [(-int(score), i) for i in self.ids[row, : min(self.copies[row], n)].tolist()]
        return [(-s, i) for s, i in sorted(out)[:n]]


# ------------------------------------------------------------------ anchors against buckets


def _against(buckets: DataFrame, anchors: DataFrame, n_blocks: int, p: HardNegatives, negatives: bool) -> DataFrame:
    """``SCORES`` of the anchors ``(cls, label, vector, square, least, bands, bucket, block)`` in their buckets.

    Positives are the best rows of the label; negatives, for each of ``bands`` (scores of positives), the best of other
    labels within its limits.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        for row in left.to_pylist() if right.num_rows else ():
            bucket = Bucket(row)
            same = right.filter(pa.array(np.equal(right["dim"].to_numpy(), bucket.dim)))
            if not same.num_rows:
                continue
            values, _ = _numbers(same["vector"].combine_chunks())
            vectors = values.astype(np.int64).reshape(same.num_rows, bucket.dim)
            lengths = np.sqrt(same["square"].to_numpy())
            ids, labels, bands = same["cls"].to_pylist(), same["label"].to_pylist(), same["bands"].to_pylist()
            for k, rows, scores in bucket.met(vectors, lengths, same["least"].to_numpy(), p.focus):
                fits = (bucket.labels[rows] != labels[k]) == negatives
                rows, scores = rows[fits], scores[fits]
                if not negatives:
                    out += [(ids[k], 0, *best) for best in bucket.best(rows, scores, p.positives + 1)]
                    continue
                for band in bands[k]:
                    inside = (100 * scores >= p.low * band) & (100 * scores <= p.high * band)
                    out += [(ids[k], band, *best) for best in bucket.best(rows[inside], scores[inside], p.negatives)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table({c.split()[0]: pa.array(v, pa.int64()) for c, v in zip(SCORES.split(", "), columns, strict=True)})

    blocks = buckets.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    asked = anchors.select("bucket", "block", "cls", "label", "vector", "square", "least", "bands", F.size("vector").alias("dim"))
    return blocks.groupBy("bucket", "block").cogroup(asked.groupBy("bucket", "block")).applyInArrow(run, SCORES)


def _first(scores: DataFrame, n: int) -> DataFrame:
    """``(cls, band, found)``: the first ``n`` scores and ids of each."""
    order = Window.partitionBy("cls", "band").orderBy(F.desc("score"), "id")
    few = scores.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n)
    return few.groupBy("cls", "band").agg(F.array_sort(F.collect_list(F.struct("_place", "score", "id"))).alias("found")).select(
        "cls", "band", F.transform("found", lambda f: F.struct(f["score"].alias("score"), f["id"].alias("id"))).alias("found"))


def hard_negatives(embeddings: DataFrame, anchor: Column, p: HardNegatives = HardNegatives()) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of ``embeddings (vec_id, label, embedding)``.

    A score is the inner product of the vectors after ``floor(scale * x)``. For each row for which ``anchor`` holds, the
    first ``positives`` other rows of its label are its positives, and the first ``negatives`` rows of other labels with a
    score of ``low`` to ``high`` percent of the positive's are returned, each with its rank from 1. Higher scores come
    first, then smaller vec_ids.

    1. Equal vectors of one label are one class with its smallest ids. Classes are dealt by falling length into buckets.
    2. Each anchor meets one bucket of the longest rows; the scores found there are what better rows must reach.
    3. With these it meets every bucket whose length can reach them, in blocks; the ranges of its focus coordinates
       give the candidates, which are multiplied out exactly. So the positives are found, and likewise the negatives.

    Rows with a NULL label, vector or component, or one that isn't finite, take no part, nor do rows whose squared length
    reaches 2**62, as their scores need not fit 64 bits. A NULL vec_id comes last among ties, as an anchor too. Rows meet only rows of as many
    components. Repeated rows count each: the other rows of an anchor include its copies. Vectors of zeros and empty ones
    score 0. Anchors without positives, and positives without negatives, give no rows; neither does an empty table.
    """
    rows = quantised(embeddings, anchor, p)
    key = ["label", "vector"]
    asked = materialize(
        rows.where("anchor").groupBy(*key).agg(F.first("square").alias("square")).withColumn("cls", F.monotonically_increasing_id()), "anchors")
    numbers = rows.agg(F.sum((F.size("vector") + PER_ROW).cast("double"))).first()[0] or 0
    n_blocks = max(1, math.ceil(asked.count() / p.block_rows))
    n_buckets = max(1, math.ceil(numbers / p.bucket_values))
    buckets = index(classes(rows, p), n_buckets, p)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("cls"), F.lit(n_blocks)).cast("int"))
    lengths = materialize(buckets.groupBy(F.col("dim").alias("_dim"), F.col("bucket").alias("_bucket")).agg(F.max("high").alias("high")), "lengths")
    longest = lengths.groupBy("_dim").agg(F.max_by("_bucket", F.struct("high", -F.col("_bucket"))).alias("_bucket"))
    dim = F.size("vector")

    def met(anchors: DataFrame, negatives: bool) -> DataFrame:
        n = p.negatives if negatives else p.positives + 1
        first = buckets.join(longest, (F.col("dim") == F.col("_dim")) & (F.col("bucket") == F.col("_bucket")), "left_semi")
        start = anchors.join(longest, dim == F.col("_dim")).withColumnRenamed("_bucket", "bucket")
        seeds = materialize(_first(_against(first, start, n_blocks, p, negatives), n), "seeds")
        # What the first bucket gives in full must be reached; where it gives less, the limit of a band, or nothing.
        last = F.element_at("found", n)["score"].cast("double")
        reached = F.when(F.size("found") == n, last - F.abs(last) * 1e-12)
        if negatives:
            limit = seeds.select("cls", F.col("band").alias("_band"), reached.alias("_least"))
            each = anchors.select("cls", F.explode("bands").alias("_band")).join(limit, ["cls", "_band"], "left")
            floor = F.col("_band") * (p.low / 100.0) * (1 - 1e-12)
            least = each.groupBy("cls").agg(F.min(F.greatest(floor, "_least")).alias("_least"))
        else:
            least = seeds.select("cls", reached.alias("_least"))
        every = (
            anchors.drop("least").join(least, "cls", "left").withColumn("least", F.coalesce("_least", F.lit(NOTHING)))
            .withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(n_buckets - 1)))))
        near = every.join(lengths, (dim == F.col("_dim")) & (F.col("bucket") == F.col("_bucket"))).where(
            (F.col("least") <= 0) | (F.sqrt("square") * F.col("high") * (1 + 1e-9) >= F.col("least")))
        return materialize(_first(_against(buckets, near, n_blocks, p, negatives), n), "found")

    asked = asked.withColumn("least", F.lit(NOTHING))
    positives = met(asked.withColumn("bands", F.array().cast("array<bigint>")), False).select("cls", F.col("found").alias("near"))
    # Below 0 the limits part: no score is within.
    bands = F.array_distinct(F.transform(F.filter("near", lambda f: f["score"] >= 0), lambda f: f["score"]))
    banded = materialize(asked.join(positives.select("cls", bands.alias("bands")), "cls").where(F.size("bands") > 0), "bands")
    negatives = met(banded, True).groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("band", "found"))).alias("negatives"))

    # One class may hold very many anchors: its results are repeated for shares of them.
    results = asked.join(positives, "cls").join(negatives, "cls").select(
        *key, "near", "negatives", F.explode(F.sequence(F.lit(0), F.lit(p.shares - 1))).alias("share"))
    dealt = F.pmod(F.monotonically_increasing_id(), F.lit(p.shares)).cast("int")
    answered = rows.where("anchor").withColumn("share", dealt).join(results, [*key, "share"])
    itself = F.aggregate("vector", F.lit(0).cast("bigint"), lambda total, v: total + v * v)
    others = F.filter("near", lambda f, k: k + 1 != F.col("own"))
    found = (
        answered.withColumn("own", F.array_position("near", F.struct(itself.alias("score"), F.col("id"))))
        .select("id", "negatives", F.explode(F.slice(others, 1, p.positives)).alias("positive"))
        .select("id", "positive", F.posexplode(F.col("negatives")[F.col("positive.score")]).alias("at", "negative")))

    def shown(column: str) -> Column:
        return F.when(F.col(column) != NO_ID, F.col(column))

    return found.select(
        shown("id").alias("anchor_id"), shown("positive.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
        shown("negative.id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("negative.score").alias("negative_score"))
