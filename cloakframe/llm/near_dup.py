"""Near-duplicate documents: MinHash bands find candidates, odd sketches thin them, full shingle sets decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.components import components
from cloakframe.llm.words import coefficients, mix, shingles, word_hashes
from cloakframe.session import discard, materialize

FEATURES = "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, sketch array<bigint>, whole array<bigint>"
SETS = "digest binary, part int, shingles binary"


@dataclass(frozen=True)
class NearDup:
    """Parameters of the search.

    A pair at exactly ``percent`` shares no band with a chance of (1 - 0.8**rows)**bands, 3e-6 here. Its odd sketches
    differ by more than ``max_distance`` bits with about the same chance: 256 samples give the estimate a standard
    deviation of 0.025 to 0.03, and the limit stands at an estimate of 0.67.
    """

    words: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 4
    samples: int = 256
    sketch_bits: int = 512
    estimate: float = 0.67
    block: int = 4096
    shares: int = 8

    @property
    def max_distance(self) -> int:
        """Largest XOR population count of two sketches whose estimated similarity is ``estimate``."""
        differing = 2 * self.samples * (1 - self.estimate)
        return int(np.ceil(self.sketch_bits / 2 * (1 - np.exp(-2 * differing / self.sketch_bits))))


def minhashes(items: np.ndarray, samples: int) -> np.ndarray:
    """The smallest value of each of ``samples`` hash functions over the set."""
    factors, shift = coefficients(samples, seed=101), coefficients(samples, seed=102)
    best = np.full(samples, 2**64 - 1, dtype=np.uint64)
    for k in range(0, len(items), 2048):
        part = items[k : k + 2048, None] * factors
        part += shift
        part ^= part >> np.uint64(29)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(best, part.min(axis=0), out=best)
    return best


def samples_of(signature: np.ndarray) -> np.ndarray:
    """A MinHash signature as the set of its (function, minimum) samples."""
    return mix(signature ^ coefficients(len(signature), seed=103))


def odd_sketch(items: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmap of a set, as 64-bit words; the XOR of two is the bitmap of the symmetric difference."""
    at = items % np.uint64(bits)
    parity = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.uint64)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    factor = coefficients(rows, seed=104)
    total = (signature[: bands * rows].reshape(bands, rows) * factor).sum(axis=1, dtype=np.uint64)
    return mix(total + coefficients(bands, seed=105))


def set_of(text: bytes | None, words: int) -> np.ndarray:
    return shingles(word_hashes((text or b"").lower()), words)


def digest_of(items: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def features(docs: DataFrame, p: NearDup) -> DataFrame:
    """Set size, digest of the set, band keys and odd sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sizes, digests, bands, sketches, wholes = [], [], [], [], []
                for text in part.column(1):
                    items = set_of(text.as_py(), p.words)
                    sizes.append(len(items))
                    digests.append(digest_of(items))
                    signature = minhashes(items, p.samples)
                    bands.append(band_keys(signature, p.bands, p.rows).view(np.int64))
                    sketches.append(odd_sketch(samples_of(signature), p.sketch_bits).view(np.int64))
                    wholes.append(odd_sketch(items, p.sketch_bits).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())),
                     pa.array(wholes, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "digest", "bands", "sketch", "whole"])

    # bytes.lower() changes A-Z alone, which are the letters the definition lower-cases.
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(run, FEATURES)


def _sets(docs: DataFrame, p: NearDup) -> DataFrame:
    """``(digest, part, shingles)``: the full sets of texts, each once for a task, whose number is ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), set()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                digests, sets = [], []
                for text in batch.slice(start, 512).column(0):
                    items = set_of(text.as_py(), p.words)
                    digest = digest_of(items)
                    if digest not in seen:
                        seen.add(digest)
                        digests.append(digest)
                        sets.append(items.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array([task] * len(digests), pa.int32()), pa.array(sets, pa.binary())],
                    names=["digest", "part", "shingles"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(run, SETS)


def _confirm(pairs: DataFrame, sets: DataFrame, p: NearDup) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_py(), dtype=np.uint64) for s in (left, right))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= p.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint")


def _alike(p: NearDup) -> Column:
    """Sizes and sketches of ``l`` and ``r`` allow the wanted similarity.

    The sketches of the samples estimate it. Those of the whole sets bound it: they differ in as many bits at most as the
    sets in shingles, and at the wanted similarity s these are (1 - s) / (1 + s) of both sizes at most.
    """

    def distance(sketch: str) -> Column:
        return sum((F.bit_count(F.col(f"l.{sketch}")[k].bitwiseXOR(F.col(f"r.{sketch}")[k])) for k in range(p.sketch_bits // 64)), F.lit(0))

    small, large = F.least("l.n_shingles", "r.n_shingles"), F.greatest("l.n_shingles", "r.n_shingles")
    return (
        (small * 100 >= large * p.percent) & (distance("sketch") <= p.max_distance)
        & (distance("whole") * (100 + p.percent) <= (small + large) * (100 - p.percent)))


#: Short lists are broadcast up to this many rows, some 100 bytes each with the hash table; more are met by a shuffle.
BROADCAST_ROWS = 500_000


def counted(ids: DataFrame) -> DataFrame:
    """``ids``, rows of a few short columns, written once and marked for broadcast if there are few enough.

    A join of texts with a short list need not shuffle the texts; beyond the limit it does.
    """
    written = materialize(ids, "ids")
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def near_duplicates(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs (doc_id, text)``.

    Two rows are linked if 100 * |intersection| >= percent * |union| of their sets of word shingles; ``component_id``
    is the smallest doc_id reachable. NULL and word-free texts have no set and no link. Equal rows are linked like any
    equal texts, and different texts under one doc_id are rows of their own. A NULL doc_id keeps its row and its links,
    can be nobody's smallest id unless its whole component has none, and is not kept. Other columns are ignored; an empty
    table gives no rows.

    1. Rows of equal sets are one class, found by a partial aggregate of a 128-bit digest. Classes are numbered; what
       follows costs a class as much however many rows it has, and its full set is made and held once.
    2. In each band bucket every class is paired with the one that shares buckets with most others. Pairs whose odd
       sketches are near enough are confirmed on the full sets, and links make first components.
    3. Only buckets that still hold several components are searched again: the classes outside a bucket's main
       component against the bucket's classes of other components, in blocks, with the sketch test inside the join.
       A link between classes that share a bucket is therefore found, or joins what is joined already.

    So a group of near copies costs its size, and only what the first links left apart is compared further.
    """
    rows = materialize(features(docs, p), "features")
    classes = materialize(
        rows.where("n_shingles > 0").groupBy("digest").agg(
            F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("whole").alias("whole"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    profile = classes.select("node", "n_shingles", "sketch", "whole", F.transform("bands", lambda k: F.shiftright(k, 32).cast("int")).alias("places"))

    keys = classes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = materialize(keys.join(buckets, "key").select("key", "band", "node", "members"), "buckets")
    # The class that meets most others is the middle of its group: more of them are near it than near any other.
    meets = shared.groupBy("node").agg(F.sum("members").alias("meets"))
    pivots = shared.join(meets, "node").groupBy("key").agg(
        F.max_by("node", F.struct(F.col("meets"), -F.col("node"))).alias("pivot"))
    wanted = materialize(classes.select("node", "digest", "least").join(shared, "node", "left_semi"), "wanted")
    named = counted(wanted.select("least").distinct())
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(named, F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    made = materialize(_sets(texts, p), "sets")
    # Repeated rows and other texts of the same ids have made sets too: one of each wanted class is left.
    once = counted(made.groupBy("digest").agg(F.min("part").alias("part")).join(wanted.select("digest", "node"), "digest"))
    sets = made.join(once, ["digest", "part"]).select("node", "shingles")

    stars = shared.join(pivots, "key").where("node <> pivot").select(
        F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    near = (
        stars.join(profile.alias("l"), F.col("a") == F.col("l.node")).join(profile.alias("r"), F.col("b") == F.col("r.node"))
        .where(_alike(p)).select("a", "b"))
    links = materialize(_confirm(near, sets, p), "links")
    first = components(links)

    labelled = materialize(
        shared.join(first, "node", "left").join(profile, "node").select(
            "key", "band", "node", "members", F.coalesce("component", "node").alias("component"),
            "n_shingles", "sketch", "whole", "places"), "labelled")
    counts = labelled.groupBy("key", "component").agg(F.count("*").alias("n"), F.first("members").alias("members"))
    mixed = materialize(counts.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main"),
        F.first("members").alias("members"), F.count("*").alias("parts")).where("parts > 1").select(
        "key", "main",
        F.ceil((F.col("members") - F.col("n_main")) / p.block).cast("int").alias("left_blocks"),
        F.ceil(F.col("members") / p.block).cast("int").alias("right_blocks")), "mixed")
    # A bucket may hold very many classes: they are dealt in shares before they meet what is known of the bucket.
    block = F.xxhash64("node")
    shares = F.explode(F.sequence(F.lit(0), F.lit(p.shares - 1)))
    open_rows = labelled.withColumn("share", F.pmod(block, F.lit(p.shares)).cast("int")).join(
        mixed.withColumn("share", shares), ["key", "share"]).drop("share")
    left = open_rows.where("component <> main").withColumn("lb", F.pmod(block, "left_blocks").cast("int")).withColumn(
        "rb", F.explode(F.sequence(F.lit(0), F.col("right_blocks") - 1))).alias("l")
    right = open_rows.withColumn("rb", F.pmod(block, "right_blocks").cast("int")).withColumn(
        "lb", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1))).alias("r")
    again = left.join(
        right,
        (F.col("l.key") == F.col("r.key")) & (F.col("l.lb") == F.col("r.lb")) & (F.col("l.rb") == F.col("r.rb"))
        & (F.col("l.component") != F.col("r.component"))
        & ((F.col("r.component") == F.col("r.main")) | (F.col("l.node") < F.col("r.node"))) & _alike(p)
        # A pair comes from the first band it shares.
        & ~F.arrays_overlap(F.slice("l.places", 1, F.col("l.band")), F.slice("r.places", 1, F.col("l.band"))),
    ).select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()
    more = materialize(_confirm(again, sets, p), "links")
    linked = components(first.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))

    grouped = classes.select("digest", "node", "least").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = grouped.groupBy("component").agg(F.min("least").alias("smallest"))
    members = materialize(grouped.join(smallest, "component").select("digest", "smallest"), "members")
    for spent in (classes, shared, wanted, made, links, labelled, mixed, more):
        discard(spent)
    return rows.select("doc_id", "n_shingles", "digest").join(members, "digest", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
