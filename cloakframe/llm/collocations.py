"""Collocations: phrases of several words, scored by how much oftener they stand together than chance has it."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.words import coefficients, mix
from cloakframe.session import materialize

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
INSIDE = ~SEPARATOR
INSIDE[[0x09, 0x20]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
ENDS = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
WORDS = re.compile(rb"[^ \t.,;:!?\n\x0b\x0c\r]+")
SUMMARY = "part int, items binary, counts binary, undercount bigint"
PACKED = "part int, lang string, phrases binary, counts binary"
COUNTS = "lang string, phrase string, words int, n bigint"


@dataclass(frozen=True)
class Collocations:
    """Parameters.

    ``capacity`` counters are kept for each hash partition of phrases, and there are so many partitions that capacity
    times ``threshold`` exceeds a partition's share of the mass. ``bits`` is the size of the bitmap of survivors as a
    power of two; a full bitmap would only let more phrases through to the exact counts.
    """

    threshold: int = 100
    longest: int = 5
    top: int = 2000
    capacity: int = 1 << 18
    bits: int = 27
    flush: int = 1 << 22
    remembered: int = 200_000
    #: Bytes of text worked on at a time.
    block: int = 1 << 22


# ------------------------------------------------------------------ words of a block


class Block:
    """Words of several texts: where they are, their piece, language and two hashes."""

    def __init__(self, texts: list[bytes], langs: list[int], old: list[int], check: bool):
        self.data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
        inside = INSIDE[self.data]
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.piece = np.cumsum(SEPARATOR[self.data], dtype=np.int32)[self.starts]
        lengths = np.array([len(t) + 1 for t in texts])
        first = np.searchsorted(self.starts, np.cumsum(lengths) - lengths)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(first, append=len(self.starts)))
        self.lang = np.array(langs, dtype=np.int64)[self.owner]
        # The first words of a text's later parts were in its part before.
        self.fresh = np.ones(len(self.starts), dtype=bool)
        for at, n in zip(first.tolist(), old, strict=True):
            self.fresh[at : at + n] = False
        size = self.ends - self.starts
        position = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        letters = self.data[inside].astype(np.uint64) + np.uint64(1)
        begin = np.cumsum(size) - size
        self.hashes = [
            mix(np.add.reduceat(letters * coefficients(int(size.max()), seed=seed)[position], begin) + size.astype(np.uint64))
            if len(size) else np.empty(0, dtype=np.uint64) for seed in ((11, 12) if check else (11,))]

    def runs(self, words: int) -> np.ndarray:
        """Places of the words at which a phrase of ``words`` words begins inside a piece and has not been counted."""
        n = len(self.starts) - words + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64)
        return np.flatnonzero((self.piece[:n] == self.piece[words - 1 :]) & self.fresh[words - 1 :])

    def phrase_hashes(self, at: np.ndarray, words: int, seeds: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of the phrases at ``at``, with the language's seed."""
        factor = coefficients(words + 1, seed=31 + words)
        total = seeds[self.lang[at]] * factor[words]
        for k in range(words):
            total += self.hashes[which][at + k] * factor[k]
        return mix(total)

    def phrase(self, at: int, words: int) -> bytes:
        return b" ".join(self.data[self.starts[k] : self.ends[k]].tobytes() for k in range(at, at + words))


def parts(text: bytes, longest: int, size: int) -> Iterator[tuple[bytes, int]]:
    """Parts of a text and how many words at each one's start belong to the part before.

    A text within ``size`` is one part. Longer ones are parted behind a word, and the next part repeats the last words, so
    that a phrase that reaches over the cut is in the later part, whole.
    """
    begin = old = cut = 0
    while (met := ENDS.search(text, max(begin + size, cut + 1))):
        cut = met.start()
        yield text[begin:cut], old
        last = [m.start() for m in WORDS.finditer(text, begin, cut)][-(longest - 1) :] if longest > 1 else []
        begin, old = last[0] if last else cut, len(last)
    yield text[begin:], old


def blocks(batches: Iterator[pa.RecordBatch], names: dict[str, int], longest: int, block: int, check: bool) -> Iterator[Block]:
    """Blocks of the texts of ``batches (lang, text)``; ``names`` numbers the languages met."""
    texts, langs, old, size = [], [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            number = names.setdefault(lang.as_py(), len(names))
            for part, n in parts(text.as_py() or b"", longest, block):
                texts.append(part)
                langs.append(number)
                old.append(n)
                size += len(part) + 1
                if size >= block:
                    yield Block(texts, langs, old, check)
                    texts, langs, old, size = [], [], [], 0
    if texts:
        yield Block(texts, langs, old, check)


class Seeds:
    """A number for each language met, alike on every machine."""

    def __init__(self) -> None:
        self.names: dict[str, int] = {}
        self._seeds = np.empty(0, dtype=np.uint64)

    def get(self) -> np.ndarray:
        if len(self._seeds) < len(self.names):
            self._seeds = np.array(
                [int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in self.names], dtype=np.uint64)
        return self._seeds


# ------------------------------------------------------------------ summaries


class Summary:
    """A Misra-Gries summary over 48-bit items: at most ``capacity`` counters, each short by ``undercount`` at most.

    To make room all counters are lowered by the largest that must go. Every such step takes its amount from more than
    ``capacity`` counters, so the undercount stays below mass / capacity, over merged summaries too.
    """

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.items = np.empty(0, dtype=np.uint64)
        self.counts = np.empty(0, dtype=np.int64)
        self.undercount = 0
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._n = 0

    def add(self, items: np.ndarray, counts: np.ndarray, undercount: int = 0) -> None:
        """Merge counters of other summaries; items of one call differ."""
        self._waiting.append((items, counts))
        self._n += len(items)
        self.undercount += undercount
        if self._n > 4 * self.capacity:
            self.settle()

    def settle(self) -> None:
        items = np.concatenate([self.items, *(w[0] for w in self._waiting)])
        counts = np.concatenate([self.counts, *(w[1] for w in self._waiting)])
        self._waiting, self._n = [], 0
        order = np.argsort(items, kind="stable")
        items, counts = items[order], counts[order]
        first = np.flatnonzero(np.diff(items, prepend=~items[:1]))
        self.items, self.counts = items[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(self.items) > self.capacity:
            lower = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            if self.undercount + lower < self.limit:  # else the summary outgrows its capacity rather than its promise
                left = self.counts > lower
                self.items, self.counts = self.items[left], self.counts[left] - lower
                self.undercount += lower


def _pack(items: np.ndarray) -> bytes:
    return items.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8")[:, 0].astype(np.uint64)


class Bitmap:
    """Two bits for each 48-bit item of a set."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def has(self, items: np.ndarray) -> np.ndarray:
        met = np.ones(len(items), dtype=bool)
        for place in (items & np.uint64(2**self.bits - 1), items >> np.uint64(48 - self.bits)):
            met &= self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1) > 0
        return met


def bitmap(survivors: DataFrame, bits: int) -> Bitmap:
    """The bitmap of ``survivors (item)``. Words of 64 bits are made by Spark; the driver gets 2**bits / 64 at most."""
    place = F.explode(F.array(
        F.col("item").bitwiseAND(F.lit(2**bits - 1)), F.shiftright("item", 48 - bits))).alias("place")
    rows = survivors.select(place).groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("set")).toArrow()
    words = np.zeros(2**bits // 64, dtype=np.uint64)
    words[rows["word"].to_numpy()] = rows["set"].to_numpy().view(np.uint64)
    return Bitmap(words, bits)


def _phrases(block: Block, seeds: np.ndarray, orders: range, pairs: Bitmap | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Order, places and 64-bit hashes; phrases of three words and more only where all their pairs are in ``pairs``."""
    linked = None
    for words in orders:
        at = block.runs(words)
        if words > 2 and pairs is not None:
            if linked is None:
                linked = np.zeros(len(block.starts), dtype=bool)
                n = len(block.starts) - 1
                two = np.flatnonzero(block.piece[:n] == block.piece[1:]) if n > 0 else at
                linked[two] = pairs.has(block.phrase_hashes(two, 2, seeds) >> np.uint64(16))
            for k in range(words - 1):
                at = at[linked[at + k]]
        yield words, at, block.phrase_hashes(at, words, seeds)


def survivors(texts: DataFrame, p: Collocations, orders: range, mass: int, pairs: Broadcast | None) -> DataFrame:
    """``(item)``: 48 bits of the hash of every phrase of ``orders`` words that may be met ``threshold`` times.

    Tasks turn their texts into summaries, one for each hash partition; those of one partition are merged in one task,
    whose memory is bounded by ``capacity``. What comes out has every phrase of the threshold and little else.
    """
    spark = texts.sparkSession
    n_parts = max(mass // (p.threshold * p.capacity) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def summaries(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        items, counts = np.unique(np.concatenate(found) >> np.uint64(16), return_counts=True)
        bounds = np.searchsorted(items, np.array([-(-(k << 48) // n_parts) for k in range(1, n_parts)], dtype=np.uint64))
        rows = []
        for part, (a, b) in enumerate(zip([0, *bounds.tolist()], [*bounds.tolist(), len(items)], strict=True)):
            if a < b:
                one = Summary(p.capacity, p.threshold)
                one.add(items[a:b], counts[a:b])
                one.settle()
                rows.append((part, _pack(one.items), one.counts.astype("<u4").tobytes(), one.undercount))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.int64()), strict=True)],
            names=["part", "items", "counts", "undercount"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, found, n = Seeds(), [], 0
        for block in blocks(batches, seeds.names, orders[-1], p.block, check=False):
            for _, _, hashes in _phrases(block, seeds.get(), orders, pairs.value if pairs else None):
                found.append(hashes)
                n += len(hashes)
            if n >= p.flush:
                yield from summaries(found)
                found, n = [], 0
        if n:
            yield from summaries(found)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def left(summary: Summary) -> Iterator[pa.RecordBatch]:
            summary.settle()
            if summary.undercount >= p.threshold:
                raise ValueError("a hash partition has more mass than capacity and threshold allow")
            items = summary.items[summary.counts + summary.undercount >= p.threshold]
            yield pa.RecordBatch.from_arrays([pa.array(items.astype(np.int64), pa.int64())], names=["item"])

        now, summary = None, None
        for batch in batches:
            for part, items, counts, undercount in zip(*batch.columns, strict=True):
                if part.as_py() != now:
                    if summary is not None:
                        yield from left(summary)
                    now, summary = part.as_py(), Summary(p.capacity, p.threshold)
                summary.add(_unpack(items.as_py()), np.frombuffer(counts.as_py(), dtype="<u4").astype(np.int64), undercount.as_py())
        if summary is not None:
            yield from left(summary)

    dealt = texts.mapInArrow(read, SUMMARY).repartition(n_parts, "part").sortWithinPartitions("part")
    return materialize(dealt.mapInArrow(merge, "item bigint"), "survivors")


def alike(at: np.ndarray, hashes: np.ndarray, second: np.ndarray) -> tuple[list[int], list[int]]:
    """A place of each phrase and how often it is met, by two hashes."""
    order = np.argsort(hashes, kind="stable")
    if (second[order][1:] != second[order][:-1])[hashes[order][1:] == hashes[order][:-1]].any():
        order = np.lexsort((second, hashes))  # two phrases of one hash
    at, hashes, second = at[order], hashes[order], second[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (second[1:] != second[:-1])
    first = np.flatnonzero(new)
    return at[first].tolist(), np.diff(first, append=len(at)).tolist()


def counted_phrases(texts: DataFrame, p: Collocations, kept: Broadcast, words: int) -> DataFrame:
    """``(lang, phrase, words, n)``: exact counts of the phrases that survived, ``threshold`` at least.

    Rows without a phrase have the number of all words of a language. ``kept`` has the bitmaps of one and two words and of
    more; ``words`` is a bound of the words of all texts. Inside a block occurrences are told apart by two hashes of 64
    bits, from there on by the phrase itself. A task's counts go out packed, one record for each hash partition and
    language, and are added up there; what is not met ``threshold`` times ends in the partition.
    """
    spark = texts.sparkSession
    # As many phrases as a partition may have to return: each of them takes ``threshold`` of the mass.
    n_parts = max(p.longest * words // (p.threshold * p.capacity) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, long = kept.value
        seeds, known, totals = Seeds(), {}, {}

        def out() -> pa.RecordBatch:
            packed: dict[tuple[int, str], list[tuple[bytes, int]]] = {}
            for (lang, phrase), n in known.items():
                packed.setdefault((zlib.crc32(phrase) % n_parts, lang), []).append((phrase, n))
            rows = [(part, lang, b"\n".join(x for x, _ in some), np.array([n for _, n in some], dtype="<i8").tobytes())
                    for (part, lang), some in packed.items()]
            rows += [(zlib.crc32(lang.encode()) % n_parts, lang, None, np.array([n], dtype="<i8").tobytes()) for lang, n in totals.items()]
            known.clear()
            totals.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.binary(), pa.binary()))],
                names=["part", "lang", "phrases", "counts"])

        for block in blocks(batches, seeds.names, p.longest, p.block, check=True):
            names = list(seeds.names)
            for lang, n in enumerate(np.bincount(block.lang[block.fresh], minlength=len(names)).tolist()):
                if n:
                    totals[names[lang]] = totals.get(names[lang], 0) + n
            for order, at, hashes in _phrases(block, seeds.get(), range(1, p.longest + 1), short):
                hit = (short if order <= 2 else long).has(hashes >> np.uint64(16))
                for k, n in zip(*alike(at[hit], hashes[hit], block.phrase_hashes(at[hit], order, seeds.get(), 1)), strict=True):
                    key = names[block.lang[k]], block.phrase(k, order)
                    known[key] = known.get(key, 0) + n
            if len(known) > p.remembered:
                yield out()
        yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}

        def left() -> pa.RecordBatch:
            rows = [(lang, phrase, n) for (lang, phrase), n in known.items() if phrase is None or n >= p.threshold]
            known.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()),
                 pa.array([None if r[1] is None else r[1].decode("utf-8", "replace") for r in rows], pa.string()),
                 pa.array([0 if r[1] is None else r[1].count(b" ") + 1 for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())],
                names=["lang", "phrase", "words", "n"])

        for batch in batches:
            for part, lang, phrases, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    yield left()
                    now = part
                for phrase, n in zip((None,) if phrases is None else phrases.split(b"\n"), np.frombuffer(counts, dtype="<i8").tolist(), strict=True):
                    known[lang, phrase] = known.get((lang, phrase), 0) + n
        yield left()

    dealt = texts.mapInArrow(run, PACKED).repartition(n_parts, "part").sortWithinPartitions("part")
    return materialize(dealt.mapInArrow(merge, COUNTS), "phrases")


def scored(counts: DataFrame) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)`` for each phrase of two words and more in ``counts (lang, phrase, words, n)``.

    A phrase in a longer one met as often is left out. Such a longer one lies inside one with a single word more that is
    met as often, so only those are asked.
    """
    words = F.split("phrase", " ")
    phrases = counts.where("words >= 2")
    left_out = phrases.where("words >= 3").select(
        "lang", "n", F.explode(F.array(
            F.array_join(F.slice(words, 1, F.col("words") - 1), " "), F.array_join(F.slice(words, 2, F.col("words") - 1), " "))).alias("phrase"))
    kept = phrases.join(left_out, ["lang", "phrase", "n"], "left_anti").withColumnRenamed("n", "a")
    cut = kept.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("_left"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("_right"))
    some = counts.where("phrase IS NOT NULL")
    both = cut.join(some.select("lang", F.col("phrase").alias("_left"), F.col("n").alias("l")), ["lang", "_left"]).join(
        some.select("lang", F.col("phrase").alias("_right"), F.col("n").alias("r")), ["lang", "_right"])
    totals = counts.where("phrase IS NULL").select("lang", "n")
    score = "(1000 * cast(a AS decimal(17,0)) * cast(n AS decimal(17,0))) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))"
    return both.join(totals, "lang").withColumn("score", F.expr(score)).groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("_cut")).select(
        "lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")


def collocations(docs: DataFrame, p: Collocations = Collocations()) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of ``docs (lang, text)``.

    A-Z count as a-z. Texts are split at ``.,;:!?`` and 0x0A-0x0D and then into words at blanks and tabs; a phrase is 2 to
    ``longest`` words in a row, met ``threshold`` times or more. For a cut into two, ``a`` is how often the phrase is met,
    ``l`` and ``r`` its parts, ``n`` all words of the language; the score is floor(1000 a n / (l r)), and the cut with the
    lowest counts. Phrases inside a longer one met as often are left out.

    1. All words and pairs are summarised in hash partitions; capacity times threshold exceeds their mass, so every
       frequent one survives. Its bits go into a bitmap of fixed size.
    2. The same for longer phrases, where all their pairs are in the bitmap.
    3. What is in the bitmaps is counted exactly; a needless bit costs a count, not a result.

    NULL texts are empty, NULL languages ``und``; repeated rows count again; ties go to the phrase first in byte order; an
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary"))
    # A word takes two bytes with what follows it.
    words = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    words = words // 2 + 1
    short = bitmap(survivors(texts, p, range(1, min(p.longest, 2) + 1), 2 * words, None), p.bits)
    long = short
    if p.longest > 2:
        long = bitmap(survivors(
            texts, p, range(3, p.longest + 1), (p.longest - 2) * words, spark.sparkContext.broadcast(short)), p.bits)
    counts = counted_phrases(texts, p, spark.sparkContext.broadcast((short, long)), words)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's phrases are ranked in shares first, so that no task sorts all of them.
    shares = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = scored(counts).withColumn("_place", F.row_number().over(shares)).where(F.col("_place") <= p.top).drop("_place")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= p.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
