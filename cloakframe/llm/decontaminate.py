"""Benchmark passages inside documents: latent semantic retrieval, then common subsequences and answer words."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.llm.words import coefficients, word_hashes


@dataclass(frozen=True)
class Decontamination:
    """Parameters of the search.

    Benchmark texts are cut evenly into passages of at most ``passage_words``. A latent space spans ``dimensions``
    passages, so that nothing of a passage's own words is lost; one reading of the corpus serves ``spaces_per_pass``
    spaces, and a larger benchmark is met by more readings.
    """

    passage_words: int = 64
    dimensions: int = 256
    oversample: int = 8
    spaces_per_pass: int = 8
    window: int = 40
    stride: int = 10
    margin: int = 24
    overlap: float = 0.6
    answer_part: float = 0.5
    answer_share: float = 0.5


class Passages:
    """The benchmark passages of one latent space: their words, weights and coordinates."""

    def __init__(self, items: list[tuple[int, np.ndarray]], p: Decontamination):
        self.items = np.array([i for i, _ in items], dtype=np.int64)
        self.words = [w for _, w in items]
        self.terms, self.flat = np.unique(np.concatenate(self.words), return_inverse=True)
        self.first = np.cumsum([0] + [len(w) for w in self.words])[:-1]
        self.ids = np.split(self.flat, self.first[1:])
        self.unique, self.repeats = zip(*(np.unique(i, return_counts=True) for i in self.ids), strict=True)
        self.pairs = np.cumsum([len(self.terms)] + [len(u) for u in self.unique])
        self.need = np.array([math.ceil(p.overlap * len(w) - 1e-9) for w in self.words])
        self.idf: np.ndarray | None = None
        self.axes: np.ndarray | None = None

    def at(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that occur in this space, and their term numbers."""
        k = np.searchsorted(self.terms, hashes)
        k[k == len(self.terms)] = 0
        where = np.flatnonzero(self.terms[k] == hashes)
        return where, k[where]

    def regions(self, j: int, where: np.ndarray, terms: np.ndarray, starts: np.ndarray, p: Decontamination) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows whose region holds as many words of passage ``j`` as ``overlap`` asks for, and how often each of its words."""
        unique, need = self.unique[j], self.need[j]
        k = np.searchsorted(unique, terms)
        k[k == len(unique)] = 0
        hit = np.flatnonzero(unique[k] == terms)
        at, k = where[hit], k[hit]
        lows, highs = np.searchsorted(at, starts - p.margin), np.searchsorted(at, starts + p.window + p.margin)
        many = np.flatnonzero(highs - lows >= need)
        for part in (many[n : n + 256] for n in range(0, len(many), 256)):
            low, count = lows[part], highs[part] - lows[part]
            row = np.repeat(np.arange(len(part)), count)
            pick = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            counts = np.bincount(row * len(unique) + k[pick], minlength=len(part) * len(unique)).reshape(len(part), -1)
            enough = np.minimum(counts, self.repeats[j]).sum(axis=1) >= need
            if enough.any():
                yield starts[part[enough]], counts[enough]

    def count(self, hashes: np.ndarray, counts: np.ndarray, p: Decontamination) -> None:
        """Adds a document to the frequencies of terms, and of the words of each passage that it may be a copy of."""
        where, terms = self.at(hashes)
        present = np.zeros(len(self.terms), dtype=np.int32)
        present[terms] = 1
        counts[: len(present)] += present
        for j in np.flatnonzero(np.add.reduceat(present[self.flat], self.first) >= self.need).tolist():
            if any(True for _ in self.regions(j, where, terms, _starts(hashes, p), p)):
                counts[self.pairs[j] : self.pairs[j + 1]] += present[self.unique[j]]

    def weigh(self, counts: np.ndarray, documents: int, p: Decontamination) -> None:
        """Weights, the rarer words of each passage (by the documents that are no copies of it), and the least weight of a find.

        A find has ``need`` words of the passage and a share ``answer_share`` of the rarer ones; ``least`` is the sum of the
        lightest such words.
        """
        frequency = counts[: len(self.terms)]
        self.idf = np.log((1.0 + documents) / (1.0 + frequency)) + 1e-3
        self.answers, self.least = [], np.zeros(len(self.words))
        for j, (unique, repeats) in enumerate(zip(self.unique, self.repeats, strict=True)):
            others = frequency[unique] - counts[self.pairs[j] : self.pairs[j + 1]]
            rare = np.lexsort((unique, others))[: math.ceil(p.answer_part * len(unique))]
            self.answers.append(rare)
            mass = self.idf[unique] ** 2
            asked = rare[np.argsort(mass[rare])][: math.ceil(p.answer_share * len(rare) - 1e-9)]
            left = repeats.copy()
            left[asked] -= 1
            rest = np.sort(np.repeat(mass, left))[: max(int(self.need[j]) - len(asked), 0)]
            self.least[j] = mass[asked].sum() + rest.sum()

    def place(self, axes: np.ndarray) -> None:
        """Latent vectors of the passages and of the terms."""
        self.axes = (axes * self.idf[:, None]).astype(np.float32)
        self.vectors = np.stack([self.axes[i].sum(axis=0) for i in self.ids])

    def near(self, terms: np.ndarray) -> list[int]:
        """Passages whose share in the latent vector of a document's words reaches the least weight of a find.

        The space holds the passages whole, so the inner product is that of the words; 1 % is left for rounding.
        """
        return np.flatnonzero(self.vectors @ self.axes[np.unique(terms)].sum(axis=0) >= 0.99 * self.least).tolist()


def _starts(hashes: np.ndarray, p: Decontamination) -> np.ndarray:
    return np.arange(0, max(len(hashes) - p.window, 0) + p.stride, p.stride)


def common_subsequence(masks: dict[int, int], length: int, words: np.ndarray) -> int:
    """Length of the longest common subsequence; ``masks`` has a bit for each place of a word in the passage."""
    full = (1 << length) - 1
    row = full
    for w in words.tolist():
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return length - row.bit_count()


def _masks(words: np.ndarray) -> dict[int, int]:
    masks: dict[int, int] = {}
    for k, w in enumerate(words.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    return masks


def find(hashes: np.ndarray, space: Passages, p: Decontamination, masks: list[dict[int, int]]) -> dict[int, float]:
    """Benchmark items of ``space`` found in a document, each with its share of words in common order."""
    where, terms = space.at(hashes)
    found: dict[int, float] = {}
    if not len(where):
        return found
    starts = _starts(hashes, p)
    for j in space.near(terms):
        length, item, answers = len(space.words[j]), int(space.items[j]), space.answers[j]
        for begins, counts in space.regions(j, where, terms, starts, p):
            answered = (counts[:, answers] > 0).sum(axis=1) >= p.answer_share * len(answers)
            for begin in begins[answered].tolist():
                region = hashes[max(begin - p.margin, 0) : begin + p.window + p.margin]
                share = common_subsequence(masks[j], length, region) / length
                if share >= p.overlap:
                    found[item] = max(found.get(item, 0.0), share)
    return found


def _words(text: bytes | None) -> np.ndarray:
    return word_hashes((text or b"").lower())


def passages(benchmark: DataFrame, p: Decontamination) -> DataFrame:
    """``(item_id, words)`` with the word hashes of every passage, as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = _words(text)
                parts = math.ceil(len(hashes) / p.passage_words)
                for part in np.array_split(hashes, parts) if parts else []:
                    ids.append(item)
                    words.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.binary())], names=["item_id", "words"])

    rows = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("bigint"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "item_id bigint, words binary")


def _added(partials: DataFrame) -> dict[int, np.ndarray]:
    """Sums the float vectors ``data`` of equal ``slot``; their number and size are bounded by the spaces of a pass."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table.column("data"))
        return pa.table({"slot": table.column("slot").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})

    summed = partials.groupBy("slot").applyInArrow(add, "slot bigint, data binary")
    return {r.slot: np.frombuffer(r.data) for r in summed.toLocalIterator()}


def document_frequencies(docs: DataFrame, spaces: list[Passages], p: Decontamination) -> tuple[list[np.ndarray], int]:
    """In how many of all documents each term of each space occurs, behind them the same for each passage's words in
    documents that may be copies of it (they have a region with ``overlap`` of its words), and the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(spaces)
    at = np.cumsum([0] + [int(s.pairs[-1]) for s in spaces])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(at[-1], dtype=np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0):
                hashes = _words(text.as_py())
                for k, space in enumerate(shared.value):
                    space.count(hashes, counts[at[k] : at[k + 1]], p)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1), pa.int64()), pa.array(np.append(counts[seen], rows), pa.int64())], names=["term", "n"])

    total, documents = np.zeros(at[-1]), 0
    counted = docs.select(F.col("text").cast("binary")).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    for r in counted.toLocalIterator():
        if r.term < 0:
            documents = r.n
        else:
            total[r.term] = r.n
    return np.split(total, at[1:-1]), documents


def latent_axes(rows: DataFrame, spaces: list[Passages], p: Decontamination) -> None:
    """Randomised SVD of each space's TF-IDF matrix, over its passages ``(space, words)``.

    The range finder multiplies by the matrix and its transpose, the second pass gives the small Gram matrix of the
    coordinates; both are sums over passages, made in tasks and added by space.
    """
    context = rows.sparkSession.sparkContext
    width = [min(p.dimensions + p.oversample, len(s.words), len(s.terms)) for s in spaces]

    def over(bases: list[np.ndarray], gram: bool) -> list[np.ndarray]:
        shared = context.broadcast([(s.terms, s.idf, b) for s, b in zip(spaces, bases, strict=True)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for space, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    terms, idf, basis = shared.value[space]
                    ids, tf = np.unique(np.searchsorted(terms, np.frombuffer(words, dtype=np.uint64)), return_counts=True)
                    weights = tf * idf[ids]
                    y = weights @ basis[ids]
                    if space not in sums:
                        sums[space] = np.zeros((basis.shape[1],) * 2 if gram else basis.shape)
                    if gram:
                        sums[space] += np.outer(y, y)
                    else:
                        sums[space][ids] += np.outer(weights, y)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slot", "data"])

        added = _added(rows.mapInArrow(run, "slot bigint, data binary"))
        return [added[k].reshape((b.shape[1],) * 2 if gram else b.shape) for k, b in enumerate(bases)]

    start = [
        mix_normal(len(s.terms), w) for s, w in zip(spaces, width, strict=True)]
    bases = [np.linalg.qr(z)[0] for z in over(start, gram=False)]
    for space, basis, gram in zip(spaces, bases, over(bases, gram=True), strict=True):
        values, vectors = np.linalg.eigh(gram)
        space.place(basis @ vectors[:, np.argsort(-values)[: p.dimensions]])


def mix_normal(rows: int, columns: int) -> np.ndarray:
    """A seeded matrix of about normal entries (sums of four uniforms)."""
    bits = coefficients(rows * columns, seed=201).view(np.uint16).reshape(rows * columns, 4)
    return (bits.astype(np.float64).sum(axis=1) / 65536 - 2).reshape(rows, columns)


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """``docs`` with ``contaminated``, ``n_items``, ``item_ids``, ``best_item`` and ``overlap`` for each row.

    Words are lower-cased (A-Z) runs without blanks. A document's words are weighed by IDF and projected into the latent
    spaces of the benchmark; a passage is a candidate if its inner product reaches the weight of the lightest words that
    a find must have. Every ``stride`` words there is a window of ``window`` words; a candidate is found if its longest
    common subsequence with the window and ``margin`` words on both sides has at least ``overlap`` of its words and at least
    ``answer_share`` of its rarer words (the ``answer_part`` that carries the answer) stand there. What is passed over
    before can't reach ``overlap`` or ``answer_share``. Rarer words are those of fewer documents, without the documents
    that may be copies of the passage, so that many copies don't make their words common.

    NULL and empty texts contain nothing; benchmark rows without id or words are passed over, equal ones are found
    together; repeated rows are judged alike; an empty benchmark or table flags nothing. Columns of ``docs`` that bear a
    result's name are replaced. Row order in equal shares: the smallest item_id is the best. There is no shuffle of
    texts: the corpus is read once for the frequencies and once for the search (for each pass, see Decontamination).
    """
    docs = docs.drop(*(c for c in ("contaminated", "n_items", "item_ids", "best_item", "overlap", "_found") if c in docs.columns))
    pieces = passages(benchmark, p).distinct()
    per_pass = p.dimensions * p.spaces_per_pass
    passes = math.ceil(pieces.count() / (0.8 * per_pass))
    numbered = pieces.withColumn("pass", F.pmod(F.xxhash64("item_id", "words"), F.lit(max(passes, 1))))
    found = docs.withColumn("_found", F.lit(None).cast("map<bigint,double>"))
    for number in range(passes):
        members = [(r.item_id, np.frombuffer(r.words, dtype=np.uint64)) for r in numbered.where(F.col("pass") == number).sort("item_id", "words").toLocalIterator()]
        if not members:
            continue
        spaces = [Passages(members[k : k + p.dimensions], p) for k in range(0, len(members), p.dimensions)]
        frequencies, documents = document_frequencies(docs, spaces, p)
        for space, frequency in zip(spaces, frequencies, strict=True):
            space.weigh(frequency, documents, p)
        placed = docs.sparkSession.createDataFrame(
            [(k, bytearray(w.tobytes())) for k, s in enumerate(spaces) for w in s.words], "space bigint, words binary")
        latent_axes(placed, spaces, p)
        found = _search(found, spaces, p)
    items = F.array_sort(F.map_keys("_found"))
    best = F.array_max(F.transform(F.map_entries("_found"), lambda e: F.struct(e["value"].alias("share"), (-e["key"]).alias("id"))))
    n = F.coalesce(F.size(F.map_keys("_found")), F.lit(0))
    n = F.when(F.col("_found").isNull(), F.lit(0)).otherwise(n)
    return found.select(
        *docs.columns, (n > 0).alias("contaminated"), n.cast("int").alias("n_items"),
        F.coalesce(items, F.expr("CAST(array() AS array<bigint>)")).alias("item_ids"),
        (-best["id"]).alias("best_item"), best["share"].alias("overlap"))


def _search(docs: DataFrame, spaces: list[Passages], p: Decontamination) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(spaces)
    schema = docs.schema
    names = docs.columns
    text_at, found_at = names.index("text"), names.index("_found")
    binary_text = docs.schema["text"].dataType != T.BinaryType()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [[_masks(w) for w in s.words] for s in shared.value]
        for batch in batches:
            texts = batch.column(text_at)
            texts = texts.cast(pa.binary() if not pa.types.is_large_string(texts.type) else pa.large_binary()) if binary_text else texts
            result = []
            for text, before in zip(texts, batch.column(found_at), strict=True):
                found = dict(before.as_py() or ())
                hashes = _words(text.as_py())
                for space, mask in zip(shared.value, masks, strict=True):
                    for item, share in find(hashes, space, p, mask).items():
                        found[item] = max(share, found.get(item, 0.0))
                result.append(list(found.items()) or None)
            columns = list(batch.columns)
            columns[found_at] = pa.array(result, batch.column(found_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)
