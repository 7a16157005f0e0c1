"""Token counts by greedy longest match, in one pass over each word."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A vocabulary is broadcast; larger ones are refused.
MAX_PIECES = 1_000_000
#: Word lengths that a task remembers before it starts afresh.
REMEMBERED = 200_000
RESULTS = "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint"


class LongestMatch:
    """A trie over a vocabulary with failure links, for the number of pieces alone.

    Where no edge leads on from a node, its failure link goes to the node of what remains of its string after the
    longest pieces at its start are popped, and ``popped`` has their number. Links are followed at most once for each
    byte read, so a word of n bytes takes O(n) steps and no piece is ever built. Pieces at the start of a word hang
    under one root, the ones inside under another.
    """

    def __init__(self, initial: Iterable[bytes], inner: Iterable[bytes], prefix: bytes = b""):
        self.prefix = prefix
        self.edges: dict[int, int] = {}
        ends = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    if (after := self.edges.get(key)) is None:
                        after = self.edges[key] = len(ends)
                        ends.append(False)
                    node = after
                if piece:
                    ends[node] = True
        if len(ends) > MAX_PIECES * 16:
            raise ValueError(f"the vocabulary has more than {MAX_PIECES} pieces of usual length")
        self.fail = [-1] * len(ends)
        self.popped = [0] * len(ends)
        children: dict[int, list[tuple[int, int]]] = {}
        for key, child in self.edges.items():
            children.setdefault(key >> 8, []).append((key & 255, child))
        level = [0, 1]
        while level:
            following = []
            for parent in level:
                for byte, child in children.get(parent, ()):
                    following.append(child)
                    if ends[child]:
                        self.fail[child], self.popped[child] = 1, 1
                        continue
                    node, count = self.fail[parent], self.popped[parent]
                    while node >= 0 and (node << 8 | byte) not in self.edges:
                        count += self.popped[node]
                        node = self.fail[node]
                    if node >= 0:
                        self.fail[child], self.popped[child] = self.edges[node << 8 | byte], count
            level = following

    def count(self, word: bytes) -> int | None:
        """Number of pieces; None if some part of the word is in no piece."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node = total = 0
        for byte in self.prefix + word:
            while (after := edges.get(node << 8 | byte)) is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return None
            node = after
        while node != 1:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return None
        return total


def ranked_pieces(path: str) -> tuple[list[bytes], list[bytes], bytes]:
    """Pieces of a rank file (base64 piece, rank a line): those with a leading blank start a word."""
    with open(path, "rb") as lines:
        pieces = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    if len(pieces) > MAX_PIECES:
        raise ValueError(f"{path} has more than {MAX_PIECES} pieces")
    return [p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "], b" "


def token_counts(docs: DataFrame, automaton: LongestMatch) -> DataFrame:
    """``(doc_id, n_words, n_tokens, n_unknown)`` for each row of ``docs (doc_id, text)``.

    Words are runs of UTF-8 bytes without blank or 0x09-0x0D; each is cut greedily into the longest pieces. A word with a
    part in no piece is one token and counts in ``n_unknown``. NULL and empty texts have zeros; repeated rows count
    alike; a NULL doc_id stays; other columns are ignored. The automaton is broadcast, its size bounded by MAX_PIECES.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = shared.value, {}
        for batch in batches:
            words, tokens, unknown = [], [], []
            for text in batch.column(1):
                parts = (text.as_py() or b"").split()
                total = bad = 0
                for word in parts:
                    n = known.get(word)
                    if n is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        n = machine.count(word)
                        n = known[word] = -1 if n is None else n
                    if n < 0:
                        bad += 1
                        total += 1
                    else:
                        total += n
                words.append(len(parts))
                tokens.append(total)
                unknown.append(bad)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))],
                names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(run, RESULTS)


def counter(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Token counts with the vocabulary file at ``path``, which the driver reads."""
    return token_counts(docs, LongestMatch(*ranked_pieces(path)))
