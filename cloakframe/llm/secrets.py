"""Secrets in texts: known shapes, and strings that compress badly next to a sensitive word."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The shapes and least lengths that define the base spans, in order.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = re.compile(r"(?i:passw|passphrase|secret|token|api.?key|auth|credential|private.?key|signature|bearer|login)", re.ASCII)
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")

# Identifiers and idioms that surround secrets in code and settings, for the compressor's dictionary.
IDENTIFIERS = """
import os sys json self return def class function const let var public private static final void string int true false none null
config settings environment development production database connection username password passwd secret token api_key apikey
access_key secret_key private_key authorization bearer credential certificate signature client_id client_secret refresh_token
http https localhost www com org net example test value default name type data file path user host port index content
aws azure google github gitlab docker kubernetes redis postgres mysql mongodb http://localhost:8080 https://example.com
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 xxxxxxxxxxxxxxxx 0000000000000000 ________________
your_api_key_here replace_me changeme placeholder example_token insert_your_secret
"""
RESULTS = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, base_sha256 string, spans string"


@dataclass(frozen=True)
class Novelty:
    """A candidate is reported if it adds ``least`` compressed bytes or more for each of its characters."""

    context: int = 160
    near: int = 48
    least: float = 0.66
    level: int = 3


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the known shapes, leftmost and non-overlapping for each kind.

    Runs of hex digits are maximal, so a least length inside the pattern drops the same matches as a test after it.
    """
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


class NoveltyScan:
    def __init__(self, p: Novelty):
        self.p = p
        words = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=p.level, dict_data=words, write_checksum=False, write_content_size=False)

    def size(self, data: bytes) -> int:
        return len(self.compressor.compress(data))

    def spans(self, text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Candidates close behind a sensitive word or with one inside, in no known span, whose marginal size is high.

        A candidate is a maximal run of its characters and judged once, so the spans don't overlap; the search is linear.
        """
        words = [m.span() for m in SENSITIVE.finditer(text)]
        if not words:
            return []
        begins, ends = zip(*words, strict=True)
        starts = [s for s, _, _ in known]
        reach = list(itertools.accumulate((e for _, _, e in known), max))
        found = []
        for m in CANDIDATE.finditer(text):
            start, end = m.span()
            before = bisect.bisect_right(ends, start)
            near = before and start - ends[before - 1] <= self.p.near
            inside = before < len(begins) and begins[before] < end
            taken = bisect.bisect_left(starts, end)
            if not (near or inside) or taken and reach[taken - 1] > start:
                continue
            around = (text[max(start - self.p.context, 0) : start] + text[end : end + self.p.context]).encode()
            added = self.size(around + m[0].encode()) - self.size(around)
            if added >= self.p.least * (end - start):
                found.append((start, 3, end))
        return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secrets(docs: DataFrame, p: Novelty = Novelty()) -> DataFrame:
    """Counts and spans of secrets for each row of ``docs (doc_id, text)``.

    Spans are ``kind:start:end`` in code points, end exclusive, ordered by start and kind: ``assign`` (a sensitive name
    given a value of 6 characters or more), ``access`` (key identifiers), ``hex`` (24 digits or more) and ``novel``: a whole
    run of 16 characters or more that begins within ``near`` characters after a sensitive word or has one inside, meets no
    other span, and that a zstandard compressor primed with identifiers cannot shorten even next to the surrounding text. ``base_sha256`` is the digest
    of the first three kinds. NULL texts count as empty; the digest of no span is that of the empty string; repeated
    rows are judged alike; other columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = NoveltyScan(p)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + scan.spans(text, base))
                counts = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, RESULTS)
