"""Phrases against counting every phrase of every piece."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.llm.collocations import WORDS, Block, Collocations, Summary, alike, collocations, parts


def plain(rows, p):
    """All results by direct counting, ``rows`` of (lang, text)."""
    total, counts = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, p.longest + 1):
                for k in range(len(words) - n + 1):
                    counts[lang, tuple(words[k : k + n])] += 1
    out = collections.defaultdict(list)
    frequent = {k: a for k, a in counts.items() if len(k[1]) >= 2 and a >= p.threshold}
    inside = {(lang, q[i:j]) for (lang, q), a in frequent.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1)
              if j - i < len(q) and a >= counts[lang, q[i:j]]}
    for (lang, q), a in frequent.items():
        if (lang, q) in inside:
            continue
        score, _, left, right = min(
            (1000 * a * total[lang] // (counts[lang, q[:k]] * counts[lang, q[k:]]), k, counts[lang, q[:k]], counts[lang, q[k:]])
            for k in range(1, len(q)))
        out[lang].append((-score, -a, " ".join(q).encode(), left, right))
    return sorted(
        (lang, rank, q.decode(), -a, left, right, total[lang], -score)
        for lang, found in out.items() for rank, (score, a, q, left, right) in enumerate(sorted(found)[: p.top], 1))


def run(spark, rows, p, slices=3):
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"n": F.lit("x"), "words": F.lit(1)}).repartition(slices)
    return sorted(tuple(r) for r in collocations(docs, p).collect())


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["été", "😀", "The", "a-b", "ÀB"]
    phrases = ["new york city", "once upon a time", "a a a a a a", "x y", "the end of the line"]
    out = [(None, None), ("en", ""), ("en", " \t\n\x0b"), (None, "x y x y"), ("und", "x y. x\ty, x  y")]
    for k in range(300):
        words = [draw.choice(vocabulary) if draw.random() < 0.8 else draw.choice(phrases) for _ in range(draw.randrange(40))]
        text = "".join(w + draw.choice([" ", " ", "  ", "\t", ". ", "\n", "\r\n", "; ", "!"]) for w in words)
        out.append((draw.choice(["en", "en", "en", "de", None, "und"]), text))
    return out + [out[9]] * 40


@pytest.mark.parametrize("p", [
    Collocations(threshold=3, top=100_000, bits=20), Collocations(threshold=20, top=7, bits=20), Collocations(threshold=5, longest=2, bits=20),
    Collocations(threshold=6, longest=4, capacity=100, flush=500, remembered=50, bits=12, top=50, block=150)], ids=str)
def test_collocations(spark, rows, p):
    assert run(spark, rows, p) == plain(rows, p)


def test_one_long_text_and_no_text(spark):
    p = Collocations(threshold=50, bits=20, block=5000)
    draw = random.Random(1)
    text = " ".join(draw.choice(["a", "b", "c", "long" * 300]) for _ in range(20_000))
    assert run(spark, [("en", text)], p) == plain([("en", text)], p)
    assert run(spark, [], p) == []
    assert run(spark, [(None, None)], p) == []


def test_parts_overlap():
    text = b"one two three, four " + b"x" * 50 + b" five six seven eight nine ten"
    got = list(parts(text, 3, 10))
    assert len(got) > 2
    words = [w for part, old in got for w in WORDS.findall(part)[old:]]
    assert words == WORDS.findall(text)
    assert list(parts(b"", 3, 10)) == [(b"", 0)]
    assert len(Block([b"", b"a b"], [0, 1], [0, 0], True).starts) == 2


def test_summary_keeps_the_frequent():
    """Merged summaries miss no item of the threshold, however the mass is spread."""
    draw = np.random.default_rng(2)
    for skew in (1.1, 2.0):
        items = np.concatenate([draw.zipf(skew, 60_000) % 5_000, draw.integers(10_000, 10**9, 60_000)]).astype(np.uint64)
        draw.shuffle(items)
        threshold = 60
        capacity = len(items) // threshold + 1
        whole = Summary(capacity, threshold)
        for part in np.array_split(items, 23):
            one = Summary(capacity, threshold)
            for few in np.array_split(part, 5):
                one.add(*np.unique(few, return_counts=True))
            one.settle()
            whole.add(one.items, one.counts, one.undercount)
        whole.settle()
        exact = dict(zip(*np.unique(items, return_counts=True), strict=True))
        left = dict(zip(whole.items, whole.counts, strict=True))
        assert whole.undercount < threshold and len(left) <= capacity
        assert all(exact[i] - whole.undercount <= n <= exact[i] for i, n in left.items())
        assert all(i in left for i, n in exact.items() if n >= threshold)


def test_two_phrases_of_one_hash():
    at = np.arange(6)
    hashes = np.array([7, 7, 5, 7, 5, 9], dtype=np.uint64)
    assert alike(at, hashes, np.zeros(6, dtype=np.uint64)) == ([2, 0, 5], [2, 3, 1])
    places, counts = alike(at, hashes, np.array([1, 2, 3, 1, 3, 1], dtype=np.uint64))
    assert sorted(zip(counts, places, strict=True)) == [(1, 1), (1, 5), (2, 0), (2, 2)]
    assert alike(at[:0], hashes[:0], hashes[:0]) == ([], [])
