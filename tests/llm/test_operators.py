"""Operators against brute force on small tables with NULLs, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cloakframe.llm import classifier, decontaminate, licences, mixing, near_dup, quality, secrets, sharding, tokens, urls
from cloakframe.llm.components import components
from cloakframe.llm.words import LEXICAL, shingles, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def hard():
    """Awkward rows: NULLs, empty, blank, very long, repeated, copies, one source with most rows."""
    long = words(30_000, 1, 5000)
    base = words(80, 2)
    changed = base.split()
    changed[40] = "other"
    line = "the same line of words again"
    rows = [
        (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n\x0b ", "de", None, 4),
        (4, long, "en", "a", 1), (5, base, "en", "a", 1), (6, base, "en", "b", 1), (7, " ".join(changed), "en", "b", 1),
        (8, "\n".join([line] * 30), "en", "a", 1), (9, "one", "fr", "c", 1), (10, "one", "fr", "c", 1),
        (11, base.upper().replace("W", "w"), "en", "a", 1), (12, "Ünï <b> #1 $2 \u00a0x\u2003y 😀", "es", "a", 1),
    ]
    rows += [rows[5]] * 3 + [(20 + k, words(40 + k % 7, 100 + k % 20), "en", "a", 1) for k in range(60)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, hard):
    return spark.createDataFrame(hard, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, *names):
    return df.withColumns({n: F.lit("clash") for n in names})


# ------------------------------------------------------------------ words


def test_word_hashes_part_like_the_pattern():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("ab \t\n\x0b\x0c\r\x1c\u00a0é") for _ in range(rng.randrange(60)))
        parts = WORD.findall(text)
        hashes = word_hashes(text.encode())
        assert len(hashes) == len(parts)
        same = {(x == y, hashes[i] == hashes[j]) for (i, x), (j, y) in itertools.combinations(enumerate(parts), 2)}
        assert same <= {(True, True), (False, False)}
    huge = (b"x" * 3_000_000) + b" " + b"ab " * 700_000
    assert len(word_hashes(huge)) == 700_001
    assert len(word_hashes(b"it's OK!! x2", LEXICAL)) == 6


# ------------------------------------------------------------------ 1 tokens


def greedy(word, initial, inner):
    n, rest, pieces = 0, word, initial
    while rest:
        best = max((k for k in range(1, len(rest) + 1) if rest[:k] in pieces), default=0)
        if not best:
            return None
        n, rest, pieces = n + 1, rest[best:], inner
    return n


def test_longest_match_equals_greedy():
    rng = random.Random(5)
    for _ in range(60):
        piece = lambda: bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5)))
        initial, inner = {piece() for _ in range(12)}, {piece() for _ in range(12)}
        machine = tokens.LongestMatch(initial, inner)
        for _ in range(100):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
            assert machine.count(word) == greedy(word, initial, inner)


def test_token_counts(spark, docs, hard):
    machine = tokens.LongestMatch([b" w", b" "], [bytes([b]) for b in range(48, 256)] + [b"12", b"123"], b" ")
    got = tokens.token_counts(clashing(docs, "n_tokens"), machine).collect()
    assert len(got) == len(hard) and tokens.token_counts(empty(spark), machine).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert (by[2]["n_words"], by[2]["n_tokens"]) == (0, 0) and by[9]["n_tokens"] == 4
    assert by[12]["n_unknown"] == 2 and by[4]["n_words"] == 30_000


# ------------------------------------------------------------------ 2 quality


def plain_metrics(text):
    text = text or ""
    w = WORD.findall(text)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_metrics(spark, docs, hard):
    got = quality.quality(clashing(docs, "kept", "n_words")).collect()
    assert len(got) == len(hard) and quality.quality(empty(spark)).count() == 0
    for r in got:
        want = plain_metrics(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality(docs).where("kept").count() == sum(r["kept"] for r in got)


def test_quality_verdicts(spark):
    prose = "The house and the garden of it is that for on with as was by at this one from here, are not or an old one."
    rows = [(1, prose), (2, " ".join(f"{w}###" for w in prose.split())), (3, prose.upper().replace(" ", "!! "))]
    rows.append((4, " ".join(f"{w} {w} {w} {w} {w} {w} {w}" for w in prose.split()[:9])))
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False}


# ------------------------------------------------------------------ 3 near duplicates


def plain_components(rows, n, percent=80):
    sets = []
    for _, text in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(d, len(s), least.get(root(i)) if s or d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(spark, docs, hard, n):
    got = near_dup.near_duplicates(clashing(docs, "kept", "component_id"), near_dup.NearDup(words=n)).collect()
    want = plain_components([r[:2] for r in hard], n)
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == collections.Counter(want)
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got)
    assert near_dup.near_duplicates(empty(spark)).count() == 0


def test_near_copies_that_only_chain(spark):
    """A group whose members drift apart: links exist between neighbours, not to one middle; blocks are small."""
    rng = random.Random(8)
    text, rows = words(120, 9).split(), []
    for k in range(60):
        rows.append((k, " ".join(text)))
        text = text[:]
        text[rng.randrange(120)] = f"new{k}"
    rng.shuffle(rows)
    p = near_dup.NearDup(words=4, block=7)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), p).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(d, c) for d, _, c in plain_components(rows, 4)}


def test_two_texts_under_one_id(spark):
    """Rows are linked by their own texts, also rows without id; an id names none of them alone."""
    a, b = words(60, 21).split(), words(60, 22).split()
    change = lambda text, *at: " ".join("new" if k in at else w for k, w in enumerate(text))
    rows = [(7, change(a)), (7, change(b)), (3, change(a, 59)), (5, change(b, 59)), (None, change(a, 0)), (None, change(b, 0)),
            (9, change(words(60, 23).split())), (None, change(words(60, 24).split()))]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), near_dup.NearDup(words=4)).collect()
    want = plain_components(rows, 4)
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == collections.Counter(want)
    assert {c for d, _, c in want if d == 7} == {3, 5}


def test_repeated_rows_are_confirmed_once(spark, monkeypatch):
    """Very many equal rows of one id cost one set, and their near copies one pair each."""
    base = words(120, 31).split()
    rows = [(7, " ".join(base))] * 2000 + [(100 + k, " ".join("x%d" % k if i == k else w for i, w in enumerate(base))) for k in range(100)]
    met = []
    confirm = near_dup._confirm

    def counting(pairs, sets, p):
        met.append((pairs.count(), sets.count(), sets.select("node").distinct().count(), pairs.join(sets, pairs["a"] == sets["node"]).count()))
        return confirm(pairs, sets, p)

    monkeypatch.setattr(near_dup, "_confirm", counting)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = near_dup.near_duplicates(df, near_dup.NearDup(words=4)).collect()
    assert {r["component_id"] for r in got} == {7} and len(got) == 2100
    for pairs, sets, nodes, joined in met:
        assert sets == nodes <= 101 and joined == pairs


def test_sketch_estimates_high_similarity():
    p, rng = near_dup.NearDup(), np.random.default_rng(1)
    for wanted in (0.7, 0.8, 0.9):
        errors = []
        for _ in range(20):
            both = int(2 * 2000 * wanted / (1 + wanted))
            pool = rng.integers(0, 2**63, 4000 - both, dtype=np.uint64)
            a, b = pool[:2000], np.concatenate((pool[:both], pool[2000:]))
            x, y = (near_dup.odd_sketch(near_dup.samples_of(near_dup.minhashes(s, p.samples)), p.sketch_bits) for s in (a, b))
            z = sum(int(v).bit_count() for v in x ^ y)
            estimate = 1 + p.sketch_bits / (4 * p.samples) * math.log(1 - 2 * z / p.sketch_bits)
            errors.append(estimate - wanted)
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.12


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (21, 20)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}


# ------------------------------------------------------------------ 4 secrets


def test_secrets(spark, docs, hard):
    key = "AKIA" + "Q7ZK2M4P" * 2
    texts = [
        f"é password=abcdef12 token: 'short' x {key} {'0af3' * 7}", "API_KEY = Zz9/+=._-x secret:abc", "\u017fecret=abcdefgh", None, "",
        "authorization header follows: q8ZtR4mXw1LpV7nBc3Ys here", "authorization header follows: aaaaaaaaaaaaaaaaaaaaaaaa here",
    ]
    rows = {r["doc_id"]: r for r in secrets.secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert rows[0]["spans"].startswith("assign:2:19,") and (rows[0]["n_assign"], rows[0]["n_access"], rows[0]["n_hex"]) == (1, 1, 1)
    assert rows[1]["spans"] == "assign:0:20" and rows[2]["spans"] == ""
    assert rows[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[5]["n_novel"] == 1 and rows[6]["n_novel"] == 0
    assert secrets.secrets(clashing(docs, "spans")).count() == len(hard) and secrets.secrets(empty(spark)).count() == 0


def test_long_secrets_are_whole():
    rng = random.Random(8)
    blob = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(3000))
    text = f"private key follows: {blob} end"
    assert secrets.NoveltyScan(secrets.Novelty()).spans(text, []) == [(21, 3, 3021)]


def plain_spans(text, scan):
    """Both kinds of spans, place by place."""
    word = lambda c: c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    base = []
    for kind, pattern, fits in (
        (0, secrets.ASSIGN, lambda m: len(m[2]) >= 6), (1, secrets.ACCESS, lambda m: len(m[0]) >= 20), (2, re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)):
        at = 0
        while at < len(text):
            m = pattern.match(text, at)
            if m and fits(m):
                base.append((at, kind, m.end()))
            at = m.end() if m else at + 1
    novel = []
    for start in range(len(text)):
        if not word(text[start]) or start and word(text[start - 1]):
            continue
        end = next((k for k in range(start, len(text)) if not word(text[k])), len(text))
        sensitive = [m.span() for m in secrets.SENSITIVE.finditer(text)]
        close = any(e <= start <= e + scan.p.near or s < end and e > start for s, e in sensitive)
        if end - start < 16 or not close or any(s < end and start < e for s, _, e in base):
            continue
        around = (text[max(start - scan.p.context, 0) : start] + text[end : end + scan.p.context]).encode()
        if scan.size(around + text[start:end].encode()) - scan.size(around) >= scan.p.least * (end - start):
            novel.append((start, 3, end))
    return sorted(base), novel


def test_spans_against_brute_force():
    rng, scan, met = random.Random(17), secrets.NoveltyScan(secrets.Novelty()), 0
    key = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    for _ in range(150):
        parts = [rng.choice((
            "token", "secret=", "api_key: ", "AKIA", "auth ", "é", " ", "\n", "login", "passw", "the word ", "'", "x" * rng.randint(1, 60),
            key(rng.randint(2, 50)), "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(10, 30))))) for _ in range(rng.randint(1, 14))]
        text = "".join(parts)
        base, novel = plain_spans(text, scan)
        assert secrets.base_spans(text) == base and scan.spans(text, base) == novel, text
        met += len(novel)
    assert met > 30


def test_one_span_for_several_words_in_a_string():
    rng = random.Random(9)
    key = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    text = f"auth header: {key()}token{key()} end"
    scan = secrets.NoveltyScan(secrets.Novelty())
    assert scan.spans(text, []) == [(13, 3, 98)]
    begin = time.process_time()
    scan.spans("secret_" * 150_000, [])
    assert time.process_time() - begin < 5


# ------------------------------------------------------------------ 5 classifier


def test_a_repeated_id_is_learned_once(spark, monkeypatch):
    rows = [(1, f"zip zap {k}") for k in range(500)] + [(k, "alpha beta") for k in range(2, 60)]
    labels = [(k, k % 2) for k in range(1, 60)]
    seen = []

    fit = classifier.Network.__init__

    def counted(self, x, y, p):
        seen.append(len(x))
        fit(self, x, y, p)

    monkeypatch.setattr(classifier.Network, "__init__", counted)
    got = classifier.classify(
        spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int"), classifier.Classifier(epochs=1))
    assert got.count() == len(rows) and seen[0] == sum(zlib.crc32(str(k).encode()) % 5 > 0 for k in range(1, 60))


def test_word_vectors(spark):
    text = words(400, 77)
    docs = spark.createDataFrame([(text,)], "text string")
    whole = classifier.word_vectors(docs, classifier.Classifier(buckets=64))
    places, signs = classifier._index_vectors(classifier.Classifier(buckets=64))
    ids = classifier._buckets(text.encode(), classifier.Classifier(buckets=64))
    total = np.zeros((64, 48))
    for i in range(len(ids)):
        for j in range(max(i - 2, 0), min(i + 3, len(ids))):
            if i != j:
                np.add.at(total[ids[i]], places[ids[j]], signs[ids[j]])
    vectors = np.sign(total) * np.log1p(np.abs(total))
    vectors -= vectors[vectors.any(axis=1)].mean(axis=0)
    assert np.allclose(whole, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6), atol=1e-4)


def test_classifier_learns_and_holds_out(spark):
    rng, rows, labels = random.Random(2), [], []
    for k in range(600):
        good = k % 3 > 0
        rows.append((k, " ".join(rng.choice(("alpha", "beta", "gamma", "delta") if good else ("zip", "zap", "###", "zop")) for _ in range(30))))
        labels.append((k, int(good) if k % 5 else None))
    rows += [(None, None), (1000, ""), (1001, None), (0, rows[0][1])]
    frame = clashing(spark.createDataFrame(rows, "doc_id bigint, text string"), "score")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = classifier.classify(frame, marks, classifier.Classifier(epochs=5)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    seen = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600]
    assert np.mean([(r["score"] > 0.5) == (r["doc_id"] % 3 > 0) for r in seen if r["held_out"]]) > 0.95
    flipped = spark.createDataFrame([(k, q if q is None or zlib.crc32(str(k).encode()) % 5 else 1 - q) for k, q in labels], "doc_id bigint, quality int")
    again = classifier.classify(frame, flipped, classifier.Classifier(epochs=5)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["score"])
    assert [r["score"] for r in sorted(again, key=key)] == pytest.approx([r["score"] for r in sorted(got, key=key)])
    nothing = classifier.classify(frame, marks.limit(0)).collect()
    assert {r["score"] for r in nothing} == {0.5}
    assert classifier.classify(empty(spark), marks).count() == 0


# ------------------------------------------------------------------ 6 urls


def plain_rule(host, path, rules):
    fits = [(r.partition("/")[0].count("."), len(r.partition("/")[2]), v == "block", v, r) for v, r in rules
            if ("." + host).endswith("." + r.partition("/")[0]) and path.startswith("/" + r.partition("/")[2])]
    return max(fits)[3:] if fits else None


def test_url_rules():
    rng = random.Random(4)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    path = lambda: "/" + "".join(rng.choice(("a/", "b/", "a", "b", "/")) for _ in range(rng.randint(0, 4)))
    for _ in range(50):
        rules = list({host() + path(): rng.choice(("allow", "block")) for _ in range(8)}.items())
        rules = [(v, r) for r, v in rules]
        trie = urls.RuleTrie(rules)
        for _ in range(60):
            h, p = host(), rng.choice(("", path()))
            assert trie.lookup(h, p) == plain_rule(h, p, rules), (h, p, rules)


def test_url_parts(spark):
    cases = {"http://A.Com/x?q#f": ("a.com", "/x"), "x://h?a/b": ("h", ""), "nothing": ("", ""), None: ("", ""), "s://u@h:8/p://q": ("u@h:8", "/p://q")}
    rows = list(enumerate(cases))
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string"), [("block", "com/")]).collect()
    assert [(r["host"], r["path"]) for r in got] == list(cases.values())
    assert [r["verdict"] for r in got] == ["block"] + ["allow"] * 4
    assert urls.filter_urls(spark.createDataFrame([], "page_id bigint, url string"), []).count() == 0


# ------------------------------------------------------------------ 7 licences


def test_licences(spark, docs, hard):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this.\n"
           "The above copyright notice and this permission notice shall be included in all copies. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT.")
    texts = ["Licensed under CC BY-NC 4.0.", "# This work is licensed  under the GNU General Public License, version 3. Or (at your option) any later version.",
             mit, "Copyright 2020 Me. All rights reserved.", "we like licensed cars", None]
    got = {r["doc_id"]: r for r in licences.licences(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [got[k]["licences"] for k in range(6)] == ["CC-BY-NC", "GPL-3.0-or-later", "MIT", "Proprietary", "", ""]
    assert got[2]["sentence_ids"] == "<mit_grant><mit_notice><as_is>" and got[2]["unmatched"] == "" and got[5]["n_sentences"] == 0
    assert licences.licences(clashing(docs, "licences")).count() == len(hard) and licences.licences(empty(spark)).count() == 0


NOTICES = {
    "MIT": """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.""",
}


def test_published_notices(spark):
    """Wrapped as they are published, and in comments of several kinds."""
    block = lambda t: "/*\n" + "".join(f" * {x}".rstrip() + "\n" for x in t.split("\n")) + " */\nint main() { return 0; }"
    forms = [lambda t: t, block, *(lambda t, m=m: "\n".join(f"{m} {x}".rstrip() for x in t.split("\n")) + "\n\ncode = 1" for m in ("#", "//", "--", ";;")),
             lambda t: t.replace("\n", "\r\n")]
    rows = [(name, form(text)) for name, text in NOTICES.items() for form in forms]
    frame = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["licences"] for r in licences.licences(frame).select("doc_id", "licences").collect()}
    assert got == {k: name for k, (name, _) in enumerate(rows)}


def test_every_licence_sentence_is_looked_at(spark):
    """One sentence of the fewest words for each identifier, also with wide blanks, and each verb before a CC licence."""
    given = [(f"{verb} under {name} 4.0", i) for verb in ("Licensed", "This work is released", "Distributed", "Available", "Published")
             for name, i in (("CC BY", "cc_by"), ("CC BY-SA", "cc_by_sa"), ("CC BY-NC", "cc_nc"))]
    least = [(f"SPDX-License-Identifier: {n}", i) for n, i in (("MIT", "spdx_mit"), ("Apache-2.0", "spdx_apache2"), ("BSD-2-Clause", "spdx_bsd"), ("GPL-3.0", "spdx_gpl3"), ("GPL-2.0", "spdx_gpl2"))]
    least += [(f"Released under the {n}", i) for n, i in (
        ("Apache License version 2.0", "apache2"), ("MIT License", "mit"), ("BSD License", "bsd"), ("Lesser General Public License version 2", "lgpl"),
        ("Affero General Public License version 3", "agpl3"), ("General Public License version 3", "gpl3"), ("General Public License version 2", "gpl2"))]
    free = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published "
            "by the Free Software Foundation, either version {} of the License, or (at your option) any later version")
    least += [(free.format(n, v), i) for n, v, i in (
        ("General Public License", 3, "gpl3_later"), ("General Public License", 2, "gpl2_later"),
        ("Lesser General Public License", 3, "lgpl_later"), ("Affero General Public License", 3, "agpl3_later"))]
    least += [
        ("CC0", "cc0"), ("This work is dedicated to the public domain", "cc0"), ("or at your option any later version", "later"),
        ("You may not use this file except in compliance with the license", "apache_use"), ("You may obtain a copy of the license at x", "apache_copy"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy x", "mit_grant"),
        ("The above copyright notice and this permission notice shall be included x", "mit_notice"),
        ("Redistribution and use in source and binary forms, x", "bsd_redist"), ("Redistributions of source code must retain x", "bsd_source"),
        ("Redistributions in binary form must reproduce x", "bsd_binary"), ("Neither the name of x may be used to endorse x", "bsd_endorse"),
        ("The software is provided as is x", "as_is"), ("All rights reserved", "all_rights"), ("Copyright x", "copyright")]
    assert {i for _, i in given + least} == {i for i, _ in licences.SENTENCES}
    cases = [(t.replace(" ", gap), i) for t, i in given + least for gap in (" ", "  ", "\t")]
    rows = [(k, t) for k, (t, _) in enumerate(cases)]
    got = {r["doc_id"]: r["sentence_ids"] for r in licences.licences(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "sentence_ids").collect()}
    assert got == {k: f"<{i}>" for k, (_, i) in enumerate(cases)}


# ------------------------------------------------------------------ 8 mixing


def plain_targets(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, fixed, total = {}, set(), sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[s] for s in fixed)
        free = [s for s in names if s not in fixed]
        target = {s: cap * sizes[s] if s in fixed else left * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            return target
        fixed |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 5}, {"a": 1}, {f"s{k}": (k * 37) % 50 for k in range(20)}, {"x": 0, "y": 7}, {"z": 0}])
def test_water_filling(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(frame, mixing.WEIGHTS, 3).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix(spark, docs, hard):
    got = mixing.mix(clashing(docs, "taken", "size")).collect()
    assert len(got) == len(hard) and mixing.mix(empty(spark)).count() == 0
    sizes = collections.Counter()
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["taken"] == r["size"] * r["repeats"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
    target = plain_targets(sizes)
    for s in sizes:
        rows = [r for r in got if r["source"] == s]
        assert rows[0]["target"] == pytest.approx(target[s]) and {r["source_size"] for r in rows} == {sizes[s]}
        assert abs(sum(r["taken"] for r in rows) - target[s]) <= max(r["size"] for r in rows) / 2 + max(
            r["size"] * c for r, c in ((x, sum(y == x for y in rows)) for x in rows))
    key = lambda r: repr(r)
    assert sorted(mixing.mix(docs).collect(), key=key) == sorted(mixing.mix(docs.repartition(5)).collect(), key=key)


# ------------------------------------------------------------------ 9 shards


def test_hilbert_visits_neighbours(spark):
    bits, cells = 3, list(itertools.product(range(8), repeat=3))
    frame = spark.createDataFrame(cells, "a int, b int, c int")
    rows = sharding.hilbert(frame, [F.col("a"), F.col("b"), F.col("c")], "h", bits).sort("h").collect()
    assert [r["h"] for r in rows] == list(range(512))
    assert all(sum(abs(x - y) for x, y in zip(p[:3], q[:3])) == 1 for p, q in itertools.pairwise(rows))


def test_shards(spark, docs, hard):
    got = sharding.shards(clashing(docs, "size", "shard"), 16).collect()
    assert len(got) == len(hard) and sharding.shards(empty(spark)).count() == 0
    counts = collections.Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) <= set(range(16))
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    for r in got:
        data = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
    few = sharding.shards(docs.limit(5), 16).collect()
    assert len({(r["shard"], r["slot"]) for r in few}) == 5


# ------------------------------------------------------------------ 10 decontamination


def test_decontamination(spark, docs, hard):
    items = [(k, words(14 + 4 * k, 900 + k, 50_000)) for k in range(12)]
    half = items[9][1].split()
    noise = lambda s: words(150, s)
    rows = [(k, f"{noise(k)} {t.upper()} {noise(k + 50)}") for k, t in items]
    rows += [(50, " ".join(w for i, w in enumerate(half) if i % 6)), (51, noise(70)), (52, " ".join(half[:8])), (53, None), (54, "")]
    bench = spark.createDataFrame([*items, (None, "x y z"), (70, None), (71, " "), items[3]], "item_id bigint, text string")
    frame = clashing(spark.createDataFrame(rows, "doc_id bigint, text string"), "overlap")
    for p in (decontaminate.Decontamination(), decontaminate.Decontamination(dimensions=5, spaces_per_pass=1)):
        got = {r["doc_id"]: r for r in decontaminate.decontaminate(frame, bench, p).collect()}
        assert all(got[k]["item_ids"] == [k] and got[k]["overlap"] == 1.0 for k in range(12))
        assert got[50]["item_ids"] == [9] and not any(got[k]["contaminated"] for k in (51, 52, 53, 54))
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs, bench).count() == len(hard)
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0


def kept_words(text, share, seed):
    """The text with words replaced, of which at least ``share`` stay."""
    rng, parts = random.Random(seed), text.split()
    gone = set(rng.sample(range(len(parts)), len(parts) - math.ceil(share * len(parts))))
    return " ".join(f"z{seed}x{i}" if i in gone else w for i, w in enumerate(parts))


def plain_found(rows, passages, p):
    """Items of ``(item, words)`` found in each row by trying every passage at every window."""
    number = collections.defaultdict(itertools.count().__next__)
    windows = {}
    for k, text in rows:
        parts = text.split()
        windows[k] = [parts[max(b - p.margin, 0) : b + p.window + p.margin] for b in range(0, max(len(parts) - p.window, 0) + p.stride, p.stride)]
    found = {k: set() for k, _ in rows}
    for item, passage in passages:
        masks, whole = decontaminate._masks(np.array([number[w] for w in passage])), collections.Counter(passage)
        copies = {k: [w for w in regions if sum((collections.Counter(w) & whole).values()) >= p.overlap * len(passage)] for k, regions in windows.items()}
        frequency = collections.Counter(w for k, text in rows if not copies[k] for w in whole.keys() & set(text.split()))
        rare = sorted(whole, key=lambda w: (frequency[w], int(word_hashes(w.encode())[0])))
        rare = rare[: math.ceil(p.answer_part * len(rare))]
        for k, regions in copies.items():
            for region in regions:
                order = decontaminate.common_subsequence(masks, len(passage), np.array([number[w] for w in region]))
                if order / len(passage) >= p.overlap and sum(w in region for w in rare) >= p.answer_share * len(rare):
                    found[k].add(item)
    return found


def test_decontamination_of_long_passages(spark):
    """Long passages only, of which 60 to 75 % of words are kept, and many inexact copies of one of them."""
    p = decontaminate.Decontamination()
    items = [(k, words(62, 2000 + k, 3000)) for k in range(30)]
    shares = (0.6, 0.65, 0.7, 0.75)
    rows = [(k, f"{words(30 + k, k, 3000)} {kept_words(t, shares[k % 4], k)} {words(50, k + 500, 3000)}") for k, t in items]
    rows += [(100 + k, kept_words(items[3][1], 0.7, 7)) for k in range(20)] + [(200 + k, words(120, 300 + k, 3000)) for k in range(10)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    got = {r["doc_id"]: set(r["item_ids"]) for r in decontaminate.decontaminate(frame, bench, p).collect()}
    assert got == plain_found(rows, [(k, t.split()) for k, t in items], p)
    assert all(3 in got[100 + k] for k in range(20)) and sum(k in got[k] for k in range(30)) >= 28


def test_common_subsequence():
    rng = random.Random(6)
    for _ in range(100):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        masks = decontaminate._masks(np.array(a))
        assert decontaminate.common_subsequence(masks, len(a), np.array(b)) == table[-1][-1]


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages(spark, tmp_path):
    """Each stage against brute force on its own input."""
    bench = [(0, words(30, 777, 50_000))]
    prose = "the and of to a in is that it for on with as was be by at this from are".split()
    rng = random.Random(12)
    text = lambda k: " ".join(rng.choice(prose) if rng.random() < 0.3 else f"w{rng.randrange(3000)}" for _ in range(60 + k % 9))
    rows = [(k, text(k), "en", f"s{k % 3}", 1) for k in range(40)]
    near = rows[0][1].split()
    near[-1] = "changed"
    rows += [(100, rows[1][1], "en", "s0", 1), (101, " ".join(near), "en", "s0", 1), (102, "too short", "en", "s0", 1)]
    rows += [(103, f"{rows[2][1]} {bench[0][1]} {rows[3][1]}", "en", "s1", 1), (104, None, None, None, None)]
    rows += [rows[5]] * 2 + [rows[40]]  # repeated rows, of a document that stays and of one that goes
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), SCHEMA)
        ids[name] = collections.Counter(r["doc_id"] for r in docs.collect())
    assert set(ids["quality_rules"]) == {*range(40), 100, 101, 103}
    assert ids["near_dedup"] == collections.Counter([*range(40), 103])
    assert set(ids["decontamination"]) == set(range(40))
    assert set(ids["mixing"]) <= set(range(40)) and max(ids["mixing"].values()) <= 3
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert collections.Counter(r["doc_id"] for r in final.collect()) == ids["mixing"]
