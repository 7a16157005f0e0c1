"""Encoding and decoding with pieces, against the public library."""

from __future__ import annotations

import hashlib
import random
import struct

import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from cloakframe.llm import queries
from cloakframe.llm.pieces import Encoder, decode, encode, parse_model, read_model, spans

PARTS = [
    "a", "b", "the", "foo", "foo#", "<x>", "bar!", "é", "ﬁ", "①", "　", " ", "  ", "   ", "▁", "é", "가", "日本", "𝕏", "\n",
    "\t", "\0", "x", "hello", "World", "123", "ｱﾞ", "<s>", "</s>", "<unk>", "<0x41>", "�", "😀", "​", "ö", "ing", "̀", " ̀",
    "\xa0", "x" * 80,
]


def variant(nfkc=False, squeeze=False, dummy=True, own=False, fallback=True, unused=False) -> bytes:
    """The given model with other rules of normalisation and other kinds of pieces."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(queries.PIECES, "rb") as file:
        proto.ParseFromString(file.read())
    if nfkc:
        rules = sentencepiece_model_pb2.ModelProto()
        rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
        proto.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = squeeze
    proto.normalizer_spec.add_dummy_prefix = dummy
    if own:
        for k, name in zip((300, 301, 302), ("<x>", "foo#", "bar!"), strict=True):
            proto.pieces[k].piece, proto.pieces[k].type = name, 4
    if not fallback:
        proto.trainer_spec.byte_fallback = False
        for piece in proto.pieces:
            piece.type = 1 if piece.type == 6 else piece.type
    if unused:
        for k in range(310, 2000, 7):
            proto.pieces[k].type = 5
    return proto.SerializeToString()


@pytest.mark.parametrize("rules", [
    {}, {"nfkc": True}, {"squeeze": True}, {"nfkc": True, "squeeze": True}, {"dummy": False}, {"own": True},
    {"dummy": False, "squeeze": True}, {"own": True, "nfkc": True, "squeeze": True}, {"fallback": False}, {"unused": True},
    {"fallback": False, "unused": True, "nfkc": True, "own": True}], ids=str)
def test_pieces_as_the_library(rules):
    data = variant(**rules)
    library, model, draw = sentencepiece.SentencePieceProcessor(model_proto=data), parse_model(data), random.Random(3)
    encoder = Encoder(model)
    for _ in range(250):
        text = draw.choice(["", " "]).join(draw.choice(PARTS) for _ in range(draw.randint(0, 14)))
        want = library.encode(text, add_bos=True, add_eos=True)
        ids, begins, ends, counts = encoder.texts([text.encode(), b"", text.encode()])
        n = int(counts[0])
        assert ids[:n].tolist() == want == ids[len(ids) - n :].tolist()
        assert ids[n : n + 2].tolist() == [1, 2]
        proto = library.encode(text, return_type="proto")
        assert list(zip(begins[1 : n - 1].tolist(), ends[1 : n - 1].tolist(), strict=True)) == [(p.begin, p.end) for p in proto.pieces]
        assert model.decode(want) == library.decode(want)
        mixed = [draw.choice([draw.randrange(300), draw.randrange(32000), 198, 172, 259, 260]) for _ in range(draw.randint(0, 8))]
        assert model.decode(mixed) == library.decode(mixed)


def test_pieces_of_a_table(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    texts = [None, "", " ", "one  two", "one  two", "▁ ▁a\0b", "naïve — 日本語 😀 text", "w" * 50_000, "long text " * 30_000]
    docs = spark.createDataFrame(
        [(k if k else None, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, ids string").repartition(3)
    model = read_model(queries.PIECES)
    encoded = encode(docs, model)
    rows = decode(encoded.withColumn("decoded", F.lit(1)), model).collect()
    assert sorted(r.doc_id or 0 for r in rows) == list(range(len(texts)))
    for row in rows:
        text = texts[row.doc_id or 0] or ""
        ids = list(struct.unpack(f"<{len(row.ids) // 4}I", row.ids))
        assert ids == library.encode(text, add_bos=True, add_eos=True)
        assert row.decoded == library.decode(ids)
    # Without blanks dropped, spans cover the text.
    covered = spans(encoded, docs.where("doc_id IS NOT NULL")).groupBy("doc_id").agg(
        F.sum(F.col("end") - F.col("begin")).alias("n"), F.sum(F.octet_length("surface")).alias("m")).collect()
    assert {r.doc_id: (r.n, r.m) for r in covered} == {
        k: (len((t or "").encode()),) * 2 for k, t in enumerate(texts) if k}
    assert decode(encode(docs.limit(0), model), model).count() == 0


def test_piece_digests(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op13(spark, sf).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row.doc_id], add_bos=True, add_eos=True)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
