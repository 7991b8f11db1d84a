"""The queries against plain versions, on the smallest tables."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
from docweft.llm import queries as Q


def rows(spark, sf, name):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]


def got(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_chat(spark, sf):
    data = rows(spark, sf, "conversations") + [{"conv_id": -7, "turn": i, "role": r, "text": Q.PLANTED} for i, r in enumerate(("user", "assistant"))]
    found = {r[0]: r[1:] for r in got(Q.op1_chat_format(spark, sf), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")}
    assert found == brute.chat(data)


def test_topk(spark, sf):
    found = got(Q.op2_exact_topk(spark, sf), "query_id", "rank", "vec_id", "score")
    assert len(found) == len(set(found)) and set(found) == brute.topk(rows(spark, sf, "embeddings"))


def test_exact_dedup(spark, sf):
    found = got(Q.op3_exact_dedup(spark, sf), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert Counter(found) == Counter(brute.dedup(rows(spark, sf, "documents")))


def test_near_dedup(spark, sf):
    found = got(Q.op6_near_dedup(spark, sf), "doc_id", "n_shingles", "component_id", "kept")
    assert Counter(found) == Counter(brute.near(rows(spark, sf, "documents"), 3, 85))


def test_packing(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path("byte_bpe_50k.json"))
    out = got(Q.op7_packing(spark, sf), "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    want = brute.pieces(rows(spark, sf, "documents"), lambda s: t.encode(s, add_special_tokens=False).ids)
    assert Counter(x[:5] for x in out) == Counter(want)
    places = {}
    for *_, n, _, seq, off in out:
        places.setdefault(seq, []).append((off, n))
    for own in places.values():
        at = 0
        for off, n in sorted(own):
            assert off == at
            at += n
        assert at <= 2048
    assert len(places) <= 1.02 * sum(x[3] for x in out) / 2048 + 1


def test_warc(spark, sf):
    found = got(Q.op8_warc(spark, sf), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(found) == Counter(brute.warc(rows(spark, sf, "pages")))


def test_sentencepiece(spark, sf):
    import hashlib

    import numpy as np
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=Q.tokenizer_path("piece_bpe_32k.model"))
    want = [(r["doc_id"], len(ids := sp.encode(r["text"])), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest(), True) for r in rows(spark, sf, "documents")]
    assert Counter(got(Q.op4_sentencepiece(spark, sf), "doc_id", "n_ids", "ids_sha256", "decoded_sha256", "round_trip")) == Counter(want)


def test_line_templates(spark, sf):
    import hashlib

    found = got(Q.op10_line_dedup(spark, sf), "doc_id", "n_lines", "n_dropped", "kept_chars", "kept_sha256")
    want = [(d, n, g, len(t), hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in brute.line_templates(rows(spark, sf, "documents"), 10)]
    assert Counter(found) == Counter(want) and sum(x[2] for x in found) > 0


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in rows(spark, sf, "documents")}
    out = got(Q.op9_language_id(spark, sf), "doc_id", "held_out", "lang_pred", "score")
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= s <= 1 for d, h, _, s in out)
    held = [lang[d] == p for d, h, p, _ in out if h]
    assert sum(held) / len(held) >= 0.97


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_toxicity(spark, sf):
    y = {r["doc_id"]: r["toxic"] for r in rows(spark, sf, "labels")}
    out = got(Q.op5_toxicity(spark, sf), "doc_id", "held_out", "score", "predicted")
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= s <= 1 and p == (s >= 0.3) for d, h, s, p in out)
    held = [(y[d], p) for d, h, s, p in out if h and d in y]
    hit = sum(a and b for a, b in held)
    f1 = 2 * hit / (sum(a for a, _ in held) + sum(b for _, b in held))
    assert f1 >= 0.9, f1
