"""corpus_pipeline.run() against the plain versions of its stages, one after the other."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from docweft.llm import toxicity
from docweft.llm.queries import tokenizer_path


def plain(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = [r for r in docs if any(c.isalpha() for c in r["text"] or "")]
    model = toxicity.fit(spark.createDataFrame(docs), spark.read.parquet(f"{sf}/labels.parquet"))
    z = toxicity.logits({k: a.astype(np.float16).astype(np.float32) if k == "e" else a for k, a in model["net"].items()}, [r["text"] for r in docs]).astype(float)
    score = 1 / (1 + np.exp(-np.clip(z + model["shift"], -60, 60)))
    docs = [r for r, s in zip(docs, score, strict=True) if s < model["thresholds"].get(r["lang"], toxicity.CUT)]
    kept = {d for d, _, _, k, _ in brute.dedup(docs) if k}
    docs = [r for r in docs if r["doc_id"] in kept]
    kept = {d for d, _, _, k in brute.near(docs, 5, 80) if k}
    return [r for r in docs if r["doc_id"] in kept]


def test_run(spark, sf):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    out = corpus_pipeline.run(spark, sf).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    want = brute.pieces(plain(spark, sf), lambda s: lib.encode(s, add_special_tokens=False).ids)
    assert Counter(tuple(r) for r in out) == Counter(want)


def test_documents_without_any_lang_stay(spark, sf):
    rows = [(1, "one two"), (2, "12 ;"), (3, None), (4, "漢字"), (None, "a"), (5, "")]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    told = dict(corpus_pipeline.STAGES)["language_id"](spark, docs, sf)
    assert told.columns == docs.columns and Counter(r.doc_id for r in told.collect()) == Counter([1, 4, None])


def test_stages_keep_clean_documents_and_columns(spark, sf):
    """Filtering stages keep what is clean: few documents that are labelled as not toxic go, and only texts without letters have no language."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "exact_dedup", "near_dedup", "packing"]
    told = stages["language_id"](spark, docs, sf)
    assert told.columns == docs.columns and told.count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()
    calm = stages["toxicity"](spark, docs, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = labels.filter("toxic = 0").select("doc_id")
    lost = docs.join(clean, "doc_id").join(calm.select("doc_id"), "doc_id", "left_anti").count()
    assert calm.columns == docs.columns and lost <= 0.05 * clean.count()


def test_toxicity_learns_from_all_labelled_documents(spark, sf, monkeypatch):
    """Beyond what one task learns from, rows are dealt to shards: none is left out, and both classes are told apart."""
    rows = [(i, f"w{i % 97} x{i % 89} {'awful' if i % 4 == 0 else 'fine'} y{i % 7}", "en" if i % 2 else None, int(i % 4 == 0)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"), most=150, whole=True)
    assert model["rows"] == 900 and toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"), most=150)["rows"] < 450
    out = df.select("toxic", toxicity.score(F.col("text"), model).alias("s")).collect()
    assert sum((r.s >= toxicity.CUT) == (r.toxic == 1) for r in out) >= 890
    asked, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a, **k: asked.append(k) or fit(*a, **k))
    dict(corpus_pipeline.STAGES)["toxicity"](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert asked == [{"whole": True}]
