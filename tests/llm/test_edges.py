"""Nulls, empty tables, repeated rows, ties, long texts and clashing column names, for every operator."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from docweft.llm import chat_format, exact_dedup, language_id, line_templates, minhash_dedup, packing, sentencepiece_lattice, topk, toxicity, warc
from docweft.llm.queries import tokenizer_path

LONG = " ".join(f"word{i % 977} and {i % 13}" for i in range(60_000))
TEXTS = [None, "", "  \n\t ", "a", "A a", "one two three four five six", "one two three four five six", "One two  three four five six", "x y", LONG, LONG + " tail", "12 34", "漢字 かな 한글", "\x00\x01 zero", "é" * 3000]
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep_id string, kept int, digest string, n int, nid string, node string, score string, row string, leaf string, ids string, block string, lines string"


def docs(spark, rows=None):
    """Rows with null ids, repeats of whole rows, and columns named like the operators' own."""
    if rows is None:
        rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "one two three four five six"), (None, None), (7, "another text of this id"), (3, "a"), (3, "a")]
    full = [(i, t, None if i in (None, 2) else "en", None, None, "k", 1, "d", 0, "x", "y", "z", "r", "l", "i", "b", "s") for i, t in rows]
    return spark.createDataFrame(full, DOC)


def as_dicts(df):
    return [r.asDict() for r in df.select("doc_id", "text").collect()]


def test_exact_dedup(spark):
    df = docs(spark)
    got = [tuple(r) for r in exact_dedup.deduplicate(df).select("doc_id", "keep_id", "group_size", "kept", "digest").collect()]
    assert Counter(got) == Counter(brute.dedup(as_dicts(df)))
    assert exact_dedup.deduplicate(docs(spark, [])).collect() == []
    kept = exact_dedup.keep_first(df)
    assert kept.columns == df.columns and kept.count() == len({r[4] for r in got})
    assert exact_dedup.keep_first(docs(spark, [])).collect() == []


def test_exact_dedup_in_many_batches_and_with_colliding_digests(spark):
    df = docs(spark).repartition(5)
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    cols = ("doc_id", "keep_id", "group_size", "kept")
    want = Counter(r[:4] for r in brute.dedup(as_dicts(df)))
    assert Counter(tuple(r) for r in exact_dedup.deduplicate(df, digest=weak).select(*cols).collect()) == want
    assert Counter(tuple(r) for r in exact_dedup.deduplicate(df, files_per_batch=1).select(*cols).collect()) == want


def test_exact_dedup_in_batches_of_bounded_bytes(spark, monkeypatch):
    import os

    from docweft.llm import workspace

    assert exact_dedup.BATCH_BYTES <= 1 << 28
    monkeypatch.setattr(exact_dedup, "BATCH_BYTES", 3000)
    df = docs(spark).repartition(5)
    got = [tuple(r) for r in exact_dedup.deduplicate(df).select("doc_id", "keep_id", "group_size", "kept", "digest").collect()]
    assert Counter(got) == Counter(brute.dedup(as_dicts(df)))
    state = workspace._live[-1].at("state").removeprefix("file://")
    assert sum(name.startswith("epoch=") for name in os.listdir(state)) > 1


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(spark, width, percent):
    df = docs(spark)
    got = [tuple(r) for r in minhash_dedup.near_duplicates(df, width=width, percent=percent).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert Counter(got) == Counter(brute.near(as_dicts(df), width, percent))
    assert minhash_dedup.near_duplicates(docs(spark, [])).collect() == []
    kept = minhash_dedup.keep_first(df)
    assert kept.columns == df.columns
    assert minhash_dedup.keep_first(docs(spark, [])).collect() == []


def test_near_dedup_finds_chains_and_groups(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows, n = [], 0
    for group in range(4):
        words = [f"g{group}{w}" for w in base]
        for _ in range(60):
            own = list(words)
            for _ in range(rng.choice((0, 1, 2, 4, 6, 9, 14))):
                own[rng.randrange(200)] = f"e{rng.randrange(10**9)}"
            rows.append((n, " ".join(own)))
            n += 1
    words = list(base)
    for _ in range(40):  # a chain: each text is near to its neighbours only
        words = words[5:] + [f"c{rng.randrange(10**9)}" for _ in range(5)]
        rows.append((n, " ".join(words)))
        n += 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in minhash_dedup.near_duplicates(df, width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert Counter(got) == Counter(brute.near(as_dicts(df), 3, 85))


def test_packing(spark):
    df = docs(spark)
    path = tokenizer_path("byte_bpe_50k.json")
    out = packing.pack(df, path, with_ids=True).collect()
    lib = packing.encoder(path).library
    want = brute.pieces(as_dicts(df), lambda s: lib.encode(s, add_special_tokens=False).ids)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == Counter(want)
    assert all(len(r.ids) == r.length for r in out)
    check_places(out, 2048)
    assert packing.pack(docs(spark, []), path).collect() == []


def check_places(out, size):
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for off, n in sorted(own):
            assert off == at
            at += n
        assert at <= size
    return len(places)


def test_packing_tree(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, "x" * rng.randint(1, 900)) for i in range(4000)], "doc_id bigint, text string").repartition(12)
    ids = lambda s: b"\1\0\0\0" * len(s)
    out = packing.pack(df, "", token_ids=ids, size=512).collect()
    assert check_places(out, 512) <= 1.01 * sum(r.length for r in out) / 512 + 1


def test_packing_passes_on_all_bins_that_can_take_another(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = [(i, "x" * (rng.choice((100, 200, 290, 300, 310, 400)) - 1)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    ids = lambda s: b"\1\0\0\0" * len(s)
    monkeypatch.setattr(packing, "FAN", 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        bounded = check_places(packing.pack(df, "", token_ids=ids, size=512).collect(), 512)
        rise = packing._rise
        monkeypatch.setattr(packing, "_rise", lambda size, slack, most, level, last: rise(size, slack, 1 << 40, level, last))
        assert bounded == check_places(packing.pack(df, "", token_ids=ids, size=512).collect(), 512)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_packing_of_a_table_sorted_by_length(spark):
    import numpy as np

    rng = random.Random(2)
    lengths = sorted([rng.randint(1100, 1499) for _ in range(1600)] + [rng.randint(548, 899) for _ in range(1600)])
    df = spark.createDataFrame([(i % 50, "x" * (n - 1)) for i, n in enumerate(lengths)], "doc_id bigint, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several tasks, though the table is small
    try:
        out = packing.pack(df, "", token_ids=lambda s: b"\1\0\0\0" * len(s)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) == len(lengths)
    least = len(packing.best_fit(np.array(lengths, np.int64), 2048)[2])
    assert check_places(out, 2048) <= 1.03 * least


def test_sentencepiece(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    texts = [*TEXTS, "  two  blanks ", "a   b", " ", "tab\tand\nline ", "ünï çødé 漢 😀", "a▁b", " " * 7 + "x" + " " * 40, "".join(" " * n + "x" for n in range(1, 40))]
    texts += ["international" * 5, "https://example.org/a/very/long/path/with-many-parts/and_more?query=1234567&x=abcdefghijklmnop", *["a" * n for n in range(58, 66)], "ab" * 5000, "漢字かな" * 25_000, "e" * 100_000]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABC+/=", k=20_000)), " ".join("".join(rng.choices(["the", "re", "in", "ation", "s", "e", "t"], k=rng.randint(5, 30))) for _ in range(3000))]
    base = 2**60 + 1
    df = docs(spark, [*[(base + i, t) for i, t in enumerate(texts)], (None, "null id")])
    out = {r.doc_id: r for r in sentencepiece_lattice.encode(df, path, with_ids=True).collect()}
    for i, t in enumerate(texts):
        assert list(out[base + i].ids) == sp.encode(t or ""), t
        assert out[base + i].round_trip == ("▁" not in (t or ""))
    assert list(out[None].ids) == sp.encode("null id")
    assert sentencepiece_lattice.encode(docs(spark, []), path).collect() == []


def test_viterbi_fold(spark):
    pieces = {"a": -1.0, "b": -1.5, "ab": -2.0, "abc": -4.5, "c": -3.0, "bc": -2.2, "▁": -0.5, "▁a": -1.2}

    class Unigram(sentencepiece_lattice.Model):
        kind, prefix = sentencepiece_lattice.UNIGRAM, True

        def __init__(self):
            self.pieces = [(p, i, s, 1) for i, (p, s) in enumerate(pieces.items())]
            self.arrange()

        def bytes(self):
            return list(range(1000, 1256))

    words = ["▁abc", "▁aabbcc", "▁", "▁axb", "abcabc", "é", "cba", "▁" + "abcbxc" * 15]
    out = {r.word: list(r.ids) for r in sentencepiece_lattice.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), Unigram()).collect()}
    number = {p: i for i, p in enumerate(pieces)}
    for w in words:
        _, path = brute.viterbi(w, pieces, min(pieces.values()) - 10)
        assert out[w] == [x for p in path for x in ([number[p]] if p in number else [1000 + b for b in p.encode()])], w


def test_line_templates(spark):
    many = [(i, f"page {i} of {i + 9} here now\nunique line w{i} x{i}y\n\nfooter text") for i in range(12)]
    df = docs(spark, [*enumerate(TEXTS), *[(100 + i, t) for i, t in many], (None, "footer text"), (100, many[0][1])])
    out = line_templates.drop_recurring(df, min_docs=10)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect())
    assert got == Counter(brute.line_templates(as_dicts(df), 10))
    assert line_templates.drop_recurring(docs(spark, [])).collect() == []


def test_line_templates_splits_large_leaves(spark, monkeypatch):
    monkeypatch.setattr(line_templates, "LEAF", 5)
    rows = [(i, f"same start {i % 7}x tail{'abcdefgh'[i % 8]} end") for i in range(80)]
    out = line_templates.drop_recurring(docs(spark, rows), min_docs=10).collect()
    assert all(r.n_dropped == 1 for r in out)


def test_line_templates_do_not_depend_on_the_size_of_leaves(spark, monkeypatch):
    rng = random.Random(4)
    name = lambda i: f"Mac{chr(97 + i % 26)}{chr(97 + i // 26)}"
    rows = [(i, f"Dear Mr {name(i)} thank you for your letter of today") for i in range(60)]
    words = [f"w{chr(97 + i)}" for i in range(6)]
    for i in range(400):  # other lines of that start and length, some alike
        tail = [rng.choice(words) for _ in range(8)] if i % 2 else ["go", "on", "as", rng.choice(words), "did", "so", "far", rng.choice(["9", *words])]
        rows.append((1000 + i, " ".join(["Dear", "Mr", *tail])))
    df = docs(spark, rows)
    want = Counter(brute.line_templates(as_dicts(df), 10))
    assert sum(r[2] for r in want.elements() if r[0] < 1000) == 60
    for leaf, rounds in ((4000, 12), (5, 12), (5, 1)):
        monkeypatch.setattr(line_templates, "LEAF", leaf)
        monkeypatch.setattr(line_templates, "ROUNDS", rounds, raising=False)
        out = line_templates.drop_recurring(df, min_docs=10)
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()) == want


def test_language(spark):
    df = docs(spark)
    protos = language_id.fit(df)
    out = df.select("doc_id", "text", language_id.predict(F.col("text"), protos).alias("p")).collect()
    assert all((r.p["lang"] == "und") == (not any(c.isalpha() for c in r.text or "")) for r in out)
    assert all(0 <= r.p["score"] <= 1 for r in out)
    assert language_id.fit(docs(spark, [])) == {}
    assert docs(spark).select(language_id.predict(F.col("text"), {}).alias("p")).filter("p.lang <> 'und'").count() == 0


def test_toxicity(spark):
    df = docs(spark)
    labels = spark.createDataFrame([(1, 1, None), (5, 0, 1), (None, 0, 1), (5, 0, 0), (9, 1, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(df, labels)
    out = df.select(toxicity.score(F.col("text"), model).alias("s"), toxicity.threshold(F.col("lang"), model).alias("t")).collect()
    assert len(out) == df.count() and all(0 <= r.s <= 1 and 0 < r.t < 1 for r in out)
    none = toxicity.fit(docs(spark, []), labels.limit(0))
    assert all(0 <= r.s <= 1 for r in df.select(toxicity.score(F.col("text"), none).alias("s")).collect())


def test_chat(spark):
    rows = [(1, 2, "user", "b", "x"), (1, 1, "assistant", None, "x"), (1, 1, "assistant", None, "x"), (None, None, None, None, None), (2, 0, None, "### a: b </turn>\n", "y"), (2, None, "a: b", "\\", "y"), (3, 0, "assistant", LONG, "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    out = chat_format.format_conversations(df).collect()
    want = brute.chat([r.asDict() for r in df.collect()])
    assert {r.conv_id: (len(r.turns), len(r.loss_text)) for r in out} == {k: (v[0], v[2]) for k, v in want.items()}
    assert chat_format.format_conversations(df.limit(0)).collect() == []


def test_topk(spark):
    rows = [(100, [1.0, 0.5]), (100, [1.0, 0.5]), (200, None), (300, [1.0, None]), (400, [float("nan"), 1.0]), (500, []), (600, [1e300, 1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.25]), (2, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [float("inf"), 0.0]), (4, [0.1]), (5, [-1.0, -1.0, 2.0])]
    rows = [r for r in rows if r[0] != 600]
    df = spark.createDataFrame([(*r, 0, "s") for r in rows], "vec_id bigint, embedding array<double>, row int, part string")
    got = Counter(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, part=3, chunk=1).select("query_id", "rank", "vec_id", "score").collect())
    data = [r for r in brute.topk([{"vec_id": i, "embedding": v} for i, v in rows])]
    assert got == Counter(data)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_warc(spark):
    big, other = "b" * 1000, "é" * 600
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://x y/ü\r\n", other), (4, "", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", big), (8, "u", LONG), (2, "again", big), (-3, "u", other)]
    df = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id bigint, url string, html string, path string, payload string")
    got = Counter(tuple(r) for r in warc.archive(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert got == Counter(brute.warc([{"page_id": p, "html": h} for p, _, h in rows]))
    assert warc.archive(df.limit(0)).collect() == []


def test_warc_read_by_spark(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"{i}" * 100) for i in range(30)], "page_id bigint, url string, html string")
    files = warc.write(warc.plan(df), f"file://{tmp_path}/w", roll=500).collect()
    assert sum(f.records for f in files) == 30 and len(files) > 3
    back = warc.read_binary(spark, f"file://{tmp_path}/w").collect()
    assert sorted(bytes(r.payload).decode() for r in back) == sorted(f"{i}" * 100 for i in range(30)) and all(r.problem is None for r in back)


def test_pipeline_stages_on_edges(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (5, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    for df in (docs(spark), docs(spark, [])):
        cur = df.select("doc_id", "text", "lang", "source", "n_chars")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, cur, d)
            if name != "packing":
                assert out.columns == cur.columns
            rows = out.collect()
            cur = spark.createDataFrame(rows, out.schema)
    assert rows == []


def test_topk_with_other_partition_counts(spark, sf, monkeypatch):
    """A session may make more ranges than were asked for."""
    from pyspark.sql import DataFrame

    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = Counter(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect())
    frame = type(df)
    make = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *c: make(self, max(n, 23), *c))
    assert Counter(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect()) == want
    assert isinstance(df, DataFrame)


BIG = 2**60 + 1
NAMES = ["__digest", "digest", "n", "row", "__row", "__n", "__tid", "tid", "places", "__places", "gone", "__gone", "guess", "score", "keep_doc", "Keep_Digest"]


def test_columns_of_any_name_stay(spark, tmp_path):
    rows = [(i, t, "en", None, 0, *[f"{c} {i}" for c in NAMES]) for i, t in enumerate([*TEXTS[:8], "one two three four five six", None])]
    rows += [(3, "a", "en", None, 0, *["again"] * len(NAMES)), (50, "line\n" * 3, "en", None, 0, *["l"] * len(NAMES))] + [(60 + i, "line\n", "en", None, 0, *["m"] * len(NAMES)) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in NAMES))
    spark.createDataFrame([(1, 1, 0), (5, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {tuple(r) for r in df.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        assert {tuple(r) for r in out.collect()} <= kept, name
    out = line_templates.drop_recurring(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    assert Counter(tuple(r)[2:-2] for r in out.collect()) == Counter(r[2:] for r in rows)


def test_large_ids_beside_nulls(spark):
    texts = ["one two three four", "one two three four", "five six seven eight", "nine"]
    df = docs(spark, [*[(BIG + 2 * i, t) for i, t in enumerate(texts)], (None, "null")]).coalesce(1)
    ids = Counter([*[BIG + 2 * i for i in range(4)], None])
    path = tokenizer_path("byte_bpe_50k.json")
    chats = df.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), "text")
    for out in (chat_format.format_conversations(chats).select("conv_id"), minhash_dedup.near_duplicates(df).select("doc_id"), packing.pack(df, path).select("doc_id"), exact_dedup.deduplicate(df).select("doc_id"), sentencepiece_lattice.encode(df, tokenizer_path("piece_bpe_32k.model")).select("doc_id")):
        assert Counter(r[0] for r in out.collect()) == ids
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df).collect()}
    assert got[BIG + 2] == BIG and got[BIG + 4] == BIG + 4


def test_near_dedup_sends_no_table_through_the_driver(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet

    def told(self, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", told)
    out = minhash_dedup.keep_first(docs(spark, [(i, f"one two three four five six {i % 3}") for i in range(30)]))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_near_dedup_of_many_null_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(300)]
    own = lambda i: " ".join([*words[:60], *[f"x{i}y{j}" for j in range(i % 5)]])
    rows = [(None, own(i)) for i in range(1500)] + [(7, own(i)) for i in range(600)] + [(i, f"text number {i} of its own kind") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = minhash_dedup.near_duplicates(df, width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert Counter(map(tuple, got)) == Counter(brute.near(as_dicts(df), 3, 85))


def test_exact_dedup_goes_on_with_its_state(spark, tmp_path):
    state = f"file://{tmp_path}/state"
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    for digest in (exact_dedup.sha256, weak):
        state += "x"
        deliveries = [[(1, "a b"), (2, "ab"), (3, "c"), (9, None)], [(4, "a  b  "), (0, "c"), (5, "new"), (6, "new ")], [], [(7, "new"), (8, ""), (None, "last")]]
        held = []  # (delivery, rank of the contract) by text
        for number, rows in enumerate(deliveries):
            got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(docs(spark, rows), digest=digest, state=state).collect()}
            held += [("".join((t or "").split()), number, -len(t or ""), i is None, i or 0, i) for i, t in rows]
            want = {}
            for i, t in rows:
                same = sorted(h for h in held if h[0] == "".join((t or "").split()))
                want[i] = (same[0][-1], len(same), same[0][1] == number and same[0][-1] == i)
            assert got == want, number
    assert exact_dedup.deduplicate(docs(spark, [(4, "a  b  ")])).collect()[0].kept  # without a state nothing is remembered


def test_toxicity_takes_ids_of_any_type_and_scores_as_written(spark):
    import numpy as np

    texts = [("you are awful" if i % 3 == 0 else "a fine day") + f" w{i}" for i in range(60)]
    df = spark.createDataFrame([(f"d{i}", t, "en") for i, t in enumerate(texts)], "doc_id string, text string, lang string")
    labels = spark.createDataFrame([(f"d{i}", int(i % 3 == 0)) for i in range(60)], "doc_id string, toxic int")
    model = toxicity.fit(df, labels)
    assert toxicity.fit(df, labels, most_chars=300)["rows"] < model["rows"]
    got = [r.s for r in df.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()]
    net = {k: a.astype(np.float16).astype(np.float64) if k == "e" else a.astype(np.float64) for k, a in model["net"].items()}

    def plain(text):
        known = toxicity.Vocabulary()
        buckets = [known.buckets[r * toxicity.FEATURES : (r + 1) * toxicity.FEATURES] for r in known.rows(text)]
        x = [sum(net["e"][b] for b in own) for own in buckets] + [np.zeros(toxicity.DIM)] * 2
        z = net["bias"][0]
        for k, w in enumerate(toxicity.WIDTHS):
            best = np.max([np.concatenate(x[i : i + w]) @ net[f"f{w}"] for i in range(len(buckets))], axis=0) + net[f"b{w}"]
            z += np.maximum(best, 0) @ net["out"][k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS]
        return 1 / (1 + np.exp(-(z + model["shift"])))

    assert np.allclose(got, [plain(t) for t in texts], atol=1e-4)


def test_packing_of_long_runs(spark):
    """Runs that tiktoken's splitter has no stack for, through the operator and through the encoder."""
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    runs = ["\n" * 1_000_000, " " * 2_000_000 + "a", "a" * 1_000_000, "x" + "\t" * 20_000 + "y"]
    library = Tokenizer.from_file(path)
    got = {}
    for r in packing.pack(docs(spark, list(enumerate(runs))), path, with_ids=True).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.ids))
    for i, text in enumerate(runs):
        assert [x for _, ids in sorted(got[i]) for x in ids] == [*library.encode(text, add_special_tokens=False).ids, 0]


def test_packing_deals_copies_over_tasks(spark):
    """Rows of one id and text are no hot key."""
    n = 4000
    rows = spark.range(n).select(F.when(F.col("id") % 4 > 0, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.lit("").alias("text")).repartition(8)
    out = packing.pack(rows, tokenizer_path("byte_bpe_50k.json"), size=16).collect()
    assert len(out) == n and len({r.sequence_id for r in out}) == n // 16
    deal = rows.hint("rebalance").groupBy(F.spark_partition_id()).count()
    assert "RoundRobin" in deal._jdf.queryExecution().executedPlan().toString()


def test_line_templates_beside_columns_of_their_names(spark):
    df = spark.createDataFrame([(i, "one line here\nother", 5, "x") for i in range(12)], "doc_id bigint, text string, n_lines int, N_Dropped string")
    out = line_templates.drop_recurring(df)
    assert out.columns == ["doc_id", "text", "n_lines", "N_Dropped", "n_lines_", "n_dropped_"]
    assert {(r.text, r.n_lines, r.n_lines_, r.n_dropped_) for r in out.collect()} == {("", 5, 2, 2)}


def test_language_id_of_many_languages(spark):
    rows = [(k, f"{chr(0x4E00 + k)}{chr(0x4E01 + k)} {chr(0x4E00 + k)}", f"l{k}") for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    prototypes = language_id.fit(df)
    assert len(prototypes) == 1500
    got = df.select("lang", language_id.predict(F.col("text"), prototypes).alias("p")).filter("lang = p.lang").count()
    assert got >= 1490


def test_topk_beyond_64_bits(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.5, 0.0]), (4, [-1e16, 1.0])], "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(df, F.col("vec_id") == 3).collect()}
    assert got == {(3, 1): (2**63 - 1), (3, 2): -(2**63), (3, 4): -(2**63)}
