"""SentencePiece encoding and decoding over a relational lattice.

1. Texts are cut into words: the units between blanks, as no piece of the model goes
   on after a blank (checked when the model is read). Words are cut on where two neighbours
   stand side by side in no piece, so that no edge could reach over the cut. Each
   distinct word is encoded once, in tables.
2. Every substring of a word, up to the longest piece, is exploded and equi-joined to
   the piece table (at most some 100,000 rows, so it is broadcast). What matches are the
   edges of the word's lattice.
3. The edges are grouped by word and folded by the higher-order ``aggregate``. Models of
   type unigram take the Viterbi fold: the best sum of scores up to each place. Models
   of type BPE take their own order: edges by falling score, then by place, each
   removes the boundary between the two symbols that it covers. (The largest sum of
   scores isn't what a BPE model means: it gives other ids for most words.) One pass over the edges
   is right where a piece never has a half that is merged later than itself. Some
   pieces have such a half; so where an edge still fits after the pass, or several pieces
   share a score (runs of blanks), the word is folded again, taking the first edge that
   fits at each step.
   Characters outside all pieces become byte pieces.
4. Ids are looked up in the table of pieces and decoded, word by word. Each block of
   ``BLOCK`` texts gets the dictionary of its own words, and puts its texts together from it.

Words of more than ``MASKED`` characters (long runs of letters without a blank) have their
substrings exploded window by window, so that no row holds the whole word, and are folded
by a heap in an Arrow function, as ``aggregate`` can't change an array in place. Texts and
words of any length take part.

A null text counts as empty and has no ids. Repeated rows are encoded each. An empty
table gives an empty result. Whole-number doc_ids are carried exactly, beside nulls too.
Other columns are not read. A text that holds the model's sign for a blank is decoded with a
blank there, so round_trip is false for it.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .keys import carried, restored
from .memory import give_back
from .workspace import Workspace

SPACE, UNIGRAM, BPE, WORDS, BLOCK = "▁", 1, 2, 100_000, 8192
#: So many characters are cut at a time, and so many different parts of texts are held before they are.
CHARS, PARTS = 1 << 19, 150_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a serialised protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces, scores and type of a model file. Normalisers other than identity are refused."""

    def __init__(self, path: str):
        self.pieces: list[tuple[str, int, float, int]] = []  # piece, id, score, type (1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte)
        self.kind, self.prefix = UNIGRAM, True
        with open(path, "rb") as f:
            data = f.read()
        for field, value in _fields(data):
            if field == 1:
                got = dict(_fields(value))
                score = float(np.frombuffer(got.get(2, b"\0\0\0\0"), "<f4")[0])
                self.pieces.append((got[1].decode(), len(self.pieces), score, got.get(3, 1)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                norm = dict(_fields(value))
                if norm.get(1, b"identity") != b"identity" or norm.get(4, 1):
                    raise ValueError("only models that leave their text as it is are supported")
                self.prefix = bool(norm.get(3, 1))
        if any(t == 4 for *_, t in self.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.arrange()

    def arrange(self) -> None:
        """Number the pieces by falling score, then by length; ``first`` is the least number with a piece's score."""
        self.plain = sorted((p for p in self.pieces if p[3] == 1), key=lambda p: (-p[2], len(p[0]), p[1]))
        self.first = [0] * len(self.plain)
        for i in range(1, len(self.plain)):
            self.first[i] = self.first[i - 1] if self.plain[i][2] == self.plain[i - 1][2] else i
        if any(SPACE in p.lstrip(SPACE) for p, *_ in self.plain):
            raise ValueError("a piece goes on after a blank")
        self.longest = max(len(p) for p, *_ in self.plain)
        if self.longest > 255 or len(self.plain) >= UNKNOWN or any(i - f > 255 for i, f in enumerate(self.first)):
            raise ValueError("the pieces don't fit into packed edges")

    def table(self, spark: SparkSession) -> DataFrame:
        """piece and edge: all of a packed edge but its place."""
        rows = [(p, _pack(f, 0, i - f, len(p))) for i, ((p, *_), f) in enumerate(zip(self.plain, self.first, strict=True))]
        return spark.createDataFrame(pd.DataFrame(rows, columns=["piece", "edge"]), "piece string, edge bigint")

    def bytes(self) -> list[int]:
        """The id of each byte's piece."""
        by = {p: i for p, i, _, t in self.pieces if t == 6}
        return [by[f"<0x{b:02X}>"] for b in range(256)]

    def neighbours(self) -> list[str]:
        """The pairs of characters that stand side by side in a piece."""
        return sorted({p[i : i + 2] for p, *_ in self.plain for i in range(len(p) - 1)})


#: So many characters of a word have a bit each in a long, with room for the end and for sums. A packed edge is
#: first << 42 | place << 16 | (number - first) << 8 | length, so that edges sort by falling score, then by place.
MASKED, UNKNOWN, PLACES = 60, (1 << 20) - 1, (1 << 26) - 1


def _pack(first: int, place: int, more: int, length: int) -> int:
    return first << 42 | place << 16 | more << 8 | length


def _shift(c: Column, n: int | Column) -> Column:
    return F.call_function("shiftright", c, F.lit(n) if isinstance(n, int) else n)


def _place(e: Column) -> Column:
    return _shift(e, 16).bitwiseAND(F.lit(PLACES)).cast("int")


def _length(e: Column) -> Column:
    return e.bitwiseAND(F.lit(255)).cast("int")


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i)


def _ends(e: Column) -> Column:
    return _bit(_place(e)).bitwiseOR(_bit(_place(e) + _length(e)))


def _inside(e: Column) -> Column:
    return _bit(_place(e) + _length(e)) - _bit(_place(e) + 1)


def _spread(edges: Column) -> Column:
    """Packed edges with the bits of their ends and of the places between them; single characters have none between."""
    return F.transform(edges, lambda e: F.struct(e.alias("e"), _ends(e).alias("ends"), _inside(e).alias("inside")))


def _fits(mask: Column, e: Column) -> Column:
    """Whether both ends of an edge are boundaries, and one is left between them."""
    return (mask.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(mask.bitwiseAND(e["inside"])) == 1)


def _every(length: Column) -> Column:
    return F.call_function("shiftleft", F.lit(2).cast("bigint"), length) - 1


def _merge_fold(spread: Column, length: Column) -> Column:
    """The boundaries of a BPE word as bits, by one pass over its edges."""
    return F.aggregate(spread, _every(length), lambda mask, e: F.when(_fits(mask, e), mask.bitwiseXOR(mask.bitwiseAND(e["inside"]))).otherwise(mask))


def _merge_steps(spread: Column, length: Column) -> Column:
    """The same, taking the first edge that fits at every step."""

    def step(mask: Column, _: Column) -> Column:
        e = F.get(F.filter(spread, lambda x: _fits(mask, x)), F.lit(0))
        return F.coalesce(mask.bitwiseXOR(mask.bitwiseAND(e["inside"])), mask)

    return F.aggregate(F.sequence(F.lit(1), length), _every(length), step)


def _viterbi_fold(edges: Column, length: Column, scores: Column, unknown: float) -> Column:
    """The boundaries (bits) of the path with the best sum of scores; characters without a piece cost ``unknown``. Ties go to the longer last piece."""
    first = F.array(F.struct(F.lit(0.0).alias("sum"), F.lit(1).cast("bigint").alias("mask")))

    def step(best: Column, end: Column) -> Column:
        into = F.filter(edges, lambda e: _place(e) + _length(e) == end)
        ways = F.transform(into, lambda e: F.struct((F.get(best, _place(e))["sum"] + F.coalesce(F.get(scores, _number(e)), F.lit(unknown))).alias("sum"), _length(e).alias("back")))
        top = F.array_max(ways)
        return F.concat(best, F.array(F.struct(top["sum"].alias("sum"), F.get(best, end - top["back"])["mask"].bitwiseOR(_bit(end)).alias("mask"))))

    return F.get(F.aggregate(F.sequence(F.lit(1), length), first, step), length)["mask"]


def _number(e: Column) -> Column:
    return (_shift(e, 42) + _shift(e, 8).bitwiseAND(F.lit(255))).cast("int")


def lattice(words: DataFrame, model: Model) -> DataFrame:
    """key, edges: the substrings of ``word`` that are pieces and all single characters, packed and sorted, by ``key``.

    Columns of words: key, word, base (the place of word in what the key stands for) and reach (so many of its
    characters begin substrings here). Where ``words`` comes partitioned by key, nothing is shuffled.
    """
    starts = words.select("key", "word", "base", F.char_length("word").alias("n"), F.explode(F.sequence(F.lit(0), F.col("reach") - 1)).alias("a"))
    subs = starts.select("key", "word", "base", "a", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), F.col("n") - F.col("a")))).alias("len"))
    # a vocabulary: some 32,000 rows; joined on a number, which is looked up much faster than a string, and compared in full
    pieces = F.broadcast(model.table(words.sparkSession).select(F.xxhash64("piece").alias("hash"), F.col("piece").alias("known"), "edge"))
    found = subs.withColumn("piece", F.expr("substring(word, a + 1, len)")).withColumn("hash", F.xxhash64("piece")).join(pieces, "hash", "left")
    same = F.coalesce(F.col("piece").startswith(F.col("known")) & (_length(F.col("edge")) == F.col("len")), F.lit(False))
    found = found.withColumn("same", same).filter((F.col("len") == 1) | F.col("same"))
    edge = F.when(F.col("same"), F.col("edge")).otherwise(F.lit(_pack(UNKNOWN, 0, 0, 1))) + F.call_function("shiftleft", (F.col("base") + F.col("a")).cast("bigint"), F.lit(16))
    return found.select("key", edge.alias("edge")).groupBy("key").agg(F.sort_array(F.collect_list("edge")).alias("edges"))


def _long_path(kind: int, edges: list[int], scores: list[float], unknown: float) -> list[int]:
    """The edges of the path of a word of any length."""
    place = lambda e: e >> 16 & PLACES
    by = {(place(e), place(e) + (e & 255)): e for e in edges}
    n = max(b for _, b in by)
    if kind == BPE:
        end, begin, heap = list(range(1, n + 1)), {i + 1: i for i in range(n)}, [by[i, i + 2] for i in range(n - 1) if (i, i + 2) in by]
        heapq.heapify(heap)
        while heap:
            a = place(e := heapq.heappop(heap))
            b, middle = a + (e & 255), end[a]
            if not 0 < middle < b or end[middle] != b:
                continue
            end[a], end[middle], begin[b] = b, 0, a
            for pair in ((begin.get(a, -1), b), (a, end[b] if b < n else -1)):
                if pair in by and end[pair[0]] in (a, b):
                    heapq.heappush(heap, by[pair])
    else:
        sums, back, into = [0.0] + [float("-inf")] * n, [0] * (n + 1), [[] for _ in range(n + 1)]
        for (a, b), e in by.items():
            number = (e >> 42) + (e >> 8 & 255)
            into[b].append((a, scores[number] if number < len(scores) else unknown))
        for b in range(1, n + 1):
            sums[b], back[b] = max((sums[a] + s, b - a) for a, s in into[b])
        end, b = [0] * n, n
        while b:
            end[b - back[b]], b = b, b - back[b]
    out, a = [], 0
    while a < n:
        out.append(by[a, end[a]])
        a = end[a]
    return out


def _ids(path: Column, word: Column, model: Model) -> Column:
    """The ids of the edges of a path, in order; characters without a piece give one id per byte."""
    listed = lambda xs: F.split(F.lit(" ".join(map(str, xs))), " ").cast("array<int>")  # noqa: E731  folded to one literal
    ids, of_byte = listed([i for _, i, *_ in model.plain]), listed(model.bytes())
    ordered = F.sort_array(F.transform(path, lambda e: F.call_function("shiftleft", _place(e).cast("bigint"), F.lit(21)) + _number(e)))
    id_of = lambda x: F.get(ids, x.bitwiseAND(F.lit((1 << 21) - 1)).cast("int"))
    hexed = lambda x: F.hex(F.encode(F.substring(word, _shift(x, 21).cast("int") + 1, F.lit(1)), "UTF-8"))
    of_bytes = lambda h: F.transform(F.sequence(F.lit(1), F.length(h), F.lit(2)), lambda k: F.get(of_byte, F.conv(F.substring(h, k, F.lit(2)), 16, 10).cast("int")))
    each = F.flatten(F.transform(ordered, lambda x: F.coalesce(F.when(id_of(x).isNotNull(), F.array(id_of(x))), of_bytes(hexed(x)))))
    return F.when(F.exists(path, lambda e: _number(e) >= UNKNOWN), each).otherwise(F.transform(ordered, id_of))


def encode_words(words: DataFrame, model: Model) -> DataFrame:
    """(word, ids) for a table of distinct words, blanks written as the model's sign."""
    scores, unknown = [s for _, _, s, _ in model.plain], min(s for _, _, s, _ in model.pieces) - 10
    n = F.char_length("word")
    short = words.filter(n.between(1, MASKED)).select(F.col("word").alias("key"), "word", F.lit(0).alias("base"), n.alias("reach"))
    short = lattice(short, model).select(F.col("key").alias("word"), "edges", F.char_length("key").alias("n"))
    long_edges = _spread(F.filter("edges", lambda e: e.bitwiseAND(F.lit(255)) > 1)).alias("merges")
    if model.kind == BPE:
        short = short.select("word", "n", "edges", long_edges)
        short = short.withColumn("mask", _merge_fold(F.col("merges"), F.col("n")))
        again = F.exists("merges", lambda e: _fits(F.col("mask"), e) | (e["e"].bitwiseAND(F.lit(255 << 8)) > 0))
        mask = F.when(again, _merge_steps(F.col("merges"), F.col("n"))).otherwise(F.col("mask"))
    else:
        listed = F.split(F.lit(" ".join(map(repr, scores))), " ").cast("array<double>")
        short = short.select("word", "edges", _viterbi_fold(F.col("edges"), F.col("n"), listed, unknown).alias("mask"), long_edges)
        mask = F.col("mask")
    short = short.select("word", "edges", "merges", mask.alias("mask"))
    on_path = lambda e: (F.col("mask").bitwiseAND(e["ends"]) == e["ends"]) & (F.col("mask").bitwiseAND(e["inside"]) == 0)
    # a single character is on the path where its place and the next are boundaries
    alone = lambda e: (e.bitwiseAND(F.lit(255)) == 1) & (_shift(F.col("mask"), _place(e)).bitwiseAND(F.lit(3)) == 3)
    short = short.select("word", F.concat(F.transform(F.filter("merges", on_path), lambda e: e["e"]), F.filter("edges", alone)).alias("path"))

    kind = model.kind

    @F.pandas_udf("array<bigint>")
    def path_of(edges: pd.Series) -> pd.Series:
        return pd.Series([_long_path(kind, [int(e) for e in x], scores if kind != BPE else [], unknown) for x in edges])

    long = words.filter(n > MASKED).select(F.sha2("word", 256).alias("key"), "word")
    cut = long.select("key", "word", F.explode(F.sequence(F.lit(0), F.char_length("word") - 1, F.lit(MASKED))).alias("base"))
    cut = cut.select("key", F.expr(f"substring(word, base + 1, {MASKED + model.longest})").alias("word"), "base", F.least(F.lit(MASKED), F.char_length("word") - F.col("base")).alias("reach"))
    long = lattice(cut, model).join(long, "key").select("word", path_of("edges").alias("path"))
    return short.union(long).select("word", _ids(F.col("path"), F.col("word"), model).alias("ids"))


def decode_words(coded: DataFrame, model: Model) -> DataFrame:
    """(word, ids, decoded): the pieces of a word's ids, their bytes put together; only distinct words pass here."""
    data = {i: p.encode().hex() if t == 1 else p[3:5] for p, i, _, t in model.pieces if t in (1, 6)}
    names = F.split(F.lit(" ".join(data.get(i, "") for i in range(len(model.pieces)))), " ")
    return coded.select("word", "ids", F.decode(F.unhex(F.array_join(F.transform("ids", lambda i: F.get(names, i)), "")), "UTF-8").alias("decoded"))


class Cutter:
    """Cuts texts into words: where two neighbours stand side by side in no piece."""

    def __init__(self, pairs: list[str], prefix: bool):
        letters = sorted({c for p in pairs for c in p})
        self.prefix, self.number, self.size = prefix, np.zeros(0x110000, np.int32), len(letters) + 1
        self.number[[ord(c) for c in letters]] = np.arange(1, self.size)
        self.joined = np.zeros(self.size * self.size, bool)
        for a, b in pairs:
            self.joined[self.number[ord(a)] * self.size + self.number[ord(b)]] = True

    def __call__(self, texts: Collection[str]) -> Iterator[list[str]]:
        """The words of each text, blanks written as the model's sign; some CHARS characters are cut at a time."""
        held, size = [], 0
        for text in texts:
            held.append(((" " if self.prefix else "") + text).replace(" ", SPACE) if text else "")
            size += len(text)
            if size >= CHARS:
                yield from self._cut(held)
                held, size = [], 0
        if held:
            yield from self._cut(held)

    def _cut(self, held: list[str], whole: bool = False) -> Iterator[list[str]]:
        if len(held) == 1 and len(held[0]) > 2 * CHARS and not whole:
            yield [w for part in _parts(held[0]) for words in self._cut([part], True) for w in words]
            return
        text = "".join(held)
        own = self.number[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        cuts = np.ones(len(own), bool)
        if len(own):
            np.logical_not(self.joined.take(own[:-1] * self.size + own[1:]), out=cuts[1:])
        begins = np.concatenate([[0], np.cumsum([len(t) for t in held], dtype=np.int64)])
        cuts[begins[:-1][np.diff(begins) > 0]] = True
        places = np.flatnonzero(cuts)
        at = np.searchsorted(places, begins).tolist()
        every = [*places.tolist(), len(text)]
        words = [text[a:b] for a, b in zip(every[:-1], every[1:], strict=True)]
        for i, j in zip(at[:-1], at[1:], strict=True):
            yield words[i:j]


def _parts(text: str) -> Iterator[str]:
    """A long text in parts that begin where a blank follows other than a blank."""
    at = 0
    while len(text) - at > CHARS:
        to = text.rfind(SPACE, at + 1, at + CHARS)
        while to > at and text[to - 1] == SPACE:
            to -= 1
        if to <= at:  # no blank within reach: the next one
            to = text.find(SPACE, at + CHARS)
            while to >= 0 and text[to - 1] == SPACE:
                to = text.find(SPACE, to + 1)
            if to < 0:
                break
        yield text[at:to]
        at = to
    yield text[at:]


def encode(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_ids, ids_sha256 (ids as little-endian 32-bit numbers), decoded_sha256, round_trip (decoded equals the text), and ids if asked for."""
    spark, work, model = docs.sparkSession, Workspace(docs.sparkSession, "sentencepiece"), Model(model_path)
    kind = docs.schema[doc_id].dataType
    columns = [carried(F.col(doc_id), kind).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")]
    # both passes have to mean the same rows by a block: of files it is a range of row numbers, else rows and blocks are stored
    try:
        file = docs.metadataColumn("_metadata")
        blocks = docs.select(*columns, F.xxhash64(file["file_path"], F.floor(file["row_index"] / BLOCK)).alias("block"))
    except AnalysisException:
        block = F.floor(F.monotonically_increasing_id() / BLOCK).cast("bigint")
        blocks = work.keep(docs.select(*columns, block.alias("block")), "blocks", codec="zstd")
    prefix, neighbours = model.prefix, model.neighbours()
    width = 2 if len(model.pieces) <= 1 << 16 else 4

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter, parts, words, now = Cutter(neighbours, prefix), set(), set(), None

        def take(texts: Collection[str]) -> None:
            for own in cutter(texts):
                words.update(own)

        def frames() -> Iterator[pd.DataFrame]:
            take(parts)
            every = list(words)
            parts.clear()
            words.clear()
            for i in range(0, len(every), 50_000):
                yield pd.DataFrame({"block": now, "word": every[i : i + 50_000]})

        for b in batches:
            for block, texts in _by_block(b["block"], b["text"]):
                if block != now:
                    if now is not None:
                        yield from frames()
                    now = block
                for text in texts:
                    # a text of single blanks has the words of its parts, most of which are known already
                    own = text.split(" ")
                    if prefix and "" not in own and SPACE not in text:
                        parts.update(own)
                    elif text:
                        take([text])
                if len(parts) > PARTS:
                    take(parts)
                    parts.clear()
            give_back()
        if now is not None:
            yield from frames()

    pairs = work.keep(blocks.mapInPandas(words_of, "block bigint, word string"), "pairs", codec="zstd")
    # each word once, with its blocks: far fewer bytes than the pairs, which go. A task has so many pairs that it groups them in memory
    tasks = max(1, -(-pairs.count() // WORDS))
    with work.setting("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", 2 * WORDS):
        words = work.keep(pairs.repartition(tasks, "word").groupBy("word").agg(F.collect_list("block").alias("blocks")), "words", codec="zstd")
    work.drop("pairs")
    work.release()
    # the lattice and its groups stay within one exchange by word
    distinct = words.select("word").repartition(tasks, "word")
    # what decodes to itself, nearly every word, needs no second copy; ids travel as little-endian numbers of two bytes if that will do
    hexed = F.split(F.lit(" ".join(i.to_bytes(width, "little").hex() for i in range(len(model.pieces)))), " ")
    coded = decode_words(encode_words(distinct, model), model)
    data = F.unhex(F.array_join(F.transform("ids", lambda i: F.get(hexed, i)), ""))
    coded = coded.select("word", data.alias("ids"), F.when(F.col("decoded") != F.col("word"), F.col("decoded")).alias("decoded"))
    with work.setting("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", 2 * WORDS):
        coded = work.keep(coded, "coded", codec="zstd")
    work.release()
    book = words.join(coded, "word").select(F.explode("blocks").alias("block"), "word", "ids", "decoded")
    # a block's dictionary is a folder of its own, which its texts open by name
    work.keep(book.repartition("block").sortWithinPartitions("block", "word"), "book", codec="zstd", by="block")
    work.drop("words", "coded")
    work.release()
    where = work.at("book")

    def put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter, now, book, odd = Cutter(neighbours, prefix), None, {}, {}
        for b in batches:
            out, docs_of = [], iter(b["doc_id"])
            for block, texts in _by_block(b["block"], b["text"]):
                if block != now:
                    book.clear()
                    give_back()
                    book, odd = _book(where, int(block))
                    now = block
                for value, words in zip(texts, cutter(texts), strict=True):
                    data = b"".join(map(book.__getitem__, words))
                    if width == 2:
                        data = np.frombuffer(data, "<u2").astype("<u4").tobytes()
                    if odd:
                        back = "".join([odd.get(w, w) for w in words]).replace(SPACE, " ")
                        back = back[1:] if prefix and words else back
                    else:  # every word of the block decodes to itself, and the words side by side are the text
                        back = value.replace(SPACE, " ")
                    row = (next(docs_of), len(data) // 4, hashlib.sha256(data).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == value)
                    out.append((*row, np.frombuffer(data, "<u4").astype(np.int32)) if with_ids else row)
            give_back()
            yield pd.DataFrame(out, columns=["doc_id", "n_ids", "ids_sha256", "decoded_sha256", "round_trip", "ids"][: 6 if with_ids else 5])

    schema = f"doc_id {blocks.schema['doc_id'].dataType.simpleString()}, n_ids bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    out = blocks.mapInPandas(put_together, schema)
    return out.withColumn("doc_id", restored(F.col("doc_id"), kind))


def _by_block(blocks: pd.Series, texts: pd.Series) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of one block."""
    numbers, every = blocks.to_numpy(), list(texts)
    starts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist()] if len(every) else []
    for a, b in zip(starts, [*starts[1:], len(every)], strict=True):
        yield numbers[a], every[a:b]


def _book(where: str, block: int) -> tuple[dict[str, bytes], dict[str, str]]:
    """The dictionary of one block, read from the shared folder: ids by word, and what doesn't decode to itself."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(f"{where}/block={block}")
    if system.get_file_info(at).type == fs.FileType.NotFound:
        return {}, {}
    got = ds.dataset(at, filesystem=system, format="parquet").to_table(columns=["word", "ids", "decoded"])
    words = got["word"].to_pylist()
    odd = {} if got["decoded"].null_count == len(words) else {w: d for w, d in zip(words, got["decoded"].to_pylist(), strict=True) if d is not None}
    return dict(zip(words, got["ids"].to_pylist(), strict=True)), odd
