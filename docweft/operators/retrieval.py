"""Import rules, heading lookup, lexical retrieval and language votes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from . import relational as R


#: So many items go to every task; scores so near to each other may be equal when rounded; so many blocks of a batch give first bounds; about so many candidates are counted at a time.
ITEMS, NEAR, FIRST, PAIRS = 10_000, 2e-6, 512, 1 << 18
_TOKEN, _CJK = re.compile("[a-z0-9一-鿿]+"), re.compile("[一-鿿]")
ROW = np.dtype([("item", np.int64), ("doc", np.int64), ("place", np.int64), ("common", np.int64), ("bonus", np.float64), ("score", np.float64)])


def headings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(V.SECTION_HEADINGS.items()), "heading string, section_key string")


def import_warnings(normal: Column, ext: Column, weak_image: Column | None = None, used_ocr: Column | None = None, legacy: Column | None = None) -> Column:
    """The warnings of an imported text (white space normalised), in order."""
    no = F.lit(False)
    pdf = ext == ".pdf"
    n = F.char_length(normal)
    found = F.array_compact(
        F.array(
            F.when(n < 140, "Extracted text is very short and may be incomplete."),
            F.when(pdf & (n < 220), "This PDF may be image-based or low quality. Review the preview before drafting."),
            F.when(pdf & (weak_image if weak_image is not None else no) & ~(used_ocr if used_ocr is not None else no), "This PDF appears image-based and the extracted text may be incomplete without OCR support."),
            F.when(pdf & (used_ocr if used_ocr is not None else no), "OCR fallback was used for this PDF because the embedded text looked incomplete."),
            F.when((ext == ".doc") & (legacy if legacy is not None else no), "This legacy Word (.doc) file was converted during import. Review the extracted text before drafting."),
        )
    )
    return F.when(normal == "", F.array(F.lit("No readable text was extracted from this document."))).otherwise(found)


def _page_marker(line: Column) -> Column:
    return F.trim(line).rlike(r"(?i)^[-–—]*\s*\d+\s+of\s+\d+\s*[-–—]*$")


def extraction_score(text: Column) -> Column:
    """How good an extracted text looks: length, years, experience headings and bullets count for it, page markers against it."""
    every = T.lines(text)
    kept = F.filter(every, lambda x: ~_page_marker(x) & ~T.is_opaque(F.trim(x)))
    t = T.normalise_whitespace(F.array_join(kept, "\n"))
    score = F.char_length(t) + 120 * F.regexp_count(t, F.lit(r"\b(?:19|20)\d{2}\b")) + 260 * F.regexp_count(t, F.lit(r"(?i)\b(?:professional|employment|work|project)\s+experience\b"))
    score = score + 45 * F.regexp_count(t, F.lit(r"(?m)^\s*[•*-]\s+")) - 220 * F.size(F.filter(every, _page_marker))
    return F.when(t == "", 0).otherwise(score)


def wants_ocr(text: Column, image_pages: Column, pages: Column) -> Column:
    """Whether a PDF's text is so thin that its page images should be read."""
    n = F.char_length(T.normalise_whitespace(text))
    markers = F.size(F.filter(T.lines(text), _page_marker))
    images = F.coalesce(image_pages, F.lit(0))
    count = F.coalesce(F.when(pages > 0, pages), images)
    mean = F.when(count > 0, n / count).otherwise(n)
    heavy = F.when(count > 0, images >= F.greatest(F.lit(1), count - 1)).otherwise(images > 0)
    thin = heavy & (mean < 700)
    return F.when(n == 0, images > 0).when(count > 6, False).otherwise(thin & ((markers >= F.greatest(F.lit(1), count - 1)) | (n < 1600)))


def better_extraction(base: Column, ocr: Column) -> Column:
    return F.when(extraction_score(ocr) > extraction_score(base) + 400, ocr).otherwise(base)


def overlap(blocks: DataFrame, items: DataFrame, keys: list[str], text: str = "line") -> DataFrame:
    """(item_id, keys, score): the share of an item's distinct tokens that a block has; blocks without a common token don't appear.

    Items and blocks meet by their tokens, so nothing is paired that shares none.
    """
    q = items.select("item_id", T.distinct_tokens(F.col("text")).alias("qs")).select("item_id", F.greatest(F.size("qs"), F.lit(1)).alias("n"), F.explode("qs").alias("t"))
    b = blocks.select(*keys, F.explode(T.distinct_tokens(F.col(text))).alias("t"))
    return b.join(q, "t").groupBy("item_id", *keys).agg((F.count(F.lit(1)) / F.first("n")).alias("score"))


class _Best:
    """The k best blocks of each item among those that a task has seen: by score, then by place.

    Items are postings: the items of each token. An item whose k-th best score so far is T can only gain
    from blocks that share at least (T - the largest bonus) * n of its n tokens, and such a block holds one at
    least of all but that many minus one of them. So only the postings of the tokens that are rarest in a batch are
    walked, and fewer of them the better the best are; the frequent ones just count where a block is a candidate anyway.
    """

    def __init__(self, items: list[list[str]], k: int):
        self.k, self.n = k, len(items)
        self.ids: dict[str, int] = {}
        own = [[self.ids.setdefault(t, len(self.ids)) for t in ts] for ts in items]
        self.sizes = np.array([len(ts) for ts in own], np.int64)
        self.tokens, self.owner = np.concatenate([np.array(ts, np.int64) for ts in own]), np.repeat(np.arange(self.n), self.sizes)
        self.width = len(self.ids)
        self.members = np.sort(self.owner * self.width + self.tokens)
        self.least = np.full(self.n, -np.inf)
        self.rows = np.zeros(0, ROW)

    def _known(self, text: str | None) -> set[int]:
        """The distinct tokens of a text that some item has: ``distinct_tokens`` without those that no item can match."""
        words = _TOKEN.findall((text or "").lower())
        if text and _CJK.search(text):
            words = [w for x in words for w in ([x[i : i + 2] for i in range(max(1, len(x) - 1))] if _CJK.search(x) else [x])]
        own = set(map(self.ids.get, words))
        own.discard(None)
        return own

    def add(self, docs: np.ndarray, places: np.ndarray, bonuses: np.ndarray, texts: list[str | None]) -> None:
        """Blocks of a batch."""
        own = [self._known(t) for t in texts]
        counts = np.array([len(x) for x in own], np.int64)
        ids = np.fromiter(chain.from_iterable(own), np.int64, counts.sum())
        if not len(ids):
            return
        line, starts = np.repeat(np.arange(len(docs)), counts), np.concatenate([[0], np.cumsum(counts)])
        seen = np.bincount(ids, minlength=self.width)
        # tokens of an item, rarest first, and how many of them have to be walked
        order = np.lexsort((seen[self.tokens], self.owner))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        need = np.where(np.isfinite(self.least), np.ceil((self.least - bonuses.max() - NEAR) * self.sizes - 1e-9), 1)
        walk = self.sizes - np.maximum(need, 1) + 1
        chosen = order[(rank < np.repeat(walk, self.sizes)) & (seen[self.tokens[order]] > 0)]
        posted, holders = self.tokens[chosen], self.owner[chosen]
        by = np.argsort(posted, kind="stable")
        posted, holders = posted[by], holders[by]
        first, last = np.searchsorted(posted, ids), np.searchsorted(posted, ids, "right")
        step = last - first
        total = np.cumsum(step)
        # whole blocks at a time, whose postings are about as many as candidates may be
        cuts = np.unique(np.concatenate([[0], starts[line[np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS))]], [len(ids)]]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            n = step[a:b]
            if n.any():
                at = np.repeat(first[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())
                self._score(np.unique(np.repeat(line[a:b], n) * self.n + holders[at]), docs, places, bonuses, starts, ids)

    def _score(self, pairs: np.ndarray, docs: np.ndarray, places: np.ndarray, bonuses: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> None:
        """Whole counts of candidates (line * items + item), and the best of them."""
        line, item = pairs // self.n, pairs % self.n
        step = starts[line + 1] - starts[line]
        at = np.repeat(starts[line] - np.cumsum(step) + step, step) + np.arange(step.sum())
        key = np.repeat(item, step) * self.width + ids[at]
        place = np.minimum(np.searchsorted(self.members, key), len(self.members) - 1)
        common = np.add.reduceat((self.members[place] == key).astype(np.int64), np.cumsum(step) - step)
        score = common / self.sizes[item] + bonuses[line]
        good = (common > 0) & (score >= self.least[item] - NEAR)
        out = np.zeros(int(good.sum()), ROW)
        out["item"], out["doc"], out["place"], out["common"], out["bonus"], out["score"] = item[good], docs[line[good]], places[line[good]], common[good], bonuses[line[good]], score[good]
        rows = np.concatenate([self.rows, out])
        rows = rows[np.lexsort((rows["place"], rows["doc"], -rows["score"], rows["item"]))]
        firsts = np.searchsorted(rows["item"], np.arange(self.n))
        rank = np.arange(len(rows)) - firsts[rows["item"]]
        edge = rows[rank == self.k - 1]
        self.least[edge["item"]] = edge["score"]
        # scores that rounding could make equal to the k-th one stay too
        limit = self.least[rows["item"]]
        self.rows = rows[(rank < self.k) | ((np.abs(rows["score"] - limit) <= NEAR) & (rows["score"] != limit))]


def best_overlaps(blocks: DataFrame, items: DataFrame, keys: list[str], k: int, text: str = "line", bonus: Column | None = None, most: int = ITEMS) -> DataFrame:
    """item_id, keys (two whole numbers), score: all that can be among an item's k best blocks, by share of common tokens and bonus, then by keys.

    Up to ``most`` items go to every task, which keeps its own k best of each and shuffles
    nothing else; more than that meet the blocks by their tokens, in a shuffle.
    """
    bonus = F.lit(0.0) if bonus is None else bonus
    asked = items.select("item_id", T.distinct_tokens(F.col("text")).alias("qs")).filter(F.size("qs") > 0).limit(most + 1).collect()
    if len(asked) > most:
        scored = overlap(blocks, items, keys, text).join(blocks.select(*keys, bonus.alias("bonus")), keys).withColumn("score", F.col("score") + F.col("bonus"))
        return scored.select("item_id", *keys, "score")
    questions = [list(r["qs"]) for r in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(questions, k) if questions else None
        for b in batches:
            if best is None:
                continue
            # the first blocks give a first bound to the rest
            for at, n in ((0, FIRST), (FIRST, b.num_rows)):
                part = b.slice(at, n)
                if part.num_rows:
                    docs, places, bonuses = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
                    best.add(docs, places, bonuses, part.column(3).to_pylist())
        rows = best.rows if best is not None else np.zeros(0, ROW)
        yield pa.RecordBatch.from_pydict({c: pa.array(rows[c], t) for c, t in zip(("item", "doc", "place", "common", "bonus"), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)})

    # a null in a key sorts before all numbers, here and there
    low = -(1 << 63)
    sent = blocks.select(*[F.coalesce(F.col(c).cast("bigint"), F.lit(low)).alias(f"k{i}") for i, c in enumerate(keys)], bonus.alias("bonus"), F.col(text).alias("text"))
    local = sent.mapInArrow(run, "item bigint, doc bigint, place bigint, common bigint, bonus double")
    named = items.sparkSession.createDataFrame([(i, r["item_id"], float(len(r["qs"]))) for i, r in enumerate(asked)], f"item bigint, item_id {items.schema['item_id'].dataType.simpleString()}, n double")
    back = lambda c, key: F.when(F.col(c) != low, F.col(c)).cast(blocks.schema[key].dataType).alias(key)
    joined = local.join(F.broadcast(named), "item")  # at most ``most`` rows
    return joined.select("item_id", back("doc", keys[0]), back("place", keys[1]), (F.col("common") / F.col("n") + F.col("bonus")).alias("score"))


def retrieve(blocks: DataFrame, items: DataFrame, k: int, preferred: Column | None = None) -> DataFrame:
    """The k best blocks of each item, over all documents: overlap, more for preferred sections and for a document's first block."""
    bonus = F.when(F.col("line_no") == 0, V.LEAD_BONUS).otherwise(0.0)
    if preferred is not None:
        bonus = bonus + F.when(preferred, V.PREFERRED_BONUS).otherwise(0.0)
    scored = best_overlaps(blocks, items, ["doc_id", "line_no"], k, bonus=bonus).withColumn("score", F.round("score", 6))
    return R.top_k(scored, ["item_id"], [F.col("score").desc(), F.col("doc_id"), F.col("line_no")], k)


def select_blocks(blocks: DataFrame, query_tokens: Column, preferred: Column, kind: Column) -> DataFrame:
    """The blocks of each document that go into a request: the first one always (not of guidance), then by score; in document order.

    Columns of blocks: doc_id, order, text. Limits by kind of document: 8, 6, 1, else 4.
    """
    lead = (F.col("order") == 0) & (kind != "guidance")
    share = F.size(F.array_intersect(T.distinct_tokens(F.col("text")), query_tokens)) / F.greatest(F.size(query_tokens), F.lit(1))
    score = share + F.when(preferred, V.PREFERRED_BONUS).otherwise(0.0) + F.when(F.col("order") == 0, V.LEAD_BONUS).otherwise(0.0)
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in V.LIMITS.items() for x in kv]), kind), F.lit(V.OTHER_LIMIT))
    most, first = R.fresh(blocks, "most", "first")
    ranked = blocks.select("*", F.when(lead, 1.0).otherwise(F.round(score, 4)).alias("score"), limit.alias(most), lead.alias(first))
    w = R.Window.partitionBy("doc_id").orderBy(F.col(first).desc(), F.col("score").desc(), "order")
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col(most)).drop(most, first)


def language_vote(df: DataFrame, scope: str, text: str) -> DataFrame:
    """Per scope: texts in English, texts in Chinese, and whether the latter outvote the former."""
    x = T.some(F.col(text))
    chinese = x.rlike("[㐀-鿿]")
    english = ~chinese & (F.regexp_count(x, F.lit("[A-Za-z]{3,}")) >= 4)
    votes = df.groupBy(scope).agg(F.sum(english.cast("bigint")).alias("target"), F.sum(chinese.cast("bigint")).alias("opposite"))
    return votes.withColumn("needs_normalization", (F.col("opposite") >= 2) & (F.col("opposite") > F.col("target")))
