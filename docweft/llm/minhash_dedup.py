r"""Near-duplicate detection by a signature-coordinate inverted join.

1. Every text becomes the set of its word shingles (64-bit hashes), the set a MinHash
   signature of ``k`` coordinates. Rows with equal sets become one node.
2. Nodes are posted under each of their (coordinate, value) pairs. A pair that only
   one node has can't collide. Two sets of the wanted similarity share at least ``t``
   of ``k`` coordinates but for a chance below ``MISS``; so of each node only the
   k - t + 1 shortest lists are merged (prefix), and the longer ones are skipped: they
   are counted by comparing the signatures of the candidates that were found.
3. Shingles that one candidate alone has can't be in an intersection, which bounds a
   node's similarity to all others; nodes and pairs below the bound go.
4. Each list has leaders; the collisions of a node with them are counted on merged and skipped lists
   alike, pairs with at least ``t`` are confirmed on the full sets, and
   give components. Pairs of nodes in different components are found by their
   differences from a common leader (see _beyond_leaders); those with at least ``t``
   collisions are confirmed on the full sets too. So no link between two components is
   missed, while the pairs inside a component, which grow with the square of a group of
   copies, are never made.
5. Components come from min-label propagation with pointer jumping over the links.

All joins shuffle, so that no table goes through the driver.

Words: ``[^\x20\x09-\x0D]+`` after lower-casing A-Z. A text with fewer words than a
shingle has one shingle, the whole sequence; a null text or one without words has an
empty set and is linked with nothing. Rows of equal or null doc_id are told apart by a hash of
their texts: all rows with one set are in one component. Whole-number ids are carried exactly. A null doc_id never is a component_id while
another is to be had. Whole texts are read; other columns are not.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import carried, fresh, restored
from .memory import give_back
from .workspace import Workspace

MISS, ROUNDS = 1e-8, 3
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


_words = _Words()


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[1]
    h = (h ^ (h >> np.uint64(29))) * _MIX[2]
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for j in range(min(width, len(h))):
        out = _scramble(out * _MIX[0] + h[j : j + n])
    return np.unique(out)


@lru_cache
def _coefficients(k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, np.uint64)


def signature(s: np.ndarray, k: int) -> np.ndarray:
    """The k least values of multiply-shift hashes of a set, 32 bits each."""
    a, b = _coefficients(k)
    out = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        out = np.minimum(out, (s[at : at + 4096, None] * a + b).min(0))
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def least_matches(k: int, similarity: float) -> int:
    """The largest t for which a pair of this similarity has fewer than t of k collisions with a chance below MISS."""
    total = 0.0
    for i in range(k + 1):
        total += comb(k, i) * similarity**i * (1 - similarity) ** (k - i)
        if total > MISS:
            return max(1, i)
    return k


def _sets(docs: DataFrame, width: int, k: int) -> DataFrame:
    """Per row: doc_id, mark (a hash of the text), n, node (a 128-bit name of the set), sig."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, node, sig = [], [], []
            for text in b["text"]:
                s = shingles(text, width)
                n.append(len(s))
                node.append(xxhash.xxh128_digest(s.tobytes()))
                sig.append(signature(s, k) if len(s) else None)
            yield pd.DataFrame({"doc_id": b["doc_id"], "mark": b["mark"], "n": n, "node": node, "sig": sig})
            give_back()

    docs = docs.select(carried(F.col("doc_id"), kind).alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    out = docs.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark bigint, n bigint, node binary, sig array<int>")
    return out.withColumn("doc_id", restored(F.col("doc_id"), kind))


def _full_sets(work: Workspace, docs: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(nid, shingles, sig) of the wanted nids, made from their whole texts again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [shingles(text, width) for text in b["text"]]
            same = [xxhash.xxh128_digest(s.tobytes()) == bytes(x) for s, x in zip(made, b["node"], strict=True)]
            out = pd.DataFrame({"nid": b["nid"], "shingles": [s.view(np.int64) for s in made], "sig": b["sig"]})[same]
            for at in range(0, len(out), 100):
                yield out.iloc[at : at + 100]

    # a set is located by a row that has it: its doc_id and the hash of its text, so that rows of one doc_id don't meet as a product
    wanted = wanted.join(nodes.select("nid", "node", "sig", F.col("at.doc_id").alias("at_id"), F.col("at.mark").alias("at_mark")), "nid")
    marked = docs.withColumn("mark", F.xxhash64("text"))
    texts = marked.join(wanted, marked["doc_id"].eqNullSafe(wanted["at_id"]) & (marked["mark"] == wanted["at_mark"])).select("nid", "node", "sig", "text")
    return work.keep(texts.mapInPandas(run, "nid bigint, shingles array<bigint>, sig array<int>").dropDuplicates(["nid"]), "sets")


def _collisions(a: str, b: str) -> Column:
    """In how many coordinate-value lists two nodes are together, merged ones and skipped ones."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def _verified(work: Workspace, name: str, nodes: DataFrame, sets: DataFrame, pairs: DataFrame, t: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of nids, those that have t collisions and, on full sets, 100 * intersection >= percent * union."""
    side = lambda x: nodes.select(F.col("nid").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    close = work.keep(pairs.join(side("a"), "a").join(side("b"), "b").filter(_collisions("sa", "sb") >= t).select("a", "b", "na", "nb"), f"{name}_close")
    full = close.join(sets.select(F.col("nid").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("nid").alias("b"), F.col("shingles").alias("xb")), "b")
    common = F.size(F.array_intersect("xa", "xb"))
    out = work.keep(full.filter(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b"), f"{name}_links")
    work.drop(f"{name}_close")
    return out


def components(work: Workspace, name: str, links: DataFrame) -> DataFrame:
    """(nid, comp): the smallest nid that the links reach from each nid they name."""
    both = work.keep(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), f"{name}_both")
    label = work.keep(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("comp")).select(F.col("u").alias("nid"), "comp"), f"{name}_0")
    step = 0
    while True:
        near = both.join(label.select(F.col("nid").alias("v"), "comp"), "v").groupBy("u").agg(F.min("comp").alias("near"))
        moved = label.join(near, label["nid"] == near["u"]).select("nid", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        moved = work.keep(moved, f"{name}_near{step}")
        jump = moved.select(F.col("nid").alias("comp"), F.col("comp").alias("far"))
        fresh = work.keep(moved.join(jump, "comp", "left").select("nid", F.coalesce("far", "comp").alias("comp"), (F.coalesce("far", "comp") != F.col("old")).alias("changed")), f"{name}_{step + 1}")
        work.drop(f"{name}_{step}", f"{name}_near{step}")
        label, step = fresh.select("nid", "comp"), step + 1
        if not fresh.filter("changed").limit(1).count():
            work.drop(f"{name}_both")
            return label


def _labels(work: Workspace, name: str, links: DataFrame, able: DataFrame) -> DataFrame:
    """(nid, comp) of all nodes that can have links; those without keep their own."""
    comp = components(work, name, links)
    return able.select("nid").join(comp, "nid", "left").select("nid", F.coalesce("comp", "nid").alias("comp"))


def _around_leaders(work: Workspace, merged: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(r, nid, n, nr, d, diff, near, hits): nodes of a list by their differences from leaders of that list.

    A list's first leader is its most central node. Nodes near it (a
    similarity of a half) are done; the others choose a next leader among them, in ROUNDS
    rounds. What is left then gets no leader: r is -1, nr 0, and diff the whole set.
    """
    share, q = percent / 100, (100 - percent) / (100 + percent)
    # common coordinates, and few shingles that no other node has: such a node is in the middle of its copies
    central = F.col("weight") * F.pow(F.col("shared") / F.col("n"), F.lit(8.0))
    todo, groups, known = merged.select("key", "nid", "n", central.alias("central")), [], None
    for step in range(ROUNDS):
        lead = todo.groupBy("key").agg(F.min_by("nid", F.struct(-F.col("central"), "nid")).alias("r"))
        member = work.keep(todo.join(lead, "key").select("key", "r", "nid"), f"member{step}")
        of_r = sets.select(F.col("nid").alias("r"), F.col("n").alias("nr"), F.col("shingles").alias("xr"), F.col("sig").alias("sr"))
        pair = member.select("r", "nid").distinct()
        pair = (pair if known is None else pair.join(known, ["r", "nid"], "left_anti")).join(sets, "nid").join(of_r, "r")
        pair = pair.select("r", "nid", "n", "nr", _collisions("sig", "sr").alias("hits"), F.concat(F.array_except("shingles", "xr"), F.array_except("xr", "shingles")).alias("diff")).withColumn("d", F.size("diff"))
        pair = pair.withColumn("near", 3 * F.col("d") <= F.col("n") + F.col("nr"))
        # a partner of a node near r can't be farther from r than this
        reach = (F.col("n") / share + F.col("nr")) / 3 + q * F.col("n") * (1 + 1 / share) + 1e-6
        group = work.keep(pair.withColumn("diff", F.when(F.col("d") <= reach, F.col("diff"))), f"around{step}")
        groups.append(group.filter("diff is not null"))
        fresh = group.select("r", "nid", "near")
        known = fresh if known is None else known.unionByName(fresh)
        done = member.join(known.filter("near"), ["r", "nid"], "left_semi").select("key", "nid")
        todo = work.keep(todo.join(done, ["key", "nid"], "left_anti"), f"todo{step}")
    alone = todo.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    rest = todo.join(alone, "key").select("nid").distinct().join(sets, "nid")
    groups.append(rest.select(F.lit(-1).cast("bigint").alias("r"), "nid", "n", F.lit(0).cast("bigint").alias("nr"), F.col("shingles").alias("diff"), F.size("shingles").alias("d"), F.lit(True).alias("near"), F.lit(0).alias("hits")))
    return reduce(DataFrame.unionByName, groups)


def _beyond_leaders(work: Workspace, around: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that can still be similar, found by what sets them apart from a leader r.

    Let D(x) be the symmetric difference of x and r, d its size, q = (1 - s) / (1 + s). Two sets
    are similar if |D(a) ^ D(b)| <= q (|a| + |b|), so they need an overlap of D(a) and D(b) of
    o >= (d(a) + d(b) - q (|a| + |b|)) / 2. At least one of them, b, is not in the leader's
    component, so d(b) > q (|r| + |b|), and for every partner
        on a's side   o > (d(a) + q (|r| - |a|)) / 2,
        on b's side   o >= (d(b) - q (|r| + |b|)) / (1 + q)   (from o <= d(a) and |a| <= |r| + d(a)).
    Without a leader D(x) is x, and o >= s |x| on either side. Under one order of the
    elements (rarest in the group first) the first d - o + 1 elements of both sides have
    to meet. Near copies of one text have almost no rare differences in common, so their
    pairs aren't made, however many there are.
    """
    plus, minus = 100 + percent, 100 - percent
    around = around.join(comp, "nid").join(comp.select(F.col("nid").alias("r"), F.col("comp").alias("comp_r")), "r", "left").withColumn("comp_r", F.coalesce("comp_r", F.lit(-1)))
    each = around.select("r", "nid", F.explode("diff").alias("h"))
    several = each.groupBy("r", "h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    own = Window.partitionBy("r", "nid")
    ranked = each.join(several, ["r", "h"]).withColumn("rank", F.row_number().over(own.orderBy("df", "h"))).withColumn("k", F.count(F.lit(1)).over(own))
    ranked = ranked.join(around.drop("diff", "hits"), ["r", "nid"])
    # elements that no other member has come first in the order and can't meet
    place = F.col("d") - F.col("k") + F.col("rank")
    whole = F.col("d") + 1 - F.ceil(F.col("d") * percent / 100 - 1e-9)
    with_a = F.when(F.col("nr") == 0, whole).otherwise(F.col("d") - F.floor((F.col("d") * plus + (F.col("nr") - F.col("n")) * minus) / (2 * plus)))
    with_b = F.when(F.col("nr") == 0, whole).otherwise(F.col("d") + 1 - F.greatest(F.lit(1), F.ceil((F.col("d") * plus - (F.col("nr") + F.col("n")) * minus) / 200)))
    ranked = ranked.select("r", "h", "nid", "n", "d", "near", "comp", "comp_r", place.alias("place"), (place <= with_a).alias("is_a"), (place <= with_b).alias("is_b"))
    ranked = work.keep(ranked.filter("is_a or (is_b and comp <> comp_r)"), "ranked")
    side = lambda df, x: df.select("r", "h", F.col("nid").alias(x), F.col("comp").alias(f"c{x}"), F.col("d").alias(f"d{x}"), F.col("n").alias(f"n{x}"), F.col("near").alias(f"near{x}"), (F.col("d") - F.col("place")).alias(f"after{x}"))
    a, b = side(ranked.filter("is_a"), "x"), side(ranked.filter("is_b and comp <> comp_r"), "y")
    fits = (F.abs(F.col("dx") - F.col("dy")) * plus <= (F.col("nx") + F.col("ny")) * minus) & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    # where the first common element is, what follows it on either side has to be enough for the overlap
    enough = 2 * (1 + F.least("afterx", "aftery")) * plus >= (F.col("dx") + F.col("dy")) * plus - (F.col("nx") + F.col("ny")) * minus
    pairs = a.join(b, ["r", "h"]).filter(enough & (F.col("x") != F.col("y")) & (F.col("cx") != F.col("cy")) & (F.col("nearx") | F.col("neary")) & fits)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, k: int = 48) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (the row has that doc_id)."""
    spark, work, t = docs.sparkSession, Workspace(docs.sparkSession, "minhash", broadcast=-1), least_matches(k, percent / 100)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = work.keep(_sets(docs, width, k), "rows")
    # copies meet after each task has made one row of its own
    nodes = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "mark")).alias("at"), F.max("n").alias("n"), F.first("sig").alias("sig"))
    nodes = work.keep(nodes.select(F.monotonically_increasing_id().alias("nid"), "*"), "nodes")

    posts = nodes.select("nid", F.posexplode("sig").alias("c", "value")).select("nid", (F.col("c").cast("bigint") * (1 << 32) + F.col("value")).alias("key"))
    lists = posts.groupBy("key").agg(F.count(F.lit(1)).alias("length")).filter("length > 1")
    shared = posts.join(lists, "key")
    # per node: its lists that can collide, shortest first; the others count as used-up places of the prefix
    prefix = k - t + 1
    by_node = shared.groupBy("nid").agg(F.sort_array(F.collect_list(F.struct("length", "key"))).alias("own")).filter(F.size("own") >= t)
    by_node = by_node.withColumn("weight", F.aggregate("own", F.lit(0).cast("bigint"), lambda x, p: x + p["length"]))
    merged = by_node.select("nid", "weight", F.explode(F.expr(f"slice(own, 1, greatest(0, size(own) - {k - prefix}))")).alias("p")).select("nid", "weight", F.col("p.key").alias("key"))
    merged = work.keep(merged, "merged")

    # what no other candidate has can't be common to two sets: it bounds the similarity of a node to any other
    sets = _full_sets(work, docs, nodes, merged.select("nid").distinct(), width)
    alone = sets.select("nid", F.explode("shingles").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("nid").alias("nid")).filter("c = 1")
    alone = alone.groupBy("nid").agg(F.count(F.lit(1)).alias("alone"))
    able = sets.select("nid").join(nodes.select("nid", "n"), "nid").join(alone, "nid", "left").select("nid", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))
    able = work.keep(able.filter(100 * F.col("shared") >= percent * F.col("n")), "able")
    merged = work.keep(merged.join(able, "nid"), "postings")
    work.drop("merged")

    work.release()

    sets = sets.join(able.select("nid", "n"), "nid")
    around = _around_leaders(work, merged, sets, percent)
    # on full differences the similarity to a leader is exact
    alike = (F.col("hits") >= t) & (F.col("d") * (100 + percent) <= (F.col("n") + F.col("nr")) * (100 - percent))
    links = work.keep(around.filter((F.col("r") >= 0) & (F.col("r") != F.col("nid")) & alike).select(F.col("r").alias("a"), F.col("nid").alias("b")), "links")
    work.release()
    comp = work.keep(_labels(work, "first", links, able), "comp")
    rest = work.keep(_beyond_leaders(work, around, comp, percent), "rest")
    more = _verified(work, "rest", nodes, sets, rest, t, percent)
    if more.limit(1).count():
        comp = _labels(work, "last", links.union(more), able)
    work.drop("postings", "sets", "rest", "ranked", *[f"around{i}" for i in range(ROUNDS)])
    work.release()

    # names of components are doc_ids again
    named = nodes.join(comp, "nid", "left").select("node", "doc_id", F.coalesce("comp", "nid").alias("comp"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    ids = work.keep(named.join(least, "comp").select("node", "component_id"), "ids")
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).otherwise(F.encode(F.concat(F.lit("empty "), F.monotonically_increasing_id().cast("string")), "UTF-8")).alias("node")).join(ids.hint("merge"), "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, k: int = 48) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component those with its smallest doc_id.

    Rows of one doc_id and one text are treated alike.
    """
    gone_id, gone_text = fresh(docs, "gone", "gone_text")
    named = docs.select(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text")).alias("doc_id"), F.col(text).alias("text"))
    gone = near_duplicates(named, "doc_id", "text", width, percent, k).filter("not kept").select(F.col("doc_id.doc_id").alias(gone_id), F.col("doc_id.text").alias(gone_text)).distinct()
    return docs.join(gone.hint("merge"), F.col(doc_id).eqNullSafe(F.col(gone_id)) & (F.md5(F.coalesce(F.col(text), F.lit(""))) == F.col(gone_text)), "left_anti")
