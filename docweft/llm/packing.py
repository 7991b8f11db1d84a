"""Best-fit packing of token sequences, by a hierarchy of residuals.

1. Documents are dealt one by one over tasks of bounded bytes (a rebalancing shuffle without a key), so that
   every task has all lengths, however the table is ordered, and copies are no hot key.
2. Every task tokenizes its documents, adds the separator, cuts what is longer than a
   sequence (the remainder comes first) and packs its own pieces: longest first, each
   into the fullest bin that still takes it.
3. Bins with at most ``slack`` free places are done. The others go up as items, with
   their fill as length, ``FAN`` tasks at a time to one, and are packed again, until one
   task is left. So only bins move, never pieces or texts.
4. A task passes on its T emptiest bins, where T is the number of tasks of step 2; the
   others are done. That loses nothing: best-fit leaves at most one bin per task that is half
   full or less, only such a bin can be put into another, so at most T bins are ever wanted
   to take one in; and of all bins with room for it at least as many are among the T
   emptiest as there are bins to be placed. What a task gets is FAN * T rows at most.

Empty pieces don't occur: a null or empty text has the separator alone. A null doc_id
is packed like any other; repeated rows are documents of their own, also where id and text are the same. An empty table
gives no pieces. A very long text is tokenized whole; a task holds the pieces of its share of the documents, 40 bytes each. Other columns are not read. Ids of whole numbers are carried exactly.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import carried, restored
from .workspace import Workspace

FAN = 8
PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint, leaf bigint, at bigint, fill bigint, task bigint"

_encoders: dict[str, "Encoder"] = {}

#: A run of so much white space is more than tiktoken's splitter may have the stack for.
RUN = 10_000
_RUN = re.compile(rf"\s{{{RUN}}}")


#: How the byte-level vocabularies split a text before merging; part of their definition.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: bytes that print stand for themselves."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(model: dict) -> dict[bytes, int] | None:
    """The pieces of a vocabulary file by rank; None where normalising, splitting or merging isn't the plain byte-level kind."""
    split, bpe = model.get("pre_tokenizer") or {}, model["model"]
    plain = not model.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    plain = plain and bpe.get("type", "BPE") == "BPE" and not any(bpe.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if not plain or not isinstance(bpe.get("vocab"), dict):
        return None
    alphabet, special, vocab = _alphabet(), {t["content"] for t in model.get("added_tokens") or []}, bpe["vocab"]
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in bpe["merges"]]
    order = [vocab.get(piece, -1) for piece in made]
    # ranks stand for the merges if those come in the order of the ids of what they make, and make all pieces
    whole = set(made) | set(alphabet) >= vocab.keys() - special and vocab.keys() >= set(alphabet)
    if not whole or -1 in order or any(a >= b for a, b in zip(order, order[1:])):
        return None
    return {bytes(alphabet[c] for c in piece): i for piece, i in vocab.items() if piece not in special}


class Encoder:
    """Ids of a byte-level BPE as the tokenizers library gives them, 4 bytes each.

    The library's own encoder takes four times the CPU of tiktoken's, so tiktoken merges
    by the ranks of the library's vocabulary file. Texts beyond Latin-1, where versions of
    Unicode could split differently, those with the special token and those with very long runs of white space go to the library, and so do
    all texts where the file asks for anything else than that splitting and merging.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.path, self.special, self.fast = path, tuple({t["content"] for t in model.get("added_tokens") or []}), None
        if ranks := _ranks(model):
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            plain = self.fast is not None and not any(s in text for s in self.special) and (len(text) < RUN or not _RUN.search(text))
        except UnicodeEncodeError:
            plain = False
        if plain:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
            except ValueError:  # its splitter gives up on texts that take too much stack
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin; longest item first, each to the fullest bin with room."""
    where, at, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    bins: dict[int, list[int]] = {}
    frees: list[int] = []  # distinct free spaces, ascending
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        j = bisect_left(frees, n)
        if j == len(frees):
            b = len(fill)
            fill.append(0)
        else:
            b = bins[frees[j]].pop()
            if not bins[frees[j]]:
                del bins[frees[j]], frees[j]
        where[i], at[i] = b, fill[b]
        fill[b] += n
        if free := size - fill[b]:
            if free not in bins:
                bins[free] = []
                insort(frees, free)
            bins[free].append(b)
    return where, at, np.array(fill, np.int64)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first has the remainder."""
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))] if n > size else [(0, n)]


def _leaves(docs: DataFrame, path: str, size: int, separator: int, with_ids: bool, token_ids: Callable[[str], bytes] | None) -> DataFrame:
    """The pieces, packed task by task; leaf is the bin, unique over all tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, task, end = token_ids or encoder(path).encode, TaskContext.get().partitionId(), np.array([separator], "<u4").tobytes()
        held, kept = [], []
        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                data = encode(text or "") + end
                for k, (s, n) in enumerate(cut(len(data) // 4, size)):
                    part = data[4 * s : 4 * (s + n)]
                    held.append((doc, k, s, n, zlib.crc32(part)))
                    if with_ids:
                        kept.append(np.frombuffer(part, "<u4").astype(np.int32))
        out = pd.DataFrame(held, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
        where, at, fill = best_fit(out["length"].to_numpy(np.int64), size)
        out["leaf"], out["at"], out["fill"], out["task"] = where + (task << 32), at, fill[where] if len(out) else 0, task
        if with_ids:
            out["ids"] = kept
        for i in range(0, len(out), 4096):
            yield out.iloc[i : i + 4096]

    named = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(run, f"doc_id {named}, {PIECE}" + ", ids array<int>" * with_ids)


def _rise(size: int, slack: int, most: int, level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One node of the tree: its bins as items, packed again; leaves follow the bin they are in."""

    def rise(df: pd.DataFrame) -> pd.DataFrame:
        task = int(df["task"].iloc[0])
        items = df.drop_duplicates("bin").sort_values(["fill", "bin"], ascending=[False, True])
        where, at, fill = best_fit(items["fill"].to_numpy(np.int64), size)
        to = pd.DataFrame({"bin": items["bin"].to_numpy(), "to": where + (task << 32) + (level << 56), "by": at, "new": fill[where]})
        df = df.merge(to, on="bin")
        emptiest = np.sort(fill)[most] if len(fill) > most else size + 1
        ready = last | (df["new"] >= min(size - slack, emptiest))
        return pd.DataFrame({"leaf": df["leaf"], "bin": df["to"], "shift": df["shift"] + df["by"], "fill": df["new"], "task": df["task"], "ready": ready})

    return rise


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = 2048, separator: int = 0, slack: int = 0, with_ids: bool = False, token_ids: Callable[[str], bytes] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and the ids, if asked for).

    ``tokenizer`` is the path of a tokenizers file, there on every machine; ``token_ids``
    takes its place in tests. Sequence ids are any distinct numbers.
    """
    work = Workspace(docs.sparkSession, "packing")
    kind = docs.schema[doc_id].dataType
    docs = docs.select(carried(F.col(doc_id), kind).alias("doc_id"), F.col(text).alias("text"))
    docs = docs.hint("rebalance")
    pieces = work.keep(_leaves(docs, tokenizer, size, separator, with_ids, token_ids), "pieces")
    # a leaf bin: where it is (bin, shift) and how full that bin is
    bins = pieces.groupBy("leaf").agg(F.first("fill").alias("fill"), F.first("task").alias("task"))
    bins = work.keep(bins.select("leaf", F.col("leaf").alias("bin"), F.lit(0).cast("bigint").alias("shift"), "fill", "task"), "bins0")
    tasks, level, done = (bins.agg(F.max("task")).first()[0] or 0) + 1, 0, None
    most = tasks
    unready = F.col("fill") < size - slack
    done, rising = bins.filter(~unready), bins.filter(unready)
    while tasks > 1 or level == 0:
        level, tasks = level + 1, -(-tasks // FAN)

        rise = _rise(size, slack, most, level, tasks == 1)
        up = rising.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("task").applyInPandas(rise, "leaf bigint, bin bigint, shift bigint, fill bigint, task bigint, ready boolean")
        up = work.keep(up, f"bins{level}")
        done, rising = done.unionByName(up.filter("ready").drop("ready")), up.filter("not ready").drop("ready")
    placed = work.keep(done.select("leaf", "bin", "shift"), "placed")
    out = pieces.join(placed, "leaf").select(restored(F.col("doc_id"), kind).alias("doc_id"), "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), (F.col("at") + F.col("shift")).alias("offset"), *(["ids"] if with_ids else []))
    return out
