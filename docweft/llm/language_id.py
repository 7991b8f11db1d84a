"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point alone. An
n-gram of three letters is bound as the product of its letters' vectors, the first
rotated by two places and the second by one; a text is the sum (bundle) of its
n-grams, a language prototype the sum of its training texts scaled to length one.
A text gets the language of the prototype with the largest cosine; the score is
that cosine, cut to 0..1.

Words are runs of letters in lower case; each is padded by one blank on either side.
A null text and one without any letter get ``und`` and score 0. Ties go to the
language that sorts first. Prototypes are fitted on at most about ``per_lang`` texts
of each language, drawn by a hash of the row's identifier (the bound holds in
expectation; it is the one bounded sample here). Every language gets a prototype; one
vector a language comes to the driver. Whole texts are read, in pieces of ``PIECE`` letters that are added up, so
memory doesn't grow with a text or with the number of its letters.

An empty table, or one without any language, has no prototypes, and every text is
``und``. Repeated rows are scored each. Only the named columns are read, so other names
can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import give_back

DIM, SEED, PIECE, GRAMS, LETTERS, UND = 1024, 20_240_801, 1 << 17, 1 << 12, 1 << 11, "und"

_letters: dict[tuple[int, int], np.ndarray] = {}


def letter_vector(code: int, dim: int = DIM) -> np.ndarray:
    if (v := _letters.get((code, dim))) is None:
        if len(_letters) >= LETTERS:
            _letters.clear()
        v = _letters[code, dim] = np.random.default_rng((SEED, code)).integers(0, 2, dim).astype(np.float32) * 2 - 1
    return v


def _table() -> np.ndarray:
    """Code point -> its lower-case letter; 32 for all that is no letter. Letters whose lower case is several points keep themselves."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_lower: np.ndarray | None = None


def _codes(text: str) -> np.ndarray:
    global _lower
    if _lower is None:
        _lower = _table()
    return _lower[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def encode(texts: list[str | None], dim: int = DIM) -> np.ndarray:
    """The bundles of texts, one row each; all zero where a text has no letter."""
    out = np.zeros((len(texts), dim), np.float32)
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text or ""), PIECE):
            # a piece begins with the two characters before it, so that no n-gram is lost or counted twice
            held.append((i, " " * (at == 0) + text[max(0, at - 2) : at + PIECE] + " " * (at + PIECE >= len(text))))
            size += len(held[-1][1])
            if size >= 2 * PIECE or len(held) >= 256:
                _add(out, held, dim)
                held, size = [], 0
    if held:
        _add(out, held, dim)
    return out


def _turned(letters: np.ndarray, which: np.ndarray, places: int, dim: int) -> np.ndarray:
    """The rotated vectors of some letters, one row for each of ``which``."""
    used, row = np.unique(which, return_inverse=True)
    return np.roll(np.stack([letter_vector(int(c), dim) for c in letters[used]]), places, 1)[row]


def _add(out: np.ndarray, held: list[tuple[int, str]], dim: int) -> None:
    """Add the n-grams of some pieces: count each n-gram by piece, then multiply counts by n-gram vectors."""
    seqs = [_codes(text) for _, text in held]
    lengths = np.array([len(s) for s in seqs])
    letters, index = np.unique(np.concatenate(seqs), return_inverse=True)
    owner = np.repeat(np.arange(len(held)), lengths)
    k = len(letters)
    blank = int(np.searchsorted(letters, 32)) if 32 in letters else -1
    # an n-gram holds a letter in its middle or is none: runs of blanks count for nothing
    fits = np.flatnonzero((owner[:-2] == owner[2:]) & (index[1:-1] != blank))
    if not len(fits):
        return
    code = (index[fits].astype(np.int64) * k + index[fits + 1]) * k + index[fits + 2]
    if k**3 <= 1 << 20:
        seen = np.zeros(k**3, np.int32)
        seen[code] = 1
        grams = np.flatnonzero(seen)
        seen[grams] = np.arange(len(grams))
        column = seen[code]
    else:
        grams, column = np.unique(code, return_inverse=True)
    to, of = np.array([i for i, _ in held]), owner[fits]
    for first in range(0, len(grams), GRAMS):  # so many n-gram vectors are held at a time
        own = grams[first : first + GRAMS]
        bound = _turned(letters, own // (k * k), 2, dim)
        bound *= _turned(letters, own // k % k, 1, dim)
        bound *= _turned(letters, own % k, 0, dim)
        mine = slice(None) if len(grams) <= GRAMS else (column >= first) & (column < first + len(own))
        counts = np.bincount(of[mine] * len(own) + column[mine] - first, minlength=len(held) * len(own)).reshape(len(held), len(own))
        np.add.at(out, to, counts.astype(np.float32) @ bound)


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 2000, dim: int = DIM) -> dict[str, list[float]]:
    """Prototypes {language: vector} of the rows, which all count as training rows; null languages don't."""
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).cast("string").alias("key")).filter("lang is not null")
    often = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not often:
        return {}
    # smaller than the prototypes, which the driver holds as well
    share = F.broadcast(rows.sparkSession.createDataFrame([(r["lang"], min(1.0, per_lang / r["n"])) for r in often], "lang string, share double"))
    drawn = rows.join(share, "lang").filter(F.crc32(F.concat(F.lit("fit "), F.coalesce("key", F.lit("")))) < F.col("share") * (1 << 32))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            v = encode(list(b["text"]), dim)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            for name in b["lang"].unique():
                total[name] = total.get(name, 0) + v[(b["lang"] == name).to_numpy()].sum(0, dtype=np.float64)
        yield pd.DataFrame([(k, list(v)) for k, v in total.items()], columns=["lang", "v"])

    parts = drawn.select("text", "lang").mapInPandas(sums, "lang string, v array<double>").select("lang", F.posexplode("v").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    # one row a language; its entries are as many as there are dimensions
    sums_of = parts.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda e: e["x"]).alias("v"))
    out: dict[str, list[float]] = {r["lang"]: [0.0] * dim for r in often} | {r["lang"]: r["v"] for r in sums_of.collect()}
    return {k: [x / (sum(y * y for y in v) ** 0.5 or 1.0) for x in v] for k, v in sorted(out.items())}


def has_letter(text: Column) -> Column:
    """Whether a text has a letter, so that its language could be told."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(text: Column, prototypes: dict[str, list[float]], dim: int = DIM) -> Column:
    """struct<lang: string, score: double> for a column of texts."""
    names = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in names], np.float32).reshape(len(names), dim).T

    @F.pandas_udf("lang string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        v = encode(list(texts), dim)
        give_back()
        norm = np.linalg.norm(v, axis=1)
        if not names:
            return pd.DataFrame({"lang": [UND] * len(texts), "score": 0.0})
        cos = v @ matrix / np.maximum(norm, 1e-9)[:, None]
        best = cos.argmax(1)
        none = norm == 0
        return pd.DataFrame({"lang": np.where(none, UND, np.array(names, object)[best]), "score": np.where(none, 0.0, np.clip(cos.max(1), 0, 1)).astype(float)})

    return guess(text)
