"""Plain versions of the contracts, over rows as dictionaries."""

import hashlib
import re
import zlib

import numpy as np


def chat(rows):
    by = {}
    for r in rows:
        by.setdefault(r["conv_id"], []).append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(t for _, _, r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()
        out[conv] = (len(turns), digest, len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def quantise(v):
    x = None if v is None else np.array([np.nan if c is None else c for c in v], np.float64)
    return None if x is None or not np.isfinite(x).all() else [int(c) for c in np.floor(x * 1024)]


def topk(rows, k=10):
    ok = [(r["vec_id"], quantise(r["embedding"])) for r in rows if r["vec_id"] is not None]
    ok = [(i, v) for i, v in ok if v is not None]
    out = set()
    for q, v in {(i, tuple(v)) for i, v in ok if i % 100 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def dedup(rows):
    by = {}
    for r in rows:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), []).append(r)
    out = []
    for norm, own in by.items():
        own.sort(key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        for k, r in enumerate(own):
            out.append((r["doc_id"], own[0]["doc_id"], len(own), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return out


def shingle_set(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def near(rows, width, percent):
    sets = [(r["doc_id"], shingle_set(r["text"], width)) for r in rows]
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    posts = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            posts.setdefault(x, []).append(i)
    tried = set()
    for own in posts.values():
        for n, i in enumerate(own):
            for j in own[:n]:
                if (j, i) not in tried:
                    tried.add((j, i))
                    common = len(sets[i][1] & sets[j][1])
                    if 100 * common >= percent * (len(sets[i][1]) + len(sets[j][1]) - common):
                        top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least.get(find(i)) if s else d, d == (least.get(find(i)) if s else d)) for i, (d, s) in enumerate(sets)]


def pieces(rows, encode, size=2048):
    out = []
    for r in rows:
        ids = [*encode(r["text"] or ""), 0]
        first = len(ids) % size or size if len(ids) > size else len(ids)
        starts = [0, *range(first, len(ids), size)]
        for k, s in enumerate(starts):
            part = ids[s : starts[k + 1] if k + 1 < len(starts) else len(ids)]
            out.append((r["doc_id"], k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def warc(rows):
    data = [(r["page_id"], (r["html"] or "").encode()) for r in rows]
    most = {}
    for p, d in data:
        if len(d) >= 1000:
            most[d] = max((x for x in (most.get(d), p) if x is not None), default=None)
    out = []
    for p, d in data:
        again = len(d) >= 1000 and most[d] != p
        out.append((p, len(d), hashlib.sha1(d).hexdigest(), "revisit" if again else "response", most[d] if again else None))
    return out


def line_templates(rows, min_docs, depth=2, alike=0.8):
    """{text: (lines, dropped, kept text)} by the definition, without its tree or tables."""

    def tokens(line):
        return ["<*>" if any("0" <= c <= "9" for c in t) else t for t in line.split()]

    leaves, holders = {}, {}
    for n, r in enumerate(rows):
        for line in (r["text"] or "").split("\n"):
            t = tokens(line)
            if t:
                leaves.setdefault((len(t), *t[:depth]), {}).setdefault(tuple(t), set()).add(n)
    template = {}
    for leaf, own in leaves.items():
        known = []
        for line in sorted(own, key=lambda x: (-len(own[x]), " ".join(x))):
            best, share = None, 0
            for k, t in enumerate(known):
                s = sum(a == b and a != "<*>" for a, b in zip(t, line)) / len(line)
                if s > share:
                    best, share = k, s
            if best is not None and share >= alike:
                known[best] = [a if a == b else "<*>" for a, b in zip(known[best], line)]
            else:
                known.append(list(line))
                best = len(known) - 1
            template[line] = (leaf, best)
            holders.setdefault((leaf, best), set()).update(own[line])
    out = []
    for r in rows:
        every = (r["text"] or "").split("\n")
        gone = [bool(tokens(x)) and len(holders[template[tuple(tokens(x))]]) >= min_docs for x in every]
        out.append((r["doc_id"], sum(bool(x.split()) for x in every), sum(gone), "\n".join(x for x, g in zip(every, gone) if not g)))
    return out


def viterbi(word, pieces, unknown):
    """The best segmentation of a word by exhaustive recursion."""
    from functools import lru_cache

    @lru_cache(None)
    def best(i):
        if i == 0:
            return 0.0, ()
        ways = [(best(j)[0] + pieces[word[j:i]], -(i - j), best(j)[1] + (word[j:i],)) for j in range(i) if word[j:i] in pieces]
        if word[i - 1 : i] not in pieces:
            ways.append((best(i - 1)[0] + unknown, -1, best(i - 1)[1] + (word[i - 1 : i],)))
        top = max(w[0] for w in ways)
        s, _, path = min((w for w in ways if w[0] == top), key=lambda w: w[1])
        return s, path

    return best(len(word))
