"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substrings(rows):
    """(doc_id, text) -> {(doc_id, text): (n_words, n_removed, kept_sha256)}"""
    least, cut = {}, []
    for i, text in rows:
        w = WORD.findall(text or "")
        cut.append(w)
        if i is not None:
            for s in range(len(w) - 49):
                k = tuple(w[s : s + 50])
                least[k] = min(least.get(k, i), i)
    out = {}
    for (i, text), w in zip(rows, cut, strict=True):
        gone = set()
        if i is not None:
            for s in range(len(w) - 49):
                if least[tuple(w[s : s + 50])] < i:
                    gone |= set(range(s, s + 50))
        out[i, text] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def fingerprint(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def linked(values, near):
    """Component number of each value, by union-find over all pairs."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def chunks(text, window=2, base=31, divisor=3):
    lines, out, run = text.split("\n"), [], []
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    for i, x in enumerate(lines):
        run.append(x)
        if i == len(lines) - 1 or (h[i] + sum(base**j * h[i - j] for j in range(1, window) if i >= j)) % divisor == 0:
            out.append(run)
            run = []
    return out


def lines(rows):
    """(doc_id, text) distinct -> {(doc_id, text): (n_lines, n_removed, kept)}; a null doc_id comes first."""
    seen, out = set(), {}
    for i, text in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        kept, n, gone = [], 0, 0
        for c in chunks(text):
            n += len(c)
            if len(c) > 1 and tuple(c) in seen:
                gone += len(c)
            else:
                kept += c
                seen.add(tuple(c))
        out[i, text] = (n, gone, "\n".join(kept) if gone else text)
    return out | {(i, t): (0, 0, None) for i, t in rows if t is None}


def crc(text):
    return zlib.crc32((text or "").encode())
