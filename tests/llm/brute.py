"""Plain Python versions of the corpus operators' contracts."""

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def components(rows, k, percent):
    """{doc_id: (set size, least doc_id reached)} for distinct doc_ids."""
    sets = {}
    for d, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owners = {}
    for d, s in sets.items():
        for e in s:
            owners.setdefault(e, []).append(d)
    for d, s in sets.items():
        for o, n in Counter(o for e in s for o in owners[e] if o < d).items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = root(d), root(o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def suffix_dedup(rows, window=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if (w := b[i : i + window]) in seen:
                gone[i : i + window] = b"\1" * window
            else:
                seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def base_spans(t, kinds, luhn):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), m.end(), "email") for m in EMAIL.finditer(t)]
    found += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], kinds.index(s[2]), s[1]))


def counts(t):
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i, x in enumerate(zip(w, w[1:], w[2:])):
        if windows[x] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def sketch(t, k, scale):
    """Retained hashes of k-word shingles: 64-bit XXH64 chained over the words from seed 42, signed, upper 32 bits."""
    w = WORD.findall(t)
    out = set()
    for i in range(max(1, len(w) - k + 1) if w else 0):
        h = 42
        for x in w[i : i + k]:
            h = xxhash.xxh64_intdigest(x.encode(), seed=h)
        signed = h - (1 << 64) if h >> 63 else h
        if signed < -(1 << 63) + (1 << 64) // scale:
            out.add(signed >> 32)
    return out
