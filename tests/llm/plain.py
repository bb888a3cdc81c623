"""Plain versions of the operators, text by text, for comparison on small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def fingerprint(text):
    words = WORD.findall(lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(prints: dict, radius: int = 3) -> dict:
    """Least key reachable from each key."""
    keys = sorted(prints)
    values = np.array([prints[k] for k in keys], np.uint64)
    up = list(range(len(keys)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= radius) + i + 1:
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    return {k: keys[root(i)] for i, k in enumerate(keys)}


_NAME = "|".join("".join(f"[{c.upper()}{c}]" for c in n) for n in ("password", "passwd", "secret", "token"))
_ASSIGN = re.compile(rf"""(?:{_NAME}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


class KneserNey:
    """Interpolated modified Kneser-Ney bigrams over dictionaries."""

    END, START = ("end",), ("start",)

    def __init__(self, texts):
        self.count, self.pairs = Counter(), Counter()
        for t in texts:
            x = self.tokens(t)
            self.count.update(x)
            self.pairs.update(zip([self.START, *x[:-1]], x))
        self.total, self.size = sum(self.count.values()), len(self.count)
        self.before = Counter(w for _, w in self.pairs)
        self.after, self.followers = Counter(), defaultdict(lambda: [0, 0, 0, 0])
        for (v, _), n in self.pairs.items():
            self.after[v] += n
            self.followers[v][min(n, 3)] += 1
        self.d2, self.d1 = self.discounts(self.pairs.values()), self.discounts(self.before.values())
        self.free = sum(self.d1[min(n, 3)] for n in self.before.values()) / max(len(self.pairs), 1)

    def tokens(self, text):
        return [*WORD.findall(lowered(text)), self.END]

    @staticmethod
    def discounts(counts):
        n = [sum(1 for c in counts if c == k) for k in range(1, 5)]
        if min(n) <= 0:
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return [0, *(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw))]

    def unigram(self, w):
        return max(self.before[w] - self.d1[min(self.before[w], 3)], 0) / len(self.pairs) + self.free / (self.size + 1)

    def p(self, v, w):
        if not self.total:
            return 1.0
        if not self.after[v]:
            return self.unigram(w)
        n = self.pairs[v, w]
        back = sum(self.d2[k] * self.followers[v][k] for k in (1, 2, 3))
        return (max(n - self.d2[min(n, 3)], 0) + back * self.unigram(w)) / self.after[v]

    def score(self, text):
        x = self.tokens(text)
        return sum(math.log10(self.p(v, w)) for v, w in zip([self.START, *x[:-1]], x))

    def base(self, text):
        floor = self.total + 0.1 * (self.size + 1)
        return sum(math.log10((self.count[w] + 0.1) / floor) for w in self.tokens(text))
