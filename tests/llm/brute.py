"""Slow, plain versions of the training-data operators, written from their definitions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def order(doc_id):
    """Ids in order, null last."""
    return (doc_id is None, doc_id or 0)


def fingerprint(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, most=3):
    """Fingerprint to the set of all fingerprints that a chain of links reaches."""
    left, out = set(fps), {}
    while left:
        todo, group = [left.pop()], set()
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= most}
            left -= near
            todo += near
        out |= dict.fromkeys(group, group)
    return out


def base_rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    places = defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i : i + 3])].append(i)
    inside = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def quality(rows, floor=20, share=0.05, least=0.5):
    """rows (id, text, host) to (id, text, host): base rules, failed, removed words, kept."""
    normal = lambda line: " ".join(words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)))
    docs, texts, ids = set(rows), defaultdict(set), {}
    held = defaultdict(lambda: defaultdict(list))
    for i, text, host in docs:
        texts[host].add(text)
        for line in {normal(x) for x in (text or "").split("\n")} - {""}:
            held[host, line][text].append(i)
    over = {k: min(((i, t) for t, x in v.items() for i in x), key=lambda r: order(r[0]))[1] for k, v in held.items() if len(v) > floor and len(v) > share * len(texts[k[0]])}
    out = {}
    for i, text, host in docs:
        base = base_rules(text)
        gone = sum(len(words(x)) for x in (text or "").split("\n") if (k := (host, normal(x))) in over and over[k] != text)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        out[i, text, host] = (*base, failed, gone, not failed and base[0] - gone >= least * base[0])
    return out


def substrings(rows, size=20):
    """rows (id, text), distinct, to {(id, text): (n_words, n_removed, kept words)}."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: order(r[0])):
        w, gone = words(text), set()
        for k in range(len(w) - size + 1):
            window = tuple(w[k : k + size])
            if window in seen:
                gone |= set(range(k, k + size))
            seen.add(window)
        out[i, text] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def line_removals(rows, patience, min_words=4):
    """rows (id, text), distinct and in order, to the set of lines that go from each.

    Long lines: by alignment with every earlier document. Short ones: with a block
    of the first holder of one of the long lines. A document with the long lines of
    an earlier one is aligned with the first such alone."""
    lines = [[x.strip("\t\n\v\f\r ") for x in (t or "").split("\n")] for _, t in rows]
    at = [[k for k, x in enumerate(own) if len(words(x)) >= min_words] for own in lines]
    long = [[own[k] for k in where] for own, where in zip(lines, at)]

    def stretch(d, k):
        """The lines of document d before its k-th long line."""
        lo, hi = ([-1, *at[d]][k] + 1, [*at[d], len(lines[d])][k])
        return list(range(lo, hi)), [" ".join(lines[d][x].split()) and lines[d][x] for x in range(lo, hi)]

    def side(a, b, m):
        out = set()
        for i, j in m:
            if (i, j) == (0, 0) or (i - 1, j - 1) in m:
                out |= set(stretch(b, j)[0]) if stretch(a, i)[1] == stretch(b, j)[1] else set()
        if (i, j) == (len(long[a]) - 1, len(long[b]) - 1) and stretch(a, i + 1)[1] == stretch(b, j + 1)[1]:
            out |= set(stretch(b, j + 1)[0])
        return out

    holders, first_of, out = defaultdict(list), {}, []
    for b in range(len(rows)):
        gone, key = set(), tuple(long[b])
        same = first_of.setdefault(key, b) if key else b
        near = {same} if same != b else {holders[x][0] for x in key if holders[x]}
        for a in {same} if same != b else {a for x in key for a in holders[x]}:
            m = patience(long[a], long[b])
            gone |= {at[b][j] for _, j in m}
            if m and a in near:
                gone |= side(a, b, m)
        if same == b:
            for x in set(key):
                holders[x].append(b)
        out.append(gone)
    return out


def water(totals, weights, cap=3):
    """Targets of each source: the level at which capped shares add up to the whole."""
    whole = sum(totals)
    lo, hi = 0.0, 1e6 * (whole + 1)
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(cap * t, mid * w) for t, w in zip(totals, weights)) < whole else (lo, mid)
    return [min(cap * t, lo * w) for t, w in zip(totals, weights)]


def pieces(ids, capacity=4096):
    """start, length, crc of each piece of a document's ids."""
    ids = [*ids, 1]
    cut = [ids[k : k + capacity] for k in range(0, len(ids), capacity)]
    return [(k * capacity, len(c), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in c))) for k, c in enumerate(cut)]


class KneserNey:
    """Interpolated Kneser-Ney over the grams that end at each unit of the training texts."""

    def __init__(self, grams, order, vocabulary):
        self.order, self.vocabulary = order, vocabulary
        self.counts = {order: Counter(grams)}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])

    def d(self, k):
        one, two = (sum(v == x for v in self.counts[k].values()) for x in (1, 2))
        return min(max(one / max(one + 2 * two, 1), 0.1), 0.95)

    def p(self, gram):
        k, c = len(gram), self.counts[len(gram)]
        d = self.d(k)
        own = {g: n for g, n in c.items() if g[:-1] == gram[:-1]}
        low = 1 / self.vocabulary if k == 1 else self.p(gram[1:])
        if not own:
            return low
        total = sum(own.values())
        return max(c[gram] - d, 0) / total + d * len(own) / total * low


def near(a, b, share, least=1.0):
    return math.isclose(a, b, rel_tol=share, abs_tol=least)
