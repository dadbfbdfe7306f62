"""Plain versions of the operators for small inputs."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def earlier_bytes(rows, length):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = [True] * length
            seen.add(b[p : p + length])
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()
    return out


def earlier_words(rows, window):
    words, first = {i: WORD.findall(t or "") for i, t in rows}, {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        out[i] = len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()
    return out


def classes(rows, words=5, threshold=0.8):
    """doc_id to (class_id, links)."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        sets[i] = {tuple(w[p : p + words]) for p in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    label, links = {i: i for i in sets}, collections.Counter()
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9 and sets[b]]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = {k: new if v == old else v for k, v in label.items()}
    return {i: (label[i], links[i]) for i in sets}


def context_tree(rows, depth):
    """doc_id to (held_out, tokens, known, training tokens, base score, score)."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = {i: WORD.findall(lower(t)) for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    count = collections.Counter(w for i in words if not held[i] for w in [*words[i], "\n"])
    total, different = sum(count.values()), len(count)
    node, below = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)

    def bits(i):
        s = b"\n" * depth + (" ".join(words[i]) + "\n").encode()
        for p in range(depth, len(s)):
            for b in range(8):
                yield [s[p - d : p] for d in range(depth + 1)], (1 << b) | (s[p] >> (8 - b)), (s[p] >> (7 - b)) & 1

    for i in words:
        if not held[i]:
            for contexts, m, bit in bits(i):
                for d, c in enumerate(contexts):
                    node[c, m][bit] += 1
                    if d < depth:
                        below[c, m].add(contexts[d + 1])
    memo = {}

    def log_weighted(c, m):
        if (c, m) not in memo:
            a, b = node[c, m]
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            if len(c) == depth:
                memo[c, m] = own, 1.0
            else:
                rest = sum(log_weighted(x, m)[0] for x in below[c, m])
                both = math.log(0.5) + max(own, rest) + math.log1p(math.exp(-abs(own - rest)))
                memo[c, m] = both, math.exp(math.log(0.5) + own - both)
        return memo[c, m]

    out = {}
    for i, w in words.items():
        tokens, score = [*w, "\n"], 0.0
        for contexts, m, bit in bits(i):
            guess = None
            for c in reversed(contexts):
                if (c, m) in node or not c:
                    a = node[c, m]
                    own, weight = (a[bit] + 0.5) / (sum(a) + 1), log_weighted(c, m)[1]
                    guess = own if guess is None else weight * own + (1 - weight) * guess
            score += math.log10(guess)
        base = sum(math.log10((count[x] + 1) / (total + different + 1)) for x in tokens)
        out[i] = held[i], len(tokens), sum(count[x] > 0 for x in tokens), total, base, score
    return out
