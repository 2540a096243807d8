"""Plain versions of the operators, over lists of (doc_id, text)."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def suffix_dedup(docs, window):
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for (doc, _), t in zip(docs, texts):
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone) if not g))))
    return out


def kmer_dedup(docs, window):
    words = [WORD.findall(t or "") for _, t in docs]
    first = {}
    rank = lambda d: -(2**63) if d is None else d
    for (doc, _), w in zip(docs, words):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, 2**63), rank(doc))
    out = []
    for (doc, _), w in zip(docs, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < rank(doc):
                gone[i : i + window] = [True] * window
        out.append((doc, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def item_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return ITEM_WORD.findall(low)


def decontaminate(docs, items, size=10):
    windows = defaultdict(set)
    for n, (_, text) in enumerate(items):
        w = item_words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(n)
    sizes = sorted({len(w) for w in windows})
    out = []
    for doc, text in docs:
        w, hit, own = item_words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (x := tuple(w[i : i + k])) in windows:
                    hit.update(range(i, i + k))
                    own |= windows[x]
        ids = sorted({str(items[n][0]) for n in own if items[n][0] is not None})
        out.append((doc, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out


def jaccard(docs, size=3, percent=90):
    sets = []
    for _, text in docs:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        k = min(size, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for t in s:
            lists[t].append(i)
    for i, s in enumerate(sets):
        for j, c in Counter(j for t in s for j in lists[t] if j < i).items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            low[root(i)] = min(low.get(root(i), doc), doc)
    return [(doc, len(s), low.get(root(i))) for i, ((doc, _), s) in enumerate(zip(docs, sets))]


def quality(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        many = Counter(grams)
        covered = {j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + 5)}
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        symbols = sum(c in "#*$%&|<>" for c in text)
        out.append((doc, len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed))
    return out
