"""Plain versions of the text operators, for small fixtures."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def substrings(docs, length=50):
    """id: (bytes, removed, spans, digest)."""
    seen, out = {}, {}
    for i, text in sorted(docs.items()):
        x = (text or "").encode()
        cover = [False] * len(x)
        for k in range(len(x) - length + 1):
            if seen.setdefault(x[k : k + length], i) < i:
                cover[k : k + length] = [True] * length
        spans = sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover))
        out[i] = (len(x), sum(cover), spans, sha(bytes(b for b, c in zip(x, cover, strict=True) if not c)))
    return out


def shingles(text, k):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(docs, k, percent=80):
    s, parent = {i: shingles(t, k) for i, t in docs.items()}, {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(docs)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(s[a] & s[b])
            if both and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(s[i]), root(i)) for i in ids}


def lines(docs, least=10):
    """id: (lines, dropped, kept text)."""
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(strip).translate(UPPER)
    holders = {}
    for i, text in docs.items():
        for x in (text or "").split("\n"):
            if len(key(x)) >= least:
                holders.setdefault(key(x), set()).add(i)
    out = {}
    for i, text in docs.items():
        every = (text or "").split("\n")
        kept = [x for x in every if not (len(key(x)) >= least and min(holders[key(x)]) < i)]
        out[i] = (len(every), len(every) - len(kept), "\n".join(kept))
    return out


def quality(text, least=12, covered=30, longest=100):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_covered)."""
    text = text or ""
    w = WORD.findall(text)

    def windows(k):
        places = {}
        for i in range(len(w) - k + 1):
            places.setdefault(tuple(w[i : i + k]), []).append(i)
        return {i + j for p in places.values() if len(p) > 1 for i in p for j in range(k)}

    some = [x for x in text.split("\n") if WORD.search(x)]
    rep, cov = len(windows(3)), len(windows(least))
    failed = len(w) < 50 or 100 * rep > 50 * len(w)
    kept = not failed and 100 * cov <= covered * len(w) and not windows(longest + 1)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(some) - len(set(some)), rep, failed, kept, cov
