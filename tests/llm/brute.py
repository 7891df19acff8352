"""Plain Python versions of the corpus operators, for small tables."""

import hashlib
import itertools
import re
from collections import defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def quality_counts(text):
    t = text or ""
    words = SPACED.findall(t)
    windows = defaultdict(list)
    for k in range(len(words) - 7):
        windows[tuple(words[k : k + 8])].append(k)
    covered = {i for at in windows.values() if len(at) > 1 for k in at for i in range(k, k + 8)}
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def contamination(docs, items):
    """{doc_id: (n_words, n_hit, items)}"""
    windows = defaultdict(set)
    for item, text in items:
        w = LETTERED.findall(lower(text))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].update([] if item is None else [str(item)])
    out = {}
    for i, text in docs:
        w, hit, found = LETTERED.findall(lower(text)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out[i] = (len(w), len(hit), sorted(found))
    return out


def shingles(text):
    w = SPACED.findall(lower(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(docs):
    """{doc_id: smallest linked doc_id}"""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


BASE = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    """Sorted (kind, start, end) of the base patterns."""
    out = []
    for kind, pattern in enumerate(BASE):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = (True, all(int(x) <= 255 for x in m.group().split(".")) if kind == 1 else True, 16 <= len(digits) <= 19 and luhn(digits), 8 <= len(digits) <= 15)[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return sorted(out)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
