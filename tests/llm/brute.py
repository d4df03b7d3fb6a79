"""Plain Python versions of the operators, for comparison on small tables."""

import collections
import hashlib
import re

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK_WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contamination(docs, items, width=10):
    """{doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}"""
    windows = collections.defaultdict(set)
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        for a in range(max(1, len(w) - width + 1)) if w else ():
            windows[tuple(w[a:a + width])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, of = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if found := windows.get(tuple(w[a:a + n])):
                    hit |= set(range(a, a + n))
                    of |= found
        names = ",".join(sorted(map(str, of)))
        out.append((doc, len(w), len(hit), len(of), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def quality(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        w = BLANK_WORD.findall(text)
        windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        count = collections.Counter(windows)
        repeated = {i + j for i, x in enumerate(windows) if count[x] > 1 for j in range(5)}
        lines = [s for s in text.split("\n") if BLANK_WORD.search(s)]
        n, r = len(w), len(repeated)
        out.append((doc, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r,
                    n < 10 or 100 * r > 20 * n))
    return out


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def shingles(text, width=3):
    w = BLANK_WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components(docs, width=3, percent=90):
    """[(doc_id, n_shingles, component_id)] with unique ids."""
    sets = [(d, shingles(t, width)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    by = collections.defaultdict(list)
    for d, s in sets:
        for x in s:
            by[x].append(d)
    of = dict(sets)
    shared = collections.Counter()
    for ids in by.values():
        if len(ids) <= 400:
            for i, a in enumerate(ids):
                for b in ids[:i]:
                    shared[(b, a)] += 1
        else:  # too many for the counter: all their pairs are counted in full
            for i, a in enumerate(ids):
                for b in ids[:i]:
                    shared[(b, a)] = 1
    for a, b in shared:
        i = len(of[a] & of[b])
        if 100 * i >= percent * (len(of[a]) + len(of[b]) - i):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    low = {}
    for d, _ in sets:
        low[find(d)] = min(low.get(find(d), d), d)
    return [(d, len(s), low[find(d)]) for d, s in sets]
