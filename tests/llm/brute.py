"""Plain-Python versions of the operators for small tables."""

import collections
import hashlib
import math
import re

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def windows(w, n):
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def contamination(docs, items, size=13):
    known = collections.defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        for g in windows(w, min(size, len(w))) if w else []:
            known[g].add(item)
    out = []
    for doc, text in docs:
        w, hit, of = ALNUM.findall(lower(text)), set(), set()
        for n in {len(k) for k in known}:
            for i, g in enumerate(windows(w, n)):
                if g in known:
                    hit |= set(range(i, i + n))
                    of |= {str(x) for x in known[g] if x is not None}
        out.append((doc, len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def rules(text):
    text = text or ""
    w = SPACED.findall(text)
    c = collections.Counter(windows(w, 5))
    repeated = {j for i, g in enumerate(windows(w, 5)) if c[g] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), dup, len(repeated)


def removed_bytes(docs, length=100):
    """Rows (id, text) in the order of the operator; per row the mask of removed bytes."""
    seen, out = {}, []
    for key, text in docs:
        b = (text or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            place = (key, i)
            if seen.setdefault(b[i : i + length], place) != place:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def kept_lines(docs, min_words=25):
    """(text without repeated passages, spans) of rows (id, text) in the order of the operator."""
    seen, out = {}, []
    for key, text in docs:
        units, at = [], 0
        for line in (text or "").split("\n"):
            run = []
            for m in SPACED.finditer(line):
                run.append((lower(m[0]), at + m.start(), at + m.end()))
                if sum(lower(m[0]).encode()) % 8 == 0:
                    units.append(run)
                    run = []
            units += [run] if run else []
            at += len(line) + 1
        spans, size, open_ = [], 0, False
        for k, unit in enumerate(units):
            if seen.setdefault(tuple(w for w, _, _ in unit), (key, k)) == (key, k):
                open_ = False
                continue
            if not open_:
                if spans and size < min_words:
                    spans.pop()
                spans.append([unit[0][1], unit[-1][2]])
                size = 0
            spans[-1][1], size, open_ = unit[-1][2], size + len(unit), True
        if spans and size < min_words:
            spans.pop()
        kept, at = "", 0
        for a, b in spans:
            kept, at = kept + (text or "")[at:a], b
        out.append((None if text is None else kept + text[at:], [tuple(s) for s in spans]))
    return out


def shingles(text):
    w = ALNUM.findall(lower(text))
    return tuple(w), set(windows(w, min(5, len(w)))) if w else set()


def near_classes(docs, least=0.8):
    items = [(d, *shingles(t)) for d, t in docs]
    at = collections.defaultdict(list)
    for i, (_, _, s) in enumerate(items):
        for x in s:
            at[x].append(i)
    common = collections.Counter()
    for own in at.values():
        for k, i in enumerate(own):
            for j in own[:k]:
                common[j, i] += 1
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, j), n in common.items():
        if n / (len(items[i][2]) + len(items[j][2]) - n) >= least:
            a, b = sorted((find(i), find(j)), key=lambda k: items[k][0])
            parent[b] = a
    return {items[i][0]: items[find(i)][0] for i in range(len(items))}


def personal_data(text):
    """(start, kind number, end) of the base rules, in order."""
    text, out = text or "", []

    def luhn(d):
        return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0

    forms = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    )
    for kind, form in enumerate(forms):
        for m in re.finditer(form, text):
            d = re.sub("[^0-9]", "", m[0])
            good = (True, kind == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15)[kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def kneser_ney(texts, order):
    """log p of every n-gram by the textbook recursion, for one language."""
    lines = [" " * (order - 1) + "".join(w + " " for w in SPACED.findall(lower(t))) for t in texts if SPACED.search(t or "")]
    lines = [x.encode() for x in lines]
    counts = {order: collections.Counter(b[i : i + order] for b in lines for i in range(len(b) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    cuts = {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        cuts[k] = []
        for i in (1, 2, 3):
            raw = i - (i + 1) * y * n[i + 1] / n[i] if y is not None and n[i] else 0.5 * i
            cuts[k].append(max(0.1, min(i, raw)))
    total = {k: collections.Counter() for k in counts}
    back = {k: collections.Counter() for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            total[k][g[:-1]] += v
            back[k][g[:-1]] += cuts[k][min(v, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        ctx = g[:-1]
        if not total[k][ctx]:
            return p(g[1:])
        v = counts[k][g]
        own = (v - cuts[k][min(v, 3) - 1]) / total[k][ctx] if v else 0.0
        return own + back[k][ctx] / total[k][ctx] * p(g[1:])

    return lambda g: math.log(p(g)), lines
