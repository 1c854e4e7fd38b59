"""Plain-Python forms of the contracts, for small tables: rows are (doc_id, text, ...)."""

import hashlib
import re
from collections import Counter

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def words(text):
    return SPACE_WORD.findall(text or "")


def plain_words(text):
    return ALNUM_WORD.findall((text or "").translate(FOLD))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii(text):
    text = text or ""
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                  "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def base_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def repeats(texts, n=35):
    """Per text: (words, removed, digest of the kept)."""
    docs = [words(t) for t in texts]
    count = Counter(tuple(w[i:i + n]) for w in docs for i in range(len(w) - n + 1))
    out = []
    for w in docs:
        gone = {i + j for i in range(len(w) - n + 1) if count[tuple(w[i:i + n])] > 1 for j in range(n)}
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def contamination(texts, items, n=13):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(len(w) - n + 1, 1) if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    sizes = {len(x) for x in windows}
    out = []
    for t in texts:
        w = plain_words(t)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (k := tuple(w[i:i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[k]
        names = sorted({str(x) for x in found if x is not None})
        out.append((len(w), len(hit), len(names), sha(",".join(names)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def longest_match(texts, items, n=13):
    """Per text: (words, item, first word) of the longest stretch from a window's place on that an item holds from a
    window's place on: the first one, of the least id; or three times None."""
    tails, windows = {}, set()
    for item, text in items:
        w = plain_words(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.add(tuple(w[i:i + size]))
            for k in range(1, size + 1):
                tails.setdefault(tuple(w[i:i + k]), set()).add((item is None, "" if item is None else str(item), tuple(w[i:])))
    sizes = {len(x) for x in windows}
    out = []
    for t in texts:
        w, found = plain_words(t), []
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (at := tuple(w[i:i + size])) in windows:
                    for none, item, rest in tails[at]:
                        k = size
                        while k < len(rest) and i + k < len(w) and rest[k] == w[i + k]:
                            k += 1
                        found.append((-k, i, none, item))
        k, i, none, item = min(found, default=(None, None, True, None))
        out.append((None if k is None else -k, None if none else item, i))
    return out


def shingles(text, n=3):
    w = words((text or "").translate(FOLD))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows, n=3, percent=90):
    """[(doc_id, set size, component_id)] of (doc_id, text) rows."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j, c in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def targets(sizes, share=1.5):
    """{source: target} of {source: size}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * rate > 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * rate for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def sainte_lague(votes, seats):
    got = dict.fromkeys(votes, 0)
    for _ in range(seats):
        got[max(votes, key=lambda k: (votes[k] / (2 * got[k] + 1), -k))] += 1
    return got


def license_base(text):
    w = plain_words(text)
    found = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    at = [x[0] for x in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x[1] for x in found}))
