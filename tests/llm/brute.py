"""Plain Python versions of the operators, row by row, for the tests."""

import hashlib
import re
from itertools import combinations

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def simhash(text, n=3):
    w = words(ascii_lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def simhash_components(rows, radius=2, n=3):
    """rows: (doc_id, text) -> [(doc_id, fp, component)]"""
    fps = [simhash(t, n) for _, t in rows]
    distinct = sorted(set(fps))
    at = {f: i for i, f in enumerate(distinct)}
    pairs = [(at[a], at[b]) for a, b in combinations(distinct, 2) if (a ^ b).bit_count() <= radius]
    root = roots(len(distinct), pairs)
    least = {}
    for (i, _), f in zip(rows, fps):
        r = root[at[f]]
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [(i, f, least.get(root[at[f]])) for (i, _), f in zip(rows, fps)]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def pii_spans(text):
    text, out = text or "", []
    for m in EMAIL.finditer(text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in IP.finditer(text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in PHONE.finditer(text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


def pii_row(text):
    s = pii_spans(text)
    n = [sum(1 for x in s if x[1] == k) for k in range(4)]
    return (*n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in s).encode()).hexdigest())


TOKEN = re.compile(r"[^\W]+")


def telling(texts, reach=100, open_bits=1.0, share=0.5, prior=1.0):
    """{term: P(entity | term)} of the disclosing terms, all counts over distinct texts."""
    distinct = {t or "" for t in texts}
    near, holders, has = {}, {}, {}
    for t in distinct:
        for w in {m[0].lower() for m in TOKEN.finditer(t)}:
            holders.setdefault(w, set()).add(t)
        spans = pii_spans(t)
        for s, k, e, _ in spans:
            entity = (k, t[s:e].lower())
            has.setdefault(entity, set()).add(t)
            low, high = max(0, s - reach), min(len(t), e + reach)
            for a, b in ((low, s), (e, high)):
                for m in TOKEN.finditer(t[a:b]):
                    x, y = m.start() + a, m.end() + a
                    broken = (b == s and x == low > 0) or (a == e and y == e + reach < len(t))
                    if not broken and not any(p < y and x < q for p, _, q, _ in spans):
                        near.setdefault((entity, m[0].lower()), set()).add(t)
    out = {}
    for (entity, term), both in near.items():
        own = len(has[entity]) / len(distinct)
        p = (len(both) + prior * own) / (len(holders[term]) + prior)
        if p >= 2**-open_bits and p >= own ** (1 - share):
            out[term] = max(p, out.get(term, 0))
    return out


def term_spans(text, terms, removed=0.9):
    """(start, end, mark) of the terms' tokens that no pattern's match touches."""
    spans = pii_spans(text)
    found = ((m.start(), m.end(), terms.get(m[0].lower())) for m in TOKEN.finditer(text or ""))
    return [(a, b, "" if p >= removed else "[TERM]") for a, b, p in found if p is not None and not any(x < b and a < y for x, _, y, _ in spans)]


def sanitise(text, terms):
    out, at = [], 0
    for a, b, mark in sorted([(a, b, f"[{k.upper()}]") for a, _, b, k in pii_spans(text)] + term_spans(text, terms)):
        if a >= at:
            out.append(text[at:a] + mark)
        at = max(at, b)
    return "".join(out) + text[at:]


def quality_counts(text):
    text = text or ""
    w = words(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = {}
    for t in tri:
        count[t] = count.get(t, 0) + 1
    covered = {i + d for i, t in enumerate(tri) if count[t] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def mix(rows, weights=(3, 1, 2), share=1.5, most=2.0):
    """rows (source, size) -> {source: (source_size, target)} by pouring in rounds."""
    size = {}
    for s, n in rows:
        size[s] = size.get(s, 0) + n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    target, left, open_ = {}, share * sum(size.values()), list(order)
    while open_:
        total = sum(w[s] for s in open_)
        full = [s for s in open_ if left * w[s] / total > most * size[s]]
        if not full:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in full:
            target[s] = most * size[s]
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return {s: (size[s], target[s]) for s in order}


def mix_queue(rows, share=1.5, most=2):
    """rows (doc_id, source, text) -> (row number, words taken) of the copies in the mix, in order: one at a time
    in order of virtual finish times until the budget is spent."""
    size = [len(words(t)) for _, _, t in rows]
    goal = mix([(s, n) for (_, s, _), n in zip(rows, size)], share=share, most=most)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    name = lambda i: "" if i is None else f":{i}"
    served, copies = {}, []
    for k in range(most):
        for at in sorted(range(len(rows)), key=lambda at: (md5(f"0{name(rows[at][0])}:{md5(rows[at][2] or '')}"), size[at])):
            s = rows[at][1]
            if size[at]:
                start = served.get(s, 0)
                served[s] = start + size[at]
                copies.append(((start + size[at]) / goal[s][1], s is None, s or "", start, at))
    left, out = int(share * sum(size)), []
    for *_, at in sorted(copies):
        n = min(size[at], left)
        left -= n
        if n:
            out.append((at, n))
    return out


def mix_taken(rows):
    """(doc_id, source, size, taken) of each of rows (doc_id, source, text)."""
    taken = {}
    for at, n in mix_queue(rows):
        taken[at] = taken.get(at, 0) + n
    return [(i, s, len(words(t)), taken.get(at, 0)) for at, (i, s, t) in enumerate(rows)]
