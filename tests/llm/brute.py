"""Plain versions of the corpus operators over lists of rows, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
sha = lambda s: hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def contamination(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(len(w) - min(n, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (k := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[k] - {None}
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def fingerprint(text):
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", (text or "").translate(LOWER).encode()) if x]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(prints, radius=2):
    """prints: list of (id, fingerprint); -> the smallest id of each one's component (None if no member has an id)."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(prints))]


def top(vectors, every, k=10):
    good = [(i, np.floor(np.array(v, dtype=np.float64) * 1024)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and len(v)]
    sizes = [len(v) for _, v in good]
    dims = max(set(sizes), key=lambda s: (sizes.count(s), -s)) if sizes else 0
    good = [(i, v) for i, v in good if len(v) == dims]
    out = set()
    for q, v in good:
        if q % every == 0:
            scored = sorted(((-int(v @ x), i) for i, x in good if i != q))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return sorted(out)


SECRETS = (
    ("assign", re.compile(r"""((?:[Pp][Aa][Ss][Ss](?:[Ww][Oo][Rr][Dd]|[Ww][Dd]))|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def secrets(text):
    spans = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, ok) in enumerate(SECRETS) for m in p.finditer(text or "") if ok(m)]
    n = [sum(s[1] == i for s in spans) for i in range(3)]
    return (*n, sha(",".join(s[2] for s in sorted(spans))))


def repeats(docs, length=50):
    """(doc, text) rows -> n_bytes, n_removed, n_spans, kept digest."""
    first = {}
    data = [(d, (t or "").encode()) for d, t in docs]
    for d, b in data:
        if d is not None:
            for i in range(len(b) - length + 1):
                s = b[i : i + length]
                first[s] = min(d, first.get(s, d))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if d is not None and first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def greedy_tokens(text, pieces):
    """Longest match word by word, each word with a leading space."""
    pieces, longest, n = set(pieces), max(map(len, pieces)), 0
    for w in (text or "").encode().split():
        w = b" " + w
        while w:
            size = next(k for k in range(min(longest, len(w)), 0, -1) if w[:k] in pieces)
            w, n = w[size:], n + 1
    return n


def _luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def _digits(s):
    return sum(c in "0123456789" for c in s)


PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= _digits(s) <= 19 and _luhn(s)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= _digits(s) <= 15),
)


def personal(text):
    found = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if ok(m[0])] for k, p, ok in PERSONAL]
    return (*map(len, found), sha(",".join(x for f in found for x in f)))


def size(text):
    return len((text or "").encode()) + 16


def crc(text):
    return zlib.crc32((text or "").encode())


def smallest_capacity(sizes, shards):
    """By trying every capacity that a run can have."""
    runs = sorted({sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)})
    for c in runs:
        n, room = 1, c
        for s in sizes:
            if s > c:
                n = shards + 1
                break
            if s > room:
                n, room = n + 1, c
            room -= s
        if n <= shards:
            return c
    return 0


def shingles(text, n=5):
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", (text or "").translate(LOWER).encode()) if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def spans_by_labels(texts, pii):
    """op7's spans text by text, as one string each: candidates, votes and features in plain Python; pii gives patterns and training."""
    import regex

    flags = regex.ASCII | regex.V0
    patterns = {k: regex.compile(p, flags) for k, p in pii.PATTERNS.items()}
    has = lambda rule, s: regex.search(rule, s, flags) is not None
    checks = {k: ok for (k, _, ok) in PERSONAL} | {"card": lambda s: 13 <= _digits(s) <= 19 and _luhn(s), "number": lambda s: 7 <= _digits(s) <= 19}
    found = []
    for t in texts:
        t, own = t or "", []
        for k in pii.KINDS:
            matches = list(patterns[k].finditer(t))
            for i, m in enumerate(matches):
                if not checks.get(k, lambda s: True)(m[0]):
                    continue
                low = matches[i - 1].end() if i else 0
                high = matches[i + 1].start() if i + 1 < len(matches) else len(t)
                own.append((k, m.start(), m.end(), m[0], t[max(low, m.start() - 32) : m.start()], t[m.end() : min(high, m.end() + 12)]))
        found.append(own)

    def votes(k, m, before, after):
        word = lambda words: has(rf"(?i)\b(?:{words})\b", m)
        return (
            1 if k in pii.BASE or has(pii.FORMATS, m) else -1 if has(r"^[0-9]+\.[0-9]{1,2}$", m) else 0,
            1 if k == "name" and word(pii.GIVEN) else -1 if k == "name" and word(pii.NO_NAMES) else 0,
            1 if has(pii.CUES, before) else -1 if has(pii.AGAINST, before) else 0,
            -1 if has(pii.UNITS, after) else 0,
            1 if k != "name" and has(r"[0-9][\x20()./-]+[0-9]", m) else -1 if k == "number" and not has("[^0-9]", m) else 0,
            1 if has(r"^(?:Mr|Mrs|Ms|Dr|Prof)\b", m) else 0,
        )

    def features(k, m, before):
        form = 2 if has(pii.FORMATS, m) else 1 if has(r"[A-Za-z@+()]|[0-9][\x20./-]+[0-9]", m) else 0
        return pii.KINDS.index(k), min(3, len(m) // 8), 2 if has(pii.CUES, before) else 1 if has(pii.AGAINST, before) else 0, form

    counts = {}
    for own in found:
        for k, _, _, m, before, after in own:
            key = votes(k, m, before, after), features(k, m, before)
            counts[key] = counts.get(key, 0) + 1
    model = pii.train(sorted((*k, n) for k, n in counts.items()))
    out = []
    for own in found:
        taken = [(s, e) for k, s, e, *_ in own if k in pii.BASE]
        likely = lambda k, m, before: model[0][0] + sum(table[x] for table, x in zip(model[1:], features(k, m, before), strict=True)) > 0
        kept = [f"{k}:{s}:{e}" for k, s, e, m, before, _ in own if k in pii.BASE or (likely(k, m, before) and not any(a < e and s < b for a, b in taken))]
        out.append(",".join(kept))
    return out


def mixture(rows, mixing, budget):
    """(doc_id, text, lang, source) rows -> op8's (doc_id, source, lang, topic, n_tokens, share, prob, uniform number)."""
    import struct

    def topic(t):
        return "empty" if t is None else next((name for name, rule in mixing.TOPICS if re.search(rule, t, re.ASCII)), mixing.OTHER)

    cells, own = {}, []
    for doc, text, lang, source in rows:
        n = len(re.findall(r"\S+", text or "", re.ASCII))
        own.append((doc, (source, lang, topic(text)), n))
        cells[own[-1][1]] = cells.get(own[-1][1], 0) + n
    mass = {c: m for c, m in cells.items() if m > 0}
    total = sum(mass.values())
    goals = []
    for i, margin in enumerate(mixing.MARGINS):
        sums = {}
        for c, m in mass.items():
            sums[c[i]] = sums.get(c[i], 0) + m
        powered = {v: m ** mixing.POWERS[margin] for v, m in sums.items()}
        goals.append({v: x / sum(powered.values()) for v, x in powered.items()})
    w = {c: m / total for c, m in mass.items()}
    for _ in range(500):
        for i, goal in enumerate(goals):
            sums = {}
            for c, x in w.items():
                sums[c[i]] = sums.get(c[i], 0) + x
            w = {c: x * goal[c[i]] / sums[c[i]] for c, x in w.items()}
    kept = lambda scale: sum(min(mass[c] / total, scale * w[c]) for c in w)
    low, high = 0.0, 1e9
    for _ in range(200):
        low, high = ((low + high) / 2, high) if kept((low + high) / 2) < budget else (low, (low + high) / 2)

    def uniform(doc):
        seed = 42 if doc is None else xxhash.xxh64_intdigest(struct.pack("<q", doc), 42)
        return (xxhash.xxh64_intdigest(struct.pack("<i", mixing.SEED), seed) >> 11) / (1 << 53)

    return [(doc, *c, n, w.get(c, 0.0), min(1.0, high * w[c] * total / mass[c]) if c in w else 1.0, uniform(doc)) for doc, c, n in own]


def languages(training, texts, longest=5, smooth=0.5, temper=12.0):
    """(lang, text) rows and texts -> (lang, score) each: word-first back-off with plain counters."""
    import math

    import regex

    names = sorted({lang for lang, _ in training})
    counts = [{} for _ in range(longest + 1)]  # size -> gram -> lang -> n

    def add(size, gram, lang, n):
        table = counts[size].setdefault(gram, {})
        table[lang] = table.get(lang, 0) + n

    words = {}
    for lang, text in training:
        for w in regex.findall(r"\p{L}+", text.lower()):
            words[lang, w] = words.get((lang, w), 0) + 1
    for (lang, w), n in words.items():
        add(0, w, lang, n)
        marked = f"^{w}$"
        for k in range(1, longest + 1):
            for i in range(len(marked) - k + 1):
                add(k, marked[i : i + k], lang, n)
    totals = [{lang: sum(t.get(lang, 0) for t in table.values()) + smooth * (len(table) + 1) for lang in names} for table in counts]

    def logs(size, gram):
        found = [math.log((counts[size][gram].get(lang, 0) + smooth) / totals[size][lang]) for lang in names]
        return [x - max(found) for x in found]

    def score(w):
        if w in counts[0]:
            return logs(0, w)
        marked, at, got = f"^{w}$", 0, []
        while at < len(marked):
            k = next((k for k in range(min(longest, len(marked) - at), 0, -1) if marked[at : at + k] in counts[k]), 0)
            if k:
                got.append(logs(k, marked[at : at + k]))
            at += max(k, 1)
        return [sum(x) / len(got) for x in zip(*got, strict=True)] if got else None

    out = []
    for t in texts:
        own = [w for w in regex.findall(r"[^\W\d_]+", (t or "").lower()) if any(map(str.isalpha, w))]
        if not own or not names:
            out.append(("und", 0.0))
            continue
        got = [s for s in map(score, own) if s is not None]
        total = [sum(x) * min(1.0, temper / max(len(got), 1)) for x in zip(*got, strict=True)] or [0.0] * len(names)
        odds = [math.exp(x - max(total)) for x in total]
        best = max(range(len(names)), key=lambda i: (odds[i], -i))
        out.append((names[best], odds[best] / sum(odds)))
    return out


def group_sizes(texts):
    """Sizes of the groups of equal texts, in the order of their hashes."""
    groups = {}
    for t in texts:
        at = xxhash.xxh64_intdigest((t or "").encode(), 42) >> 1
        groups[at] = groups.get(at, 0) + size(t)
    return [groups[k] for k in sorted(groups)]


def least_capacity(sizes, shards):
    """By binary search over the groups themselves, filling one shard after the other."""

    def fits(room):
        n, left = 1, room
        for x in sizes:
            if x > room:
                return False
            if x > left:
                n, left = n + 1, room
            left -= x
        return n <= shards

    low, high = 0, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low
