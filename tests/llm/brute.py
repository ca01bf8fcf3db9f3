"""Plain Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re

import xxhash

SPACE = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(SPACE, text or "")


def simhash(text):
    ws = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[j:j + 3]).encode(), 42) for j in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def near_duplicates(docs, radius=3):
    fp = [simhash(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    ids = {}
    for a, (i, _) in enumerate(docs):
        ids.setdefault(find(a), []).append(i)
    name = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return [(docs[a][0], f"{fp[a]:016x}", name[find(a)]) for a in range(len(docs))]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_pii(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                  "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
                  "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def quality_figures(text):
    text = text or ""
    ws = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    often = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else None
    covered = {i + j for i, g in enumerate(grams) if g in often for j in range(3)}
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Water filling by rounds. ``sizes``: source -> size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left, budget = {}, set(order), share * sum(sizes.values())
    while left:
        level = budget / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > most * sizes[s]}
        if not over:
            return full | {s: level * weight[s] for s in left}
        for s in over:
            full[s] = most * sizes[s]
            budget -= full[s]
        left -= over
    return full


def repeated_bytes(docs, length=50):
    first = {}
    for i, t in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            first.setdefault(b[s:s + length], i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            f = first.get(b[s:s + length])
            if f is not None and (i is None or f < i):
                gone[s:s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def edit_distance_in(item, text):
    """Least edits with which ``item`` occurs in ``text``."""
    row = [0] * (len(text) + 1)
    for c in item:
        new = [row[0] + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def expected(rows):
    return sorted(map(str, rows))
