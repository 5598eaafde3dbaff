"""Plain forms of the operators for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SMALL = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text: str | None) -> set:
    w = words((text or "").translate(SMALL))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard_components(rows: list[tuple]) -> list[tuple]:
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for e in s for j in holders[e])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[top(i)] = top(j)
        for e in s:
            holders[e].append(i)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[top(i)].append(doc_id)
    return [(d, len(sets[i]), min((x for x in groups[top(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


def repeated_bytes(rows: list[tuple], length: int) -> list[tuple]:
    data = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for (doc_id, _), b in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text: str | None) -> list[tuple]:
    """(place of the kind, start, end, kind)"""
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((0, m.start(), m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"\D", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append((3, m.start(), m.end(), "phone"))
    return sorted(out)


def secrets(text: str | None) -> list[tuple]:
    """(start, place of the kind, end, kind)"""
    t, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", t):
        if len(m[0]) >= 18:
            out.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(r"[0-9a-f]+", t):
        if len(m[0]) >= 16:
            out.append((m.start(), 2, m.end(), "hex"))
    return sorted(out)


def digest(spans: list[tuple], start: int) -> str:
    return hashlib.sha256(",".join(f"{s[3]}:{s[start]}:{s[2]}" for s in spans).encode()).hexdigest()


def repetition(text: str | None, window: int) -> dict:
    t, w = text or "", words(text)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)

    def covered(n):
        count = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        return len({p for k in range(len(w) - n + 1) if count[tuple(w[k : k + n])] > 1 for p in range(k, k + n)})

    order, longest = sorted(range(len(w)), key=lambda k: w[k:]), 0
    for a, b in zip(order, order[1:]):
        n = 0
        while max(a, b) + n < len(w) and w[a + n] == w[b + n]:
            n += 1
        longest = max(longest, n)
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
        "n_dup_lines": dup,
        "n_repeat_words": covered(3),
        "n_covered_words": covered(window),
        "longest_repeat": longest,
    }
