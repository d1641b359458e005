"""The contracts of the numbered queries in plain Python, for small tables."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def chat(rows, formatted):
    """rows of (conv_id, turn, role, text); formatted(role, text) gives one turn's characters."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(x[3] for x in turns if x[2] == "assistant")
        out[conv] = (conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(said), sha(said), sum(len("".join(formatted(r, t))) for _, _, r, t in turns))
    return out


def contamination(docs, items, width=13):
    windows = defaultdict(set)
    for item, text in items:
        words = ITEM_WORD.findall((text or "").translate(LOWER))
        for i in range(max(len(words) - width, 0) + 1 if words else 0):
            windows[tuple(words[i : i + width])].add(item)
    widths = sorted({len(w) for w in windows})
    out = []
    for doc, text in docs:
        words = ITEM_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in widths:
            for i in range(len(words) - n + 1):
                if got := windows.get(tuple(words[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= got
        out.append((doc, len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def substring(docs, width=50):
    first: dict[tuple, int] = {}
    split = [(d, SPACE.findall(t or "")) for d, t in docs]
    for d, words in split:
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            first[w] = min(first.get(w, d), d)
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] < d:
                gone.update(range(i, i + width))
        out.append((d, len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    return out


def suffix(docs, width=50):
    first: dict[bytes, int] = {}
    raw = [(d, (t or "").encode()) for d, t in docs]
    for d, b in raw:
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if first.get(w, d) >= d:
                first[w] = d
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < d:
                gone[i : i + width] = b"\x01" * width
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return out


def warc(pages, least=0):
    rows = [(p, (h or "").encode()) for p, h in pages]
    top: dict[bytes, int] = {}
    for p, b in rows:
        top[b] = max(top.get(b, p), p)
    out = []
    for p, b in rows:
        other = len(b) >= least and top[b] != p
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if other else "response", top[b] if other else None))
    return out


def simhash(docs, shingle=3, most=2):
    prints = {}
    for d, text in docs:
        words = SPACE.findall((text or "").translate(LOWER))
        grams = [" ".join(words[i : i + shingle]) for i in range(max(len(words) - shingle, 0) + 1)] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    values = sorted(set(prints.values()))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                root[find(a)] = find(b)
    least: dict[int, int] = {}
    for d, v in prints.items():
        least[find(v)] = min(least.get(find(v), d), d)
    return [(d, f"{v:016x}", least[find(v)]) for d, v in prints.items()]


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c in "0123456789"][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


PII = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in s.split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 16 <= sum(c in "0123456789" for c in s) <= 19 and luhn(s)),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 8 <= sum(c in "0123456789" for c in s) <= 15),
}


def pii(docs):
    out = []
    for d, text in docs:
        spans = {k: [m.span() for m in p.finditer(text or "") if ok(m[0])] for k, (p, ok) in PII.items()}
        out.append((d, *(len(spans[k]) for k in PII), sha(",".join(f"{k}:{a}:{b}" for k in PII for a, b in spans[k]))))
    return out


def quality(docs):
    out = []
    for d, text in docs:
        text = text or ""
        words = SPACE.findall(text)
        grams = Counter(zip(words, words[1:], words[2:]))
        inside = set()
        for i in range(len(words) - 2):
            if grams[tuple(words[i : i + 3])] > 1:
                inside.update((i, i + 1, i + 2))
        lines = [x for x in text.split("\n") if SPACE.search(x)]
        n, r = len(words), len(inside)
        out.append((d, n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n))
    return out


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def search(docs, items, k=10):
    split = lambda t: [w.translate(LOWER) for w in TERM.findall(t or "")]
    bags = [(d, Counter(split(t))) for d, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    held = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        scores = []
        for d, bag in bags:
            score = 0
            for w, times in Counter(split(text)).items():
                if tf := bag.get(w):
                    m = 100 - 75 + 75 * bag.total() * n_docs // total
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[w] + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scores)[:k])]
    return out


def _cheapest(rows):
    """rows of (role, text, fault): (cost, labels) by strings from the end back, and what is left."""
    step = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}
    want = lambda q: "assistant" if q == "2" else "user"
    far = (10**9, "")
    ahead = {q: far for q in "0123"} | {"0": (0, ""), "3": (0, "")}
    steps: list[dict] = []

    def inserts(here):
        how = {}
        for _ in range(4):
            for q in "0123":
                to = step[q, want(q)[0]]
                new = (here[to][0] + 5, "I" + here[to][1])
                if new < here[q]:
                    here[q], how[q] = new, ("I", to)
        return how

    steps.append(inserts(ahead))
    for role, _, fault in reversed(rows):
        here, how = {}, {}
        for q in "0123":
            found = [((2 + ahead[q][0], "D" + ahead[q][1]), ("D", q))]
            if fault not in ("blank", "duplicate"):
                stays = 5 * (fault == "truncated")
                if (q, role[:1]) in step:
                    to = step[q, role[:1]]
                    found.append(((stays + ahead[to][0], "K" + ahead[to][1]), ("K", to)))
                to = step[q, want(q)[0]]
                found.append(((1 + stays + ahead[to][0], "R" + ahead[to][1]), ("R", to)))
            here[q], how[q] = min(found)
        how |= inserts(here)
        steps.append(how)
        ahead = here
    left, q, at = [], "0", 0
    for label in ahead["0"][1]:
        edit, to = steps[len(rows) - at][q]
        assert edit == label
        if label in "IR":
            left.append((want(q), rows[at][1] if label == "R" else ""))
        elif label == "K":
            left.append(rows[at][:2])
        at += label != "I"
        q = to
    return ahead["0"], left


def repair(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        here = by[conv]
        blank = lambda x: " " if x is None else x
        harm = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = "user" if harm == 4 else blank(role), "" if harm == 1 else re.sub("[.!?]", "", blank(text)) if harm == 2 else blank(text)
        here += [(turn, role, text)] * {0: 0, 3: 2}.get(harm, 1)
    out = []
    for conv, turns in by.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], sha(x[2])))
        seen, marked = set(), []
        for _, role, text in turns:
            words = SPACE.findall(text)
            marked.append((role, text, "blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1][-1] in ".!?" else "truncated"))
            seen.add((role, text))
        (cost, audit), left = _cheapest(marked)
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") or not a[1] or not b[1] for a, b in zip(turns, turns[1:]))
        faults = [sum(f == x for _, _, f in marked) for x in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *faults, illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in left))))
    return out
