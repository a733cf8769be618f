"""Plain, slow versions of the text operators, written from their contracts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def held(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def op1(docs: list[tuple[int, str | None]], size: int) -> list[tuple]:
    texts = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(t[i : i + size] for _, t in texts for i in range(len(t) - size + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(t), sum(gone), runs, sha(bytes(b for b, g in zip(t, gone, strict=True) if not g))))
    return out


def op5(docs: list[tuple[int, str | None]], shingle: int = 4, distance: int = 4) -> list[tuple]:
    prints = []
    for d, t in docs:
        words = WORD.findall((t or "").translate(LOWER))
        grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append((d, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    ids = {}
    for d, f in prints:
        ids.setdefault(f, []).append(d)
    keys, parent = list(ids), {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    least: dict[int, int] = {}
    for f, ds in ids.items():
        known = [x for x in ds if x is not None]
        if known:
            least[find(f)] = min(min(known), least.get(find(f), 1 << 62))
    return [(d, f"{f:016x}", least.get(find(f))) for d, f in prints]


def op6_base(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    grams = [tuple(words[i : i + 8]) for i in range(n - 7)]
    count = Counter(grams)
    hit = set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def op4_base(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    order = ["email", "ip", "card", "phone"]
    return sorted(out, key=lambda x: (x[1], order.index(x[0])))


def op8(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = 10) -> list[tuple]:
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wanted: dict[tuple, set] = {}
    for i, t in items:
        words = word.findall((t or "").translate(LOWER))
        size = min(window, len(words))
        if i is not None and words:
            for k in range(len(words) - size + 1):
                wanted.setdefault(tuple(words[k : k + size]), set()).add(i)
    out = []
    for d, t in docs:
        words, hit, found = word.findall((t or "").translate(LOWER)), set(), set()
        for size in {len(k) for k in wanted}:
            for k in range(len(words) - size + 1):
                if ids := wanted.get(tuple(words[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= ids
        out.append((d, len(words), len(hit), len(found), sha(",".join(sorted(map(str, found))).encode()), bool(hit)))
    return out
