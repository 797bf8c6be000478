"""Plain re-statements of what the corpus queries return, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

from xxhash import xxh64_intdigest

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def license_base(text):
    found = ALNUM.findall((text or "").translate(LOWER))
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    places = []
    for phrase, label in phrases.items():
        w = phrase.split()
        places += [(i, label) for i in range(len(found)) if found[i : i + len(w)] == w]
    starts = [p for p, _ in places]
    labels = ",".join(sorted({x for _, x in places}))
    return (len(found), len(places), min(starts, default=None), max(starts, default=None), labels)


def simhash(text):
    w = SPACED.findall((text or "").translate(LOWER))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_components(rows):
    """rows: (doc_id, text). Returns sorted (doc_id, hex, component_id)."""
    prints = [(d, simhash(t)) for d, t in rows]
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                parent[top(i)] = top(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(prints):
        ids[top(i)].append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(d, f"{f:016x}", least[top(i)]) for i, (d, f) in enumerate(prints)]


def quality_base(text):
    text = text or ""
    w = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (
        len(w),
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
        failed,
    )


def decontamination(docs, items):
    """docs: (doc_id, text), items: (item_id, text). Returns rows of the query."""
    index = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        if w:
            for i in range(max(len(w) - 12, 1)):
                index[tuple(w[i : i + 13])].add(str(item))
    sizes = sorted({len(k) for k in index})
    out = []
    for doc, text in docs:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                at = index.get(tuple(w[i : i + n]))
                if at:
                    hit |= set(range(i, i + n))
                    found |= at
        bad = bool(hit) and 20 * len(hit) >= len(w)
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bad))
    return out


def repeats(rows, size=400):
    """rows: (doc_id, text). Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    seen = Counter()
    for _, text in rows:
        b = (text or "").encode()
        seen.update(b[i : i + size] for i in range(len(b) - size + 1))
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        spans = []
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + size
                else:
                    spans.append([i, i + size])
        kept, at = b"", 0
        for s, e in spans:
            kept += b[at:s]
            at = e
        kept += b[at:]
        digest = hashlib.sha256(kept).hexdigest()
        out.append((doc, len(b), sum(e - s for s, e in spans), len(spans), digest))
    return out


def _luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text):
    """Base spans: (start, kind order, kind, end)."""
    text = text or ""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    return sorted(found)


def personal_row(text):
    spans = personal(text)
    count = Counter(k for _, _, k, _ in spans)
    line = ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
    return (count["email"], count["ip"], count["card"], count["phone"], sha(line), line)
