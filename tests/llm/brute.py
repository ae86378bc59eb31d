"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re

TEXT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def similar(a, b):
    both = len(a & b)
    return 5 * both >= 4 * (len(a) + len(b) - both)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def repeats(texts, length):
    """(n_removed, n_spans, kept) per text."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for k, t in enumerate(raw):
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s: s + length], []).append((k, s))
    gone = [bytearray(len(t)) for t in raw]
    for places in seen.values():
        if len(places) > 1:
            for k, s in places:
                gone[k][s: s + length] = b"\1" * length
    out = []
    for t, g in zip(raw, gone, strict=True):
        spans = sum(1 for i, x in enumerate(g) if x and (i == 0 or not g[i - 1]))
        out.append((sum(g), spans, bytes(c for c, x in zip(t, g, strict=True) if not x)))
    return out


def components(rows):
    """rows (id, text) -> {position: smallest id of the component}."""
    sets = []
    for _, text in rows:
        w = space_words(text)
        sets.append({tuple(w)} if len(w) == 1 else {*zip(w, w[1:], strict=False)})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and similar(sets[i], sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (k, _) in enumerate(rows):
        best.setdefault(find(i), []).append(k)
    return [min((k for k in best[find(i)] if k is not None), default=None) if sets[i] else rows[i][0] for i in range(len(rows))]


def line_dedup(rows):
    """rows (id, text), ids unique -> kept text per row; earlier is by (id, line)."""
    lines = []
    for r, (k, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0])):
        for i, line in enumerate((text or "").split("\n")):
            lines.append((r, i, line, frozenset(space_words(line))))
    keep = {}
    for p, (r, _, line, words) in enumerate(lines):
        if not words or not any(q[3] and similar(words, q[3]) for q in lines[:p]):
            keep.setdefault(r, []).append(line)
    return [None if text is None else "\n".join(keep.get(r, [])) for r, (_, text) in enumerate(rows)]


def windows(items, width=10):
    """Window -> ids as strings."""
    found = {}
    for k, text in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        for s in range(max(1, len(w) - width + 1)) if w else ():
            found.setdefault(tuple(w[s: s + width]), set()).add("" if k is None else str(k))
    return found


def hits(text, found):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places, items = set(), set()
    for window, ids in found.items():
        for s in range(len(w) - len(window) + 1):
            if tuple(w[s: s + len(window)]) == window:
                places |= set(range(s, s + len(window)))
                items |= ids
    return len(w), len(places), sorted(items)
