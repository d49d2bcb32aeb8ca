"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations


def repeats(docs: list[tuple[int, str | None]], window: int) -> dict[int, tuple[bytes, int, int]]:
    """By id: kept bytes, removed bytes and removed runs, for texts with one row per id."""
    first: dict[bytes, int] = {}
    for doc, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - window + 1):
            w = data[i:i + window]
            first[w] = min(first.get(w, doc), doc)
    out = {}
    for doc, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            if first[data[i:i + window]] < doc:
                gone[i:i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc] = kept, len(data) - len(kept), spans
    return out


def edit_infix(pattern: str, text: str) -> int:
    """Least edit distance of the pattern to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def near_components(docs: list[tuple[int, str | None]], words: int, percent: int) -> dict[int, tuple[int, int]]:
    """By id: size of the shingle set and the smallest id that is reachable over links."""
    import re

    sets = {}
    for doc, text in docs:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets[doc] = {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    parent = {doc: doc for doc in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            common, both = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if both and 100 * common >= percent * both:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {doc: (len(s), root(doc)) for doc, s in sets.items()}
