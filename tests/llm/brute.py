"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

_LOWER = {c: c + 32 for c in range(65, 91)}
SPACE = " \t\n\x0b\x0c\r"


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def line_dedup(rows, min_chars=40, min_docs=5):
    """rows: (doc_id, text). Returns [(doc_id, n_lines, n_dropped, kept text)]; a document is a doc_id."""
    key = lambda line: line.strip(SPACE).translate(_LOWER)
    holders = defaultdict(set)
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].add(-1 if d is None else d)
    keep = {k: max(h) for k, h in holders.items() if len(h) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keep.get(key(x), None) in (None, -1 if d is None else d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def simhash(text, size=3):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(_LOWER))
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_components(rows, size=3, bits=3):
    """rows: (doc_id, text). Returns [(doc_id, fingerprint hex, component id)]."""
    fps = [simhash(t, size) for _, t in rows]
    ids = defaultdict(list)
    for (d, _), f in zip(rows, fps):
        ids[f].append(d)
    fs = list(ids)
    parent = {f: f for f in fs}

    def root(f):
        while parent[f] != f:
            parent[f] = parent[parent[f]]
            f = parent[f]
        return f

    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= bits:
                parent[root(a)] = root(b)
    least = {}
    for f in fs:
        some = [d for d in ids[f] if d is not None]
        if some:
            least[root(f)] = min([least[root(f)], *some] if root(f) in least else some)
    return [(d, f"{f:016x}", least.get(root(f))) for (d, _), f in zip(rows, fps)]


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contamination(docs, items, size=10):
    """Returns [(doc_id, n_words, n_hit, n_items, sha, contaminated)]."""
    where = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(_LOWER))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            where[tuple(w[k : k + size])].add("" if i is None else str(i))
    lengths = sorted({len(w) for w in where})
    out = []
    for d, t in docs:
        w = WORD.findall((t or "").translate(_LOWER))
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                got = where.get(tuple(w[k : k + n]))
                if got:
                    found |= got
                    hit.update(range(k, k + n))
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def same_rows(a, b):
    return Counter(a) == Counter(b)


def auc(score, label):
    """Chance that a row of label 1 scores above one of label 0, ties by half."""
    a, b = ([s for s, y in zip(score, label) if y == k] for k in (1, 0))
    return sum((x > y) + 0.5 * (x == y) for x in a for y in b) / (len(a) * len(b))
