"""Plain single-process versions that the operators are held against."""

import hashlib
import re
from collections import defaultdict

import xxhash


def simhash(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [words[i:i + shingle] for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(rows, bits=2):
    prints = [simhash(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                label[find(i)] = find(j)
    low = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        if key is not None:
            low[find(i)].append(key)
    return [(key, min(low[find(i)], default=None)) for i, (key, _) in enumerate(rows)]


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def decontaminate(rows, items, window=13):
    windows = defaultdict(set)
    for item, text in items:
        words = bench_words(text)
        for i in range(max(1, len(words) - window + 1)):
            if part := tuple(words[i:i + window]):
                windows[part].add(item or "")
    sizes, out = {len(p) for p in windows}, []
    for key, text in rows:
        words, hit, found = bench_words(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if (part := tuple(words[i:i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[part]
        out.append((key, len(words), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def repeats(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    count = defaultdict(int)
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i:i + length]] += 1
    out = []
    for (key, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((key, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


# -- operators 11 to 13 ------------------------------------------------------

def spelling(rows, least=5, ratio=5, drop=199):
    from zlib import crc32
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    counts = defaultdict(int)
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = crc32(f"{'' if key is None else key}:{run}".encode())
            if h % drop == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= least}

    def near(u, v):
        if len(u) > len(v):
            u, v = v, u
        if u == v or len(v) - len(u) > 1:
            return False
        i = next((i for i in range(len(u)) if u[i] != v[i]), len(u))
        return u[i + 1:] == v[i + 1:] if len(u) == len(v) else u[i:] == v[i + 1:]

    others = {u: [v for v in n if near(u, v)] for u in n}
    form = {}
    for u, vs in others.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[u] = best if best is not None and n[best] >= ratio * n[u] else None
    out = []
    for u in n:
        root = u
        while form[root] is not None:
            root = form[root]
        out.append((u, form[u], root, n[u], len(others[u]), n.get(form[u])))
    return sorted(out)


def _digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def merkle(rows, tamper):
    """rows: (doc_id, source, lang, n_chars, text); returns the manifest's rows, sorted."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: _digest(*map(field, r))

    def tree(nodes):
        """(root, for each leaf its list of (left, right))"""
        steps, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for s, i in zip(steps, at):
                lo = i // 8 * 8
                s.append(("".join(nodes[lo:i]), "".join(nodes[i + 1:lo + 8])))
            nodes = [_digest(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
            at = [i // 8 for i in at]
        return nodes[0], steps

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [tree([leaf(r) for r in groups[g]]) for g in order]
    root, upper = tree([t[0] for t in trees]) if trees else (None, [])
    out = []
    for g, (subroot, steps), up in zip(order, trees, upper):
        for r, own in zip(groups[g], steps):
            folded = leaf(tamper(r))
            for left, right in own + up:
                folded = _digest(left, folded, right)
            out.append((r[0], leaf(r), subroot, root, _digest(*[x + y for x, y in own + up]), folded, folded == root))
    return out


def exact_groups(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[text or ""].append(key)
    out = []
    for text, keys in groups.items():
        known = [k for k in keys if k is not None]
        keep = max(known, default=None)
        left = 1
        for k in keys:
            kept = k == keep and left == 1
            left -= kept
            out.append((k, keep, len(keys), kept, hashlib.sha256(text.encode()).hexdigest()))
    return out
