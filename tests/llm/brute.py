"""Plain rules of the contracts, for small inputs: what the operators' results are compared with."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TOKEN = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def decontaminate(docs, items, window=10):
    """[(doc_id, text)], [(item_id, text)] -> [(doc_id, n_words, n_hit, n_items, sha, contaminated)]"""
    grams = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            grams.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    sizes = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                owners = grams.get(tuple(w[i : i + n]))
                if owners:
                    hit.update(range(i, i + n))
                    found |= owners
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit)))
    return out


def quality(docs):
    """[(doc_id, text)] -> [(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)]"""
    out = []
    for doc, text in docs:
        text = text or ""
        w = TOKEN.findall(text)
        lines = [x for x in text.split("\n") if TOKEN.search(x)]
        at = {}
        for i in range(len(w) - 7):
            at.setdefault(tuple(w[i : i + 8]), []).append(i)
        rep = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(8)}
        failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
        row = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep))
        out.append((doc, *row, failed))
    return out


def components(n, links):
    """Smallest member reachable by links, per member."""
    parent = {i: i for i in n}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def jaccard(docs, width=4, percent=85):
    """[(doc_id, text)] -> [(doc_id, n_shingles, component_id)]"""
    sets = {}
    for doc, text in docs:
        w = TOKEN.findall((text or "").translate(LOWER))
        sets[doc] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    ids = sorted(sets)
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    links.append((a, b))
    comp = components(ids, links)
    return [(d, len(sets[d]), comp[d]) for d in ids]


def repeats(docs, width=50):
    """[(doc_id, text)] -> [(doc_id, n_bytes, n_removed, n_spans, kept_sha256)]"""
    first = {}
    raw = {d: (t or "").encode() for d, t in docs}
    for d in sorted(raw):
        b = raw[d]
        for i in range(len(b) - width + 1):
            first.setdefault(b[i : i + width], d)
    out = []
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def spelling(docs, every=31, least_length=7, least_count=2, dominance=10):
    """(word, form, root, n, n_near, form_n) of all words."""
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % every == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    cut = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            cut[i, w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for (_, short), longer in cut.items():
        for w in longer:
            near[w] |= longer - {w}
            if short in words:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w in words:
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        if best and words[best] >= dominance * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return [(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()]


def clusters(rows, k=16, rounds=3):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the usable (vec_id, vector) rows."""
    kept = [
        (i, [math.floor(64 * float(x)) for x in v])
        for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centers = [v for _, v in sorted((name(i), v) for i, v in kept)[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((gap(v, c), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centers = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centers)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return [(i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in found]


def token_rows(docs, tokenizer, end=2):
    """(doc_id, start, n_tokens, ids_crc32), keys ascending and the missing one last."""
    at, out = 0, []
    for doc, text in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    return out


def cross_entropy(docs, target, fold_of, prior):
    """(doc_id, n_tokens, loss_target, loss_background, score) of documents with words, all words in the vocabulary."""
    words = [(d, (t or "").translate(LOWER).encode().split(), fold_of((t or "").encode())) for d, t in docs]
    v = len({w for _, own, _ in words for w in own}) + 1
    one, pair, context, total = Counter(), Counter(), Counter(), Counter()
    for d, own, f in words:
        g = f, d in target
        for a, b in zip([None, *own], own):
            pair[g, a, b] += 1
            context[g, a] += 1
            one[g, b] += 1
            total[g] += 1
    out = []
    for d, own, f in words:
        loss = []
        for m in (True, False):
            g = 1 - f, m
            p = [
                (pair[g, a, b] + prior * (one[g, b] + 1) / (total[g] + v)) / (context[g, a] + prior)
                for a, b in zip([None, *own], own)
            ]
            loss.append(-sum(map(math.log, p)) / len(p) if p else None)
        out.append((d, len(own), *loss, loss[0] - loss[1] if own else None))
    return out
