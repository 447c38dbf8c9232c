"""Plain-Python versions of what the operators compute, for small fixtures."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import regex
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lower)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(rows):
    """{index: smallest doc_id reachable} by comparing all fingerprints with all."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[find(b)] = find(a)
    low = defaultdict(list)
    for d, f in rows:
        if d is not None:
            low[find(f)].append(d)
    return [min(low[find(f)], default=None) for _, f in rows]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def base_digest(text):
    return hashlib.sha256(",".join(f"{kind}:{s}:{e}" for s, _, e, kind in base_spans(text)).encode()).hexdigest()


def quality(text):
    text = text or ""
    w = words(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def spark_hash(text):
    """xxhash64 as Spark's function of that name gives it."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def targets(sizes, weights=(1.0, 2.0, 3.0), most=3):
    """Targets by sharing what is above the limit again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        for s in full or open_:
            out[s] = float(most * sizes[s]) if full else left * weight[s] / total
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def peak_pairs(payload):
    """(times, codes) of the spectral-peak pairs, frame by frame and peak by peak."""
    x = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    n = 1 + max(0, -(-(len(x) - 256) // 128))
    x = np.concatenate([x, np.zeros((n - 1) * 128 + 256 - len(x), np.float32)])
    window = np.hanning(257)[:256].astype(np.float32)
    rows = []
    for i in range(n):
        frame = x[i * 128 : i * 128 + 256]
        rows.append(np.abs(np.fft.rfft((frame - frame.mean()) * window)).astype(np.float32))
    at = lambda i, k: rows[i][k] if 0 <= i < n and 0 <= k < 129 else np.float32(-1)
    found = []
    for i, row in enumerate(rows):
        floor = 2 * row.mean() + 1e-3
        own = [k for k in range(1, 129) if row[k] > floor and row[k] > at(i, k - 1) and row[k] >= at(i, k + 1) and row[k] >= np.float32(0.99) * at(i - 1, k) and row[k] >= np.float32(0.99) * at(i + 1, k)]
        found += [(i, k) for k in sorted(sorted(own, key=lambda k: (-row[k], k))[:3])]
    pairs = [(t, (b << 16) | (c << 8) | (u - t)) for p, (t, b) in enumerate(found) for u, c in found[p + 1 : p + 4] if u - t <= 32]
    return [t for t, _ in pairs], [c for _, c in pairs]


def letter_grams(text):
    """The unit vector of hashed letter n-grams, gram by gram."""
    c = [ord(x) if x.isalpha() else 32 for x in f" {text.lower()} "]
    low, counts = (1 << 32) - 1, Counter()
    for i, x in enumerate(c):
        one = x * 2654435761 & low
        if x != 32:
            counts[one >> 20] += 1
        if i + 1 < len(c):
            two = (one ^ (c[i + 1] * 2246822519 & low)) * 3266489917 & low
            if x != 32 or c[i + 1] != 32:
                counts[two >> 20] += 1
            if i + 2 < len(c) and c[i + 1] != 32:
                counts[((two ^ (c[i + 2] * 668265263 & low)) * 374761393 & low) >> 20] += 1
    v = np.zeros(4096)
    for k, n in counts.items():
        v[k] = n**0.5
    return v / np.linalg.norm(v)


def all_spans(rows):
    """(doc_id, spans): base spans and every place of the terms that reveal an entity of the document."""
    n, own, held, terms, plain = len(rows), [], Counter(), Counter(), []
    both = Counter()
    for _, text in rows:
        found = base_spans(text)
        plain.append(re.sub(PII["email"], lambda m: "0" * len(m[0]), text or ""))
        words = {w.lower() for w in regex.findall(r"\p{L}{3,}", plain[-1])}
        entities = set()
        for start, _, end, kind in found:
            value = text[start:end]
            entities.add(f"{kind}:" + (value.lower() if kind == "email" else value if kind == "ip" else re.sub("[^0-9]", "", value)))
        own.append(entities)
        held.update(entities)
        terms.update(words)
        both.update((e, w) for e in entities for w in words)
    action = {}
    for (e, w), k in both.items():
        if k >= 3 and n > held[e]:
            share = math.log(k * n / (held[e] * terms[w])) / math.log(n / held[e])
            if share >= 0.8:
                action[e, w] = "removed" if share >= 0.95 else "generalised"
    out = []
    for (d, text), entities, bare in zip(rows, own, plain):
        spans = base_spans(text)
        for m in regex.finditer(r"\p{L}{3,}", bare):
            kinds = {action[e, m[0].lower()] for e in entities if (e, m[0].lower()) in action}
            if kinds:
                spans.append((m.start(), 4, m.end(), max(kinds)))
        out.append((d, ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(spans))))
    return out


def kept(rows, labels, grids, alpha, delta, cost):
    """Verdicts by doc_id: each stratum's cutoffs by exact binomial tails, tested along the grid."""
    label = {}
    for d, q in labels:
        if d is not None and q is not None:
            label[d] = min(q, label.get(d, q))
    signal, stratum, failed = {}, {}, {}
    for d, text, lang in rows:
        n, _, _, dup, repeat, failed[d] = quality(text)
        w, per = words(text), max(n, 1)
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        letters, capitals = (len(regex.findall(p, text or "")) for p in (r"\p{L}", r"\p{Lu}"))
        marks = len(regex.findall(r"[^\p{L}\p{N}\x20\x09-\x0D]", text or ""))
        signal[d] = {"marks": marks / per, "capitals": capitals / max(letters, 1), "repeats": 1 - len(set(w)) / per, "echoes": repeat / per, "lines": dup / max(len(lines), 1)}
        stratum[d] = (lang, "short" if n < 100 else "medium" if n < 1000 else "long")
    known = [d for d, _, _ in rows if d in label and not failed[d]]
    tests = len({stratum[d] for d in known}) * len(grids)
    rate, cut = alpha / len(grids), {}
    for s in {stratum[d] for d in known}:
        good, bad = ([d for d in known if stratum[d] == s and (label[d] >= 1) == g] for g in (True, False))
        for name, grid in grids.items():
            best = (0.0, None)
            for v in grid:
                lost, gained = (sum(signal[d][name] > v for d in x) for x in (good, bad))
                tail = sum(math.comb(len(good), j) * rate**j * (1 - rate) ** (len(good) - j) for j in range(lost + 1))
                if lost >= rate * len(good) or tail > delta / tests:
                    break
                gain = gained / max(len(bad), 1) - cost * lost / max(len(good), 1)
                if gained and gain > best[0] + 1e-12:
                    best = (gain, v)
            if best[1] is not None:
                cut[s, name] = best[1]
    return {d: not failed[d] and not any(signal[d][g] > cut.get((stratum[d], g), math.inf) for g in grids) for d, _, _ in rows}
