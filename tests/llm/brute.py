"""Plain versions of the operators, written from the contracts, for comparison on small tables."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
    r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ENDPOINT = re.compile(r"""https?://[^\x20\x09-\x0D"'<>]+""")
KINDS = ["assign", "access", "hex", "weak_access", "weak_secret", "endpoint"]
ROLE = {"access": "id", "weak_access": "id", "assign": "secret", "hex": "secret", "weak_secret": "secret", "endpoint": "endpoint"}


def secrets(text, reach=300):
    """(base spans, all spans) as (start, kind number, kind, end)."""
    text = text or ""
    parts = []
    for m in ASSIGN.finditer(text):
        n = len(m[2])
        if n >= 6:
            parts.append((m.start(), m.end(), "assign" if n >= 12 else "weak_secret"))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        n = m.end() - m.start()
        if n >= 12:
            parts.append((m.start(), m.end(), "access" if n >= 18 else "weak_access"))
    parts += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
    parts += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    base = sorted((s, KINDS.index(k), k, e) for s, e, k in parts if k in KINDS[:3])

    def near(part, role):
        s, e, k = part
        return any(ROLE[q[2]] == role and q != part and (s - q[1] <= reach if (q[0], q[2]) < (s, k) else q[0] - e <= reach) for q in parts)

    needs = {"weak_access": ("secret", "endpoint"), "weak_secret": ("id", "endpoint"), "endpoint": ("id", "secret")}
    more = [(s, KINDS.index(k), k, e) for s, e, k in parts if k in needs and all(near((s, e, k), r) for r in needs[k])]
    return base, sorted(base + more)


def span_text(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)


def secret_row(text):
    base, spans = secrets(text)
    count = Counter(k for _, _, k, _ in base)
    return (count["assign"], count["access"], count["hex"], hashlib.sha256(span_text(base).encode()).hexdigest(), span_text(spans))


def quality_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    n = len(words)
    return (n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def normal_line(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").translate({c: c + 32 for c in range(65, 91)})


def quality(rows, least=20, share=0.05):
    """rows: (doc_id, source, text); gives {doc_id: (counts..., removed words, kept)}"""
    documents, holds = {}, {}
    for _, source, text in rows:
        documents.setdefault(source, set()).add(text or "")
        for line in (text or "").split("\n"):
            if WORD.search(line):
                holds.setdefault((source, normal_line(line)), set()).add(text)
    frequent = {k for k, v in holds.items() if len(v) > least and len(v) > share * len(documents[k[0]])}
    out = {}
    for doc_id, source, text in rows:
        lost = sum(len(WORD.findall(x)) for x in (text or "").split("\n") if WORD.search(x) and (source, normal_line(x)) in frequent)
        counts = quality_counts(text)
        out[doc_id] = (*counts, lost, not counts[5] and 2 * lost <= counts[0])
    return out


def fingerprint(text, size=4):
    import xxhash

    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components(prints, bits=4):
    """{print: least print reachable}, by comparing all pairs."""
    import numpy as np

    values = np.array(sorted(set(prints)), np.uint64)
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= bits) + i + 1:
            a, b = sorted((root(i), root(int(j))))
            parent[b] = a
    return {int(v): int(values[root(i)]) for i, v in enumerate(values)}


def near_duplicates(rows, bits=4):
    """rows: (doc_id, text); gives {doc_id: (fingerprint, component)}"""
    prints = {d: fingerprint(t) for d, t in rows}
    group = components(prints.values(), bits)
    least = {}
    for d, p in prints.items():
        least[group[p]] = min(d, least.get(group[p], d))
    return {d: (f"{p:016x}", least[group[p]]) for d, p in prints.items()}


def _xxh(data, seed=42):
    import xxhash

    return xxhash.xxh64_intdigest(data, seed=seed)


WINDOWS = (1,) * 12 + (2,) * 4


def line_chunks(text):
    """[(first line, last line, whether a boundary set makes it a chunk)] of neighbouring lines with words."""
    lines = text.split("\n")
    worded = [i for i, x in enumerate(lines) if WORD.search(x)]
    hashes = [_xxh(lines[i].encode()) for i in worded]
    turned = lambda h, by: (h << by | h >> (64 - by)) & (2**64 - 1) if by else h

    def mark(i, opening):
        total = 0
        for window in sorted(set(WINDOWS)):
            rolled = 0
            for at in range(window):
                j = i + (at if opening else at - window + 1)
                rolled ^= turned(hashes[j] if 0 <= j < len(hashes) else 0, window - 1 - at)
            value = _xxh((2 * window + opening).to_bytes(8, "little"), _xxh(rolled.to_bytes(8, "little")))
            total |= sum(1 << s for s, w in enumerate(WINDOWS) if w == window) & value
        return total

    return [(worded[i], worded[i + 1], bool(mark(i, True) & mark(i + 1, False))) for i in range(len(worded) - 1)]


def line_dedup(rows):
    """rows: distinct (doc_id, text) with ids that are not null; gives {doc_id: text}"""
    lines, firsts, before, after, matches = {}, {}, {}, {}, []
    for doc_id, text in sorted(rows):
        lines[doc_id] = own = text.split("\n")
        for first, last, caught in line_chunks(text):
            chunk = tuple(own[first:last + 1])
            if not caught:
                before[doc_id, last], after[doc_id, first] = (first, chunk), (last, chunk)
            elif chunk in firsts:
                matches.append((doc_id, first, last, *firsts[chunk]))
            else:
                firsts[chunk] = (doc_id, first, last)
    seen = set(matches)
    while matches:
        doc_id, first, last, of, of_first, of_last = matches.pop()
        for gaps, edge, of_edge in ((before, first, of_first), (after, last, of_last)):
            mine, its = gaps.get((doc_id, edge)), gaps.get((of, of_edge))
            if mine and its and mine[1] == its[1]:
                grown = (doc_id, *sorted((edge, mine[0])), of, *sorted((of_edge, its[0])))
                if grown not in seen:
                    seen.add(grown)
                    matches.append(grown)
    gone = {}
    for doc_id, first, last, *_ in seen:
        gone.setdefault(doc_id, set()).update(range(first, last + 1))
    return {d: "\n".join(x for i, x in enumerate(own) if i not in gone.get(d, ())) for d, own in lines.items()}


def repeated_lines(rows):
    """Exact search: {doc_id: text} without the lines of any run of two or more lines with words that has occurred before."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        own, gone = text.split("\n"), set()
        worded = [i for i, x in enumerate(own) if WORD.search(x)]
        for a, b in zip(worded, worded[1:]):
            run = tuple(own[a:b + 1])
            if run in seen:
                gone.update(range(a, b + 1))
            seen.add(run)
        out[doc_id] = "\n".join(x for i, x in enumerate(own) if i not in gone)
    return out


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target}: excess over ``most`` times a source's size is shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, total = {}, sum(sizes.values())
    while len(out) < len(names):
        rest = [s for s in names if s not in out]
        share = {s: (total - sum(out.values())) * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s] + 1e-9]
        out |= {s: float(most * sizes[s]) for s in over} if over else share
    return out
