"""Plain Python versions of the corpus operators' digests, for comparison on small tables."""

import hashlib
import re
from collections import Counter, defaultdict

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def op1(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(said), sha(said))
    return out


def op2(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def op7(rows):
    by = defaultdict(list)
    for doc_id, text in rows:
        by[text or ""].append(doc_id)
    return {d: (max(ids), len(ids), d == max(ids), sha(t)) for t, ids in by.items() for d in ids}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(re.sub("[^0-9]", "", s))):
        total += int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))
    return total % 10 == 0


def op8(text):
    n = lambda s: len(re.sub("[^0-9]", "", s))
    ok = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 14 <= n(s) <= 19 and luhn(s), "phone": lambda s: 10 <= n(s) <= 15}
    spans = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if ok[kind](m[0]))
    return [f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in spans]


def op10(text, encoding):
    ids = encoding.encode_ordinary(text or "")
    return len(ids), sha(",".join(map(str, ids))), sha(text or "")


def op8_terms(rows, min_count=3, min_share=0.5, min_g=24.0):
    """Of (id, text): id -> term spans, by the definition: counts over distinct texts, one pair of word and entity at a time."""
    from math import log

    base = {t: [(m.start(), m.end(), f"{kind}:{m[0]}") for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t) if f"{kind}:{m.start()}:{m.end()}" in op8(t)] for _, t in rows}
    plain = {t: "".join(" " if any(a <= i < b for a, b, _ in spans) else c for i, c in enumerate(t)) for t, spans in base.items()}
    word = lambda t: [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", plain[t])]
    words = {t: {w for _, _, w in word(t)} for t in plain}
    held = {t: {v for _, _, v in spans} for t, spans in base.items()}
    n, telling = len(plain), set()
    for e in {v for vs in held.values() for v in vs}:
        own = {t for t in plain if e in held[t]}
        for w in {w for t in own for w in words[t]}:
            with_word = {t for t in plain if w in words[t]}
            k, a, b = len(own & with_word), len(with_word), len(own)
            cells = [(k, a, b), (a - k, a, n - b), (b - k, n - a, b), (n - a - b + k, n - a, n - b)]
            g = sum(2 * x * log(x * n / (r * c)) for x, r, c in cells if x > 0)
            if k >= min_count and b >= min_count and k / a >= min_share and g >= min_g:
                telling.add(w)
    return {i: [f"term:{a}:{b}" for a, b, w in word(t) if w in telling] for i, t in rows}


def op6(text, weights, exceptions, fold):
    """Hits and sum of weights per hundred words: of each word the longest stem that it begins with, unless it or a neighbour excuses it."""
    from math import log

    words = re.findall(r"[^\W_]+", fold(text))
    hits = Counter()
    for k, w in enumerate(words):
        stems = [s for s in weights if w.startswith(s)]
        near = {w, f"{words[k - 1] if k else ''} {w}", f"{w} {words[k + 1] if k + 1 < len(words) else ''}"}
        if stems and not near & exceptions:
            hits[max(stems, key=len)] += 1
    total = sum(weights[s] * (1 + log(n)) for s, n in hits.items())
    return sum(hits.values()), 100 * total / (len(text.split()) + 100)
