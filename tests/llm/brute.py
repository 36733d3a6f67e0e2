"""Plain one-process versions of the operators' contracts, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def simhash(text):
    w = words((text or "").translate(LOWER))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    if not grams:
        return 0
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, max_bits=3):
    """{row number: smallest row number reachable} over fingerprints at most ``max_bits`` apart."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def line_dedup(docs):
    """{doc_id: (n_lines, n_dropped, kept text)} for (doc_id, text) with distinct ids."""
    keys = defaultdict(set)
    blanks = " \t\n\x0b\x0c\r"
    for d, t in docs:
        for line in (t or "").split("\n"):
            k = line.strip(blanks).translate(LOWER)
            if len(k) >= 40:
                keys[k].add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(ds := keys.get(x.strip(blanks).translate(LOWER), ())) >= 5 and d != max(ds))]
        out[d] = len(lines), len(lines) - len(keep), "\n".join(keep)
    return out


def quality(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def secrets(text):
    """Base spans by start, then kind."""
    text, out = text or "", []
    rules = (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
             re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+"))
    for k, (kind, group, least) in enumerate((("assign", 2, 8), ("access", 0, 16), ("hex", 0, 32))):
        out += [(m.start(), k, kind, m.end()) for m in rules[k].finditer(text) if len(m[group]) >= least]
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


def spans_text(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def lm_base(docs):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}."""
    count = Counter()
    for d, t in docs:
        if crc(d) % 7 != 2:
            count.update([*words((t or "").translate(LOWER)), None])
    n, v = sum(count.values()), len(count)
    out = {}
    for d, t in docs:
        toks = [*words((t or "").translate(LOWER)), None]
        out[d] = (crc(d) % 7 == 2, len(toks), sum(count[x] > 0 for x in toks), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in toks))
    return out


def contained(docs, items, share=0.8):
    """{(doc_id, item_id): (n_shared, n_item)} by distinct five-word shingles."""
    def norm(t):
        return [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]

    def grams(w, k):
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
    out = {}
    for i, t in items:
        w = norm(t)
        want = grams(w, min(5, len(w))) if w else set()
        for d, text in docs:
            n = len(want & grams(norm(text), min(5, len(w)))) if want else 0
            if want and n >= share * len(want) - 1e-9:
                out[d, i] = n, len(want)
    return out
