"""Plain Python forms of the operators, for small inputs."""

import hashlib
import re
import struct
import unicodedata
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingle_sets(rows, k):
    out = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(FOLD))
        out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def near_duplicates(rows, k, percent):
    """{doc_id: (set size, component, kept)}; ids are unique."""
    sets = shingle_sets(rows, k)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def without_repeats(rows, width):
    """[(id, words, removed, kept text)] in row order."""
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[j : j + width]) for _, w in texts for j in range(len(w) - width + 1))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            if seen[tuple(w[j : j + width])] > 1:
                gone[j : j + width] = [True] * width
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def item_words(text):
    folded = re.sub(r"[\W_]+", " ", (text or "").lower()).strip()
    return folded.split(" ") if folded else []


def grams(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else Counter()


def contaminated(docs, items, k, percent):
    """{(doc, item): (common, total) of the best window}."""
    out = {}
    for d, text in docs:
        words = item_words(text)
        for i, item in items:
            w = item_words(item)
            want = grams(w, k)
            for s in range(max(0, len(words) - len(w)) + 1):
                have = grams(words[s : s + len(w)], k)
                common = sum((have & want).values())
                total = sum((have | want).values())
                if common and common * 100 >= total * percent:
                    best = out.get((d, i))
                    if best is None or common / total > best[0] / best[1]:
                        out[d, i] = (common, total)
    return out


def canonical(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return re.sub(r"\s+", " ", folded).strip()


def fingerprint(text):
    import xxhash

    raw = canonical(text).encode()
    half = lambda salt: xxhash.xxh64(raw, seed=xxhash.xxh64(struct.pack("<i", salt), seed=42).intdigest()).intdigest()
    return f"{half(1):016x}{half(2):016x}"


def edited(rows):
    """{doc_id: (chars, sha256 of the edited text, edited text, next text)}; ids are unique."""
    ordered = sorted(((i, t or "") for i, t in rows), reverse=True)
    out = {}
    for n, (i, text) in enumerate(ordered):
        following = ordered[(n + 1) % len(ordered)][1]
        part = len(text) // 3
        new = text[: len(text) - part] + following[:part]
        out[i] = (len(text), hashlib.sha256(new.encode()).hexdigest(), new, following)
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def licenses(text, sentences, rules):
    """(identifiers, licences) by a plain scan."""
    table = {}
    for name, forms in sentences.items():
        for form in forms:
            form = form.lower().replace("license-identifier:", "license-identifier")
            parts = [re.sub("[^a-z0-9]+", " ", p).strip() for p in re.split(r"(?<=[.!?:;])[ \t]+", form)]
            table[max(parts, key=len)] = name
    found = []
    for line in (text or "").lower().replace("license-identifier:", "license-identifier").split("\n"):
        for part in re.split(r"(?<=[.!?:;])[ \t]+", line):
            key = re.sub("[^a-z0-9]+", " ", part.lower()).strip()
            if key in table:
                found.append(table[key])
    left, out = list(found), []
    for name, sequence in rules:
        at, hit = 0, False
        while at + len(sequence) <= len(left):
            if left[at : at + len(sequence)] == sequence:
                left[at : at + len(sequence)] = [None]
                hit = True
            at += 1
        if hit and name not in out:
            out.append(name)
    return found, out


def components(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for start in sorted(near):
        if start not in out:
            stack = [start]
            while stack:
                x = stack.pop()
                if x not in out:
                    out[x] = start
                    stack += near[x]
    return out
