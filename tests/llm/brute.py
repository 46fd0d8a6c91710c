"""Plain versions of the contracts, for small inputs: rows are (doc_id, text) with no nulls in doc_id."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def op2_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def op5(rows):
    fps = {}
    for doc, text in rows:
        words = WORD.findall(lower(text))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.setdefault(doc, []).append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    distinct = sorted({f for v in fps.values() for f in v})
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    least = defaultdict(lambda: 1 << 62)
    for doc, own in fps.items():
        for f in own:
            least[find(f)] = min(least[find(f)], doc)
    return sorted((doc, f"{f:016x}", least[find(f)]) for doc, own in fps.items() for f in own)


def op9(rows, length=100):
    first = {}
    data = sorted((doc, (text or "").encode()) for doc, text in rows)
    for doc, raw in data:
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i : i + length], (doc, i))
    out = []
    for doc, raw in data:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < (doc, i):
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out)


def op10(rows, window=50):
    first = {}
    data = sorted((doc, WORD.findall(text or "")) for doc, text in rows)
    for doc, words in data:
        for i in range(len(words) - window + 1):
            first.setdefault(tuple(words[i : i + window]), doc)
    out = []
    for doc, words in data:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        out.append((doc, len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone) if not g).encode()).hexdigest()))
    return sorted(out)


def op6(pages):
    import base64

    groups = defaultdict(list)
    for key, html in pages:
        groups[html or ""].append(key)
    out = []
    for html, keys in groups.items():
        raw = html.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out += [(k, len(raw), digest, "response" if k == max(keys) else "revisit", None if k == max(keys) else max(keys)) for k in keys]
    return sorted(out)


def op7_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def op7_base(text, phrases):
    words = op7_words(text)
    places = [(i, label) for p, label in phrases for w in [p.split()] for i in range(len(words)) if words[i : i + len(w)] == w]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def op7_method(text, templates, common, block_of, threshold=0.8):
    """Labels and best containment, from every block and template."""
    import math

    words = op7_words(text)
    hits, best = set(), 0.0
    for wording, label in templates:
        block = block_of(wording)
        for at in range(0, max(1, len(words)), block // 2):
            own = set(words[at : at + block])
            need = set(wording.split()) - common
            if len(own & need) >= max(1, math.ceil(threshold * len(need) - 1e-9)):
                hits.add(label)
                best = max(best, len(own & need) / len(need))
    return hits, best


def op4(rows, items, size=8, least=13):
    """(doc, item) of literal matches: words without ASCII punctuation, windows on one alignment."""
    norm = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower()) if w]
    index = defaultdict(set)
    length = {}
    for item, text in items:
        words = norm(text)
        length[item] = len(words)
        for i in range(len(words) - size + 1):
            index[tuple(words[i : i + size])].add((item, i))
    out = set()
    for doc, text in rows:
        words, found = norm(text or ""), defaultdict(set)
        for i in range(len(words) - size + 1):
            for item, k in index.get(tuple(words[i : i + size]), ()):
                found[item, i - k] |= set(range(k, k + size))
        out |= {(doc, item) for (item, _), covered in found.items() if len(covered) >= min(least, length[item])}
    return out


UNITS = set("km cm mm kg mg ml kwh mph kmh percent m g l s h".split()) | {u + e for u in "hour minute second day week month year mile meter metre dollar euro cent".split() for e in ("", "s")}


def op4_words(text):
    """(plain, template, value) of each word, read off sign by sign."""
    import unicodedata

    words, own = [], ""
    text = text or ""
    for k, c in enumerate(text):
        before, after = text[k - 1 : k], text[k + 1 : k + 2]
        digit = lambda x: x != "" and x in "0123456789"
        if c in ".," and digit(before) and digit(after):
            own += "·"
        elif ord(c) < 128 and not c.isalnum():
            words, own = [*words, own], ""
        elif own and digit(own[-1]) and unicodedata.category(c)[0] == "L":
            words, own = [*words, own], c
        else:
            own += c
    words = [w for w in [*words, own] if w]
    out = []
    for k, w in enumerate(words):
        low, kinds = w.lower(), [unicodedata.category(c) for c in w]
        if w[0] in "0123456789":
            mark = "<number>"
        elif kinds[0] == "Lu" and len(w) > 1 and set(kinds[1:]) == {"Ll"}:
            mark = "<name>"
        elif low in UNITS and k and words[k - 1][0] in "0123456789":
            mark = "<unit>"
        else:
            mark = low
        out.append((low, mark, low[:-1] if len(low) > 2 and low.endswith("s") and low[-3:-1].isalpha() else low))
    return out


def op4_slots(rows, items, size=8, least=13, literal=2):
    """(doc, item): (covered, slots, changed) of the best alignment, from comparing each item with each place of each text."""
    out = {}
    for doc, text in rows:
        words = op4_words(text)
        for item, wording in items:
            own = op4_words(wording)
            n, found, refused = len(own), [], False
            if not n:
                continue
            for kind, width in ((0, min(size, n)), (1, min(least, n))):
                good = [i for i in range(n - width + 1) if kind or sum(not m.startswith("<") for _, m, _ in own[i : i + width]) >= literal]
                for shift in range(-n, len(words)):
                    starts = [i for i in good if 0 <= i + shift <= len(words) - width and all(own[i + k][1 - kind] == words[i + shift + k][1 - kind] for k in range(width))]
                    covered = {i + k for i in starts for k in range(width)}
                    if not starts or len(covered) < min(least, n):
                        continue
                    pairs = [(own[i][2], words[i + shift][2]) for i in sorted(covered) if own[i][1].startswith("<")] if not kind else []
                    if len(set(pairs)) == len({a for a, _ in pairs}) == len({b for _, b in pairs}):
                        found.append((-len(covered), kind, shift, len(covered) == n, len(pairs), sum(a != b for a, b in pairs)))
                    else:
                        refused = True
            found = [f for f in found if f[1] == 0 or f[3] or not refused]
            if found:
                best = min(found)
                out[doc, item] = (-best[0], best[4], best[5])
    return out


def near(rows, least=0.8):
    """The smallest id of each component of rows whose five-word shingle sets have that Jaccard similarity, from all pairs."""
    words = {k: tuple(WORD.findall(lower(t))) for k, t in rows}
    sets = {k: {w[i : i + 5] for i in range(max(1, len(w) - 4))} if w else set() for k, w in words.items()}
    root = {k: k for k in words}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(words)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if words[a] == words[b] or shared and shared >= least * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k for k in root if find(k) == k}
