"""Plain-Python versions of the operator contracts, for small inputs."""

import hashlib
import re
import zlib

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def licenses(text):
    """(n_words, n_base, first_word, last_word, base_labels) of a text."""
    words, at, labels = alnum_words(text), [], set()
    for phrase, label in {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def pieces(tokenizer, text, size=2048):
    """(piece, start, length, crc32) of a text."""
    import struct

    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
    out = []
    for k, at in enumerate(range(0, len(ids), size)):
        part = ids[at:at + size]
        out.append((k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    return out


def decontaminate(docs, items, window=10):
    """doc_id -> (n_words, n_hit, sorted item ids as strings)."""
    wins = []
    for item, text in items:
        w = alnum_words(text)
        n = min(window, len(w))
        wins += [(item, w[i:i + n]) for i in range(len(w) - n + 1)] if n else []
    out = {}
    for doc, text in docs:
        w, hit, found = alnum_words(text), set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if w[i:i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found |= {str(item)} - {"None"}
        out[doc] = len(w), len(hit), sorted(found)
    return out


def near_duplicates(docs, k=4, percent=85):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {}
    for doc, text in docs:
        w = space_words(text)
        sets[doc] = {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    ids = sorted(sets)
    comp = {d: d for d in ids}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                ra, rb = sorted((root(a), root(b)))
                comp[rb] = ra
    return {d: (len(sets[d]), root(d)) for d in ids}


def secrets(text):
    """Base spans (kind, start, end) in order."""
    text, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 8 and m[1].isascii():
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda s: (s[1], order[s[0]]))
