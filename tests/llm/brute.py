"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = SPACED.findall(lowered(text))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def jaccard(rows):
    """[(id, text)] -> {id: (n, component)}"""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(rows, width=100):
    """[(id, text)] -> {id: (bytes, removed, spans, sha of the rest)}"""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - width + 1):
            w = data[k : k + width]
            if w in seen:
                gone[k : k + width] = b"\1" * width
            seen.add(w)
        rest = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def contamination(rows, items, width=10):
    """[(id, text)], [(item, text)] -> {id: (words, hit, items, sha)}"""
    windows = {}
    for item, text in items:
        w = ALNUM.findall(lowered(text))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add("null" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = {}
    for i, text in rows:
        w, hit, found = ALNUM.findall(lowered(text)), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= owners
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def damage(rows):
    """[(conversation, turn, role, text)] damaged by the checksum of conversation and turn"""
    out = []
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if d:
            x = "" if d == 1 else re.sub("[.!?]", "", x) if d == 2 else x
            out += [(c, t, "user" if d == 4 else r, x)] * (2 if d == 3 else 1)
    return out


def repair(rows):
    """[(conversation, turn, role, text)] -> {conversation: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha)}, all paths forward with their audits"""
    onward = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    convs, out = {}, {}
    for c, *m in rows:
        convs.setdefault(c, []).append([" " if v is None and k else v for k, v in enumerate(m)])

    def put(best, state, *path):
        if state is not None and (state not in best or path[:2] < best[state][:2]):
            best[state] = path

    def with_inserts(best):
        for _ in range(3):
            for s, (cost, audit, text) in list(best.items()):
                for role in ("user", "assistant"):
                    put(best, onward.get((role[0], s)), cost + 3, audit + "I", text + [(role, "")])
        return best

    for c, own in convs.items():
        own.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], hashlib.md5(m[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, r, x in own:
            rest = x.strip(" \t\n\x0b\f\r")
            faults.append("b" if not rest else "d" if (r, x) in seen else "t" if rest[-1] not in ".!?" else "")
            seen.add((r, x))
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        best = with_inserts({0: (0, "", [])})
        for (_, r, x), fault in zip(own, faults):
            after, extra = {}, 3 if fault == "t" else 0
            for s, (cost, audit, text) in best.items():
                put(after, s, cost + 4, audit + "D", text)
                if fault not in ("b", "d"):
                    put(after, onward.get((r[:1], s)), cost + extra, audit + "K", text + [(r, x)])
                    for role in ("user", "assistant"):
                        put(after, onward.get((role[0], s)), cost + 3 + extra, audit + "R", text + [(role, x)])
            best = with_inserts(after)
        cost, audit, text = min((best[s] for s in (0, 3) if s in best), key=lambda v: v[:2])
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in "bdt"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                  cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in text).encode()).hexdigest())
    return out


def resample(rows, target, percent=25, buckets=10000):
    """[(id, text)], [text] -> {id: (features, weight, score, rank)}"""

    def features(text):
        w = ALNUM.findall(lowered(text))
        return len(w), [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    own = {i: features(t) for i, t in rows}
    corpus, aim = Counter(b for _, f in own.values() for b in f), Counter(b for t in target for b in features(t)[1])
    n, m = sum(corpus.values()), sum(aim.values())
    out, able = {}, []
    for i, (words, f) in own.items():
        gains = [math.floor(1000 * math.log((aim[b] + 1) * (n + buckets) / ((corpus[b] + 1) * (m + buckets)))) for b in f]
        weight = sum(gains) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if words >= 20:
            able.append((-out[i][2], i is not None, i))
    for place, (*_, i) in enumerate(sorted(able)[: percent * len(able) // 100]):
        out[i][3] = place + 1
    return {i: tuple(v) for i, v in out.items()}
