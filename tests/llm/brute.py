"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def pii(text):
    """Base spans ``(start, kind number, end)``."""
    out = []
    for k, (kind, pattern) in enumerate(_PII.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def span_text(spans):
    return ",".join(f"{['email', 'ip', 'card', 'phone'][k]}:{a}:{z}" for a, k, z in spans)


def quality(text):
    text = text or ""
    words, lines = WORD.findall(text), Counter()
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    dup = 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += lines[line] > 0
            lines[line] += 1
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def shingles(text, n):
    words = WORD.findall((text or "").translate(_LOWER))
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) or (frozenset([tuple(words)]) if words else frozenset())


def near_components(docs, n, percent):
    """``{doc_id: (set size, component)}`` from all pairs."""
    sets, up = {d: shingles(t, n) for d, t in docs}, {d: d for d, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def substrings(docs, length=50):
    """``{doc_id: (bytes, removed, spans, sha256 of the rest)}``; ids are different."""
    first, out = {}, {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i:i + length], d)
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < d:
                gone[i:i + length] = True
        gone = gone[:-1]
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def ids_crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def normal_words(text):
    return [w for w in (re.sub(r"[\W_]+", "", x.lower()) for x in WORD.findall(text or "")) if w]


def best_shift(words, item):
    """Most equal words of ``item`` over all shifts of it along ``words``."""
    place, count = defaultdict(list), Counter()
    for i, w in enumerate(words):
        place[w].append(i)
    for j, w in enumerate(item):
        for i in place[w]:
            count[i - j] += 1
    return max(count.values(), default=0)


def simhash(text):
    import xxhash

    words = WORD.findall((text or "").translate(_LOWER))
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def simhash_components(docs):
    """``{bits: smallest id}`` from all pairs of rows."""
    bits = sorted({simhash(t) for _, t in docs})
    up = {b: b for b in bits}

    def top(b):
        while up[b] != b:
            b = up[b]
        return b

    for i, x in enumerate(bits):
        for y in bits[i + 1:]:
            if (x ^ y).bit_count() <= 4:
                up[top(x)] = top(y)
    least = {}
    for d, t in docs:
        if d is not None:
            b = top(simhash(t))
            least[b] = min(least.get(b, d), d)
    return {b: least.get(top(b)) for b in bits}


def damage(rows):
    """Rows ``(conv, turn, role, text)`` after damage, in order, by conversation."""
    out = {c: [] for c, *_ in rows}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out[c] += [(turn, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def conversation(rows):
    """Digest of one conversation: plain search over whole strings of edits."""
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "ok")
        seen.add((role, text))
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    full = {"u": "user", "a": "assistant"}

    def closed(ways):
        """Inserts from every state, until nothing gets better."""
        todo = list(ways)
        while todo:
            s = todo.pop()
            cost, edits, made = ways[s]
            for r in "ua":
                if r in follow[s] and (cost + 2, edits + "I") < ways.get(r, (9e9, ""))[:2]:
                    ways[r] = (cost + 2, edits + "I", [*made, (full[r], "")])
                    todo.append(r)
        return ways

    # Strings that cover the same rows differ before they end, so the least per state is enough at row borders.
    ways = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults):
        now = {}

        def offer(s, way):
            if s not in now or way[:2] < now[s][:2]:
                now[s] = way

        for s, (cost, edits, made) in closed(dict(ways)).items():
            offer(s, (cost + 3, edits + "D", made))
            if fault in ("ok", "truncated"):
                more = fault == "truncated"
                if role[:1] in follow[s] and role[:1]:
                    offer(role[0], (cost + more, edits + "K", [*made, (role, text)]))
                for r in "ua":
                    if r in follow[s]:
                        offer(r, (cost + 2 + more, edits + "R", [*made, (full[r], text)]))
        ways = now
    ends = closed(dict(ways))
    cost, audit, made = min((ends[s] for s in ("", "a") if s in ends), key=lambda w: w[:2])
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest
