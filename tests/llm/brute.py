"""Plain versions of the contracts, for small inputs."""

import hashlib
import re
from collections import Counter

WS = "\x20\x09-\x0D"
EDGES = "\"'()[]{}<>,;:!?."


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans)).encode()).hexdigest()


def luhn(d):
    return sum(sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m, d: 14 <= len(d) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 10 <= len(d) <= 15),
)


def pii(text):
    out = seeds(text)
    return Counter(k for *_, k in out), digest(out)


def seeds(text):
    """(start, rank, end, kind) of the base."""
    t, out = text or "", []
    only = lambda s: re.sub("[^0-9]", "", s)
    for r, (kind, pat, ok) in enumerate(PII):
        out += [(m.start(), r, m.end(), kind) for m in re.finditer(pat, t) if ok(m[0], only(m[0]))]
    return out


def discovered(texts, forms, prior=2, least=8, sure_at=0.8):
    """For each text the spans (start, rank, end) that the bootstrap adds, straight from its description."""
    trim = lambda w: w.strip(EDGES)
    group = r"[(+]?+[0-9][0-9().-]*+"
    candidate = rf"(?<![^{WS}])(?:{group}(?: {group})++[,;:!?]*+(?![^{WS}])|[^{WS}0-9@]*+[0-9@][^{WS}]*+)"

    def around(matches, t):
        """(start, end, text, patterns) of each; between two matches the words of the one before count, no further."""
        out = []
        for k, m in enumerate(matches):
            a = matches[k - 1].start() if k else 0
            z = matches[k + 1].end() if k + 1 < len(matches) else len(t)
            before, after = t[a : m.start()][-200:], t[m.end() : z][:200]
            w = re.findall(rf"[^{WS}]+", before) if re.search(rf"[{WS}]$", before) else []
            r = re.match(rf"[{WS}]+([^{WS}]+)", after)
            left, right = " ".join(trim(x) for x in w[-2:]).lower(), trim(r[1]).lower() if r else ""
            out.append((m.start(), m.end(), m[0], left, right))
        return out

    def named(left, right, value):
        near, shape = left.split(" ")[-1], re.sub("[0-9]+", "9", re.sub("[a-z]+", "a", value.lower()))
        return [x for x, y in ((f"left {near}", near), (f"two left {left}", near and re.match("[^ ]+ ", left)), (f"right {right}", right), (f"both {near} {right}", near and right), (f"shape {near} {shape}", near)) if y]

    seen = []  # text, start, end, value, patterns, rank
    for d, t in enumerate(texts):
        t = t or ""
        base = seeds(t)
        only = lambda s: re.sub("[^0-9]", "", s)
        for r, (kind, pat, ok) in enumerate(PII):
            for s, e, v, left, right in around(list(re.finditer(pat, t)), t):
                if ok(v, only(v)):
                    seen.append((d, s, e, v, named(left, right, v), r))
        for s, e, v, left, right in around(list(re.finditer(candidate, t)), t):
            if not any(a < e and s < b for a, _, b, _ in base):
                seen.append((d, s + len(v) - len(v.lstrip(EDGES)), e - len(v) + len(v.rstrip(EDGES)), trim(v), named(left, right, trim(v)), None))
    graph, known = {}, {(v, r) for *_, v, _, r in seen if r is not None}
    for _, _, _, v, ps, _ in seen:
        for p in ps:
            graph.setdefault(p, set()).add(v)
    seed_values = {v for v, _ in known}
    fits = lambda v, r: re.search(forms[r], v) is not None
    while True:
        held = {(p, r): sum((v, r) in known for v in vs) for p, vs in graph.items() for r in range(len(forms))}
        held = {k: n for k, n in held.items() if n >= least}
        confidence = {k: n / (len(graph[k[0]]) + prior) for k, n in held.items()}
        sure = {k: c for k, c in confidence.items() if c >= sure_at}
        fresh = {(v, r) for p, r in sure for v in graph[p] if v not in seed_values and fits(v, r)} - known
        if not fresh:
            break
        known |= fresh
    out = [[] for _ in texts]
    for d, s, e, v, ps, r in seen:
        if r is None and (found := [(sure[p, k], -k) for p in ps for k in range(len(forms)) if (p, k) in sure and fits(v, k)]):
            out[d].append((s, -max(found)[1], e))
    return [sorted(x) for x in out]


def secrets(text):
    t, out = text or "", []
    for r, (kind, pat, ok) in enumerate((
        ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    )):
        out += [(m.start(), r, m.end(), kind) for m in re.finditer(pat, t) if ok(m)]
    return Counter(k for *_, k in out), digest(out)


def words(text):
    return re.findall(rf"[^{WS}]+", text or "")


def quality(text):
    t, w = text or "", words(text)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(wins)
    rep = {j for i, x in enumerate(wins) if n[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)


def line_dedup(docs):
    """docs: {doc_id: text}."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for d, t in docs.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(d)
    out = {}
    for d, t in docs.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == d]
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def shingles(text, k=2):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(n, linked):
    """Smallest reachable index for each of range(n); linked: pairs."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
