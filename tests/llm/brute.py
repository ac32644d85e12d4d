"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

W = re.compile(r"[^\x20\x09-\x0D]+")


def secret_spans(text):
    from waygrid.llm import secrets
    text = text or ""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    for rank, pattern, least, kind in ((1, r"AKIA[A-Z0-9]+", 20, "access"), (2, r"[0-9a-f]+", 24, "hex")):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    base = list(out)
    for m in re.finditer(r"[A-Za-z0-9+/=_-]+", text):
        c = m[0]
        if len(c) < 20 or any(re.search(p, c) for p in secrets.ALLOW):
            continue
        inside = set()
        for i in range(len(c) - 19):
            if secret_window(c[i:i + 20]):
                inside.update(range(i, i + 20))
        for run in re.finditer(r"[A-Za-z0-9]+", c):  # a key is covered to both ends
            if inside.intersection(range(*run.span())):
                inside.update(range(*run.span()))
        for s in sorted(i for i in inside if i - 1 not in inside):
            e = s
            while e in inside:
                e += 1
            word = r"(?:[A-Z]?[a-z]+|[A-Z]+)?"
            lead, trail = re.match(rf"(?:{word}[+/=_-])*", c[s:e]), re.search(rf"(?:[+/=_-]{word})*$", c[s:e])
            s, e = s + len(lead[0]), e - len(trail[0])
            if not any(b[0] <= m.start() + s and m.start() + e <= b[2] for b in base):
                out.append((m.start() + s, 3, m.start() + e, "entropy"))
    return sorted(out)


def secret_window(w):
    """Whether 20 characters are one of the shapes of a key."""
    from waygrid.llm import secrets
    bits = -sum(n / 20 * math.log2(n / 20) for n in Counter(w).values())
    low, up, num = (sum(a <= c <= b for c in w) for a, b in ("az", "AZ", "09"))
    wordy = sum(w[i:i + 2].lower() in secrets.PAIRS for i in range(19))
    odd = 20 - low - up - num
    at = lambda least: bits >= least - 1e-12
    return wordy <= 3 and (
        (at(3.0) and low >= 3 and num >= 3 and set(w) <= set("0123456789abcdef")) or (at(3.0) and up >= 3 and num >= 3 and set(w) <= set("0123456789ABCDEF"))
        or (at(3.6) and low >= 3 and up >= 3 and (num >= 2 and odd <= 2 or num >= 1 and not odd))
        or (at(3.6) and low >= 4 and num >= 3 and not up and not odd) or (at(3.5) and up >= 4 and num >= 1 and not low and not odd)
        or (at(3.9) and low >= 5 and up >= 5 and not odd))


def masked(text):
    spans, out, at = secret_spans(text), "", 0
    if not spans:
        return text
    for s, _, e, _ in spans:
        if s >= at:
            out += text[at:s] + "[secret]"
        at = max(at, e)
    return out + text[at:]


def quality(text):
    from waygrid.llm import quality as q
    text = text or ""
    ws = W.findall(text)
    lines = [s for s in text.split("\n") if W.search(s)]
    windows = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    m = dict(n_words=len(ws), word_chars=sum(map(len, ws)), n_symbols=sum(text.count(c) for c in q.SYMBOLS), n_lines=len(lines),
             n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(covered),
             n_stop_words=sum(w.strip(q.EDGES).lower() in q.STOP_WORDS for w in ws),
             n_bullet_lines=sum(bool(re.match(r"[-*•+][ \t\n\x0b\f\r]", s.lstrip(" "))) for s in lines),
             n_ellipsis_lines=sum(s.rstrip(" ").endswith(("...", "…")) for s in lines))

    def broken(r):
        scale = 1 if r.denominator is None else m[r.denominator]
        top = m[r.numerator] * (1 if r.denominator is None else 100)
        low, high = r.low is not None and top < r.low * scale, r.high is not None and top > r.high * scale
        return (low or high) and m["n_words"] >= r.from_words and scale > 0
    base = any(broken(r) for r in q.BASE)
    return m | {"base_failed": base, "kept": not base and not any(broken(r) for r in q.RULES)}


def shingles(text):
    ws = W.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4)))


def near_groups(rows, percent=85):
    """{row number: (set size, smallest id reachable)} of (doc_id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            k = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] or (k and 100 * k >= percent * len(sets[i] | sets[j])):
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return {i: (len(sets[i]), low.get(find(i)) if rows[i][0] is not None else None) for i in range(len(rows))}


def leaks(rows, items, share=0.6):
    """(doc_id, item_id) pairs, by scoring every item for every passage without an index."""
    from waygrid.llm import decontam as d
    split = [(i, d.terms(t)) for i, t in items if t and i is not None and d.terms(t)]
    n = len(split)
    df = Counter(t for _, ws in split for t in set(ws))
    mean = sum(len(ws) for _, ws in split) / max(n, 1)
    size = max([32, *(len(ws) for _, ws in split)])
    weigh = lambda t, c, length: math.log(1 + (n - df[t] + .5) / (df[t] + .5)) * c * (d.K1 + 1) / (c + d.K1 * (1 - d.B + d.B * length / mean))
    out = set()
    for doc, text in rows:
        ws = d.terms(text)
        for s in range(0, max(1, len(ws) - size), size) if ws else ():
            p = ws[s:s + 2 * size]
            for i, iw in split:
                weights = {t: weigh(t, c, len(iw)) for t, c in Counter(iw).items()}
                if sum(v for t, v in weights.items() if t in set(p)) < share * sum(weights.values()) * (1 - 1e-9):
                    continue
                sh = lambda x: {tuple(x[k:k + 5]) for k in range(max(1, len(x) - 4))}
                if len(iw) >= 5 and len(sh(iw) & sh(p)) < d.SHINGLE_OVERLAP * len(sh(iw)):
                    continue
                cut = max(len(iw) - d.ANSWER_WORDS, 0)
                have = Counter(p)
                part = lambda x: sum(min(c, have[t]) for t, c in Counter(x).items()) / len(x)
                if part(iw[:cut] or iw) >= d.OVERLAP and part(iw[cut:]) >= d.OVERLAP:
                    out.add((doc, i))
    return out


def digest(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()
