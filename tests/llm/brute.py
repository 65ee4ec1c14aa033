"""Pair-by-pair versions of what several tests compare with."""

import re
from collections import defaultdict

import numpy as np

from factorseg.llm import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def split(text):
    return WORD.findall(lower(text))


def groups(pairs):
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {a: find(a) for a in parent}


def paragraphs(text, reach=8, min_words=20):
    """(start byte, end byte, words) of the paragraphs of at least ``reach`` words, found word by word."""
    raw = text.encode()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    lines = [raw.count(b"\n", 0, a) for a, _ in spans]
    own = [lower(raw[a:b].decode()) for a, b in spans]
    data = np.frombuffer(raw, np.uint8)
    h = words.span_hashes(data, np.array([a for a, _ in spans], int), np.array([b for _, b in spans], int)) if spans else []
    n = len(spans)
    begin, segments = 0, []
    for i in range(1, n + 1):
        if i == n or lines[i] != lines[i - 1]:
            segments.append((begin, i, i - begin >= min_words))
            begin = i
    joined = []
    for a, b, long in segments:
        if joined and not long and not joined[-1][2]:
            joined[-1] = (joined[-1][0], b, False)
        else:
            joined.append((a, b, long))
    cuts = []
    for a, b, _ in joined:
        cuts.append(a)
        pair = {i: words.mixed(np.array([h[i]]) * np.uint64(5) + (h[i + 1] if i + 1 < b else np.uint64(0)))[0] for i in range(a, b)}
        for i in range(a + reach, b - reach + 1):
            if all(pair[i] < pair[j] for j in range(i - reach, i)) and all(pair[i] <= pair[j] for j in range(i + 1, min(b, i + reach + 1))):
                cuts.append(i)
    cuts.append(n)
    return [(spans[a][0], spans[b][0] if b < n else len(raw), own[a:b], p) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b - a >= reach]


def passages(texts, min_words=20):
    """{(id, text): {(start, end): (kept, removed)}} of all repeated paragraphs, pair by pair."""
    def parts(w):
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    units = [(i, t, *p) for i, t in sorted(set(texts)) for p in paragraphs(t)]
    sets = [parts(u[4]) for u in units]
    links = [(a, b) for a in range(len(units)) for b in range(a, len(units)) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    group = groups(links)
    out, members = defaultdict(dict), defaultdict(list)
    for n, u in enumerate(units):
        members[group[n]].append(n)
    hit = {n for g in members.values() if len(g) > 1 for n in g}
    return units, members, hit


def removals(units, members, hit, min_words=20):
    """(kept, removed) of the paragraphs in ``hit``: first occurrences, and those in runs of enough words of which none is kept."""
    kept = {min(g, key=lambda n: (units[n][0], units[n][5])) for g in members.values() if len(g) > 1}
    runs, removed = [], set()
    for n in sorted(hit - kept):
        if runs and n == runs[-1][-1] + 1 and units[n][:2] == units[n - 1][:2] and units[n][2] == units[n - 1][3]:
            runs[-1].append(n)
        else:
            runs.append([n])
    for run in runs:
        if sum(len(units[n][4]) for n in run) >= 20:
            removed |= set(run)
    return kept, removed


def without(text, doc_id, units, removed):
    raw = text.encode()
    for n in sorted((n for n in removed if units[n][:2] == (doc_id, text)), reverse=True):
        raw = raw[:units[n][2]] + raw[units[n][3]:]
    return raw.decode()
