"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def kept_words(rows, size=13):
    """{id: (n_words, kept words)} of rows (id, text)."""
    first, words = {}, {}
    for i, text in rows:
        words[i] = _WORD.findall(text or "")
        for k in range(len(words[i]) - size + 1):
            w = tuple(words[i][k : k + size])
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, own in words.items():
        gone = [False] * len(own)
        for k in range(len(own) - size + 1):
            if first[tuple(own[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out[i] = len(own), [w for w, g in zip(own, gone, strict=True) if not g]
    return out


def shingles(text, n=5):
    w = _WORD.findall((text or "").translate(_LOWER))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def roots(nodes, links):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def near_groups(rows, percent=75):
    """{id: (set size, smallest id reachable)}."""
    sets, index = {i: shingles(t) for i, t in rows}, {}
    for i, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(i)
    links = []
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in index[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                links.append((i, j))
    root = roots(sets, links)
    return {i: (len(s), root[i]) for i, s in sets.items()}


def contaminates(item, text, window=8, least_words=5, common=None):
    """Whether one text holds one benchmark item: every window against every window. common: words that are no names at the start of a sentence, where others are."""
    from bitweave.llm.decontamination import LONG_RUN, SHARE, _template

    a, b = _template([item], common), _template([text], common)
    n = len(a.start)
    size, words = min(window, n), int((~a.sure).sum())
    least = n if n < window else min(LONG_RUN, max(window, SHARE * n))
    if not n:
        return False
    forms = lambda t: [t.typed.tolist()] if t.wide else [t.typed.tolist(), t.plain.tolist()]
    lines = {}
    for own in forms(a):
        for p in range(n - size + 1):
            for other in forms(b):
                for q in range(len(b.start) - size + 1):
                    if own[p : p + size] == other[q : q + size]:
                        lines.setdefault(q - p, set()).add(p)
    spread = lambda starts: {p + k for p in starts for k in range(size)}
    about = lambda p: (a.one[p], a.one[p + 1] if a.number[p] and p + 1 < n else None)
    minds = []
    for shift, starts in sorted(lines.items(), key=lambda x: (-len(x[1]), x[0])):
        places = spread(starts)
        changed = {p for p in places if a.slot[p] and a.hash[p] != b.hash[p + shift]}
        clear = lambda bad: spread({s for s in starts if not bad & set(range(s, s + size))})  # noqa: B023, E731
        if words < least_words:
            pieces = [clear(changed)]
        else:
            stands = {}
            for p in places:
                if a.slot[p]:
                    stands.setdefault(about(p), {}).setdefault(b.one[p + shift], []).append(p)
            if all(len(x) == 1 for x in stands.values()):
                pieces = [places]
            else:
                wrong = set()
                for values in stands.values():
                    most = max(map(len, values.values()))
                    top = [x for x in values.values() if len(x) == most]
                    wrong |= {p for x in values.values() if len(x) < most or len(top) > 1 for p in x}
                pieces = []
                for kept in (sorted(clear(wrong)), sorted(clear(changed))):
                    run = []
                    for p in [*kept, -1]:
                        if run and p != run[-1] + 1:
                            pieces += [set(run)] if len(run) >= least else []
                            run = []
                        run.append(p)
        for piece in filter(None, pieces):
            values = {about(p): b.one[p + shift] for p in piece if a.slot[p]}
            for known, covered in minds:
                if piece <= covered:
                    break
                if all(known.get(k, v) == v for k, v in values.items()):
                    known.update(values)
                    covered |= piece
                    break
            else:
                known, covered = values, set(piece)
                minds.append((known, covered))
            if len(covered) >= least and sum(not a.sure[p] for p in covered) >= min(least_words, words):
                return True
    return False
