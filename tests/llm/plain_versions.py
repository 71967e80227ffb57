"""Plain versions of the pipeline's decisions."""

from collections import Counter


def lines_after(docs):
    """(id, text) after removal of lines alike an earlier one (Jaccard 0.8 of words); documents that lose all their words go."""
    seen, by_word, out = [], {}, []
    for i, t in docs:
        kept, lost, left = [], 0, 0
        for line in t.split("\n"):
            s = frozenset(line.encode().lower().split())
            if not s:
                kept.append(line)
                continue
            near = Counter(k for w in s for k in by_word.get(w, ()))
            if any(10 * c >= 8 * (len(s) + len(seen[k]) - c) for k, c in near.items()):
                lost += 1
            else:
                kept.append(line)
                left += 1
            for w in s:
                by_word.setdefault(w, []).append(len(seen))
            seen.append(s)
        if not lost or left:
            out.append((i, "\n".join(kept)))
    return sorted(out)


def near_components(docs):
    """id -> least id of its component (80 of 100 five-word shingles)."""
    sets = {}
    for i, t in docs:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    by, up = {}, {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        for j, c in Counter(j for g in s for j in by[g] if j < i).items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in sets}


def contaminated(docs, items):
    """ids of documents with a window of an item's size at weighted similarity 0.8 of five-word shingles."""

    def grams(w):
        return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])

    words = [t.lower().split() for t in items]
    seeds = {}
    for k, w in enumerate(words):
        for g in grams(w):
            seeds.setdefault(g, set()).add(k)
    bad = set()
    for i, t in docs:
        w = t.lower().split()
        for k in {k for g in grams(w) for k in seeds.get(g, ())} if w else ():
            own = grams(words[k])
            for s in range(max(1, len(w) - len(words[k]) + 1)):
                g = grams(w[s : s + len(words[k])])
                if sum((g & own).values()) >= 0.8 * sum((g | own).values()):
                    bad.add(i)
                    break
    return bad
