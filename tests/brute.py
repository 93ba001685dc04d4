"""Plain Python versions of the graph search, for small inputs."""

from collections import Counter, defaultdict


def edges(seqs, k, both=False):
    out = Counter()
    for s in seqs:
        for t in (s, s[::-1].translate(str.maketrans("ACGT", "TGCA"))) if both else (s,):
            for i in range(len(t) - k):
                w = t[i : i + k + 1]
                if set(w) <= set("ACGT"):
                    out[w] += 1
    return out


def starts(mults, k, least_mult=20, least_in=2):
    arriving = Counter(e[1:] for e in mults)
    return {e for e, m in mults.items() if m >= least_mult and arriving[e[:k]] >= least_in and e[:k] != e[1:]}


def cycles(mults, start, k, low, high, ratio):
    """Simple cycles through start as tuples of edges, by depth-first search."""
    leaving = defaultdict(list)
    for e in mults:
        leaving[e[:k]].append(e)
    found, stack = set(), [(start,)]
    while stack:
        path = stack.pop()
        for e in leaving[path[-1][1:]]:
            if e == start:
                if low <= len(path) <= high:
                    found.add(path)
            elif len(path) < high and e not in path and mults[start] // mults[e] <= ratio:
                stack.append((*path, e))
    return found
