"""Plain versions of the text operators, for comparison on small tables."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) >= size:
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def near(rows, size, percent):
    """n and component of each row, from all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return [(rows[i][0], len(sets[i]), rows[i][0] if not sets[i] else min((d for d in least[find(i)] if d is not None), default=None)) for i in range(len(rows))]


def quality(text):
    w = WORD.findall(text or "")
    runs = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def pii(text):
    def fine(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, text or "") if fine(k, m.group())]


SHAPES = {
    "email": r"^[^@]+@[^@]+$", "ip": r"^(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}$|^[0-9]{1,3}(?:[.\-][0-9]{1,3}){3}$",
    "card": r"^[0-9][0-9-]{6,22}[0-9]$", "phone": r"^\(?[0-9][0-9().\-/]{5,18}[0-9]$",
}


def pii_graph(rows, min_seeds=4, least=0.7, trust=0.5, settled=1e-4):
    """(number of the row, kind, start, end) of the spans that contexts add, by plain loops."""
    seeds, loose = [], []  # (pattern, m, kind) and (pattern, m, row, start, end)
    for i, (_, text) in enumerate(rows):
        text = text or ""

        def around(a, b, text=text):
            left, right = (re.sub("[0-9]", "9", x.lower()).split() for x in (text[:a], text[b:]))
            return [
                *([f"before {left[-2]} {left[-1]}"] if len(left) > 1 else []), *([f"around {left[-1]} {right[0]}"] if left and right else []),
                *([f"after {right[0]} {right[1]}"] if len(right) > 1 else []),
            ]

        spans = pii(text)
        seeds += [(p, text[a:b].lower(), k) for k, a, b in spans for p in around(a, b)]
        for m in re.finditer(r"[^ \t-\r]*[0-9@][^ \t-\r]*", text):
            core = re.sub("[^0-9A-Za-z]+$", "", re.sub("^[^0-9A-Za-z(]+", "", m.group()))
            a = m.end() - len(re.sub("^[^0-9A-Za-z(]+", "", m.group()))
            if core and not any(s < a + len(core) and e > a for _, s, e in spans):
                loose += [(p, core.lower(), i, a, a + len(core)) for p in around(a, a + len(core))]
    distinct = defaultdict(set)
    for p, m, _ in seeds:
        distinct[p].add(m)
    used = {p for p, s in distinct.items() if len(s) >= min_seeds}
    kind_of = {}  # (pattern, m) -> kind
    for p, m, k in seeds:
        kind_of[p, m] = max(k, kind_of.get((p, m), k))
    n = Counter([(p, m) for p, m, _ in seeds if p in used] + [(p, m) for p, m, *_ in loose if p in used])
    total, own, count = Counter(), Counter(), Counter()
    known = defaultdict(set)
    for (p, m), c in n.items():
        total[p] += c
        if (p, m) in kind_of:
            own[p, kind_of[p, m]] += c
            count[p, kind_of[p, m]] += 1
            known[m].add(kind_of[p, m])
    free = {}
    for (p, m), c in n.items():
        if (p, m) not in kind_of:
            if m in known:
                for k in known[m]:
                    own[p, k] += c
            else:
                free[p, m] = c
    score = {key: own[key] / total[key[0]] for key in own}
    while True:
        hits = Counter()
        for (p, m), c in free.items():
            best = defaultdict(float)
            for (q, k), v in score.items():
                if q != p and (q, m) in free and q.split()[0] == p.split()[0]:
                    best[k] = max(best[k], v)
            for k, v in best.items():
                hits[p, k] += c * trust * v
        new = {key: (own[key] + hits[key]) / total[key[0]] for key in {*own, *hits}}
        change = max((v - score.get(key, 0) for key, v in new.items()), default=0)
        score = new
        if change <= settled:
            break
    found = {}
    for p, m, i, a, b in loose:
        for k in PII:
            if p in used and score.get((p, k), 0) >= least and count[p, k] >= min_seeds and re.match(SHAPES[k], m):
                found[i, a, b] = max(found.get((i, a, b), (0, "")), (score[p, k], k))
    return sorted((i, k, a, b) for (i, a, b), (_, k) in found.items())
