"""Plain versions that several tests compare with."""

import hashlib
from collections import defaultdict

WS = " \t\n\v\f\r"
SYLLABLES = {"en": "the and ing ed er on th re at or wh".split(), "de": "der und sch ung keit ver ein zu ge ß ü".split(), "fr": "le la eau que tion é è oi ou ai re".split()}


def split(text):
    out, word = [], ""
    for c in text or "":
        if c in WS:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def sets(text):
    words = split((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    s = [sets(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                label[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(d, len(s[i]), least[root(i)] if s[i] else d) for i, (d, _) in enumerate(rows)], [root(i) for i in range(len(rows))]


def brute_substring(rows, window=20):
    """Rows are distinct (doc_id, text) pairs that may be repeated."""
    first = {}
    order = lambda d: (d is None, d or 0)
    words = [split(t) for _, t in rows]
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, ((True, 1 << 70), 0)), (order(d), i))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (order(d), i):
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def prose(rng, lang, n=80):
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))))
        if rng.random() < 0.1:
            out[-1] += ".\n"
    return " ".join(out)
