"""Small corpora, and operators by brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text, n=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def prose(rng, n, vocabulary=500):
    return " ".join("".join(rng.choice("abdeilmnorstu") for _ in range(1 + (k * 7919) % 7)) + str(k) for k in (rng.randrange(vocabulary) for _ in range(n)))


def corpus(seed=1):
    """Texts with exact and near copies, shared passages, a long text, odd white space, nulls and empties."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    texts = [None, "", "  \n", "one", "one two three four", "one two three four", passage, prose(rng, 40) + " x y " + passage]
    for _ in range(25):
        t = prose(rng, rng.randint(5, 150))
        texts.append(t)
        if rng.random() < 0.3:
            texts.append(t)
        for _ in range(rng.choice([0, 0, 1, 4])):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append("  ".join(w))
    texts += [prose(rng, 20) + "\n" + passage + "\t" + prose(rng, 20) for _ in range(8)]
    texts += ["é ñ 日本 " * 30, "é ñ 日本 " * 30, prose(rng, 9000)]
    return texts


def frame(spark, texts, parts=3):
    rows = [(k, t, "en", f"s{k % 4}" if k % 7 else None, len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)


def components(n, links):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def near(texts, threshold=0.8):
    """(class_id, n_links, group_id) of each text."""
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]
    n, group = Counter(x for p in links for x in p), components(len(sets), links)
    first: dict = {}
    return [(first.setdefault(s, i) if s else i, n[i], group[i]) for i, s in enumerate(sets)]
