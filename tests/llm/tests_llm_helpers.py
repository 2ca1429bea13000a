"""Texts in families of edited, extended, shortened and reordered versions."""

import random


def versions(seed, families, size, vocabulary=4000):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    out = []
    for _ in range(families):
        base = [word() for _ in range(60)]
        for _ in range(size):
            v = list(base)
            for _ in range(rng.randrange(7)):
                v[rng.randrange(len(v))] = word()
            if rng.random() < 0.3:
                v = v[30:] + v[:30]
            if rng.random() < 0.3:
                v += [word() for _ in range(4)]
            out.append(" ".join(v).title() + ".")
    return out
