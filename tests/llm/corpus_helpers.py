"""What the tests of the corpus operators share."""

import random


def prose(seed, words, letters="etaoinshrdlu"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(words))


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
