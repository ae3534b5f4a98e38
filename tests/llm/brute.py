"""Plain versions of the operators' contracts, row by row."""

import random
import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return SPACE_WORD.findall(text or "")


def alnum(text):
    return ALNUM_WORD.findall(fold(text))


def shingles(text):
    w = words(fold(text))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


class Union:
    def __init__(self, items):
        self.parent = {i: i for i in items}

    def find(self, i):
        while self.parent[i] != i:
            i = self.parent[i]
        return i

    def join(self, i, j):
        a, b = self.find(i), self.find(j)
        self.parent[max(a, b)] = min(a, b)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


VOCABULARY = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def prose(rng, n, names=VOCABULARY):
    return " ".join(rng.choice(names) for _ in range(n))


def changed(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = "new%d" % rng.randrange(10**6)
    return " ".join(w)


def seeded(k):
    return random.Random(k)


ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "é ñ 漢字 \U0001f600 a"), (905, "a\x0b b\x1cc\xa0d"), (906, "same words twice"), (907, "same words twice"), (None, "no id at all"), (None, None)]
