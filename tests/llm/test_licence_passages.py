"""Licence passages longer or shorter than their template, against every passage tried."""

import random
from collections import Counter

import pytest

from scatterwave.llm import licences
from tests.llm.test_operators import WORDS, prose

GPL = licences.TEMPLATES["GPL-3.0"][1].split()


@pytest.mark.parametrize(
    "text, licence",
    [
        ("This work is licensed under the terms of the GNU General Public License, version 3.", "GPL-3.0"),
        ("Licensed under the Apache Software License, Version 2.0.", "Apache-2.0"),
        (" ".join([*GPL[:20], *"which you will find beside it in this folder".split(), *GPL[20:]]), "GPL-3.0"),
    ],
)
def test_words_put_in(text, licence):
    found = licences.Matcher().passages(f"alpha beta gamma {text} delta omega")
    assert [m[0] for m in found] == [licence]


def test_every_size_is_tried():
    rng = random.Random(12)
    hits = 0
    for _ in range(60):
        template = " ".join(rng.choice(WORDS) for _ in range(rng.choice([4, 9, 16])))
        matcher = licences.Matcher({"A": (template,)})
        w = template.split()
        for _ in range(rng.randrange(0, 3)):
            w.insert(rng.randrange(len(w)), rng.choice(WORDS))
        text = " ".join([prose(rng.randrange(5), rng), *w, prose(rng.randrange(5), rng), *template.split()[rng.randrange(3) :]])
        words = licences.normalise(text)
        pairs, t = list(zip(words, words[1:])), matcher.templates[0]
        every = []
        for a in range(len(pairs)):
            for b in range(a + 1, len(pairs) + 1):
                dice = 2 * sum((Counter(pairs[a:b]) & t.bigrams).values()) / (t.size - 1 + b - a)
                if dice >= 0.8:
                    every.append((-dice, a, b + 1))
        want = []
        for d, a, b in sorted(every):
            if all(b <= x or y <= a for _, x, y, _ in want):
                want.append(("A", a, b, -d))
        assert matcher.passages(text) == sorted(want, key=lambda m: m[1])
        hits += len(want)
    assert hits > 60


def test_a_statement_cut_off(spark):
    text = "alpha beta This work is licensed under the GNU General Public License gamma delta"
    assert [(m[0], m[1], m[2]) for m in licences.Matcher().passages(text)] == [("GPL-3.0", 2, 12)]
