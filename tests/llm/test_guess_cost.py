"""The guess cost against all segmentations, its time on long values, and the order of spans."""

import math
import random
import time
from functools import lru_cache

import pytest

from scatterwave.llm import secrets
from scatterwave.llm.queries import tokenizer_path
from tests.llm.test_operators import frame, none  # noqa: F401

RANKS = secrets.word_ranks(["password", "pass", "word", "abc", "cab", "sea"])


def segment_bits(value, i, j):
    """Least bits of value[i:j] as one segment, by the definition of each kind."""
    part, low = value[i:j], value[i:j].lower()
    each, n, out = math.log2(secrets.alphabet(value)), j - i, [math.inf]
    if n == 1:
        out.append(min(each, 3.0) if part in "._-/" else each)
    for form in (low, low.translate(secrets._LEET)):
        if RANKS.get(form):
            out.append(secrets.word_bits(RANKS[form], part))
    out += [bits + 1 for form, bits in secrets.DATES if (m := form.match(value.lower(), i)) and m[1] == low]
    for u in range(1, 5):
        if n >= max(3, 2 * u) and n % u == 0 and low == low[:u] * (n // u):
            out.append(u * each + 5)
    steps = {ord(b) - ord(a) for a, b in zip(low, low[1:])}
    if n >= 3 and low.isalnum() and steps in ({1}, {-1}):
        out.append(11.0)
    walk = [secrets.walk_step(a, b) for a, b in zip(part, part[1:])]
    if n >= 3 and None not in walk:
        out.append(10.0 + sum(walk))
    return min(out)


def plain_bits(value):
    @lru_cache(None)
    def best(j):
        return 0.0 if j == 0 else min(best(i) + segment_bits(value, i, j) for i in range(j))

    return best(len(value))


def test_least_over_all_segmentations():
    rng = random.Random(3)
    parts = ["password", "Pass", "p4ss", "WORD", "qwer", "QWe", "zaq", "1999", "20240131", "31-12-2023", "may2020", "05jun1999", "aaaa", "abab", "xyzxyz", "abcd", "321", "k", "9", "_", "-", "#", "T", "tyu"]
    for _ in range(600):
        value = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 5)))
        assert secrets.guess_bits(value, RANKS) == pytest.approx(plain_bits(value)), value


@pytest.mark.parametrize("unit", ["a", "ab12", "1234567890", "qwer"])
def test_long_values_take_linear_time(unit):
    took = []
    for n in (100_000, 1_000_000):
        began = time.process_time()
        secrets.guess_bits((unit * n)[:n])
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] and took[1] < 15


def test_plain_words_are_no_secrets():
    ranks = secrets.word_ranks([*secrets.WORDS, *secrets.vocabulary_words(tokenizer_path())])
    text = "secret: documentation page, password: authentication_required; bearer: responsibilities; the token is understanding."
    assert secrets.guessed_spans(text, ranks=ranks) == []
    assert len(secrets.guessed_spans("pwd=aX7kQ2mZ", ranks=ranks)) == 1


def test_corpus_words(spark, none):  # noqa: F811
    texts = [(i, "Quxolimar ventatoro; the password is hgfqwzzkrtm and secret: wqkzzjhvbx") for i in range(4)] + [(9, None), (10, ""), (11, "lonely")]
    assert set(secrets.corpus_words(frame(spark, texts))) == {"quxolimar", "ventatoro", "the", "and"}
    assert secrets.corpus_words(none) == []


def test_spans_that_start_together_stand_by_kind(spark, none):  # noqa: F811
    key = "deadbeef" * 3 + "/x9K2mQ7vL4pT8wZr"
    rows = secrets.scan(frame(spark, [(1, "auth: password=x9K2mQ7vL4pT8wZr. end"), (1, f"bearer {key}")])).collect()
    assert [r["spans"] for r in sorted(rows, key=lambda r: r["spans"])] == ["assign:6:32,guess:6:31", "hex:7:31,guess:7:48"]
    assert secrets.scan(none).count() == 0
