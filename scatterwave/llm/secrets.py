"""Secret scans: fixed patterns, and values in a credential's context that would cost many guesses.

The guess cost of a value is the least total, in bits, over all ways to cut it into words, dates, repeats, runs of
neighbouring characters, keyboard walks and brute-force spans, found by dynamic programming in time linear in its length.
Words are ranked: a few fixed ones that guessers try first, then a public tokenizer's whole words, then those that
many documents of the corpus hold.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterwave.llm.common import arrow_map, whole_text
from scatterwave.runtime import ship

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Words before a value that make it a credential; longer ones first.
CONTEXT = re.compile(
    r"""(?ai)(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|(?:bearer|basic)(?=["']?[ \t]*(?:[:=]|\bis\b))|(?:api|access|private|secret)[ _-]?key)["']?[ \t]*(?::=|={1,3}>?|:|\bis\b)[ \t]*["'`]?(?:(?:bearer|basic|token)[ \t]+)?["'`]?([!-~]{8,})"""
    r"""|(?ai:\b(?:bearer|basic)[ \t]+)["'`]?([!-~]{8,})"""
)
CONTEXT_KEYS = ("pass", "pwd", "secret", "token", "credential", "auth", "bearer", "basic", "key")
#: Bits at which a value counts as a secret; eight random letters and digits have 47.6.
MIN_BITS = 45.0
#: Words that guessers try first, most tried first.
WORDS = (
    "password pass admin root user login welcome master secret token test guest default changeme letmein qwerty dragon monkey football baseball "
    "sunshine princess shadow superman batman trustno love hello freedom whatever michael jordan hunter ranger summer winter spring autumn "
    "computer internet server system backup oracle database example sample demo dummy your mykey key value string null none true false "
    "access private public client api auth user name company service account prod production staging local host word"
).split()
#: Corpus words: those in at least so many documents, and the most of them that are kept, by documents.
LEAST_DOCS, MOST_WORDS = 3, 50_000
#: Rows of a keyboard, the same with shift, and the usual replacements of letters.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = ("~!@#$%^&*()_+", "QWERTYUIOP{}|", 'ASDFGHJKL:"', "ZXCVBNM<>?")
_KEY = {c: (r, i) for rows in (ROWS, SHIFTED) for r, row in enumerate(rows) for i, c in enumerate(row)}
_SHIFTED = set("".join(SHIFTED))
_LEET = str.maketrans("4301$5@7", "aeolssat")
_MONTHS = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_DAY, _MONTH, _YEAR = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])", "(?:19|20)[0-9][0-9]"
#: Forms of dates in lower case, and their bits: 120 years, the days of those, the months of those.
DATES = tuple((re.compile(f"(?=({form}))"), math.log2(n)) for form, n in (
    (f"{_YEAR}([-/.]?){_MONTH}\\2{_DAY}", 365 * 120), (f"{_DAY}([-/.]?){_MONTH}\\2{_YEAR}", 365 * 120), (f"{_MONTH}([-/.]?){_DAY}\\2{_YEAR}", 365 * 120),
    (f"{_DAY}([-/.]?){_MONTHS}\\2{_YEAR}", 365 * 120), (f"{_MONTHS}([-/.]?){_YEAR}", 12 * 120), (_YEAR, 120),
))
#: Bits of a segment's kind, of one separator between words, of a repeat's length, of a run (start and length), of a walk
#: (first key and length), of a walk's step to another row and of a change of the shift key.
SEGMENT_BITS, SEPARATOR_BITS, REPEAT_BITS, RUN_BITS, WALK_BITS, TURN_BITS, SHIFT_BITS = 1.0, 3.0, 4.0, 10.0, 9.0, 2.0, 1.0
SEPARATORS = frozenset("._-/")
UNITS = 4  # longest unit of a repeat


def word_ranks(words) -> dict[str, int]:
    """Rank of each word of three letters or more, from 1 and in the order given, and 0 for each beginning that is no word itself."""
    ranks: dict[str, int] = {}
    for word in words:
        if len(word) >= 3 and word not in ranks:
            ranks[word] = len(ranks) + 1
    for word in list(ranks):
        for k in range(1, len(word)):
            ranks.setdefault(word[:k], 0)
    return ranks


@lru_cache(maxsize=2)
def vocabulary_words(path: str) -> tuple[str, ...]:
    """Whole words (ASCII letters, three or more) of a tokenizer file that marks word ends, most frequent first as its ids are."""
    vocabulary = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    return tuple(t[:-4] for t, _ in sorted(vocabulary.items(), key=lambda x: x[1]) if t.endswith("</w>") and re.fullmatch("[a-z]{3,}</w>", t))


def corpus_words(docs: DataFrame, least: int = LEAST_DOCS, most: int = MOST_WORDS) -> list[str]:
    """Words of 3 to 24 ASCII letters that at least ``least`` documents hold outside a credential's context, by documents.

    Counted over all whole texts by built-in functions, map-side first; the driver receives ``most`` words at most.
    """
    context = rf"""({"|".join(CONTEXT_KEYS)})[a-z]*["']?[ \t]*(:=|={{1,3}}>?|:|is\b)?[ \t]*["'`]?[!-~]{{8,}}"""
    low = docs.select(F.lower(whole_text()).alias("x"))
    named = reduce(lambda a, b: a | b, [F.contains("x", F.lit(key)) for key in CONTEXT_KEYS])  # far cheaper than the pattern
    plain = F.when(named, F.regexp_replace("x", context, " ")).otherwise(F.col("x"))
    words = F.array_distinct(F.split(plain, "[^a-z]+"))
    counted = low.select(F.explode(words).alias("w")).filter(F.length("w").between(3, 24)).groupBy("w").agg(F.count("*").alias("n"))
    return [r["w"] for r in counted.filter(F.col("n") >= least).orderBy(F.desc("n"), "w").limit(most).collect()]


RANKS = word_ranks(WORDS)


def alphabet(value: str) -> int:
    """Characters that a brute-force guesser of this value must go through."""
    if all(c in "0123456789" for c in value):
        return 10
    if all(c in "0123456789abcdef" for c in value) or all(c in "0123456789ABCDEF" for c in value):
        return 16
    sizes = ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10))
    return sum(n for test, n in sizes if any(test(c) for c in value)) + (33 if any(not c.isalnum() for c in value) else 0)


def word_bits(rank: int, shown: str) -> float:
    """Bits of a word of that rank, written as ``shown``: capitals and replaced letters cost extra."""
    letters = [c for c in shown if c.isalpha()]
    if all(c.islower() for c in letters):
        cased = 0.0
    elif all(c.isupper() for c in letters) or (letters[0].isupper() and all(c.islower() for c in letters[1:])):
        cased = 1.0
    else:
        cased = 1.0 + len(shown)
    return math.log2(rank + 1) + cased + (1.0 if len(letters) < len(shown) else 0.0) + SEGMENT_BITS


def walk_step(a: str, b: str) -> float | None:
    """Bits of a step between neighbouring keys, on a row or to the row above or below; None for any other two characters."""
    x, y = _KEY.get(a), _KEY.get(b)
    if x is None or y is None or x == y:
        return None
    (r, i), (s, j) = x, y
    if not (r == s and abs(i - j) == 1 or {r, s} in ({1, 2}, {2, 3}) and i == j):
        return None
    return (TURN_BITS if r != s else 0.0) + (SHIFT_BITS if (a in _SHIFTED) != (b in _SHIFTED) else 0.0)


def guess_bits(value: str, ranks: dict[str, int] = RANKS) -> float:
    """Least bits over all cuts of ``value`` (ASCII); zero for an empty one.

    Linear in the length. Words are followed as long as they begin one of ``ranks``. Repeats, runs and walks may
    start and end anywhere inside the longest one: for each end the cheapest start is carried along, not searched.
    """
    n = len(value)
    if not n:
        return 0.0
    low = value.lower()
    plain = low.translate(_LEET)
    each = math.log2(alphabet(value))
    inf = math.inf
    best = [0.0] + [inf] * n
    dated: dict[int, list[tuple[int, float]]] = {}
    for form, bits in DATES:
        for m in form.finditer(low):
            dated.setdefault(m.end(1), []).append((m.start(), bits + SEGMENT_BITS))
    same = [0] * (UNITS + 1)  # characters up to here that equal the one a unit before
    repeat = [[inf] * max(1, u) for u in range(UNITS + 1)]  # cheapest start, by the end's remainder
    step, run, run_from, walk, walk_from, before = 0, 1, inf, 1, inf, 0.0
    forms = (low,) if low == plain else (low, plain)
    for j in range(n + 1):
        now = best[j]
        if j:
            c = low[j - 1]
            now = min(now, best[j - 1] + (SEPARATOR_BITS if c in SEPARATORS and each > SEPARATOR_BITS else each))
            for u in range(1, UNITS + 1):
                if j <= u or low[j - 1 - u] != c:
                    same[u] = 0
                    continue
                same[u] += 1
                least = max(3, 2 * u)  # characters of the shortest repeat
                if same[u] + u >= least:
                    start = best[j - least]
                    if same[u] + u >= least + u:
                        start = min(start, repeat[u][j % u])
                    repeat[u][j % u] = start
                    now = min(now, start + u * each + REPEAT_BITS + SEGMENT_BITS)
        if j > 1:
            last = low[j - 2]
            d = ord(c) - ord(last)
            if d in (1, -1) and c.isalnum() and last.isalnum():
                run, step = run + 1 if d == step else 2, d
                if run >= 3:
                    run_from = min(best[j - 3], run_from if run > 3 else inf)
                    now = min(now, run_from + RUN_BITS + SEGMENT_BITS)
            else:
                run, step = 1, 0
            turn = walk_step(value[j - 2], value[j - 1])
            walk = 1 if turn is None else walk + 1
            if walk >= 3:
                walk_from = min(best[j - 3] + before + turn, walk_from + turn if walk > 3 else inf)
                now = min(now, walk_from + WALK_BITS + SEGMENT_BITS)
            before = turn
        for i, bits in dated.get(j, ()):
            now = min(now, best[i] + bits)
        best[j] = now
        for form in forms:  # words that start here
            k = j + 1
            while k <= n and (rank := ranks.get(form[j:k])) is not None:
                if rank and (bits := now + word_bits(rank, value[j:k])) < best[k]:
                    best[k] = bits
                k += 1
    return best[n]


def by_start(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans by start, and those that start together by kind as listed."""
    return sorted(spans, key=lambda s: (s[0], s[2]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` of the fixed patterns; each kind is matched on its own, leftmost and not overlapping."""
    out = []
    low = text.lower()
    if any(k in low for k in ASSIGN_KEYS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return by_start(out)


def guessed_spans(text: str, min_bits: float = MIN_BITS, ranks: dict[str, int] = RANKS) -> list[tuple[int, int, int]]:
    """Values in a credential's context whose least guess cost reaches ``min_bits``."""
    low = text.lower()
    if not any(k in low for k in CONTEXT_KEYS):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        k = 1 if m[1] else 2
        value = m[k].rstrip("\"'`,;.)]}>#*&%$|")
        if len(value) >= 8 and guess_bits(value, ranks) >= min_bits:
            out.append((m.start(k), m.start(k) + len(value), 3))
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, min_bits: float = MIN_BITS, words: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess``.

    ``words``: a public list, most frequent first, which stands before the corpus's own words. Null texts are empty
    and have no spans; rows that repeat an id or a text are each looked at; an empty table gives no rows. Offsets are
    code points, ends exclusive; spans that start together stand in the order of their kinds. Texts of any length are
    scanned whole, also those of one long value. Only doc_id and text are read, so other columns may have any names.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(word_ranks([*WORDS, *words, *corpus_words(docs)]))  # bounded by MOST_WORDS and the list

    def run(batch):
        rows = []
        for text in batch["text"]:
            text = text or ""
            base = base_spans(text)
            more = guessed_spans(text, min_bits, held.value)
            n = np.bincount([k for _, _, k in base + more], minlength=4) if base or more else np.zeros(4, int)
            sha = hashlib.sha256(joined(base).encode()).hexdigest()
            rows.append((int(n[0]), int(n[1]), int(n[2]), sha, joined(by_start(base + more)), int(n[3])))
        names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess")
        return {"doc_id": batch["doc_id"]} | {k: list(v) for k, v in zip(names, zip(*rows))}

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)
