"""The pipeline's near stage against all pairs compared."""

import random

import corpus_pipeline as pipeline
from scatterwave.llm import near_copies
from tests.llm.test_operators import frame, none, prose  # noqa: F401


def words_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_stage_drops_edited_copies(spark, none, monkeypatch):  # noqa: F811
    rng = random.Random(21)
    notice = prose(12, rng)  # a frequent passage
    pairs = [(0, None), (1, ""), (2, " \n"), (3, "a b"), (4, "A  B"), (5, "a b c")]
    for i in range(40):
        w = prose(rng.choice([6, 20, 60, 300]), rng).split()
        pairs.append((10 + 4 * i, " ".join(w) + " " + notice))
        for j in range(1, 4):
            for _ in range(rng.choice([1, 1, 2, 4]) * len(w) // 60 + 1):
                w[rng.randrange(len(w))] = "edit"
            pairs.append((10 + 4 * i + j, " ".join(w) + " " + notice))
    low = {i: i for i, _ in pairs}

    def root(i):
        return i if low[i] == i else root(low[i])

    sets = [(i, words_set(t)) for i, t in pairs]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if len(a & b) >= 0.8 * len(a | b) and root(i) != root(j):
                low[max(root(i), root(j))] = min(root(i), root(j))
    want = sorted(i for i, _ in pairs if root(i) == i)
    docs = frame(spark, [*pairs, (None, pairs[6][1])])
    for slots, chunk in ((2**17, 2_048), (8, 4)):  # the second: hardly any order, and blocks in many chunks
        monkeypatch.setattr(near_copies.near_classes, "__defaults__", (0.8, 5, 19, chunk, slots))
        out = pipeline.near_stage(spark, docs, "")
        assert out.columns == docs.columns
        assert sorted(r["doc_id"] for r in out.select("doc_id").collect() if r["doc_id"] is not None) == want
    assert 40 < len(want) < 140 and out.filter("doc_id IS NULL").count() == 1
    assert near_copies.keep_representatives(none).count() == 0
