"""Documents with fewer words than a benchmark item."""

import random

import pytest

from scatterwave.llm import decontaminate
from tests.llm.test_operators import frame, prose


@pytest.mark.parametrize("limit", [500_000, 0])
def test_documents_shorter_than_an_item(spark, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", limit)
    rng = random.Random(8)
    long, short, four = prose(59, rng).split(), prose(15, rng).split(), prose(4, rng).split()
    docs = [(1, long[:56]), (2, short[:14]), (3, short[1:]), (4, long[:40]), (5, long[7:]), (6, long[:25] + ["x"] + long[26:58]), (7, four[:3]), (8, long[3:] + ["y", "z"])]
    docs = frame(spark, [(i, " ".join(w)) for i, w in docs])
    items = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short)), (3, " ".join(four))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["similarity"]) for r in decontaminate.contaminated(docs, items).collect()}
    # Shared shingles over those of either side: 52 of 55, 10 of 11, 48 of 55, and 49 of 55 + 54 - 49; 8 shares 52 of 55 + 54 - 52.
    want = {(1, 1): 52 / 55, (2, 2): 10 / 11, (3, 2): 10 / 11, (5, 1): 48 / 55, (6, 1): 49 / 60, (8, 1): 52 / 57}
    assert set(got) == set(want) and all(got[k] == (0, pytest.approx(want[k])) for k in want)
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(docs, items).collect()) == [4, 7]
