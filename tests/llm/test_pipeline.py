"""The pipeline against plain Python stages, and the registered queries that SQL can express."""

import re
from collections import Counter

import duckdb
import pytest

from scatterwave.llm import quality
from scatterwave.llm import queries as llm
from tests.llm.test_near_copies import words_set
from tests.llm.test_operators import brute_contaminated, none, odd  # noqa: F401

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def near_representatives(pairs):
    """Smallest doc_id of each component of 5-word Jaccard similarity of 0.8 or more, over all pairs."""
    sets = [(i, words_set(t)) for i, t in pairs]
    low = {i: i for i, _ in pairs}

    def root(i):
        return i if low[i] == i else root(low[i])

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                low[max(root(i), root(j))] = min(root(i), root(j))
    return {i for i, _ in pairs if root(i) == i}


def test_pipeline(spark):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = quality.digest(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").select("doc_id")
    left = docs.join(good, "doc_id").toPandas().sort_values("doc_id")
    left = left[~left["text"].duplicated(keep="last")]
    stays = near_representatives(list(zip(left["doc_id"], left["text"])))
    left = left[left["doc_id"].isin(stays)]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    words = lambda t: set(re.split(r"[\W_]+", t.lower()))
    pairs = [(i, t) for i, t in zip(left["doc_id"], left["text"])]
    dirty = {i for i, t in pairs for k in brute_contaminated([(i, t)], [x for x in zip(items["item_id"], items["text"]) if len(words(x[1]) & words(t)) >= 0.5 * len(words(x[1]))])}
    want = sorted(i for i, _ in pairs if i not in dirty)
    out = pipeline.run(spark, SF).toPandas()
    assert sorted(out["doc_id"]) == want and not out.duplicated(["bucket", "batch", "slot"]).any()


def test_stages_over_odd_rows(spark, odd, none, tmp_path):  # noqa: F811
    """Each stage on nulls, repeated rows, clashing columns and an empty table: what goes is stated, the rest stays whole."""
    docs, pairs = odd
    copy, near = pairs[0][1], pairs[4][1]
    spark.createDataFrame([(1, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, near), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = Counter(pairs)
    kept = {
        "quality": rows,  # one row alone is learnt from, and it is good
        "exact_dedup": Counter([(10, copy), (4, None), *[p for p in pairs if pairs.index(p) in (4, 5, 6, 7, 8, 12, 13)]]),
        "near_dedup": rows - Counter([(2, copy), (10, copy), (10, copy), (4, None), (6, near + " tail"), (7, "  \n\t ")]),
        "decontamination": rows - Counter([(5, near), (6, near + " tail")]),
    }
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = Counter((r["doc_id"], r["text"]) for r in out.collect())
        assert name == "quality" and set(got) <= set(rows) or got == kept[name], name
        assert stage(spark, none, str(tmp_path)).count() == 0
    assert dict(pipeline.STAGES)["packing"](spark, docs, str(tmp_path)).count() == len(pairs)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    a, b = llm.queries()[name](spark, SF).toPandas(), con.execute(llm.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    a, b = (x[cols].sort_values(cols, ignore_index=True) for x in (a, b))
    assert len(a) == len(b) and all((a[c] == b[c]).all() for c in cols)


def test_every_operator_is_registered():
    names = list(llm.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
