"""Each operator against a plain version of its definition, and over odd inputs: nulls, empty and long texts, ties,
repeated rows, empty tables, and extra columns with clashing names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scatterwave.llm import components, decontaminate, exact_dedup, language, licences, line_dedup, packing, quality, secrets, simhash, token_records
from scatterwave.llm.queries import tokenizer_path
from scatterwave.runtime import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, fp long, h int, w int, n int, len int, bucket int, score double, gone_id long, __d long"
WORDS = "alpha beta gamma delta omega sigma kappa theta lambda zeta iota rho".split()
RNG = random.Random(5)


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, 2, 3, 4, 5, 6, 0.5, 7, 8) for i, t in pairs], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Copies, an empty and a null text (equal to each other), a repeated row, a null id, no letters, a long text."""
    copy, near = prose(80), prose(200)
    pairs = [(1, copy), (2, copy), (3, ""), (4, None), (5, near), (6, near + " tail"), (7, "  \n\t "), (8, "12 34 !!"), (9, prose(20_000)), (10, copy), (10, copy), (None, copy), (None, "lone text"), (11, "é ü\nÀ")]
    return frame(spark, pairs).cache(), pairs


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# 1 ---------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
def test_boundaries_are_optimal(histogram, k):
    lengths = sorted(histogram)
    counts = [histogram[x] for x in lengths]

    def cost(bounds):
        return sum(min(b for b in bounds if b >= x) * c for x, c in zip(lengths, counts))

    best = min(cost((*some, lengths[-1])) for r in range(k) for some in itertools.combinations(lengths[:-1], r))
    got = packing.optimal_boundaries(np.array(lengths), np.array(counts), k)
    assert len(got) <= k and got[-1] == lengths[-1] and cost(got) == best


def test_packing(spark, odd, none, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 2)
    docs, pairs = odd
    out = packing.pack(docs, buckets=3, budget=2_000).toPandas()
    assert sorted(out["n_tokens"]) == sorted(len((t or "").encode()) + 1 for _, t in pairs)
    assert (out["n_tokens"] <= out["padded_length"]).all() and not out.duplicated(["bucket", "batch", "slot"]).any()
    held = out.groupby(["bucket", "batch"]).agg(n=("slot", "size"), top=("slot", "max"), padded=("padded_length", "sum"))
    assert ((held["padded"] <= 2_000) | (held["n"] == 1)).all() and (held["top"] == held["n"] - 1).all()
    full = out.groupby("bucket").agg(rows=("slot", "size"), bound=("padded_length", "first"), batches=("batch", "nunique"))
    assert (full["batches"] == -(-full["rows"] // (2_000 // full["bound"]).clip(lower=1))).all()
    assert packing.pack(none).count() == 0


def test_boundaries_of_many_and_long_lengths():
    rng = np.random.default_rng(4)
    lengths = np.unique(rng.integers(1, 10**9, 50_000))
    bounds = packing.optimal_boundaries(lengths, rng.integers(1, 50, len(lengths)), 16)
    assert len(bounds) == 16 and bounds[-1] == lengths[-1]
    huge = packing.optimal_boundaries(np.array([5, 10**10, 10**10 + 1]), np.array([10**10, 3, 10**10]), 2)
    assert huge == [5, 10**10 + 1]


def test_packing_deals_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 10)
    out = packing.pack(spark.range(400).selectExpr("CAST(NULL AS LONG) AS doc_id", "'same' AS text"), budget=50)
    assert out.select("batch", "slot").distinct().count() == 400 and out.groupBy("batch").count().filter("count <> 10").isEmpty()


# 2 ---------------------------------------------------------------------------------------------------------------


def test_exact_dedup(odd, none):
    docs, pairs = odd
    out = exact_dedup.digest(docs).toPandas()
    assert len(out) == len(pairs)
    groups = {}
    for i, t in pairs:
        groups.setdefault(t or "", []).append(i)
    for row in out.astype(object).where(out.notna(), None).itertuples():
        own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == row.text_sha256)
        assert row.group_size == len(own)
        assert row.keep_id == max((i for i in own if i is not None), default=None)
    stay = exact_dedup.deduplicate(docs)
    assert stay.columns == docs.columns
    assert Counter(r["text"] or "" for r in stay.collect()) == Counter(groups.keys())
    assert {r["doc_id"] for r in stay.filter("text LIKE '%alpha%' OR text = ''").collect()} >= {10}
    assert exact_dedup.digest(none).count() == 0 and exact_dedup.deduplicate(none).count() == 0


@pytest.mark.parametrize("shard_slots", [65_536, 2**29])
def test_exact_dedup_shards_its_filter(spark, shard_slots):
    pairs = [(i, str(i % 40_000)) for i in range(40_100)] + [(50_000 + i, "hot") for i in range(3_000)]
    assert exact_dedup.filter_size(len(pairs), 65_536) == (16, 65_536) and exact_dedup.filter_size(10**9)[0] == 32
    out = exact_dedup.decide(spark.createDataFrame(pairs, "doc_id long, text string").repartition(7), shard_slots)
    assert out.count() == len(pairs) and out.filter("kept").count() == 40_001 and out.filter("group_size = 2").count() == 200
    assert out.filter("group_size = 3000 AND keep_id = 52999").count() == 3_000


# 3 ---------------------------------------------------------------------------------------------------------------

SF = "/root/testdata/sf0.01"


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.digest(docs, labels).toPandas()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(out["doc_id"], out["held_out"]))
    assert out["score"].between(0, 1).all() and ((out["score"] >= 0.3) == (out["predicted"] == 1)).all()
    own = out[out["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert (own["predicted"] == own["quality"]).mean() > 0.95
    assert quality.keep_good(docs, labels).count() == (out["predicted"] == 1).sum()


def test_quality_of_odd_rows(spark, odd, none):
    docs, pairs = odd
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (5, 0, 0), (6, 1, 1), (8, 0, 0), (None, 1, 0), (99, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.digest(docs, labels).toPandas()
    assert len(out) == len(pairs) and out["score"].between(0, 1).all()
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.digest(none, labels).count() == 0
    unlearnt = quality.digest(docs, labels.limit(0)).toPandas()
    assert (unlearnt["score"] == 0.5).all()


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    model = quality.Model(0.1, rng.normal(size=quality.DIMENSION).astype(np.float32) / 50, rng.normal(size=(quality.DIMENSION, quality.FACTORS)).astype(np.float32) / 50)
    at, x = quality.features(prose(20), quality.WordHash())
    pairs = sum(float(model.factors[i] @ model.factors[j]) * a * b for (i, a), (j, b) in itertools.combinations(list(zip(at, x)), 2))
    z = model.bias + float(model.weights[at] @ x) + pairs
    assert model.score([(at, x)])[0] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4)


# 4 ---------------------------------------------------------------------------------------------------------------


def test_line_dedup_equals_sql(spark):
    rng = random.Random(3)
    lines = ["Alpha", " alpha", "beta", "", "  ", "gamma gamma", "delta", "e", "long " * 25, "other " * 22, "half " * 12]
    pairs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 9)))) for i in range(160)] + [(500, None), (501, ""), (502, "\n".join(lines * 400))]
    page = [prose(rng.choice([2, 4, 6]), rng) for _ in range(60)]
    pairs += [(600 + i, "\n".join([prose(3, rng), *page[(a := rng.randrange(50)) : a + rng.randrange(1, 9)], prose(3, rng)])) for i in range(80)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    documents = pd.DataFrame(pairs, columns=["doc_id", "text"])  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(line_dedup.ORACLE_SQL).df().sort_values("doc_id", ignore_index=True)
    got = line_dedup.digest(docs).toPandas().sort_values("doc_id", ignore_index=True)
    assert want["n_removed"].sum() > 200
    for c in got.columns:
        assert (got[c] == want[c]).all(), c


def test_matches_stand_where_they_say(spark):
    rng = random.Random(8)
    page = [f"line {i} {prose(2, rng)}" for i in range(400)]
    pairs = [(1, "\n".join(page[:200])), (2, "\n\n".join(["new", *page[20:90], "}", "}", *page[100:103], "x", *page[150:152]])), (3, "\n".join(page[180:300])), (4, "\n".join([*page[250:260], *page[30:40]]))]
    full = {i: [x for x in t.split("\n") if x] for i, t in pairs}
    runs = line_dedup.matches(frame(spark, pairs)).collect()
    got = {(r["doc_id"], r["first"], r["last"], r["from_id"], r["from_first"]) for r in runs}
    assert got == {(2, 1, 70, 1, 20), (2, 73, 75, 1, 100), (3, 0, 19, 1, 180), (4, 0, 9, 3, 70), (4, 10, 19, 1, 30)}
    for d, a, b, e, c in got:
        assert full[d][a : b + 1] == full[e][c : c + b - a + 1]


def test_line_dedup_of_many_runs(spark):
    """Time linear in the runs of one document: 30,000 of them, parted by lines of its own."""
    rows = spark.range(1).selectExpr("1L AS doc_id", "array_join(transform(sequence(0, 89999), i -> concat('line ', i)), '\n') AS text").union(
        spark.range(1).selectExpr("2L", "array_join(flatten(transform(sequence(0, 29999), i -> array(concat('own ', i), concat('line ', 3 * i), concat('line ', 3 * i + 1), concat('line ', 3 * i + 2)))), '\n')")
    )
    out = {r["doc_id"]: r for r in line_dedup.digest(rows).collect()}
    assert out[1]["n_removed"] == 0 and out[2]["n_removed"] == 90_000


def test_line_dedup_of_odd_rows(odd, none):
    docs, pairs = odd
    out = line_dedup.dedup_lines(docs.withColumn("first", docs["n"]).withColumn("runs", docs["n"]))
    assert out.columns == [*[c for c in docs.columns if c != "text"], "first", "runs", "text", "n_removed"]
    assert out.count() == len(pairs) and out.filter("text IS NULL").count() == 1
    by_id = {r["doc_id"]: r for r in out.collect()}
    assert by_id[1]["n_removed"] == 1 and by_id[2]["n_removed"] == 1 and by_id[9]["n_removed"] == 0  # one long line each; the null id is first
    assert line_dedup.digest(none).count() == 0


# 5 ---------------------------------------------------------------------------------------------------------------


def test_licences(spark, odd, none):
    rng = random.Random(9)
    short = {name: [t for t in ts if len(t.split()) <= 16] for name, ts in licences.TEMPLATES.items()}
    matcher = licences.Matcher({name: ts for name, ts in short.items() if ts})
    texts = [t for ts in short.values() for t in ts]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(0, 4)):
            w = rng.choice(texts).split()
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            parts += [prose(rng.randrange(0, 6), rng), " ".join(w[rng.randrange(0, 2) :])]
        words = licences.normalise(" ".join(parts))
        pairs, found = list(zip(words, words[1:])), []
        for t in matcher.templates:
            every = []
            for a in range(len(pairs)):
                for b in range(a + 1, min(len(pairs), a + 2 * t.size) + 1):
                    shared = sum((Counter(pairs[a:b]) & t.bigrams).values())
                    if 2 * shared >= 0.8 * (t.size - 1 + b - a):
                        every.append((-2 * shared / (t.size - 1 + b - a), a, b + 1, t.licence, shared))
            taken = []
            for m in sorted(every):
                if all(m[2] <= x[1] or x[2] <= m[1] for x in taken):
                    taken.append(m)
            found += taken
        want = []
        for m in sorted(found, key=lambda m: (-m[4], *m)):
            if all(m[2] <= x[1] or x[2] <= m[1] for x in want):
                want.append(m)
        assert matcher.passages(" ".join(parts)) == sorted(((m[3], m[1], m[2], -m[0]) for m in want), key=lambda m: m[1])
    docs = spark.createDataFrame([(1, "x RELEASED under the MIT licence? Released  under\nthe MIT License, y"), (1, None), (None, "Licensed under CC BY-NC 4.0."), (2, "")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["licence"]) for r in licences.scan(docs).collect()) == [(0, "CC-BY-NC-4.0"), (1, "MIT"), (1, "MIT")]
    assert licences.scan(none).count() == 0 and licences.scan(odd[0]).count() == 0


# 6 ---------------------------------------------------------------------------------------------------------------


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language.digest(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    own = out[out["held_out"]]
    assert (own["lang_pred"] == own["lang"]).mean() > 0.97 and out["score"].between(0, 1).all()


def test_language_of_odd_rows(spark, odd, none):
    docs, pairs = odd
    out = language.digest(docs).toPandas()
    assert len(out) == len(pairs)
    letters = sorted((t or "") for _, t in pairs if any(c.isalpha() for c in t or ""))
    assert (out["lang_pred"] == "en").sum() == len(letters) and (out["lang_pred"] == "und").sum() == len(pairs) - len(letters)
    assert language.digest(none).count() == 0
    model = language.learn(docs)
    far = language.identify(spark.createDataFrame([(1, "жжж щщщ")], "doc_id long, text string"), model).first()
    assert far["rejected"] and far["lang_pred"] == "und"


# 7 ---------------------------------------------------------------------------------------------------------------


def brute_contaminated(docs, items):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    cut = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    out = {}
    for i, text in docs:
        w = words(text)
        for k, item in items:
            iw = words(item)
            n = len(cut(iw))
            for s in range(len(w) - len(iw) + 1 if iw else 0):
                c = sum((Counter(cut(w[s : s + len(iw)])) & Counter(cut(iw))).values())
                sim = c / (2 * n - c)
                if sim >= 0.8 and sim > out.get((i, k), (0, 0))[1] + 1e-12:
                    out[i, k] = (s, sim)
    return out


@pytest.mark.parametrize("limit", [500_000, 0])
def test_decontamination(spark, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", limit)
    rng = random.Random(11)
    items = [(k, prose(rng.choice([3, 5, 12, 40, 55]), rng)) for k in range(12)] + [(50, None), (51, ""), (52, "one two one two one two one two")]
    docs = [(0, None), (1, ""), (2, "!!"), (2, prose(30, rng)), (3, items[12 + 2][1] + " one two")]
    for i in range(4, 60):
        w = rng.choice(items[:12])[1].split()
        for _ in range(rng.randrange(0, 2)):
            w[rng.randrange(len(w))] = "new"
        docs.append((i, f"{prose(rng.randrange(0, 20), rng)}, {'; '.join(w).upper()}. {prose(rng.randrange(0, 20), rng)}"))
    docs += [docs[10], (None, items[4][1])]
    got = decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["similarity"]) for r in got.collect()}
    want = brute_contaminated(docs, items)
    assert set(got) == set(want) and len(want) > 30
    # Windows as good as the best may lie up to an edge's shingles apart; the one that shares an alignment is reported.
    assert all(got[k][1] == pytest.approx(want[k][1]) and abs(got[k][0] - want[k][0]) <= 4 for k in want)


def test_decontamination_of_odd_rows(spark, odd, none):
    docs, pairs = odd
    items = spark.createDataFrame([(1, pairs[0][1]), (None, pairs[4][1])], "item_id long, text string")
    clean = decontaminate.keep_clean(docs, items)
    assert clean.columns == docs.columns
    dirty = (pairs[0][1], pairs[4][1], pairs[5][1])  # (None, "lone text") stays: each row is judged by its own text
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == Counter((i, t) for i, t in pairs if t not in dirty)
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_counters_of_long_items(spark):
    rows = spark.range(40_000).selectExpr("1 AS k", "IF(id % 3 = 0, id, -1 - id % 4) AS h")
    assert decontaminate._simhash(rows, ["k"], 32).first()["fp"] < 0
    few = spark.range(900).selectExpr("id % 5 AS k", "xxhash64(id) AS h")
    assert sorted(decontaminate._simhash(few, ["k"]).collect()) == sorted(decontaminate._simhash(few, ["k"], 32).collect())


def test_blocks_cover_the_radius():
    assert sum(decontaminate.BLOCKS) == 64 and len(decontaminate.BLOCKS) * (decontaminate.RADIUS // len(decontaminate.BLOCKS) + 1) > decontaminate.RADIUS


# 8 ---------------------------------------------------------------------------------------------------------------


def test_token_records(spark, odd, none):
    from tokenizers import Tokenizer

    docs, pairs = odd
    t = Tokenizer.from_file(tokenizer_path())
    ids = {(i, x): t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in pairs}
    manifest = token_records.write_records(docs, tokenizer_path(), scratch_path(spark, "t"), 3)
    back = [r for path in manifest["path"] for r in token_records.read_records(path)]
    assert sorted(-1 if i is None else i for i, _ in back) == [-1 if i is None else i for i, _ in back]
    assert sorted((i or -1, tuple(map(int, x))) for i, x in back) == sorted((i or -1, tuple(x)) for (i, t), x in ids.items() for _ in range(sum(p == (i, t) for p in pairs)))
    out = token_records.digest_records(spark, manifest).toPandas().sort_values("start", ignore_index=True)
    assert out["start"].tolist() == [0, *out["n_tokens"].cumsum()[:-1]]
    assert out["ids_crc32"].tolist() == [zlib.crc32(x.astype("<u4").tobytes()) for _, x in back]
    path = manifest["path"].iloc[-1]
    shuffled = list(token_records.read_records(path, order=range(len(token_records.read_index(path)) - 1, -1, -1)))
    assert len(shuffled) == manifest["docs"].iloc[-1]
    assert token_records.digest(none, tokenizer_path()).count() == 0


def test_damage_is_found(spark, tmp_path):
    manifest = token_records.write_records(frame(spark, [(1, prose(50))]), tokenizer_path(), str(tmp_path), 1)
    path = manifest["path"].iloc[0]
    raw = bytearray(open(path + ".bin", "rb").read())
    raw[40] ^= 1
    open(path + ".bin", "wb").write(raw)
    with pytest.raises(ValueError):
        list(token_records.read_records(path))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", "É", ".", ",", " ", "\n", "'s", "5", "İ", "ß", "́", "ṯ", "K", "İ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "Σ", "\x85", "\xa0", ". ", "!", "word, "]), max_size=14))
def test_pieces_encode_like_whole_texts(parts):
    e, text = token_records.encoder(tokenizer_path(), "<u2"), "".join(parts)
    assert np.frombuffer(e([text])[0], "<u2").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_the_cache_forgets(monkeypatch):
    monkeypatch.setattr(token_records, "CACHE_PIECES", 50)
    e = token_records.Encoder(tokenizer_path(), "<u2")
    texts = [prose(10) for _ in range(400)]
    assert [np.frombuffer(b, "<u2").tolist() for b in e(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("marks", [0, 3])
def test_pieces_parted_by_marks(monkeypatch, marks):
    monkeypatch.setattr(token_records, "GROUP", 7)
    monkeypatch.setattr(token_records, "CHUNK_CHARS", 900)
    e = token_records.Encoder(tokenizer_path(), "<u2")
    texts = [prose(60) for _ in range(30)] + ["", " ", "~ a~b ~~ \uff5e"] * marks + ["<|endoftext|> x", "İi ß Σς"]
    assert [np.frombuffer(b, "<u2").tolist() for b in e(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


# 9 ---------------------------------------------------------------------------------------------------------------


def brute_components(ids, fps):
    fps = np.array(fps, np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    label = np.array(ids)
    while True:
        new = np.array([label[row].min() for row in near])
        new = np.array([new[np.array(ids) == i].min() for i in ids])
        if (new == label).all():
            return label
        label = new


def test_fingerprint_definition():
    for text in ("", None, " \t\n", "One", "A b", "a B c d a b c", prose(300), "É\xa0x y z"):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        import xxhash

        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        assert simhash.simhash(simhash.shingle_hashes(text)) == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 80))
def test_tree_finds_every_link(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 6, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (n, 2), dtype=np.uint64)
    fps = np.unique(base[rng.integers(0, 6, n)] ^ flips[:, 0] ^ flips[:, 1])
    a = {(min(x, y), max(x, y)) for p, q in simhash.tree_links(fps, fps, leaf=2) for x, y in zip(p.tolist(), q.tolist()) if x != y}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    assert a == {(x, y) for x, y in zip(*map(np.ndarray.tolist, np.nonzero(near))) if x < y}


@pytest.mark.parametrize("shard_rows", [8_192, 4])
def test_near_duplicates(spark, odd, none, shard_rows):
    docs, pairs = odd
    rng = random.Random(4)
    base = [prose(150, rng) for _ in range(12)]
    more = [(100 + i, " ".join(base[i % 12].split()[: 150 - (i % 3 == 0) * (i % 5)])) for i in range(120)]
    everything = pairs + more + [(100, prose(90, rng))]
    out = simhash.near_duplicates(frame(spark, everything), shard_rows=shard_rows).toPandas()
    assert len(out) == len(everything) and out.loc[out["doc_id"].isna(), "component_id"].isna().all()
    own = out[out["doc_id"].notna()].astype({"doc_id": int, "component_id": int})
    want = brute_components(own["doc_id"].tolist(), own["fp"].to_numpy(np.int64).view(np.uint64))
    assert (own["component_id"].to_numpy() == want).all() and (want != own["doc_id"]).sum() > 50
    if shard_rows > 4:
        kept = simhash.keep_representatives(docs)
        assert kept.columns == docs.columns
        assert simhash.digest(none).count() == 0 and simhash.keep_representatives(none).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(50, 51), (60, 60), (52, 51), (50, 51), (100, 70), (100, 80), (100, 90)]
    out = dict(map(tuple, components.connected_components(spark.createDataFrame(chain, "u long, v long")).collect()))
    assert all(out[i] == 1 for i in range(1, 41)) and out[52] == 50 and out[100] == 70 and out[90] == 70 and 60 not in out


# 10 --------------------------------------------------------------------------------------------------------------


def test_base_patterns():
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    rng = random.Random(2)
    parts = ["password", "TOKEN", "Api_Key", "apikey", "ſecret", "toKen", "= ", ":", '"', "'", "AKIA", "ABCD1234ABCD1234", "deadbeef" * 3, "0123456789abcdef", "abc", " ", "é", "secret: token:abcdefgh", "\n"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 12)))
        want = [(m.start(), m.end(), 0) for m in assign.finditer(text) if len(m[2]) >= 6]
        want += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert secrets.base_spans(text) == sorted(want, key=lambda x: (x[0], x[2]))


def test_guess_cost():
    bits = secrets.guess_bits
    assert bits("") == 0 and bits("password") < 10 and bits("P@ssw0rd") < 25 and bits("qwertyuiop") < 20 and bits("aaaaaaaaaaaa") < 15
    assert bits("20240131") < 20 and bits("abcdefgh") < 15 and bits("changeme2024") < 25
    assert bits("x9K2mQ7vL4pT8wZr") > 70 and bits("4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e") > 100
    assert bits("passwordx9K2mQ7v") < bits("kjhgvtybx9K2mQ7v")


def test_scan(spark, odd, none):
    docs = frame(spark, [(1, 'é password = "hunter2x" and pwd is x9K2mQ7vL4pT8wZr!'), (2, None), (3, ""), (None, "AKIA" + "A1" * 8), (4, "the password: changeme2024")])
    rows = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    assert rows[1]["n_assign"] == 1 and rows[1]["n_guess"] == 1 and rows[1]["spans"] == "assign:2:22,guess:35:52"
    assert rows[1]["base_sha256"] == hashlib.sha256(rows[1]["spans"].split(",guess")[0].encode()).hexdigest()
    assert rows[2]["base_sha256"] == rows[3]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[2]["spans"] == ""
    assert rows[None]["n_access"] == 1 and rows[4]["n_guess"] == 0 and rows[4]["n_assign"] == 1
    assert secrets.scan(odd[0]).count() == len(odd[1]) and secrets.scan(none).count() == 0
