"""Language identification against a plain version of its definition, and tokenizers that must not be fed piece by piece."""

import json
import math
from collections import Counter

import numpy as np
import pytest

from scatterwave.llm import language, token_records
from scatterwave.llm.common import held_out
from scatterwave.llm.queries import tokenizer_path
from tests.llm.test_operators import none, odd, prose  # noqa: F401

SF = "/root/testdata/sf0.001"


def plain_counts(text):
    """Hashed 1- to 3-grams of letters, word boundaries as zeros, one after the other."""
    out, word = Counter(), []
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word.append(ord(c))
            continue
        line = [0, *word, 0]
        for i in range(1, len(line) - 1):
            a, b, d = line[i - 1 : i + 2]
            for h in (b * 2654435761, (a * 31 + b + 7) * 2246822519, ((a * 31 + b) * 31 + d + 13) * 3266489917):
                out[((h + 2**63) % 2**64 - 2**63) >> 15 & (language.SLOTS - 1)] += 1
        word = []
    return out


@pytest.mark.parametrize("text", ["", None, " 12 ", "a", "Äpfel und Birnen, 3 Stück", "ΟΔΟΣ ΣΑΣ", "don't", "x" * 50 + " y", "日本 語"])
def test_ngrams(text):
    got = language.ngram_counts(text)
    want = plain_counts(text)
    assert (got is None) == (not want) and (got is None or {i: int(n) for i, n in enumerate(got) if n} == dict(want))


def test_long_texts_go_by_pieces(monkeypatch):
    text = "\n".join([prose(30), "ΟΔΟΣ", "Straße", "12,5"] * 40)
    whole = language.ngram_counts(text)
    monkeypatch.setattr(language, "PIECE", 50)
    assert len(list(language._pieces(text))) > 50 and (language.ngram_counts(text) == whole).all()


def test_nearest_centroid_against_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs)
    rows = docs.select("doc_id", "text", "lang", held_out(docs["doc_id"]).alias("out")).toPandas()
    learnt = rows[~rows["out"] & rows["lang"].notna()]
    texts = [plain_counts(t) for t in learnt["text"]]
    n = sum(bool(c) for c in texts)
    seen = Counter(s for c in texts for s in c)
    assert all(model.idf[s] == pytest.approx(math.log((1 + n) / (1 + seen[s])) + 1, rel=1e-5) for s in range(0, language.SLOTS, 37))
    assert set(model.languages) == set(learnt["lang"]) and Counter(model.languages).most_common(1)[0][1] <= language.CENTROIDS
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    got = {r["doc_id"]: r for r in language.identify(docs, model, reject=False).collect()}
    for r in rows.iloc[:60].itertuples():
        weights = {s: math.log1p(c) * float(model.idf[s]) for s, c in plain_counts(r.text).items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        cosines = [sum(w * float(c[s]) for s, w in weights.items()) / norm for c in model.centroids] if norm else []
        if not cosines:
            assert got[r.doc_id]["lang_pred"] == "und"
            continue
        best = max(range(len(cosines)), key=lambda k: cosines[k])
        assert got[r.doc_id]["score"] == pytest.approx(cosines[best], abs=1e-4)
        assert got[r.doc_id]["lang_pred"] == model.languages[best]
        assert got[r.doc_id]["rejected"] == all(c < l for c, l in zip(cosines, model.limits))


def test_other_tokenizers_get_whole_texts(tmp_path):
    from tokenizers import Tokenizer

    rules = json.load(open(tokenizer_path()))
    assert token_records.Encoder(tokenizer_path(), "<u2").piecewise
    rules["normalizer"] = None  # capitals are kept, so texts must not be lower-cased first
    path = str(tmp_path / "other.json")
    json.dump(rules, open(path, "w"))
    encode, plain = token_records.Encoder(path, "<u2"), Tokenizer.from_file(path)
    assert not encode.piecewise
    texts = ["Hello World. And THE rest\n", "", "a <|endoftext|> b"]
    assert encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
