"""Languages in blocks and by a plain reading, and texts that are not UTF-8."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from corvane.llm import common, langid, simhash


def plain_counts(text):
    raw = langid.NO_LETTERS.sub(" ", f" {text.lower()} ").encode()
    cells = Counter()
    for i in range(len(raw) - 2):
        code = raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]
        cells[(code * 2654435761 % 2**32) >> (32 - 11)] += 1
    return cells


@pytest.mark.parametrize("block", [256, 1, 3])
def test_languages_equal_a_plain_reading(spark, monkeypatch, block):
    monkeypatch.setattr(langid, "LANGUAGES", block)
    docs = common.documents(spark, SF)
    model = langid.fit_centroids(docs, common.id_remainder(F.col("doc_id"), 5) != 0)
    table = {r["lang"]: (np.frombuffer(r["centroids"]).reshape(-1, langid.DIMS), r["least"]) for r in model["table"].collect()}
    assert model["langs"] == sorted(table) and len(table) > 2
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r for r in langid.identify_languages(docs, model, reject=False).collect()}
    for d, t in texts.items():
        x = np.zeros(langid.DIMS)
        for cell, n in plain_counts(t).items():
            x[cell] = (1 + math.log(n)) * model["idf"][cell]
        x /= max(np.sqrt(x @ x), 1e-12)
        cosine = {lang: max(float(x @ c) for c in rows) for lang, (rows, _) in table.items()}
        best = max(cosine, key=lambda lang: (cosine[lang], [-ord(c) for c in lang]))
        if not any(c.isalpha() for c in t):
            assert (got[d]["lang_pred"], got[d]["score"], got[d]["rejected"]) == ("und", 0.0, True)
            continue
        assert got[d]["lang_pred"] == best and got[d]["similarity"] == pytest.approx(min(max(cosine[best], 0), 1), abs=1e-9)
        assert got[d]["score"] == pytest.approx(1 / sum(math.exp(langid.SHARPNESS * (c - cosine[best])) for c in cosine.values()), abs=1e-9)
        assert got[d]["rejected"] == (cosine[best] < table[best][1])


def test_many_languages_and_ties(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(2, 5) for _ in range(30)) for _ in range(300)]
    rows = [(i, t, f"l{i:03d}") for i, t in enumerate(texts)] + [(1000, texts[7], "a7"), (1001, texts[7], "z7")]  # three languages with one text
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_centroids(df, F.lit(True))
    assert len(model["langs"]) == 302
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify_languages(df, model).collect()}
    assert got[7] == got[1000] == got[1001] == "a7" and got[299] == "l299"
    nobody = langid.fit_centroids(df, F.lit(False))
    assert {r["lang_pred"] for r in langid.identify_languages(df, nobody).collect()} == {"und"}


@pytest.mark.parametrize("rare", [32, 1])
def test_near_duplicates_of_texts_that_are_not_utf8(spark, monkeypatch, rare):
    monkeypatch.setattr(simhash, "RARE", rare)
    rng = random.Random(4)
    word = lambda: bytes(rng.choice([0x61, 0x62, 0xFF, 0xFE, 0xE9]) for _ in range(6))
    base = [word() for _ in range(400)]
    rows = [(1, b" ".join(base)), (2, b" ".join([*base, word()])), (3, b" ".join(word() for _ in range(400))), (4, b" ".join([*base[:200], word(), *base[200:]])), (5, b"\xff"), (6, b"\xff"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).select("doc_id").collect()) == [1, 3, 5, 7]
