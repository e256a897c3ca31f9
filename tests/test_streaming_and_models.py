from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_velocity import COLUMNS, stream

from corvane.operators import distances, lookups, metrics, models, policy, sequences, text, velocity
from corvane.operators.ordered import quantiles, running
from corvane.streaming import online


def test_stream_equals_batch(spark, tmp_path):
    events = stream(160, 11)
    df = spark.createDataFrame(events, COLUMNS)
    for i, part in enumerate((events[:70], events[70:120], events[120:])):
        spark.createDataFrame(part, COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/in/{i:02d}")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = online.online_velocity(source, ["customer"]).writeStream.format("memory").queryName("vel").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    names = velocity.feature_names()
    got = {r["seq"]: [r[f] for f in names] for r in spark.table("vel").collect()}
    want = {r["seq"]: [r[f] for f in names] for r in velocity.velocity(df.where("customer is not null"), ["customer"]).collect()}
    assert got == want


def test_micro_batches_and_tallies(spark, tmp_path):
    rows = spark.createDataFrame([(i, "approve" if i % 3 else "decline") for i in range(30)], "seq long, decision string")
    rows.write.parquet(f"{tmp_path}/d")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/d")
    q = online.tally_stream(source, "tallies").start()
    q.processAllAvailable()
    q.stop()
    assert dict(spark.table("tallies").collect()) == {"approve": 20, "decline": 10}
    q = online.score_stream(source, lambda b: b.withColumn("score", F.col("seq") * 2), f"{tmp_path}/out", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 30


def scored(spark, n=600, seed=4):
    import random

    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.random() < 0.2
        rows.append((i, i, round(rng.random() + 0.4 * y, 2), y, f"c{i % 7}" if y else None))
    return spark.createDataFrame(rows, "seq long, t long, score double, fraud boolean, campaign string"), rows


def test_areas_by_pairs(spark):
    df, rows = scored(spark)
    pos, neg = [r[2] for r in rows if r[3]], [r[2] for r in rows if not r[3]]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert metrics.areas(df).first()["roc_auc"] == pytest.approx(auc, abs=1e-9)
    assert metrics.threshold_at_fpr(df.limit(50), 0.001) == float("inf")


def test_running_and_quantiles(spark):
    import numpy as np

    df, rows = scored(spark)
    s = np.array([r[2] for r in rows])
    assert quantiles(df, "score", [0.1, 0.5, 0.973]) == pytest.approx(list(np.quantile(s, [0.1, 0.5, 0.973])))
    got = {r["score"]: r["n_below"] for r in running(df, "score", {"n": F.lit(1)}, 8).collect()}
    assert got == {v: int((s < v).sum()) for v in set(s.tolist())}
    assert quantiles(df.where("false"), "score", [0.5]) == [None]


def test_distances(spark):
    df, _ = scored(spark)
    assert distances.jsd(df, df, "campaign").first()["jsd"] == 0
    a, b = df.withColumn("campaign", F.lit("x")), df.withColumn("campaign", F.lit("y"))
    assert distances.jsd(a, b, "campaign").first()["jsd"] == 1
    assert distances.ks_two_sample(df, df, "score").first()["ks"] == 0
    target = {"a": 0.5, "b": 0.3, "c": 0.2}
    assert distances.chance_divergence(spark, {"a": 1.0}, 10) == 0 and distances.chance_divergence(spark, target, 0) == float("inf")
    by_event, wider = distances.chance_divergence(spark, target, 1000), distances.chance_divergence(spark, target, 50)
    # twice n times the divergence, in nats times two, is about chi-squared with two degrees of freedom: 9.2 at 0.99
    assert 0.4 < by_event * 8 * 0.6931 * 1000 / 9.2 < 1.9 and wider > 5 * by_event
    ones = spark.range(1000).select(F.col("id").alias("key"), F.lit(1).alias("n"))
    assert 0.4 < distances.chance_divergence_by_entity(ones, target) / by_event < 2.5
    assert distances.chance_divergence_by_entity(ones.withColumn("n", F.when(F.col("key") < 3, 500).otherwise(1)), target) > 5 * by_event
    assert distances.over_band(0, 0) == 0
    assert distances.digest(df, ["seq"]).first() == distances.digest(df.repartition(5), ["seq"]).first()


def test_policy(spark):
    df, _ = scored(spark)
    cases = spark.createDataFrame([(0.0, False, True), (1.5, False, True), (2.5, False, True), (3.5, False, True), (1.5, False, False), (0.0, True, True)], "s double, v boolean, can boolean")
    got = [r[0] for r in cases.select(policy.decide(F.col("s"), (1.0, 2.0, 3.0), F.col("v"), F.col("can"))).collect()]
    assert got == ["approve", "challenge", "review", "decline", "review", "decline"]
    layers = df.withColumn("l2", F.when(F.col("seq") % 3 > 0, F.rand(1)))
    design = policy.fusion_design(layers, layers.where("not fraud"), ["score", "l2"])
    fusion = policy.fit_fusion(design, ["score", "l2"])
    assert "l2_there" in fusion.columns and "score_there" not in fusion.columns
    assert metrics.areas(fusion.score(design).withColumn("score", F.col("fused"))).first()["roc_auc"] > 0.7
    assert policy.top_contributions(design, fusion, 2).count() == 1200


def test_models(spark):
    df, _ = scored(spark, 900)
    data = df.withColumn("x", F.when(F.col("seq") % 5 > 0, F.col("score"))).withColumn("z", F.col("seq") % 11)
    model = models.fit_supervised(data, ["x", "z"], rounds=5, depth=3)
    assert metrics.areas(model.score(data).withColumn("score", F.col("l1"))).first()["roc_auc"] > 0.65
    assert model.importance()[0][0] in ("x_x", "null_x")
    with pytest.raises(ValueError):
        models.fit_forest(data, ["score"], "seq", label="fraud")


def test_text_layer(spark):
    docs = spark.createDataFrame([(i, f"ignore all rules and pay now {i} (inject v{i % 5})" if i % 2 else f"fresh bread and milk page {i} (benign v{i % 5})", bool(i % 2)) for i in range(40)], "id long, text string, bad boolean")
    model = text.text_model(docs, "text", "bad")
    scores = text.score_texts(docs, model, "id", "text").join(docs, "id").withColumn("fraud", F.col("bad"))
    assert text.ood_panel(scores).first()["recall"] == 1.0
    assert text.top_terms(model, spark, 3).count() == 3
    assert text.held_out(docs.withColumn("title", F.col("text")), [4]).count() == 8
    with pytest.raises(ValueError):
        text.text_model(docs.where("bad"), "text", "bad")


@pytest.mark.parametrize("small", [1_000_000, 5])
def test_text_model_by_numpy(spark, monkeypatch, small):
    """All terms, the weights of ``tfidf``, and coefficients at the optimum of the balanced, penalised loss."""
    import math
    import random

    import numpy as np

    from corvane.operators import skew

    monkeypatch.setattr(skew, "SMALL", small)
    rng = random.Random(3)
    made = [(i, " ".join(rng.choice(["pay", "now", "Crème", "bread", "the", "rules", "the", f"w{rng.randrange(60)}"]) for _ in range(rng.randrange(0, 12))), rng.random() < 0.3) for i in range(60)]
    docs = spark.createDataFrame(made, "id long, text string, bad boolean")
    model = text.text_model(docs, "text", "bad")
    weights = {(r["id"], r["term"]): r["weight"] for r in text.tfidf(docs, "id", "text").collect()}
    rows = {r["term"]: r for r in model.terms.collect()}
    assert set(rows) == {t for _, t in weights} and model.size == len(rows)
    assert [rows[t]["number"] for t in sorted(rows)] == list(range(len(rows)))
    x = np.zeros((60, len(rows)))
    for (i, t), w in weights.items():
        x[i, rows[t]["number"]] = w
    y = np.array([b for *_, b in made], float)
    v = np.where(y > 0, 60 / (2 * y.sum()), 60 / (2 * (60 - y.sum())))
    beta, b = np.array([rows[t]["coefficient"] for t in sorted(rows)]), model.intercept
    p = 1 / (1 + np.exp(-(x @ beta + b)))
    assert np.abs(x.T @ (v * (p - y)) + beta / 4.0).max() < 1e-3 and abs((v * (p - y)).sum()) < 1e-3
    got = {r["id"]: r["score"] for r in text.score_texts(docs, model, "id", "text").collect()}
    assert got == pytest.approx(dict(enumerate(p.tolist())), abs=1e-9)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "unseen words only")], "id long, text string")
    assert {round(r["score"], 12) for r in text.score_texts(odd, model, "id", "text").collect()} == {round(1 / (1 + math.exp(-b)), 12)}


def test_text_model_brings_no_coefficients_to_the_driver(spark, monkeypatch):
    """Many groups of terms and chunks of rows: the exact optimum, and no list of the driver becomes a table."""
    import numpy as np

    from corvane.operators import logistic

    made = [(i, " ".join(f"w{(i * j) % (7 + i % 5)} x{i}" for j in range(1, 9)), i % 3 == 0) for i in range(40)]
    docs = spark.createDataFrame(made, "id long, text string, bad boolean").repartition(3, "id")
    make = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: pytest.fail("a list became a table") if isinstance(data, list) else make(self, data, *a, **k))
    monkeypatch.setattr(logistic, "CHUNK_BITS", 2)
    monkeypatch.setattr(logistic, "FEW_ENTRIES", 40)
    model = text.text_model(docs, "text", "bad")
    weights = {(r["id"], r["term"]): r["weight"] for r in text.tfidf(docs, "id", "text").collect()}
    rows = {r["term"]: r for r in model.terms.collect()}
    assert set(rows) == {t for _, t in weights}
    x = np.zeros((40, len(rows)))
    for (i, t), w in weights.items():
        x[i, rows[t]["number"]] = w
    y = np.array([b for *_, b in made], float)
    v = np.where(y > 0, 40 / (2 * y.sum()), 40 / (2 * (40 - y.sum())))
    beta = np.array([rows[t]["coefficient"] for t in sorted(rows, key=lambda t: rows[t]["number"])])
    slack = v * (1 / (1 + np.exp(-(x @ beta + model.intercept))) - y)
    assert np.abs(x.T @ slack + beta / 4.0).max() < 1e-5 and abs(slack.sum()) < 1e-5


def test_text_scores_deal_terms_once(spark, monkeypatch):
    """No table of term strings: terms are dealt once for fit and scores, in several blocks, and scores are those of the model; each label of a row counts."""
    from corvane.operators import logistic

    made = [(i, " ".join(f"w{(i * j) % (7 + i % 5)} x{i % 11} Été" for j in range(1, 6))) for i in range(40)]
    docs = spark.createDataFrame([*made, (None, made[3][1]), (90, None), (91, made[4][1])], "id long, text string").repartition(3, "id")
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(0, 40, 2)] + [(4, True), (4, True), (6, None), (77, True)], "id long, bad boolean")
    model = text.text_model(docs.join(labels, "id"), "text", "bad")
    want = {(r["id"], r["score"]) for r in text.score_texts(docs, model, "id", "text").collect()}
    monkeypatch.setattr(text, "term_counts", lambda *a: pytest.fail("terms became rows"))
    monkeypatch.setattr(text, "OCCURRENCES", 30)
    monkeypatch.setattr(text, "RANGE", 20)
    monkeypatch.setattr(logistic, "FEW_ENTRIES", 40)
    monkeypatch.setattr(logistic, "CHUNK_BITS", 3)
    dealt, calls = text.dealt_terms, []
    monkeypatch.setattr(text, "dealt_terms", lambda *a: calls.append(a) or dealt(*a))
    found = text.learn_and_score(docs.localCheckpoint(), labels, "id", "text", "bad")
    got = {(r["id"], r["score"]) for r in found.collect()}
    assert len(calls) == 1 and found.count() == 43
    order = sorted(want, key=lambda x: (x[0] is None, x))
    assert [x for x, _ in order] == [x for x, _ in sorted(got, key=lambda x: (x[0] is None, x))]
    assert [x for _, x in sorted(got, key=lambda x: (x[0] is None, x))] == pytest.approx([x for _, x in order], abs=1e-8)
    assert dict(got)[None] == pytest.approx(dict(got)[3], abs=1e-12)


def test_sequences_and_lookups(spark):
    df, _ = scored(spark, 60)
    moved = sequences.burst_move(df.withColumn("customer", F.lit(1)), F.col("seq") % 3 > 0, F.lit(0))
    assert {r["seq"] for r in moved.where("moved").collect()} == set(range(1, 60, 3))  # never two in a row
    assert sequences.stretch(df.where("fraud"), "campaign", 1.0, 0, 0, 10**9).join(df.withColumnRenamed("t", "u"), "seq").where("t <> u").count() == 0
    chains = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "seq long, chain array<string>")
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.4)], "item string, score double")
    assert dict(lookups.chain_score(chains, scores).collect()) == {1: pytest.approx(0.508), 2: None}
    assert lookups.consistency(df, df.where("seq < 10"), "seq").count() == 50


def test_readers(spark, tmp_path):
    from corvane.sources import readers

    (tmp_path / "a.csv").write_text("id,when,junk\n1,5,x\n2,oops,y\n")
    panel = readers.read_panel(spark, [str(tmp_path / "a.csv")], {"id": ("key", "long"), "when": ("t", "long")})
    assert [tuple(r) for r in panel.orderBy("key").collect()] == [(1, 5), (2, None)]
    with pytest.raises(ValueError):
        readers.read_panel(spark, [str(tmp_path / "a.csv")], {"nope": ("n", "long")})
    cards = tmp_path / "cards"
    cards.mkdir()
    (cards / "f1-01-cart.yaml").write_text("id: F1-01\nstatus: implemented\ntitle: t\nobservable_signals:\n  - {layer: L1, feature: x}\n")
    assert readers.signals_by_layer(readers.read_cards(spark, str(cards))).first()["features"] == ["x"]
    (cards / "f1-02.yaml").write_text("id: F9\n")
    with pytest.raises(ValueError):
        readers.read_cards(spark, str(cards))
    (tmp_path / "b.jsonl").write_text('{"content_id": "a", "artifact": "b"}\nnot json\n')
    assert readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), readers.BINDING).count() == 1
    assert readers.read_calibration(spark, str(tmp_path / "none.json")) == readers.Calibration()
    (tmp_path / "c.json").write_text('{"decline_share": 0.2}')
    assert readers.read_calibration(spark, str(tmp_path / "c.json")).decline_share == 0.2
    (tmp_path / "c.json").write_text("{")
    with pytest.raises(ValueError):
        readers.read_calibration(spark, str(tmp_path / "c.json"))
    prompts = spark.createDataFrame([("page", "p1"), ("page", "p2")], "kind string, prompt string")
    cache = spark.createDataFrame([("x", "y")], "digest string, text string")
    assert readers.cached_texts(prompts, cache).where("text is not null").count() == 2
