from __future__ import annotations

import hashlib
import math
import os
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF, same
from pyspark.sql import functions as F

from corvane.llm import common, langid, language_model, mixing, piece_codec, quality_rules, registry, sharding, simhash, token_counts, toxicity, transport_stream

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, kept boolean, k string, id string, t string, component string, size long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, and columns with clashing names."""
    clash = (0.5, 3, True, "k", "id", "t", "c", 7)
    prose = "the cat of the house and the dog in a garden is with you for it " * 6
    rows = [
        (1, prose, "en", "a", 1, *clash), (1, prose, "en", "a", 1, *clash), (2, "", "en", "a", 1, *clash), (3, None, None, None, None, *clash), (4, "   \n\t ", "fr", None, 1, *clash), (None, "you idiot 12", "en", "b", 1, *clash),
        (5, "xyzzy" * 20_000, "de", "b", 1, *clash), (6, "un mot " * 9_000, "fr", "c", 1, *clash), (7, "12 !! ?? ß \U0001f600 日本", "de", "c", 1, None, None, None, None, None, None, None, None), (8, prose + "x", "en", "a", 1, *clash),
    ]
    return spark.createDataFrame(rows, DOCS)


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def operators(spark):
    train = F.lit(True)
    return {
        "toxicity": lambda d: toxicity.score_toxicity(d, labels_of(spark, [(1, 1, 0), (8, 1, 1), (3, 1, None)]), train),
        "sharding": lambda d: sharding.assign_shards(d, [1.0, 2.0, 1.0], grown_weight=1.0),
        "langid": lambda d: langid.identify_languages(d, langid.fit_centroids(d, train)),
        "quality": quality_rules.score_quality,
        "pieces": piece_codec.encode_pieces,
        "simhash": simhash.near_duplicates,
        "language_model": lambda d: language_model.score_texts(d, F.col("doc_id") != 2),
        "tokens": token_counts.count_tokens,
        "media": lambda d: transport_stream.read_streams(transport_stream.write_streams(d)),
        "mixing": lambda d: mixing.mix(d, [3, 1, 2]),
    }


@pytest.mark.parametrize("name", ["toxicity", "sharding", "langid", "quality", "pieces", "simhash", "language_model", "tokens", "media", "mixing"])
def test_odd_rows_and_empty_tables(spark, odd, name):
    run = operators(spark)[name]
    out = run(odd).collect()
    assert len(out) == odd.count()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in odd.collect())
    if name != "sharding":  # rows that are equal get equal results
        assert len({tuple(map(str, r)) for r in out if r["doc_id"] == 1}) == 1
    assert run(odd.where("false")).count() == 0


def test_stages_on_odd_rows(spark, odd):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.where("false")):
            out = stage(spark, docs, SF)
            out.count()
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert out.columns == odd.columns


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    same(registry.QUERIES[name](spark, SF), duck.execute(registry.SQL[name]))


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in common.documents(spark, SF).select("doc_id", "text").collect()}


def test_pieces_equal_library(spark, texts):
    c = piece_codec.codec(piece_codec.public_model())
    rng = random.Random(1)
    odd = ["", " ", "a  b   c", "\n\n x", "▁ a▁▁b", "<s> <0x41>", "x" * 500 + " " * 70 + "ab" * 300, "\t\x00 a"] + ["".join(rng.choice("ab ▁\n<s>é\U0001f642日 the") for _ in range(rng.randint(1, 200))) for _ in range(200)]
    for t in [*odd, *list(texts.values())[:60]]:
        said = c.library.encode(t, add_bos=True, add_eos=True)
        ids = c.encode([t])[0]
        assert ids.tolist() == said and c.decode([ids])[0].decode() == c.library.decode(said)
    got = {r["doc_id"]: r for r in registry.QUERIES["op5_piece_codec"](spark, SF).collect()}
    for d, t in texts.items():
        said = c.library.encode(t, add_bos=True, add_eos=True)
        assert got[d]["n_tokens"] == len(said) and got[d]["ids_sha256"] == hashlib.sha256(np.array(said, "<u4").tobytes()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(c.library.decode(said).encode()).hexdigest()


def test_token_counts_equal_library(spark, texts):
    import public_tokenizers

    c = token_counts.counter(public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["n_tokens"] for r in registry.QUERIES["op8_token_counts"](spark, SF).collect()}
    for d, t in texts.items():
        assert got[d] == len(c.library.encode(t, add_special_tokens=False).ids)


def test_token_counts_with_special_pieces_equal_library():
    import public_tokenizers

    c = token_counts.counter(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    bits = ["<unk>", "<s>", "</s>", "<0x41>", "a", "b", " ", "\u2581", "\t", "\n", "\u00e9", "\u65e5", "\U0001f642", "the", "<", "unk>", "  "]
    made = ["a\t<unk>", "<unk><unk>", "<unk>"] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    assert c.count(made)[0].tolist() == [len(c.library.encode(t, add_special_tokens=False).ids) for t in made]


def neighbours(fps, most, check=None):
    """Least index reachable, by comparing all pairs."""
    label = list(range(len(fps)))
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i][0] ^ fps[j][0]).bit_count() <= most and (check is None or (fps[i][1] ^ fps[j][1]).bit_count() <= check)]
    moved = True
    while moved:
        moved = False
        for i, j in pairs:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                moved = True
    return label


def test_simhash_query_equals_brute_force(spark, texts):
    import xxhash

    ids = sorted(texts)
    fps = []
    for d in ids:
        words = texts[d].encode().translate(common.LOWER_AZ).split()
        found = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        fps.append((sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found)), 0))
    label = neighbours(fps, 2)
    got = {r["doc_id"]: r for r in registry.QUERIES["op6_simhash"](spark, SF).collect()}
    for i, d in enumerate(ids):
        assert got[d]["fingerprint"] == f"{fps[i][0]:016x}" and got[d]["component_id"] == ids[label[i]]


@pytest.mark.parametrize(("most", "check", "group"), [(2, None, 8), (2, None, 4096), (3, None, 8), (6, 8, 8), (6, 8, 4096)])
def test_links_lose_nothing(spark, most, check, group):
    rng = random.Random(most)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {(b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 4))), rng.getrandbits(4)) for b in base for _ in range(12)}
    rows = sorted((simhash.signed(a), b) for a, b in fps)
    points = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "id long, fp long, fp2 long")
    got = {r["node"]: r["label"] for r in simhash.components(simhash.links(points, most, check, group)).collect()}
    label = neighbours([(a & (2**64 - 1), b) for a, b in rows], most, check)
    assert [got.get(i, i) for i in range(len(rows))] == label


def test_allocation_keeps_the_pigeonhole_sum():
    cost, thresholds = simhash.allocate([[0, 5, 50], [0, 1, 2], [0, 100, 200]], 0)
    assert sum(thresholds) == 0 and thresholds[2] == -1 and cost == min(50 + 1, 5 + 2)


def test_language_model(spark, texts):
    got = {r["doc_id"]: r for r in registry.QUERIES["op7_language_model"](spark, SF).collect()}
    words = {d: t.encode().translate(common.LOWER_AZ).split() for d, t in texts.items()}
    train = [d for d in texts if zlib.crc32(str(d).encode()) % 5 != 1]
    c = Counter(w for d in train for w in words[d])
    c[None] = len(train)
    n, v = sum(c.values()), len(c)
    for d, ws in words.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*ws, None])
        r = got[d]
        assert r["train_tokens"] == n and r["n_tokens"] == len(ws) + 1 and r["n_known"] == sum(c[w] > 0 for w in ws) + 1 and r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0


def ppm(strings, order):
    """A plain PPM with exclusion: the log10 probability of a string under the counts of ``strings``."""
    counts = {}
    for s in strings:
        s = language_model.END * order + s
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts.setdefault(s[i - k : i], Counter())[s[i]] += 1

    def one(context, byte):
        out, gone = 0.0, set()
        for k in range(order, -1, -1):
            left = {x: n for x, n in counts.get(context[order - k :], {}).items() if x not in gone}
            if not left:
                continue
            if byte in left:
                return out + math.log10((left[byte] - language_model.DISCOUNT) / sum(left.values()))
            out += math.log10(language_model.DISCOUNT * len(left) / sum(left.values()))
            gone |= set(left)
        return out - math.log10(256 - len(gone))

    def score(s):
        s = language_model.END * order + s
        return sum(one(s[i - order : i], s[i]) for i in range(order, len(s)))

    return one, score


@pytest.mark.parametrize(("order", "block"), [(5, 64 << 20), (5, 3000), (2, 1), (6, 40_000)])
def test_language_model_equals_plain_ppm(spark, monkeypatch, order, block):
    """Scores of texts learned from and of new ones, with bytes that training lacks, in one block or many."""
    monkeypatch.setattr(language_model, "BLOCK", block)
    monkeypatch.setattr(language_model, "MERGE", 50)
    monkeypatch.setattr(common, "SLICE", min(block, 2 << 20))
    rng = random.Random(order)
    made = ["".join(rng.choice("abc de\u00e9\u65e5") for _ in range(rng.randint(0, 200))) for _ in range(60)] + ["the cat sat on the mat"] * 20 + ["", "\U0001f642 qqq zzz the cat"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(made)] + [(None, None)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in language_model.score_texts(docs, F.col("doc_id") % 3 != 1, order=order).collect()}
    strings = [language_model.serialised(t.encode()) for t in made]
    _, score = ppm([s for i, s in enumerate(strings) if i % 3 != 1], order)
    assert len(got) == len(made) + 1
    for i, s in [*enumerate(strings), (None, language_model.END)]:
        assert got[i] == pytest.approx(score(s), rel=1e-9), i


def test_language_model_prices_sum_to_one(spark):
    strings = [language_model.serialised(t) for t in [b"the cat sat on the mat and the cat ran", b"a dog and a cat"] * 3]
    codes, n = np.unique(language_model.grams_of(strings, 3), return_counts=True)
    known = dict(zip(codes.tolist(), n.tolist(), strict=True))
    contexts = [b"the", b"e c", b"zth", b"zz ", b"qqq"]
    asked = {int.from_bytes(c + bytes([b])) for c in contexts for b in range(256)}
    grams = spark.createDataFrame([(g, known.get(g, 0)) for g in sorted(asked | set(known))], "gram long, n long")
    found = {r["gram"]: r["value"] for r in language_model.price(grams, 3).collect()}
    for c in contexts:
        assert sum(10 ** found[int.from_bytes(c + bytes([b]))] for b in range(256)) == pytest.approx(1, abs=1e-9)


def test_media_round_trip_and_damage():
    ts = transport_stream
    for n in [*range(0, 400, 7), 4031, 4032, 4033, 20_000]:
        data = os.urandom(n)
        s = ts.read_stream(ts.write_stream(data))
        assert s.payload == data and not (s.lost_bytes or s.continuity_errors or s.crc_errors or s.duplicates)
    data = os.urandom(20_000)
    m = ts.write_stream(data)
    s = ts.read_stream(m[: 188 * 10] + m[188 * 11 :])
    assert s.continuity_errors == 1 and [u["damaged"] for u in s.units] == [True] + [False] * 4
    s = ts.read_stream(m[: 188 * 10] + m[188 * 9 :])
    assert s.duplicates == 1 and s.payload == data
    s = ts.read_stream(b"junk!" + m[: 188 * 10] + b"\x00abc" + m[188 * 10 :])
    assert s.lost_bytes == 9 and s.payload == data
    bad = bytearray(m)
    bad[20] ^= 1
    assert ts.read_stream(bytes(bad)).crc_errors == 1 and not ts.read_stream(bytes(bad)).programs
    s = ts.read_stream(m)
    assert [u["pts"] for u in s.units] == [90_000 + 3600 * i for i in range(5)] and all(u["random_access"] for u in s.units)


def test_many_losses_of_sync_take_linear_time():
    data = bytearray(transport_stream.write_stream(os.urandom(2_000_000)))
    data[:: 188 * 10] = bytes(len(data[:: 188 * 10]))
    began = time.time()
    s = transport_stream.read_stream(bytes(data))
    assert s.lost_bytes > 0 and s.continuity_errors > 500 and time.time() - began < 2


def plain_payload(media):
    """The elementary bytes of a stream by a plain reading, packet after packet."""
    units, counters = [], {}
    for i in range(0, len(media), 188):
        p = media[i : i + 188]
        assert p[0] == 0x47 and len(p) == 188
        pid, begin = (p[1] & 31) << 8 | p[2], 5 + p[4] if p[3] & 0x20 else 4
        if not p[3] & 0x10:
            continue
        assert counters.setdefault(pid, p[3] & 15) == p[3] & 15
        counters[pid] = (p[3] + 1) & 15
        if p[1] & 0x40 and p[begin : begin + 3] == b"\0\0\1":
            units.append(bytearray(p[begin + 9 + p[begin + 8] :]))
            which = pid
        elif units and pid == which:
            units[-1] += p[begin:]
    return b"".join(units), len(units), len(media) // 188


def test_media_query(spark, texts):
    got = {r["doc_id"]: r for r in registry.QUERIES["op9_transport_stream"](spark, SF).collect()}
    for d, t in texts.items():
        p = t.encode().ljust(max(192, -(-len(t.encode()) // 192) * 192))
        media = transport_stream.write_stream(p)
        assert (got[d]["media_bytes"], got[d]["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        payload, units, packets = plain_payload(media)
        assert payload == p
        said = dict(x.split("=") for x in got[d]["feature"].split(";"))
        assert (said["packets"], said["units"], said["random_access"], said["programs"], said["errors"]) == (str(packets), str(units), str(units), "1", "0")
        assert (int(said["first_pts"]), int(said["last_pts"])) == (90_000, 90_000 + 3600 * (units - 1))
    for d, t in texts.items():
        b = t.encode()
        p = b.ljust(max(192, -(-len(b) // 192) * 192))
        assert (got[d]["n_bytes"], got[d]["payload_bytes"], got[d]["payload_sha256"], got[d]["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))


def test_language_and_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = common.documents(spark, sf)
    hit = registry.QUERIES["op3_langid"](spark, sf).join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert hit > 0.97
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = registry.QUERIES["op1_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").select("score", "toxic").collect()
    pos, neg = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg) > 0.85


def test_sharding_laws(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    small = {r["doc_id"]: r for r in sharding.assign_shards(rows, [1.0] * 10, grown_weight=1.0).collect()}
    large = {r["doc_id"]: r for r in sharding.assign_shards(rows, [1.0] * 11).collect()}
    assert all(large[d]["shard"] == r["grown_shard"] and r["grown_shard"] in (r["shard"], 10) for d, r in small.items())
    for s in range(10):
        slots = sorted(r["slot"] for r in small.values() if r["shard"] == s)
        assert slots == list(range(len(slots))) and 300 < len(slots) < 500
    heavy = Counter(r["shard"] for r in sharding.assign_shards(rows, [3.0, 1.0]).collect())
    assert 2.6 < heavy[0] / heavy[1] < 3.4


def test_mixing_targets_and_both_joins(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.choice("aaaaaabbc"), "w " * rng.randint(1, 60)) for i in range(1500)] + [(9000 + i, None, "w " * 3) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix(docs, [3, 1, 2]).join(docs.drop("text"), "doc_id").collect()
    for s in ("a", "b", "c", None):
        mine = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 31
        assert mine[0]["target"] <= 2 * mine[0]["source_size"] and all(r["taken"] <= 2 * r["size"] for r in mine)
    repeated = Counter(r["doc_id"] for r in mixing.repeat_mixed(docs, [3, 1, 2]).collect())
    assert all(repeated[r["doc_id"]] * r["size"] == r["taken"] for r in out)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 1)
    assert sorted(map(str, mixing.mix(docs, [3, 1, 2]).collect())) == sorted(str(r) for r in mixing.mix(docs, [3, 1, 2]).collect())
    assert Counter(r["doc_id"] for r in mixing.repeat_mixed(docs, [3, 1, 2]).collect()) == repeated


def test_quality_counts_by_hand(spark):
    text = "a b c d a b c e\n\na b\nx y #$\na b\n"
    r = quality_rules.score_quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    # a b c occurs twice (positions 0-2 and 4-6)
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (15, 16, 2, 1, 6)


def test_pipeline_equals_its_parts(spark):
    """Stage by stage: near-duplicates by the brute-force Jaccard similarity of five-word shingle sets."""
    import corpus_pipeline

    docs = common.documents(spark, SF)
    good = {r["doc_id"] for r in quality_rules.score_quality(docs).where("kept").collect()}
    kept = common.checkpointed(corpus_pipeline.STAGES[0][1](spark, docs, SF))
    assert {r["doc_id"] for r in kept.collect()} == good
    clean = common.checkpointed(corpus_pipeline.STAGES[1][1](spark, kept, SF))
    scores = toxicity.score_toxicity(kept, spark.read.parquet(f"{SF}/labels.parquet"), common.id_remainder(F.col("doc_id"), 4) != 2)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in scores.collect() if r["score"] < toxicity.THRESHOLD}
    texts = {r["doc_id"]: r["text"].encode().translate(common.LOWER_AZ).split() for r in clean.collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in texts.items()}
    label = {d: d for d in sets}
    near = [(a, b) for a in sets for b in sets if b < a and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    unique = common.checkpointed(corpus_pipeline.STAGES[2][1](spark, clean, SF))
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(set(label.values()))
    taken = {r["doc_id"]: r for r in mixing.mix(unique, mixing.WEIGHTS).collect()}
    mixed = common.checkpointed(corpus_pipeline.STAGES[3][1](spark, unique, SF))
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert all(times[d] * r["size"] == r["taken"] for d, r in taken.items())
    coded = corpus_pipeline.STAGES[4][1](spark, mixed, SF).collect()
    library = piece_codec.codec(piece_codec.public_model()).library
    whole = {r["doc_id"]: r["text"] for r in unique.collect()}
    said = {d: library.encode(t, add_bos=True, add_eos=True) for d, t in whole.items() if times[d]}
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in coded) == Counter({(d, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()): times[d] for d, i in said.items()})


@pytest.mark.parametrize("rare", [32, 2])
def test_keep_one_equals_brute_force_jaccard(spark, monkeypatch, rare):
    """Families whose copies share about half, three quarters or more of their shingles, near 0.8 on both sides."""
    monkeypatch.setattr(simhash, "RARE", rare)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 4)
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 300]))]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    label = list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted(set(label))


@pytest.mark.parametrize("hot", [512, 3])
def test_keep_one_loses_no_link_that_fingerprints_miss(spark, monkeypatch, hot):
    """Fingerprints that find nothing, or only some links: the result is that of brute force, also with passages that many texts share."""
    monkeypatch.setattr(simhash, "HOT_TOKEN", hot)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 4)
    monkeypatch.setattr(simhash, "TOKENS", 50)
    rng = random.Random(7)
    texts, passage = ["", "one", "one two", "a b c d e"], [f"p{i}" for i in range(30)]
    for k in range(10):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([5, 12, 40, 90]))] + passage * (k % 3 == 0)
        for _ in range(6):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in map(str.split, texts)]
    label = list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    proposed = simhash.near_fingerprints
    for missed in ("false", "node % 3 = 0"):
        monkeypatch.setattr(simhash, "near_fingerprints", lambda points, missed=missed: proposed(points).where(missed))
        assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted(set(label))


def test_keep_one_proposes_by_fingerprint_bands(spark, monkeypatch):
    """Pairs come from SimHash fingerprints: near ones of one bucket share the least of their chain, also across blocks; others share nothing."""
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 1 << 64, 301, np.uint64)
    words = simhash._majorities(hashes, 3)
    assert [int(words[0]), int(words[1])] == [simhash._majority(h) for h in (hashes, simhash._remixed(hashes + np.uint64(0x9E3779B97F4A7C15)))]
    assert simhash._majorities(hashes[:2], 1)[0] == hashes[0] & hashes[1]
    bits, bands = simhash.bands_for(10_000_000)
    assert (1 - 0.8485**bits) ** bands < 1.1e-5 and simhash.bands_for(0)[0] == simhash.LEAST_BITS
    base = [" ".join(f"w{rng.integers(10**6)}" for _ in range(200)) for _ in range(30)]
    docs = spark.createDataFrame([(3 * i + k, f"{t} x{k}" if k else t) for i, t in enumerate(base) for k in range(3)], "doc_id long, text string")
    rows = simhash.shingle_sketches(docs, 5, "doc_id", "text").localCheckpoint()
    family = {r["node"]: r["id"] // 3 for r in rows.collect()}
    for hot in (simhash.HOT, 4):
        monkeypatch.setattr(simhash, "HOT", hot)
        near = simhash.near_fingerprints(rows).collect()
        assert {r["node"] for r in near} == set(family) and all(family[r["key"]] == family[r["node"]] == family[r["nearest"]["other"]] for r in near)
        assert all(r["key"] <= r["nearest"]["other"] <= r["node"] for r in near)
        assert len({r["node"] for r in near if r["node"] != r["nearest"]["other"]}) == 60


def test_stages_decide_on_rows_not_ids(spark, monkeypatch):
    """Null and repeated ids: a row's fate depends on its own text."""
    docs = spark.createDataFrame([(None, "bad one"), (None, "good one"), (1, "bad two"), (1, "good two"), (2, "good three")], "doc_id long, text string")

    def scored(d, *args, **kw):
        key = args[6] if len(args) > 6 else F.col("doc_id")
        return d.select(key.alias("doc_id"), F.when(F.col("text").startswith("bad"), 1.0).otherwise(0.0).alias("score"))

    monkeypatch.setattr(toxicity, "score_toxicity", scored)
    kept = toxicity.keep_clean(docs, labels_of(spark), F.lit(True))
    assert sorted(r["text"] for r in kept.collect()) == ["good one", "good three", "good two"]
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    # id 5 holds two unrelated texts, one of which ids 3 and 9 repeat; null ids hold others
    rows = [(5, a), (5, b), (3, a), (9, b), (None, a + " end"), (None, "c d e f g h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs, most_bits=0).collect()}
    assert {(5, 3), (5, 5), (3, 3), (9, 5), (None, None)} <= got and (9, 3) not in got
    assert sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(docs).collect()) == [(0, "c d e f g h"), (3, a), (5, b)]


def test_links_of_a_group_become_one_a_node(spark):
    """All pairs of two groups: a forest connects the same nodes, whatever the tasks."""
    pairs = [(i, j) for g in (range(0, 40), range(100, 130)) for i in g for j in g if i < j] + [(200, 201)]
    df = spark.createDataFrame(pairs, "a long, b long")
    want = {(r["node"], r["label"]) for r in simhash.components(df).collect()}
    for most in (1 << 20, 300):
        few = simhash.fewer_links(df, most)
        assert {(r["node"], r["label"]) for r in simhash.components(few).collect()} == want
        assert most == 300 or few.count() == 39 + 29 + 1
    assert simhash.fewer_links(df.limit(0)).count() == 0
