"""The trie, the negatives and the decontamination against plain readings, on odd rows too."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import conversation_trie, decontamination, hard_negatives


def plain_trie(rows, rebuilt):
    """The contract read word for word: nodes as prefixes in a dictionary."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [t for _, t in sorted(ts, key=lambda x: x[0])] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuilt else 0
        whole[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:] if rebuilt else ts
    members = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = {}

    def walk(p):
        below = [walk(q) for q in children.get(p, [])]
        own_words = len([w for w in re.split(r"[\x20\x09-\x0D]+", p[-1][1]) if w]) if p else 0
        leaves = sum(b[0] for b in below) or 1
        saved = (len(members[p]) - 1) * own_words + sum(b[1] for b in below)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(whole[c]) == len(p))))
        out[(len(p), min(members[p]))] = (min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        return leaves, saved

    if whole:
        import sys

        sys.setrecursionlimit(20_000)
        walk(())
    return out


def trie_rows(df):
    return {(r["depth"], r["conv_id"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect()}


TURNS = "conv_id long, turn long, role string, text string, d long, key string, node long, n long"


def made_turns(rng, n):
    rows = []
    for c in range(n):
        base = rng.randrange(4)
        for t in range(rng.randrange(0, 6)):
            rows.append((c, t, rng.choice(["user", "user", None]), f"turn {t} of {base if rng.random() < 0.8 else c}\twords"))
    return rows


@pytest.mark.parametrize("hot", [2, 1000])
def test_trie_equals_plain_reading(spark, monkeypatch, hot):
    monkeypatch.setattr(conversation_trie, "HOT_GROUPS", hot)
    monkeypatch.setattr(conversation_trie, "END_BLOCK", 2)
    rows = made_turns(random.Random(hot), 60)
    # Nulls in each column, turns with equal numbers, repeated rows, negative ids, an absent base, empty text, and copies of one conversation.
    rows += [(None, 0, "user", "lost"), (7, None, None, None), (7, None, None, None), (8, 1, "a", ""), (8, 1, "a", "b"), (8, 1, "b", "a"), (-3, 0, "user", "x"), (-20, 0, "user", "x y"), (1001, 5, "user", "late"), (1001, 0, "user", "early")]
    rows += [(2000 + k, t, "user", f"same {t}") for k in range(30) for t in range(4)]
    df = spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], TURNS)
    turns = conversation_trie.numbered_turns(df)
    assert trie_rows(conversation_trie.build_trie(*conversation_trie.rebuilt_steps(turns))) == plain_trie(rows, True)
    assert trie_rows(conversation_trie.conversation_trie(df)) == plain_trie(rows, False)


def test_trie_of_none_of_one_and_of_a_long_one(spark):
    build = lambda rows: trie_rows(conversation_trie.build_trie(*conversation_trie.rebuilt_steps(conversation_trie.numbered_turns(spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], TURNS)))))
    assert build([]) == {} and build([(None, 1, "a", "b")]) == {}
    one = [(3, 0, "user", "hello there")]
    assert build(one) == plain_trie(one, True)
    # A conversation of many turns needs no rounds of its own; a very long text is one turn.
    long = [(5, t, "user", f"t{t}") for t in range(3000)] + [(6, 0, "user", "word " * 200_000), (6, 1, "user", "x")]
    assert build(long) == plain_trie(long, True)


def plain_negatives(rows, anchor, positives, negatives):
    usable = [(i, lab, [int(np.floor(256.0 * x)) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    top = 2**55
    score = lambda a, b: max(-top, min(top, sum(x * y for x, y in zip(a, b, strict=False))))
    out = []
    for i, lab, v in usable:
        if not anchor(i):
            continue
        ranked = sorted((-score(v, w), j) for j, l2, w in usable if l2 == lab and j != i)[:positives]
        others = sorted((-score(v, w), j) for j, l2, w in usable if l2 != lab)
        for p, pid in ranked:
            inside = [(-s, j) for s, j in others if 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out += [(i, pid, k, j, -p, s) for k, (s, j) in enumerate(inside, 1)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<double>, id long, q string, rank int"


@pytest.mark.parametrize(("block", "anchors", "chunk"), [(7, 3, 2), (2048, 256, 16)])
def test_negatives_equal_plain_reading(spark, monkeypatch, block, anchors, chunk):
    for name, value in (("BLOCK", block), ("ANCHORS", anchors), ("CHUNK", chunk)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(block)
    same = [0.5, 0.25, -0.125]
    rows = [(i, rng.randrange(3), [rng.uniform(-1, 1) for _ in range(3)]) for i in range(0, 120)]
    rows += [(i, i % 3, same) for i in range(200, 240)] + [(i, 1, [0.3, 0.1, 0.0]) for i in range(300, 340)]  # many equal scores
    rows += [(None, 1, same), (5000, None, same), (5001, 1, None), (5002, 1, [0.1, None, 0.2]), (5003, 1, [0.1, float("nan"), 0.2]), (5004, 1, [float("inf"), 0.0, 0.0])]
    rows += [(5005, 2, []), (5006, 2, [0.4]), (5007, 1, [0.4, 0.2, 0.1, 0.9]), (-40, 0, same), (5010, 2, [3e9, -2e9, 1e9]), (5020, 2, [1e200, 0.0, 0.0]), (6000, 0, [0.2, 0.2, 0.2]), (6000, 0, [0.2, 0.2, 0.2])]
    rows += [(7001, 2, [0.3, 0.1, 0.0])] * 25  # repeated rows
    df = spark.createDataFrame([(*r, 1, "q", 2) for r in rows], VECTORS)
    got = hard_negatives.mine_negatives(df, F.col("vec_id") % 20 == 0).collect()
    assert sorted(tuple(r) for r in got) == plain_negatives(rows, lambda i: i % 20 == 0, 5, 10)
    assert hard_negatives.mine_negatives(df.where("false"), F.lit(True)).count() == 0
    assert hard_negatives.mine_negatives(df, F.lit(False)).count() == 0


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(docs, items, width):
    split = lambda t: WORD.findall((t or b"").lower())  # noqa: E731  bytes.lower() changes A-Z only
    windows = {}
    for item, text in items:
        ws = split(text)
        for i in range(max(1, len(ws) - width + 1) if ws else 0):
            windows.setdefault(tuple(ws[i : i + width]), set()).add(str(item) if item is not None else "")
    out = []
    for d, text in docs:
        ws, hit, found = split(text), set(), set()
        for w, ids in windows.items():
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found |= ids
        runs = [(i, next(j for j in range(i, len(ws) + 1) if j not in hit)) for i in sorted(hit) if i - 1 not in hit]
        out.append((d, len(ws), runs, sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("part_bytes", "cut", "pairs"), [(1 << 23, 4 << 20, 1 << 20), (400, 16, 3)])
def test_contamination_equals_plain_reading(spark, monkeypatch, part_bytes, cut, pairs):
    monkeypatch.setattr(decontamination, "CUT", cut)
    monkeypatch.setattr(decontamination, "PAIRS", pairs)
    rng = random.Random(cut)
    text = lambda n: " ".join(rng.choice(["a", "b", "c1", "É", "日本"]) for _ in range(n)).encode()
    items = [(k, text(rng.choice([1, 2, 3, 5, 8, 12, 20]))) for k in range(12)] + [(3, text(11)), (None, b"A-b! c1"), (77, None), (78, b" \n"), (100, b"a \xff b"), (9, text(4)), (10, text(30))]
    docs = [(k, text(rng.randrange(0, 40))) for k in range(30)]
    docs += [(50, items[10][1].upper()), (51, b"x " * 5000 + (items[5][1] or b"") + b" y" * 5000), (52, None), (52, None), (52, b""), (None, b"a \xff b"), (None, items[-1][1]), (53, items[-1][1] + b"." + items[-1][1]), (53, items[-1][1] + b"." + items[-1][1])]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text binary, k string, t string, items string, digest string")
    df = frame([(*d, "k", "t", "i", "d") for d in docs], "doc_id").withColumn("text", F.col("text").cast("string"))
    bench = frame([(*i, "k", "t", "i", "d") for i in items], "item_id").withColumn("text", F.col("text").cast("string"))
    for width in (10, 4):
        got = decontamination.find_contamination(df, bench, width=width, part_bytes=part_bytes).collect()
        assert sorted([(r["doc_id"], r["n_words"], [(s["start"], s["end"]) for s in r["spans"]], list(r["items"])) for r in got], key=str) == plain_hits(docs, items, width)
    clean = decontamination.drop_contaminated(df, bench, part_bytes=part_bytes)
    assert clean.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(d) for d, _, runs, _ in plain_hits(docs, items, 10) if not runs)
    assert decontamination.find_contamination(df.where("false"), bench).count() == 0
    assert {len(r["items"]) for r in decontamination.find_contamination(df, bench.where("false")).collect()} == {0}
