"""Ranked search against plain Python."""

import collections
import math
import random
import re

import pytest

from doclake.llm import lexical

r = random.Random(12)
WORDS = [f"t{i}" for i in range(40)] + ["É", "é", "x1", "日本"]
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, m int, block int, ids string, terms int, item int, score int, rank int, nth int"


def text(n):
    return "".join(r.choices(WORDS, weights=[60 / (i + 1) for i in range(len(WORDS))])[0] + r.choice([" ", ", ", "_", "\x00", "-", "T0 "]) for _ in range(n))


DOCS = [(i, text(r.choice([0, 1, 5, 5, 20, 20, 100]))) for i in range(300)] + [(900 + i, "same t1 t2 words") for i in range(70)] + [(7, "t1 t1"), (7, "t1 t1"), (None, "t1 t1"), (None, None), (8, ""), (9, "... !"), (10, "t39 " * 5000)]
ITEMS = [(i, text(r.choice([1, 3, 30]))) for i in range(9)] + [(3, "t1"), (None, "same words"), (20, None), (21, "unheard"), (22, "")]


def plain(docs, items, top):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    own = [(d, collections.Counter(terms(t))) for d, t in docs]
    own = [(d, c, sum(c.values())) for d, c in own if c]
    big_n, big_l = len(own), sum(n for _, _, n in own)
    df = collections.Counter(t for _, c, _ in own for t in c)
    out = []
    for item, t in items:
        hits = []
        for d, c, n in own:
            m = 50 + (50 * n * big_n) // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 20 * m)) for x in set(terms(t)) if x in c)
            if score > 0:
                hits.append((-score, d is None, d))
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(sorted(hits, key=lambda h: (h[0], h[1], h[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"block": 7, "at_once": 4, "gathered": 30}, {"block": 50, "best": 1, "gathered": 1}])
@pytest.mark.parametrize("top", [50, 3])
def test_search(spark, sizes, top):
    docs = spark.createDataFrame([(*d, 1, 2, "z", 3, 4, 5, 6, 7) for d in DOCS], SCHEMA).repartition(4)
    items = spark.createDataFrame([(*x, 1) for x in ITEMS], "item_id long, text string, score int")
    got = lexical.search(docs, items, top, **sizes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(DOCS, ITEMS, top)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


def test_other_ids_and_long_texts(spark):
    docs = [("b", "needle " + "hay " * 2_000_000), ("a", "needle"), ("c", "needle"), (None, "needle")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame([("q", "Needle!")], "item_id string, text string"))
    assert [(x["rank"], x["doc_id"]) for x in sorted(got.collect(), key=lambda x: x["rank"])] == [(1, "a"), (2, "c"), (3, None), (4, "b")]


def test_sums_beyond_doubles():
    """Where a bound passes 2^53 sums are made of integers."""
    import numpy as np

    items = [[b"a", b"b"]]
    query = lexical.Query(items, {b"a": 1, b"b": 2}, {b"a": 1 << 40, b"b": 3})
    row = lexical._blocks(__import__("pyarrow").table({"m": [60, 60], "block": [0, 0], "doc_id": [1, 2], "terms": [np.array([1, 2], np.int32).tobytes()] * 2, "tfs": [np.array(x, np.int32).tobytes() for x in ([3, 1], [2, 9])]}), 4096).to_pylist()[0]
    place, there, bounds = query.met(60, np.frombuffer(row["terms"], np.int32), np.frombuffer(row["top_tf"], np.int32))
    (_, scores), = lexical.Block(row).scores(query, place, there, np.array([0]), int(bounds[0]))
    want = [sum(w * int(lexical.impact(t, 60)) for w, t in zip((1 << 40, 3), tfs, strict=True)) for tfs in ((3, 1), (2, 9))]
    assert bounds[0] > 1 << 53 and scores[0].tolist() == want
