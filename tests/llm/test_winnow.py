import hashlib
import random

import numpy as np
import pytest
import xxhash

from doclake.llm import winnow as w


def by_hand(text):
    p = w.points_of(text)
    if not len(p):
        return []
    with np.errstate(over="ignore"):
        grams = [int(w._grams(p[i : i + w.GRAM])[0]) for i in range(max(1, len(p) - w.GRAM + 1))]
    chosen = set()
    for i in range(max(1, len(grams) - w.WINDOW + 1)):
        window = grams[i : i + w.WINDOW]
        chosen.add(i + max(k for k, v in enumerate(window) if v == min(window)))
    return [(grams[i], i) for i in sorted(chosen)]


@pytest.mark.parametrize("piece", [1 << 20, 64, 100])
def test_same_as_by_hand(monkeypatch, piece):
    monkeypatch.setattr(w, "PIECE", piece)
    r = random.Random(3)
    for _ in range(60):
        n = r.choice([0, 1, 15, 16, 17, 46, 47, 48, 49, 163, 500])
        text = "".join(r.choice("ab" if r.random() < 0.5 else "abcdé😀 ") for _ in range(n))
        assert list(zip(*(x.tolist() for x in w.winnow(w.points_of(text))), strict=True)) == by_hand(text)


def test_guarantee():
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    for _ in range(50):
        shared = word(w.GRAM + w.WINDOW - 1)
        a, b = (w.winnow(w.points_of(word(r.randint(0, 90)) + shared + word(r.randint(0, 90))))[0] for _ in "ab")
        assert np.intersect1d(a, b).size


def mark(text):
    h = xxhash.xxh64((text or "").encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def expected(rows):
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, mark(x[1])), reverse=True)
    out = []
    for i, (id_, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = ({h for h, _ in by_hand(x)} for x in (text, edited, after))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out.append((id_, len(text), sha, w.as_text(np.array([h for h, _ in by_hand(text)], np.uint32)), w.as_text(np.array([h for h, _ in by_hand(edited)], np.uint32)), round(like(a, b), 9), round(like(a, c), 9)))
    return sorted(out, key=repr)


def got(df):
    return sorted([(*r[:5], round(r[5], 9), round(r[6], 9)) for r in df.collect()], key=repr)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(3, "one document alone, " * 9)],
        [(None, "no id"), (None, None), (5, ""), (5, "tie a"), (5, "tie b"), (5, "tie b"), (-1, "x" * 3000), (9, "é😀" * 40)],
        [(i, f"text number {i} " * (i % 13)) for i in range(200)],
    ],
)
def test_edits(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({}).selectExpr("*", "1 AS stretch", "2 AS own")
    assert got(w.with_edits(docs.repartition(3))) == expected(rows)


def test_positions_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some words here " * 5, 7)], "doc_id long, text string, hashes int")
    r = w.fingerprints(docs).first()
    assert list(zip(r["hashes"], r["positions"], strict=True)) == by_hand("some words here " * 5)


def test_one_id_is_cut_into_many_stretches(spark):
    rows = [(None, f"text number {i} " * 6) for i in range(300)] + [(7, f"other {i} " * 9) for i in range(300)] + [(1, "rest")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = [r["count"] for r in w.in_order(docs).where("NOT lent").groupBy("stretch").count().collect()]
    assert sum(parts) == len(rows) and len(parts) > 10 and max(parts) < 120
    assert got(w.with_edits(docs)) == expected(rows)


def test_ids_of_text(spark):
    rows = [(f"id \"{i}\", é", f"text number {i} " * 6) for i in range(40)]
    docs = spark.createDataFrame([*rows, (None, "none")], "doc_id string, text string")
    numbered = {id_: n for n, id_ in enumerate(sorted(r[0] for r in rows))}
    want = expected([(numbered[id_], text) for id_, text in rows] + [(None, "none")])
    assert got(w.with_edits(docs)) == sorted([({v: k for k, v in numbered.items()}.get(x[0]), *x[1:]) for x in want], key=repr)
