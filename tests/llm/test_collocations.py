"""Phrase collocations against plain Python."""

import collections
import random
import re

import pytest

from doclake.llm import collocations

SCHEMA = "text string, lang string, w string, h int, f int, n int, part int, keys int"
r = random.Random(11)
WORDS = [f"w{i}" for i in range(12)] + ["É", "ö\xa0x", "\x85", "the", "The"]


def text():
    out = []
    for _ in range(r.choice([0, 1, 30, 300])):
        out.append(r.choices(WORDS, weights=[5] * 12 + [1, 1, 1, 20, 10])[0] if r.random() < 0.8 else "new york city hall")
        out.append(r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "?", " ,", "\x0b"]))
    return "".join(out)


DOCS = [(text(), r.choice(["en", "de", None, ""])) for _ in range(120)] + [(None, "en"), ("", None), (" ..\n", "en"), ("copy of a line\n" * 3, "en")] * 3 + [("la " * 3000, "fr")]
DOCS.append((" ".join(r.choices(WORDS, k=5000)), "de"))


def plain(docs, least, top, cover=100):
    fold = lambda t: t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for t, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold(t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        gone = {g[i : i + k] for g, a in cand.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * a >= cover * counts[g[i : i + k]]}
        rows = []
        for g, a in cand.items():
            if g not in gone:
                score, _, left, rest = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), left, rest))
        for i, (score, a, g, left, rest) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, i, g.decode(), -a, left, rest, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "hot", "bits"), [(5, 2000, 1_000_000, 20), (100, 7, 1_000_000, 20), (5, 2000, 40, 6)])
def test_collocations(spark, least, top, hot, bits):
    """Hot pairs dealt out further, and a filter so small that it lets nearly all pass, change nothing."""
    docs = spark.createDataFrame([(*d, "w", 1, 2, 3, 4, 5) for d in DOCS], SCHEMA).repartition(3)
    got = collocations.collocations(docs, least, top, hot=hot, filter_bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(DOCS, least, top)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 5


def test_cover_and_empty(spark):
    docs = spark.createDataFrame(DOCS, "text string, lang string")
    assert sorted(map(tuple, collocations.collocations(docs, 20, 2000, cover=60, filter_bits=20).collect())) == plain(DOCS, 20, 2000, 60)
    assert collocations.collocations(docs.limit(0), filter_bits=20).count() == 0


def test_runs_and_few_known_words(monkeypatch):
    """Long texts in runs, and a task that forgets its words, give the same places."""
    import numpy as np

    def places(**sizes):
        for k, v in sizes.items():
            monkeypatch.setattr(collocations, k, v)
        seen = collections.Counter()

        def give(lang, numbers, known):
            words = [known.words[i] for i in numbers.tolist()]
            for i in range(len(words) - collocations.DEPTH + 1):
                own = []
                for w in words[i : i + collocations.DEPTH]:
                    if w == collocations.BREAK:
                        break
                    own.append(w)
                if own:
                    seen[lang, tuple(own)] += 1
            yield np.sum(numbers)

        held = collocations.Held(0, give)
        for t, lang in DOCS:
            list(held.add(lang or "und", t or ""))
        list(held.flush())
        return seen

    whole = places(RUN=1 << 20, HELD=1 << 20, KNOWN=400_000)
    assert places(RUN=50, HELD=10, KNOWN=400_000) == whole
    assert places(RUN=7, HELD=100, KNOWN=9) == whole


def test_a_shared_hash_is_found(spark, monkeypatch, tmp_path):
    """Under the first seed two words share a hash, so the next one is taken."""
    given = collocations._given_words

    def short(lang, numbers, known):
        known.hashes = [h % (16 if known.seed == 0 else 1 << 60) for h in known.hashes]
        yield from given(lang, numbers, known)

    monkeypatch.setattr(collocations, "_given_words", short)
    rows = spark.createDataFrame([(" ".join(f"w{i}" for i in range(40)), "en")], "text string, lang string")
    words, seed = collocations.word_counts(rows, str(tmp_path))
    assert seed == 1 and words.count() == 40


def test_sorted_counts():
    import numpy as np

    rows = [tuple(r.choices(range(1, 5), k=k)) + (0,) * (5 - k) for k in r.choices([1, 2, 3, 4, 5], k=3000)]
    weights = np.array(r.choices([1, 2, 50], k=3000))
    want = collections.Counter()
    for row, w in zip(rows, weights.tolist(), strict=True):
        for k in range(2, 6):
            if 0 not in row[:k]:
                want[row[:k]] += w
    columns = [np.array([x[d] for x in rows], np.uint64) for d in range(5)]
    for least in (1, 700, 5000):
        got = dict(collocations.sorted_counts(columns, weights, least))
        assert got == {k: v for k, v in want.items() if v >= least}
