"""Each operator against plain Python, with nulls, empty texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from doclake.llm import bpe, chat, exact_dedup, jaccard_join, line_dedup, lm_score, mixing, quality, token_rollup
from doclake.llm.common import public_vocabulary

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
VOCAB = public_vocabulary("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, n int, uid int, h int, key int, size int, ids string, keep int, batch int"
r = random.Random(5)
BASE = [
    (1, "a b  c\td e f g"), (2, "A b c d e f g"), (3, "a b c d e f g"), (4, None), (5, ""), (6, " \n "), (7, "one"), (7, "one"), (7, "two"), (None, "one"), (None, None),
    (8, "é😀 \x85x\xa0 y 's don't I'LL  \n\n\n end"), (9, "word " * 3000), (10, "x" * 9000), (11, "x" * 8999 + "y"), (12, "line one\n LINE ONE \r\nother\n\n"),
] + [(100 + i, f"shared line\nown {i}\n  Shared LINE\t\n{' '.join(r.choice('abcdefgh') for _ in range(i))}") for i in range(14)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s" if (i or 0) % 3 else None, 0, "n", 1, 2, 3, 4, 5, "z", 6, 7) for i, t in BASE]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(x[c] for c in columns) for x in df.collect()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, docs, empty, weak):
    from pyspark.sql import functions as F

    hash_ = (lambda c: F.octet_length(c).cast("long") % 2) if weak else F.xxhash64  # the weak one makes nearly all collide
    got = exact_dedup.exact_dedup(docs, 64 if weak else 4096, hash_)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in BASE:
        groups[norm(t)].append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    want = sorted([(i, least[norm(t)], len(groups[norm(t)]), sha(norm(t))) for i, t in BASE], key=repr)
    assert rows(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
    kept = [x for x in got.collect() if x["kept"]]
    assert len(kept) == len(groups) and all(x["doc_id"] == x["keep_id"] for x in kept)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_line_dedup(docs, empty):
    out = line_dedup.line_dedup(docs, min_docs=10)
    assert set(out.columns) == set(docs.columns) | {"n_lines", "n_dropped"}
    keys = lambda t: [x.strip(" \t\n\v\f\r").encode().lower() for x in (t or "").split("\n")]
    counts = collections.Counter(k for _, t in BASE for k in set(keys(t)) if k)
    want = []
    for i, t in BASE:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t), strict=True) if counts[k] < 10 or not k]
        want.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    assert rows(line_dedup.digest(out), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=repr)
    assert counts[b"shared line"] >= 10
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_runs_are_levelled(spark, tmp_path):
    runs = line_dedup.Runs(str(tmp_path), min_docs=3)
    batch = lambda keys: spark.createDataFrame([(k, 0, n) for k, n in keys], "h1 long, h2 long, n long")
    for b in ([(1, 2), (2, 1)], [(1, 1), (3, 1)], [(1, 9), (2, 1)], [(2, 1), (4, 3)]):
        runs.add(batch(b))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    # key 1 was settled after two batches, so later batches don't count it
    assert sorted(tuple(x) for x in runs.counts().collect()) == [(1, 0, 3), (2, 0, 3), (3, 0, 1), (4, 0, 3)]
    assert sorted(x[0] for x in runs.frequent().collect()) == [1, 2, 4]
    # a batch that is sent again is known, also to a later session, which then takes a real new arrival
    assert not runs.add(batch([(1, 5)]), 3)
    later = line_dedup.Runs(str(tmp_path), min_docs=3)
    assert later.runs == [(0, 3)] and later.buckets == runs.buckets and not later.add(batch([(1, 5)]), 0)
    with pytest.raises(ValueError):
        later.add(batch([(1, 5)]), 6)
    assert later.add(batch([(3, 2), (4, 9), (5, 1)]), 4) and [len(x) for x in later.levels] == [1, 0, 1]
    assert sorted(tuple(x) for x in later.counts().collect()) == [(1, 0, 3), (2, 0, 3), (3, 0, 3), (4, 0, 3), (5, 0, 1)]
    assert sorted(x[0] for x in later.frequent().collect()) == [1, 2, 3, 4]
    later.remove()
    assert line_dedup.Runs(str(tmp_path), min_docs=3).counts() is None


def test_line_runs_are_read_as_they_lie(spark, tmp_path):
    """The runs' side of the anti-join has no shuffle; a batch's counts have one."""
    runs = line_dedup.Runs(str(tmp_path / "runs"), min_docs=3)
    spark.range(1000).selectExpr("id AS h1", "id * 7 % 1000 AS h2", "1L AS n").write.parquet(str(tmp_path / "batch"))
    batch = spark.read.parquet(str(tmp_path / "batch"))
    for _ in range(3):
        runs.add(batch)
    new = runs.unsettled(batch.repartition(runs.buckets, "h1", "h2").groupBy("h1", "h2").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n"))
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SelectedBucketsCount") == 2, plan
    merged = runs.counts()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in merged and merged.count("SelectedBucketsCount") == 2, merged


def shingles(text):
    w = WORD.findall((text or "").encode().lower())
    return set() if not w else {tuple(w)} if len(w) < 5 else set(zip(*(w[i:] for i in range(5)), strict=False))


def components(texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * len(a | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return sets, label


def test_components_of_paths(spark, tmp_path):
    """Long paths, rings and stars with shuffled names, in few rounds."""
    from doclake.llm.components import components as connected

    q = random.Random(6)
    names = q.sample(range(10**6), 1300)
    groups = [names[:1000], names[1000:1200], names[1200:1290], names[1290:1292], names[1292:]]
    links = [*zip(groups[0], groups[0][1:], strict=False), *zip(groups[1], groups[1][1:] + groups[1][:1], strict=True), *((groups[2][0], x) for x in groups[2][1:]), tuple(groups[3]), *((b, a) for a, b in zip(groups[4], groups[4][1:], strict=False)), (groups[3][0], groups[3][1])]
    q.shuffle(links)
    got = {r["node"]: r["comp"] for r in connected(spark.createDataFrame(links, "a long, b long"), str(tmp_path)).collect()}
    assert got == {x: min(g) for g in groups for x in g}
    assert len(list(tmp_path.glob("least*"))) <= 12


def near_texts(seed):
    """Texts of many sizes and copies with edits, so that similarities lie on both sides of 0.8."""
    q = random.Random(seed)
    out = []
    for n in (1, 4, 5, 6, 8, 9, 12, 20, 40, 90, 300, 1200):
        base = [f"w{q.randrange(400)}" for _ in range(n)]
        out.append(" ".join(base))
        for edits in (0, 1, 1, 2, 3, 4, n // 60 + 1, n // 40 + 1):
            copy = list(base)
            for _ in range(edits):
                copy[q.randrange(n)] = f"v{q.randrange(10**6)}"
            out.append(" ".join(copy[: q.choice([n, n, n - 1]) or 1]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard_join, "ROOM_FROM", 0 if seed == 1 else 1000)
    texts = near_texts(seed) + [None, "", " "]
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets, label = components(texts)
    want = [(i, len(s), min(j for j, x in enumerate(label) if x == label[i])) for i, s in enumerate(sets)]
    assert rows(jaccard_join.near_components(data), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)


def test_jaccard_join_deals_out_no_documents(spark, monkeypatch):
    met = jaccard_join._met

    def small(table):
        assert table.num_rows < 300  # rows of packed pieces, which copies don't add to
        return met(table)

    monkeypatch.setattr(jaccard_join, "_met", small)
    copy = " ".join(f"w{i}" for i in range(60))
    near = " ".join(f"w{i}" for i in range(61))
    data = spark.createDataFrame([(i, copy) for i in range(700)] + [(i, " ") for i in range(700, 1400)] + [(1400, near)], "doc_id long, text string").repartition(3)
    got = rows(jaccard_join.near_components(data), "doc_id", "n_shingles", "component_id")
    assert got == sorted([(i, 56, 0) for i in range(700)] + [(i, 0, i) for i in range(700, 1400)] + [(1400, 57, 0)], key=repr)


def family(n, q):
    """Documents of 100 common words and a passage of 14 of their own each: no two are similar, nearly all share pieces."""
    common = [f"c{i}" for i in range(100)]
    return [" ".join([*common[: (at := q.randrange(101))], *[f"o{d}_{k}" for k in range(14)], *common[at:]]) for d in range(n)]


def test_jaccard_join_of_a_family_grows_with_its_size(spark, monkeypatch):
    """What meets in joins of pieces, of families just below the threshold: twice the documents, twice the rows."""
    q, made = random.Random(8), []
    crossed = jaccard_join.Join._crossed
    monkeypatch.setattr(jaccard_join, "ROOM_FROM", 1)
    monkeypatch.setattr(jaccard_join.Join, "_crossed", lambda self, own: (lambda out: made.append((own.count(), out.count())) or out)(crossed(self, own)))
    for n in (300, 600):
        texts = family(n, q)
        near = texts[0].replace("c0 ", "other ")
        data = spark.createDataFrame(list(enumerate([*texts, near])), "doc_id long, text string").repartition(3)
        got = jaccard_join.near_components(data).where("component_id <> doc_id").collect()
        assert [(r["doc_id"], r["component_id"]) for r in got] == [(n, 0)]
    (small, few), (large, more) = made
    assert small > 1000 and large <= 2.5 * small and few <= 300 and more <= 600, made


def test_near_dedup_keeps_the_same_row_of_equal_ids(spark):
    rows_ = [(1, "a b c d e f g", x) for x in "zyx"] + [(1, "a b c d e f g", "x"), (2, "a b c d e f g", "w"), (3, None, "u"), (3, None, "v"), (3, None, "v")]
    kept = [rows(jaccard_join.near_dedup(spark.createDataFrame(rows_, "doc_id long, text string, s string").repartition(p)), "doc_id", "s") for p in (1, 3, 5)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 3 and kept[0][1:] == [(3, "u"), (3, "v")]


def test_jaccard_join_edges(docs, empty):
    _, label = components([t for _, t in BASE])
    ids = [i for i, _ in BASE]
    want = [(i, min((ids[j] for j, x in enumerate(label) if x == label[k] and ids[j] is not None), default=None)) for k, i in enumerate(ids)]
    assert rows(jaccard_join.near_components(docs), "doc_id", "component_id") == sorted(want, key=repr)
    kept = jaccard_join.near_dedup(docs)
    assert kept.columns == docs.columns
    # one of each component; rows without words stay, repeated ones of them as one
    assert kept.count() == len({label[k] for k in range(len(ids))})
    assert jaccard_join.near_components(empty).count() == 0


def test_pigeonhole_keeps_every_similar_pair():
    import numpy as np

    q = random.Random(7)
    for _ in range(300):
        n = q.choice([5, 9, 10, 14, 23, 40, 77, 150, 400])
        a = np.unique(np.array([q.getrandbits(63) for _ in range(n)], np.uint64))
        lost, new = q.randrange(n // 9 + 1), q.randrange(n // 9 + 1)
        b = np.unique(np.append(a[lost:], np.array([q.getrandbits(63) for _ in range(new)], np.uint64)))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both) and len(a) + len(b) > 2 * both:
            with np.errstate(over="ignore"):
                assert np.intersect1d(jaccard_join.pieces(a)[0], jaccard_join.pieces(b)[0]).size
                apart = sum(bin(int(x) & (2**64 - 1)).count("1") for x in jaccard_join.sketch(a) ^ jaccard_join.sketch(b))
            assert apart <= len(a) + len(b) - 2 * both


def test_wide_sketches_bound_the_difference():
    import numpy as np

    q = random.Random(8)
    for n in (900, 1024, 1025, 2100, 5000):
        a = np.unique(np.array([q.getrandbits(63) for _ in range(n)], np.uint64))
        b = np.append(a[q.randrange(150) :], np.array([q.getrandbits(63) for _ in range(q.randrange(150))], np.uint64))
        far = np.array([q.getrandbits(63) for _ in range(n)], np.uint64)
        with np.errstate(over="ignore"):
            x, y, z = (jaccard_join.wide_sketch(s) for s in (a, b, far))
        assert jaccard_join.wide_apart(x, y) <= len(a) + len(b) - 2 * len(np.intersect1d(a, b))
        assert jaccard_join.wide_apart(x, z) > jaccard_join.may_differ(n, n)


def test_mixing(spark, docs, empty):
    q = random.Random(3)
    data = [(i, " ".join(["w"] * q.randrange(200)), f"s{i % 7}" if i % 11 else None) for i in range(600)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix_report(df)
    sizes = collections.Counter()
    for _, t, s in data:
        sizes[s] += len(t.split())
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    # the level of water: a target is its weight times it, or twice the source's size
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * sizes[s], weight[s] * mid) for s in names) < 1.5 * sum(sizes.values()) else (low, mid)
    taken = collections.Counter()
    for x in got.collect():
        src = next(s for i, _, s in data if i == x["doc_id"])
        assert x["source_size"] == sizes[src] and math.isclose(x["target"], min(2 * sizes[src], weight[src] * low), rel_tol=1e-6)
        assert x["size"] == len(data[x["doc_id"]][1].split()) and x["taken"] in (0, x["size"], 2 * x["size"])
        taken[src, x["target"]] += x["taken"]
    assert all(abs(v - t) <= 100 for (_, t), v in taken.items())
    assert rows(got, *got.columns) == rows(mixing.mix_report(df.repartition(5)), *got.columns)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and sum(len(x["text"].split()) for x in mixed.collect()) == sum(taken.values())
    assert mixing.mix_report(docs).count() == len(BASE) and mixing.mix(docs).columns == docs.columns
    assert mixing.mix_report(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_bpe(docs, empty):
    import public_tokenizers
    import tiktoken

    with open(VOCAB, "rb") as f:
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(f.read()), special_tokens={})
    got = bpe.decode(bpe.encode(docs, VOCAB), VOCAB).collect()
    assert sorted((x["text"] or "", x["ids"]) for x in got) == sorted((t or "", own.encode_ordinary(t or "")) for _, t in BASE)
    for x in got:
        data = (x["text"] or "").encode()
        assert bytes(x["decoded"]) == data and x["n_tokens"] == len(x["ids"])
        ends = [*x["offsets"][1:], len(data)]
        assert [data[a:b] for a, b in zip(x["offsets"], ends, strict=False)] == [own.decode_single_token_bytes(i) for i in x["ids"]]
    one = bpe.round_trip(docs, VOCAB)
    assert set(one.columns) == set(docs.columns) - {"text"} | {"n_tokens", "ids", "ids_le", "decoded"}
    assert rows(one, "doc_id", "ids", "ids_le", "decoded", "name") == rows(bpe.decode(bpe.encode(docs, VOCAB), VOCAB), "doc_id", "ids", "ids_le", "decoded", "name")
    sha_of = lambda x: hashlib.sha256(bytes(x)).hexdigest()
    want = sorted([(x["doc_id"], x["n_tokens"], sha_of(x["ids_le"]), sha_of(x["decoded"])) for x in got], key=repr)
    assert rows(bpe.digest(docs, VOCAB), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.digest(empty, VOCAB).count() == 0 and bpe.decode(bpe.encode(empty, VOCAB), VOCAB).count() == 0


def test_pieces_against_the_pattern():
    import numpy as np
    import public_tokenizers
    import regex

    q, rule = random.Random(2), regex.compile(public_tokenizers.PATTERN)
    for _ in range(2000):
        text = "".join(q.choice(" \n\t'srevlmdtA1é,!\xa0　😀x²") for _ in range(q.randrange(1, 90)))
        points = np.frombuffer((text + "\0").encode("utf-32-le"), np.uint32)
        at = bpe.starts(bpe.classes(points, np.array([len(text)]))).tolist()
        assert [text[a:b] for a, b in zip(at, at[1:], strict=False)] == rule.findall(text)


def test_chat(spark):
    said = ["\\### Assistant: </turn> ok", "", None, "a\\b\\l<#:\\\\", "multi\nline", "### user: x</turn>\n", "é😀"]
    data = [(c, t, role, said[(c * 3 + t) % 7]) for c in range(6) for t, role in enumerate(["system", "user", "user", "assistant", None, "assistant", "assistant", "a:b#\\"])]
    data += [(None, 1, "user", "n"), (None, 1, "assistant", "tie"), (None, 1, "assistant", "tie"), (9, None, "user", "only")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS turns", "2 AS loss")
    chats = chat.format_chats(df.repartition(3))
    conv = collections.defaultdict(list)
    for c, t, role, text in data:
        conv[c].append((t is not None, t or 0, role or "", text or ""))
    for x in chat.read_back(chats).collect():
        own, merged = sorted(conv.pop(x["conv_id"])), []
        for _, _, role, text in own:
            if merged and merged[-1][0] == role:
                merged[-1] = (role, merged[-1][1] + "\n" + text)
            else:
                merged.append((role, text))
        assert [tuple(t) for t in x["turns"]] == merged
        assert x["loss_text"] == "".join(text for _, _, role, text in own if role == "assistant")
    assert not conv
    assert chat.digest(chat.format_chats(df.where("false"))).count() == 0


def test_chat_with_many_turns_and_long_texts(spark):
    """Spans over many blocks, and time about in proportion to the turns."""
    import time

    q = random.Random(6)

    def chats(n):
        return [(1, t, q.choice(["user", "assistant"]), "é<#" * q.choice([0, 1, 5])) for t in range(n)]

    texts = {1: chats(3000), 2: [(2, 0, "user", "a" * 5000), (2, 1, "assistant", "b😀" * 400_000), (2, 2, "assistant", ""), (2, 3, "assistant", "c")]}
    df = spark.createDataFrame([r for own in texts.values() for r in own], "conv_id long, turn long, role string, text string")
    for x in chat.read_back(chat.format_chats(df)).collect():
        assert x["loss_text"] == "".join(t for _, _, role, t in texts[x["conv_id"]] if role == "assistant")
    took = []
    for n in (20_000, 40_000):
        data = spark.createDataFrame(chats(n), "conv_id long, turn long, role string, text string")
        began = time.time()
        assert chat.digest(chat.format_chats(data)).first()["formatted_chars"] > n
        took.append(time.time() - began)
    assert took[1] < 3 * took[0] + 5


def test_long_words_in_bounded_memory(spark, tmp_path):
    import tracemalloc

    import numpy as np

    pieces = lm_score.pieces_of(open(VOCAB, "rb").read())
    logp = np.append(np.log(np.linspace(1, 2, pieces.size) / pieces.size / 2), -np.inf)
    word = b" " + b"ab=x" * 3000
    for span in (1, 7, 200, 1 << 20):
        one, two = np.zeros(pieces.size + 1), np.zeros(pieces.size + 1)
        assert lm_score._alone(word, pieces, logp, one, 2.0, span) == lm_score._alone(word, pieces, logp, two, 2.0) and np.allclose(one, two)
    tracemalloc.start()
    lm_score._alone(b"=" * 200_000, pieces, logp, np.zeros(pieces.size + 1))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40_000_000  # two numbers a byte, and one span
    said = [(i, "a few words here") for i in range(20)] + [(100, "x" * 300_000 + " end")]
    got = lm_score.score_documents(spark.createDataFrame(said, "doc_id long, text string"), VOCAB).where("doc_id = 100").first()
    assert got["n_tokens"] == 3 and -3e6 < got["score"] < 0


def lattice(word, pieces, logp):
    """The sum over all cuts, by listing them."""
    if not word:
        return 1.0
    return sum(math.exp(logp[k]) * lattice(word[n:], pieces, logp) for n in range(1, len(word) + 1) if (k := pieces.index.get(word[:n])) is not None)


def test_lattice_sums_over_all_cuts():
    import numpy as np

    with open(VOCAB, "rb") as f:
        pieces = lm_score.Pieces(f.read())
    logp, _ = lm_score._log_shares(pieces.guess, 0.1, pieces.leads)
    words = [b"the", b"x", b"tionthe", "été".encode(), b"ing" * 4, b"a" * 60]
    got, counts = lm_score.word_logprobs(words, pieces, logp), np.zeros(pieces.size + 1)
    for w, v in zip(words[:-1], got, strict=False):
        assert math.isclose(math.exp(v), lattice(b" " + w, pieces, logp), rel_tol=1e-9)
    alone = lm_score._alone(b" " + words[0], pieces, logp, None)
    assert math.isclose(alone, got[0], rel_tol=1e-9)
    # expected pieces of a word cover its bytes exactly
    lm_score.word_logprobs(words, pieces, logp, counts)
    assert math.isclose(sum(len(p) * c for p, c in zip(pieces.pieces, counts, strict=False)), sum(len(w) + 1 for w in words), rel_tol=1e-9)


def test_long_words_have_the_same_lattice():
    import numpy as np

    with open(VOCAB, "rb") as f:
        pieces = lm_score.Pieces(f.read())
    logp, _ = lm_score._log_shares(pieces.guess, 0.1, pieces.leads)
    word = b"internationalisations"
    one, two = np.zeros(pieces.size + 1), np.zeros(pieces.size + 1)
    lm_score.word_logprobs([word], pieces, logp, one, np.array([3.0]))
    assert math.isclose(lm_score._alone(b" " + word, pieces, logp, two, 3.0), lm_score.word_logprobs([word], pieces, logp)[0], rel_tol=1e-9)
    assert np.allclose(one, two)
    far = lm_score._alone(b" " + b"ab" * 100_000, pieces, logp, None)
    assert math.isfinite(far) and far < lm_score._alone(b" " + b"ab" * 50_000, pieces, logp, None) < 0


def cuts(word, pieces):
    """All ways to cut a word, as tuples of pieces."""
    if not word:
        return [()]
    return [(word[:n], *rest) for n in range(1, len(word) + 1) if word[:n] in pieces for rest in cuts(word[n:], pieces)]


def test_lm_score_sums_over_all_cuts(spark, tmp_path):
    """The whole score against plain code that lists every cut of every word, in each round of learning too."""
    import base64

    own = [b" a", b" b", b" ab", b"ab", b"ba", b"bab", b" ba", b"aa", b"\n ab", b" a b"]  # the last two can't be used
    vocab = tmp_path / "own.tiktoken"
    vocab.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % i for i, p in enumerate(own)))
    data = [(i, t) for i, t in enumerate(["ab ba", "abab\tA", "b", None, "", "aab aab bb", "ba c", "abba ab", "ab", "a b a"] * 2)]
    got = {x["doc_id"]: x["score"] for x in lm_score.score_documents(spark.createDataFrame(data, "doc_id long, text string").repartition(3), str(vocab), rounds=2).collect()}
    single = [bytes([b]) for b in range(256) if b == 32 or bytes([b]) not in (b"\t", b"\n", b"\v", b"\f", b"\r")]
    pieces = {p: i for i, p in enumerate([*single, *own[:8]])}
    words = {i: (t or "").encode().lower().split() for i, t in data}
    train = [i for i in words if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = collections.Counter(w for i in train for w in words[i])
    ranks = {p: i for i, p in enumerate(own)}
    expected, stops = {p: 1 / (ranks.get(p, len(own)) + 100) for p in pieces}, sum(1 / (ranks.get(p, len(own)) + 100) for p in pieces) / 4
    for turn in range(3):
        held = {p: n + lm_score.PRIOR for p, n in expected.items()}
        leads, later = sum(n for p, n in held.items() if p[:1] == b" "), sum(n for p, n in held.items() if p[:1] != b" ") + stops + lm_score.PRIOR
        prob = {p: n / (leads if p[:1] == b" " else later) for p, n in held.items()}
        stop = (stops + lm_score.PRIOR) / later
        assert math.isclose(sum(v for p, v in prob.items() if p[:1] == b" "), 1) and math.isclose(sum(v for p, v in prob.items() if p[:1] != b" ") + stop, 1)
        if turn == 2:
            break
        expected, stops = dict.fromkeys(pieces, 0.0), float(sum(counts.values()))
        for w, c in counts.items():
            ways = [(way, math.prod(prob[p] for p in way)) for way in cuts(b" " + w, pieces)]
            for way, weight in ways:
                for p in way:
                    expected[p] += c * weight / sum(x for _, x in ways)
    n, ends = sum(counts.values()), len(train)
    word = lambda w: (n + 1) / (n + ends + 2) * sum(math.prod(prob[p] for p in way) for way in cuts(b" " + w, pieces)) * stop / (1 - prob[b" "] * stop)
    for i, own_words in words.items():
        want = sum(math.log10(word(w)) for w in own_words) + math.log10((ends + 1) / (n + ends + 2))
        assert math.isclose(got[i], want, rel_tol=1e-9), (i, got[i], want)
    # all words and the end sum to 1: what words of up to two bytes have, and what is left to longer ones
    begin, end = map(math.exp, lm_score.word_and_end(n, ends))
    assert math.isclose(begin + end, 1) and sum(word(bytes([x])) for x in range(256) if bytes([x]) in pieces and x != 32) < begin


def test_lm_score(docs, empty):
    got = lm_score.score_documents(docs, VOCAB, rounds=2).collect()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    words = [(i, WORD.findall((t or "").encode().lower())) for i, t in BASE]
    counts, ends = collections.Counter(), 0
    for i, w in words:
        if not held(i):
            counts.update(w)
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    want = [
        (i, held(i), len(w) + 1, sum(counts[k] > 0 for k in w) + 1, n, round(sum(math.log10((counts[k] + 1) / (n + v)) for k in w) + math.log10((ends + 1) / (n + v)), 6))
        for i, w in words
    ]
    assert sorted([(*x[:5], round(x["base_score"], 6)) for x in got], key=repr) == sorted(want, key=repr)
    assert all(math.isfinite(x["score"]) and x["score"] < 0 for x in got)
    by_text = collections.defaultdict(set)
    for x in got:
        by_text[x["doc_id"]].add(round(x["score"], 9))
    assert len(by_text[7]) == 2
    assert lm_score.score_documents(empty, VOCAB).count() == 0


def test_quality(spark, docs, empty):
    q = random.Random(1)
    good = lambda: " ".join("".join(q.choice("abcdefghij") for _ in range(q.randrange(2, 8))) for _ in range(60)).capitalize() + "."
    bad = lambda: " ".join([good().upper().replace(" ", "!! ")] if q.random() < 0.5 else ["spam now |"] * 40)
    data = [(i, bad() if i % 4 == 0 else good(), "en", f"s{i % 5}") for i in range(800)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), None) for i in range(400)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    got = {x["doc_id"]: x for x in quality.score(df, model).collect()}
    assert sum(got[i]["keep"] == (i % 4 > 0) for i in range(400, 800)) >= 392  # held out
    again = {x["doc_id"]: x["quality_score"] for x in quality.score(df.repartition(5), quality.train(df.repartition(2), labels)).collect()}
    assert all(abs(again[i] - got[i]["quality_score"]) < 1e-6 for i in got)
    assert quality.score(docs, model).count() == len(BASE)
    assert quality.score(empty, quality.train(empty, labels)).count() == 0
    assert all(x["keep"] for x in quality.score(docs, quality.train(docs, labels.where("false"))).collect())


def plain_logistic(x, y, ridge):
    """Standardised logistic regression with a ridge on all but the offset, by Newton steps in plain Python; gives a function to log odds."""
    n, k = len(x), len(x[0])
    mean = [sum(r[j] for r in x) / n for j in range(k)]
    scale = [math.sqrt(sum((r[j] - mean[j]) ** 2 for r in x) / n) for j in range(k)]
    z = [[(r[j] - mean[j]) / (scale[j] if scale[j] > 1e-6 else 1e9) for j in range(k)] + [1.0] for r in x]
    w = [0.0] * (k + 1)
    for _ in range(60):
        p = [1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(w, r, strict=True)))))) for r in z]
        slope = [sum(r[j] * (q - t) for r, q, t in zip(z, p, y, strict=True)) + (ridge if j < k else 1e-6) * w[j] for j in range(k + 1)]
        bend = [[sum(r[i] * r[j] * (q * (1 - q) + 1e-6) for r, q in zip(z, p, strict=True)) + (i == j) * (ridge if j < k else 1e-6) for j in range(k + 1)] + [slope[i]] for i in range(k + 1)]
        for i in range(k + 1):  # elimination
            top = max(range(i, k + 1), key=lambda r: abs(bend[r][i]))
            bend[i], bend[top] = bend[top], bend[i]
            for r in range(k + 1):
                if r != i:
                    f = bend[r][i] / bend[i][i]
                    bend[r] = [a - f * b for a, b in zip(bend[r], bend[i], strict=True)]
        w = [a - bend[i][k + 1] / bend[i][i] for i, a in enumerate(w)]
    return lambda r: max(-30, min(30, sum(a * (v - m) / (s if s > 1e-6 else 1e9) for a, v, m, s in zip(w, r, mean, scale, strict=False)) + w[k]))


@pytest.mark.parametrize("seed", [1, 2])
def test_cotraining_rounds(seed):
    """Pseudo-labels, calibration and combination against plain Python, round by round."""
    import numpy as np

    q = random.Random(seed)
    draw = lambda good: ([q.gauss(1.6 * good, 1), q.gauss(0, 1), q.gauss(-good, 1)], [q.gauss(1.2 * good, 1), q.gauss(good, 1)])
    y = [i % 2 for i in range(120)]
    rows, pool = [draw(v) for v in y], [draw(q.randrange(2)) for _ in range(200)]
    apart = [i % 4 == 0 for i in range(120)]
    text, meta, pool_text, pool_meta = (np.array(v) for v in (*zip(*rows, strict=True), *zip(*pool, strict=True)))
    model = quality.CoTrained().fit(text, meta, np.array(y, float), np.array(apart), pool_text, pool_meta, rounds=3)

    known = [[(r[v], t) for r, t, a in zip(rows, y, apart, strict=True) if not a] for v in (0, 1)]
    kept, free, given = [(r, t) for r, t, a in zip(rows, y, apart, strict=True) if a], set(range(200)), []
    for turn in range(4):
        views = []
        for v in (0, 1):
            raw = plain_logistic([x for x, _ in known[v]], [t for _, t in known[v]], 1.0)
            scale = plain_logistic([[raw(r[v])] for r, _ in kept], [t for _, t in kept], 1e-3)
            views.append(lambda x, raw=raw, scale=scale: scale([raw(x)]))
        if turn == 3 or not free:
            break
        for v in (0, 1):
            p = {i: 1 / (1 + math.exp(-views[v](pool[i][v]))) for i in range(200)}
            for label in (1, 0):
                sure = sorted((i for i in free if (p[i] >= quality.SURE if label else p[i] <= 1 - quality.SURE)), key=lambda i: (abs(p[i] - label), i))[: quality.MOST]
                known[1 - v] += [(pool[i][1 - v], label) for i in sure]
                free -= set(sure)
                given.append(len(sure))
    both = plain_logistic([[views[0](r[0]), views[1](r[1])] for r, _ in kept], [t for _, t in kept], 1e-2)
    assert sum(given) > 20  # each view has taught the other something
    for got, view, v in zip(model.score(pool_text, pool_meta)[:2], views, (0, 1), strict=True):
        assert np.allclose(got, [1 / (1 + math.exp(-view(r[v]))) for r in pool], atol=1e-4)
    assert np.allclose(model.score(pool_text, pool_meta)[2], [1 / (1 + math.exp(-both([views[0](r[0]), views[1](r[1])]))) for r in pool], atol=1e-4)


def test_quality_sample_is_bounded(spark, monkeypatch):
    """Many rows of null ids and of one id: the sample that comes to the driver stays small, scores come for all."""
    rows = [(None, "same text") for _ in range(500)] + [(1, f"text {i}") for i in range(500)] + [(i, f"good text {i}." if i % 2 else "BAD!! " * 9) for i in range(2, 200)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 200)], "doc_id long, quality int")
    seen, fit = [], quality.CoTrained.fit
    monkeypatch.setattr(quality.CoTrained, "fit", lambda self, text, meta, y, apart, pool_text, pool_meta: seen.append(len(text) + len(pool_text)) or fit(self, text, meta, y, apart, pool_text, pool_meta))
    model = quality.train(docs, labels, max_labelled=60, max_pool=40)
    assert seen and seen[0] <= 200 and quality.score(docs, model).count() == len(rows)


def test_token_rollup(spark, tmp_path):
    roll = token_rollup.Rollup(spark, str(tmp_path))
    one = spark.createDataFrame([("a", "en", "v1", 10), ("a", "en", "v1", None), (None, None, "v1", 3), ("b", "de", "v1", 7)], "source string, lang string, version string, n_tokens long")
    new = spark.createDataFrame([("a", "en", "v1", 4)], one.schema)
    assert roll.apply(1, token_rollup.inserted(one)) and not roll.apply(1, token_rollup.inserted(one))
    assert roll.apply(2, token_rollup.revised(one.where("n_tokens = 10"), new))
    assert roll.apply(3, token_rollup.deleted(one.where("source = 'b'"))) and roll.apply(4, one.where("false").selectExpr("*", "1 AS sign"))
    assert sorted((tuple(x) for x in roll.totals().collect()), key=repr) == sorted([("a", "en", "v1", 2, 4), (None, None, "v1", 1, 3)], key=repr)
    # a batch that was broken off leaves no _SUCCESS and is written again
    (tmp_path / "batch_id=3" / "_SUCCESS").unlink()
    assert roll.apply(3, token_rollup.deleted(one.where("source = 'b'")))
    assert token_rollup.Rollup(spark, str(tmp_path / "none")).totals().count() == 0


def test_token_rollup_snapshots(spark, tmp_path):
    schema = "source string, lang string, version string, n_tokens long, sign int, n_docs int"
    roll = token_rollup.Rollup(spark, str(tmp_path))
    change = lambda n, sign=1: spark.createDataFrame([("a", "en", "v1", n, sign, 77), (None, None, "v1", n, sign, 77)], schema)
    want = lambda docs, tokens: sorted([("a", "en", "v1", docs, tokens), (None, None, "v1", docs, tokens)], key=repr)
    got = lambda *upto: sorted((tuple(x) for x in roll.totals(*upto).collect()), key=repr)
    assert roll.apply(1, change(5)) and roll.apply(2, change(7)) and roll.compact(2) and not roll.compact(2)
    assert roll.apply(3, change(5, -1)) and not roll.apply(2, change(7)) and got() == want(1, 7) and got(2) == want(2, 12) and got(1) == want(1, 5)
    # a snapshot that was broken off is not read, and written again later
    assert roll.compact(3)
    (tmp_path / "snapshot=3" / "_SUCCESS").unlink()
    next((tmp_path / "snapshot=3").glob("part-*")).unlink()
    assert got() == want(1, 7) and roll.compact(3) and got() == want(1, 7)
    assert roll.apply(4, change(7, -1)) and got() == []
    with pytest.raises(ValueError):
        roll.apply(0, change(1))


def test_token_rollup_history(spark, docs, empty):
    labels = spark.createDataFrame([(7, 1, 1), (9, 0, None), (12, 0, 1), (12, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    bad, toxic, want = {9, 12}, {7, 12}, collections.Counter()
    for i, t in BASE:
        if i not in bad:
            key = (i or 0) % 3 and "s" or None
            text = (t or "").partition("\n")[2] if i in toxic else t or ""
            for version, n in (("words-1", len(WORD.findall(text.encode()))), ("letters-2", len(re.findall("[A-Za-z]+", t or "")))):
                want[key, "en", version, "n"] += n
                want[key, "en", version, "d"] += 1
    got = token_rollup.history(docs, labels).collect()
    assert {(x["source"], x["lang"], x["version"]): (x["n_docs"], x["n_tokens"]) for x in got} == {k[:3]: (v, want[*k[:3], "n"]) for k, v in want.items() if k[3] == "d"}
    assert token_rollup.history(empty, labels).count() == 0
