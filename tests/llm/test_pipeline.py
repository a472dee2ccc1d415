"""The pipeline's stages against plain code, stage by stage."""

import collections

import corpus_pipeline
from doclake.llm import mixing, quality
from doclake.llm.common import public_vocabulary, scratch
from tests.llm.test_operators import components

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    scratch(spark)  # sets a checkpoint folder where there is none
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: {x["doc_id"]: x["text"] for x in df.collect()}

    good = stages["quality classifier"](spark, docs, SMALL).checkpoint()
    labels = {x["doc_id"]: x["quality"] for x in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = texts(good)
    assert good.columns == docs.columns
    right = [(i in kept) == (q == 1) for i, q in labels.items()]
    assert sum(right) >= 0.95 * len(right)

    lines = stages["line dedup"](spark, good, SMALL).checkpoint()
    counts = collections.Counter(k for t in kept.values() for k in {x.strip(" \t\n\v\f\r").encode().lower() for x in t.split("\n")} if k)
    want = {i: "\n".join(x for x in t.split("\n") if counts[x.strip(" \t\n\v\f\r").encode().lower()] < 10) for i, t in kept.items()}
    assert texts(lines) == want and lines.columns == docs.columns

    near = stages["n-gram Jaccard join"](spark, lines, SMALL).checkpoint()
    ids = sorted(want)
    _, label = components([want[i] for i in ids])
    first = {}
    for i, x in zip(ids, label, strict=True):
        first.setdefault(x, i)
    assert set(texts(near)) == set(first.values()) and near.columns == docs.columns

    mixed = stages["mixing sources"](spark, near, SMALL).checkpoint()
    often = collections.Counter(x["doc_id"] for x in mixed.collect())
    report = {x["doc_id"]: x for x in mixing.mix_report(near).collect()}
    # of a document without words only the number of its copies shows, not the words taken
    assert all(often[i] * x["size"] == x["taken"] for i, x in report.items()) and set(often.values()) <= {1, 2}
    assert mixed.columns == docs.columns

    out = stages["byte-level BPE"](spark, mixed, SMALL)
    assert sorted((x["doc_id"], x["decoded"], len(x["ids"])) for x in out.collect()) == sorted((x["doc_id"], x["text"], n) for x, n in zip(mixed.collect(), token_counts(mixed), strict=True))


def token_counts(df):
    import public_tokenizers
    import tiktoken

    from doclake.llm.bpe import parse_ranks

    with open(public_vocabulary(corpus_pipeline.VOCABULARY), "rb") as f:
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=parse_ranks(f.read()), special_tokens={})
    return [len(own.encode_ordinary(x["text"])) for x in df.collect()]


def test_run_and_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0, name
    assert quality.KEEP_FROM == 0.5


CLASHES = "keep boolean, copies int, n_lines string, n_dropped int, k1 int, k2 int, drop_ int, of_source int, below int, s_id int, s_key int, quality_score string, `a.b` string, `c``d` string, `full` int, label int, cid int"
CLASH = (False, 7, "own", 3, 1, 2, 4, 5, 6, 8, 9, "mine", "dotted", "quoted", 10, 11, 12)


def test_stages_keep_clashing_columns(spark):
    """Columns with the names of results, of helpers, and with dots go through the stages as they are."""
    scratch(spark)
    rows = [(i, f"text number {i} of many words that differ {i * 7} {i * 11}\nshared", "en", f"s{i % 3}", 0, *CLASH) for i in range(30)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SMALL).checkpoint()
        assert len(docs.columns) == 5 + len(CLASH), name
        assert docs.count() and all(tuple(x)[5:] == CLASH for x in docs.collect()), name
    assert all("shared" not in x["text"] and x["n_chars"] == len(x["text"]) for x in docs.collect())
    assert corpus_pipeline.STAGES[4][1](spark, docs, SMALL).columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "decoded"]


def test_stages_with_nulls_repeats_and_long_texts(spark):
    """Each stage by itself on the same odd rows."""
    scratch(spark)
    long = " ".join(f"w{i % 5000}" for i in range(2_500_000))  # some 14 MB
    odd = [(1, None), (2, ""), (3, " \n "), (None, None), (None, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g"), (5, "x" * 1_000_000), (6, long), (7, long + " end")]
    docs = spark.createDataFrame([(i, t, None if (i or 0) % 2 else "en", None, None) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    pairs = lambda df: collections.Counter((x["doc_id"], x["text"]) for x in df.collect())
    assert not pairs(stages["quality classifier"](spark, docs, SMALL)) - pairs(docs)
    lines = stages["line dedup"](spark, docs, SMALL)
    assert pairs(lines) == collections.Counter((i, t or "") for i, t in odd)
    assert all(x["n_chars"] == len(x["text"]) for x in lines.collect())
    near = pairs(stages["n-gram Jaccard join"](spark, docs, SMALL))
    assert near == collections.Counter([(1, None), (2, ""), (3, " \n "), (None, None), (4, "a b c d e f g"), (5, "x" * 1_000_000), (6, long)])
    mixed, report = pairs(stages["mixing sources"](spark, docs, SMALL)), mixing.mix_report(docs).collect()
    assert sum(len((t or "").split()) * n for (_, t), n in mixed.items()) == sum(x["taken"] for x in report) and max(mixed.values()) <= 4
    out = stages["byte-level BPE"](spark, docs, SMALL).collect()
    assert collections.Counter((x["doc_id"], x["decoded"]) for x in out) == collections.Counter((i, t or "") for i, t in odd)
    assert all(x["n_tokens"] == len(x["ids"]) for x in out)
