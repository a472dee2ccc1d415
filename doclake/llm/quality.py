"""Quality classifier by co-training.

Two views of a document: its text (class bigrams of code points, repetition, hashed words) and its page's metadata
(source, language, length). A logistic regression on each view learns from labelled rows; over some rounds each
labels the unlabelled rows it is sure of for the other; then both are calibrated on labelled rows set apart, and
combined by a logistic regression of the calibrated views. A view that knows nothing is never sure and gets no
weight. The combined model scores every document.

The models are fitted on the driver on a bounded sample: about MAX_LABELLED labelled and MAX_POOL other rows, chosen
by a hash of the id (of the others, of the text too); only where many rows share ids, twice as many cut it off. Scoring covers all rows and shuffles nothing.

Defined results: a null text counts as empty, null metadata as values of their own; a document whose labels differ
counts as bad; null labels don't count; without labels of both kinds nothing is rejected and every score is 1;
rows are scored one by one, so ties and repeated rows need no rule, and rows of the sample that have equal features
and labels teach once; an empty table gives no rows; columns of the input with the names of results are replaced, but
kept() adds none and leaves all as they are; very long texts are read whole.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import appended, columns, named_back, plain_named, quoted, slices, trimmed, typed, unused, without

MAX_LABELLED, MAX_POOL = 10_000, 6_000
ROUNDS = 3
#: A view is sure of rows with a calibrated probability of SURE for one class; it labels MOST of a class a round.
SURE, MOST = 0.97, 400
#: Bytes of text whose features are held at once.
SLICE = 1 << 19
#: A document with a lower score is rejected.
KEEP_FROM = 0.5
WORD_BINS, SOURCE_BINS, LANG_BINS, LENGTH_BINS = 256, 64, 16, 24
#: Classes of code points: the ASCII ones as listed, then letters beyond ASCII and the rest.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:?", "'\"()-", "|", "!")
KINDS = len(CLASSES) + 2
TEXT_SIZE, META_SIZE = KINDS * KINDS + 8 + WORD_BINS, SOURCE_BINS + LANG_BINS + LENGTH_BINS


def _class_table():
    import numpy as np

    out = np.full(256, KINDS - 1, np.uint8)
    for i, chars in enumerate(CLASSES):
        out[[ord(c) for c in chars]] = i
    out[0xC0:] = KINDS - 2
    return out


def text_features(text: str):
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _TABLE[np.minimum(points, 255)]
    out = np.zeros(TEXT_SIZE, np.float32)
    if len(kinds) > 1:
        out[: KINDS * KINDS] = np.bincount(kinds[:-1] * np.uint8(KINDS) + kinds[1:], minlength=KINDS * KINDS) / (len(kinds) - 1)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    n, lines = len(words), text.split("\n")
    if n:
        most = sorted(counts.values())
        out[KINDS * KINDS : KINDS * KINDS + 8] = (
            np.log1p(n), len(counts) / n, most[-1] / n, sum(most[-5:]) / n, np.log1p(n / len(counts)),
            len(text) / n, len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)),
        )
        at = np.array([zlib.crc32(w) % WORD_BINS for w in counts])
        out[KINDS * KINDS + 8 :] = np.sqrt(np.bincount(at, np.array(list(counts.values()), float), WORD_BINS) / n)
    return out


_TABLE = None


def _ready():
    """The class table, once a worker."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _class_table()


def meta_features(source: str | None, lang: str | None, length: int):
    import numpy as np

    out = np.zeros(META_SIZE, np.float32)
    out[zlib.crc32(repr(source).encode()) % SOURCE_BINS] = 1
    out[SOURCE_BINS + zlib.crc32(repr(lang).encode()) % LANG_BINS] = 1
    out[SOURCE_BINS + LANG_BINS + min(LENGTH_BINS - 1, length.bit_length())] = 1
    return out


def _views(part, texts):
    """The two feature matrices of a slice."""
    import numpy as np

    _ready()
    sources, langs = part.column("source").to_pylist(), part.column("lang").to_pylist()
    rows = zip(sources, langs, texts, strict=True)
    return np.stack([text_features(t) for t in texts]), np.stack([meta_features(s, g, len(t)) for s, g, t in rows])


class Logistic:
    """Logistic regression with a ridge, by Newton steps on standardised features."""

    def __init__(self, ridge: float = 1.0):
        self.ridge = ridge

    def fit(self, x, y, steps: int = 12):
        import numpy as np

        self.mean, self.scale = x.mean(0), x.std(0)
        self.scale[self.scale < 1e-6] = 1e9  # a constant feature has no say
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        w = np.zeros(z.shape[1])
        ridge = np.full(len(w), self.ridge)
        ridge[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = z.T @ (p - y) + ridge * w
            bend = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(bend, slope)
            w -= step
            if np.abs(step).max() < 1e-5:
                break
        self.w = w
        return self

    def logit(self, x):
        import numpy as np

        return np.clip((x - self.mean) / self.scale @ self.w[:-1] + self.w[-1], -30, 30)


def _probability(logit):
    import numpy as np

    return 1 / (1 + np.exp(-logit))


class CoTrained:
    """Both views' models, their calibrations and the combination."""

    def fit(self, text, meta, y, apart, pool_text, pool_meta, rounds: int = ROUNDS):
        """text, meta, y: labelled rows, of which `apart` marks those for calibration; pool_*: unlabelled rows."""
        import numpy as np

        known = [(text[~apart], y[~apart]), (meta[~apart], y[~apart])]
        views, pools, free = (text, meta), (pool_text, pool_meta), np.ones(len(pool_text), bool)
        for turn in range(rounds + 1):
            self.models = [Logistic().fit(x, v) for x, v in known]
            # two numbers each: slope and offset of the view's log odds
            self.scales = [Logistic(1e-3).fit(m.logit(v[apart])[:, None], y[apart]) for m, v in zip(self.models, views, strict=True)]
            if turn == rounds or not free.any():
                break
            for own in (0, 1):
                p = _probability(self.view(own, pools[own]))
                for label, sure in ((1.0, p >= SURE), (0.0, p <= 1 - SURE)):
                    at = np.flatnonzero(sure & free)
                    at = at[np.argsort(np.abs(p[at] - label), kind="stable")][:MOST]
                    x, v = known[1 - own]
                    known[1 - own] = np.vstack([x, pools[1 - own][at]]), np.append(v, np.full(len(at), label))
                    free[at] = False
        both = np.stack([self.view(0, text[apart]), self.view(1, meta[apart])], 1)
        self.last = Logistic(1e-2).fit(both, y[apart])
        return self

    def view(self, own: int, x):
        return self.scales[own].logit(self.models[own].logit(x)[:, None])

    def score(self, text, meta):
        """Probabilities of good by text, by metadata, and by both."""
        import numpy as np

        logits = np.stack([self.view(0, text), self.view(1, meta)], 1)
        return _probability(logits[:, 0]), _probability(logits[:, 1]), _probability(self.last.logit(logits))


def _share(bound: int, many: int, *more: str) -> Column:
    """Whether a row is of the sample of about `bound` of `many`, by a hash of its id and of other columns."""
    return F.pmod(F.xxhash64(F.lit("quality"), F.col("doc_id").cast("string"), *more), F.lit(1 << 30)) < int((1 << 30) * min(1.0, bound / max(1, many)))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL) -> CoTrained | None:
    """Fits on the sample; None if it lacks rows of either class."""
    import numpy as np

    told = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("label"))
    some = told.where(_share(max_labelled, told.count())).withColumnRenamed("doc_id", "l_id")  # a bounded table
    many = docs.count()
    sample = docs.select("doc_id", "text", "source", "lang").join(F.broadcast(some), F.col("doc_id") == F.col("l_id"), "left")
    # unlabelled rows that share an id, null ids above all, are told apart by their texts
    sample = sample.where(F.col("label").isNotNull() | _share(max_pool, many, "text"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id").cast("string")), F.lit(4)) == 0

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, texts in slices(batch, SLICE):
                text, meta = _views(part, texts)
                rows = [pa.array([r.tobytes() for r in v], pa.binary()) for v in (text, meta)]
                yield pa.RecordBatch.from_arrays([part.column("label"), part.column("apart"), *rows], ["label", "apart", "text", "meta"])

    held = sample.withColumn("label", F.col("label").cast("double")).withColumn("apart", fold).drop("l_id", "doc_id")
    rows = held.mapInArrow(run, "label double, apart boolean, text binary, meta binary").distinct()
    # rows of one id can make the sample larger than meant: then a part of it that is the same in all runs
    rows = rows.orderBy(F.xxhash64("text", "meta", "label"), "text", "meta", "label").limit(2 * (max_labelled + max_pool)).toArrow().sort_by([("text", "ascending"), ("meta", "ascending")])
    if not rows.num_rows:
        return None
    y = rows.column("label").to_numpy(zero_copy_only=False).astype(float)
    apart = np.array(rows.column("apart").to_pylist(), bool)
    text, meta = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.float32).reshape(rows.num_rows, -1) for c in ("text", "meta"))
    known = ~np.isnan(y)
    if any(len(np.unique(y[known & part])) < 2 for part in (apart, ~apart)):
        return None
    return CoTrained().fit(text[known], meta[known], (y[known] > 0).astype(float), apart[known], text[~known], meta[~known])


def score(docs: DataFrame, model: CoTrained | None, names: tuple[str, ...] = ("text_score", "meta_score", "quality_score", "keep")) -> DataFrame:
    """The documents with text_score, meta_score, quality_score (probabilities of good) and keep, or under other names."""
    held, back = plain_named(without(docs, *names))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part, texts in slices(batch, SLICE):
                got = shared.value.score(*_views(part, texts)) if shared.value else [np.ones(len(texts))] * 3
                told = [pa.array(np.asarray(x, float)) for x in got] + [pa.array(np.asarray(got[2]) >= KEEP_FROM)]
                yield appended(part, **dict(zip(names, told, strict=True)))
        trimmed()

    one, two, both, keep = map(quoted, names)
    return named_back(held.mapInArrow(run, f"{typed(held)}, {one} double, {two} double, {both} double, {keep} boolean"), back)


def kept(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """The documents that the model does not reject, as they are."""
    names = tuple(unused(docs, "text_score", "meta_score", "quality_score", "keep"))
    return score(docs, model, names).where(F.col(names[3])).select(*columns(docs))
