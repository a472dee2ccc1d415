"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Words are known by 64-bit hashes. All distinct words of the corpus are counted with their hashes first; two words of a
language with one hash are found there, and another seed is taken, so a hash stands for one word in all that follows.

A suffix begins at a word and ends with its piece, or after DEPTH words. Before suffixes are routed, pairs of adjacent
words are counted by hash. A suffix ends where a pair is infrequent, since no frequent phrase goes on there; those that
begin with such a pair are not sent. Frequent words and pairs come to the tasks as bit tables of a fixed size, which may
say yes too often and never no. Equal suffixes of a task go as one with a weight.

Suffixes are routed by their two leading words. A task sorts pointers to its suffixes: it parts them at a pivot of the
word at the present depth into less, equal and greater ones. The weight of the equal ones is the count of the phrase up
to that word; it goes on at the next depth with the equal ones, and at the same depth with the others. A part of less
weight than a phrase needs is abandoned. A pair of leading words that holds too many suffixes is dealt out further, by a
hash of the words that follow; its tasks give partial counts, which are added up.

Scores come from joins of the phrases with their first and last words, in decimals of 38 digits.

Defined results: a null text counts as empty, a null language as `und`; pieces without words give nothing; a phrase
occurs as often as its words follow each other, overlaps included; repeated rows are documents of their own; ties in
score and count go by the phrase's bytes; an empty table gives no rows; other columns are ignored, whatever their names;
very long texts are read in runs of words that overlap, so none is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclake.llm.common import removed, scratch, slices, stored, trimmed

DEPTH, LEAST, TOP = 5, 100, 2000
#: A candidate goes if a longer one around it has COVER hundredths of its count.
COVER = 100
#: Pairs of leading words with more suffixes than this are dealt out further; at most MOST_HOT of them can be told.
HOT, MOST_HOT = 1_000_000, 100_000
#: Bits of a filter.
FILTER = 27
#: Words of a task that are sorted at once, and distinct words that it knows at once.
HELD, KNOWN = 1 << 20, 400_000
#: Bytes of a text that are split at once.
RUN = 1 << 20
#: Partitions of suffixes for each shuffle partition.
PARTS = 4
BREAK = b","
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz " + BREAK * 9)


def _mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _language(lang: str):
    import numpy as np
    import xxhash

    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), 11))


def _pairs(first, second, lang):
    """The keys of pairs of word hashes."""
    import numpy as np

    return _mix(_mix(first + lang) * np.uint64(0x9FB21C651E98DF25) + second)


class Known(dict):
    """Words by numbers, from 1 as they come, with their hashes; 0 is the end of a piece."""

    def __init__(self, seed: int):
        super().__init__({BREAK: 0})
        self.seed, self.words, self.hashes = seed, [BREAK], [0]

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = n = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word, self.seed) or 1)
        return n


def _runs(text: str):
    """The text in bytes, folded, in runs that end between words."""
    raw = text.encode("utf-8", "surrogatepass").translate(FOLD)
    start = 0
    while start < len(raw):
        stop = start + RUN
        if stop < len(raw):
            ends = [x for x in (raw.find(b" ", stop), raw.find(BREAK, stop)) if x >= 0]
            stop = min(ends, default=len(raw))
        yield raw[start:stop]
        start = stop


class Held:
    """Words of each language as a task meets them; `give(lang, numbers)` gets arrays of which each place that begins a
    suffix comes once, with DEPTH - 1 more places behind it."""

    def __init__(self, seed: int, give):
        self.known, self.give, self.seed = Known(seed), give, seed
        self.parts: dict[str, list] = {}
        self.size = 0

    def add(self, lang: str, text: str):
        import numpy as np

        for run in _runs(text):
            own = self.parts.setdefault(lang, [])
            own.append(np.array(list(map(self.known.__getitem__, run.replace(BREAK, b" , ").split())), np.int64))
            self.size += len(own[-1])
            if self.size >= HELD or len(self.known) >= KNOWN:
                yield from self.flush(lang)
        self.parts.setdefault(lang, []).append(np.zeros(1, np.int64))  # the text's end

    def flush(self, going_on: str | None = None):
        """All that is held; of the language whose text goes on the last words are held again."""
        import numpy as np

        parts, self.parts, self.size, again = self.parts, {}, 0, None
        for lang, own in parts.items():
            numbers = np.concatenate(own) if own else np.zeros(0, np.int64)
            if lang == going_on:
                again = numbers[-(DEPTH - 1) :]
                if len(numbers) < DEPTH:
                    continue
            else:
                numbers = np.append(numbers, np.zeros(DEPTH - 1, np.int64))
            if len(numbers) >= DEPTH:
                yield from self.give(lang, numbers, self.known)
        if len(self.known) >= KNOWN:
            words, self.known = self.known.words, Known(self.seed)
            if again is not None:
                again = np.array([self.known[words[i]] for i in again.tolist()], np.int64)
        if again is not None:
            self.parts[going_on] = [again]


def _read(seed: int, give):
    """A function for mapInArrow() over lang, text."""

    def run(batches):
        held = Held(seed, give)
        for batch in batches:
            for part, texts in slices(batch):
                for lang, text in zip(part.column("lang").to_pylist(), texts, strict=True):
                    yield from held.add(lang, text)
        yield from held.flush()
        trimmed()

    return run


def _given_words(lang, numbers, known):
    import numpy as np
    import pyarrow as pa

    counts = np.bincount(numbers[: len(numbers) - DEPTH + 1])
    counts[:1] = 0
    found = np.flatnonzero(counts)
    if len(found):
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([lang] * len(found), pa.string()), "h": pa.array(np.array(known.hashes, np.uint64)[found].view(np.int64)),
            "word": pa.array([known.words[i] for i in found.tolist()], pa.binary()), "f": pa.array(counts[found]),
        })


class Filter:
    """2^size bits of which some are set for each key."""

    def __init__(self, spark: SparkSession, keys: DataFrame, size: int = FILTER):
        """keys: a column k of 64 bits. What comes to the driver is bounded by the size of the table."""
        import numpy as np

        self.size = size
        bits = np.zeros(1 << (size - 6), np.uint64)
        slot = F.shiftrightunsigned("k", 64 - size)
        for at in (slot, F.col("k").bitwiseAND(F.lit((1 << size) - 1))):
            told = keys.select(at.alias("slot")).groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot % 64 AS INT))")).alias("b"))
            got = told.toArrow()
            place, held = (got.column(c).to_numpy() for c in ("w", "b"))
            bits[place] |= held.view(np.uint64)
        self.table = spark.sparkContext.broadcast(bits)

    def maybe(self, keys):
        import numpy as np

        bits, out = self.table.value, True
        for slot in (keys >> np.uint64(64 - self.size), keys & np.uint64((1 << self.size) - 1)):
            out = out & ((bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out

    def close(self) -> None:
        self.table.destroy()


def _word_keys(batches):
    import numpy as np
    import pyarrow as pa

    with np.errstate(over="ignore"):
        for batch in batches:
            hashes = batch.column("h").to_numpy().view(np.uint64)
            langs = batch.column("lang").dictionary_encode()
            of = np.array([_language(x) for x in langs.dictionary.to_pylist()], np.uint64)
            keys = _mix(hashes + of[langs.indices.to_numpy()]) if len(hashes) else hashes
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["k"])


def _good(words: Filter, lang, numbers, known):
    """(hash of each place, language, which places begin a pair of words that may be frequent)."""
    import numpy as np

    own = _language(lang)
    hashes = np.array(known.hashes, np.uint64)
    ok = words.maybe(_mix(hashes + own))
    ok[0] = False
    ok = ok[numbers]
    return hashes[numbers], own, ok[:-1] & ok[1:]


def _packed(parts, *columns):
    """(part, bytes of each column) for each part that has rows."""
    import numpy as np

    order = np.argsort(parts, kind="stable")
    parts = parts[order]
    first = np.flatnonzero(np.append(True, parts[1:] != parts[:-1]))
    columns = [c[order] for c in columns]
    for x, y in zip(first.tolist(), np.append(first[1:], len(parts)).tolist(), strict=True):
        yield int(parts[x]), [c[x:y].tobytes() for c in columns]


def _given_pairs(words: Filter, parts: int):
    """Counts of pairs, packed by partition."""

    def give(lang, numbers, known):
        import numpy as np
        import pyarrow as pa

        with np.errstate(over="ignore"):
            hashes, own, good = _good(words, lang, numbers, known)
            at = np.flatnonzero(good[: len(numbers) - DEPTH + 1])
            keys, counts = np.unique(_pairs(hashes[at], hashes[at + 1], own), return_counts=True)
            if len(keys):
                rows = list(_packed((keys % np.uint64(parts)).astype(np.int64), keys, counts.astype(np.uint32)))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[1][i] for r in rows], pa.binary()) for i in (0, 1)]], ["part", "keys", "counts"])

    return give


def _added_pairs(least: int):
    """Of one partition: k, f of the pairs that may be frequent."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        total = np.add.reduceat(counts, first)
        return pa.table({"k": keys[first][total >= least].view(np.int64), "f": total[total >= least]})

    return run


def _given_suffixes(words: Filter, pairs: Filter, hot: dict[int, int], parts: int):
    """Distinct suffixes of two words or more with their weights, packed by language and partition."""
    import numpy as np

    hot_keys = np.array(sorted(hot), np.uint64)
    salts = np.array([hot[int(k)] for k in hot_keys], np.uint64)

    def give(lang, numbers, known):
        import pyarrow as pa

        with np.errstate(over="ignore"):
            hashes, own, good = _good(words, lang, numbers, known)
            at = np.flatnonzero(good)
            lead = _pairs(hashes[at], hashes[at + 1], own)
            good[at[~pairs.maybe(lead)]] = False
            at = np.flatnonzero(good[: len(numbers) - DEPTH + 1])
            if not len(at):
                return
            columns, on = [numbers[at]], np.ones(len(at), bool)
            for d in range(1, DEPTH):  # a word goes on from the one before if the pair of both is good
                on = on & good[at + d - 1]
                columns.append(np.where(on, numbers[at + d], 0))
            order = np.lexsort(columns[::-1])
            columns = [c[order] for c in columns]
            new = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
            first = np.flatnonzero(new)
            weights = np.diff(np.append(first, len(order))).astype(np.uint32)
            hash_of = np.array(known.hashes, np.uint64)
            keys = [hash_of[c[first]] for c in columns]
            lead = _pairs(keys[0], keys[1], own)
            is_hot = np.zeros(len(lead), bool)
            if len(hot_keys):
                place = np.minimum(np.searchsorted(hot_keys, lead), len(hot_keys) - 1)
                is_hot = hot_keys[place] == lead
                rest = _pairs(_pairs(keys[2], keys[3], own), keys[4], own)
                lead = np.where(is_hot, _mix(lead + rest % salts[place]), lead)
            part = (_mix(lead) % np.uint64(parts)).astype(np.int64) * 2 + is_hot
            rows = list(_packed(part, np.stack(keys, 1), weights))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[1][i] for r in rows], pa.binary()) for i in (0, 1)]],
                ["lang", "part", "keys", "weights"],
            )

    return give


def sorted_counts(columns: list, weights, least: int):
    """(words of a prefix, weight of the suffixes that begin with it) of all prefixes of two words and more that weigh
    `least` at least. columns: the word hashes of the suffixes by depth, 0 behind a suffix's end."""
    import numpy as np

    depth_of = len(columns)
    stack = [(np.arange(len(weights)), 0, ())]
    while stack:
        pointers, depth, prefix = stack.pop()
        words = columns[depth][pointers]
        pivot = np.partition(words, len(words) // 2)[len(words) // 2] if len(words) < 64 else np.sort(words[:: len(words) // 31])[15]
        less, same = words < pivot, words == pivot
        equal = pointers[same]
        if len(equal) < len(pointers):
            for others in (pointers[less], pointers[~(less | same)]):
                if weights[others].sum() >= least:
                    stack.append((others, depth, prefix))
        weight = int(weights[equal].sum())
        if pivot == 0 or weight < least:
            continue
        longer = (*prefix, int(pivot))
        if depth:
            yield longer, weight
        if depth + 1 < depth_of:
            stack.append((equal, depth + 1, longer))


def _sorted(least: int):
    def run(table):
        import numpy as np
        import pyarrow as pa

        lang, part = table.column("lang")[0].as_py(), table.column("part")[0].as_py()
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64).reshape(-1, DEPTH)
        weights = np.frombuffer(b"".join(table.column("weights").to_pylist()), np.uint32).astype(np.int64)
        columns = [np.ascontiguousarray(keys[:, d]) for d in range(DEPTH)]
        found = list(sorted_counts(columns, weights, 1 if part % 2 else least))
        signed = lambda w: np.array(w, np.uint64).view(np.int64)
        return pa.table({
            "lang": pa.array([lang] * len(found), pa.string()), "w": pa.array([signed(w) for w, _ in found], pa.list_(pa.int64())), "f": pa.array([f for _, f in found], pa.int64()),
        })

    return run


def word_counts(rows: DataFrame, path: str) -> tuple[DataFrame, int]:
    """lang, h, word, f of all distinct words, and the seed under which no two words of a language share a hash."""
    for seed in range(99):
        told = rows.mapInArrow(_read(seed, _given_words), "lang string, h long, word binary, f long")
        told = told.repartition("lang", "h").groupBy("lang", "h", "word").agg(F.sum("f").alias("f"))
        words = stored(told, f"{path}/words{seed}")
        if words.groupBy("lang", "h").count().where("count > 1").isEmpty():
            return words, seed
    raise ValueError("words share hashes under every seed")


def phrase_counts(rows: DataFrame, path: str, least: int = LEAST, hot: int = HOT, filter_bits: int = FILTER) -> tuple[DataFrame, DataFrame]:
    """(lang, h, word, f of all words; lang, w array of word hashes, f of phrases of 1 to DEPTH words found `least` times)."""
    spark = rows.sparkSession
    parts = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    words, seed = word_counts(rows, path)
    frequent = words.where(F.col("f") >= least)
    good_words = Filter(spark, frequent.select("lang", "h").mapInArrow(_word_keys, "k long"), filter_bits)
    told = rows.mapInArrow(_read(seed, _given_pairs(good_words, parts)), "part int, keys binary, counts binary")
    pairs = stored(told.groupBy("part").applyInArrow(_added_pairs(least), "k long, f long"), f"{path}/pairs")
    good_pairs = Filter(spark, pairs.select("k"), filter_bits)
    most = max(hot, (pairs.agg(F.sum("f")).first()[0] or 0) // MOST_HOT)
    salts = {r["k"] % (1 << 64): -(-r["f"] // most) for r in pairs.where(F.col("f") > most).collect()}  # MOST_HOT at most
    told = rows.mapInArrow(_read(seed, _given_suffixes(good_words, good_pairs, salts, parts)), "lang string, part int, keys binary, weights binary")
    found = told.groupBy("lang", "part").applyInArrow(_sorted(least), "lang string, w array<long>, f long")
    found = found.groupBy("lang", "w").agg(F.sum("f").alias("f")).where(F.col("f") >= least)  # adds what hot pairs were dealt out to
    grams = stored(found.unionByName(frequent.select("lang", F.array("h").alias("w"), "f")), f"{path}/grams")
    good_words.close()
    good_pairs.close()
    return words, grams


def _whole(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, cover: int = COVER, hot: int = HOT, filter_bits: int = FILTER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `top` phrases of 2 to DEPTH words."""
    path = scratch(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    words, grams = phrase_counts(rows, path, least, hot, filter_bits)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    phrases = grams.where(F.size("w") > 1)
    # a phrase two words longer has no greater count than the one between, so the phrases one word longer tell all
    inner = phrases.where(F.size("w") > 2).select("lang", F.explode(F.array(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1))).alias("w"), "f")
    around = inner.groupBy("lang", "w").agg(F.max("f").alias("longer"))
    left = phrases.join(around, ["lang", "w"], "left").where(F.coalesce(F.lit(100) * F.col("longer") < F.lit(cover) * F.col("f"), F.lit(True)))
    cut = left.select("lang", "w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cut = cut.withColumn("first", F.slice("w", F.lit(1), F.col("k"))).withColumn("rest", F.slice("w", F.col("k") + 1, F.size("w")))
    cut = cut.join(grams.select("lang", F.col("w").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(grams.select("lang", F.col("w").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cut = cut.join(totals, "lang")
    cut = cut.withColumn("x", _whole(F.lit(1000)) * _whole("a") * _whole("n")).withColumn("y", _whole("l") * _whole("r"))
    score = F.expr("CAST(x DIV y AS BIGINT)")
    best = cut.groupBy("lang", "w", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    best = stored(best.select("lang", "w", "a", "n", "b.score", "b.l", "b.r"), f"{path}/best")
    spelled = best.select("lang", "w", F.posexplode("w").alias("at", "h")).join(words.where(F.col("f") >= least).select("lang", "h", "word"), ["lang", "h"])
    spelled = spelled.groupBy("lang", "w").agg(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("s"))
    out = best.join(spelled.select("lang", "w", F.array_join("s.word", " ").alias("phrase")), ["lang", "w"])
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = stored(out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), f"{scratch(docs.sparkSession)}/out")
    removed(docs.sparkSession, path)
    return out


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (SELECT lang, w FROM listed WHERE len(w) > 0),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM runs),
grams AS (SELECT lang, w[i:i + k - 1] AS g, count(*) AS f FROM starts, range(1, 6) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM runs GROUP BY lang),
cand AS (SELECT lang, g, f AS a FROM grams WHERE len(g) >= 2 AND f >= 100),
spans AS (
  SELECT c.lang, c.g[i:i + k - 1] AS g, max(c.a) AS longer FROM cand c, range(2, 5) t(k), range(1, 5) s(i)
  WHERE k < len(c.g) AND i + k - 1 <= len(c.g) GROUP BY ALL),
stay AS (SELECT c.* FROM cand c LEFT JOIN spans s ON c.lang = s.lang AND c.g = s.g WHERE s.longer IS NULL OR 100 * s.longer < 100 * c.a),
cuts AS (
  SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM stay c JOIN range(1, 5) s(k) ON k < len(c.g)
  JOIN grams x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN grams y ON y.lang = c.lang AND y.g = c.g[k + 1:]
  JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM best)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM ranked)
WHERE rank <= 2000
"""
