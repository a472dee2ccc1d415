"""LM scoring by subword lattice likelihood.

The pieces of an existing vocabulary have unigram scores. A word, with a leading space, can be cut into pieces in
many ways; each way weighs the product of its pieces, and a forward recursion in log space sums over all of them.
Pieces don't cross words, so a text's marginal probability is the product over its words, times that of the end. The
probabilities of all words and of the end sum to 1.

A public vocabulary comes with ranks, not with probabilities, so the pieces' scores are learned by expectation
maximisation over all training words, each as often as it occurs: first pieces have a leading space and sum to 1,
later pieces and the word's stop sum to 1. The vocabulary itself is never changed, and words are known only by their
pieces.

Tokens never leave the task that reads their text. A task numbers its distinct words (a block of BLOCK_WORDS at
most) and writes each document as numbers; counts and word probabilities come back to blocks by word.

Defined results: a null text counts as empty and has the end token alone; a null doc_id counts as empty text for
its remainder; rows that repeat are documents of their own; without training documents N and V are 0 and pieces have
equal scores; an empty table gives no rows; extra columns are ignored, whatever their names; a very long word is one
lattice, gone through in spans, of which a task holds two numbers for each byte.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.llm.bpe import _read, parse_ranks
from doclake.llm.common import scratch, slices, stored

#: Remainder of crc32(doc_id) by FOLDS that is held out.
FOLDS, HELD_OUT = 7, 2
ROUNDS = 4
#: Distinct words in a block: what a task holds while it numbers them.
BLOCK_WORDS = 400_000
#: Added to each piece's expected count.
PRIOR = 0.01
#: Words of more bytes go through the lattice one by one, shorter ones of one length together.
LONG_WORD, TOGETHER = 40, 8192
#: Places of a long word whose pieces are held at once.
SPAN = 1 << 15
SLOTS = 1 << 20
ASCII_SPACE = frozenset(b" \t\n\v\f\r")


class Pieces:
    """The usable pieces and a hash table of them; piece i has the i-th probability."""

    def __init__(self, vocabulary: bytes):
        import numpy as np

        usable = (p for p in parse_ranks(vocabulary) if p and not ASCII_SPACE & set(p[1:]) and (p[0] == 0x20 or not ASCII_SPACE & set(p[:1])))
        single = [bytes([b]) for b in range(256) if b == 0x20 or b not in ASCII_SPACE]
        self.pieces = list(dict.fromkeys([*single, *sorted(usable)]))  # with every byte no word is without a cut
        self.index = {p: i for i, p in enumerate(self.pieces)}
        self.leads = np.array([p[0] == 0x20 for p in self.pieces])
        self.size, self.longest = len(self.pieces), max(map(len, self.pieces))
        with np.errstate(over="ignore"):
            keys = np.zeros(self.size, np.uint64)
            lengths = np.array([len(p) for p in self.pieces])
            chars = np.zeros((self.size, self.longest), np.uint8)
            for i, p in enumerate(self.pieces):
                chars[i, : len(p)] = list(p)
            for j in range(self.longest):
                keys = np.where(lengths > j, self.grown(keys, chars[:, j]), keys)
        if len(np.unique(keys)) < self.size:
            raise ValueError("two pieces have one key")
        self.keys = np.append(keys, np.uint64(0))
        self.tables, rest = [], np.arange(self.size)
        self.full = np.zeros(SLOTS, bool)  # slots of the first table that more than one piece wanted
        while len(rest):  # who finds its slot taken goes to the next table
            table = np.full(SLOTS, self.size, np.int32)
            slot = self.slot(keys[rest], len(self.tables))
            _, first = np.unique(slot, return_index=True)
            table[slot[first]] = rest[first]
            rest = np.delete(rest, first)
            if not self.tables:
                self.full[self.slot(keys[rest], 0)] = True
            self.tables.append(table)
        # a Zipf guess by rank, until there are counts
        ranks = parse_ranks(vocabulary)
        self.guess = 1 / (np.array([ranks.get(x, len(ranks)) for x in self.pieces]) + 100.0)

    @staticmethod
    def grown(key, char):
        """The key of a string, from that of the string without its last byte."""
        import numpy as np

        return (key + char + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (key >> np.uint64(29))

    @staticmethod
    def slot(keys, nth: int):
        import numpy as np

        return ((keys * np.uint64(0xD6E8FEB86659FD93 + 2 * nth)) >> np.uint64(44)).astype(np.int64)  # of SLOTS

    def find(self, keys):
        """(places of the keys that are pieces, those pieces)."""
        import numpy as np

        slot = self.slot(keys, 0)
        got = self.tables[0][slot]
        fits = self.keys[got] == keys
        rest = np.flatnonzero(self.full[slot] & ~fits)
        for nth, table in enumerate(self.tables[1:], 1):
            other = table[self.slot(keys[rest], nth)]
            right = self.keys[other] == keys[rest]
            got[rest[right]], fits[rest[right]] = other[right], True
        at = np.flatnonzero(fits)
        return at, got[at]


@functools.lru_cache(maxsize=2)
def pieces_of(vocabulary: bytes) -> Pieces:
    return Pieces(vocabulary)


def _ways(words, pieces: Pieces):
    """(i, j, which words have a piece from i to j, those pieces) for words of one length, which are rows of bytes."""
    import numpy as np

    m, n = words.shape
    out = []
    with np.errstate(over="ignore"):
        for i in range(n):
            key = np.zeros(m, np.uint64)
            for j in range(i, min(n, i + pieces.longest)):
                key = pieces.grown(key, words[:, j])
                at, found = pieces.find(key)
                if len(at):
                    out.append((i, j + 1, at, found))
    return out


def _together(words, pieces: Pieces, logp):
    """The log probability of words of one length: the forward recursion, in log space."""
    import numpy as np

    m, n = words.shape
    forward = np.full((n + 1, m), -np.inf)
    forward[0] = 0
    for i, j, at, found in _ways(words, pieces):
        forward[j, at] = np.logaddexp(forward[j, at], forward[i, at] + logp[found])
    return forward[n]


def _expected(words, pieces: Pieces, logp, counts, weights) -> None:
    """Adds the expected piece counts of words of one length, times their weights. They are short enough for plain products."""
    import numpy as np

    m, n = words.shape
    forward, backward = np.zeros((n + 1, m)), np.zeros((n + 1, m))
    forward[0] = backward[n] = 1
    ways = [(i, j, at, found, np.exp(logp[found])) for i, j, at, found in _ways(words, pieces)]
    for i, j, at, _, p in ways:
        forward[j, at] += forward[i, at] * p
    shares, scale = [], weights / forward[n]
    for i, j, at, _, p in reversed(ways):
        way = p * backward[j, at]
        shares.append(forward[i, at] * way * scale[at])
        backward[i, at] += way
    counts += np.bincount(np.concatenate([w[3] for w in reversed(ways)]), np.concatenate(shares), len(counts))


def _add(a: float, b: float) -> float:
    """The log of a sum of two numbers, of which one may be 0, from their logs."""
    return b if a == -math.inf else a if b == -math.inf else max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _ways_from(data, first: int, last: int, pieces: Pieces):
    """(start, end, piece) of the pieces that begin from `first` to before `last`, by start and then by length."""
    import numpy as np

    found, key = [], np.zeros(last - first, np.uint64)
    with np.errstate(over="ignore"):
        for size in range(1, pieces.longest + 1):
            many = min(last, len(data) - size + 1) - first
            if many <= 0:
                break
            key = pieces.grown(key[:many], data[first + size - 1 : first + size - 1 + many])
            at, own = pieces.find(key)
            found.append((at + first, at + first + size, own))
    starts, ends, own = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order], own[order]


def _alone(word: bytes, pieces: Pieces, logp, counts, weight: float = 1.0, span: int = SPAN) -> float:
    """As _together() and, with counts, _expected(), for one long word, in spans: of the whole word only its bytes and two
    numbers for each are held."""
    import numpy as np

    data, n = np.frombuffer(word, np.uint8), len(word)
    spans = [(x, min(n, x + span)) for x in range(0, n, span)]
    forward = np.full(n + 1, -np.inf)
    forward[0] = 0.0
    for first, last in spans:
        starts, ends, own = _ways_from(data, first, last, pieces)
        reach = min(n, last + pieces.longest - 1)
        held = forward[first : reach + 1].tolist()
        for i, j, p in zip((starts - first).tolist(), (ends - first).tolist(), logp[own].tolist(), strict=True):
            held[j] = _add(held[j], held[i] + p)
        forward[first : reach + 1] = held
    if counts is not None:
        backward = np.full(n + 1, -np.inf)
        backward[n] = 0.0
        for first, last in reversed(spans):
            starts, ends, own = _ways_from(data, first, last, pieces)
            held = backward[first : min(n, last + pieces.longest - 1) + 1].tolist()
            for i, j, p in zip((starts[::-1] - first).tolist(), (ends[::-1] - first).tolist(), logp[own[::-1]].tolist(), strict=True):
                held[i] = _add(held[i], p + held[j])
            backward[first : first + len(held)] = held
            share = np.exp(forward[starts] + logp[own] + backward[ends] - forward[n])
            counts += weight * np.bincount(own, share, len(counts))
    return float(forward[n])


def word_logprobs(words: list[bytes], pieces: Pieces, logp, counts=None, weights=None):
    """The natural log of each word's marginal probability. logp: of each piece, and -inf for none.

    With counts (one more than there are pieces) it adds what an expectation step counts instead, each word as often as
    its weight says, and gives nothing.
    """
    import numpy as np

    out, weights = np.empty(len(words)), np.ones(len(words)) if weights is None else weights
    size = np.array([len(w) + 1 for w in words], np.int64)
    order = np.argsort(size, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(size[order])) + 1, len(order))
    first = 0
    for last in ends.tolist() if len(order) else []:
        n = int(size[order[first]])
        for i in range(first, last, TOGETHER):
            own = order[i : min(last, i + TOGETHER)]
            if n > LONG_WORD:
                for k in own.tolist():
                    out[k] = _alone(b" " + words[k], pieces, logp, counts, weights[k])
                continue
            rows = np.frombuffer(b"".join([b" " + words[k] for k in own.tolist()]), np.uint8).reshape(-1, n)
            if counts is None:
                out[own] = _together(rows, pieces, logp)
            else:
                _expected(rows, pieces, logp, counts, weights[own])
        first = last
    return out if counts is None else None


def _gathered(batches, rows: int = 65_536):
    """Arrow batches of about `rows` rows, so that words of one length come in numbers."""
    import pyarrow as pa

    held, many = [], 0
    for batch in batches:
        held.append(batch)
        many += batch.num_rows
        if many >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, many = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _log_shares(counts, stops: float, leads):
    """(log probability of each piece and -inf for none, that of a word's stop) from expected counts."""
    import numpy as np

    counts = counts + PRIOR
    later = np.where(leads, 0.0, counts).sum() + stops + PRIOR
    shares = counts / np.where(leads, np.where(leads, counts, 0.0).sum(), later)
    return np.append(np.log(shares), -np.inf), math.log((stops + PRIOR) / later)


def learn(words: DataFrame, vocabulary: bytes, rounds: int = ROUNDS):
    """(log probability of each piece, of a word's stop), from words (word binary, c long), each of which counts c times.

    Each round is one pass over all distinct words; tasks send one sum for each piece, the driver holds one number
    for each piece of the vocabulary, whose size is fixed.
    """
    import numpy as np

    sc = words.sparkSession.sparkContext
    pieces = pieces_of(vocabulary)
    shared = sc.broadcast(vocabulary)
    logp, stop = _log_shares(pieces.guess, pieces.guess.sum() / 4, pieces.leads)
    for _ in range(rounds):
        now = sc.broadcast(logp)

        def expected(batches, now=now):
            import pyarrow as pa

            own = pieces_of(shared.value)
            counts, many = np.zeros(own.size + 1), 0.0
            for batch in _gathered(batches):
                often = batch.column("c").to_numpy().astype(float)
                many += often.sum()
                word_logprobs(batch.column("word").to_pylist(), own, now.value, counts, often)
            counts[-1] = many  # each word stops once
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], ["piece", "n"])

        sums = words.where("c > 0").select("word", "c").mapInArrow(expected, "piece int, n double")
        counts = np.zeros(pieces.size + 1)
        for piece, n in sums.groupBy("piece").agg(F.sum("n")).collect():
            counts[piece] = n
        logp, stop = _log_shares(counts[:-1], counts[-1], pieces.leads)
    return logp, stop


def word_and_end(n_words: int, ends: int) -> tuple[float, float]:
    """Log probabilities that a token is a word, and that it is the end."""
    return math.log((n_words + 1) / (n_words + ends + 2)), math.log((ends + 1) / (n_words + ends + 2))


def held_out() -> Column:
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(FOLDS)) == HELD_OUT


def _numbered(batches):
    """Rows of words (kind 0: block, word, its number, n in training texts) and of documents (kind 1: ids packed)."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    names = ["kind", "block", "word", "idx", "n", "doc_id", "held_out", "once", "more"]
    block, known, trained, id_type = TaskContext.get().partitionId() << 24, {}, np.zeros(0, np.int64), None

    def rows(many, id_type, **given):
        types = {"kind": pa.int32(), "block": pa.int64(), "word": pa.binary(), "idx": pa.int32(), "n": pa.int64(), "doc_id": id_type, "held_out": pa.bool_(), "once": pa.binary(), "more": pa.binary()}
        given["block"] = [block] * many
        return pa.RecordBatch.from_arrays([pa.array(given[k], t) if k in given else pa.nulls(many, t) for k, t in types.items()], names)

    def words():
        every = list(known)
        for i in range(0, len(every), 50_000):
            part = every[i : i + 50_000]
            yield rows(len(part), id_type, kind=[0] * len(part), word=part, idx=range(i, i + len(part)), n=trained[i : i + len(part)])

    for batch in batches:
        id_type = batch.schema.field("doc_id").type
        for part, texts in slices(batch, 1 << 20):
            held = part.column("held_out").to_pylist()
            once, more = [], []
            for text, out in zip(texts, held, strict=True):
                ids = [known.setdefault(w, len(known)) for w in text.encode("utf-8", "surrogatepass").lower().split()]
                idx, n = np.unique(np.array(ids, np.int32), return_counts=True)
                if len(known) > len(trained):
                    trained = np.append(trained, np.zeros(len(known), np.int64))
                if not out:
                    trained[idx] += n
                once.append(idx[n == 1].tobytes())
                more.append(np.stack([idx[n > 1], n[n > 1].astype(np.int32)]).tobytes())
            yield rows(len(texts), id_type, kind=[1] * len(texts), doc_id=part.column("doc_id").to_pylist(), held_out=held, once=once, more=more)
            if len(known) >= BLOCK_WORDS:
                yield from words()
                block, known, trained = block + 1, {}, np.zeros(0, np.int64)
    yield from words()


def score_documents(docs: DataFrame, vocab_path: str, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    The vocabulary file is read by the driver and broadcast (some MB, of fixed size).
    """
    spark = docs.sparkSession
    path, vocabulary = scratch(spark), _read(vocab_path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"block long, word binary, idx int, n long, doc_id {kind}, held_out boolean, once binary, more binary"
    packed = docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(_numbered, f"kind int, {columns}")
    packed.write.partitionBy("kind").parquet(f"{path}/packed")
    packed = spark.read.schema(f"{columns}, kind int").parquet(f"{path}/packed")
    words = packed.where("kind = 0").select(F.col("block").alias("w_block"), "word", "idx", "n")
    texts = packed.where("kind = 1").select("block", "doc_id", "held_out", "once", "more")

    counts = stored(words.groupBy("word").agg(F.sum("n").alias("c")), f"{path}/words")
    ends = texts.where("NOT held_out").count()
    n_words, v_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    total, distinct = n_words + ends, v_words + (ends > 0)
    logp, stop = learn(counts, vocabulary, rounds)
    # a word or the end, then the word's cuts and its stop; a word of no bytes can't be
    begin, end = word_and_end(n_words, ends)
    begin += stop - math.log1p(-math.exp(logp[pieces_of(vocabulary).index[b" "]] + stop))
    sc = spark.sparkContext
    shared, now = sc.broadcast(vocabulary), sc.broadcast(logp)

    def scored(batches):
        import pyarrow as pa

        for batch in _gathered(batches):
            got = begin + word_logprobs(batch.column("word").to_pylist(), pieces_of(shared.value), now.value)
            yield from pa.table({"word": batch.column("word"), "c": batch.column("c"), "lp": got}).to_batches()

    known = counts.mapInArrow(scored, "word binary, c long, lp double")
    back = words.select("w_block", "word", "idx").join(known, "word").select("w_block", "idx", "c", "lp")

    def summed(left, right):
        import numpy as np
        import pyarrow as pa

        at = right.column("idx").to_numpy()
        size = int(at.max(initial=-1)) + 1
        c, lp = np.zeros(size, np.int64), np.zeros(size)
        c[at], lp[at] = right.column("c").to_numpy(), right.column("lp").to_numpy()
        least = math.log10(total + distinct) if total + distinct else 0.0
        base, end_known = np.log10(c + 1.0) - least, int(ends > 0)
        rows = []
        for once, more in zip(left.column("once").to_pylist(), left.column("more").to_pylist(), strict=True):
            one, (idx, n) = np.frombuffer(once, np.int32), np.frombuffer(more, np.int32).reshape(2, -1)
            tokens = len(one) + int(n.sum()) + 1
            seen = int((c[one] > 0).sum()) + int(n[c[idx] > 0].sum()) + end_known
            plain = float(base[one].sum() + (base[idx] * n).sum()) + math.log10(ends + 1) - least
            model = (float(lp[one].sum() + (lp[idx] * n).sum()) + end) / math.log(10)
            rows.append((tokens, seen, plain, model))
        n_tokens, n_known, base_score, score = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.Table.from_arrays(
            [left.column("doc_id"), left.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array([total] * len(rows), pa.int64()), pa.array(base_score, pa.float64()), pa.array(score, pa.float64())],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return (
        texts.groupBy("block")
        .cogroup(back.groupBy("w_block"))
        .applyInArrow(summed, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
