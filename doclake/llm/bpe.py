"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts of a batch are one array of code points. Each code point gets a class; what a piece boundary needs of the
code points after it (contractions, the end of white space) is part of the class. A small automaton over classes
says where pieces begin. Each class is a function from state to state; such functions compose associatively, and
all compositions form a small table. So the states at the heads of many short stretches come from a scan of
composed functions over all stretches at once, then all stretches run in step. No regex is used.

Pieces are slices of the UTF-8 bytes. Their ids come from a bounded cache, else from merging pairs by rank. The
byte offset of every token is kept; decoding gathers the tokens' bytes by one vectorised copy.

Defined results: a null text counts as empty and has no ids; ids and offsets are per row, so ties and repeated
rows need no rule; an empty table gives no rows; columns of the input with the names of results are replaced.
"""

from __future__ import annotations

import base64
import functools
import heapq
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import appended, columns, named_back, plain_named, slices, trimmed, typed, without

# classes of code points
LETTER, NUMBER, OTHER, SPACE, LAST_WHITE, WHITE, SHORT, LONG, BREAK = range(9)
# states: between pieces, in letters, in numbers, in others, after a leading space, in white space, and with one or
# two letters of a contraction to come
BETWEEN, LETTERS, NUMBERS, OTHERS, LED, WHITES, ONE_LEFT, TWO_LEFT = range(8)
STRETCH = 64
#: Pieces whose ids a worker keeps; twice as many at most.
CACHED = 150_000
#: Bytes of text that are worked on at once.
SLICE = 1 << 20
#: Up to so many bytes a plain list of pairs is quicker than a heap.
SHORT_PIECE, NO_RANK = 48, 1 << 40
#: Code points that have White_Space, fixed values.
WHITE_POINTS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Contractions of one letter, and of two.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")


def _rule(state: int, cls: int) -> tuple[int, bool]:
    """(next state, whether a piece begins here) of the automaton."""
    run = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS}
    if cls == LETTER and state in (ONE_LEFT, TWO_LEFT):
        return (BETWEEN if state == ONE_LEFT else ONE_LEFT), False
    if cls in (SHORT, LONG):  # an apostrophe that begins a contraction, if it begins a piece
        if state in (OTHERS, LED):
            return OTHERS, False
        return (ONE_LEFT if cls == SHORT else TWO_LEFT), True
    if cls in run:
        return run[cls], state not in (run[cls], LED)
    if cls == WHITE:
        return WHITES, state != WHITES
    return {SPACE: LED, LAST_WHITE: BETWEEN, BREAK: BETWEEN}[cls], True


@functools.cache
def _automaton():
    """after[state * 9 + cls], begins[...], and the closure of the classes' functions: first[cls], then[f * 9 + cls],
    both[f * M + g] (f before g), at_start[f]: the state f leads to from BETWEEN."""
    import numpy as np

    rules = [[_rule(s, c) for c in range(9)] for s in range(8)]
    after = np.array([[n for n, _ in r] for r in rules], np.uint8).ravel()
    begins = np.array([[b for _, b in r] for r in rules], bool).ravel()
    plain = [tuple(rules[s][c][0] for s in range(8)) for c in range(9)]
    known = {f: i for i, f in enumerate(dict.fromkeys(plain))}
    found = list(known)
    for f in found:  # grows while it is walked, until no composition is new
        for g in plain:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(found)
                found.append(h)
    m = len(found)
    first = np.array([known[f] for f in plain], np.uint16)
    then = np.array([[known[tuple(g[s] for s in f)] for g in plain] for f in found], np.uint16).ravel()
    both = np.array([[known[tuple(g[s] for s in f)] for g in found] for f in found], np.uint16).ravel()
    return after, begins, first, then, both, m, np.array([f[BETWEEN] for f in found], np.uint8)


@functools.cache
def _class_table():
    """Letter, number, white space or other for each code point, by its general category."""
    import unicodedata

    import numpy as np

    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_POINTS] = WHITE
    return out


def classes(points, breaks):
    """The class of each code point; `breaks` are the places after the texts, which belong to none."""
    import numpy as np

    cls = _class_table()[points]
    cls[breaks] = BREAK
    after = np.append(cls[1:], np.uint8(BREAK))
    ends = (cls == WHITE) & (after != WHITE) & (after != BREAK)
    cls[ends] = np.where(points[ends] == 0x20, SPACE, LAST_WHITE)
    at = np.flatnonzero(points == 0x27)
    at = at[cls[at] == OTHER]
    if at.size:
        ext = np.append(points, np.zeros(2, points.dtype))
        stop = np.append(cls, np.full(2, BREAK, np.uint8)) == BREAK
        one, two = np.where(stop[at + 1], 0, ext[at + 1]), np.where(stop[at + 1] | stop[at + 2], 0, ext[at + 2])
        cls[at[np.isin(one, [ord(c) for c in ONE_LETTER])]] = SHORT
        for pair in TWO_LETTERS:
            cls[at[(one == ord(pair[0])) & (two == ord(pair[1]))]] = LONG
    return cls


def starts(cls):
    """Where pieces begin, by a scan of composed functions over stretches of STRETCH code points."""
    import numpy as np

    after, begins, first, then, both, m, at_start = _automaton()
    n = len(cls)
    k = -(-n // STRETCH)
    rows = np.full(k * STRETCH, BREAK, np.uint8)
    rows[:n] = cls
    rows = np.ascontiguousarray(rows.reshape(k, STRETCH).T)
    f = first[rows[0]]
    for row in rows[1:]:
        f = then[f * np.uint16(9) + row]
    step, f = 1, f.astype(np.int64)
    while step < k:
        f[step:] = both[f[:-step] * m + f[step:]]
        step *= 2
    state = np.zeros(k, np.uint8)
    state[1:] = at_start[f[:-1]]
    out = np.empty((STRETCH, k), bool)
    for i, row in enumerate(rows):
        at = state * np.uint8(9) + row
        out[i] = begins[at]
        state = after[at]
    return np.flatnonzero(out.T.reshape(-1)[:n])


def _merged_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merged(), by a list of the pairs' ranks in which each merge renews two."""
    get, n = ranks.get, len(piece)
    cut = list(range(n + 1))
    pair = [get(piece[i : i + 2], NO_RANK) for i in range(n - 1)]
    while pair and (least := min(pair)) < NO_RANK:
        i = pair.index(least)
        del cut[i + 1], pair[i]
        if i < len(pair):
            pair[i] = get(piece[cut[i] : cut[i + 2]], NO_RANK)
        if i:
            pair[i - 1] = get(piece[cut[i - 1] : cut[i + 1]], NO_RANK)
    return [ranks[piece[a:b]] for a, b in zip(cut, cut[1:], strict=False)]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: of all adjacent pairs the one of least rank is merged, the leftmost of equal ones."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n <= SHORT_PIECE:
        return _merged_short(piece, ranks)
    end = list(range(1, n + 1))  # part i is piece[i:end[i]]; a part that was merged away has end 0
    before = list(range(-1, n - 1))
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue  # one of the two parts has changed since
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(queue, (r, i, end[stop]))
        if (j := before[i]) >= 0 and (r := ranks.get(piece[j:stop])) is not None:
            heapq.heappush(queue, (r, j, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Pieces(dict):
    """The ids of pieces, as little-endian unsigned 32-bit integers; a miss merges and remembers, within CACHED."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.old = ranks, {}

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def __missing__(self, piece: bytes) -> bytes:
        got = self.old.get(piece)
        if got is None:
            ids = merged(piece, self.ranks)
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 256:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines `base64 rank` of a public vocabulary file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


@functools.lru_cache(maxsize=2)
def _vocabulary(data: bytes):
    """Ranks with their cache, all tokens' bytes in one array, and where each begins; once a worker."""
    import numpy as np

    ranks = parse_ranks(data)
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    at = np.concatenate([[0], np.cumsum([len(t) for t in tokens], dtype=np.int64)])
    return Pieces(ranks), np.frombuffer(b"".join(tokens), np.uint8), at


def encode_texts(texts: list[str], cache: Pieces) -> list[bytes]:
    """The packed ids of each text."""
    import numpy as np

    joined = "".join([t + "\0" for t in texts])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64)) - 1
    at = starts(classes(points, ends))
    wide = 1 + (points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000)
    offset = np.concatenate([[0], np.cumsum(wide, dtype=np.int64)])
    cut = offset[at].tolist()
    stop = np.searchsorted(at, ends).tolist()  # each text's break is a start too
    data, out, first = joined.encode("utf-8", "surrogatepass"), [], 0
    for last in stop:
        own = cut[first : last + 1]
        out.append(b"".join([cache[data[a:b]] for a, b in zip(own, own[1:], strict=False)]))
        first = last + 1
    return out


def decode_ids(ids, tokens, at) -> bytes:
    """The bytes of an array of ids, by one gather."""
    import numpy as np

    size = at[ids + 1] - at[ids]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return tokens[np.repeat(at[ids] - (ends - size), size) + np.arange(total)].tobytes()


def _lists(rows, dtype):
    """A list array of the arrays in `rows`."""
    import numpy as np
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate([np.empty(0, dtype), *rows])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _read(vocab_path: str) -> bytes:
    with open(vocab_path, "rb") as f:
        return f.read()


def _encoded(texts: list[str], cache: Pieces, at):
    """The ids of each text, and where each token begins in its bytes."""
    import numpy as np

    ids, begin = [np.frombuffer(x, "<i4") for x in encode_texts(texts, cache)], []
    for x in ids:
        size = at[x + 1] - at[x]
        begin.append((np.cumsum(size) - size).astype(np.int32))
    return ids, begin


def encode(docs: DataFrame, vocab_path: str) -> DataFrame:
    """The documents with n_tokens, ids array<int>, offsets array<int> (where each token begins in the UTF-8 text).

    The vocabulary file (some MB, of fixed size) is read by the driver and broadcast; executors need no copy.
    """
    held, back = plain_named(without(docs, "n_tokens", "ids", "offsets"))
    vocab = docs.sparkSession.sparkContext.broadcast(_read(vocab_path))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        cache, _, at = _vocabulary(vocab.value)
        for batch in batches:
            for part, texts in slices(batch, SLICE):
                ids, begin = _encoded(texts, cache, at)
                yield appended(part, n_tokens=pa.array([len(x) for x in ids], pa.int64()), ids=_lists(ids, np.int32), offsets=_lists(begin, np.int32))
        cache.forget()  # the worker may serve other stages next
        trimmed()

    return named_back(held.mapInArrow(run, f"{typed(held)}, n_tokens long, ids array<int>, offsets array<int>"), back)


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """Any table with a column ids array<int>, with ids_le binary (unsigned 32-bit, little-endian) and decoded binary."""
    held, back = plain_named(without(encoded, "ids_le", "decoded"))
    vocab = encoded.sparkSession.sparkContext.broadcast(_read(vocab_path))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        _, tokens, at = _vocabulary(vocab.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows = [np.asarray(x.values, np.int32) if x.is_valid else np.empty(0, np.int32) for x in part.column("ids")]
                packed = pa.array([x.astype("<u4").tobytes() for x in rows], pa.binary())
                yield appended(part, ids_le=packed, decoded=pa.array([decode_ids(x, tokens, at) for x in rows], pa.binary()))

    return named_back(held.mapInArrow(run, f"{typed(held)}, ids_le binary, decoded binary"), back)


def round_trip(docs: DataFrame, vocab_path: str) -> DataFrame:
    """encode() and then decode() in one pass over the texts: n_tokens, ids, ids_le and decoded in place of text.

    What is decoded are the ids that the same row gives out; a task needs one Python worker instead of two.
    """
    others = without(docs, "n_tokens", "ids", "ids_le", "decoded", "text")
    vocab = docs.sparkSession.sparkContext.broadcast(_read(vocab_path))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        cache, tokens, at = _vocabulary(vocab.value)
        for batch in batches:
            for part, texts in slices(batch, SLICE):
                ids, _ = _encoded(texts, cache, at)
                yield appended(
                    part.drop_columns(["text"]), n_tokens=pa.array([len(x) for x in ids], pa.int64()), ids=_lists(ids, np.int32),
                    ids_le=pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), decoded=pa.array([decode_ids(x, tokens, at) for x in ids], pa.binary()),
                )
        cache.forget()
        trimmed()

    held, back = plain_named(docs.select(*columns(others), "text"))
    return named_back(held.mapInArrow(run, ", ".join([typed(held.drop("text")), "n_tokens long, ids array<int>, ids_le binary, decoded binary"])), back)


def digest(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    out = round_trip(docs.select("doc_id", "text"), vocab_path)
    return out.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
