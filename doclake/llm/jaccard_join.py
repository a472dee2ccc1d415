"""N-gram Jaccard join by parity sketches.

Of a document's word shingles each flips one bit of a sketch, so two sketches differ in no more bits than the sets
have elements that only one of them holds. Sets of a and b shingles with a Jaccard similarity of 0.8 differ in at
most (a + b) / 9 elements.

Candidates. Per size band (sets are at most 1.25 times as large as a partner's) a sparse sketch is cut into so
many pieces, more than sets of the band may differ in, that of two similar sets some piece is equal. A piece goes
by a hash of its bits. Empty pieces are not given out; this loses nothing where a set fills more pieces than may
differ, and a set that does not is given out again with twice as many pieces, until it does. So no pair is lost.

A piece is five bytes within a partition of pieces, with five bytes that stand for its document; a task sends them
packed. Pieces that several documents hold become rows. There, documents of equal shingles are one class.

Rare pieces first. Similar sets differ in `most` pieces at most, so of any most + 1 pieces of a set its partner holds
one. A set that shares fewer of its pieces with others than it would have to has no partner and is out; of the others
only the most + 1 pieces stay that the fewest sets hold, those that no other holds among them. Passages and lines that
many otherwise different documents share are in the common pieces, which so never bring documents together.

Each piece links its members to one of them first, and only pieces whose members are then in different components
are joined with themselves. In a band sets of the band below meet only those of the band itself.

Room. Where that join could make many pairs, shingles are counted that no set of another component holds, of all that are left to be joined.
Two such sets of sizes a and b with u and v of them differ in u + v elements at least, so they need room: (a + b) / 9 is
not below u + v. One of them then has room by itself, a / 9 not below u; sets without meet only sets with it. So documents
made from one template, each with more text of its own than a link allows, do not meet each other at all.

A dense sketch of
1024 bits drops pairs whose Hamming distance is too large, a wide one those of long sets; the rest is verified on
whole sets. Intermediate tables are removed when the components are known.

Defined results: null and empty texts and texts without words have no shingles and link with nothing; documents
of fewer than five words have one shingle, their whole sequence; component_id is null only if no document of the
component has an id; rows with one doc_id are documents of their own; an empty table gives no rows; extra columns
are ignored, whatever their names; very long texts are worked on one by one, very long words as any others.
"""

from __future__ import annotations

import bisect
import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclake.llm.common import columns, quoted, removed, scratch, slices, stored, trimmed, unused
from doclake.llm.components import components

WORDS = 5
#: A pair links if 100 times the intersection is at least THRESHOLD times the union.
THRESHOLD = 80
SKETCH_WORDS = 16
#: Sets with more shingles have a wide sketch too, of about a bit for each; the dense one tells little of them.
LONG_SET = 800
#: Up to so many ids of candidates (some MB) are broadcast to the texts; more are joined by shuffle.
FEW_IDS = 200_000
#: Pieces that a task holds before it sends them, and pieces' partitions for each shuffle partition.
HELD_PIECES, PARTS = 400_000, 4
#: Bytes of text that are hashed at once; arrays are up to ten times as large.
SLICE = 1 << 18
#: Pieces beyond what may differ, so that nearly all sets fill enough of them at once.
SPARE = 1.15
#: Rounds that link a piece's members to one of them, before members of different components meet.
STARS = 2
#: Shingles of components with more sets than this count as shared, so a shingle has no more rows than that from a task.
BIG = 1000
#: Rooms are found where pieces could make more pairs than this for each of their rows; a join of fewer costs less.
ROOM_FROM = 1000
FIVE = (1 << 40) - 1
#: Bytes of a word up to which powers are kept.
USUAL_WORD = 4096


@functools.cache
def _tables():
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(20240607))
    byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    byte[list(b" \t\n\v\f\r")] = 0
    return byte, rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int):
    import numpy as np

    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))


_usual_powers = functools.cache(lambda: _powers(USUAL_WORD))


def shingles(texts: list[str]) -> list:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    import numpy as np

    byte, place = _tables()
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    coded = byte[data]
    inside = coded != 0
    before = np.append(False, inside[:-1])
    start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(before & ~inside)
    if len(start):
        size = stop - start
        offset = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data)))) if start[0] == 0 else None
        if offset is None:
            offset = np.arange(len(data)) - np.concatenate([np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.append(start, len(data))))])
        longest = 1 << int(size.max()).bit_length()
        powers = _usual_powers() if longest <= USUAL_WORD else _powers(longest)
        coded = np.where(inside, coded * powers[np.where(inside, offset, 0)], np.uint64(0))
        words = _mix(np.add.reduceat(coded, start) + size.astype(np.uint64))
    ends = np.cumsum([len(r) + 1 for r in raw])
    cut = np.searchsorted(start, np.append(0, ends)).tolist()
    out = []
    for a, b in zip(cut, cut[1:], strict=False):
        n = b - a
        if n == 0:
            out.append(np.empty(0, np.uint64))
            continue
        own = words[a:b]
        if n < WORDS:
            h = np.add.reduce(own * place[:n], keepdims=True) + np.uint64(n)
        else:
            h = own[: n - WORDS + 1] * place[0]
            for k in range(1, WORDS):
                h = h + own[k : n - WORDS + 1 + k] * place[k]
        out.append(np.unique(_mix(h)))
    return out


@functools.cache
def bands(limit: int = 1 << 40) -> tuple[int, ...]:
    """Where size bands begin; a set's partner is in the same band or in the next to it."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // THRESHOLD)))
    return tuple(out)


def band_of(n: int) -> int:
    return bisect.bisect_right(bands(), n) - 1


def may_differ(a: int, b: int) -> int:
    """A bound of the elements in which linked sets of at most these sizes differ: a + b less twice the intersection."""
    return (100 - THRESHOLD) * (a + b) // (100 + THRESHOLD)


def pieces(hashes, parts: int = 1):
    """(keys of the pieces that a set of shingle hashes gives out; (filled, most) in its own band and in the next).

    A key is the partition of pieces, of `parts`, and 40 bits, the last of which tells an odd band from an even one.
    filled: the pieces given out in the band, most: those which a linked set that is met there can lack. Where a set
    had to be given out again, most is so large that none of its pieces is spared.
    """
    import numpy as np

    n, starts, out, told = len(hashes), bands(), [], []
    own = band_of(n)
    for band in (own, own + 1):
        top = starts[band + 1] - 1
        most = may_differ(top, top)
        many, filled, first_time = int(SPARE * (most + 1)) + 2, 0, True
        told.append((0, 0))
        while most and filled <= most:  # a set with more elements than `most` fills enough in the end; if most is 0, linked sets are equal
            salt = np.uint64((band << 32) + many)
            bits = _mix(hashes ^ _mix(salt))  # the bit that a shingle flips: its piece, and the place in it
            at = (bits >> np.uint64(32)) * np.uint64(many) >> np.uint64(32)
            order = np.argsort(at, kind="stable")
            at = at[order]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            parity = np.bitwise_xor.reduceat(_mix(bits[order] + salt), first)
            key = _mix(parity ^ _mix(at[first] + salt))
            key = ((key >> np.uint64(40)) % np.uint64(parts) << np.uint64(40)) | (key & np.uint64(FIVE - 1)) | np.uint64(band & 1)
            out.append(np.unique(key))
            filled = len(out[-1])
            told[-1] = (filled, may_differ(n, min(top, n * 100 // THRESHOLD))) if first_time else (0, n)
            many, first_time = many * 2, False
    return np.concatenate(out) if out else np.empty(0, np.uint64), (*told[0], *told[1])


def sketch(hashes):
    """The dense sketch, as SKETCH_WORDS integers of 64 bits."""
    import numpy as np

    at = (_mix(hashes + np.uint64(77)) >> np.uint64(32)).astype(np.int64) % (64 * SKETCH_WORDS)
    odd = (np.bincount(at, minlength=64 * SKETCH_WORDS) & 1).astype(np.uint8)
    return np.packbits(odd).view("<i8")


def wide_sketch(hashes) -> bytes | None:
    """A sketch of as many bits as the set has elements or nearly twice as many, of sets with more than LONG_SET."""
    import numpy as np

    if len(hashes) <= LONG_SET:
        return None
    bits = 1 << (len(hashes) - 1).bit_length()
    at = (_mix(hashes + np.uint64(78)) >> np.uint64(16)) % np.uint64(bits)  # halves of it fold to the next smaller one's
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide_apart(x: bytes, y: bytes) -> int:
    """The Hamming distance of two wide sketches, the larger one folded until both are of one size."""
    import numpy as np

    a, b = sorted((np.frombuffer(v, np.uint8) for v in (x, y)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _wide_possible(batches):
    """Of pairs (a, b, m, x, y) those whose wide sketches differ in no more than m bits."""
    import pyarrow as pa

    for batch in batches:
        told = zip(*(batch.column(c).to_pylist() for c in ("m", "x", "y")), strict=True)
        keep = pa.array([i for i, (m, x, y) in enumerate(told) if not x or not y or wide_apart(x, y) <= m], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("a", "b")], ["a", "b"])


def class_key(hashes) -> tuple[int, int]:
    """128 bits that stand for a set."""
    import numpy as np
    import xxhash

    one, two = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<i8").tolist()
    return one, two


SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
#: What pieces() tells of a set.
TOLD = ["filled0", "most0", "filled1", "most1"]


def _given(parts: int):
    """Of each document a row (kind 0), and its pieces packed: those shared within the task (1) and one of each (2)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["kind", "part", "keys", "refs", "doc_id", "text_key", "n", "d1", "d2", *TOLD, *SKETCH, "wide"]
        id_type = pa.int64()

        def rows(many, **given):
            types = dict.fromkeys(names, pa.int64()) | {"kind": pa.int32(), "part": pa.int32(), "keys": pa.binary(), "refs": pa.binary(), "doc_id": id_type, "wide": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(given[k], types[k]) if k in given else pa.nulls(many, types[k]) for k in names], names)

        def packed(kind, part, key, ref, width):
            """A row for each partition of pieces; of each key its first `width` bytes."""
            if not len(part):
                return
            order = np.argsort(part, kind="stable")
            part = part[order]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            spans = list(zip(first.tolist(), np.append(first[1:], len(part)).tolist(), strict=True))
            key, ref = (x[order].view(np.uint8).reshape(-1, 8)[:, :w] for x, w in ((key, width), (ref, 5)))
            yield rows(
                len(spans), kind=[kind] * len(spans), part=part[first].astype(np.int32),
                keys=[key[x:y].tobytes() for x, y in spans], refs=[ref[x:y].tobytes() for x, y in spans],
            )

        def send(keys, refs):
            key, ref = np.concatenate(keys), np.concatenate(refs)
            order = np.argsort(key, kind="stable")
            key, ref = key[order], ref[order]
            new = np.append(True, key[1:] != key[:-1])
            shared = ~new | ~np.append(new[1:], True)
            # what the task itself finds shared goes by its document to any partition; home goes one of each piece
            yield from packed(1, (ref[shared] % np.uint64(parts)).astype(np.int64), key[shared], ref[shared], 8)
            yield from packed(2, (key[new] >> np.uint64(40)).astype(np.int64), key[new], ref[new], 5)

        held_keys, held_refs, held, seen = [], [], 0, {}
        with np.errstate(over="ignore"):
            for batch in batches:
                id_type = batch.schema.field("doc_id").type
                for part, texts in slices(batch, SLICE):
                    sets = shingles(texts)
                    known = [class_key(s) for s in sets]
                    dense = np.stack([sketch(s) for s in sets])
                    told = []
                    for s, k in zip(sets, known, strict=True):
                        if len(s) and k not in seen:
                            own, seen[k] = pieces(s, parts)
                            held_keys.append(own)
                            held_refs.append(np.full(len(own), k[0] & FIVE, np.uint64))
                            held += len(own)
                        told.append(seen[k] if len(s) else (0, 0, 0, 0))
                    yield rows(
                        len(sets), kind=[0] * len(sets), doc_id=part.column("doc_id").to_pylist(),
                        text_key=part.column("text_key").to_pylist(), n=[len(s) for s in sets], d1=[k[0] for k in known], d2=[k[1] for k in known],
                        **{c: [t[i] for t in told] for i, c in enumerate(TOLD)}, **{c: dense[:, i] for i, c in enumerate(SKETCH)}, wide=[wide_sketch(s) for s in sets],
                    )
                    if held >= HELD_PIECES:
                        yield from send(held_keys, held_refs)
                        held_keys, held_refs, held, seen = [], [], 0, {}
            if held:
                yield from send(held_keys, held_refs)
        trimmed()

    return run


def _wide(data: bytes, width: int):
    """Integers from their first `width` little-endian bytes."""
    import numpy as np

    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<i8").reshape(-1)


def _met(table):
    """Of one partition of pieces: (key, ref) of those that several documents hold."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    kind, part = table.column("kind"), table.column("part")[0].as_py()
    keys, refs = [], []
    for k, width in ((1, 8), (2, 5)):
        own = table.filter(pc.equal(kind, k))
        key = _wide(b"".join(own.column("keys").to_pylist()), width)
        ref = _wide(b"".join(own.column("refs").to_pylist()), 5)
        if k == 2:
            order = np.lexsort((ref, key))
            key, ref = key[order] | (part << 40), ref[order]
            fresh = np.append(True, (key[1:] != key[:-1]) | (ref[1:] != ref[:-1]))[: len(key)]
            key, ref = key[fresh], ref[fresh]
            new = np.append(True, key[1:] != key[:-1])[: len(key)]
            shared = ~new | ~np.append(new[1:], True)[: len(key)]
            key, ref = key[shared], ref[shared]
        keys.append(key)
        refs.append(ref)
    return pa.table({"key": np.concatenate(keys), "ref": np.concatenate(refs)})


def _sets(batches):
    """cid and the packed set of each candidate's representative, where its text is the one that was meant."""
    import numpy as np
    import pyarrow as pa

    seen: set[int] = set()  # rows that repeat give their class's set once a task; more of them do no harm
    with np.errstate(over="ignore"):
        for batch in batches:
            for part, texts in slices(batch, SLICE):
                want = zip(part.column("d1").to_pylist(), part.column("d2").to_pylist(), strict=True)
                sets = shingles(texts)
                cids = part.column("cid").to_pylist()
                right = [i for i, (s, w) in enumerate(zip(sets, want, strict=True)) if class_key(s) == w and cids[i] not in seen and not seen.add(cids[i])]
                yield pa.RecordBatch.from_arrays([part.column("cid").take(pa.array(right, pa.int64())), pa.array([sets[i].tobytes() for i in right], pa.binary())], ["cid", "set"])


def _linked(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= THRESHOLD * (len(x) + len(y) - both):
                keep.append(i)
        keep = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("a", "b")], ["a", "b"])


def _lone_given(parts: int):
    """Shingles of sets (cid, comp, d1, d2, text), packed by partition: one row where two components hold a shingle (comp -1),
    else one for each set that holds it."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def send(held):
            h, cid, comp = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, cid, comp = h[order], cid[order], comp[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            shared = np.minimum.reduceat(comp, first) != np.maximum.reduceat(comp, first)
            shared |= comp[first] < 0
            keep = ~np.repeat(shared, np.diff(np.append(first, len(h))))
            keep[first] = True
            comp[first[shared]] = -1
            h, cid, comp = h[keep], cid[keep], comp[keep]
            part = (h % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part = part[order]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            spans = list(zip(first.tolist(), np.append(first[1:], len(part)).tolist(), strict=True))
            packed = [pa.array([c[order[x:y]].tobytes() for x, y in spans], pa.binary()) for c in (h, cid, comp)]
            yield pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), *packed], ["part", "h", "cid", "comp"])

        held, size = [], 0
        with np.errstate(over="ignore"):
            for batch in batches:
                for part, texts in slices(batch, SLICE):
                    told = zip(shingles(texts), *(part.column(c).to_pylist() for c in ("cid", "comp", "d1", "d2")), strict=True)
                    for own, cid, comp, d1, d2 in told:
                        if len(own) and class_key(own) == (d1, d2):
                            held.append((own, np.full(len(own), cid, np.int64), np.full(len(own), comp, np.int64)))
                            size += len(own)
                    if size >= HELD_PIECES:
                        yield from send(held)
                        held, size = [], 0
            if held:
                yield from send(held)
        trimmed()

    return run


def _lone(table):
    """Of one partition of shingles: cid, n of the sets that hold n of them which no other component holds."""
    import numpy as np
    import pyarrow as pa

    h, cid, comp = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("h", np.uint64), ("cid", np.int64), ("comp", np.int64)))
    order = np.lexsort((cid, h))
    h, cid, comp = h[order], cid[order], comp[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    alone = (np.minimum.reduceat(comp, first) == np.maximum.reduceat(comp, first)) & (comp[first] >= 0)
    once = np.append(True, (h[1:] != h[:-1]) | (cid[1:] != cid[:-1]))  # rows that repeat give a set twice
    ids, counts = np.unique(cid[once & np.repeat(alone, np.diff(np.append(first, len(h))))], return_counts=True)
    return pa.table({"cid": ids, "n": counts})


def _possible(columns: list[str]) -> str:
    """What the sizes and sketches (columns) of two classes x and y tell without their sets."""
    apart = " + ".join(f"bit_count(x.{c} ^ y.{c})" for c in columns)
    return (
        f"100 * least(x.n, y.n) >= {THRESHOLD} * greatest(x.n, y.n) AND "
        f"{apart} <= x.n + y.n - 2 * ceil({THRESHOLD} * (x.n + y.n) / {100 + THRESHOLD})"
    )


class Join:
    """One similarity join and its written tables."""

    def __init__(self, docs: DataFrame, *others: str):
        """others: columns that tell rows of one id and text apart."""
        spark = docs.sparkSession
        self.path, self.turn = scratch(spark), 0
        self.docs = docs.select("doc_id", "text")
        text_key = row_key(docs, *others).alias("text_key")
        parts = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
        id_type = docs.schema["doc_id"].dataType.simpleString()
        dense = ", ".join(f"{c} long" for c in [*TOLD, *SKETCH]) + ", wide binary"
        columns = f"part int, keys binary, refs binary, doc_id {id_type}, text_key long, n long, d1 long, d2 long, {dense}"
        given = docs.select("doc_id", "text", text_key).mapInArrow(_given(parts), f"kind int, {columns}")
        given.write.partitionBy("kind").parquet(f"{self.path}/given")
        given = spark.read.schema(f"{columns}, kind int").parquet(f"{self.path}/given")
        # documents stay where they are, as copies of one text would all meet in one task; only pieces are dealt out
        told = given.where("kind = 0")
        met = given.where("kind > 0").select("kind", "part", "keys", "refs").groupBy("part").applyInArrow(_met, "key long, ref long")
        met = stored(met, f"{self.path}/met")
        #: doc_id, text_key, n, d1, d2 of every document
        self.rows = told.select("doc_id", "text_key", "n", "d1", "d2")
        classes = told.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("doc"), *[F.max(c).alias(c) for c in [*TOLD, *SKETCH, "wide"]])
        odd = F.expr(f"size(filter(array({', '.join(f'{b}L' for b in bands() if b < 1 << 32)}), b -> b <= n)) % 2 = 0")  # as the last bit of a key of its band
        classes = classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("ref", F.col("d1").bitwiseAND(F.lit(FIVE)))
        self.classes = stored(classes.withColumn("odd", odd), f"{self.path}/classes")
        by_band = lambda c: F.when(F.col("own"), F.col(f"{c}0")).otherwise(F.col(f"{c}1")).alias(c)
        held = met.join(self.classes.select("ref", "cid", "odd", *TOLD), "ref").withColumn("own", (F.col("key") % 2 != 0) == F.col("odd"))
        held = stored(held.select("key", "cid", "own", by_band("filled"), by_band("most")).distinct(), f"{self.path}/held")
        few = self._rare(held)
        sizes = stored(self._sizes(few), f"{self.path}/sizes")
        #: pairs of classes that alone hold some piece, and (key, cid, own) of pieces that more hold
        self.couples = sizes.where("many = 2").select("a", "b").distinct()
        self.members = stored(few.join(sizes.where("many > 2").select("key"), "key", "left_semi"), f"{self.path}/members")

    @staticmethod
    def _sizes(held: DataFrame) -> DataFrame:
        """Of the pieces that several classes hold, one of the band itself among them: how many, the least and the greatest."""
        out = held.groupBy("key").agg(F.count("*").alias("many"), F.min("cid").alias("a"), F.max("cid").alias("b"), F.max("own").alias("any_own"))
        return out.where("many > 1 AND any_own")

    def _rare(self, held: DataFrame) -> DataFrame:
        """key, cid, own of the pieces that stay: of each set and band the most + 1 rarest, if it shares enough at all."""
        shared = held.join(self._sizes(held).select("key", "many"), "key")
        in_band = Window.partitionBy("cid", "own")
        alone = F.col("filled") - F.count("*").over(in_band)  # pieces that no other set holds are the rarest
        ranked = shared.select("key", "cid", "own", "most", alone.alias("alone"), F.row_number().over(in_band.orderBy("many", "key")).alias("nth"))
        return stored(ranked.where("nth <= most + 1 - alone").select("key", "cid", "own"), f"{self.path}/few")

    def _with(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs of classes (a, b) that their sizes and sketches allow, each once, written."""
        sizes = self.classes.select("cid", "n", *SKETCH)
        near = pairs.join(sizes.alias("x"), F.col("a") == F.col("x.cid")).join(sizes.alias("y"), F.col("b") == F.col("y.cid"))
        most = F.expr(f"x.n + y.n - 2 * ceil({THRESHOLD} * (x.n + y.n) / {100 + THRESHOLD})")
        near = near.where(_possible(SKETCH)).select("a", "b", most.alias("m"), (F.expr("least(x.n, y.n)") > LONG_SET).alias("long"))
        near = stored(near, f"{self.path}/{name}_near")
        wide = self.classes.where(F.col("n") > LONG_SET).select("cid", "wide")
        long = near.where("long").join(wide.selectExpr("cid AS a", "wide AS x"), "a").join(wide.selectExpr("cid AS b", "wide AS y"), "b")
        long = long.select("a", "b", "m", "x", "y").mapInArrow(_wide_possible, "a long, b long")
        return stored(near.where("NOT long").select("a", "b").unionByName(long), f"{self.path}/{name}")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets link."""
        self.turn += 1
        ids = pairs.selectExpr("a AS cid").union(pairs.selectExpr("b AS cid")).distinct()
        ids = stored(ids.join(self.classes.select("cid", "doc", "d1", "d2"), "cid"), f"{self.path}/ids{self.turn}")
        if ids.count() <= FEW_IDS:
            ids = F.broadcast(ids)  # of a checked size, so that texts aren't shuffled
        found = self.docs.join(ids, F.col("doc_id").eqNullSafe(F.col("doc"))).select("cid", "d1", "d2", "text")
        sets = stored(found.mapInArrow(_sets, "cid long, set binary"), f"{self.path}/sets{self.turn}")
        whole = pairs.join(sets.selectExpr("cid AS a", "set AS x"), "a").join(sets.selectExpr("cid AS b", "set AS y"), "b")
        return stored(whole.select("a", "b", "x", "y").mapInArrow(_linked, "a long, b long"), f"{self.path}/links{self.turn}")

    def _open(self, members: DataFrame, labels: DataFrame | None, name: str) -> DataFrame:
        """key, cid, own, comp of the pieces whose members are in different components."""
        if labels is None:
            return members.withColumn("comp", F.col("cid"))
        told = members.select("key", "cid", "own").join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", "own", F.coalesce("comp", "cid").alias("comp"))
        told = stored(told, f"{self.path}/told_{name}")
        open_ = told.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
        return stored(told.join(open_, "key", "left_semi"), f"{self.path}/open_{name}")

    def _starred(self, own: DataFrame, turn: int) -> DataFrame:
        """Pairs of each piece's members with one of the band itself: the least in an order that differs by round."""
        rank = F.struct((~F.col("own")).alias("other"), F.xxhash64(F.lit(turn), "cid").alias("r"), "cid", "comp")
        hubs = own.groupBy("key").agg(F.min(rank).alias("hub")).select("key", F.col("hub.cid").alias("h_cid"), F.col("hub.comp").alias("h_comp"))
        hubs = stored(hubs, f"{self.path}/hubs{turn}")
        pairs = own.join(hubs, "key").where("comp <> h_comp")
        return pairs.select(F.least("cid", "h_cid").alias("a"), F.greatest("cid", "h_cid").alias("b"))

    def _rooms(self, own: DataFrame) -> DataFrame:
        """cid, room of the sets that are left, but for those that no partner could have room for: a pair needs a sum of 0."""
        sets = own.select("cid", "comp").distinct()
        big = sets.groupBy("comp").agg(F.count("*").alias("sets")).where(F.col("sets") > BIG).select("comp", F.lit(True).alias("big"))
        sets = sets.join(big, "comp", "left").select("cid", F.when(F.col("big"), F.lit(-1)).otherwise(F.col("comp")).alias("comp"))
        sets = stored(sets.join(self.classes.select("cid", "n", "doc", "d1", "d2"), "cid"), f"{self.path}/left")
        wanted = sets.select("cid", "comp", "doc", "d1", "d2")
        if sets.count() <= FEW_IDS:
            wanted = F.broadcast(wanted)  # of a checked size
        parts = PARTS * int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found = self.docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("doc"))).select("cid", "comp", "d1", "d2", "text")
        alone = found.mapInArrow(_lone_given(parts), "part int, h binary, cid binary, comp binary").groupBy("part").applyInArrow(_lone, "cid long, n long")
        alone = alone.groupBy("cid").agg(F.sum("n").alias("u"))
        room = F.expr(f"{100 - THRESHOLD} * n - {100 + THRESHOLD} * coalesce(u, 0)")
        out = sets.select("cid", "n").join(alone, "cid", "left").withColumn("room", room)
        return stored(out.where(f"room * {THRESHOLD} + {100 * (100 - THRESHOLD)} * n >= 0").select("cid", "room"), f"{self.path}/rooms")

    def _many(self, own: DataFrame) -> bool:
        sizes = own.groupBy("key").agg(F.count("*").alias("c"))
        told = sizes.agg(F.sum("c").alias("rows"), F.sum(F.col("c").cast("double") * F.col("c")).alias("pairs")).first()
        return (told["pairs"] or 0) > ROOM_FROM * (told["rows"] or 0)

    def _crossed(self, own: DataFrame) -> DataFrame:
        """Pairs of a piece's members in different components; of many pairs those alone of which one member has room by
        itself. The sketch lets the join itself drop most."""
        told = own.join(self._rooms(own), "cid") if self._many(own) else own.withColumn("room", F.lit(0))
        told = told.join(self.classes.select("cid", "n", *SKETCH), "cid")
        told = stored(told, f"{self.path}/sketched")
        meet = "x.key = y.key AND x.cid <> y.cid AND (y.room < 0 OR x.cid < y.cid) AND x.room + y.room >= 0 AND (x.own OR y.own) AND x.comp <> y.comp AND " + _possible(SKETCH)
        pairs = told.where("room >= 0").alias("x").join(told.alias("y"), F.expr(meet))
        return pairs.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b"))

    def links(self) -> tuple[DataFrame | None, DataFrame | None]:
        """All links found (a, b) and the components of their classes (node, comp).

        A piece whose members have come together is done; the others meet another hub, at last each other.
        """
        links, labels, tested, own = None, None, None, self.members
        for turn in range(STARS + 1):
            own = self._open(own, labels, str(turn))
            pairs = self._starred(own, turn) if turn < STARS else self._crossed(own)
            if not turn:
                pairs = pairs.unionByName(self.couples)
            pairs = pairs.distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = self._with(pairs, f"pairs{turn}")
            tested = pairs if tested is None else tested.unionByName(pairs)
            if pairs.isEmpty():
                continue
            new = self.verified(pairs)
            links = new if links is None else links.unionByName(new)
            labels = components(links, f"{self.path}/components{turn}")
        return links, labels

    def component_ids(self) -> DataFrame:
        """doc_id, text_key, n, component_id and first (the id and text key of the document that stays) by document."""
        links, labels = self.links()
        nodes = self.classes.select("n", "d1", "d2", "cid")
        if labels is not None:
            nodes = nodes.join(labels, nodes["cid"] == labels["node"], "left").select("n", "d1", "d2", F.coalesce("comp", "cid").alias("comp"))
        else:
            nodes = nodes.withColumnRenamed("cid", "comp")
        nodes, kept = stored(nodes, f"{self.path}/nodes"), scratch(self.docs.sparkSession)
        in_comp = stored(self.rows.join(nodes, ["n", "d1", "d2"], "left").select("doc_id", "text_key", "n", "comp"), f"{kept}/in_comp")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
        heads = stored(in_comp.where("comp IS NOT NULL").groupBy("comp").agg(first), f"{kept}/heads")
        removed(self.docs.sparkSession, self.path)
        own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
        out = in_comp.join(heads, "comp", "left").withColumn("first", F.coalesce("first", own))
        return out.select("doc_id", "text_key", "n", F.col("first.doc_id").alias("component_id"), "first")


def row_key(docs: DataFrame, *others: str):
    """64 bits of the text and of other columns, but for maps, which have no hash."""
    hashed = [F.col(quoted(c)) for c in others if "map<" not in docs.select(F.col(quoted(c))).schema[0].dataType.simpleString()]
    return F.xxhash64(F.lit("text"), F.col("text"), *hashed)


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return Join(docs).component_ids().select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The documents, of each component the one of the smallest id; of equal ids the one with the least hash of all columns.

    Repeated rows count as one, as do rows of one id that have no words and are alike in all columns.
    """
    others = sorted(c for c in docs.columns if c not in ("doc_id", "text"))
    found = Join(docs, *others).component_ids()
    one, two, both = unused(docs, "s_id", "s_key", "s_both")
    stays = found.where("doc_id <=> first.doc_id AND text_key = first.text_key").select(F.col("doc_id").alias(one), F.col("text_key").alias(two)).distinct()
    stays = stored(stays.withColumn(both, F.xxhash64(one, two)), f"{scratch(docs.sparkSession)}/stays")
    key = row_key(docs, *others)
    kept = docs.withColumn(both, F.xxhash64(F.col("doc_id"), key)).join(stays, both).where(F.col("doc_id").eqNullSafe(F.col(one)) & (key == F.col(two)))
    return kept.dropDuplicates([both, one, two]).select(*columns(docs))  # where the join has dealt them to
