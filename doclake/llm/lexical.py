"""Ranked lexical search over a length-stratified index.

Documents whose length gives the same normaliser m are a stratum. A stratum is held in blocks of up to BLOCK documents;
a block has its terms in order, and for each term its postings by term frequency: runs of documents that hold the term
equally often. So what a term counts for in a document (its impact) is computed once for each tf that a stratum's term
has, not for each posting, and a posting is the number of a document alone.

Of a block, its terms' greatest tf bound what it can score for an item. Bounds order the visits: first each item's BEST
blocks of greatest bound are scored, which gives the score that a document has to reach at least; then of all other
blocks only those are opened whose bound reaches it, in the order of their bounds, while the mark rises within a task.
A bound equal to the mark is visited, since the document's id may decide. So the result is that of scoring everything.

The index is written by Spark in two passes over the texts. The first counts terms, lengths and, of the terms that are
asked for, documents; the second makes postings. Texts are not shuffled.

Defined results: a null text has no terms, and documents without terms score nothing; each row of items is an item, also
if ids repeat; a null or empty item has no results; equal scores go by ascending doc_id, null ids last, of repeated rows
each has a rank of its own; an empty table of documents or items gives no rows; other columns are ignored, whatever their
names; very long texts are read whole. Items are searched for in groups of ITEMS, which are what a task holds of them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclake.llm.common import removed, scratch, slices, stored, trimmed

TOP = 50
#: The share of the length in the normaliser, in hundredths, and the weight of the tf's saturation in thousandths.
LENGTH, SATURATION = 50, 20
#: Documents of a block.
BLOCK = 4096
#: Items that are searched for together.
ITEMS = 2000
#: Blocks of an item that are scored first.
BEST = 2
#: Postings that are added up at once.
GATHERED = 1 << 20
#: What is no term, as a space; only A-Z are lower-cased. Bytes of letters beyond ASCII are 128 and more.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def normaliser(n: int, n_docs: int, n_terms: int) -> int:
    return 100 - LENGTH + (LENGTH * n * n_docs) // n_terms


def impact(tf, m: int):
    """What a term of that frequency counts for in a document of the stratum, times its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + SATURATION * m)


def _counted(wanted: dict[bytes, int]):
    """Of each task: documents by their number of terms (kind 0), and documents that hold each wanted term (kind 1)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        lengths: dict[int, int] = {}
        held = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for _, texts in slices(batch):
                for text in texts:
                    own = terms_of(text)
                    lengths[len(own)] = lengths.get(len(own), 0) + 1
                    found = [wanted[t] for t in set(own) if t in wanted]
                    held[found] += 1
        some = np.flatnonzero(held)
        kinds = [0] * len(lengths) + [1] * len(some)
        yield pa.RecordBatch.from_pydict({
            "kind": pa.array(kinds, pa.int32()), "key": pa.array([*lengths, *some.tolist()], pa.int64()), "f": pa.array([*lengths.values(), *held[some].tolist()], pa.int64()),
        })
        trimmed()

    return run


def _postings(wanted: dict[bytes, int], n_docs: int, n_terms: int, blocks: dict[int, int]):
    """m, block, doc_id, terms, tfs (packed) of the documents that hold a wanted term. blocks: of a stratum, if over 1."""

    def run(batches):
        import collections

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for batch in batches:
            for part, texts in slices(batch):
                rows, out = [], ([], [], [], [])
                for i, text in enumerate(texts):
                    own = terms_of(text)
                    found = collections.Counter(filter(None, map(wanted.get, own)))  # 0 is no term
                    if found:
                        m = normaliser(len(own), n_docs, n_terms)
                        rows.append(i)
                        told = (m, task % blocks.get(m, 1), np.fromiter(found, np.int32).tobytes(), np.fromiter(found.values(), np.int32).tobytes())
                        for held, x in zip(out, told, strict=True):
                            held.append(x)
                ids = part.column("doc_id").take(pa.array(rows, pa.int64()))
                types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
                m, block, terms, tfs = (pa.array(x, t) for x, t in zip(out, types, strict=True))
                yield pa.RecordBatch.from_arrays([m, block, ids, terms, tfs], ["m", "block", "doc_id", "terms", "tfs"])
        trimmed()

    return run


def _blocks(table, block: int):
    """One part of a stratum as blocks: terms in order, for each its runs by tf, and the documents of each run."""
    import numpy as np
    import pyarrow as pa

    out = []
    for start in range(0, table.num_rows, block):
        own = table.slice(start, block).combine_chunks()
        terms = [np.frombuffer(x, np.int32) for x in own.column("terms").to_pylist()]
        doc = np.repeat(np.arange(len(terms), dtype=np.int16), [len(t) for t in terms])
        term, tf = np.concatenate(terms), np.frombuffer(b"".join(own.column("tfs").to_pylist()), np.int32)
        order = np.lexsort((doc, tf, term))
        term, tf, doc = term[order], tf[order], doc[order]
        run = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])))
        first = np.flatnonzero(np.append(True, term[run][1:] != term[run][:-1]))  # of each term among the runs
        last = np.append(first[1:], len(run)) - 1
        out.append({
            "m": own.column("m")[0].as_py(), "part": own.column("block")[0].as_py(), "nth": start // block, "ids": own.column("doc_id").to_pylist(),
            "terms": term[run][first].tobytes(), "top_tf": tf[run][last].tobytes(), "runs_of": np.append(first, len(run)).astype(np.int32).tobytes(),
            "tfs": tf[run].tobytes(), "docs_of": np.append(run, len(term)).astype(np.int32).tobytes(), "docs": doc.tobytes(),
        })
    schema = [("m", pa.int64()), ("part", pa.int32()), ("nth", pa.int32()), ("ids", pa.list_(table.schema.field("doc_id").type))]
    return pa.Table.from_pylist(out, pa.schema([*schema, *[(c, pa.binary()) for c in ("terms", "top_tf", "runs_of", "tfs", "docs_of", "docs")]]))


class Index:
    """The written blocks of documents for a set of terms, and what weighs them."""

    def __init__(self, docs: DataFrame, terms: list[bytes], path: str, block: int = BLOCK):
        rows = docs.select("doc_id", "text")
        id_type = docs.schema["doc_id"].dataType.simpleString()
        self.number = {t: i for i, t in enumerate(sorted(set(terms)), 1)}
        counted = rows.select("text").mapInArrow(_counted({t: i - 1 for t, i in self.number.items()}), "kind int, key long, f long")
        counted = stored(counted.groupBy("kind", "key").agg(F.sum("f").alias("f")), f"{path}/counted")
        lengths = counted.where("kind = 0 AND key > 0")
        total = lengths.agg(F.sum("f").alias("docs"), F.sum(F.col("key") * F.col("f")).alias("terms")).first()
        self.n_docs, self.n_terms = total["docs"] or 0, total["terms"] or 0
        df = {r["key"] + 1: r["f"] for r in counted.where("kind = 1").collect()}  # a row for each term that is asked for
        self.weights = {t: weight(self.n_docs, df[i]) for t, i in self.number.items() if i in df}
        # strata are as many as lengths of documents tell apart, a bound that does not grow with their number
        m = F.expr(f"{100 - LENGTH} + ({LENGTH} * key * {max(1, self.n_docs)}L) DIV {max(1, self.n_terms)}L")
        full = lengths.groupBy(m.alias("m")).agg(F.sum("f").alias("f")).where(F.col("f") > block)
        parts = {r["m"]: -(-r["f"] // block) for r in full.collect()}
        wanted = {t: i for t, i in self.number.items() if t in self.weights}
        made = rows.mapInArrow(_postings(wanted, self.n_docs, self.n_terms, parts), f"m long, block int, doc_id {id_type}, terms binary, tfs binary")
        packed = ", ".join(f"{c} binary" for c in ("terms", "top_tf", "runs_of", "tfs", "docs_of", "docs"))
        blocks = made.groupBy("m", "block").applyInArrow(lambda t: _blocks(t, block), f"m long, part int, nth int, ids array<{id_type}>, {packed}")
        self.blocks = stored(blocks, f"{path}/blocks")
        self.id_type = id_type

    def query(self, items: list[list[bytes]]) -> Query:
        return Query(items, self.number, self.weights)


class Query:
    """A group of items as arrays: of each entry (an item's term) the item, the term's number, its weight."""

    def __init__(self, items: list[list[bytes]], number: dict[bytes, int], weights: dict[bytes, int]):
        import numpy as np

        own = [[t for t in dict.fromkeys(x) if t in weights] for x in items]
        self.n = len(items)
        self.item = np.repeat(np.arange(self.n), [len(x) for x in own])
        self.number = np.array([number[t] for x in own for t in x], np.int64)
        self.weight = np.array([weights[t] for x in own for t in x], np.int64)
        self.starts = np.cumsum([0, *[len(x) for x in own]])

    def met(self, m: int, terms, top_tf):
        """(place of each entry's term in a block, which of them are there, what each item can score at most)."""
        import numpy as np

        place = np.minimum(np.searchsorted(terms, self.number), len(terms) - 1)
        there = terms[place] == self.number
        most = np.where(there, impact(top_tf[place].astype(np.int64), m) * self.weight, 0)
        sums = np.append(0, np.cumsum(most))
        return place, there, sums[self.starts[1:]] - sums[self.starts[:-1]]


class Block:
    """An opened block."""

    def __init__(self, row: dict):
        import numpy as np

        self.ids = row["ids"]
        runs_of, tfs, docs_of = (np.frombuffer(row[c], np.int32) for c in ("runs_of", "tfs", "docs_of"))
        self.docs = np.frombuffer(row["docs"], np.int16)
        impacts = impact(tfs.astype(np.int64), row["m"])  # once for each tf of a term in the stratum
        self.impacts = np.repeat(impacts, np.diff(docs_of))
        self.begins = docs_of[runs_of].astype(np.int64)  # of each term among the postings

    def scores(self, query: Query, place, there, items, most: int, gathered: int = GATHERED):
        """(some of the items, their scores by document) until all items are told. most: the greatest bound."""
        import numpy as np

        chosen = np.full(query.n, -1)
        chosen[items] = np.arange(len(items))
        entry = np.flatnonzero(there & (chosen[query.item] >= 0))
        start, size = self.begins[place[entry]], np.diff(self.begins)[place[entry]]
        row, total = chosen[query.item[entry]], np.cumsum(size)
        first = 0
        while first < len(items):  # as many items as `gathered` postings allow, one at least
            x = np.searchsorted(row, first)
            y = np.searchsorted(total, (total[x - 1] if x else 0) + gathered, "right")
            last = len(items) if y >= len(entry) else max(first + 1, int(row[y]))
            last = min(last, first + max(1, gathered // len(self.ids)))
            y = np.searchsorted(row, last)
            n = size[x:y]
            at = np.arange(n.sum()) + np.repeat(start[x:y] - np.cumsum(n) + n, n)
            cell = np.repeat(row[x:y] - first, n) * len(self.ids) + self.docs[at]
            value = self.impacts[at] * np.repeat(query.weight[entry[x:y]], n)
            cells = (last - first) * len(self.ids)
            if most < 1 << 53:  # sums in doubles are exact
                out = np.bincount(cell, value, cells).astype(np.int64)
            else:
                out = np.zeros(cells, np.int64)
                np.add.at(out, cell, value)
            yield items[first:last], out.reshape(last - first, len(self.ids))
            first = last


def _order(hit):
    score, id_ = hit
    return -score, id_ is None, id_


def _best(held: list, scores, ids, top: int, mark: int) -> list:
    """held and the documents that score `mark` or more, the `top` first of them."""
    import numpy as np

    if len(scores) > top:
        mark = max(mark, int(np.partition(scores, len(scores) - top)[len(scores) - top]))
    found = np.flatnonzero(scores >= mark)
    if not len(found):
        return held
    return sorted([*held, *zip(scores[found].tolist(), (ids[i] for i in found.tolist()), strict=True)], key=_order)[:top]


def _leading(query, best: int):
    """item, bound, m, part, nth of each item's blocks of greatest bounds in a task."""

    def run(batches):
        import heapq

        import numpy as np
        import pyarrow as pa

        held: list[list] = [[] for _ in range(query.n)]
        least = np.zeros(query.n, np.int64)
        for batch in batches:
            for m, part, nth, terms, top_tf in zip(*(batch.column(c).to_pylist() for c in ("m", "part", "nth", "terms", "top_tf")), strict=True):
                bounds = query.met(m, np.frombuffer(terms, np.int32), np.frombuffer(top_tf, np.int32))[2]
                for item in np.flatnonzero(bounds > least).tolist():
                    own, entry = held[item], (int(bounds[item]), m, part, nth)
                    (heapq.heappush if len(own) < best else heapq.heapreplace)(own, entry)
                    if len(own) == best:
                        least[item] = own[0][0]
        rows = [(i, *x) for i, own in enumerate(held) for x in own]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["item", "bound", "m", "part", "nth"])

    return run


def _visited(query, top: int, marks, done: dict[tuple, set[int]], only: bool, gathered: int):
    """item, score, doc_id of the first `top` of each item in a task.

    marks: the score that a document has to reach by item. done: items by block (m, part, nth); with `only` these are the
    visits, else all others.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        best: list[list] = [[] for _ in range(query.n)]
        mark, given_type = np.maximum(np.array(marks, np.int64), 1), None
        for batch in batches:
            given_type = batch.schema.field("ids").type.value_type
            plan = []
            heads = zip(*(batch.column(c).to_pylist() for c in ("m", "part", "nth", "terms", "top_tf")), strict=True)
            for i, (m, part, nth, terms, top_tf) in enumerate(heads):
                told = done.get((m, part, nth), ())
                if only and not told:
                    continue
                place, there, bounds = query.met(m, np.frombuffer(terms, np.int32), np.frombuffer(top_tf, np.int32))
                if only:
                    bounds[~np.isin(np.arange(query.n), list(told))] = 0
                elif told:
                    bounds[list(told)] = 0
                if (bounds >= mark).any():
                    plan.append((int(bounds.max()), i, bounds, place, there))
            for most, i, bounds, place, there in sorted(plan, key=lambda p: -p[0]):
                items = np.flatnonzero(bounds >= mark)  # which may have risen
                if not len(items):
                    continue
                block = Block(batch.slice(i, 1).to_pylist()[0])
                for some, scores in block.scores(query, place, there, items, most, gathered):
                    for item in np.flatnonzero((scores >= mark[some][:, None]).any(axis=1)).tolist():
                        own = int(some[item])
                        best[own] = _best(best[own], scores[item], block.ids, top, int(mark[own]))
                        if len(best[own]) == top:
                            mark[own] = max(mark[own], best[own][-1][0])
        rows = [(i, s, d) for i, own in enumerate(best) for s, d in own]
        types = (pa.int32(), pa.int64(), given_type or pa.null())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["item", "score", "doc_id"])
        trimmed()

    return run


def _search(index: Index, items: list[list[bytes]], top: int, path: str, best: int, gathered: int) -> DataFrame:
    """item (its place), rank, doc_id, score."""
    query = index.query(items)
    out_type = f"item int, score long, doc_id {index.id_type}"
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "m", "part", "nth")
    heads = index.blocks.select("m", "part", "nth", "terms", "top_tf").mapInArrow(_leading(query, best), "item int, bound long, m long, part int, nth int")
    first = heads.withColumn("n", F.row_number().over(order)).where(F.col("n") <= best).collect()  # so many rows an item
    done: dict[tuple, set[int]] = {}
    for r in first:
        done.setdefault((r["m"], r["part"], r["nth"]), set()).add(r["item"])
    none = [0] * len(items)
    strata = sorted({k[0] for k in done})
    seeds = index.blocks.where(F.col("m").isin(strata)).mapInArrow(_visited(query, top, none, done, True, gathered), out_type)
    seeds = stored(seeds, f"{path}/seeds")
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = lambda df: df.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top)
    marks = list(none)
    for r in ranked(seeds).where(F.col("rank") == top).collect():  # a row an item
        marks[r["item"]] = r["score"]
    rest = index.blocks.mapInArrow(_visited(query, top, marks, done, False, gathered), out_type)
    return stored(ranked(seeds.unionByName(rest)), f"{path}/hits")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK, at_once: int = ITEMS, best: int = BEST, gathered: int = GATHERED) -> DataFrame:
    """item_id, rank, doc_id, score: for each item (item_id, text) the `top` documents (doc_id, text) of highest scores.

    The other arguments, whose defaults are described above, bound what a task holds; they change no result.
    """
    spark, path = docs.sparkSession, scratch(docs.sparkSession)
    asked = stored(items.select("item_id", "text").withColumn("nth", F.monotonically_increasing_id()), f"{path}/items")
    out, kept, last = None, scratch(spark), -1
    for turn in range(-(-asked.count() // at_once)):
        own = asked.where(F.col("nth") > last).orderBy("nth").limit(at_once).collect()
        last, words = own[-1]["nth"], [terms_of(r["text"]) for r in own]
        index = Index(docs, [t for x in words for t in x], f"{path}/index{turn}", block)
        hits = _search(index, words, top, f"{path}/index{turn}", best, gathered)
        names = spark.createDataFrame([(i, r["nth"]) for i, r in enumerate(own)], "item int, nth long")  # at_once rows at most
        told = hits.join(F.broadcast(names), "item").join(asked.select("nth", "item_id"), "nth").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        told = stored(told, f"{kept}/hits{turn}")
        removed(spark, f"{path}/index{turn}")
        out = told if out is None else out.unionByName(told)
    removed(spark, path)
    if out is None:
        out = spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    return out


ORACLE = r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
held AS (SELECT row, doc_id, len(w) AS n FROM words WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM held),
tfs AS (SELECT row, t, count(*) AS tf FROM (SELECT row, unnest(w) AS t FROM words) GROUP BY ALL),
dfs AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tfs, total GROUP BY t, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
scored AS (
  SELECT item_id, doc_id, row, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN dfs USING (t) JOIN tfs USING (t) JOIN held USING (row), total GROUP BY item_id, doc_id, row)
SELECT * FROM (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, row))::INT AS rank, doc_id, score FROM scored WHERE score > 0)
WHERE rank <= 50
"""
