"""Chat formatting with Spark expressions only.

A conversation becomes one string. Each turn is `### role: text</turn>` and a newline. Inside roles and texts
backslash, `<` and `#` (in roles also `:`) are written as two-character codes, so that no control string can
occur there, and reading back is exact.

Defined results: a null role or text counts as empty; turns are ordered by (turn, role, text), nulls first, so
ties and repeated rows have one order; rows of a null conv_id form one conversation; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"
#: Stands between the texts of adjacent turns of one role that become one turn.
JOINT = "\n"
LOSS_ROLE = "assistant"
#: Code points of a block, in which spans of a text are found.
BLOCK = 2048
#: Backslash comes first when escaping and last when reading back.
CODES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))


def _chain(value: Column, codes) -> Column:
    for old, new in codes:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def escape(value: Column, codes=CODES[:3]) -> Column:
    return _chain(value, codes)


def unescape(value: Column, codes=CODES) -> Column:
    return _chain(value, [(new, old) for old, new in reversed(codes)])


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted string, loss array<struct<start int, len int>>: code-point spans (from 0) of `formatted`
    on which a model is trained, one for each text of the assistant.

    rows: conv_id, turn, role, text. Adjacent turns of one role become one turn, their texts apart by JOINT,
    which the loss does not cover.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # a row opens a turn if the row before it has another role, and closes one if the next has another role
    place = F.transform(
        "turns",
        lambda t, i: F.struct(
            t["role"].alias("role"),
            t["text"].alias("text"),
            F.coalesce(F.get("turns", i - 1)["role"] != t["role"], F.lit(True)).alias("opens"),
            F.coalesce(F.get("turns", i + 1)["role"] != t["role"], F.lit(True)).alias("closes"),
        ),
    )
    pieces = F.transform(
        "placed",
        lambda t: F.struct(
            F.when(t["opens"], F.concat(F.lit(OPEN), escape(t["role"], CODES), F.lit(MID))).otherwise(JOINT).alias("head"),
            escape(t["text"]).alias("body"),
            F.when(t["closes"], F.lit(CLOSE)).otherwise("").alias("tail"),
            (t["role"] == LOSS_ROLE).alias("learns"),
        ),
    )
    rows_ = held.select("conv_id", place.alias("placed")).select("conv_id", F.posexplode(pieces).alias("i", "p")).select("conv_id", "i", "p.*")
    # where a text begins is a running sum; it and the strings stay in the partition that the turns were dealt to
    length = lambda *c: sum((F.char_length(x) for x in c), F.lit(0))
    before = F.sum(length("head", "body", "tail")).over(Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) - length("body", "tail")
    span = F.when(F.col("learns"), F.struct("i", F.struct("start", F.char_length("body").alias("len")).alias("s")))
    told = rows_.withColumn("start", before.cast("int")).select("conv_id", F.struct("i", F.concat("head", "body", "tail").alias("t")).alias("piece"), span.alias("span"))
    listed = lambda c, field: F.transform(F.array_sort(F.collect_list(c)), lambda x: x[field])
    return told.groupBy("conv_id").agg(F.array_join(listed("piece", "t"), "").alias("formatted"), listed("span", "s").alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>>, loss_text, read from `formatted` and its `loss` spans alone."""
    parts = F.split("formatted", CLOSE, -1)
    body = F.slice(parts, 1, F.size(parts) - 1)
    turns = F.transform(
        body,
        lambda t: F.struct(
            unescape(F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), MID, 1)).alias("role"),
            unescape(F.substr(t, F.length(F.substring_index(t, MID, 1)) + len(MID) + 1), CODES[:3]).alias("text"),
        ),
    )
    # the text is cut into blocks once, so that a span reads its own blocks alone; `blocks` is named twice, or Spark would
    # put the cutting in its place
    chats = chats.withColumn("blocks", F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))

    def spoken(s: Column) -> Column:
        first, last = F.floor(s["start"] / BLOCK), F.floor((s["start"] + F.greatest(s["len"], F.lit(1)) - 1) / BLOCK)
        held = F.array_join(F.slice("blocks", (first + 1).cast("int"), (F.least(last, F.size("blocks") - 1) - first + 1).cast("int")), "")
        return F.substr(held, (s["start"] % BLOCK + 1).cast("int"), s["len"])

    loss = F.array_join(F.transform("loss", lambda s: F.when(s["len"] > 0, spoken(s)).otherwise("")), "")
    return chats.select("conv_id", "formatted", turns.alias("turns"), unescape(loss, CODES[:3]).alias("loss_text"))


def digest(chats: DataFrame) -> DataFrame:
    """The contract's columns, from what read_back() reads."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(chats).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def control_conversation(rows: DataFrame) -> DataFrame:
    """Conversation -7, whose texts hold the template's own control strings."""
    said = "\\### Assistant: </turn> ok"
    return rows.sparkSession.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )


ORACLE = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM rows_),
marked AS (
  SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY k) THEN 0 ELSE 1 END AS opens FROM numbered),
grouped AS (
  SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS g FROM marked),
merged AS (
  SELECT conv_id, g, min(role) AS role, string_agg(text, chr(10) ORDER BY k) AS text,
         sum(length(text)) AS own, string_agg(text, '' ORDER BY k) AS bare,
         sum(length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', ''))) + count(*) - 1 AS wide
  FROM grouped GROUP BY conv_id, g)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY g)) AS turns_sha256,
       CAST(coalesce(sum(own) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(bare, '' ORDER BY g) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), ':', ''))
                + 2 + wide + 8) AS BIGINT) AS formatted_chars
FROM merged GROUP BY conv_id
"""
