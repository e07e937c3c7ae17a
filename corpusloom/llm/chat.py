"""Chat formatting: logged snapshots that a longer conversation begins with are collapsed, the rest is rendered.

A service that logs a conversation after each turn leaves its every prefix behind. A conversation's turns meet in one
row, as they must to be rendered, and are folded once: each turn gets a rolling hash of all turns up to it, SHA-256 of
the last hash and the turn's role and text. Half of it, 128 bits of a hash that nobody can make collide, stands for
the prefix. A conversation whose whole hash is a proper prefix hash of another one goes; of equal conversations the
one with the least id stays. The anti-join runs on distinct hashes: a first turn or a whole conversation that a third
of all logs share is one row on either side.

Turns are ordered by turn, then role, then text; repeated rows are turns of their own. Nulls: a null turn comes
first; a null role or text is rendered as empty, and is equal to no other value. A row without conversation id is a
conversation of its own and keeps a null id; equal ones collapse as any others. Other columns are ignored. An empty
table gives no rows. Very long texts are hashed and rendered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import small_side, written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _said(value: Column) -> Column:
    """A value with its length ahead, so that neighbours can't be mistaken; null differs from any."""
    return F.coalesce(F.concat(F.lit("="), F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def conversations(turns: DataFrame) -> DataFrame:
    """conv (a key), id, n (turns), times (rows it stands for), hashes (of each prefix, the whole last), turns (sorted structs)."""
    t = turns.select(turns["conv_id"].alias("id"), turns["turn"].alias("turn"), turns["role"].alias("role"), turns["text"].alias("text"))
    turn = F.struct("turn", "role", "text")
    one = F.lit(1).cast("long").alias("times")
    named = t.where("id IS NOT NULL").groupBy("id").agg(F.sort_array(F.collect_list(turn)).alias("turns")).select(F.concat(F.lit("="), F.col("id").cast("string")).alias("conv"), "id", one, "turns")
    # counted before they are moved: very many rows without id may be equal
    alone = t.where("id IS NULL").groupBy("id", "role", "text").agg(F.count("*").alias("times"), F.first("turn").alias("turn"))
    alone = alone.select(F.concat(F.lit("-"), F.sha2(F.concat(_said(F.col("role")), _said(F.col("text"))), 256)).alias("conv"), "id", "times", F.array(turn).alias("turns"))
    c = named.unionByName(alone)
    begin = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all"))

    def step(a: Column, x: Column) -> Column:
        h = F.sha2(F.concat(a["last"], _said(x["role"]), _said(x["text"])), 256)
        return F.struct(h.alias("last"), F.concat(a["all"], F.array(h)).alias("all"))

    # rows of one element: the fold is made once, and not again for each column that reads it
    folded = c.select("conv", "id", "times", "turns", F.inline(F.array(F.struct(F.aggregate("turns", begin, step, lambda a: a["all"]).alias("hashes")))))
    return folded.select("conv", "id", F.size("turns").alias("n"), "times", F.transform("hashes", lambda h: F.unhex(F.left(h, F.lit(32)))).alias("hashes"), "turns")


def maximal_conversations(c: DataFrame) -> DataFrame:
    """conv, id, n_turns, n_copies of each of the conversations that stays."""
    whole = c.select(F.element_at("hashes", -1).alias("h"), "conv", "id", "n", "times")
    whole = whole.groupBy("h").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "conv")).alias("first"), F.sum("times").alias("n_copies"), F.max("n").alias("n"))
    inner = c.where("n > 1").select(F.explode(F.slice("hashes", F.lit(1), F.col("n") - 1)).alias("h")).distinct()
    return whole.join(inner, "h", "left_anti").select("first.conv", "first.id", F.col("n").alias("n_turns"), "n_copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """Per conversation that stays: conv_id, n_turns, n_copies, chat. A marker inside a text gets a space after its first sign."""
    safe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    line = lambda x: F.concat(F.lit(OPEN), safe(x["role"]), F.lit("\n"), safe(x["text"]), F.lit(CLOSE + "\n"))
    c = conversations(turns)
    c = written(c.select("conv", "id", "n", "times", "hashes", F.array_join(F.transform("turns", line), "").alias("chat")), "conversations")
    kept = written(maximal_conversations(c.drop("chat")), "kept")
    out = c.select("conv", "chat").join(small_side(kept, F.lit(100)), "conv")
    return out.select(F.col("id").alias("conv_id"), F.col("n_turns").cast("long").alias("n_turns"), F.col("n_copies").cast("long").alias("n_copies"), "chat")


def oracle() -> str:
    safe = lambda c: f"replace(coalesce({c}, ''), '<|', '< |')"
    return f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place, role, text FROM conversations),
c AS (SELECT conv_id, count(*) AS n, list(md5(coalesce('=' || role, '-') || chr(0) || coalesce('=' || text, '-')) ORDER BY place) AS h,
             string_agg('{OPEN}' || {safe('role')} || chr(10) || {safe('text')} || '{CLOSE}' || chr(10), '' ORDER BY place) AS chat FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT h[1:k] AS h FROM (SELECT h, unnest(range(1, n)) AS k FROM c))
SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_copies, any_value(chat) AS chat FROM c WHERE h NOT IN (SELECT h FROM p) GROUP BY h, n"""
