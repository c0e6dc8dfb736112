"""Chat formatting of maximal conversations, after collapse of cumulative snapshots.

Method. A chat log holds a conversation again after each turn, so most logged
conversations are the beginning of a longer one. Every conversation gets a
rolling hash per turn: the hash of turn n is SHA-256 of the hash of turn n - 1
and of turn n's role and text, so it stands for the whole prefix. Conversations
with the same last hash are the same; one is kept. The hashes of proper prefixes
are collected without repeats, and an anti-join keeps the conversations whose
last hash is none of them. Only those are rendered.

Scale: turns are hashed where they are read, and only hashes are shuffled until
the maximal conversations are known; then their texts are. Copies, and
conversations with the same beginning, meet as hashes that are reduced before
they are shuffled (sets and counts per task). A conversation's hashes, and the
text of a maximal one, are held as one row, as the rendered result is.

Rows: turns are ordered by ``turn`` (null last), then role, then the hash of their
content; rows equal in all four columns are one turn; null role and text count as
empty; rows of a null conv_id are one conversation; a group of equal
conversations has its smallest conv_id (null only if all are); further columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopcast.llm.common import materialize

#: Markers of a turn in the rendered text.
START, END = "<|im_start|>", "<|im_end|>"


def _turns(turns: DataFrame) -> DataFrame:
    """conv_id, role, text without nulls, and ``place``, by which a conversation's turns are sorted."""
    t = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    content = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    place = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"), F.col("role").alias("role"), content.alias("hash"))
    return t.select("conv_id", place.alias("place"), "role", "text")


def _newest(acc: Column) -> Column:
    """First element of a list that grows at its front, null if it is empty."""
    return F.try_element_at(acc, F.lit(1))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, hashes (of each prefix, the shortest first)."""
    convs = _turns(turns).groupBy("conv_id").agg(F.sort_array(F.collect_set("place")).alias("places"))
    step = lambda acc, t: F.concat(F.array(F.unhex(F.sha2(F.concat(F.coalesce(_newest(acc), F.lit(b"")), t["hash"]), 256))), acc)
    return convs.select("conv_id", F.reverse(F.aggregate("places", F.array().cast("array<binary>"), step)).alias("hashes"))


def maximal(turns: DataFrame) -> DataFrame:
    """Conversations that no longer one begins with: conv_id, n_copies, turns (role, text)."""
    hashes = materialize(prefix_hashes(turns))
    distinct = hashes.groupBy(F.element_at("hashes", -1).alias("last")).agg(F.min("conv_id").alias("kept_id"), F.count(F.lit(1)).alias("n_copies"))
    prefixes = hashes.select(F.explode(F.slice("hashes", 1, F.size("hashes") - 1)).alias("last")).distinct()
    kept = distinct.join(prefixes, "last", "left_anti").select("kept_id", "n_copies")
    rows = _turns(turns).join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    one = F.collect_set(F.struct("place", "role", "text"))
    convs = rows.groupBy("conv_id", "n_copies").agg(F.sort_array(one).alias("ts"))
    return convs.select("conv_id", "n_copies", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def render(convs: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """Adds the rendered ``text`` and, per turn, its role and the span of its content in ``text`` (from 0, end not included)."""
    head = lambda t: F.concat(F.lit(start), t["role"], F.lit("\n"))
    tail = F.lit(end + "\n")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], tail)), "")
    begin = lambda acc: F.coalesce(_newest(acc)["end"] + len(end) + 1, F.lit(0))
    span = lambda acc, t: F.concat(F.array(F.struct(t["role"].alias("role"), (begin(acc) + F.length(head(t))).alias("begin"), (begin(acc) + F.length(head(t)) + F.length(t["text"])).alias("end"))), acc)
    spans = F.reverse(F.aggregate("turns", F.array().cast("array<struct<role:string,begin:int,end:int>>"), span))
    return convs.withColumns({"text": whole, "spans": spans})


def format_chats(turns: DataFrame) -> DataFrame:
    """Maximal conversations of ``turns`` (conv_id, turn, role, text), rendered."""
    return render(maximal(turns))
