"""Chat formatting with cumulative-snapshot collapse.

Logs hold a conversation again after each answer. A conversation whose turns are the first turns of a longer one is dropped,
and of equal ones the smallest id stays; the maximal ones are rendered.

Turns get their place in the conversation, and each prefix a rolling hash: the sums, up to its place, of four 32-bit lanes of
md5(place, role, text). A whole conversation is dropped by an anti-join of its length and hash with the proper prefixes of
others. Sums over prefixes are associative, so a conversation is worked on in blocks of `BLOCK` turn numbers; only one row
per block meets the others of its conversation, and rendered text comes in one chunk per block.

Everything is DataFrame functions. Keys of both join sides are made distinct before the join, with partial sums before each
shuffle, so first turns that a third of all conversations share cost one row a task.

Defined results: rows that repeat wholly count once; rows of one turn number are ordered by role, then text, nulls first; a
null turn comes first; null ids are one conversation, with id null; a null role renders as "user", a null text as empty, yet
both differ from these when compared; roles are compared and rendered trimmed and lower-cased. No turn can end itself or
begin another: markers within texts are rendered with spaces inside ("<| im_end |>"), which no neighbouring characters can
make a marker again, and in roles each run of other characters than letters, digits and "_.-" is rendered as "_". An empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import staged

BLOCK = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LANES = ("h0", "h1", "h2", "h3")


def _lanes(place: Column, role: Column, text: Column) -> list[Column]:
    # Strings in a struct of JSON-like form, so that null, empty and shifted fields differ.
    part = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c))
    digest = F.md5(F.concat_ws("|", place.cast("string"), part(role), part(text)))
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def placed(turns: DataFrame) -> DataFrame:
    """key, conv_id, block, place (from 1), role, text: each turn's place in its conversation."""
    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.lower(F.trim(F.col("role").cast("string"))).alias("role"),
        F.col("text").cast("string").alias("text"),
    ).distinct()
    keyed = clean.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))).withColumn("block", F.floor(F.coalesce("turn", F.lit(-(2**62))) / BLOCK))
    blocks = keyed.groupBy("key", "block").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("key", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("key", "block").orderBy("turn", "role", "text")
    nth = keyed.withColumn("nth", F.row_number().over(own))
    return nth.join(blocks, ["key", "block"]).select("key", "conv_id", "block", (F.col("before") + F.col("nth")).alias("place"), "role", "text")


def prefixes(turns: DataFrame) -> DataFrame:
    """key, conv_id, place, turns (the conversation's number) and the rolling hash of its first `place` turns."""
    hashed = turns.select("key", "conv_id", "block", "place", *[c.alias(h) for c, h in zip(_lanes(F.col("place"), F.col("role"), F.col("text")), LANES, strict=True)])
    sums = hashed.groupBy("key", "block").agg(F.max("place").alias("end"), *[F.sum(h).alias(f"b_{h}") for h in LANES])
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("key")
    sums = sums.select("key", "block", F.max("end").over(every).alias("turns"), *[F.coalesce(F.sum(f"b_{h}").over(before), F.lit(0)).alias(f"b_{h}") for h in LANES])
    inside = Window.partitionBy("key", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolling = hashed.select("key", "conv_id", "block", "place", *[F.sum(h).over(inside).alias(h) for h in LANES])
    return rolling.join(sums, ["key", "block"]).select("key", "conv_id", "place", "turns", *[(F.col(h) + F.col(f"b_{h}")).alias(h) for h in LANES])


def maximal(turns: DataFrame) -> DataFrame:
    """key, turns, copies: the conversations that no other one contains as a prefix, and how many were equal to each."""
    rolling = staged(prefixes(turns), "prefixes")
    # A null id comes last among equals.
    smallest = F.min(F.struct(F.col("conv_id").isNull().alias("none"), F.col("conv_id"), F.col("key"))).alias("least")
    whole = rolling.where("place = turns").groupBy("turns", *LANES).agg(smallest, F.count(F.lit(1)).alias("copies"))
    proper = rolling.where("place < turns").select(F.col("place").alias("turns"), *LANES).distinct()
    return whole.join(proper, ["turns", *LANES], "left_anti").select(F.col("least.key").alias("key"), "turns", "copies")


def render(turns: DataFrame) -> DataFrame:
    """key, chunk, rendered: the turns of each block between markers, in order."""
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|(im_(?:start|end))\|>", r"<| $1 |>")
    role = F.regexp_replace(F.coalesce("role", F.lit("user")), r"[^\p{L}\p{N}_.-]+", "_")
    line = F.concat(F.lit(OPEN), role, F.lit("\n"), clean, F.lit(CLOSE), F.lit("\n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"])
    return turns.groupBy("key", "conv_id", "block").agg(F.min("place").alias("first_place"), F.array_join(lines, "").alias("rendered"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per chunk of each maximal conversation: conv_id, chunk (from 0), n_turns, copies, rendered."""
    turns = staged(placed(conversations), "turns")
    kept = maximal(turns)
    chunks = render(turns.join(kept, "key", "left_semi")).join(kept, "key")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("block")) - 1
    return chunks.select("conv_id", nth.cast("int").alias("chunk"), F.col("turns").cast("long").alias("n_turns"), F.col("copies").cast("long").alias("copies"), "rendered")


SQL = r"""
with t as (select distinct conv_id, turn, lower(trim(role)) as role, text from conversations),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as place from t),
c as (select conv_id, count(*) as n_turns, string_agg(md5(coalesce(length(role) || ':' || role, '-') || '|' || coalesce(length(text) || ':' || text, '-')), ',' order by place) || ',' as path,
  string_agg(array_to_string(['<|im_start|>', array_to_string(regexp_split_to_array('_' || coalesce(role, 'user') || '_', '[^\p{L}\p{N}_.-]+'), '_')[2:-2], chr(10),
    replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start |>'), '<|im_end|>', '<| im_end |>'), '<|im_end|>', chr(10)], ''), '' order by place) as rendered
  from o group by conv_id),
w as (select path, n_turns, min(conv_id) as conv_id, count(*) as copies from c group by path, n_turns),
p as (select distinct substr(path, 1, k * 33) as path from c, unnest(generate_series(1, n_turns - 1)) as u(k))
select w.conv_id, 0 as chunk, w.n_turns, w.copies, c.rendered from w join c using (conv_id) where not exists (select 1 from p where p.path = w.path)
"""
