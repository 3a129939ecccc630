"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

A source's target is its weight's share of all words, held to `MAX_REPEATS` times its size, with the excess dealt again by
weight. The mix is cut into equal blocks of `BLOCK` words, or fewer where the smallest target is less than `BLOCKS` of them. The
highest quotients votes / (2 j - 1) give blocks to sources (votes: targets), then to each source's shards (votes: the shard's
words). In a shard, documents lie in seeded order on a ring; its quota of blocks takes whole rounds of the ring and a run
of blocks from a seeded one. So a document's share is arithmetic over its place, and no block is ever a row.

Everything runs in the JVM. After the one scan that counts words, rows are three numbers a document; sources and shards
are pre-aggregated, and a hot source has more shards, not larger ones. Rows without an id are dealt by their text.

Defined results: a null text has size 0 and takes 0; null sources are one source, the last; sources of no words have target
0; with no words at all, all targets are 0; an empty table gives an empty result; rows that repeat are mixed each for
itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import WORD, boxed, few, staged, text_or_empty

#: Words of a block, and blocks of the smallest target above 0, at least while blocks have words.
BLOCK, BLOCKS = 64, 64
MAX_REPEATS = 3
SHARD_DOCS = 1024
SEED = "mix-1"


def word_count(text: Column | str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def _unit(salt: str, *parts: Column) -> Column:
    """A seeded number from 0 to 2**32 - 1 that any engine can compute."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def sainte_lague(parties: DataFrame, seats: str, votes: str, order: list[str], within: list[str]) -> DataFrame:
    """`parties` with `won`: the seats of each party by highest quotients; ties go to the first in `order`.

    Each group of `within` deals its own `seats`. Rounding votes by a divisor that seats too few in sum gives seats that all
    are won; rounding by one that seats too many bounds them. Only the quotients between are ranked, about two for each
    party, however many seats there are.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    v, n = F.col(votes).cast("double"), F.col(seats).cast("double")
    total, m = F.sum(v).over(group), F.count(F.lit(1)).over(group)
    bounded = (
        parties.withColumn("_v", total)
        .withColumn("_m", m)
        .withColumn("_low", F.when((F.col("_v") > 0) & (n - F.col("_m") / 2 - 1 > 0), F.floor(v * (n - F.col("_m") / 2 - 1) / F.col("_v") + 0.5)).otherwise(F.lit(0)).cast("long"))
        .withColumn("_high", F.when((F.col("_v") > 0) & (n > 0), F.floor(v * (n + F.col("_m") / 2 + 1) / F.col("_v") + 0.5)).otherwise(F.lit(0)).cast("long"))
        .withColumn("_left", F.col(seats).cast("long") - F.sum("_low").over(group))
    )
    keys = [*within, *order]
    quotients = bounded.where("_high > _low").select(*keys, "_low", "_left", v.alias("_votes"), F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_j"))
    ranked = quotients.withColumn("_rank", F.row_number().over(group.orderBy((F.col("_votes") / (2 * F.col("_j") - 1)).desc(), *order, "_j")))
    more = ranked.where("_rank <= _left").groupBy(*keys).agg(F.count(F.lit(1)).alias("_more"))
    return bounded.join(more, keys, "left").withColumn("won", F.col("_low") + F.coalesce("_more", F.lit(0))).drop("_v", "_m", "_low", "_high", "_left", "_more")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Per source_key: source_size, source_docs, target. Sources by code point, null last, weigh `weights`, repeating.

    Targets fill like water: with sources by the level where each is full, the level over those not full is the first that
    the next source bears, which is the highest of all. One row a source, so the windows run over pre-aggregated rows.
    """
    per = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    everything = Window.partitionBy(F.lit(0))
    nth = (F.row_number().over(everything.orderBy("source_key")) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (nth + 1).cast("int")).cast("double"))
    full = (MAX_REPEATS * F.col("source_size")).cast("double")
    before = everything.orderBy((full / F.col("w")), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    rest = everything.orderBy((full / F.col("w")), "source_key").rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("w").over(rest))
    # The level rises while full sources are passed over, and falls after.
    level = F.max(F.when(F.col("level") * F.col("w") <= full, F.col("level"))).over(everything)
    return per.withColumn("target", F.least(full, F.coalesce(level, F.lit(0.0)) * F.col("w"))).drop("level", "w")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: str = SEED) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, taken, whole.

    taken: the words that the mix takes, repeats counted. whole: how often it takes the document when none is cut, by
    where the document's middle lies.
    """
    key = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    own_id = F.col(doc_id).cast("long")
    at = F.when(own_id.isNull(), F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(_unit(seed, own_id))
    sizes = staged(docs.select(own_id.alias("doc_id"), key.alias("source_key"), word_count(text).alias("size"), at.alias("at")), "sizes")
    targets = source_targets(sizes)
    everything = Window.partitionBy(F.lit(0))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything) / BLOCKS))).cast("long")
    targets = targets.withColumn("block", block).withColumn("blocks", F.round(F.sum("source_size").over(everything) / F.col("block")).cast("long"))
    quotas = sainte_lague(targets, "blocks", "target", ["source_key"], []).withColumnRenamed("won", "source_blocks")
    quotas = staged(quotas.withColumn("shards", F.ceil(F.col("source_docs") / SHARD_DOCS)).select("source_key", "source_size", "target", "block", "source_blocks", "shards"), "quotas")
    dealt = sizes.join(quotas, "source_key").withColumn("shard", F.col("at") % F.col("shards"))
    per_shard = dealt.groupBy("source_key", "shard", "block", "source_blocks").agg(F.sum("size").alias("words"))
    won = sainte_lague(per_shard, "source_blocks", "words", ["shard"], ["source_key"]).where("words > 0")
    wanted = F.least(F.col("won") * F.col("block"), MAX_REPEATS * F.col("words"))
    first = _unit(seed + ":start", F.col("source_key"), F.col("shard")) % F.ceil(F.col("words") / F.col("block"))
    won = won.select("source_key", "shard", "words", (first * F.col("block")).alias("begin"), F.floor(wanted / F.col("words")).alias("rounds"), (wanted % F.col("words")).alias("run"))
    lane = Window.partitionBy("source_key", "shard").orderBy(_unit(seed + ":order", F.col("doc_id")), "doc_id", "at", "size")
    placed = dealt.where("size > 0").withColumn("hi", F.sum("size").over(lane.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(won, ["source_key", "shard"]).withColumn("lo", F.col("hi") - F.col("size"))
    end = F.col("begin") + F.col("run")
    overlap = lambda a, b: F.greatest(F.lit(0), F.least(F.col("hi"), b) - F.greatest(F.col("lo"), a))
    taken = F.col("rounds") * F.col("size") + overlap(F.col("begin"), F.least(end, F.col("words"))) + overlap(F.lit(0), end - F.col("words"))
    middle = F.col("lo") + F.floor(F.col("size") / 2)
    inside = ((middle >= F.col("begin")) & (middle < end)) | (middle < end - F.col("words"))
    whole = F.least(F.lit(MAX_REPEATS), F.col("rounds") + inside.cast("long"))
    shown = lambda rows, taken, whole: rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), whole.cast("int").alias("whole"))
    # Rows of no words have no place on a ring.
    return shown(placed, taken, whole).unionByName(shown(dealt.where("size = 0"), F.lit(0), F.lit(0)))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` as often as the mix takes them whole, with all their columns; empty texts leave.

    Rows that repeat an id and a size share their rounds evenly. Documents that are taken once, most of them, need no verdict;
    those of the rest are broadcast while they are few, so that texts stay where they are.
    """
    picks = staged(mix(docs).groupBy(F.col("doc_id").alias("id"), F.col("size").alias("n")).agg(F.ceil(F.sum("whole") / F.count(F.lit(1))).cast("int").alias("times")), "picks")
    changed = picks.where("times <> 1")
    changed = F.broadcast(changed) if few(changed) else changed
    # Sizes are counted again only where they tell rows of one id apart.
    unsure = picks.groupBy("id").agg(F.count(F.lit(1)).alias("sizes")).where("sizes > 1").limit(1).count()
    fresh, same = boxed(docs), F.col("doc.doc_id").cast("long").eqNullSafe(F.col("id"))
    if unsure:
        fresh = fresh.withColumn("size", word_count(F.col("doc.text")))
        same = same & (F.col("size") == F.col("n"))
    joined = fresh.join(changed, same, "left").withColumn("times", F.coalesce("times", F.lit(1))).where("times > 0")
    return joined.select("doc", F.explode(F.sequence(F.lit(1), "times")).alias("time")).select("doc.*")


SQL = r"""
with d as (select doc_id, case when source is null then '1' else '0' || source end as source_key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
per as (select source_key, sum(size)::bigint as source_size, count(*) as source_docs, ((row_number() over (order by source_key) - 1) % 3 + 1)::double as w from d group by source_key),
lev as (select *, (3 * source_size)::double as cap, ((sum(source_size) over ())::double - coalesce(sum((3 * source_size)::double) over (order by (3 * source_size)::double / w, source_key rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by (3 * source_size)::double / w, source_key rows between current row and unbounded following) as level from per),
tgt as (select source_key, source_size, source_docs, least(cap, coalesce(max(case when level * w <= cap then level end) over (), 0) * w) as target from lev),
blk as (select *, greatest(1, least(64, floor(min(case when target > 0 then target end) over () / 64)))::bigint as block from tgt),
s0 as (select *, round((sum(source_size) over ())::double / block) as n, sum(target) over () as v, count(*) over () as m from blk),
s1 as (select *, case when v > 0 and n - m / 2 - 1 > 0 then floor(target * (n - m / 2 - 1) / v + 0.5) else 0 end as low, case when v > 0 and n > 0 then floor(target * (n + m / 2 + 1) / v + 0.5) else 0 end as high from s0),
s2 as (select source_key, j, target / (2 * j - 1) as q from s1, unnest(generate_series(low::bigint + 1, high::bigint)) as u(j)),
s3 as (select source_key, count(*) as more from (select *, row_number() over (order by q desc, source_key, j) as r from s2) where r <= (select max(n) - sum(low) from s1) group by source_key),
src as (select s1.source_key, source_size, target, block, low::bigint + coalesce(more, 0) as source_blocks, ceil(source_docs / 1024)::bigint as shards from s1 left join s3 using (source_key)),
dealt as (select d.*, src.source_size, src.target, src.block, src.source_blocks, ('0x' || substr(md5('mix-1:' || doc_id), 1, 8))::bigint % shards as shard from d join src using (source_key)),
p0 as (select source_key, shard, block, source_blocks as n, sum(size)::bigint as words from dealt group by all),
p1 as (select *, sum(words) over (partition by source_key) as v, count(*) over (partition by source_key) as m from p0),
p2 as (select *, case when v > 0 and n - m / 2 - 1 > 0 then floor(words * (n - m / 2 - 1) / v + 0.5) else 0 end as low, case when v > 0 and n > 0 then floor(words * (n + m / 2 + 1) / v + 0.5) else 0 end as high from p1),
p3 as (select *, n - sum(low) over (partition by source_key) as leftover from p2),
p4 as (select source_key, shard, leftover, j, words::double / (2 * j - 1) as q from p3, unnest(generate_series(low::bigint + 1, high::bigint)) as u(j)),
p5 as (select source_key, shard, count(*) as more from (select *, row_number() over (partition by source_key order by q desc, shard, j) as r from p4) where r <= leftover group by all),
won as (select p3.source_key, p3.shard, block, words, least((low::bigint + coalesce(more, 0)) * block, 3 * words) as wanted from p3 left join p5 on p3.source_key = p5.source_key and p3.shard = p5.shard where words > 0),
ring as (select *, ('0x' || substr(md5('mix-1:start:' || source_key || ':' || shard), 1, 8))::bigint % ceil(words / block)::bigint * block as b, wanted // words as rounds, wanted % words as run from won),
lane as (select *, sum(size) over (partition by source_key, shard order by ('0x' || substr(md5('mix-1:order:' || doc_id), 1, 8))::bigint, doc_id, size rows between unbounded preceding and current row)::bigint as hi from dealt where size > 0),
fin as (select doc_id, size, source_size, target, words, b, rounds, run, hi, hi - size as lo, b + run as e from lane join ring on lane.source_key = ring.source_key and lane.shard = ring.shard)
select doc_id, size, source_size, target, (rounds * size + greatest(0, least(hi, least(e, words)) - greatest(lo, b)) + greatest(0, least(hi, e - words) - lo))::bigint as taken,
  least(3, rounds + case when (lo + size // 2 >= b and lo + size // 2 < e) or lo + size // 2 < e - words then 1 else 0 end)::int as whole
from fin
union all select doc_id, size, source_size, target, 0::bigint, 0::int from dealt where size = 0
"""
