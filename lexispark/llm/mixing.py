"""Mixing sources to target weights by Pareto order sampling (operator 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.llm.common import WORD, Scratch, table

RANGES = 1024
SEED = "mix-1"


def _uniform(key: Column, seed: str) -> Column:
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"/{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sized: DataFrame, cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Per source: weight, source_size and target; water-filling with targets of at most ``cap`` source sizes.

    Sources are ranked by code point with null last and take the weights in turn. Saturated sources are those
    with the smallest cap * size / weight; the level is found by prefix sums over that order. One row per
    source is all that the global window sorts.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("rows"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    turn = (F.col("rank") - 1) % len(weights)
    chosen = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    by_room = Window.orderBy(F.col("source_size") * F.lit(cap) / F.col("w"), "rank")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("w", chosen.cast("long"))
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("room", F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double") * F.lit(cap))
        .withColumn("open_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("level", (F.col("all_size") - F.col("room")) / F.col("open_w"))
        .withColumn("fits", F.col("source_size") * F.lit(cap) >= F.col("level") * F.col("w"))
    )
    # with the sources in this order the level stays the same from the first that fits on
    first_fit = F.min(F.when(F.col("fits"), F.struct(F.col("source_size") * F.lit(cap) / F.col("w"), "rank", "level"))).over(everything)
    target = F.least(F.col("source_size") * F.lit(cap), F.coalesce(first_fit["level"], F.lit(float("inf"))) * F.col("w"))
    return filled.select("source", "w", "source_size", "rows", target.alias("target"))


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), seed: str = SEED) -> DataFrame:
    """Copies of every row so that the words taken of each source meet its target.

    Each row first gets the whole copies that target / source size makes certain. The rest of the target is a
    sample without replacement and with unequal probabilities: a row's inclusion odds l / (1 - l) are those of its
    source's rest, times its size over the mean size of the source, so that longer rows are likelier. Rows are ranked by
    their random odds u / (1 - u) over their inclusion odds and taken in that order while their words fit; then one more
    row, the one whose size comes nearest to the words still open, closes the gap if it narrows it. A source of any size is
    cut by two levels of histograms over the rank and a sort of one of their cells only.

    Returns key, source, size (words; null text 0), source_size, target, copies, taken. Null is a source of its
    own, ranked last; rows without words never change the mix; equal keys (repeated rows) are taken together,
    by one random number; an empty table gives no rows. The same rows and seed give the same mix.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.save(
        docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _uniform(F.col(key), seed).alias("u")),
        "sized",
    )
    targets = scratch.save(source_targets(sized, cap, weights), "targets").withColumnRenamed("source", "s")

    size, u = F.col("source_size"), F.col("u")
    plan = (
        targets.withColumn("whole", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("int"))
        .withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * size))
        .withColumn("rate", F.when(size > 0, F.least(F.col("rest") / size, F.lit(1.0))).otherwise(0.0))
    )
    # inclusion odds rate / (1 - rate) * own size / mean size; Pareto rank q = (u / (1 - u)) / odds, kept as q / (1 + q) in [0, 1]
    for_it, against = F.col("rate") * (F.col("size") * F.col("rows")).cast("double"), (1 - F.col("rate")) * size.cast("double")
    spot = F.when(for_it > 0, u * against / (u * against + (1 - u) * for_it)).otherwise(1.0)
    ranked = (
        sized.join(plan, sized["source"].eqNullSafe(plan["s"]))
        .drop("s")
        .withColumn("spot", spot)
        .withColumn("b1", F.floor(F.col("spot") * RANGES).cast("int"))
        .withColumn("b2", F.floor((F.col("spot") * RANGES - F.col("b1")) * RANGES).cast("int"))
    )

    def crossing(rows: DataFrame, by: str, start: Column, out: str) -> DataFrame:
        """Per source, the first range in which the words taken pass the rest, and the words before it."""
        upto = Window.partitionBy("source").orderBy(by)
        cells = rows.groupBy("source", by).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), F.first(start).alias("start"))
        cells = cells.withColumn("sum", F.col("start") + F.sum("n").over(upto)).filter(F.col("sum") > F.col("rest"))
        return cells.groupBy("source").agg(F.min_by(F.struct(F.col(by), (F.col("sum") - F.col("n")).alias("before")), by).alias("x")).select(F.col("source").alias("s"), F.col(f"x.{by}").alias(out), F.col("x.before").alias(f"{out}_before"))

    c1 = scratch.save(crossing(ranked, "b1", F.lit(0), "c1"), "c1")
    in1 = ranked.join(c1, F.col("source").eqNullSafe(c1["s"]) & (F.col("b1") == F.col("c1"))).drop("s")
    c2 = scratch.save(crossing(in1, "b2", F.col("c1_before"), "c2"), "c2")
    in2 = in1.join(c2, F.col("source").eqNullSafe(c2["s"]) & (F.col("b2") == F.col("c2"))).drop("s")
    order = Window.partitionBy("source").orderBy("spot", "key")
    run = in2.withColumn("sum", F.col("c2_before") + F.sum("size").over(order)).filter(F.col("sum") <= F.col("rest"))
    last = run.groupBy("source").agg(F.max(F.struct("spot", F.col("key").isNotNull().alias("has"), "key")).alias("last")).withColumnRenamed("source", "s")
    cuts = c1.join(c2.withColumnRenamed("s", "s2"), c1["s"].eqNullSafe(F.col("s2")), "left").drop("s2")
    cuts = cuts.join(last.withColumnRenamed("s", "s3"), cuts["s"].eqNullSafe(F.col("s3")), "left").drop("s3").withColumnRenamed("s", "s4")
    here = F.struct("spot", F.col("key").isNotNull().alias("has"), "key")
    inside = (
        F.col("c1").isNull()
        | (F.col("b1") < F.col("c1"))
        | ((F.col("b1") == F.col("c1")) & ((F.col("b2") < F.col("c2")) | ((F.col("b2") == F.col("c2")) & F.coalesce(here <= F.col("last"), F.lit(False)))))
    )
    drawn = ranked.join(cuts, F.col("source").eqNullSafe(cuts["s4"]), "left").withColumn("drawn", F.coalesce(inside, F.lit(False)) & (F.col("rest") > 0)).select("key", "source", "size", "source_size", "target", "whole", "rest", "spot", "drawn")
    drawn = scratch.save(drawn, "drawn")

    gap = drawn.groupBy("source").agg((F.first("rest") - F.coalesce(F.sum(F.when(F.col("drawn"), F.col("size"))), F.lit(0))).alias("gap")).withColumnRenamed("source", "s")
    miss = F.abs(F.col("gap") - F.col("size"))
    closing = (
        drawn.filter(~F.col("drawn") & (F.col("size") > 0))
        .join(gap, F.col("source").eqNullSafe(F.col("s")))
        .filter(miss < F.col("gap"))
        .groupBy("source")
        .agg(F.min(F.struct(miss.alias("miss"), "spot", F.col("key").isNull().alias("no"), "key")).alias("x"))
        .select(F.col("source").alias("s"), F.col("x.spot").alias("x_spot"), F.col("x.key").alias("x_key"))
    )
    closes = (F.col("spot") == F.col("x_spot")) & F.col("key").eqNullSafe(F.col("x_key"))
    copies = (F.col("whole") + F.when(F.col("drawn") | F.coalesce(closes & ~F.col("drawn"), F.lit(False)), 1).otherwise(0)).cast("int")
    return drawn.join(closing, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )


def op4_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = rf"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
         (('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || '/{SEED}'), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from documents),
totals as (select source, sum(size)::bigint as source_size, count_if(size > 0)::bigint as filled from sized group by source),
weighed as (select *, [1, 2, 3][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint as w,
                   row_number() over (order by source nulls last) as rank from totals),
levels as (
  select *, source_size * 3.0::double / w as room,
    ((sum(source_size) over ())::double - coalesce(sum(source_size) over (order by source_size * 3.0::double / w, rank rows between unbounded preceding and 1 preceding), 0)::double * 3.0::double)
      / (sum(w) over () - coalesce(sum(w) over (order by source_size * 3.0::double / w, rank rows between unbounded preceding and 1 preceding), 0))::double as level
  from weighed),
lvl as (select arg_min(level, (room, rank)) as level from levels where source_size * 3.0::double >= level * w),
plan as (
  select source, source_size, filled, least(source_size * 3.0::double, coalesce(lvl.level, 'inf'::double) * w) as target
  from levels, lvl),
parts as (select *, case when source_size > 0 then floor(target / source_size)::int else 0 end as whole from plan),
rests as (select *, greatest(0.0::double, target - whole * source_size) as rest from parts),
ranked as (
  select s.doc_id, s.size, s.u, r.*, case when source_size > 0 then least(rest / source_size, 1.0::double) else 0.0::double end as rate
  from sized s join rests r on s.source is not distinct from r.source),
odds as (select *, rate * (size * filled)::double as for_it, (1 - rate) * source_size::double as against from ranked),
spots as (select *, case when for_it > 0 then u * against / (u * against + (1 - u) * for_it) else 1.0::double end as spot from odds),
runs as (select *, rest > 0 and sum(size) over (partition by source order by spot, doc_id) <= rest as drawn from spots),
gaps as (select *, rest - sum(case when drawn then size else 0 end) over (partition by source) as gap from runs),
closes as (select source, arg_min(doc_id, (abs(gap - size), spot, doc_id)) as x from gaps where not drawn and size > 0 and abs(gap - size) < gap group by source)
select g.doc_id, g.size, g.source_size::bigint as source_size, g.target,
       (g.size * (g.whole + case when g.drawn or (c.x is not null and c.x = g.doc_id) then 1 else 0 end))::bigint as taken
from gaps g left join closes c on g.source is not distinct from c.source
"""
