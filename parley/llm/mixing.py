"""Mixing sources to target weights, by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import by_place, place, restored
from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK = 128
SHARD_ROWS = 4_000
#: Shards are dealt their quotas by bundles of this many, so no task ranks all shards of a source.
BUNDLE = 1_000
SEED = 17


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """(source, size) -> one row per source: __source, __rows, __source_size, __target.

    Sources by code point, null last, weigh as `weights` says, over and over.
    A target stops at `most` times the source's size; what is over is shared
    anew by weight. Sorted by size over weight the capped sources are a prefix,
    so the sharing has a closed form over running sums.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("__rows"), F.sum("size").alias("__source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = per.withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (turn + 1).cast("int")))
    cap = F.col("__source_size") * F.lit(float(most))
    by_fill = W.orderBy(cap / F.col("w"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    shared = weighed.select(
        "*",
        cap.alias("cap"),
        F.sum("__source_size").over(everything).alias("total"),
        F.sum("w").over(everything).alias("w_all"),
        F.coalesce(F.sum(cap).over(before), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"),
    )
    # the level of a source if all before it are capped; the first source below its cap fixes the level of the rest
    level = (F.col("total") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before"))
    leveled = (
        shared.withColumn("level", level)
        .withColumn("fill", F.row_number().over(by_fill))
        .withColumn("final", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("fill", "level"))).over(everything)["level"])
    )
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("w")))
    return leveled.select(F.col("source").alias("__source"), "__rows", "__source_size", target.alias("__target"))


def apportion(parties: DataFrame, group: list[str], votes: str, seats: str) -> DataFrame:
    """Sainte-Laguë: `seats` of each group go to its parties by the highest quotients votes/(2k+1); adds __quota.

    Seats that rounding votes over the divisor votes/seats gives for certain are
    taken at once; only quotients near the last seat are enumerated and ranked,
    so the rows ranked follow the number of parties and not of seats.
    """
    g = W.partitionBy(*group) if group else W.partitionBy()
    near = (
        parties.withColumn("__v", F.col(votes).cast("double"))
        .withColumn("__all", F.sum("__v").over(g))
        .withColumn("__guess", F.when(F.col("__all") > 0, F.floor(F.col("__v") * F.col(seats) / F.col("__all") + 0.5)).otherwise(F.lit(0)))
        .withColumn("__off", F.abs(F.col(seats) - F.sum("__guess").over(g)) + F.count("*").over(g))
        .withColumn("__reach", F.when(F.col("__all") > 0, F.ceil(F.col("__off") * F.col("__v") / F.col("__all")) + 2).otherwise(F.lit(0)))
        .withColumn("__low", F.greatest(F.lit(0), F.col("__guess") - F.col("__reach")))
        .withColumn("__left", F.col(seats) - F.sum("__low").over(g))
    )
    key = ["__party"]
    named = near.withColumn("__party", F.struct(*(F.col(c) for c in parties.columns)))
    tried = named.where("__v > 0").select(
        *group, "__party", "__left", "__v", F.explode(F.sequence(F.col("__low"), F.col("__guess") + F.col("__reach"))).alias("__k")
    )
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.desc(F.col("__v") / (2 * F.col("__k") + 1)), *(F.col("__party").getField(c).asc_nulls_last() for c in parties.columns)))
    won = tried.withColumn("__rank", rank).where("__rank <= __left").groupBy(*key).agg(F.count("*").alias("__won"))
    joined = named.join(won, named["__party"].eqNullSafe(won["__party"]), "left")
    return joined.select(*parties.columns, (F.col("__low") + F.coalesce("__won", F.lit(0))).cast("long").alias("__quota"))


def _hash(seed: int, *columns: str) -> Column:
    """A number below 16**15 from a seed and columns, the same in any SQL engine that has md5."""
    parts = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(parts.cast("binary")), 1, 15), 16, 10).cast("long")


def _planned(sizes: DataFrame, scratch: Scratch, weights, block: int, shard_rows: int, seed: int) -> DataFrame:
    """(doc_id, source, size and others by place) with source_size, target and copies."""
    total = F.sum("__source_size").over(W.partitionBy())  # long, so that no order of additions moves a block
    targets = source_targets(sizes, weights).withColumn("__blocks", F.floor((2 * total + block) / (2 * block)).cast("long"))
    quotas = apportion(targets, [], "__target", "__blocks").withColumnRenamed("__quota", "__source_blocks")
    sources = scratch.keep(quotas.drop("__blocks").withColumn("__shards", F.ceil(F.col("__rows") / shard_rows).cast("long")), "sources")
    small = sources.count() <= 10_000  # checked; more sources are shuffled
    sharded = sizes.join(F.broadcast(sources) if small else sources, sizes["source"].eqNullSafe(sources["__source"])).select(
        *sizes.columns, F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), "__source_blocks",
        (_hash(seed + 1, "doc_id", "size") % F.col("__shards")).cast("int").alias("shard"), _hash(seed, "doc_id", "size").alias("turn"),
    )
    shards = sharded.groupBy("source", "shard").agg(F.sum("size").alias("__shard_size"), F.first("__source_blocks").alias("__source_blocks"))
    shards = scratch.keep(shards.withColumn("bundle", F.floor(F.col("shard") / BUNDLE).cast("int")), "shards")
    bundles = shards.groupBy("source", "bundle").agg(F.sum("__shard_size").alias("__bundle_size"), F.first("__source_blocks").alias("__source_blocks"))
    dealt = apportion(bundles, ["source"], "__bundle_size", "__source_blocks").select(
        F.col("source").alias("__s"), F.col("bundle").alias("__b"), F.col("__quota").alias("__bundle_blocks")
    )
    within = shards.join(dealt, shards["source"].eqNullSafe(dealt["__s"]) & (shards["bundle"] == dealt["__b"])).select("source", "bundle", "shard", "__shard_size", "__bundle_blocks")
    quota = scratch.keep(apportion(within, ["source", "bundle"], "__shard_size", "__bundle_blocks").select(
        F.col("source").alias("__s"), F.col("shard").alias("__h"), "__shard_size", (F.col("__quota") * block).alias("__words")
    ), "quotas")
    few = quota.count() <= 100_000  # checked; more shards are shuffled
    both = sharded.join(F.broadcast(quota) if few else quota, sharded["source"].eqNullSafe(quota["__s"]) & (sharded["shard"] == quota["__h"]))
    rounds = F.when(F.col("__shard_size") > 0, F.least(F.lit(MAX_REPEATS), F.floor(F.col("__words") / F.col("__shard_size")))).otherwise(F.lit(0)).cast("long")
    missing = F.when(rounds < MAX_REPEATS, F.col("__words") - rounds * F.col("__shard_size")).otherwise(F.lit(0)).cast("long")
    carried = [c for c in sizes.columns if c != "source"]
    filled = (
        both.groupBy("source", "shard")
        .agg(
            F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first(rounds).alias("rounds"), F.first(missing).alias("missing"),
            F.array_sort(F.collect_list(F.struct("turn", *carried))).alias("rows"),
        )  # about shard_rows of them
        .withColumn("done", _greedy(F.col("rows"), F.col("missing")))
        .withColumn("nearest", _nearest(F.col("rows"), F.col("done.fits"), F.col("done.gap")))
        .select("source", "source_size", "target", "rounds", "nearest", "done", F.posexplode("rows").alias("at", "row"))
        .select("source", "source_size", "target", "rounds", *(f"row.{c}" for c in carried), (F.get("done.fits", F.col("at")) | F.coalesce(F.col("at") == F.col("nearest"), F.lit(False))).alias("extra"))
    )
    copies = F.when(F.col("size") > 0, F.col("rounds") + F.col("extra").cast("long")).otherwise(F.lit(0)).cast("long")
    return filled.select(*sizes.columns, "source_size", F.col("target").cast("double").alias("target"), copies.alias("copies"))


def _words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def mix(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights=WEIGHTS,
    block: int = BLOCK,
    shard_rows: int = SHARD_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """Per row: doc_id, size, source, source_size, target, copies (0 to 3) and taken (words, repeats counted).

    Blocks of `block` words go to sources, then to the shards of each source. A
    document's blocks stay together: a shard's quota is filled in a seeded order
    with full rounds of all its documents first, then each document that fits
    what is still missing, then the one document left that comes nearest to the
    rest. Null texts have size 0 and are never taken; a null source is a source
    of its own, last; rows with equal doc_id and size are alike, so reruns
    agree. An empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), _words(text).alias("size"))
    plan = _planned(scratch.keep(sizes, "sizes"), scratch, weights, block, shard_rows, seed)
    return plan.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _greedy(rows: Column, missing: Column) -> Column:
    """Rows in order, each taken if it fits what is still missing: struct of gap left and fits per row."""

    def step(acc: Column, row: Column) -> Column:
        fit = (row["size"] > 0) & (row["size"] <= acc["gap"])
        return F.struct((acc["gap"] - F.when(fit, row["size"]).otherwise(F.lit(0))).alias("gap"), F.array_append(acc["fits"], fit).alias("fits"))

    return F.aggregate(rows, F.struct(missing.alias("gap"), F.array().cast("array<boolean>").alias("fits")), step)


def _nearest(rows: Column, fits: Column, gap: Column) -> Column:
    """Place of the row left over whose size comes nearest to the gap, if taking it leaves less than the gap; else null."""

    def gain(row: Column, at: Column) -> Column:
        off = F.abs(gap - row["size"])
        return F.when(~F.get(fits, at) & (row["size"] > 0) & (off < gap), F.struct(off.alias("off"), at.alias("at")))

    return F.array_min(F.transform(rows, gain))["at"]


def mixed(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs, which may have any names.

    Rows alike in doc_id, source and text share the copies of their kind, and so
    are told apart by nothing but other columns.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    placed = by_place(docs)
    names = [place(docs, c) for c in (doc_id, source, text)]
    key = F.xxhash64(F.col(names[2]).cast("string"))
    sizes = placed.select(F.col(names[0]).alias("doc_id"), F.col(names[1]).cast("string").alias("source"), _words(names[2]).alias("size"), key.alias("key"))
    plan = _planned(scratch.keep(sizes, "sizes"), scratch, WEIGHTS, BLOCK, SHARD_ROWS, SEED)
    plan = scratch.keep(plan.groupBy("doc_id", "source", "key").agg(F.sum("copies").alias("n"), F.count("*").alias("alike")).where("n > 0"), "plan")
    joined = placed.withColumn("row_key", key).join(
        plan, F.col(names[0]).eqNullSafe(F.col("doc_id")) & (F.col("row_key") == F.col("key")) & F.col(names[1]).cast("string").eqNullSafe(F.col("source"))
    )
    alone = joined.where("alike = 1").withColumn("each", F.col("n").cast("int"))
    order = F.row_number().over(W.partitionBy("doc_id", "source", "key").orderBy(F.xxhash64(*placed.columns)))
    alike = joined.where("alike > 1").withColumn("each", F.ceil((F.col("n") - order + 1) / F.col("alike")).cast("int"))
    both = alone.unionByName(alike).where("each > 0")
    return restored(both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("each")))), docs)
