"""Mixing sources to target weights (operator 5), in DataFrame operations only.

Each source has a target in words. The mix is a whole number of blocks of ``block`` words; Sainte-Lague apportionment deals them to
the sources by highest quotient target / (2k + 1), and each source's blocks to its shards in the same way. A shard is a line of
documents in seeded order, cut into blocks; its quota is filled by whole passes over the line and one run of blocks from
a seeded start, so that few documents are cut and none is taken more often than there are passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
BLOCK = 64
DOCS_PER_SHARD = 8192
SEED = 42
#: Halvings of the interval that holds a group's divisor.
STEPS = 64


def sized(docs: DataFrame, docs_per_shard: int, seed: int) -> DataFrame:
    """doc_id, source, size in words, a hash of the text, shard of the source and seeded place in its line. A source has a shard for each ``docs_per_shard``."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("text_key"))
    rows = materialize(rows, "sizes")
    shards = rows.groupBy(F.col("source").alias("_source")).agg(F.ceil(F.count(F.lit(1)) / docs_per_shard).alias("_shards"))
    key = F.xxhash64(F.lit(seed), "doc_id", "size")
    rows = rows.join(shards, F.col("source").eqNullSafe(F.col("_source")))
    return rows.select("doc_id", "source", "size", "text_key", key.alias("place"), F.pmod(F.xxhash64(key, F.lit(1)), F.col("_shards")).cast("int").alias("shard"))


def source_targets(cells: DataFrame, weights: Sequence[float], share: float, repeats: float) -> DataFrame:
    """source, source_size and target of each source, from rows (source, size).

    Sources sort by code point, nulls last, and weigh ``weights``, repeating. Targets share ``share`` of all sizes by weight;
    one that would pass ``repeats`` times its source's size stops there and the rest share the excess by weight. With
    sources by size / weight, that level is found by running sums. Its windows see a row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy(F.col("size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    sums = cells.groupBy("source").agg(F.sum("size").alias("size")).withColumn("weight", weight)
    level = (
        sums.withColumns({"total": F.lit(float(share)) * F.sum("size").over(everything), "cap": F.lit(float(repeats)) * F.col("size")})
        .withColumns({"capped": F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "free": F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))})
        # the level if all before this source are capped and none from here on
        .withColumn("rise", (F.col("total") - F.col("capped")) / F.col("free"))
        # the first source that stays under its cap sets the level; when none does, all are capped
        .withColumn("level", F.min(F.when(F.col("rise") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("source").isNull().alias("last"), "source", "rise"))).over(everything)["rise"])
    )
    return level.select("source", F.col("size").alias("source_size"), F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def sainte_lague(rows: DataFrame, seats: Column, share: Column, most: Column, within: list[str], ties: list[Column]) -> DataFrame:
    """Add ``quota``: of the ``seats`` of each group ``within``, those that each row's ``share`` wins by highest quotient.

    The quotients share / (2k + 1) of at least 1 / (2 d) win floor(share * d + 1/2) seats at once, for a row's bound ``most`` at the most. Bisection finds the
    d of each group, a sum a step, at which these are just not more than the seats; only the quotients next to that cut, three a row, are ranked.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))
    keep = rows.columns
    rows = rows.withColumns({"_seats": seats, "_share": share.cast("double"), "_most": F.greatest(most, F.lit(0)).cast("long")})
    won_at = lambda d: F.least(F.floor(F.col("_share") * d + F.lit(0.5)).cast("long"), F.col("_most"))
    # the sum is at most share sum * d + half a seat a row; from (2 most + 1) / share on all have what they may
    sure = F.when(F.sum("_share").over(group) > 0, (F.col("_seats") - F.count(F.lit(1)).over(group) / 2) / F.sum("_share").over(group))
    full = F.max(F.when(F.col("_share") > 0, (2 * F.col("_most") + 1) / F.col("_share"))).over(group)
    rows = rows.withColumns({"_low": F.greatest(F.coalesce(sure, F.lit(0.0)), F.lit(0.0)), "_high": F.coalesce(full, F.lit(0.0))})
    rows = rows.withColumn("_high", F.greatest("_low", "_high"))
    for step in range(STEPS):
        at = (F.col("_low") + F.col("_high")) / 2
        fits = F.sum(won_at(at)).over(group) <= F.col("_seats")
        rows = rows.withColumn("_fits", fits).withColumns({"_low": F.when(F.col("_fits"), at).otherwise(F.col("_low")), "_high": F.when(F.col("_fits"), F.col("_high")).otherwise(at)})
        if step % 8 == 7:  # plans stay short
            rows = materialize(rows, "divisor")
            if rows.where(F.col("_share") * (F.col("_high") - F.col("_low")) > 0.5).isEmpty():
                break
    # one less than the cut gives, so that rounding near it is decided by rank
    rows = rows.withColumn("_sure", F.greatest(won_at(F.col("_low")) - 1, F.lit(0)).cast("long"))
    rows = rows.withColumn("_left", F.col("_seats") - F.sum("_sure").over(group))
    near = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<long>")))
    near = near.withColumn("_quotient", F.when(F.col("_sure") + F.col("_k") < F.col("_most"), F.col("_share") / (2 * (F.col("_sure") + F.col("_k")) + 1)))
    order = group.orderBy(F.col("_quotient").desc_nulls_last(), *ties, "_k")
    won = near.withColumn("_won", (F.col("_quotient") > 0) & (F.row_number().over(order) <= F.col("_left")))
    return won.groupBy(*keep, "_sure").agg(F.sum(F.col("_won").cast("long")).alias("_more")).select(*keep, (F.col("_sure") + F.coalesce("_more", F.lit(0))).alias("quota"))


def quotas(cells: DataFrame, weights: Sequence[float], share: float, repeats: float, block: int, seed: int) -> DataFrame:
    """source, shard, source_size, target, blocks, passes, more, start: the blocks of each shard that the mix takes.

    Every block is taken ``passes`` times, and the ``more`` from ``start`` on (round the end) once again.
    """
    targets = source_targets(cells, weights, share, repeats)
    all_blocks = F.floor(F.sum("target").over(Window.partitionBy(F.lit(1))) / block + 0.5)
    dealt = sainte_lague(targets, all_blocks, F.col("target"), F.floor(F.col("target") / block + 1), [], [F.col("source").asc_nulls_last()])
    here = cells.where("size > 0").join(dealt.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    here = here.withColumn("blocks", F.ceil(F.col("size") / block)).withColumnRenamed("quota", "source_quota")
    here = sainte_lague(here, F.col("source_quota"), F.col("size"), F.col("blocks") * int(repeats), ["source"], [F.col("shard")])
    return here.select(
        "source", "shard", "source_size", "target", "blocks", F.expr("quota div blocks").alias("passes"), F.expr("quota % blocks").alias("more"),
        F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.col("blocks")).alias("start"),
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int = BLOCK, docs_per_shard: int = DOCS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """What the mix takes of every row of ``docs``.

    Returns doc_id, size, source_size, target, taken, passes (whole times), spans (word ranges [from, to) taken once more) and text_key (a hash of the text).
    A null or empty text has size 0 and is not taken. Rows that repeat are taken each on its own. An empty table gives no
    rows. Other columns, whatever their names, are ignored.
    """
    rows = materialize(sized(docs, docs_per_shard, seed), "sized")
    cells = rows.groupBy("source", "shard").agg(F.sum("size").alias("size"))
    plan = materialize(quotas(cells, weights, share, repeats, block, seed), "quotas")
    of_source = plan.select("source", "source_size", "target").distinct()
    line = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("through", F.sum("size").over(line))
    p = plan.select(*[F.col(c).alias(f"p_{c}") for c in plan.columns])
    rows = rows.join(p, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("shard") == F.col("p_shard")), "left")
    # the run of blocks, in words, as one range or (round the end) two
    first = lambda a, b: F.greatest(a * block, F.col("through") - F.col("size")) - (F.col("through") - F.col("size"))
    last = lambda a, b: F.least(b * block, F.col("through")) - (F.col("through") - F.col("size"))
    runs = [
        (F.col("p_start"), F.least(F.col("p_start") + F.col("p_more"), F.col("p_blocks"))),
        (F.lit(0), F.greatest(F.col("p_start") + F.col("p_more") - F.col("p_blocks"), F.lit(0))),
    ]
    spans = F.filter(F.array(*[F.struct(first(a, b).cast("long").alias("from"), last(a, b).cast("long").alias("to")) for a, b in reversed(runs)]), lambda s: s["from"] < s["to"])
    rows = rows.withColumn("spans", F.when(F.col("p_blocks").isNotNull(), spans).otherwise(F.array().cast("array<struct<from:bigint,to:bigint>>")))
    rows = rows.withColumn("passes", F.coalesce("p_passes", F.lit(0)))
    s = of_source.select(F.col("source").alias("s_source"), F.col("source_size").alias("s_size"), F.col("target").alias("s_target"))
    # a source without a word has no shard in the plan
    known = rows.where("p_blocks is not null").select("doc_id", "size", "text_key", "passes", "spans", F.col("p_source_size").alias("source_size"), F.col("p_target").alias("target"))
    rest = rows.where("p_blocks is null").join(s, F.col("source").eqNullSafe(F.col("s_source")), "left").select("doc_id", "size", "text_key", "passes", "spans", F.coalesce("s_size", F.lit(0)).alias("source_size"), F.coalesce("s_target", F.lit(0.0)).alias("target"))
    taken = F.col("passes") * F.col("size") + F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])
    return known.unionByName(rest).withColumn("taken", taken).select("doc_id", "size", "source_size", "target", "taken", "passes", "spans", "text_key")


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time that a document, or words of it, is taken.

    Words taken once more keep the white space after them. A row that repeats an earlier one in id and text gets that row's share; different texts
    of one id have their own. ``n_chars``, if there, is set to the new length of a cut text. Columns may have any names.
    """
    plan = mix(docs, **how).where("taken > 0").groupBy("doc_id", "size", "text_key").agg(F.min(F.struct("taken", "passes", "spans")).alias("m"))
    plan = plan.select(F.col("doc_id").alias("id"), F.col("size").alias("n"), F.col("text_key").alias("key"), "m.passes", "m.spans")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    # each word with what follows it; white space before the first word stays with that word
    text = F.col("row").getField("text").cast("string")
    words = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    first, last = F.col("span")["from"], F.col("span")["to"]
    cut = F.when((first == 0) & (last == F.col("n")), text).otherwise(F.array_join(F.slice(words, (first + 1 + lead).cast("int"), (last - first).cast("int")), ""))
    whole = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("passes"), F.lit(1).cast("long"))), lambda k: F.struct(F.lit(0).cast("long").alias("from"), F.col("n").alias("to")))
    takes = F.concat(F.when(F.col("passes") > 0, whole).otherwise(F.array().cast("array<struct<from:bigint,to:bigint>>")), "spans")
    rows = keyed.join(plan, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))).withColumn("span", F.explode(takes)).withColumn("cut", cut)
    new = {"text": F.col("cut"), "n_chars": F.length("cut").cast(docs.schema["n_chars"].dataType if "n_chars" in docs.columns else "long")}
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
