"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix has ``share`` of all words. Sources share it by weight; a target stops at
``limit`` times its source's size and what is over is shared by weight again. A
source gives whole passes first (as many as its target holds); the words beyond
them are equal-token blocks, apportioned to sources and then to the hashed shards
of each source by highest quotients votes / (2 seats + 1). A shard's documents lie in
seeded order, and its quota takes the first blocks of them: whole documents, and the
beginning of the one at which it ends.

Only one row per source and one per shard are ordered together, and within a shard
its keys, never texts. The same rows give the same mix however they are partitioned.

Edge cases: NULL and empty texts have size 0 and give nothing. A null source is a
source of its own, the last. Repeated rows are documents of their own; where a quota
ends among rows equal in id, source and text, each gives the same share of its words,
rounded down. Empty tables give empty results. Columns named like results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintmill.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
BLOCK = 8        # words
SHARD = 4096     # documents, more where there would be more than SHARDS
SHARDS = 1 << 16
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"
GAP_AND_WORD = r"[\x20\x09-\x0D]*" + WORD
RESULTS = ("size", "source_size", "target", "taken")


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, docs, source_size) with weight and target; one row per source.

    With the sources in order of limit * size / weight those stopped come first:
    the level is the first quotient of what is left by the weight left that the
    next source can still take.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    held = sizes.withColumn("weight", weight).withColumn("cap", limit * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    everything = Window.partitionBy()
    steps = held.select(
        "cap", "weight", F.row_number().over(order).alias("n"),
        ((share * F.sum("source_size").over(everything) - before("cap"))
         / (F.sum("weight").over(everything) - before("weight"))).alias("level"),
    )
    level = steps.filter("level * weight <= cap").agg(F.min_by("level", "n").alias("level"))
    return held.crossJoin(F.broadcast(level)).select(  # one row
        "source", "docs", "source_size", "weight",
        F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def apportion(votes: DataFrame, vote: str, total: Column | str, group: list[str], seats: str) -> DataFrame:
    """Sainte-Lague: seats by highest quotients vote / (2 k + 1), within each group.

    ``total`` is the number of seats of the group. Seats below a first estimate are
    certain; only a few quotients around each party's share compete for the rest,
    about three per party, since rounding all shares is off by half a seat each.
    """
    whole = Window.partitionBy(*group)
    share = F.try_divide(F.col(vote), F.sum(vote).over(whole))
    parties = F.count(F.lit(1)).over(whole)
    party = F.struct(*[c for c in votes.columns])
    fair = votes.withColumn("all_seats", total if isinstance(total, Column) else F.col(total)).withColumns({
        "quota": F.coalesce(share * F.col("all_seats"), F.lit(0.0)),
        "slack": (F.ceil(F.coalesce(share, F.lit(0.0)) * parties / 2) + 1).cast("long"),
    }).select(*group, party.alias("party"), "all_seats", "quota", "slack", F.col(vote).alias("vote"))
    sure = F.greatest(F.floor(F.col("quota")) - F.col("slack"), F.lit(0).cast("long"))
    held = fair.withColumn("sure", sure).withColumn(
        "seat", F.explode(F.sequence(F.col("sure"), F.col("sure") + 2 * F.col("slack") + 1))
    )
    first = F.col("seat") == F.col("sure")
    place = F.row_number().over(
        Window.partitionBy(*group).orderBy(F.desc(F.col("vote") / (2 * F.col("seat") + 1)), F.col("party"))
    )
    left = F.col("all_seats") - F.sum(F.when(first, F.col("sure"))).over(whole)
    won = held.withColumn("place", place).withColumn("left", left)
    return won.groupBy(*group, "party").agg(
        (F.first("sure") + F.sum(((F.col("place") <= F.col("left")) & (F.col("vote") > 0)).cast("long"))).alias(seats)
    ).select("party.*", seats)


def mix_sources(
    docs: DataFrame, size: Column, text_key: Column, id_column: str = "doc_id", source: str = "source",
    weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, block: int = BLOCK, seed: int = SEED, shards: int = SHARDS,
) -> DataFrame:
    """What the mix takes of every document.

    ``size`` gives a document's words, ``text_key`` tells texts apart. Adds size,
    source_size, target and taken (words, repeats counted). Only sizes and keys are
    written and shuffled; the documents meet one row per shard, which says where its
    quota ends, and stay where they are.
    """
    names = [c for c in docs.columns if c not in RESULTS]
    key = F.xxhash64(F.col(f"`{id_column}`").cast("string"), text_key, F.lit(seed))
    of = F.col(f"`{source}`").cast("string")
    held = materialize(docs.select(of.alias("source"), size.alias("size"), key.alias("key")), "sizes")
    sources = targets(
        held.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size")), weights, share, limit
    )
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    beyond = sources.withColumn("passes", passes).withColumn(
        "extra", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
    everything = Window.partitionBy()
    beyond = beyond.withColumns({
        "seats_all": F.round(F.sum("extra").over(everything) / block).cast("long"),
        "shards": F.greatest(F.least(F.ceil(F.col("docs") / SHARD), F.ceil(shards * F.col("docs") / F.sum("docs").over(everything))), F.lit(1)),
    })
    sources = materialize(apportion(beyond, "extra", "seats_all", [], "seats").drop("seats_all"), "sources")

    # Rows with equal keys are one row here: copies of a document share what they give.
    groups = held.groupBy("source", "key").agg(F.sum("size").alias("size")).join(
        sources.select(F.col("source").alias("of"), "shards", "seats"), F.col("source").eqNullSafe(F.col("of"))
    ).drop("of").withColumn("shard", F.pmod("key", F.col("shards")))
    votes = groups.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("seats").alias("seats"))
    quotas = apportion(votes, "shard_size", "seats", ["source"], "quota").select(
        F.col("source").alias("of"), F.col("shard").alias("at"),
        F.least(F.col("quota") * block, F.col("shard_size")).alias("quota"))
    placed = groups.join(quotas, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("at")))
    shard = Window.partitionBy("source", "shard").orderBy("key")
    high = F.sum("size").over(shard.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first_left_out = placed.withColumn("high", high).filter("high > quota").groupBy("source", "shard").agg(
        F.min(F.struct("key", "size", (F.col("quota") - F.col("high") + F.col("size")).alias("some"))).alias("cut"))
    cuts = votes.select("source", "shard").join(
        first_left_out.select(F.col("source").alias("s"), F.col("shard").alias("n"), "cut"),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("n")), "left",
    ).select("source", "shard", "cut").join(
        sources.select(F.col("source").alias("s"), "shards", "source_size", "target", "passes"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    cuts = materialize(cuts, "cuts")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), size.alias("size"), key.alias("key"), of.alias("of"))
    # A row per source is at most a row per document; beyond the bound Spark decides how to join.
    few = cuts.select("source", "shards").distinct().count() <= shards and cuts.count() <= 3 * shards
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    known = rows.join(small(cuts.select("source", "shards").distinct().withColumnRenamed("shards", "of_shards")),
                      F.col("of").eqNullSafe(F.col("source")), "left").drop("source")
    known = known.withColumn("at", F.pmod("key", F.col("of_shards")))
    joined = known.join(small(cuts), F.col("of").eqNullSafe(F.col("source")) & (F.col("at") == F.col("shard")), "left")
    extra = F.when(F.col("cut").isNull() | (F.col("key") < F.col("cut.key")), F.col("size")).when(
        F.col("key") == F.col("cut.key"), F.floor(F.col("size") * F.col("cut.some") / F.col("cut.size"))).otherwise(F.lit(0))
    return joined.select("row.*", "size", "source_size", "target", (F.col("passes") * F.col("size") + extra).cast("long").alias("taken"))


def mixed_texts(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: a row per whole copy, and one for what else is taken of a document.

    That is its beginning, white space kept; only the document at which a shard's quota
    ends gives such a piece.
    """
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    rest = (F.col("taken") - whole * F.col("size")).cast("int")
    takes = F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    words = F.regexp_extract_all(F.col(text), F.lit(GAP_AND_WORD), F.lit(0))
    some = F.array_join(F.slice(words, 1, F.greatest(F.col("_take"), F.lit(0))), "")
    return mixed.withColumn("_take", F.explode(takes)).withColumn(
        text, F.when(F.col("_take") < 0, F.col(text)).otherwise(some)).drop("_take")
