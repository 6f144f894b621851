"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 11).

The words of each source form a tape: its documents in a seeded order, end to end, repeated as often
as needed. Tapes are cut into blocks of equally many words. The blocks of the mix are seats: the next
seat always goes to the source with the highest quotient ``target / (2 * seats it has + 1)``, and each
shard is a run of seats, so that every shard has a whole number of blocks of each source and the
shards up to any one are an apportionment too. Each shard then takes its blocks from the tapes.

Seats are never listed. For each shard's last seat the number of seats of a source is known from its
share up to a few, and only those few quotients are ranked. Everything is DataFrame expressions; what
reaches the driver are sums over all sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartoload.llm.common import truncate_lineage
from cartoload.operators.ordinal import row_numbers

WEIGHTS = (3, 1, 2)  # of the sources in order, repeated
SHARE = 1.5  # words of the mix for each word of the table
MOST = 2  # a source's target stops at so many times its words
BLOCK = 16  # words
SHARD_BLOCKS = 1 << 18
SEED = "mix"
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; none in a null."""
    inner = F.trim(text, F.lit(" \t\n\v\f\r"))
    return F.when(F.length(inner) > 0, F.size(F.split(inner, SPACE))).otherwise(0).cast("bigint")


def tape(spark: SparkSession, docs: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """Documents in the seeded order of their sources, in ranges, and the words of each range.

    The documents are ``(doc_id, source, size, at, range)``: a range is a sorted run of bounded size,
    which cuts large sources and repeated ids alike. Texts aren't shuffled.
    """
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keys = ["source", "drawn", "doc_id", "size", "row"]
    placed = sized.withColumns({"drawn": drawn, "row": F.monotonically_increasing_id()}).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = truncate_lineage(spark, placed.select("doc_id", "source", "size", F.monotonically_increasing_id().alias("at")), "tape").withColumn("range", F.shiftright("at", 33))
    ranges = truncate_lineage(spark, rows.groupBy("source", "range").agg(F.sum("size").alias("words")), "ranges")
    return rows, ranges


def targets(spark: SparkSession, sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, size, place, weight, target)`` of the sources ``(source, size)``.

    Sources in the order of their code points, null last, take the weights in turn. Targets are
    proportional to the weights and come to ``share`` times all sizes, but stop at ``most`` times the
    source's own; what is over goes to the others by weight, until none is above.
    """
    if not 0 <= share <= most:
        raise ValueError("share must lie between 0 and most")
    ordered = row_numbers(spark, sizes.select("source", "size", F.col("source").isNull().alias("last")), [], ["last", "source"], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    weighed = truncate_lineage(spark, ordered.select("source", "size", "place", weight.alias("weight")), "weights")
    level, before = 0.0, -1
    while True:
        limit = F.col("size") * F.lit(float(most))
        full = limit <= F.col("weight") * F.lit(level)
        row = weighed.agg(F.sum("size").alias("size"), F.sum(F.when(full, limit)).alias("limits"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.sum(full.cast("int")).alias("full")).first()
        if not row.open or row.full == before:
            break
        level, before = (share * row.size - (row.limits or 0.0)) / row.open, row.full
    return weighed.withColumn("target", F.least(F.col("size") * F.lit(float(most)), F.col("weight") * F.lit(level)))


def quotas(spark: SparkSession, wanted: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """``(shard, source, first, blocks)``: the blocks that each shard takes of each source.

    ``wanted`` holds ``source place target``. ``first`` is the source's number of blocks in earlier shards.
    One shard's rows are a few per source.
    """
    live = wanted.where("target > 0")
    n_sources, total = live.agg(F.count("*"), F.sum("target")).first()
    seats = int((total or 0.0) / block + 0.5)
    if not seats:
        return wanted.selectExpr("1L as shard", "source", "0L as first", "0L as blocks").where("false")
    shards = -(-seats // shard_blocks)
    upto = F.least(F.col("shard") * shard_blocks, F.lit(seats))
    share = F.col("target") / F.lit(total)
    # Rounded shares add up to the seats within half the sources; handing these out moves no source further than this.
    reach = F.ceil(share * n_sources) + 1
    lists = live.select("source", "place", "target", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(shards).cast("bigint"))).alias("shard"))
    sure = lists.withColumn("reach", reach).withColumn("sure", F.greatest(F.lit(0).cast("bigint"), F.floor(share * upto + 0.5) - F.col("reach")))
    shard = Window.partitionBy("shard")
    open_seats = sure.withColumn("left", upto - F.sum("sure").over(shard)).withColumn("k", F.explode(F.expr("sequence(sure, sure + 2 * reach + 1)")))
    ranked = open_seats.withColumn("turn", F.row_number().over(shard.orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), "place")))
    held = ranked.groupBy("shard", "source").agg((F.first("sure") + F.sum((F.col("turn") <= F.col("left")).cast("bigint"))).alias("upto"))
    before = F.coalesce(F.lag("upto").over(Window.partitionBy("source").orderBy("shard")), F.lit(0))
    return held.select("shard", "source", before.alias("first"), (F.col("upto") - before).alias("blocks"))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST,
        block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs`` (``doc_id source text``): its documents and its shards' quotas.

    Documents: ``(doc_id, source, size, source_size, target, taken, start)``, one for each row of ``docs``:
    words, words of its source, the source's target, the words that the mix takes of it (repeats counted,
    at most ``most`` times its words) and where it starts on its source's tape. Quotas: as ``quotas``.
    Taken words of a source are its blocks, but no more than ``most`` times its words.

    A null or empty text has no words; a null source is a source of its own, the last in order; null
    and repeated ids are documents of their own; rows equal in id, source and size may swap places.
    An empty table, or one without words, takes nothing; other columns are ignored.
    """
    rows, ranges = tape(spark, docs, seed)
    wanted = truncate_lineage(spark, targets(spark, ranges.groupBy("source").agg(F.sum("words").alias("size")), weights, share, most), "targets")
    shards = truncate_lineage(spark, quotas(spark, wanted, block, shard_blocks), "quotas")
    given = shards.groupBy("source").agg((F.sum("blocks") * block).alias("given"))
    sources = wanted.join(given, wanted["source"].eqNullSafe(given["source"]), "left").select(
        wanted["source"], F.col("size").alias("source_size"), "target", F.least(F.coalesce("given", F.lit(0)), F.col("size") * most).alias("given"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("source", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    of_range = offsets.join(sources, offsets["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    inside = Window.partitionBy("source", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    met = local.join(of_range, local["source"].eqNullSafe(of_range["source"]) & (local["range"] == of_range["range"]))
    start = F.col("before") + F.col("inside")
    rest = F.expr("given % source_size")
    taken = F.when(F.col("source_size") > 0, F.expr("given div source_size") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))).otherwise(0)
    return met.select("doc_id", local["source"], "size", "source_size", "target", taken.cast("bigint").alias("taken"), start.alias("start")), shards


def pieces(mixed: DataFrame, shards: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """``(shard, source, doc_id, start, length, at)``: the runs of words that each shard takes, ``at`` on the source's tape.

    A source's shards have nearly equal quotas; cells of that width bring documents and shards
    together by equality, a few of each to a cell.
    """
    ends = shards.groupBy("source").agg(F.max(F.col("first") + F.col("blocks")).alias("seats"), F.count("*").alias("runs"))
    wide = ends.select(F.col("source").alias("tape"), F.greatest(F.lit(block), F.ceil(F.col("seats") * block / F.col("runs"))).alias("wide"), (F.col("seats") * block).alias("given"))

    def celled(rows: DataFrame, first: Column, last: Column) -> DataFrame:
        sized = rows.join(wide, F.col("source").eqNullSafe(F.col("tape"))).withColumns({"from": first, "to": last}).where(F.col("to") > F.col("from"))
        return sized.withColumn("cell", F.explode(F.expr("sequence(from div wide, (to - 1) div wide)")))

    rounds = mixed.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    begin = F.col("pass") * F.col("source_size") + F.col("start")
    left = celled(rounds, begin, F.least(begin + F.col("size"), F.col("given"))).select("source", "doc_id", "from", "to", "cell")
    right = celled(shards, F.col("first") * block, (F.col("first") + F.col("blocks")) * block).select(F.col("source").alias("of"), "shard", F.col("from").alias("open"), F.col("to").alias("close"), F.col("cell").alias("there"))
    met = left.join(right, F.col("source").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("there")) & (F.col("from") < F.col("close")) & (F.col("open") < F.col("to")))
    at = F.greatest("from", "open")
    # A pair that shares several cells counts in the first of them only.
    return met.withColumn("wide_at", at).dropDuplicates(["shard", "source", "doc_id", "from", "wide_at"]).select(
        "shard", "source", "doc_id", (at - F.col("from")).alias("start"), (F.least("to", "close") - at).alias("length"), at.alias("at"))
