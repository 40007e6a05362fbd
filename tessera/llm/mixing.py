"""Mixing sources to target weights along a low-discrepancy schedule. DataFrame functions only.

Slot i of the schedule takes the i-th golden-ratio point through the cumulative target shares and so
picks a source; slots are ranked within their source, and the slot of rank r gets block r of the
source's own stream: its documents, shuffled by a hash of id and text, cut into blocks of equal token
counts. Past its last block a stream starts again. A source is served until its target is met
exactly; where discrepancy leaves it a few slots short, they follow behind the last slot.

Edge cases: a null text has size 0 and takes nothing; a null source is a source of its own, last in
order; rows that repeat id and text stand next to each other in the stream and both count; a text longer than a block
spans several; an empty table gives no rows. Of a document only id, text and source are read; other
columns, whatever their names, come back with the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_name, row_key, save

#: Tokens in a block of the mix.
BLOCK = 512
#: Hash ranges that deal a source's stream to tasks; 16 ** 3.
HEX_DIGITS = 3
CHUNK = 1 << 14
#: The golden ratio times 2 ** 64: point i is i * GOLDEN modulo 2 ** 64, exact for any number of slots.
GOLDEN = 11400714819323198485
#: Equal bins of the line of shares; a share lies in one or more.
BINS = 4096


def source_targets(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source of docs(source, size): rank in code point order (null last), source_size, weight, target.

    Targets fill up by weight like water: sources in the order of cap by weight close first.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    s = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("place", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(most))
    closing = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    whole = Window.partitionBy(F.lit(0))
    s = s.withColumn("closed", F.coalesce(F.sum("cap").over(closing.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open_weight", F.sum("weight").over(closing.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - F.col("closed")) / F.col("open_weight"))
    s = s.withColumn("turn", F.row_number().over(closing))  # the first source, in closing order, that stays open
    s = s.withColumn("water", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("turn", "level"))).over(whole)["level"])
    target = F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", "place", "weight", target.alias("target"))


def source_streams(docs: DataFrame) -> DataFrame:
    """Adds to docs(source, size, key, row) `start`: where a document's tokens begin in its source's shuffled stream."""
    keyed = docs.withColumn("order_key", F.md5("key"))
    keyed = keyed.withColumn("range", F.substring("order_key", 1, HEX_DIGITS))
    ranges = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("r_source"), F.col("range").alias("r_range"), F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("source", "range").orderBy("order_key", "key", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    joined = keyed.join(ranges, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
    return joined.withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(own), F.lit(0))).drop("base", "range", "order_key", "r_source", "r_range")


def slot_schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, place (of the source), rank, block, epoch, take: the tokens that the slot takes of its block."""
    spark = targets.sparkSession
    need = targets.where("source_size > 0 and target >= 1").select(
        "place", "source_size", F.floor("target").cast("long").alias("want"),
        F.ceil(F.col("source_size") / block).cast("long").alias("blocks"),
    )
    # slots of the whole epochs and of what is left of the target
    need = need.withColumn("slots", (F.floor(F.col("want") / F.col("source_size")) * F.col("blocks") + F.ceil((F.col("want") % F.col("source_size")) / block)).cast("long"))
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    need = need.withColumn("high", F.sum("slots").over(upto)).withColumn("all_slots", F.sum("slots").over(Window.partitionBy(F.lit(0))))
    need = need.withColumn("low", F.col("high") - F.col("slots"))
    total = need.agg(F.max("all_slots")).first()[0] or 0
    shares = need.select("place", "low", "high", "all_slots")  # one row per source
    fraction = f"pmod(cast(id + 1 as decimal(14, 0)) * {GOLDEN}BD, {1 << 64}BD)"
    points = spark.range(total).select(F.col("id").alias("slot"), F.expr(f"{fraction} * cast({total} as decimal(14, 0)) div {1 << 64}BD").alias("point"))
    # shares and points meet by equal bins of the line, so that this is a join on a key
    width = max(1, -(-total // BINS))
    lines = shares.where("high > low").withColumn("bin", F.explode(F.expr(f"sequence(low div {width}, (high - 1) div {width})")))
    drawn = points.withColumn("bin", F.expr(f"point div {width}")).join(lines, "bin").where("point >= low and point < high")
    drawn = drawn.select("slot", "place", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    tally = drawn.groupBy("place", "chunk").agg(F.count("*").alias("n"))
    tally = tally.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = drawn.join(tally, ["place", "chunk"]).withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("place", "chunk").orderBy("slot")) - 1)
    got = tally.groupBy("place").agg(F.sum("n").alias("got"))
    short = need.join(got, "place", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
    late = short.select((F.lit(total) + F.col("low")).alias("from"), "place", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("rank"))
    late = late.select((F.col("from") + F.col("rank")).alias("slot"), "place", "rank")
    slots = ranked.select("slot", "place", "rank").union(late)
    slots = slots.join(need.select("place", "source_size", "want", "blocks", "slots"), "place").where("rank < slots")
    slots = slots.withColumn("epoch", F.floor(F.col("rank") / F.col("blocks"))).withColumn("block", F.col("rank") % F.col("blocks"))
    done = F.col("epoch") * F.col("source_size") + F.col("block") * block
    take = F.least(F.lit(block), F.col("source_size") - F.col("block") * block, F.col("want") - done)
    return slots.select("slot", "place", "rank", "epoch", "block", take.cast("long").alias("take")).where("take > 0")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(sized, pieces). sized: a row per document with size, source_size, target, place and start.
    pieces: what each slot takes of which document: slot, epoch, row, place, start, length."""
    words = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size"), row_key(id_col, text_col).alias("key")).withColumn("row", F.monotonically_increasing_id())
    sized = save(sized, "sized")
    targets = save(source_targets(sized, weights, share, most), "targets")
    named = targets.select(F.col("source").alias("t_source"), "source_size", "place", "target")
    placed = save(source_streams(sized).join(named, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source"), "streams")
    cut = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    cut = cut.select("row", "place", "block", (low - F.col("block") * block).alias("from"), (high - F.col("block") * block).alias("to"), (low - F.col("start")).alias("doc_from"))
    pieces = cut.join(slot_schedule(targets, block), ["place", "block"]).where(F.col("from") < F.col("take"))
    pieces = pieces.select("slot", "epoch", "row", "place", F.col("doc_from").alias("start"), (F.least("to", "take") - F.col("from")).alias("length"))
    return placed, pieces


def mix_totals(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    placed, pieces = mix(docs, **options)
    taken = pieces.groupBy("row").agg(F.sum("length").alias("taken"))
    return placed.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix draws its first word: 0 to 2 times. A text without words never comes.

    Rows that repeat doc_id and text share the decision: the larger number of draws.
    """
    placed, pieces = mix(docs, id_col=id_col, text_col=text_col, **options)
    name, own, times, turn = (free_name(docs, x) for x in ("mix_key", "row_key", "mix_times", "mix_turn"))
    drawn = pieces.where("start = 0").groupBy("row").agg(F.count("*").cast("int").alias(times))
    drawn = placed.join(drawn, "row").groupBy(F.col("key").alias(name)).agg(F.max(times).alias(times))
    keyed = docs.withColumn(own, row_key(id_col, text_col))
    repeated = keyed.join(drawn, keyed[own] == drawn[name]).withColumn(turn, F.explode(F.sequence(F.lit(1), times)))
    return repeated.drop(name, own, times, turn)
