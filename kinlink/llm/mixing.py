"""Mixing sources to target weights by weighted fair queueing."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.llm.tables import store

# Documents that one task puts in order, on average.
RUN_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A text that orders sources by code point with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def document_mark(seed: int, id_column: str, text_column: str) -> Column:
    """The hash by which documents are shuffled."""
    return F.xxhash64(F.lit(seed), F.col(id_column), F.col(text_column))


def source_targets(sizes: DataFrame, cycle: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(key, source_size, docs, target) from (key, source_size, docs), one row for each source.

    Sources in the order of ``key`` take the weights in ``cycle`` in turn. A target is capped
    at ``most`` times the size and the excess goes to the others by weight. Capped sources
    are the first ones in the order of size by weight, so the level of the rest follows from
    running sums over the sources; these windows see one row for each source.
    """
    place = (F.row_number().over(Window.orderBy("key")) - 1) % len(cycle) + 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), place)
    rows = sizes.withColumn("weight", weight)
    ratio = F.col("source_size") / F.col("weight")
    before = Window.orderBy(ratio, "key").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(every) * share
    left = budget - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / rest).withColumn("cap", F.col("source_size") * most)
    # Uncapped sources are those from the first one on whose share is within its cap.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(ratio.alias("r"), "key", "level"))
    rows = rows.withColumn("first", F.min(fits).over(every))
    capped = F.col("first").isNull() | (F.struct(ratio.alias("r"), "key") < F.struct("first.r", "first.key"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("first.level") * F.col("weight"))
    return rows.select("key", "source_size", "docs", target.alias("target"))


def fair_queue(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    cycle: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.0,
    most: int = 3,
    seed: int = 7,
) -> DataFrame:
    """How often each document enters a mix of ``share`` times all words.

    Documents of a source are shuffled by a hash and stand in line up to ``most`` times, one
    round after the other. A copy's virtual finish time is the source's words up to its end
    divided by the source's target. All copies are ordered by that time, and the mix is the
    longest beginning of this order within the budget, so each source's part is within one
    document of its target.

    Null texts count 0 words. A null source is a source of its own, after the others. Rows
    that repeat stand in line each. Other columns are not read; an empty table gives no rows.

    Returns (id, size, source_size, target, copies, taken, key, mark, number) with the id under
    ``id_column``; ``key`` (of the source), ``mark`` and ``number`` identify the row (a hash of
    id and text, and the number among equal rows).
    """
    key = source_key(F.col(source_column))
    mark = document_mark(seed, id_column, text_column)
    sized = docs.select(
        F.col(id_column).alias("id"), key.alias("key"), word_count(F.col(text_column)).alias("size"), mark.alias("mark")
    )
    sized = store(sized, "sized")
    sizes = sized.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    targets = store(source_targets(sizes, cycle, share, most), "targets")
    total, rows = targets.agg(F.sum("source_size"), F.sum("docs")).first()
    budget = int((total or 0) * share)

    # Words before each document in its source: runs of the hash order, then inside a run.
    place = F.shiftrightunsigned("mark", 1)
    runs = F.ceil(F.col("docs") / RUN_ROWS)
    run = F.least(F.floor(place / F.lit(2.0**63) * runs), runs - 1)
    placed = sized.join(targets, "key").withColumn("run", run)
    sums = placed.groupBy("key", "run").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "run", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("key", "run").orderBy(place, "mark", "id").rowsBetween(Window.unboundedPreceding, 0)
    line = placed.join(sums, ["key", "run"]).withColumn("words", F.col("ahead") + F.sum("size").over(inside))
    same = Window.partitionBy("key", "run", place, "mark", "id").orderBy("words")
    line = line.withColumn("number", F.row_number().over(same))
    line = store(line.select("id", "key", "size", "mark", "source_size", "target", "words", "number"), "line")

    def finish(turn):
        return (turn * F.col("source_size") + F.col("words")) / F.col("target")

    copies = line.where("target > 0").select(
        "key", "size", "words", "mark", "number", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("turn"),
        "source_size", "target",
    )
    order = F.struct(finish(F.col("turn")).alias("finish"), "key", "turn", "words", "number", "mark")
    copies = copies.select("size", order.alias("at"))
    # The slice of virtual time in which the budget ends, then the last copy within it.
    slices = max(64, (rows or 0) // RUN_ROWS)
    part = F.least(F.floor(F.col("at.finish") * slices), F.lit(4 * slices)).cast("long")
    by_slice = copies.groupBy(part.alias("part")).agg(F.sum("size").alias("words"))
    running = by_slice.select("part", F.sum("words").over(Window.orderBy("part")).alias("upto"), "words")
    over = running.where(F.col("upto") > budget).orderBy("part").select("part", F.col("upto") - F.col("words")).first()
    last = None
    if over:
        ending = copies.where(part == over[0]).withColumn("upto", F.sum("size").over(Window.orderBy("at")) + over[1])
        last = ending.where(F.col("upto") > budget).agg(F.min("at")).first()[0]

    def taken(turn):
        if last is None:
            return F.lit(1)
        end = F.struct(*[F.lit(last[name]).alias(name) for name in last.__fields__])
        here = F.struct(finish(F.lit(turn)).alias("finish"), "key", F.lit(turn).alias("turn"), "words", "number", "mark")
        return (here < end).cast("int")

    times = F.when(F.col("target") > 0, sum(taken(turn) for turn in range(most))).otherwise(F.lit(0))
    return line.withColumn("copies", times).select(
        F.col("id").alias(id_column),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
        "key",
        "mark",
        "number",
    )


def mixed_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    seed: int = 7,
    **options,
) -> DataFrame:
    """The mix itself: each document as often as ``fair_queue`` takes it, with all its columns.

    Of rows with equal id, text and source, those first in line are taken most often, so the
    numbers of rows taken at least once, twice and so on say how often each one is. Texts are
    shuffled once, by the key of the join, which also numbers the rows.
    """
    most = options.get("most", 3)
    queue = fair_queue(docs, id_column, text_column, source_column, seed=seed, **options)
    depth = F.array(*[F.count_if(F.col("copies") >= turn) for turn in range(1, most + 1)])
    queue = queue.where("copies > 0").groupBy("key", "mark").agg(depth.alias("depth"))
    # Columns of docs stay in a struct, so no name of theirs meets one of these.
    rows = docs.select(
        source_key(F.col(source_column)).alias("key"),
        document_mark(seed, id_column, text_column).alias("mark"),
        F.struct(*[F.col(c) for c in docs.columns]).alias("doc"),
    )
    met = rows.join(queue, ["key", "mark"])
    equal = Window.partitionBy("key", "mark").orderBy(F.col("doc")[id_column], F.col("doc")[text_column])
    met = met.withColumn("number", F.row_number().over(equal))
    copies = F.size(F.filter("depth", lambda rows_deep: rows_deep >= F.col("number")))
    met = met.withColumn("copies", copies).where("copies > 0")
    return met.withColumn("turn", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")
