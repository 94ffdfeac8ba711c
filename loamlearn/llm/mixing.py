"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame operations only).

Sources get target words by weight, at most ``max_repeats`` times their size, the excess going to
the others by weight. Each source's documents are shuffled by a keyed digest into one stream, which
repeats as often as the target asks and is cut into blocks of ``block_words`` words, the last one
shorter. The mix has a slot a block. Slot i has the golden-ratio point frac(i * 0.618...); the points
are mapped through the sources' cumulative numbers of blocks, as shares of all slots: of the points
in their order, the first source owns as many as it has blocks, then the second, and so on. So every
source gets exactly its slots, spread evenly over the mix. A source's slots are ranked by number, and
the one of rank r takes its block r. A document's ``taken`` is what all slots hold of it; ``first_slot``
and ``n_slots`` say where in the mix it stands.

Defined cases: null text has size 0; a null source is a source of its own and the last; null ids and
repeated rows are rows like any other; a document of which nothing is taken has no slot (null, 0); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Workspace, free_name

#: round(2**31 / golden ratio), odd: i * GOLDEN mod 2**31 visits every point of a period once.
GOLDEN, BITS = 1327217885, 31
#: Words of a block; slots that one task sorts.
BLOCK_WORDS, CELL_SLOTS = 1024, 1 << 16


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(rows: DataFrame, weights: tuple = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """source, src (1, 2, ... by code point, null last), n_rows, source_size, target: one row a source.

    Filling up by weight under caps: sorted by cap / weight, the level is the largest of
    (total - caps before) / (weights from here on).
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    every = Window.orderBy(F.col("source").isNull(), "source")
    per = per.withColumn("src", F.row_number().over(every))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") - 1) % len(weights) + 1)).withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    up = Window.orderBy(F.col("cap") / F.col("w"), "src")
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    per = per.withColumn("target", F.least("cap", F.col("w") * F.max("level").over(whole)))
    return per.select("source", "src", "n_rows", "source_size", "target")


def _earlier(df: DataFrame, keys: list, by: str, what: str) -> DataFrame:
    """Adds ``before``: the sum of ``what`` over earlier ``by`` of the same keys, for small tables."""
    over = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.coalesce(F.sum(what).over(over), F.lit(0)))


def schedule(plan: DataFrame, n_slots: int) -> DataFrame:
    """slot, src, rank: the source of every slot, and the slot's place among its source's.

    plan: src, need (slots of the source), upto (need summed over sources, itself included); the last
    upto is n_slots. No task sorts more than a cell of points or a chunk of slots.
    """
    spark = plan.sparkSession
    cells = max(0, (max(1, n_slots) // CELL_SLOTS).bit_length())
    period = F.lit(1 << BITS)
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), F.pmod(F.pmod(F.col("id"), period) * GOLDEN, period).alias("point"))
    slots = slots.withColumn("cell", F.shiftright("point", BITS - cells))
    # the place of a point among all: by cell first
    counts = _earlier(slots.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), [], "cell", "n").drop("n")
    here = F.row_number().over(Window.partitionBy("cell").orderBy("point", "slot")) - 1
    placed = slots.withColumn("here", here).join(counts, "cell").select("slot", (F.col("before") + F.col("here")).alias("place"))
    # its source: the one whose share of places holds it
    width = max(1, -(-n_slots // max(1024, 4 * plan.count())))
    shares = plan.filter("need > 0").select("src", (F.col("upto") - F.col("need")).alias("lo"), (F.col("upto") - 1).alias("hi"))
    shares = shares.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    owned = placed.withColumn("stretch", F.floor(F.col("place") / width)).join(shares, "stretch").filter("place BETWEEN lo AND hi").select("slot", "src", F.floor(F.col("slot") / CELL_SLOTS).alias("chunk"))
    # its rank: by chunk first
    counts = _earlier(owned.groupBy("src", "chunk").agg(F.count(F.lit(1)).alias("n")), ["src"], "chunk", "n").drop("n")
    here = F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1
    return owned.withColumn("here", here).join(counts, ["src", "chunk"]).select("slot", "src", (F.col("before") + F.col("here")).alias("rank"))


def _turns(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple, max_repeats: int, block_words: int, seed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, entries, turns): distinct (source, id, size) with their number, documents with their place ``at`` in the source's stream, and for each round of the stream
    that takes words of a document: turn, words, first_slot, n_slots."""
    spark = docs.sparkSession
    ws = Workspace(spark, "mix")
    # rows that agree in source, id and size are one entry with a count, so that copies never meet in one sort
    rows = sized(docs, id_col, text_col, source_col)
    rows = ws.save(rows.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies")), "sized")
    unit = rows.select("source", (F.col("size") * F.col("copies")).alias("size"))
    plan = targets(unit, weights, max_repeats).withColumn("goal", F.floor(F.col("target") + 0.5))
    plan = plan.withColumn("need", F.ceil(F.col("goal") / block_words).cast("long"))
    plan = plan.withColumn("upto", F.sum("need").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    plan = ws.save(plan, "plan")
    n_slots, n_docs = plan.agg(F.sum("need"), F.sum("n_rows")).first()
    slots = schedule(plan, n_slots or 0)

    # where each document lies in its source's stream: sums by digest bucket, then within the bucket
    n_buckets = max(64, -(-(n_docs or 0) // 20000))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.col("size").cast("string")))
    entries = rows.join(plan.select("source", "src", "source_size", "target", "goal").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    entries = entries.withColumn("digest", digest).withColumn("bucket", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * n_buckets / float(2**32))).withColumn("all", F.col("size") * F.col("copies"))
    sums = _earlier(entries.groupBy("src", "bucket").agg(F.sum("all").alias("n")), ["src"], "bucket", "n").drop("n")
    here = Window.partitionBy("src", "bucket").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    entries = entries.withColumn("inner", F.coalesce(F.sum("all").over(here), F.lit(0))).join(sums, ["src", "bucket"])
    entries = entries.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("at", F.col("before") + F.col("inner") + F.col("copy") * F.col("size"))
    entries = entries.select("doc_id", "source", "size", "src", "source_size", "target", "goal", "at")

    # the blocks that hold words of a document, turn by turn of the stream, meet the slots that take them
    turns = entries.filter("size > 0 AND at < goal").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("goal") - 1 - F.col("at")) / F.col("source_size")))))
    turns = turns.withColumn("lo", F.col("turn") * F.col("source_size") + F.col("at")).withColumn("hi", F.least(F.col("lo") + F.col("size"), "goal"))
    parts = turns.withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / block_words), F.floor((F.col("hi") - 1) / block_words))))
    words = F.least("hi", (F.col("rank") + 1) * block_words) - F.greatest("lo", F.col("rank") * block_words)
    parts = parts.withColumn("words", words).join(slots, ["src", "rank"])
    keys = ["doc_id", "source", "size", "src", "source_size", "target", "at"]
    return rows, entries, parts.groupBy(*keys, "turn").agg(F.sum("words").alias("words"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_slots"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5, 2, 1), max_repeats: int = 3, block_words: int = BLOCK_WORDS, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot, n_slots: one row for each row of ``docs``."""
    _, entries, turns = _turns(docs, id_col, text_col, source_col, weights, max_repeats, block_words, seed)
    keys = ["doc_id", "source", "size", "src", "source_size", "target", "at"]
    taken = turns.groupBy(*keys).agg(F.sum("words").alias("taken"), F.min("first_slot").alias("first_slot"), F.sum("n_slots").alias("n_slots"))
    none = entries.filter("size = 0 OR at >= goal").select(*keys, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"), F.lit(0).cast("long").alias("n_slots"))
    return taken.unionByName(none).select("doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "first_slot", "n_slots")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5, 2, 1), max_repeats: int = 3, block_words: int = BLOCK_WORDS, seed: str = "mix") -> DataFrame:
    """``docs`` in the order of the mix: each row once for every turn that takes half of its words or more, by slot.

    Rows that agree in id and source share their words evenly, and their slots.
    """
    rows, _, turns = _turns(docs, id_col, text_col, source_col, weights, max_repeats, block_words, seed)
    key, source, slot = (free_name(docs, x) for x in ("id", "source", "slot"))
    took = turns.groupBy(F.col("doc_id").alias(key), F.col("source").alias(source), "turn").agg(F.sum("words").alias("words"), F.min("first_slot").alias(slot))
    # a turn takes words of some of the rows that agree in id and source: half of the words of all of them count
    whole = rows.groupBy("doc_id", F.col("source").alias("of")).agg(F.sum(F.col("size") * F.col("copies")).alias("all"))
    took = took.join(whole, F.col(key).eqNullSafe(F.col("doc_id")) & F.col(source).eqNullSafe(F.col("of"))).filter("2 * words >= all").select(key, source, slot)
    met = docs.join(took, F.col(id_col).eqNullSafe(F.col(key)) & F.col(source_col).cast("string").eqNullSafe(F.col(source)))
    return met.repartitionByRange(F.col(slot)).sortWithinPartitions(slot, id_col).select(*docs.columns)
