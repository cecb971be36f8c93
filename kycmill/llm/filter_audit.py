"""What filters remove, in every order they can be applied.

Each document fails some of the filters A to E; which ones is its mask. Documents are counted per part and mask
once. A recursive query then extends prefixes of filters by one unused letter a level, meets the mask cells and
carries the bits applied so far: each level emits, for every cell, whether the step removes it, keeps it, or finds
it gone already. The cells' documents per part are weighed with that last, because a recursion of Spark may hold
a limited number of rows (a million) and the number of parts has no limit: the recursion has 326 prefixes times
32 masks whatever the input.

A text's copies fail E, but for those with its smallest id. Only texts that occur more than once are joined back,
from a checkpoint, so that Spark can split a text that holds a large part of the rows; parts and masks are
combined in the tasks before they are exchanged.

Defined cases: null text is empty; null source is the empty part; a null id neither fails E nor makes others fail
it; rows equal in id and text do not fail E for each other; of several labels of an id one of quality 1 (toxic 1)
is enough; labels of null ids and of unknown documents do not count; an empty table has no parts and gives an
empty table; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, whole_text

#: Letters of the filters; the place of a letter is its bit.
LETTERS = "ABCDE"
GAP = r"[\x20\x09-\x0D]+"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 200, 50, 2, "[#$%&*|]"

#: Prefixes by level. ``removes``: this step takes the cell; ``keeps``: the cell is left after it; ``late``: the
#: cell fails the step's filter but an earlier step has taken it.
WALK = """
WITH RECURSIVE walk(prefix, step, letter, applied, mask, removes, keeps, late) AS (
  SELECT '', 0, '', 0, mask, false, true, false FROM {masks}
  UNION ALL
  SELECT /*+ BROADCAST(f) */ w.prefix || f.letter, w.step + 1, f.letter, w.applied | f.bit, w.mask,
    (w.mask & f.bit) <> 0 AND (w.mask & w.applied) = 0,
    (w.mask & (w.applied | f.bit)) = 0,
    (w.mask & f.bit) <> 0 AND (w.mask & w.applied) <> 0
  FROM walk w JOIN {filters} f ON (w.applied & f.bit) = 0
)
SELECT prefix, step, letter, mask, removes, keeps, late, (mask & ~{bit}) = 0 AND mask <> 0 AS alone
FROM walk WHERE step > 0
"""


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, GAP), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    fails = [
        n < MIN_WORDS,
        100 * different.cast("long") < DISTINCT_PERCENT * n.cast("long"),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > UPPER_PERCENT * F.length(text).cast("long"),
        text.rlike(SYMBOLS),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask``, ``n``, ``good``, ``toxic``: documents per part and set of failed filters."""
    text = whole_text()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        failures(text).alias("bits"),
    )
    repeated = checkpointed(
        docs.select(F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"))
        .groupBy("digest")
        .agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select("digest", "least")
    )
    marks = checkpointed(
        labels.filter(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    copy = F.when(F.col("least") < F.col("doc_id"), 1 << LETTERS.index("E")).otherwise(0)
    masked = rows.join(repeated, "digest", "left").select("doc_id", "part", F.col("bits").bitwiseOR(copy).alias("mask"))
    return (
        masked.join(marks, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(
            F.count("*").alias("n"),
            F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good"),
            F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("toxic"),
        )
    )


def walk(spark) -> DataFrame:
    """Every prefix of filters with every mask; the same for any input."""
    masks = spark.range(0, 1 << len(LETTERS), 1, 1).select(F.col("id").cast("int").alias("mask"))
    filters = spark.createDataFrame([(x, 1 << i) for i, x in enumerate(LETTERS)], "letter string, bit int").coalesce(1)
    bit = f"(1 << (instr('{LETTERS}', letter) - 1))"
    return spark.sql(WALK.replace("{bit}", bit), masks=masks, filters=filters)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, zeros included."""
    cells = checkpointed(mask_cells(docs, labels))
    levels = checkpointed(walk(docs.sparkSession).coalesce(1))

    def total(flag: str, weight: str = "n") -> Column:
        return F.sum(F.when(F.col(flag), F.col(weight)).otherwise(0)).cast("long")

    steps = cells.join(F.broadcast(levels), "mask").groupBy("part", "prefix", "step", "letter").agg(
        total("keeps").alias("kept"),
        total("removes").alias("removed"),
        total("late").alias("redundant"),
        total("alone").alias("unique_fails"),
        total("removes", "good").alias("good_lost"),
        total("removes", "toxic").alias("toxic_lost"),
    )
    # One mask of 32 is enough to name the orders. Levels and orders have a fixed number of rows.
    orders = levels.filter(f"step = {len(LETTERS)} AND mask = 0").select(F.col("prefix").alias("filter_order"))
    places = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("upto")).select(
        "filter_order", F.expr("substring(filter_order, 1, upto)").alias("prefix")
    )
    found = checkpointed(steps.join(F.broadcast(places), "prefix"))
    shares = found.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return found.join(shares, ["part", "letter"]).select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant",
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )
