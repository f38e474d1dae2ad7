"""Mixing sources to target weights along a curriculum. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
# Weights of the sources in the order of their names, repeated.
WEIGHTS = (1.0, 2.0, 3.0)
# How a source's weight changes over the run, as (progress, factor) knots with mean 1,
# repeated like the weights: falling, even, rising.
SHAPES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
MOST_REPEATS = 3
# Hexadecimal digits of the hash that name the block in which a document is summed up:
# 4096 blocks per source.
BLOCK_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def integrals(shapes) -> list[list[tuple[float, ...]]]:
    """Per shape its segments: from, to, weight at from, slope, share before, whole area."""
    out = []
    for knots in shapes:
        area, segments = 0.0, []
        for (low, left), (high, right) in zip(knots, knots[1:], strict=False):
            segments.append((low, high, left, (right - left) / (high - low), area))
            area += (left + right) / 2 * (high - low)
        out.append([(*segment[:4], segment[4] / area, area) for segment in segments])
    return out


def progress_at(share: Column, shape: Column, shapes=SHAPES) -> Column:
    """The progress at which a source of this shape has met ``share`` of its demand.

    Inverts the integral of the piecewise linear weight: a quadratic per segment.
    """
    found = F.lit(None).cast("double")
    for number, segments in enumerate(integrals(shapes)):
        inverse = F.lit(1.0)
        for low, high, left, slope, before, area in reversed(segments):
            need = (share - before) * area
            if slope:
                step = (F.sqrt(F.greatest(F.lit(left * left) + 2 * slope * need, F.lit(0.0))) - left) / slope
            else:
                step = need / left
            upto = before + (left + slope * (high - low) / 2) * (high - low) / area
            here = F.least(F.greatest(F.lit(low) + step, F.lit(low)), F.lit(high))
            inverse = F.when(share <= upto, here).otherwise(inverse)
        found = F.when(shape == number, inverse).otherwise(found)
    return found


def source_targets(sizes: DataFrame, weights=WEIGHTS, shapes=SHAPES, most: float = MOST_REPEATS) -> DataFrame:
    """Targets of the sources: by weight, at most ``most`` times the size, excess reshared.

    ``sizes`` has one row per source (``source``, ``source_size``), so its windows run
    over the list of sources, never over documents. With the sources in the order of
    size by weight, those before some place are capped and the others share the rest.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    rank = F.row_number().over(by_name) - 1
    # The integral of a source's schedule is its weight.
    ranked = sizes.withColumn("shape", (rank % len(shapes)).cast("int")).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    )
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    earlier = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_room.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = ranked.withColumns({
        "level": (total - most * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))) / F.sum("weight").over(onward),
        "room": most * F.col("source_size") / F.col("weight"),
    })
    # The first source whose cap is above the level fixes it; if none is, all are at their caps.
    settled = level.withColumn("settled", F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "level"))).over(everything))
    share = F.col("settled.level") * F.col("weight")
    cap = most * F.col("source_size").cast("double")
    return settled.select(
        "source", "source_size", "shape", F.coalesce(F.least(share, cap), cap).cast("double").alias("target")
    )


def plan_mix(docs: DataFrame, weights=WEIGHTS, shapes=SHAPES, most: int = MOST_REPEATS, digits: int = BLOCK_DIGITS,
             rows: bool = False) -> DataFrame:
    """Per row of ``docs``: key, size, its source's size and target, words taken, parts.

    Documents of a source stand in the order of a hash. The source's demand runs
    through them, again from the start where a target is above the size, and ends in
    a document that is then taken in part, so ``taken`` adds up to the target.
    ``parts`` lists each time a document is used: words taken and the training
    position, which is the progress at which the source's integrated weight has
    asked for the words before it. With ``rows`` the whole row comes along as ``row``.

    Sums run in two levels, inside hash blocks and over them, so no task holds a
    source. A null text has no words and is never taken; a null source is a source,
    the last; null ids are kept; equal rows count each; further columns are not read
    unless ``rows`` asks for them; an empty table gives no rows.
    """
    source = F.col("source").cast("string")
    draw = F.md5(F.concat_ws(" ", F.col("doc_id").cast("string"), F.col("text")))
    measured = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), draw.alias("draw"),
        word_count(F.col("text")).alias("size"), source.alias("source"),
        # Windows and joins by a key that is never null.
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("of"),
        *([F.struct(*(F.col(f"`{name}`") for name in docs.columns)).alias("row")] if rows else []),
    ).withColumn("block", F.substring("draw", 1, digits))
    per_block = measured.groupBy("of", "source", "block").agg(F.sum("size").alias("held"))
    sources = source_targets(per_block.groupBy("source").agg(F.sum("held").alias("source_size")), weights, shapes, most)
    sources = sources.withColumn("of", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    before = Window.partitionBy("of").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = per_block.select(
        "of", "block", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before")
    ).join(sources, "of")
    inside = Window.partitionBy("of", "block").orderBy("draw", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    joined = measured.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(start, ["of", "block"])
    first_word = F.col("before") + F.col("ahead")
    goal = F.round("target").cast("bigint")

    def use(epoch: int) -> Column:
        at = F.lit(epoch) * F.col("source_size") + first_word
        words = F.greatest(F.least(goal - at, F.col("size")), F.lit(0).cast("bigint"))
        share = at / F.greatest(F.col("target"), F.lit(1.0))
        return F.struct(words.alias("words"), progress_at(share, F.col("shape"), shapes).alias("position"))

    parts = F.filter(F.array(*(use(epoch) for epoch in range(most))), lambda part: part["words"] > 0)
    return joined.withColumn("parts", parts).select(
        "doc_id", "draw", "size", "source_size", "target",
        F.aggregate("parts", F.lit(0).cast("bigint"), lambda total, part: total + part["words"]).alias("taken"),
        "parts", *(["row"] if rows else []),
    )


def first_words(text: Column, words: Column) -> Column:
    """The first ``words`` words, with one blank between them."""
    found = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    return F.array_join(F.slice(found, F.lit(1), words.cast("int")), " ")


def mix(docs: DataFrame, weights=WEIGHTS, shapes=SHAPES, most: int = MOST_REPEATS) -> DataFrame:
    """The mixed documents in training order: the columns of ``docs``, once per use.

    Rows are range-partitioned and sorted by position. The one document of a source
    and round that is used in part keeps its first words, and ``n_chars``, where there
    is such a column, is counted again.
    """
    used = plan_mix(docs, weights, shapes, most, rows=True).select("row", "draw", "size", F.explode("parts").alias("part"))
    ordered = used.repartitionByRange("part.position", "draw").sortWithinPartitions("part.position", "draw")
    row, words = F.col("row"), F.col("part.words")
    partly = words < F.col("size")
    text = F.when(partly, first_words(row["text"], words)).otherwise(row["text"])
    out = {name: row[name] for name in docs.columns} | {"text": text}
    if "n_chars" in out:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(partly, F.length(text).cast(kind)).otherwise(row["n_chars"])
    return ordered.select(*(column.alias(name) for name, column in out.items()))
