"""Removes later copies of repeated line runs, by prefix doubling over line sequences.

Every line is a symbol and every document a sequence of them.  Prefix doubling sorts the
suffixes of all documents into buckets by their first 1, 2, 4, ... lines; a bucket of the
suffix array with common prefix 2^k is an LCP interval, numbered here by its first position
(doc_id, then line), which is all that removing later copies needs.  Two overlapping blocks
of 2^k lines give the interval of a run of any length.

A run of lines is repeated if it stands at an earlier position too.  A line goes if it lies
in a repeated run of ``MIN_WORDS`` words or more.  The longest such runs need not be listed:
a line of a long repeated run always lies in a shortest stretch of ``MIN_WORDS`` words that
starts there, or in one that ends at the run's end, and both are repeated as well.  So the
shortest stretches from and up to every line are looked up, exactly, in the intervals.

Lines that occur once end every run.  They are dropped before the doubling, so later rounds
see only stretches of repeated lines with enough words.  Positions are compared through
joins and map-side minima: a line that stands in a third of all rows meets in no single task.

Only DataFrame operations are used.

Defined results: the first copy of everything stays; texts are cut at newlines only; a null
text stays null, an empty one empty; a document that is a copy as a whole is left with no
text; rows with the same doc_id and text are one document and are treated alike; rows
without doc_id come before all others; other columns pass through, ``n_chars`` follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import spare_names, stored

MIN_WORDS = 50
DOC = ["doc_id", "text_key"]
SEGMENT = [*DOC, "segment"]


NO_ID = -(1 << 63)


def _doc_key() -> list[Column]:
    """What tells documents apart, in order: the id, missing ones first, and the text."""
    return [F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text_key")]


def repeated_segments(docs: DataFrame, min_words: int) -> DataFrame:
    """Stretches of lines that each occur again, with enough words to hold a run.

    ``name`` is the first position of the line, ``before`` and ``upto`` count the words of
    the stretch before the line and up to its end.
    """
    lines = docs.where(F.col("text").isNotNull()).select(
        *_doc_key(), F.posexplode(F.split("text", "\n", -1)).alias("i", "line")
    ).select(
        *DOC, "i", F.unhex(F.md5("line")).alias("h"),
        F.size(F.filter(F.split(F.trim("line"), r"\s+"), lambda w: w != "")).cast("bigint").alias("words"),
    )
    lines = stored(lines, "lines")
    here = F.struct(*DOC, "i")
    again = stored(
        lines.groupBy("h").agg(F.min(here).alias("name"), F.max(here).alias("last"))
        .where(F.col("name") < F.col("last")).drop("last"), "repeated-lines",
    )
    # repeated rows are one document
    kept = lines.join(again, "h").select(*DOC, "i", "words", "name").repartition(*DOC) \
        .dropDuplicates([*DOC, "i"])
    place = Window.partitionBy(*DOC).orderBy("i")
    cut = kept.withColumn("segment", F.col("i") - F.row_number().over(place))
    upto = Window.partitionBy(*SEGMENT).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumn("upto", F.sum("words").over(upto)).withColumn(
        "before", F.col("upto") - F.col("words")
    )
    whole = Window.partitionBy(*SEGMENT)
    return summed.withColumn("total", F.sum("words").over(whole)).where(
        F.col("total") >= min_words
    ).drop("total", "words")


def shortest_runs(segments: DataFrame, min_words: int) -> DataFrame:
    """(doc, segment, start, stop): the shortest runs of enough words from and up to each line."""
    ahead = Window.partitionBy(*SEGMENT).orderBy("before").rangeBetween(0, min_words - 1)
    back = Window.partitionBy(*SEGMENT).orderBy("upto").rangeBetween(-(min_words - 1), 0)
    found = segments.select(
        *SEGMENT, "i", "before", "upto",
        F.max("i").over(ahead).alias("last"), F.max("upto").over(ahead).alias("last_upto"),
        F.min("i").over(back).alias("first"), F.min("before").over(back).alias("first_before"),
    )
    forward = found.where(F.col("last_upto") - F.col("before") >= min_words).select(
        *SEGMENT, F.col("i").alias("start"), F.col("last").alias("stop")
    )
    backward = found.where(F.col("upto") - F.col("first_before") >= min_words).select(
        *SEGMENT, F.col("first").alias("start"), F.col("i").alias("stop")
    )
    return forward.union(backward).distinct()


def doubled(names: DataFrame, step: int) -> DataFrame:
    """First positions of blocks of ``2 * step`` lines, from those of ``step`` lines."""
    order = Window.partitionBy(*SEGMENT).orderBy("i")
    pairs = names.withColumns({
        "next": F.lead("name", step).over(order), "next_i": F.lead("i", step).over(order),
    }).where(F.col("next").isNotNull())
    pairs = stored(pairs, f"pairs-{step}")
    first = stored(
        pairs.groupBy("name", "next").agg(F.min(F.struct(*DOC, "i")).alias("wider")), f"first-{step}"
    )
    return pairs.join(first, ["name", "next"]).select(*SEGMENT, "i", F.col("wider").alias("name"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, start, stop): runs of lines with an earlier copy."""
    segments = stored(repeated_segments(docs, min_words), "segments")
    runs = stored(
        shortest_runs(segments, min_words).withColumn("lines", F.col("stop") - F.col("start") + 1),
        "runs",
    )
    longest = runs.agg(F.max("lines")).first()[0] or 0
    names, step, found = segments.select(*SEGMENT, "i", "name"), 1, []
    while step <= longest:
        # runs of step to 2 * step - 1 lines: their first and their last block of step lines
        own = runs.where((F.col("lines") >= step) & (F.col("lines") < 2 * step))
        head = names.select(*SEGMENT, F.col("i").alias("start"), F.col("name").alias("head"))
        tail = names.select(*SEGMENT, (F.col("i") + step - 1).alias("stop"), F.col("name").alias("tail"))
        blocks = stored(
            own.join(head, [*SEGMENT, "start"]).join(tail, [*SEGMENT, "stop"]), f"blocks-{step}"
        )
        here = F.struct(*DOC, F.col("start").alias("i"))
        first = stored(
            blocks.groupBy("lines", "head", "tail").agg(F.min(here).alias("first")), f"runs-{step}"
        )
        found.append(
            blocks.join(first, ["lines", "head", "tail"]).where(F.col("first") < here)
            .select(*DOC, "start", "stop")
        )
        step *= 2
        if step <= longest:
            names = stored(doubled(names, step // 2), f"names-{step}")
    if not found:
        return segments.select(*DOC, F.col("i").alias("start"), F.col("i").alias("stop")).where("false")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _stretches(runs: DataFrame) -> DataFrame:
    """Per document the merged stretches of lines to remove: one array of (from, to)."""
    earlier = Window.partitionBy(*DOC).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reach = runs.withColumn("reach", F.max("stop").over(earlier))
    starts = F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach") + 1), 1).otherwise(0)
    order = Window.partitionBy(*DOC).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    return (
        reach.withColumn("fresh", starts).withColumn("no", F.sum("fresh").over(order))
        .groupBy(*DOC, "no").agg(F.min("start").alias("from"), F.max("stop").alias("to"))
        .groupBy(*DOC).agg(F.collect_list(F.struct("from", "to")).alias("gone"))
    )


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS,
                        counted: bool = False) -> DataFrame:
    """``docs`` with later copies of line runs removed; ``counted`` adds ``n_removed`` lines."""
    doc, key, own_doc, own_key, cut = spare_names(docs, "doc", "key", "own_doc", "own_key", "cut")
    gone = stored(_stretches(repeated_runs(docs, min_words)), "removed-lines").select(
        F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("gone").alias(cut)
    )
    doc_id, text_key = _doc_key()
    keyed = docs.withColumns({own_doc: doc_id, own_key: text_key})
    # a shuffle join at every size: what is removed grows with the input
    joined = keyed.join(
        gone.hint("merge"), (F.col(own_doc) == F.col(doc)) & (F.col(own_key) == F.col(key)), "left"
    )
    lines = F.split("text", "\n", -1)
    left = F.filter(lines, lambda _, i: ~F.exists(
        cut, lambda g: (g["from"] <= i) & (i <= g["to"])))
    out = joined.withColumn(
        "text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    )
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(
            F.length("text")).cast(docs.schema["n_chars"].dataType))
    if counted:
        removed = F.aggregate(cut, F.lit(0).cast("bigint"), lambda a, g: a + g["to"] - g["from"] + 1)
        out = out.withColumn("n_removed", F.coalesce(removed, F.lit(0).cast("bigint")))
    return out.select(*docs.columns, *["n_removed"] * counted)
