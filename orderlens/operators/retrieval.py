"""Text and vector retrieval as batch jobs: many queries against a corpus table.

A corpus has ``id``, ``text`` and ``source``; its reading order is an explicit
column.  Top-k per query is a ``row_number`` filter, which Spark cuts to k rows
per query in every map task before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions import text as X
from orderlens.operators import pivot_index, term_blocks
from orderlens.operators.block_search import best_rows, overlap_score
from orderlens.session import staged

TOP_K = 4
DIRECT_BUDGET = 24_000
PASSAGE_CHARS = 2_600
CONTEXT_BUDGET = 20_000
ANSWER_CHARS = 700
MIN_SENTENCE_CHARS = 12
PREAMBLE = "(preamble)"
BUDGET_SALTS = 64


# ---- TF-IDF -------------------------------------------------------------------


def term_counts(texts: DataFrame, key: str, stop_words: list[str]) -> DataFrame:
    """Occurrences of each word and word pair per text."""
    terms = X.with_pairs(X.content_words(F.col("text"), stop_words))
    return (
        texts.where(F.col("text").isNotNull()).select(key, "text")
        # the count below needs no shuffle of the longer term rows then
        .repartition(key)
        .select(key, F.explode(terms).alias("term"))
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _damped(n: str) -> Column:
    return 1.0 + F.log(F.col(n).cast("double"))


def _unit(weighted: DataFrame, key: str) -> DataFrame:
    """One row per text: its words and their weights, scaled to unit length."""
    gathered = weighted.groupBy(key).agg(
        F.collect_list(F.struct("term", "weight")).alias("terms"),
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"),
    )
    return gathered.select(
        key, F.transform("terms", lambda t: t["term"]).alias("words"),
        F.transform("terms", lambda t: t["weight"] / F.col("norm")).alias("weights"),
    )


def tfidf_index(
    corpus: DataFrame, stop_words: list[str], queries: DataFrame | None = None,
    block_words: int = term_blocks.BLOCK_WORDS, bucket_chars: int = term_blocks.BUCKET_CHARS,
) -> tuple[DataFrame, DataFrame]:
    """(index, vocabulary): each document's words and unit-length weights, and idf.

    Both are staged: the index is read by every search, one row per document, so that a search
    never moves it.  With ``queries`` (text) both list only the terms these ask for, which gives
    them the same scores: weights still rest on all terms of all documents.
    """
    total, chars = corpus.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    buckets = 1 + chars // bucket_chars
    asked = None
    if queries is not None:
        spelt = F.explode(X.with_pairs(X.content_words(F.col("text"), stop_words))).alias("term")
        asked = term_blocks.in_buckets(queries.select(spelt).distinct(), buckets)
    blocks = term_blocks.term_blocks(corpus, "id", stop_words, buckets, block_words)
    counts = term_blocks.text_counts(blocks, asked)
    vocabulary = staged(
        counts.where(F.col("block").isNull())
        .select(F.inline("listed"))
        .select("term", (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1).alias("idf")),
        "vocabulary",
    )
    return staged(term_blocks.unit_weights(blocks, counts, total, asked is None), "index"), vocabulary


def tfidf_search(
    queries: DataFrame, index: DataFrame, vocabulary: DataFrame, stop_words: list[str],
    k: int = TOP_K,
) -> DataFrame:
    """The k documents with the highest positive cosine per query (ties by id).

    The index is scanned where it lies and blocks of documents whose best possible cosine is
    too low stay closed; only k documents per task and query are shuffled.
    """
    asked = term_counts(queries, "query_id", stop_words).join(vocabulary, "term").select(
        "query_id", "term", (_damped("n") * F.col("idf")).alias("weight")
    )
    words = _unit(asked, "query_id").select(
        "query_id", F.explode(F.arrays_zip("words", "weights")).alias("w")
    ).select("query_id", F.col("w.words").alias("word"), F.col("w.weights").alias("weight"))
    return best_rows(index, words, k)


# ---- vectors --------------------------------------------------------------------

def nearest_vectors(
    queries: DataFrame, corpus: DataFrame | pivot_index.PivotIndex, k: int = TOP_K,
    max_floats: int = pivot_index.QUERY_FLOATS,
) -> DataFrame:
    """The k nearest corpus vectors per query by squared Euclidean distance, exactly.

    Score is 1 / (1 + distance).  ``corpus`` is a pivot index, or a table (id, vector) that one
    is built of.  Only the cells that may hold a nearer vector are read, in two scans for each
    block of queries; a task keeps only its k best per query.
    """
    index = corpus if isinstance(corpus, pivot_index.PivotIndex) else pivot_index.build(corpus)
    found, _ = pivot_index.nearest(queries, index, k, max_floats)
    return found.withColumn("score", 1.0 / (1.0 + F.col("distance")))


# ---- budgets ---------------------------------------------------------------------


def within_budget(
    docs: DataFrame, group: str, order: str, chars: Column, budget: int
) -> DataFrame:
    """Documents in order while their running length fits; a group's first always stays.

    A group may hold any share of the rows, so it is first read in salted slices.
    A slice drops a row only when the rows before it in the slice alone are over
    budget; what is left per group is at most one budget per slice, and the exact
    running sum is taken over that.
    """
    sized = docs.withColumn("chars", chars.cast("bigint")).where(F.col("chars") > 0)
    thin = sized.select(group, order, "chars", F.pmod(F.xxhash64(order), F.lit(BUDGET_SALTS)).alias("salt"))
    before = Window.partitionBy(group, "salt").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    candidates = thin.withColumn("before", F.coalesce(F.sum("chars").over(before), F.lit(0))).where(
        F.col("before") <= budget
    )
    upto = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    kept = (
        candidates.withColumns({
            "running_chars": F.sum("chars").over(upto),
            "place": F.row_number().over(Window.partitionBy(group).orderBy(order)),
        })
        .where((F.col("running_chars") <= budget) | (F.col("place") == 1))
        .select(group, order, "chars", "running_chars")
    )
    return kept


def context_passages(
    docs: DataFrame, group: str, order: str, passage_chars: int = PASSAGE_CHARS, budget: int = CONTEXT_BUDGET
) -> DataFrame:
    """Passages of at most ``passage_chars`` characters, ``budget`` per group, with their snippet."""
    cut = docs.withColumn(
        "snippet", X.strip_space(F.substring("text", 1, passage_chars))
    )
    kept = within_budget(cut, group, order, F.length("snippet"), budget)
    return kept.join(cut.select(group, order, "snippet"), [group, order])


# ---- sections and corpora ---------------------------------------------------------


def sections(docs: DataFrame, key: str) -> DataFrame:
    """One row per level-2 section with a body, numbered from 0 per document.

    The split is row-local: no shuffle, whatever the number of documents.
    """
    newline = F.regexp_replace("text", X.LINE_BREAK, "\n")
    pieces = F.split(newline, r"(?m)^(?=## )")
    parsed = F.transform(
        pieces,
        lambda p: F.struct(
            F.when(
                F.startswith(p, F.lit("## ")),
                X.strip_space(F.ltrim(F.substring_index(p, "\n", 1), F.lit("# "))),
            ).otherwise(F.lit(PREAMBLE)).alias("header"),
            X.strip_space(
                F.when(
                    F.startswith(p, F.lit("## ")),
                    F.when(F.contains(p, F.lit("\n")), F.regexp_replace(p, r"^[^\n]*\n", ""))
                    .otherwise(F.lit("")),
                ).otherwise(p)
            ).alias("body"),
        ),
    )
    filled = F.filter(parsed, lambda s: F.length(s["body"]) > 0)
    return docs.where(F.col("text").isNotNull()).select(
        key, "source", F.posexplode(filled).alias("section_no", "section")
    ).select(
        F.concat(F.col("source"), F.lit("/"), F.col(key).cast("string"), F.lit("#"),
                 F.col("section_no").cast("string")).alias("id"),
        X.strip_space(F.concat("section.header", F.lit("\n"), "section.body")).alias("text"),
        "source", key, "section_no",
    )


def keep_first(docs: DataFrame, key: str, order: str) -> DataFrame:
    """The first row per key in load order, blank texts dropped.

    ``min_by`` combines on the map side, so copies of one key never meet in full.
    """
    row = F.struct(*[F.col(c) for c in docs.columns])
    return (
        docs.where(F.length(X.strip_space(F.col("text"))) > 0)
        .groupBy(key).agg(F.min_by(row, F.col(order)).alias("row")).select("row.*")
    )


def ordered_sources(docs: DataFrame, order: str) -> DataFrame:
    """Distinct sources by first appearance."""
    return docs.groupBy("source").agg(F.min(order).alias("first_seen"))


def metric_sentences(metrics: DataFrame) -> DataFrame:
    """One authoritative sentence per model out of its metrics row."""
    names = {"delay": "delivery-delay", "low_review": "low-review (1-2 star) satisfaction"}
    title = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("model")]

    def fixed(name: str) -> Column:
        return F.format_string("%.4f", F.col(name))

    def grouped(name: str) -> Column:
        return F.format_number(F.col(name), 0)

    text = F.concat(
        F.lit("Model '"), F.col("model"), F.lit("' — "), title,
        F.lit(" risk. Held-out test set: "), grouped("n_test"),
        F.lit(" orders; positive base rate "),
        F.format_string("%.1f", F.col("base_rate") * 100), F.lit("%. ROC-AUC "), fixed("roc_auc"),
        F.lit(", PR-AUC "), fixed("pr_auc"), F.lit(", Brier "), fixed("brier"),
        F.lit(". At the validation-tuned threshold "), fixed("threshold"), F.lit(": precision "),
        fixed("precision"), F.lit(", recall "), fixed("recall"), F.lit(", F1 "), fixed("f1"),
        F.lit(", accuracy "), fixed("accuracy"), F.lit(". Majority-class baseline accuracy "),
        fixed("baseline_accuracy"), F.lit(", recall on positives "), fixed("baseline_recall"),
        F.lit(". Probabilities are isotonic-calibrated."),
    )
    return metrics.select(
        F.concat(F.lit("metrics_"), "model").alias("id"), text.alias("text"),
        F.concat(F.lit("reports/metrics_"), "model", F.lit(".json")).alias("source"),
    )


# ---- extractive answers -------------------------------------------------------------


def sentences(passages: DataFrame, order: str) -> DataFrame:
    """Distinct plain sentences with their first reading position.

    Copies differing only in case are one sentence; they fold on the map side, so
    a sentence repeated in a third of all passages costs one row per task.
    """
    chunks = (
        passages.where(F.col("text").isNotNull()).select(order, "text")
        .select(order, F.posexplode(X.split_lines(F.col("text"))).alias("line", "line_text"))
        .select(
            order, "line",
            F.posexplode(F.split(X.strip_space(F.col("line_text")), X.SENTENCE_BREAK))
            .alias("chunk", "chunk_text"),
        )
        .select(
            F.struct(order, "line", "chunk").alias("position"),
            X.plain_sentence(F.col("chunk_text")).alias("sentence"),
        )
        .where(F.length("sentence") >= MIN_SENTENCE_CHARS)
    )
    return chunks.groupBy(F.lower("sentence").alias("key")).agg(
        F.min("position").alias("position"), F.min_by("sentence", "position").alias("sentence")
    )


def extractive_answers(
    questions: DataFrame, passages: DataFrame, order: str, max_sentences: int = 3
) -> DataFrame:
    """Per question the best sentences by keyword overlap, in reading order.

    Sentences are searched in blocks bounded by the words that they can share with a question;
    ties go to the earlier one.
    """
    asked = questions.select("query_id", F.explode(X.keywords(F.col("text"))).alias("word"), F.lit(1.0).alias("weight"))
    words = X.keywords(F.col("sentence"))
    known = staged(sentences(passages, order).withColumn("words", words), "sentences")
    found = best_rows(
        known.select(F.col("position").alias("id"), "words", F.size("words").cast("double").alias("size")),
        asked, max_sentences, overlap_score,
    )
    # texts are fetched for the chosen sentences alone
    top = found.join(known.select(F.col("position").alias("id"), "sentence"), "id").withColumnRenamed("id", "position")
    # at most ``max_sentences`` rows per question from here on
    return top.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "sentence"))).alias("picked"),
        F.max("score").alias("top_score"),
    ).select(
        "query_id",
        X.strip_space(F.substring(
            F.array_join(F.transform("picked", lambda p: p["sentence"]), " "), 1, ANSWER_CHARS
        )).alias("answer"),
        "top_score",
    )


# ---- checks ---------------------------------------------------------------------------


def classify_answers(answers: DataFrame) -> DataFrame:
    """Whether an answer declines the request or admits not knowing."""
    return answers.withColumns({
        "declines": X.contains_any(F.col("text"), X.REFUSAL_MARKERS),
        "admits_unknown": X.contains_any(F.col("text"), X.UNKNOWN_MARKERS),
    })


def check_status(ok: Column, needs_model: bool, model_available: Column) -> Column:
    """pass / fail, or skip for a model check without a model."""
    judged = F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail")
    return F.when(~model_available, "skip").otherwise(judged) if needs_model else judged


def roll_up(checks: DataFrame) -> DataFrame:
    """Totals by status, and the verdict: any failed check fails the run."""
    failed = F.count_if(F.col("status") == "fail")
    return checks.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "pass").alias("passed"),
        failed.alias("failed"),
        F.count_if(F.col("status") == "skip").alias("skipped"),
        F.when(failed > 0, "fail").otherwise("pass").alias("overall"),
    )
