"""Queries over text and vector retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderlens.catalog.core import query
from orderlens.catalog.orders import r
from orderlens.functions import text as X
from orderlens.functions.stop_words import ENGLISH
from orderlens.operators import retrieval
from orderlens.sources.driver_tables import star_table


def english_stop_words() -> list[str]:
    return sorted(ENGLISH)


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def corpus(spark, sf_dir):
    return star_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text", "source"
    )


def questions(spark, sf_dir):
    return star_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_TERMS = r"""
    SELECT {key} AS {alias}, unnest(list_concat(words, list_transform(range(1, len(words)),
               lambda i: words[i] || ' ' || words[i + 1]))) AS term
    FROM (SELECT {key}, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'),
                 lambda w: NOT list_contains({stop}, w)) AS words FROM {table}) w
"""


def _terms(key: str, alias: str, table: str) -> str:
    return _TERMS.format(key=key, alias=alias, table=table, stop=sql_list(english_stop_words()))


@query("x1_tfidf_search", f"""
    WITH doc_terms AS (SELECT id, term, 1 + ln(count(*)) AS tf
                       FROM ({_terms('doc_id', 'id', 'documents')}) t GROUP BY id, term),
    vocabulary AS (SELECT term, ln((1.0E0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1
                       AS idf FROM doc_terms GROUP BY term),
    doc_weights AS (SELECT id, term, tf * idf AS w FROM doc_terms JOIN vocabulary USING (term)),
    doc_norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM doc_weights GROUP BY id),
    query_weights AS (SELECT query_id, term, (1 + ln(count(*))) * max(idf) AS w
                      FROM ({_terms('item_id', 'query_id', 'benchmark')}) q
                      JOIN vocabulary USING (term) GROUP BY query_id, term),
    query_norms AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM query_weights
                    GROUP BY query_id),
    scores AS (SELECT q.query_id, d.id, sum(q.w * d.w) / max(qn.norm) / max(dn.norm) AS score
               FROM query_weights q JOIN doc_weights d ON d.term = q.term
               JOIN query_norms qn ON qn.query_id = q.query_id JOIN doc_norms dn ON dn.id = d.id
               GROUP BY q.query_id, d.id)
    SELECT query_id, id, round(score, 4) AS score, CAST(rank AS BIGINT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank
        FROM scores WHERE score > 0) s WHERE rank <= 4
""")
def tfidf_search(spark, sf_dir):
    stop = english_stop_words()
    asked = questions(spark, sf_dir)
    postings, vocabulary = retrieval.tfidf_index(corpus(spark, sf_dir), stop, asked)
    return retrieval.tfidf_search(asked, postings, vocabulary, stop).select(
        "query_id", "id", r("score"), F.col("rank").cast("bigint").alias("rank")
    )


_CENTROIDS = """
    SELECT label AS query_id, list(mean ORDER BY place) AS vector FROM (
        SELECT label, place, avg(CAST(value AS DOUBLE)) AS mean FROM (
            SELECT label, unnest(embedding) AS value,
                   unnest(range(1, len(embedding) + 1)) AS place FROM embeddings) e
        GROUP BY label, place) m GROUP BY label
"""


@query("x2_nearest_vectors", f"""
    WITH asked AS ({_CENTROIDS}),
    pairs AS (SELECT a.query_id, e.vec_id AS id, list_sum(list_transform(range(1, len(a.vector) + 1),
                  lambda i: (a.vector[i] - CAST(e.embedding[i] AS DOUBLE))
                            * (a.vector[i] - CAST(e.embedding[i] AS DOUBLE)))) AS distance
              FROM asked a CROSS JOIN embeddings e)
    SELECT CAST(query_id AS BIGINT) AS query_id, id, round(1 / (1 + distance), 4) AS score,
           CAST(rank AS BIGINT) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
          FROM pairs) p WHERE rank <= 4
""")
def nearest_vectors(spark, sf_dir):
    vectors = star_table(spark, sf_dir, "embeddings")
    # one query per label: the mean of its vectors
    centroids = (
        vectors.select("label", F.posexplode("embedding").alias("place", "value"))
        .groupBy("label", "place").agg(F.avg(F.col("value").cast("double")).alias("mean"))
        .groupBy(F.col("label").cast("bigint").alias("query_id"))
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "mean"))),
                         lambda p: p["mean"]).alias("vector"))
    )
    found = retrieval.nearest_vectors(
        centroids,
        vectors.select(F.col("vec_id").alias("id"),
                       F.col("embedding").cast("array<double>").alias("vector")),
    )
    return found.select("query_id", "id", r("score"), F.col("rank").cast("bigint").alias("rank"))


_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
_STRIP = r"'^\s+|\s+$', '', 'g'"
_MARK = chr(0xE000)  # a character no text uses


def _keywords_sql(expr: str) -> str:
    return (f"list_filter(list_distinct(regexp_extract_all(lower({expr}), '[a-z0-9_]+')), "
            f"lambda w: length(w) > 2 AND NOT list_contains({sql_list(X.KEYWORD_STOP_WORDS)}, w))")


_SENTENCES = rf"""
    lines AS (SELECT doc_id, unnest(string_split_regex(text, '{_BREAK}')) AS line,
                     unnest(range(0, len(string_split_regex(text, '{_BREAK}')))) AS line_no
              FROM documents),
    chunks AS (SELECT doc_id, line_no, unnest(parts) AS chunk, unnest(range(0, len(parts))) AS n
               FROM (SELECT doc_id, line_no, string_split(regexp_replace(
                         regexp_replace(line, {_STRIP}), '([.!?])\s+', '\1{_MARK}', 'g'),
                         '{_MARK}') AS parts FROM lines) l),
    plain AS (SELECT doc_id, line_no, n, regexp_replace(regexp_replace(replace(replace(replace(
                  regexp_replace(trim(regexp_replace(chunk, {_STRIP}), ' -|#*`>'), {_STRIP}),
                  '**', ''), ' | ', ' · '), '|', ' '), '\s{{2,}}', ' ', 'g'), {_STRIP}) AS sentence
              FROM chunks),
    firsts AS (SELECT * FROM (
                  SELECT *, row_number() OVER (PARTITION BY lower(sentence)
                             ORDER BY doc_id, line_no, n) AS copy
                  FROM plain WHERE length(sentence) >= 12) p WHERE copy = 1)
"""


@query("x3_extractive_answers", rf"""
    WITH {_SENTENCES},
    known AS (SELECT doc_id, line_no, n, sentence, {_keywords_sql('sentence')} AS words
              FROM firsts),
    words AS (SELECT doc_id, line_no, n, sentence, len(words) AS m, unnest(words) AS word
              FROM known),
    asked AS (SELECT item_id AS query_id, unnest({_keywords_sql('text')}) AS word
              FROM benchmark),
    hits AS (SELECT query_id, doc_id, line_no, n, any_value(sentence) AS sentence,
                    count(*) + count(*) / (1 + sqrt(max(m))) AS score
             FROM words JOIN asked USING (word) GROUP BY query_id, doc_id, line_no, n),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
                ORDER BY score DESC, doc_id, line_no, n) AS rank FROM hits) h WHERE rank <= 3)
    SELECT query_id, regexp_replace(substr(string_agg(sentence, ' ' ORDER BY doc_id, line_no, n),
               1, 700), {_STRIP}) AS answer, round(max(score), 4) AS top_score
    FROM top GROUP BY query_id
""")
def extractive_answers(spark, sf_dir):
    passages = star_table(spark, sf_dir, "documents").select("doc_id", "text")
    return retrieval.extractive_answers(questions(spark, sf_dir), passages, "doc_id").select(
        "query_id", "answer", r("top_score")
    )


@query("w4_direct_budget", """
    SELECT source, doc_id, chars, running_chars FROM (
        SELECT source, doc_id, CAST(length(text) AS BIGINT) AS chars,
               CAST(sum(length(text)) OVER w AS BIGINT) AS running_chars,
               row_number() OVER w AS place
        FROM documents WHERE length(text) > 0
        WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) d
    WHERE running_chars <= 24000 OR place = 1
""")
def direct_budget(spark, sf_dir):
    return retrieval.within_budget(
        star_table(spark, sf_dir, "documents"), "source", "doc_id", F.length("text"),
        retrieval.DIRECT_BUDGET,
    ).select("source", "doc_id", "chars", "running_chars")


@query("x4_context_passages", rf"""
    SELECT source, doc_id, snippet, running_chars FROM (
        SELECT source, doc_id, snippet, CAST(sum(length(snippet)) OVER w AS BIGINT)
                   AS running_chars, row_number() OVER w AS place
        FROM (SELECT source, doc_id, regexp_replace(substr(text, 1, 2600), {_STRIP}) AS snippet
              FROM documents) s
        WHERE length(snippet) > 0
        WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) d
    WHERE running_chars <= 20000 OR place = 1
""")
def context_passages(spark, sf_dir):
    return retrieval.context_passages(
        star_table(spark, sf_dir, "documents"), "source", "doc_id"
    ).select("source", "doc_id", "snippet", "running_chars")


# Plain documents hold few level-2 headers, so a document's first line is made one.
_HEADED = r"'## ' || text || chr(10) || '## Origin' || chr(10) || source"

_SECTIONS = rf"""
    headed AS (SELECT doc_id, source, {_HEADED} AS text FROM documents WHERE text IS NOT NULL),
    lines AS (SELECT doc_id, source, unnest(string_split_regex(text, '{_BREAK}')) AS line,
                     unnest(range(0, len(string_split_regex(text, '{_BREAK}')))) AS n
              FROM headed),
    marked AS (SELECT *, starts_with(line, '## ') AS is_header,
                      sum(CASE WHEN starts_with(line, '## ') THEN 1 ELSE 0 END) OVER (
                          PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS block
               FROM lines),
    bodies AS (SELECT doc_id, source, block,
                      coalesce(max(CASE WHEN is_header THEN
                          regexp_replace(ltrim(line, '# '), {_STRIP}) END), '(preamble)') AS header,
                      regexp_replace(coalesce(string_agg(CASE WHEN NOT is_header THEN line END,
                          chr(10) ORDER BY n), ''), {_STRIP}) AS body
               FROM marked GROUP BY doc_id, source, block),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1
                     AS section_no FROM bodies WHERE length(body) > 0),
    sections AS (SELECT source || '/' || doc_id || '#' || section_no AS id,
                        regexp_replace(header || chr(10) || body, {_STRIP}) AS text, source,
                        doc_id, section_no FROM numbered)
"""


def headed_documents(spark, sf_dir):
    return star_table(spark, sf_dir, "documents").select(
        "doc_id", "source",
        F.concat(F.lit("## "), "text", F.lit("\n## Origin\n"), "source").alias("text"),
    )


@query("w6_sections", f"""
    WITH {_SECTIONS} SELECT id, text, source, CAST(section_no AS BIGINT) AS section_no
    FROM sections
""")
def sections(spark, sf_dir):
    return retrieval.sections(headed_documents(spark, sf_dir), "doc_id").select(
        "id", "text", "source", F.col("section_no").cast("bigint").alias("section_no")
    )


@query("w7_keep_first", """
    SELECT d.source, CAST(count(*) AS BIGINT) AS kept, CAST(sum(d.doc_id) AS BIGINT) AS id_sum,
           CAST(min(s.first_seen) AS BIGINT) AS first_seen
    FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS copy
          FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0) d
    JOIN (SELECT source, min(doc_id) AS first_seen FROM documents GROUP BY source) s
      ON s.source = d.source
    WHERE copy = 1 GROUP BY d.source
""")
def keep_first(spark, sf_dir):
    docs = star_table(spark, sf_dir, "documents").select(
        F.md5("text").alias("id"), "doc_id", "text", "source"
    )
    kept = retrieval.keep_first(docs, "id", "doc_id").groupBy("source").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("doc_id").cast("bigint").alias("id_sum")
    )
    return kept.join(retrieval.ordered_sources(docs, "doc_id"), "source")


@query("u2_keyword_overlap", f"""
    WITH k AS (SELECT conv_id, turn, {_keywords_sql('text')} AS words FROM conversations)
    SELECT a.conv_id, a.turn, CAST(len(list_intersect(a.words, b.words)) AS BIGINT) AS overlap
    FROM k a JOIN k b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
""")
def keyword_overlap(spark, sf_dir):
    turns = star_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", X.keywords(F.col("text")).alias("words")
    )
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"),
                             F.col("words").alias("next_words"))
    return turns.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn",
        F.size(F.array_intersect("words", "next_words")).cast("bigint").alias("overlap"),
    )


def _markers_sql(markers) -> str:
    return "(" + " OR ".join(
        "contains(lower(text), '" + m.replace("'", "''") + "')" for m in markers) + ")"


@query("x6_answer_markers", f"""
    SELECT conv_id, turn, {_markers_sql(X.REFUSAL_MARKERS)} AS declines,
           {_markers_sql(X.UNKNOWN_MARKERS)} AS admits_unknown
    FROM conversations WHERE role = 'assistant'
""")
def answer_markers(spark, sf_dir):
    answers = star_table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return retrieval.classify_answers(answers).select(
        "conv_id", "turn", "declines", "admits_unknown"
    )


@query("x7_check_roll_up", f"""
    WITH k AS (SELECT conv_id, turn, role, text, {_keywords_sql('text')} AS words
               FROM conversations),
    answers AS (SELECT a.*, q.words AS asked FROM k a
                LEFT JOIN k q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1
                WHERE a.role = 'assistant'),
    checks AS (
        SELECT CASE WHEN len(list_intersect(words, asked)) > 0 THEN 'pass' ELSE 'fail' END
                   AS status FROM answers WHERE asked IS NOT NULL
        UNION ALL
        SELECT CASE WHEN length(text) = 0 THEN 'skip' WHEN NOT {_markers_sql(X.REFUSAL_MARKERS)}
                    THEN 'pass' ELSE 'fail' END FROM answers)
    SELECT CAST(count(*) AS BIGINT) AS total,
           CAST(count(*) FILTER (WHERE status = 'pass') AS BIGINT) AS passed,
           CAST(count(*) FILTER (WHERE status = 'fail') AS BIGINT) AS failed,
           CAST(count(*) FILTER (WHERE status = 'skip') AS BIGINT) AS skipped,
           CASE WHEN count(*) FILTER (WHERE status = 'fail') > 0 THEN 'fail' ELSE 'pass' END
               AS overall FROM checks
""")
def check_roll_up(spark, sf_dir):
    turns = star_table(spark, sf_dir, "conversations").withColumn(
        "words", X.keywords(F.col("text"))
    )
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"),
                         F.col("words").alias("asked"))
    answers = retrieval.classify_answers(
        turns.where(F.col("role") == "assistant").join(asked, ["conv_id", "turn"], "left")
    )
    answered = F.length("text") > 0
    grounded = answers.where(F.col("asked").isNotNull()).select(
        retrieval.check_status(
            F.size(F.array_intersect("words", "asked")) > 0, False, answered).alias("status")
    )
    in_scope = answers.select(
        retrieval.check_status(~F.col("declines"), True, answered).alias("status")
    )
    return retrieval.roll_up(grounded.unionByName(in_scope))
