"""Question routing for whole question tables, in one plan.

Order of decisions per question (as in the reference's router):
  1. optional domain gate (off-topic questions leave as ``off_topic``);
  2. pattern intents (``parse_intents``) -> ``pattern``;
  3. best catalogue match with score >= threshold -> ``matched``, or ``needs_date``
     when the entry takes a date and none is given or found;
  4. any of the top-k with score >= ``suggest_at`` -> ``suggest`` (with their texts);
  5. otherwise ``not_found``.

Matching score: cosine similarity of character-trigram count vectors of the folded
texts. No embedding model is available to the engine, so this deterministic sparse
embedding stands in; its scores differ from the reference's, so thresholds are
parameters. It is computed relationally: trigrams are exploded per question, the
sparse dot product with the catalogue is an equi-join on the trigram against the
catalogue's trigram table (fixed size: 33 entries, broadcast), then a sum per
(question, entry). Each question row meets at most 33 catalogue rows per trigram,
so no step grows with the product of two large tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolo.functions.text import add_question_fields, fold, in_domain, normalize_terms
from tremolo.operators.vectors import catalogue_topk, context_text, prompt_text
from tremolo.plans.intents import catalogue_df, dated, entries

NGRAM = 3


def trigram_counts(df: DataFrame, id_cols: list[str], text: str | Column,
                   n: int = NGRAM) -> DataFrame:
    """(ids..., gram, cnt): character n-gram counts of the folded text (whole text).

    Start positions are exploded and each n-gram is cut by a plain ``substr`` in the
    next projection, which stays in generated code (a lambda over the array would be
    interpreted per element)."""
    folded = df.select(*id_cols, fold(text).alias("_f"))
    length = F.length("_f")
    pos = folded.select(*id_cols, "_f", F.explode(
        F.when(length >= n, F.sequence(F.lit(1), length - (n - 1)))).alias("_i"))
    grams = pos.select(*id_cols, F.substr(F.col("_f"), F.col("_i"), F.lit(n)).alias("gram"))
    return grams.groupBy(*id_cols, "gram").agg(F.count(F.lit(1)).alias("cnt"))


def _with_norm(counts: DataFrame, id_cols: list[str], out: str) -> DataFrame:
    w = Window.partitionBy(*id_cols)
    return counts.withColumn(out, F.sqrt(F.sum(F.col("cnt") * F.col("cnt")).over(w)))


def catalogue_scores(questions: DataFrame, id_cols: list[str], text: str | Column,
                     catalogue: DataFrame | None = None) -> DataFrame:
    """(ids..., intent_id, score) for every catalogue entry sharing a trigram."""
    spark = questions.sparkSession
    cat = catalogue if catalogue is not None else catalogue_df(spark)
    c = _with_norm(trigram_counts(cat, ["intent_id"], "question"), ["intent_id"], "cnorm")
    c = c.select("intent_id", "gram", F.col("cnt").alias("ccnt"), "cnorm")
    q = _with_norm(trigram_counts(questions, id_cols, text), id_cols, "qnorm")
    joined = q.join(F.broadcast(c), "gram")
    return (joined.groupBy(*id_cols, "intent_id")
            .agg((F.sum(F.col("cnt") * F.col("ccnt")) /
                  (F.first("qnorm") * F.first("cnorm"))).alias("score")))


def top_intents(questions: DataFrame, id_cols: list[str], text: str | Column, k: int = 3,
                catalogue: DataFrame | None = None) -> DataFrame:
    """T4: (ids..., rank, intent_id, score) for the k best entries per question; ties
    go to the lower intent id. ``row_number() <= k`` is planned as a window group
    limit, applied before the window's own shuffle."""
    s = catalogue_scores(questions, id_cols, text, catalogue)
    w = Window.partitionBy(*id_cols).orderBy(F.desc("score"), F.asc("intent_id"))
    return (s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(*id_cols, "rank", "intent_id", "score"))


#: questions that the catalogue and the patterns leave open
OPEN = ("needs_date", "suggest", "not_found")


def with_context(routed: DataFrame, questions: DataFrame, id_col: str, text: str, hits: DataFrame,
                 texts: DataFrame) -> DataFrame:
    """B3's last stage: ``routed`` with ``context`` (the texts of the question's nearest rows)
    and ``prompt`` for the questions of status ``OPEN``; NULL for all others.

    ``hits`` (query_id, rank, corpus_id) are the nearest rows of each question's vector (for
    example ``vectors.knn`` of vectors made by any embedder), ``texts`` (corpus_id, text)
    their texts. Only hits of open questions meet the texts."""
    still = routed.where(F.col("status").isin(*OPEN)).select(F.col(id_col).alias("query_id"))
    asked = questions.select(F.col(id_col).alias("query_id"),
                             normalize_terms(F.col(text)).alias("question"))
    prompts = context_text(hits.join(still, "query_id", "left_semi"), texts,
                           asked.join(still, "query_id", "left_semi"))
    return routed.join(prompts.select(F.col("query_id").alias(id_col), "context", "prompt"),
                       id_col, "left")


def with_shared_context(routed: DataFrame, questions: DataFrame, id_col: str, text: str,
                        vector: str, hits: DataFrame, texts: DataFrame) -> DataFrame:
    """:func:`with_context` for questions that share vectors: ``questions`` names each one's
    vector in the column ``vector``, and ``hits`` (query_id = vector, rank, corpus_id) has the
    nearest rows of each vector. A context is made once per vector, so that hits and texts do
    not grow with the questions; a question without a vector gets NULLs."""
    contexts = context_text(hits, texts)
    asked = questions.select(id_col, F.col(vector).alias("query_id"),
                             normalize_terms(F.col(text)).alias("_question"))
    still = F.col("status").isin(*OPEN)
    return routed.join(asked, id_col).join(contexts, "query_id", "left").withColumn(
        "context", F.when(still, F.col("context"))).withColumn(
        "prompt", prompt_text(F.col("context"), F.col("_question"))).drop("query_id", "_question")


def _question_text_of(intent: Column) -> Column:
    flat = []
    for e in entries():
        flat += [F.lit(e.intent_id), F.lit(e.question)]
    return F.element_at(F.create_map(*flat), intent)


def route_questions(questions: DataFrame, id_cols: list[str], text: str,
                    threshold: float = 0.65, suggest_at: float = 0.40, k: int = 3,
                    gate: bool = False, date_col: str | None = None,
                    compat_dayfirst: bool = False, vector: str | Callable | None = None,
                    catalogue_vectors: DataFrame | None = None) -> DataFrame:
    """One routing row per question.

    Output: ids..., kind, level, months, month_no (pattern intents), intent_id, score
    (best catalogue entry), needs_date, date, status, suggestions (array of catalogue
    texts, rank order). With ``gate`` the reference's second entry point is followed:
    off-topic questions stop, the others are matched after term rewriting. The gate reads the
    question as asked: the bare word passes, its inflected form alone does not.

    With ``vector`` (a column of ``questions``) the questions are matched by the cosine of their vectors
    with ``catalogue_vectors`` (intent_id, vector) instead of by trigrams; a question without a vector, or
    with a zero one, matches nothing. ``plans.embedder`` makes both columns from texts. ``vector`` may also be
    a function (texts, text column, new column) -> texts with vectors: each distinct text is embedded once."""
    embed, vector = (vector, None) if callable(vector) else (None, vector)
    q = questions.select(*id_cols, F.col(text).alias("_text"), *(
        [F.col(vector).alias("_vector")] if vector else []),
                         *( [F.col(date_col).alias("_given_date")] if date_col else []))
    match_text = normalize_terms(F.col("_text")) if gate else F.col("_text")
    # Scoring and parsing depend on the text only, so they run once per distinct text
    # (question tables repeat phrasings). A text is known by a 128-bit hash: n-gram rows,
    # rankings and the join back to the questions carry that key and never the text.
    q = q.select(*[c for c in q.columns if c != "_text"], match_text.alias("_match"),
                 (in_domain(F.col("_text")) if gate else F.lit(True)).alias("_on_topic"))
    known = F.md5(F.encode("_match", "UTF-8"))
    if vector:  # a text may have several vectors
        known = F.concat(known, F.coalesce(F.hex(F.xxhash64("_vector")), F.lit("-")))
    q = q.withColumn("_key", known)
    texts = q.groupBy("_key").agg(F.first("_match").alias("_match"), *(
        [F.first("_vector").alias("_vector")] if vector else []))
    if embed:
        # embedding costs time, not bytes: one part per core, which AQE would join by their size
        spread = texts.repartition(questions.sparkSession.sparkContext.defaultParallelism, "_key")
        top = catalogue_topk(embed(spread, "_match", "_vector").select("_key", "_vector"), catalogue_vectors, k,
                             qvec="_vector", cat_id="intent_id", cat_vec="vector", cosine=True).drop("_vector")
    elif vector:
        q = q.drop("_vector")
        top = catalogue_topk(texts.select("_key", "_vector"), catalogue_vectors, k, qvec="_vector",
                             cat_id="intent_id", cat_vec="vector", cosine=True).drop("_vector")
        texts = texts.drop("_vector")
    else:
        top = top_intents(texts, ["_key"], "_match", k)
    summary = top.groupBy("_key").agg(
        F.min(F.struct("rank", "intent_id", "score")).alias("_best"),
        F.array_sort(F.collect_list(F.struct("rank", "intent_id", "score"))).alias("_top"))
    per_text = add_question_fields(texts, "_match", prefix="_q_", compat_dayfirst=compat_dayfirst
                                   ).drop("_match").join(summary, "_key", "left")
    r = q.drop("_match").join(per_text, "_key", "left")
    found_date = F.col("_q_date")
    date = F.coalesce(F.col("_given_date"), found_date) if date_col else found_date
    best_score = F.col("_best.score")
    best_intent = F.col("_best.intent_id")
    needs = best_intent.isin(dated())
    sugg = F.transform(F.filter(F.coalesce(F.col("_top"), F.array()),
                                lambda s: s["score"] >= F.lit(suggest_at)),
                       lambda s: _question_text_of(s["intent_id"]))
    status = F.when(F.col("_q_kind").isNotNull(), F.lit("pattern"))
    status = (status.when(best_score >= F.lit(threshold),
                          F.when(needs & F.col("_date").isNull(), F.lit("needs_date"))
                          .otherwise(F.lit("matched")))
              .when(F.size(F.col("_sugg")) > 0, F.lit("suggest"))
              .otherwise(F.lit("not_found")))
    if gate:
        status = F.when(F.col("_on_topic"), status).otherwise(F.lit("off_topic"))
    out = r.withColumn("_date", date).withColumn("_sugg", sugg).withColumn("status", status)
    return out.select(
        *id_cols,
        F.col("_q_kind").alias("kind"), F.col("_q_level").alias("level"),
        F.col("_q_months").alias("months"), F.col("_q_month_no").alias("month_no"),
        best_intent.alias("intent_id"), best_score.alias("score"),
        F.coalesce(needs, F.lit(False)).alias("needs_date"),
        F.col("_date").alias("date"),
        "status",
        F.when(F.col("status") == "suggest", F.col("_sugg")).alias("suggestions"))
