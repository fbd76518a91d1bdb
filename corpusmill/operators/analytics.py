"""De-identified reports over the question log, facts of the corpus, and evaluation metrics."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.session import cut

#: Patterns of facts. (Fixed values.)
FACTS = (
    ("date", r"\b\d{4}-\d{2}-\d{2}\b"),
    ("amount", r"\$\d[\d,]*(?:\.\d{2})?k?\b"),
    ("gpa", r"(?i)\bgpa of \d\.\d+\b"),
    ("deadline", r"(?i)\b(?:deadline|due)\b[^.!?\n]{0,60}\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December)\b"),
)
SUPPORT_WORDS = (("crisis", r"(?i)\b(?:suicid\w*|self[- ]harm|emergency)\b"), ("health", r"(?i)\b(?:mental health|anxiety|depression|stress|wellness)\b"), ("hardship", r"(?i)\b(?:hardship|eviction|food bank|debt)\b"))
COARSE_TOPIC = "wellbeing"


def weekly_trends(questions: DataFrame, topic: str = "topic_label", at: str = "asked_at", confidence: str = "retrieval_confidence", refused: str = "was_refused") -> DataFrame:
    """week_start, topic, size, mean_confidence, refusal_rate, priority of each week's questions by topic.

    Priority is size × (1 − mean confidence × (1 − refusal rate)): many questions answered badly come first.
    Null topics are 'unknown'; null confidences don't count in the mean (0 if there are none).
    """
    own = questions.select(F.date_trunc("week", at).cast("date").alias("week_start"), F.coalesce(topic, F.lit("unknown")).alias("topic"), F.col(confidence).cast("double").alias("c"), F.col(refused).cast("double").alias("r"))
    out = own.groupBy("week_start", "topic").agg(F.count("*").alias("size"), F.round(F.coalesce(F.avg("c"), F.lit(0.0)), 6).alias("mean_confidence"), F.round(F.avg("r"), 6).alias("refusal_rate"))
    return out.withColumn("priority", F.round(F.col("size") * (1 - F.col("mean_confidence") * (1 - F.col("refusal_rate"))), 4))


def cluster_stats(questions: DataFrame, label: str = "topic_label", text: str = "redacted_text", at: str = "asked_at", samples: int = 3) -> DataFrame:
    """week_start, label, size, mean_confidence, refusal_rate, sample_questions (the first ``samples`` distinct texts)
    of each week's clusters; texts are counted before they are ranked, so a text asked very often is one row."""
    own = questions.select(F.date_trunc("week", at).cast("date").alias("week_start"), F.coalesce(label, F.lit("unknown")).alias("label"), F.col(text).alias("t"), F.col("retrieval_confidence").cast("double").alias("c"), F.col("was_refused").cast("double").alias("r"))
    stats = own.groupBy("week_start", "label").agg(F.count("*").alias("size"), F.round(F.coalesce(F.avg("c"), F.lit(0.0)), 6).alias("mean_confidence"), F.round(F.avg("r"), 6).alias("refusal_rate"))
    w = Window.partitionBy("week_start", "label").orderBy("t")
    first = own.where("t is not null").select("week_start", "label", "t").distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= samples)
    first = first.groupBy("week_start", "label").agg(F.array_sort(F.collect_list("t")).alias("sample_questions"))
    return stats.join(first, ["week_start", "label"], "left")


def k_anonymous(questions: DataFrame, k: int = 5, topic: str = "topic_label", at: str = "asked_at", unit: str | None = None, coarse: dict[str, str] | None = None) -> DataFrame:
    """week_start, topic, size (and n_units) of groups of at least ``k`` questions (or distinct units), sensitive topics
    first made coarse; smaller groups aren't shown at all."""
    label = F.coalesce(F.col(topic), F.lit("unknown"))
    for fine, wide in (coarse or {}).items():
        label = F.when(F.col(topic) == fine, wide).otherwise(label)
    counted = [F.count("*").alias("size")] + ([F.count_distinct(unit).alias("n_units")] if unit else [])
    out = questions.groupBy(F.date_trunc("week", at).cast("date").alias("week_start"), label.alias("topic")).agg(*counted)
    return out.where(F.col("n_units" if unit else "size") >= k)


def conflicts(facts: DataFrame, key: list[str], value: str, source: str) -> DataFrame:
    """key, n_values, n_sources, values of facts that have two values or more in different sources.

    Values are counted before their list is built, so a fact stated by a third of all sources is one row a value."""
    stated = facts.where(F.col(value).isNotNull())
    values = stated.groupBy(*key, value).agg(F.count("*").alias("_n")).groupBy(*key).agg(F.count("*").alias("n_values"), F.array_sort(F.collect_list(value)).alias("values"))
    sources = stated.groupBy(*key, source).agg(F.count("*").alias("_n")).groupBy(*key).agg(F.count("*").alias("n_sources"))
    return values.where("n_values > 1").join(sources.where("n_sources > 1"), key).select(*key, "n_values", "n_sources", "values")


def fact_candidates(df: DataFrame, document: str, text: str) -> DataFrame:
    """document, kind, value, n of each dated, priced or otherwise checkable statement."""
    found = None
    for kind, pattern in FACTS:
        part = df.select(F.col(document).alias("document_id"), F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("value"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("document_id", "kind", "value").agg(F.count("*").alias("n"))


def citations(answer: Column) -> Column:
    """The numbers n of an answer's [n] marks."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.cast("int"))


def citation_validity(answers: DataFrame, answer: str = "answer", n_chunks: str = "n_chunks") -> DataFrame:
    """``answers`` with cited, all_resolve (every mark names a given chunk) and uncited (sentences without a mark)."""
    sentences = F.filter(F.split(F.col(answer), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    return answers.withColumn("cited", F.array_distinct(citations(F.col(answer)))).withColumn(
        "all_resolve", (F.size("cited") > 0) & F.forall("cited", lambda n: (n >= 1) & (n <= F.col(n_chunks)))
    ).withColumn("uncited", F.size(F.filter(sentences, lambda s: ~s.rlike(r"\[\d+\]"))))


def support_areas(question: Column) -> Column:
    """Areas of support a question touches; they add resources and never suppress an answer."""
    named = F.array(*[F.when(F.coalesce(question.rlike(p), F.lit(False)), area) for area, p in SUPPORT_WORDS])
    return F.filter(named, lambda x: x.isNotNull())


def evaluation(results: DataFrame) -> DataFrame:
    """One row of metrics of (correct, should_refuse, was_refused, citations_valid, latency_s) rows."""
    rate = lambda c, among: F.round(F.avg(F.when(among, c.cast("double"))), 6)
    answerable, every = ~F.col("should_refuse"), F.lit(True)
    return results.agg(
        F.count("*").alias("n"), rate(F.col("correct"), answerable).alias("accuracy"), rate(F.col("citations_valid"), ~F.col("was_refused")).alias("citation_validity"),
        rate(~F.col("correct") & ~F.col("was_refused"), every).alias("wrong_answer_rate"), rate(F.col("was_refused"), F.col("should_refuse")).alias("correct_refusal"),
        rate(F.col("was_refused"), answerable).alias("false_refusal"), F.round(F.percentile("latency_s", 0.95), 6).alias("p95_latency_s"),
    )


GOLD = "id string, family string, question string, expected string, source_url string, must_cite array<string>"


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """The gold set: one question a line of JSON."""
    return spark.read.schema(GOLD).json(path).where("id is not null")


def judged(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """One row a question of ``gold`` for ``evaluation``, from ``answers`` (id, answer, refused, cited: urls, latency_s, and
    correct where somebody has judged it).

    Families: 'refusal' should be refused, the others not. An answer is correct if its judge says so, else if it holds
    the expected text, whatever the case; its citations are valid if there are some and all urls of must_cite are
    among them. A question without an answer row counts as wrong and not refused.
    """
    correct = F.contains(F.lower("answer"), F.lower("expected"))
    if "correct" in answers.columns:
        correct = F.coalesce(F.col("correct"), correct)
    both = gold.dropDuplicates(["id"]).join(answers.dropDuplicates(["id"]), "id", "left")
    cited = F.coalesce("cited", F.array().cast("array<string>"))
    return both.select(
        "id", "family", F.coalesce(correct, F.lit(False)).alias("correct"), F.coalesce(F.col("family") == "refusal", F.lit(False)).alias("should_refuse"), F.coalesce("refused", F.lit(False)).alias("was_refused"),
        ((F.size(cited) > 0) & (F.size(F.array_except(F.coalesce("must_cite", F.array().cast("array<string>")), cited)) == 0)).alias("citations_valid"), F.col("latency_s").cast("double").alias("latency_s"),
    )


def rate_limit_windows(events: DataFrame, user: str = "user_id", at: str = "ts", minutes: int = 10, most: int = 20) -> DataFrame:
    """user, window_start, n_requests of the windows in which a user asked more than ``most`` times."""
    w = events.groupBy(F.col(user).alias("user_id"), F.window(F.col(at).cast("timestamp"), f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n_requests"))
    return w.where(F.col("n_requests") > most).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n_requests")


def question_clusters(vectors: DataFrame, key: str, vector: str, counts: tuple[int, ...] = (2, 4, 6, 8, 10), seed: int = 1) -> DataFrame:
    """key, cluster by k-means, the number of clusters chosen by silhouette."""
    own = cut(vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("_key"), array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features")))
    best = None
    for k in counts:
        fitted = KMeans(k=k, seed=seed).fit(own).transform(own)
        score = ClusteringEvaluator().evaluate(fitted)
        if best is None or score > best[0]:
            best = (score, fitted)
    return best[1].select(F.col("_key").alias(key), F.col("prediction").alias("cluster"))


def ranked_clusters(trends: DataFrame, top: int) -> DataFrame:
    """The ``top`` topics of each week by priority (a report's limit)."""
    w = Window.partitionBy("week_start").orderBy(F.desc("priority"), "topic")
    return trends.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
