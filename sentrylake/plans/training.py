"""Queries of mail sources, sinks, text classifiers and the anomaly model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dialect import translate
from ..operators import decisions, forest
from ..session import shared_folder, written
from ..sources import events, mails

# Parameters of the trained classifiers.
VOCABULARY, LEAST_DOCS, MOST_SHARE, TEST_SHARE, LEAST_WORDS = 8000, 3, 0.9, 0.15, 20
#: English words that carry no content; a parameter of the features.
STOP_WORDS = tuple("""about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have
having he her here hers him his how if in into is it its itself just me more most my no nor not now of off on once only or other our ours out over own same she should so some such than that the their them then
there these they this those through to too under until up us very was we were what when where which while who whom why will with would you your yours""".split())


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, label (1: spam) of the labelled documents."""
    y = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max((F.col("quality") == 0).cast("int") + F.col("toxic")).alias("bad"))
    return _table(spark, sf_dir, "documents").filter("text is not null").join(y, "doc_id").select("doc_id", "text", (F.col("bad") > 0).cast("double").alias("label"))


def features(size: int = VOCABULARY, least_docs: float = LEAST_DOCS, most_share: float = MOST_SHARE) -> list:
    """Stages from ``text`` to ``features``: words of two letters or more without stop words, and their pairs; tf-idf of unit length."""
    return [
        RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False), StopWordsRemover(inputCol="tokens", outputCol="words"), NGram(n=2, inputCol="words", outputCol="pairs"),
        CountVectorizer(inputCol="words", outputCol="tf1", vocabSize=size, minDF=least_docs, maxDF=most_share), IDF(inputCol="tf1", outputCol="idf1"),
        CountVectorizer(inputCol="pairs", outputCol="tf2", vocabSize=size, minDF=least_docs, maxDF=most_share), IDF(inputCol="tf2", outputCol="idf2"),
        VectorAssembler(inputCols=["idf1", "idf2"], outputCol="weights"), Normalizer(inputCol="weights", outputCol="features"),
    ]


def counts(size: int = VOCABULARY) -> list:
    """Stages from ``text`` to ``features`` that naive Bayes and small samples take: tf-idf of single words."""
    return [
        RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False), StopWordsRemover(inputCol="tokens", outputCol="words"),
        CountVectorizer(inputCol="words", outputCol="tf", vocabSize=size), IDF(inputCol="tf", outputCol="weights"), Normalizer(inputCol="weights", outputCol="features"),
    ]


def split(rows: DataFrame, share: float = TEST_SHARE) -> DataFrame:
    """rows with ``test``: by hash, so that a label's share holds nearly and no task gets all of it."""
    return rows.withColumn("test", F.pmod(F.xxhash64("doc_id"), F.lit(10_000)) < int(share * 10_000))


def classifiers(n: int, trees: int = 100, depth: int = 20) -> dict:
    return {"logistic": LogisticRegression(regParam=1.0 / max(1, n), maxIter=200), "bayes": NaiveBayes(smoothing=0.1), "forest": RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=42)}


def train_classifiers(spark: SparkSession, sf_dir: str, trees: int = 20, depth: int = 8) -> DataFrame:
    """model, label, prediction, n: what each classifier says of the test rows. The forest is smaller here than by default."""
    rows = split(labelled(spark, sf_dir))
    fitted = Pipeline(stages=features()).fit(rows.filter("not test"))
    folder = shared_folder(spark, "text-features")
    fitted.transform(rows).select("doc_id", "label", "test", "features").write.parquet(folder)
    ready = spark.read.parquet(folder)
    known, out = ready.filter("not test"), None
    for name, c in classifiers(known.count(), trees, depth).items():
        got = c.fit(known).transform(ready.filter("test")).groupBy(F.lit(name).alias("model"), "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
        out = got if out is None else out.unionByName(got)
    return out


def select_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of the best accuracy, the first by name of equal ones, and the accuracy."""
    right = train_classifiers(spark, sf_dir).groupBy("model").agg((F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return right.orderBy(F.desc("accuracy"), "model").limit(1)


def report(predictions: DataFrame) -> DataFrame:
    """Of label, prediction and n: precision, recall, f1 and support of each class."""
    both = predictions.withColumn("hit", F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    of = both.groupBy(F.col("label").alias("class")).agg(F.sum("hit").alias("hit"), F.sum("n").alias("support"))
    as_ = both.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("said"))
    return of.join(as_, "class", "left").select(
        "class", "support", (F.col("hit") / F.greatest(F.lit(1), F.coalesce("said", F.lit(0)))).alias("precision"), (F.col("hit") / F.col("support")).alias("recall"), (2 * F.col("hit") / (F.coalesce("said", F.lit(0)) + F.col("support"))).alias("f1"))


def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a fixed table of predictions: low quality as a sign of toxic text."""
    y = _table(spark, sf_dir, "labels").filter("toxic is not null and quality is not null")
    return report(y.groupBy(F.col("toxic").cast("int").alias("label"), (F.col("quality") <= 1).cast("int").alias("prediction")).agg(F.count(F.lit(1)).alias("n")))


def blended_phishing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, 0.7 of the trained classifier and 0.3 of the keywords."""
    from .queries import PHISHING

    rows = labelled(spark, sf_dir)
    model = Pipeline(stages=[*counts(), LogisticRegression(regParam=0.01, maxIter=50)]).fit(split(rows).filter("not test"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hits = sum((F.lower("text").contains(w).cast("int") for w in PHISHING["trained"]), F.lit(0))
    return model.transform(docs).select("doc_id", (0.7 * vector_to_array("probability")[1] + 0.3 * F.least(F.lit(1.0), hits / 3.0)).alias("phishing"))


def model_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted model and its baselines are saved, loaded and used: doc_id, prediction, and the four baselines."""
    rows = labelled(spark, sf_dir)
    folder = shared_folder(spark, "text-model")
    Pipeline(stages=[*counts(), NaiveBayes(smoothing=0.1)]).fit(split(rows).filter("not test")).write().overwrite().save(f"{folder}/model")
    words = F.size(F.expr(r"regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+', 0)"))
    rows.agg(F.count(F.lit(1)).alias("mails"), F.avg(words).alias("avg_words"), F.avg(F.length("text")).alias("avg_length"), F.avg("label").alias("spam_share")).write.parquet(f"{folder}/baselines")
    loaded = PipelineModel.load(f"{folder}/model").transform(rows).select("doc_id", "prediction")
    return loaded.crossJoin(F.broadcast(spark.read.parquet(f"{folder}/baselines")))  # one row


def _listed(docs: DataFrame, stop: tuple) -> DataFrame:
    """doc_id, terms: words of two letters or more that aren't stop words, and pairs of those that follow each other."""
    words = F.filter(F.expr(r"regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}', 0)"), lambda w: ~w.isin(*stop))
    # a row for each array, so that it is made once and not for each of its elements
    return docs.select("doc_id", F.explode(F.array(words)).alias("w")).select("doc_id", F.expr("concat(w, transform(filter(sequence(1, size(w)), i -> i < size(w)), i -> concat(w[i - 1], ' ', w[i])))").alias("terms"))


def _terms(docs: DataFrame, stop: tuple, most: int) -> DataFrame:
    """Counts are added up by term alone, before rows are shuffled: a document's terms are told apart within its row, and those of ids that stand there more than once apart."""
    total = docs.count()
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1 and doc_id is not null").select("doc_id", F.lit(True).alias("again"))
    # a join would shuffle the terms: only where there is something to join
    listed = _listed(docs, stop).withColumn("again", F.lit(None).cast("boolean")) if again.isEmpty() else _listed(docs, stop).join(again, "doc_id", "left")
    once = F.expr("case when again is null and doc_id is not null then array_distinct(terms) else array() end")
    flags = F.concat(F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("df"))), F.transform(once, lambda t: F.struct(t.alias("term"), F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("df"))))
    single = listed.select(F.explode(flags).alias("x")).select("x.*")
    several = listed.filter("again").select("doc_id", F.explode("terms").alias("term")).distinct().select("term", F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("df"))
    df = single.unionByName(several).groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).filter((F.col("df") >= LEAST_DOCS) & (F.col("df") <= MOST_SHARE * total))
    return df.orderBy(F.desc("n"), "term").limit(most).withColumn("idf", F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0)


def tfidf_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term, documents that hold it, its count and smoothed inverse document frequency: the most frequent VOCABULARY of those in LEAST_DOCS documents and MOST_SHARE at most."""
    return _terms(_table(spark, sf_dir, "documents").filter("text is not null"), STOP_WORDS, VOCABULARY)


def tfidf_vectors(docs: DataFrame, stop: tuple = STOP_WORDS, most: int = VOCABULARY) -> DataFrame:
    """doc_id, terms (array of index and weight by index): sparse vectors of length 1. A term's index is its rank by frequency, then by the term; documents without one have an empty array."""
    vocabulary = written(_terms(docs, stop, most), "vocabulary")  # most rows at most, so that one task numbers them
    place = F.row_number().over(Window.orderBy(F.desc("n"), "term")) - 1
    numbered = vocabulary.select("term", "idf", place.alias("place"))
    # terms out of the vocabulary are left out before anything is shuffled
    known = _listed(docs, stop).select("doc_id", F.explode("terms").alias("term")).join(F.broadcast(numbered), "term")
    per = known.groupBy("doc_id", "place").agg(F.count(F.lit(1)).alias("n"), F.first("idf").alias("idf")).select("doc_id", "place", (F.col("n") * F.col("idf")).alias("weight"))
    found = per.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "weight"))).alias("terms"))
    norm = F.sqrt(F.aggregate("terms", F.lit(0.0), lambda a, x: a + x["weight"] * x["weight"]))
    unit = found.withColumn("norm", norm).select("doc_id", F.expr("transform(terms, x -> struct(x.place as place, x.weight / norm as weight))").alias("terms"))
    return docs.select("doc_id").join(unit, "doc_id", "left").withColumn("terms", F.coalesce("terms", F.expr("cast(array() as array<struct<place:int,weight:double>>)")))


def tfidf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's vector: number of its terms, their indices, and weights in millionths, as texts."""
    docs = _table(spark, sf_dir, "documents").filter("text is not null")
    joined = lambda x: F.concat_ws(" ", F.transform("terms", x))
    return tfidf_vectors(docs).select("doc_id", F.size("terms").cast("long").alias("n_terms"), joined(lambda x: x["place"].cast("string")).alias("places"), joined(lambda x: F.round(x["weight"] * 1e6).cast("long").cast("string")).alias("weights"))


#: Relative error that the sketches of a vocabulary stay under, and the logarithm of their size.
SKETCH_ERROR, SKETCH_BITS = 0.03, 17


def sketches(words: DataFrame, by: str) -> DataFrame:
    """A mergeable sketch of the distinct ``word`` of each group, of a fixed size."""
    return words.groupBy(by).agg(F.hll_sketch_agg("word", F.lit(SKETCH_BITS)).alias("sketch"))


def vocabulary_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sender, and in total (null): distinct words, whether the sketch is near that number, and whether sketches of halves merge to the whole's."""
    from . import queries

    session = queries._Session(spark, sf_dir)
    # mails go to their sender whole, in one exchange for all uses: what is grouped by sender shuffles no words
    sent = session.sql("select actor_id, concat(cast(pmod(event_id, 2) as string), content) as half_content from mails").repartition("actor_id")
    found = F.explode(F.expr(translate("@words(content@w)", "spark"))).alias("word")
    words = sent.select("actor_id", F.substring("half_content", 1, 1).alias("half"), F.expr("substring(half_content, 2)").alias("content")).select("actor_id", "half", found)
    exact = words.groupBy("actor_id").agg(F.countDistinct("word").alias("words"))
    whole = sketches(words, "actor_id")
    halves = words.groupBy("actor_id", "half").agg(F.hll_sketch_agg("word", F.lit(SKETCH_BITS)).alias("sketch")).groupBy("actor_id").agg(F.hll_union_agg("sketch").alias("merged"))
    senders = exact.join(whole, "actor_id").join(halves, "actor_id")
    # the total is the union of the senders' sketches: no word is read again
    total = session.sql("select content from texts").select(found).agg(F.countDistinct("word").alias("words")).crossJoin(whole.agg(F.hll_union_agg("sketch").alias("sketch")))  # one row each
    total = total.select(F.lit(None).cast("long").alias("actor_id"), "words", "sketch", F.col("sketch").alias("merged"))
    near = F.abs(F.hll_sketch_estimate("sketch") - F.col("words")) <= SKETCH_ERROR * F.col("words") + 1
    both = senders.select("actor_id", "words", "sketch", "merged").unionByName(total)
    return both.select("actor_id", "words", near.alias("near"), (F.hll_sketch_estimate("merged") == F.hll_sketch_estimate("sketch")).alias("merges"))


def raw_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole mails made from the documents: mail_id, message."""
    d = _table(spark, sf_dir, "documents").filter("text is not null")
    head = F.concat(F.lit("From: Desk <desk"), F.col("doc_id") % 7, F.lit("@org>\nTo: pool@org,\n other@outside\nSubject: note "), F.col("doc_id").cast("string"), F.lit("\n\n"))
    return d.select(F.col("doc_id").alias("mail_id"), F.concat(head, "text").alias("message"))


def parse_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and body of the made mails; the body as a digest."""
    got = mails.parse(raw_mails(spark, sf_dir))
    return got.select("mail_id", "sender", F.regexp_replace("recipients", r"\s+", " ").alias("recipients"), "subject", F.md5(F.encode("body", "UTF-8")).alias("body"), "failed")


def scan_mail_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The made mails written as CSV and read back: message digests. A made mail is never empty: an empty one is null, as of a document without an id."""
    folder = shared_folder(spark, "mail-corpus")
    raw_mails(spark, sf_dir).select("message").write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    return mails.read_corpus(spark, folder).select(F.md5(F.encode(F.nullif("message", F.lit("")), "UTF-8")).alias("message"))


def scan_labeled_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents written as CSV and read back; those of LEAST_WORDS words or more, by label."""
    folder = shared_folder(spark, "labelled-mail")
    rows = labelled(spark, sf_dir).select(F.concat(F.lit("note "), F.col("doc_id").cast("string")).alias("Subject"), F.col("text").alias("Message"), F.when(F.col("label") > 0, " Spam").otherwise("ham ").alias("Spam/Ham"))
    rows.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    got = mails.read_labeled(spark, folder)
    words = F.size(F.split(F.trim(F.concat_ws(" ", "subject", "message")), "[ \n\r\t]+"))
    return got.filter(words >= LEAST_WORDS).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def sink_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as JSON lines and read back with the fixed schema."""
    from .queries import _run

    rows = _run(spark, sf_dir, "scan_event_log")
    folder = shared_folder(spark, "event-log")
    events.write_event_log(rows, folder)
    return events.read_event_log(spark, folder).select("step", "event_type", "actor_id", "resource", "action", "dst", "bytes", "label", "phase")


def sink_sweep_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of the sweep written as CSV with a header and read back."""
    from .queries import _run

    rows = _run(spark, sf_dir, "sweep_summary")
    folder = shared_folder(spark, "sweep")
    mails.write_csv(rows, folder)
    return spark.read.schema(rows.schema).option("header", True).csv(folder)


#: What the anomaly model looks at.
VECTOR = ["logins", "queries", "sensitive", "exports", "outside", "after_hours_n", "sensitive_share", "export_share", "outside_share", "after_hours_share", "bytes_total", "bytes_max", "bytes_mean", "moves_over_100k", "mails_over_500",
          "outside_unapproved", "sequence", "density", "resources", "dsts", "exports_without_ticket", "device_changes"]


def _models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors by role, the samples of every version with theirs, and the forests."""
    from .queries import _run

    roles = _run(spark, sf_dir, "upsert_user_profile").select("actor_id", "role")
    vectors = written(_run(spark, sf_dir, "feature_vector").join(roles, "actor_id"), "vectors")
    chosen = written(_run(spark, sf_dir, "anomaly_samples").join(vectors.drop("role"), ["actor_id", "step"]), "samples")
    return vectors, chosen, written(forest.fit(chosen, VECTOR), "forest")


def isolation_forest_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """role, version (the step that it was fitted at), tree, number of its nodes."""
    return _models(spark, sf_dir)[2].select("role", "version", "tree", F.size("feature").alias("nodes"))


def isolation_forest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window's score by its role's latest model, by version."""
    vectors, chosen, trees = _models(spark, sf_dir)
    return forest.score(vectors, VECTOR, trees, chosen).select("actor_id", "step", "role", "version", "raw", "anomaly")


def _nudged(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Scored anchors with ``ml``: their window's anomaly, unless it holds a partner cycle."""
    rated = isolation_forest_score(spark, sf_dir).select("actor_id", "step", "anomaly")
    return rows.join(rated, ["actor_id", "step"], "left").withColumn("ml", F.when(F.col("cycles") > 0, 0.0).otherwise(F.coalesce("anomaly", F.lit(0.0)))).drop("anomaly")


def ml_nudge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of the first variant with the anomaly model: borderline scores of windows without a partner cycle rise."""
    from .queries import _run

    decided = decisions.decide(_nudged(spark, sf_dir, _run(spark, sf_dir, "scored_anchors")))
    return decided.select("event_id", "actor_id", "step", "value", "early_score", "confirmed_score", "early", "confirmed")


def alerts_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the first variant as it is configured by default: policy, baseline, trust, learning weights and anomaly model."""
    from .queries import _run

    decided, _ = decisions.learn(_nudged(spark, sf_dir, _run(spark, sf_dir, "_online_rows")))
    return decisions.fired(decided).select("event_id", "actor_id", "step", "tier", "label", "phase", "score", "threshold", "trust", "verdict")


def sweep_summary_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of all six configurations of the sweep, with the one that has the anomaly model."""
    from . import queries

    session = queries._Session(spark, sf_dir)
    rows = session.sql("select * from sweep_rows")
    full = _nudged(spark, sf_dir, rows.filter("config = 'full_no_ml'")).withColumn("config", F.lit("full"))
    session._decide("sweep", queries.sweep(rows.withColumn("ml", F.lit(0.0)).unionByName(full)), decisions.CONFIGS["lsc"])
    return session.sql(queries.QUERIES["sweep_summary"].replace("points as (select distinct config, confirmed_at from (", "points as (select distinct config, confirmed_at from (select 'full' as config, cast(x as double) as confirmed_at from (select explode(sequence(3, 7)) as x) f union all select config, confirmed_at from (", 1).replace(") x),\n    found as", ") y) x),\n    found as", 1))


QUERIES = {f.__name__: f for f in (train_classifiers, select_classifier, classification_report, blended_phishing, model_artifact, tfidf_features, tfidf_documents, vocabulary_sketches, parse_mail, scan_mail_corpus, scan_labeled_mail, sink_event_log,
                                   sink_sweep_csv, isolation_forest_fit, isolation_forest_score, ml_nudge, alerts_default, sweep_summary_full)}

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE_SQL = {
    "classification_report": """with y as (select toxic, cast(quality <= 1 as int) as said from labels where toxic is not null and quality is not null), c as (select distinct toxic as class from y)
        select class, (select count(*) from y where toxic = class) as support, (select count(*) from y where toxic = class and said = class) / greatest(1, (select count(*) from y where said = class)) as precision,
            (select count(*) from y where toxic = class and said = class) / (select count(*) from y where toxic = class) as recall,
            2 * (select count(*) from y where toxic = class and said = class) / ((select count(*) from y where said = class) + (select count(*) from y where toxic = class)) as f1 from c""",
    "tfidf_features": f"""with d as (select doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x not in ({_STOP})) as w from documents where text is not null),
        t as (select doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from d),
        f as (select term, count(distinct doc_id) as df, count(*) as n from t group by term), c as (select count(*) as total from d)
        select term, df, n, ln((1.0 + total) / (1.0 + df)) + 1.0 as idf from f, c where df >= {LEAST_DOCS} and df <= {MOST_SHARE} * total order by n desc, term limit {VOCABULARY}""",
    "tfidf_documents": f"""with d as (select doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x not in ({_STOP})) as w from documents where text is not null),
        t as (select doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from d),
        f as (select term, count(distinct doc_id) as df, count(*) as n from t group by term), c as (select count(*) as total from d),
        v as (select term, row_number() over (order by n desc, term) - 1 as place, ln((1.0 + total) / (1.0 + df)) + 1.0 as idf from f, c where df >= {LEAST_DOCS} and df <= {MOST_SHARE} * total order by n desc, term limit {VOCABULARY}),
        x as (select doc_id, place, count(*) * any_value(idf) as weight from t join v on t.term = v.term group by doc_id, place),
        u as (select *, weight / sqrt(sum(weight * weight) over (partition by doc_id)) as unit from x)
        select d.doc_id, count(place) as n_terms, coalesce(string_agg(place::varchar, ' ' order by place), '') as places, coalesce(string_agg(cast(round(unit * 1e6) as bigint)::varchar, ' ' order by place), '') as weights from d left join u on u.doc_id = d.doc_id group by d.doc_id""",
    "parse_mail": "select doc_id as mail_id, 'Desk <desk' || (doc_id % 7) || '@org>' as sender, 'pool@org, other@outside' as recipients, 'note ' || doc_id as subject, md5(text) as body, false as failed from documents where text is not null",
    "scan_mail_corpus": "select md5('From: Desk <desk' || (doc_id % 7) || '@org>' || chr(10) || 'To: pool@org,' || chr(10) || ' other@outside' || chr(10) || 'Subject: note ' || doc_id || chr(10) || chr(10) || text) as message from documents where text is not null",
    "scan_labeled_mail": f"""select label, count(*) as n from (select case when max(cast(quality = 0 as int) + toxic) > 0 then 'spam' else 'ham' end as label, 'note ' || d.doc_id || ' ' || any_value(d.text) as t
        from labels l join documents d on l.doc_id = d.doc_id where d.text is not null group by d.doc_id) x where len(regexp_split_to_array(trim(t), '[ \\n\\r\\t]+')) >= {LEAST_WORDS} group by label""",
}
