"""Registered queries: one callable ``(spark, folder) -> DataFrame`` each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohorta.functions import text as T
from kohorta.functions.vectors import cosine, softmax
from kohorta.operators import classify as C
from kohorta.operators import cohort as H
from kohorta.operators import embedding as E
from kohorta.operators import minibatch as M
from kohorta.operators import posts as P
from kohorta.operators import scoring as S
from kohorta.operators import survival as V
from kohorta.operators import timeline as L
from kohorta.operators import translate
from kohorta.plans import inputs as I
from kohorta.session import cut_lineage, scratch_path, tune
from kohorta.sources import paged, settings, tables
from kohorta.streaming import first_copies, rejects
from kohorta.streaming import ingest as G


def _cohort(spark, folder, **options):
    return H.build_cohort(
        I.scored_timeline(spark, folder), I.EXPOSURE, I.OUTCOME, I.THRESHOLDS,
        min_posts=I.MIN_POSTS, **options,
    )


def _intervals(spark, folder):
    return H.to_intervals(_cohort(spark, folder))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def build_cohort(spark, folder):
    return _cohort(spark, folder)


def build_cohort_user_scope(spark, folder):
    """Every other post comes again, on a later day and with the highest scores."""
    scores = I.scored_timeline(spark, folder)
    later = F.date_add("normalised_date", 1).alias("normalised_date")
    top = [F.lit(1.0).alias(c) for c in (I.EXPOSURE, I.OUTCOME)]
    copies = scores.filter("id % 2 = 0").select("user_id", "id", "created_ts", later, *top, I.ENTRY)
    return H.build_cohort(
        scores.unionByName(copies), I.EXPOSURE, I.OUTCOME, I.THRESHOLDS,
        min_posts=I.MIN_POSTS, outcome_scope="user", deduplicate=True,
    )


def cox_intervals(spark, folder):
    return _intervals(spark, folder)


def risk_table(spark, folder):
    return V.risk_table(_intervals(spark, folder))


def cox_fit(spark, folder):
    fit = V.cox_fit(_intervals(spark, folder), ["exposition"])
    return _rounded(
        fit.statistics(spark), "log_likelihood", "partial_aic", "likelihood_ratio", "likelihood_ratio_p"
    )


def cox_summary(spark, folder):
    summary = V.cox_summary(_intervals(spark, folder), covariates=["exposition"])
    return _rounded(summary, *[c for c in summary.columns if c != "covariate"])


def cox_two_covariates(spark, folder):
    """Adds the period number as a second, many-valued covariate."""
    summary = V.cox_summary(_intervals(spark, folder), covariates=["exposition", "quarter"])
    return _rounded(summary, *[c for c in summary.columns if c != "covariate"])


def assign_periods(spark, folder):
    timeline = I.scored_timeline(spark, folder).select("user_id", "id", "normalised_date")
    return L.assign_periods(timeline).withColumn(
        "quarter_name", F.concat(F.lit("Q"), F.col("quarter").cast("string"))
    )


def define_t0(spark, folder):
    hit = L.entry_hit(I.THRESHOLDS[I.ENTRY], I.ENTRY_KEYWORDS, I.ENTRY, "text")
    # Every seventh post has lost its time.
    timed = F.when(F.col("id") % 7 != 0, F.col("created_ts")).alias("created_ts")
    posts = I.posts(spark, folder).select(
        "user_id", "id", timed, "normalised_date", hit.alias("hit")
    )
    kept = L.define_t0(cut_lineage(posts, "entry"), F.col("hit"))
    return kept.select("user_id", "id", "normalised_date")


def truncate_at_outcome(spark, folder):
    timeline = I.scored_timeline(spark, folder).select("user_id", "id", "normalised_date", I.OUTCOME)
    return L.truncate_at_outcome(timeline, F.col(I.OUTCOME) >= I.THRESHOLDS[I.OUTCOME])


def min_timeline(spark, folder):
    posts = I.table(spark, folder, "events").select("user_id", F.col("event_id").alias("id"))
    return L.min_timeline(posts, I.MIN_POSTS)


def timeline_span(spark, folder):
    return L.timeline_span(I.scored_timeline(spark, folder))


def timeline_positions(spark, folder):
    timeline = I.scored_timeline(spark, folder).select(
        "user_id", "id", "created_ts", "normalised_date"
    )
    return L.timeline_positions(timeline).select("user_id", "id", "position")


def score_concepts(spark, folder):
    return S.score_concepts(I.vectors(spark, folder), I.concepts(spark, folder))


def pivot_scores(spark, folder):
    concepts = I.concepts(spark, folder)
    names = [r[0] for r in concepts.select("concept").orderBy("concept").collect()]
    return S.pivot_scores(S.score_concepts(I.vectors(spark, folder), concepts), names, ["id"])


def _encoders():
    return {
        "dense": lambda v: v,
        "sign": lambda v: F.transform(v, lambda x: F.signum(x).cast("float")),
    }


def compare_encoders(spark, folder):
    return S.compare_encoders(I.vectors(spark, folder), I.concepts(spark, folder), _encoders())


def encoder_summary(spark, folder):
    return _rounded(S.encoder_summary(compare_encoders(spark, folder)), "median_similarity")


def top_k_per_concept(spark, folder):
    return S.top_k_per_concept(score_concepts(spark, folder), 50)


def screen_thresholds(spark, folder):
    texts = I.decorated(spark, folder).select("id", "text")
    return S.screen_thresholds(score_concepts(spark, folder), texts, 50)


def apply_thresholds(spark, folder):
    return S.apply_thresholds(score_concepts(spark, folder), I.thresholds(spark, folder))


def neighbour_cosine(spark, folder):
    """Cosine of each vector with the next one, both being columns."""
    a = I.vectors(spark, folder)
    b = a.select((F.col("id") - 1).alias("id"), F.col("vector").alias("next"))
    return a.join(b, "id").select("id", F.round(cosine("vector", "next"), 6).alias("similarity"))


def latest_per_user(spark, folder):
    posts = I.table(spark, folder, "events").select(
        "user_id", F.col("event_id").alias("id"), "event_type", "value"
    )
    return L.latest_per_user(posts, 20)


def latest_per_user_paged(spark, folder):
    """The same posts, fetched page by page from a store that answers like a service."""
    posts = I.table(spark, folder, "events").select(
        "user_id", F.col("event_id").alias("id"), "event_type", "value"
    )
    path = scratch_path(spark, "service")
    paged.store_pages(posts, path, 16)
    schema = "user_id bigint, id bigint, event_type string, value double"
    return paged.read_timelines(spark, schema, 20, 8, path=path)


def build_timelines(spark, folder):
    posts, texts = I.posts_and_texts(spark, folder)
    users = P.keep_existing(P.distinct_users(posts), _directory(spark, folder))
    return L.build_timelines(posts, users, 20, texts).select("user_id", "id", F.length("text").alias("n"))


def _directory(spark, folder):
    known = I.table(spark, folder, "customer").filter("c_acctbal > 3000")
    return known.select(F.col("c_custkey").alias("user_id"))


def keep_existing(spark, folder):
    users = P.distinct_users(I.table(spark, folder, "events"))
    return P.keep_existing(users, _directory(spark, folder))


def append_new(spark, folder):
    """The store holds the events of one type; all events arrive twice."""
    posts = I.table(spark, folder, "events").select(
        F.col("event_id").alias("id"), "user_id", "event_type", "value"
    )
    store = posts.filter("event_type = 'view'")
    return P.append_new(posts.unionByName(posts), store, [F.col("value")])


def dedup_posts(spark, folder):
    posts = I.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    again = posts.withColumn("text", F.concat(F.lit("again "), "text"))
    both = posts.withColumn("seq", F.lit(0)).unionByName(again.withColumn("seq", F.lit(1)))
    return P.dedup_posts(both, [F.col("seq")])


def clean_text(spark, folder):
    posts = I.raw_posts(spark, folder)
    kept = L.clean_text(posts.unionByName(posts))
    return kept.select("id", "prep", T.token_count(F.col("prep")).alias("n_tokens"))


def expand_contractions(spark, folder):
    return I.decorated(spark, folder).select(
        "id", T.expand_contractions(F.col("text")).alias("text")
    )


#: Arrows, tags, telephone numbers, mirrored emoticons, hashtags with hyphens and of one letter.
DRAWN = "go -> or <-- <b>now</b> (: D-8> </3 +1 (555) 123-4567, 555 1234 12345678 #covid-19's #a #1-"


def _referenced(spark, folder):
    """Posts that end with character references, an address and what posts draw with signs."""
    tail = F.lit(" &lt;3 R&amp;D &quot;x&quot; I&#39;m at me.you@b-c.org. " + DRAWN)
    return I.decorated(spark, folder).withColumn("text", F.concat("text", tail))


def tokenize_post(spark, folder):
    tokens = T.tokenize_post(F.col("text"))
    return _referenced(spark, folder).select(
        "id", F.size(tokens).alias("n_tokens"), F.array_join(tokens, "|").alias("tokens")
    )


def normalize_token(spark, folder):
    """The tokens of each post, normalised one by one."""
    names = T._map_literal(T.emoji_names())
    tokens = F.transform(T.tokenize_post(F.col("text")), lambda t: T.normalize_token(t, names))
    return _referenced(spark, folder).select("id", F.array_join(tokens, " ").alias("tokens"))


def normalize_post(spark, folder):
    return _referenced(spark, folder).select("id", T.normalize_post(F.col("text")).alias("text"))


def keyword_track(spark, folder):
    return P.track(I.decorated(spark, folder), ["#T1D", "Sure They"]).select("id", "lang")


def study_track(spark, folder):
    """Track and entry keywords of the shipped study."""
    texts = I.decorated(spark, folder)
    return P.track(texts, settings.load_track(spark)).select(
        "id", T.has_keyword(F.col("text"), settings.load_entry_keywords(spark)).alias("entry")
    )


def apply_translations(spark, folder):
    posts = I.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    known = posts.filter("lang in ('fr', 'de')")
    translated = known.select("id", F.concat(F.lit("[en] "), "text").alias("text_en"))
    return P.apply_translations(posts, translated)


def translate_texts(spark, folder):
    """Two runs by a stand-in for a service: the second finds the French answers stored."""
    posts = I.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    path = scratch_path(spark, "answers")

    def make_client():
        return lambda text, lang: f"[{lang}] {text}"

    translate.translate(posts.filter("lang = 'fr'"), make_client, path)
    return translate.translate(posts, make_client, path)


def filter_lang(spark, folder):
    return P.filter_lang(I.table(spark, folder, "documents")).select("doc_id", "lang", "n_chars")


def label_counts(spark, folder):
    return P.value_counts(I.table(spark, folder, "labels"), "quality")


def distinct_users(spark, folder):
    return P.distinct_users(I.table(spark, folder, "events"))


def sample_head(spark, folder):
    return P.sample_head(I.table(spark, folder, "events"), 1000, "event_id").select(
        "event_id", "user_id", "event_type", "value"
    )


def day_normalise(spark, folder):
    events = I.table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_ts")
    )
    return L.with_days(events).select("id", "normalised_date")


def split_examples(spark, folder):
    labels = I.table(spark, folder, "labels").select(F.col("doc_id").alias("id"))
    return C.split_examples(labels)


def binary_metrics(spark, folder):
    metrics = C.binary_metrics(I.labelled(spark, folder))
    return _rounded(metrics, "accuracy", "precision", "recall", "f1")


def _half_sum(start):
    """Sum of 32 values of a vector; two of them stand for a network's raw outputs."""
    values = F.transform(F.slice("vector", start, 32), lambda x: x.cast("double"))
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def softmax_class(spark, folder):
    logits = F.array(_half_sum(1), _half_sum(33))
    classes = C.classify_logits(I.vectors(spark, folder).select("id", logits.alias("logits")))
    return _rounded(classes.select("id", "p0", "p1", "personal"), "p0", "p1")


def select_authors(spark, folder):
    """Labels stand for predictions, events for the posts they belong to.

    An author stays out if none of their posts is in class 1.
    """
    labels = I.table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("personal"))
    size = I.table(spark, folder, "documents").agg(F.count("*")).scalar()
    posts = I.table(spark, folder, "events").select(
        (F.col("event_id") % size).alias("doc_id"), F.struct(F.col("user_id").alias("id")).alias("user")
    )
    return C.select_authors(posts.join(labels, "doc_id"))


def train_and_classify(spark, folder):
    """Train, save, load, then classify every document."""
    examples = C.split_examples(I.labelled(spark, folder))
    path = scratch_path(spark, "classifier")
    C.save_classifier(C.train_classifier(examples.filter("part = 'train'")), path)
    documents = I.documents(spark, folder).select(F.col("doc_id").alias("id"), "text")
    return C.classify(documents, C.load_classifier(path)).select("id", "p0", "p1", "personal")


def evaluate_classifier(spark, folder):
    examples = C.split_examples(I.labelled(spark, folder))
    model = C.train_classifier(examples.filter("part = 'train'"))
    return C.evaluate(model, examples.filter("part = 'test'").drop("predicted"))


def _stored_classifier(spark, folder):
    """All examples, the classifier as trained, and the same one saved and loaded."""
    examples = C.split_examples(I.labelled(spark, folder).drop("predicted"))
    fitted = C.train_classifier(examples.filter("part = 'train'"))
    path = scratch_path(spark, "classifier")
    C.save_classifier(fitted, path)
    return examples, fitted, C.load_classifier(path)


def classifier_gradient(spark, folder):
    """Largest gradient of the training loss at the stored weights, by 1,024 features; bias last."""
    examples, _, loaded = _stored_classifier(spark, folder)
    train = examples.filter("part = 'train'")
    size = np.abs(C.loss_gradient(loaded, train))
    parts = [*size[:-1].reshape(-1, 1024).max(axis=1), size[-1]]
    blocks = spark.createDataFrame([(i, float(x)) for i, x in enumerate(parts)], "block bigint, gradient double")
    return _rounded(blocks.withColumn("examples", F.lit(train.count()).cast("bigint")), "gradient")


def reload_classifier(spark, folder):
    """Whether the loaded classifier gives every document what the trained one gives it."""
    _, fitted, loaded = _stored_classifier(spark, folder)
    documents = I.documents(spark, folder).select(F.col("doc_id").alias("id"), "text")
    before = C.classify(documents, fitted).select("id", "text", F.struct("p0", "p1", "personal").alias("before"))
    after = C.classify(before, loaded)
    return after.select("id", (F.col("before") == F.struct("p0", "p1", "personal")).alias("same"))


def evaluate_stored(spark, folder):
    """Metrics of the test part beside those worked out from stored predictions."""
    examples, fitted, loaded = _stored_classifier(spark, folder)
    test = examples.filter("part = 'test'")
    stored = cut_lineage(C.classify(test, loaded).select("id", "label", "personal"), "predictions")
    again = stored.agg(
        F.count("*").alias("examples"), F.sum("label").alias("positives"),
        F.avg((F.col("label") == F.col("personal")).cast("int")).alias("right"),
        (2 * F.sum(F.col("label") * F.col("personal")) / F.sum(F.col("label") + F.col("personal"))).alias("both"),
    )
    found = C.evaluate(fitted, test).first()
    near = (F.abs(F.col("right") - found.accuracy) < 1e-9) & (F.abs(F.coalesce("both", F.lit(0.0)) - found.f1) < 1e-9)
    counted = F.lit(found.tp + found.fp + found.fn + found.tn).cast("bigint")
    return again.select("examples", "positives", counted.alias("counted"), near.alias("agrees"))


def _trained(spark, folder):
    """Epochs of mini-batch training, and all examples."""
    examples = C.split_examples(I.labelled(spark, folder).drop("predicted"))
    return M.train(examples.filter("part = 'train'")), examples


def epoch_losses(spark, folder):
    return _trained(spark, folder)[0].losses(spark)


def validate_epochs(spark, folder):
    """Metrics of each epoch on the validation part, and the one to keep."""
    trained, examples = _trained(spark, folder)
    predicted = M.predict(examples.filter("part = 'validation'"), trained)
    return M.choose(M.candidate_metrics(predicted), patience=3)


def choose_candidate(spark, folder):
    """Nine cut-offs of a stored score, compared on the validation part."""
    vectors = I.vectors(spark, folder)
    size = vectors.agg(F.count("*")).scalar()
    p1 = softmax(F.array(_half_sum(1), _half_sum(33)))[1]
    scores = vectors.select(F.col("id").alias("vec_id"), p1.alias("p1"))
    labels = I.table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    part = C.split_examples(labels).filter("part = 'validation'").withColumn("vec_id", F.col("id") % size)
    cuts = part.join(scores, "vec_id").withColumn("candidate", F.explode(F.sequence(F.lit(1), F.lit(9))))
    predicted = cuts.withColumn("predicted", (F.col("p1") >= F.col("candidate") / 10).cast("int"))
    chosen = M.choose(M.candidate_metrics(predicted))
    return _rounded(chosen, "accuracy", "precision", "recall", "f1")


#: Weights of the two layers of ``network_classes`` and their biases; whole numbers, so sums are exact.
NETWORK = (
    [[3.0, -2.0, 1.0], [-4.0, 5.0, 2.0]], [10.0, -20.0, 5.0],
    [[1.0, -1.0], [2.0, 1.0], [-1.0, 3.0]], [7.0, -3.0],
)


def network_classes(spark, folder):
    """A network of two layers over whole texts, loaded once in each worker."""
    weights = spark.sparkContext.broadcast(NETWORK)

    def make_predict():
        import numpy as np

        first, bias, second, shift = (np.array(w, np.float32) for w in weights.value)

        def run(texts):
            counts = [[t.count("e"), t.count(" ")] for t in texts.tolist()]
            return np.maximum(np.array(counts, np.float32) @ first + bias, 0) @ second + shift

        return run

    texts = I.documents(spark, folder).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    encoded = E.embed(texts, E.network_encoder(make_predict), "text", "out")
    out = [F.col("out")[k].cast("double").alias(f"o{k}") for k in (0, 1)]
    classes = C.classify_logits(encoded.select("id", *out, F.col("out").cast("array<double>").alias("logits")))
    return classes.select("id", "o0", "o1", "personal")


def embed_tfidf(spark, folder):
    texts = I.decorated(spark, folder).select("id", F.col("text").alias("prep"))
    return _rounded(E.tfidf_rows(texts), "weight")


def score_texts(spark, folder):
    """Whole texts against the twenty concepts of the shipped study."""
    texts = I.decorated(spark, folder).select("id", F.col("text").alias("prep"))
    return E.score_sparse(texts, settings.load_concepts(spark))


def predicate_scan(spark, folder):
    events = I.table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    return tables.find(events, (F.col("event_type") == "purchase") & (F.col("value") > 10))


def append_sink(spark, folder):
    path = scratch_path(spark, "posts")
    events = I.table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    tables.insert_many(events.filter("event_type = 'view'"), path)
    tables.insert_many(events.filter("event_type <> 'view'"), path)
    return tables.read_collection(spark, path)


def csv_period_table(spark, folder):
    path = scratch_path(spark, "periods")
    periods = _cohort(spark, folder)
    tables.write_csv(periods, path)
    return tables.read_periods(spark, path)


def labelled_csv(spark, folder):
    path = scratch_path(spark, "labelled")
    labelled = I.labelled(spark, folder).select("text", F.col("label").alias("labels"))
    labelled.write.csv(path, header=True, escape='"')
    return tables.read_labelled(spark, path).groupBy("label").agg(
        F.count("*").alias("posts"), F.sum(F.length("text")).alias("characters")
    )


def timeline_to_intervals(spark, folder):
    """Whole chain: clean, entry time, cohort, intervals."""
    posts = I.posts(spark, folder)
    # The text has done its work once the entry test is a flag, so copies meet without it;
    # the narrow rows are stored, as both halves of the entry step read them.
    hit = L.entry_hit(I.THRESHOLDS[I.ENTRY], I.ENTRY_KEYWORDS, I.ENTRY)
    clean = L.clean_text(
        posts.unionByName(posts), [F.col("created_ts")], expand=True, flags={"hit": hit}
    )
    narrow = clean.select(
        "user_id", "id", "created_ts", "normalised_date", I.EXPOSURE, I.OUTCOME, "hit"
    )
    entered = L.define_t0(cut_lineage(narrow, "clean"), F.col("hit"))
    periods = H.build_cohort(
        entered, I.EXPOSURE, I.OUTCOME, I.THRESHOLDS, min_posts=I.MIN_POSTS // 2
    )
    return H.to_intervals(periods)


def _message_files(spark: SparkSession, folder: str) -> str:
    """All events as message files, in the three shapes of a post's text.

    Among them are repeats, old posts, one post from the far future, and lines that
    cannot be read although they hold a tracked word.
    """
    path = scratch_path(spark, "messages")
    events = I.table(spark, folder, "events")
    errors = events.filter("event_type = 'error'")
    k = F.col("event_id")

    def message(number, day, whole, shape):
        """The text in ``text``, in ``extended_tweet`` behind a cut text, or in ``full_text``."""
        return F.to_json(
            F.struct(
                number.alias("id"),
                day.alias("created_at"),
                F.when(shape == 0, whole).when(shape == 1, "cut …").alias("text"),
                F.when(shape == 1, F.struct(whole.alias("full_text"))).alias("extended_tweet"),
                F.when(shape == 2, whole).alias("full_text"),
                F.lit("en").alias("lang"),
                F.struct(F.col("user_id").alias("id")).alias("user"),
            )
        ).alias("value")

    day = F.concat(F.lit("Mon "), F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" +0000 2024"))
    whole = F.concat(F.lit("saw a "), "event_type")
    old = F.lit("Mon Jan 05 10:00:00 +0000 2015")
    future = F.lit("Mon Jan 06 10:00:00 +0000 2098")
    good = events.select(message(k, day, whole, k % 3))
    repeats = events.filter("event_type = 'click'").select(message(k, day, whole, k % 3))
    late = errors.select(message(-3 * k - 3, old, F.lit("an old view"), F.lit(0)))
    ahead = events.agg(F.max("user_id").alias("user_id")).select(
        message(F.lit(1 << 50), future, F.lit("a far view"), F.lit(0))
    )
    undated = errors.select(message(-3 * k - 2, F.lit("yesterday"), F.lit("a view"), F.lit(0)))
    broken = errors.select(
        F.regexp_replace(message(-3 * k - 1, old, F.lit("a view"), F.lit(0)), "[}]+$", "").alias("value")
    )
    lines = good.unionByName(repeats).unionByName(late).unionByName(ahead)
    lines.unionByName(undated).unionByName(broken).repartition(4).write.text(path)
    return path


def _ingest(spark, folder, **options):
    source = _message_files(spark, folder)
    store = scratch_path(spark, "store")
    stream = G.read_posts_stream(spark, source, ["VIEW", "click", "purchase", "signup"], max_files=2)
    query = G.start_ingest(
        stream, store, scratch_path(spark, "progress"), available_now=True, **options
    )
    query.awaitTermination()
    return P.with_full_text(tables.read_collection(spark, store)).select(
        "id", "user_id", "created_ts", "text"
    )


def stream_ingest(spark, folder):
    return _ingest(spark, folder, block=1 << 14)


def stream_ingest_horizon(spark, folder):
    return _ingest(spark, folder, horizon="40 days")


def stream_first_copies(spark, folder):
    """Keyed state over two runs: the second brings all messages, so those of the first again."""
    lines = spark.read.text(_message_files(spark, folder))
    source, store, progress = (scratch_path(spark, n) for n in ("messages", "store", "progress"))
    for part in (lines.filter("value LIKE '%view%'"), lines):
        part.write.mode("append").text(source)
        posts = G.read_posts_stream(spark, source, ["VIEW", "click", "purchase", "signup"])
        first_copies.start_first_copies(posts, store, progress, block=1 << 14, once=True).awaitTermination()
    return P.with_full_text(tables.read_collection(spark, store)).select(
        "id", "user_id", "created_ts", "text"
    )


def rejected_messages(spark, folder):
    """Lines that the ingest could not read, by reason."""
    source = _message_files(spark, folder)
    store, kept, progress = (scratch_path(spark, n) for n in ("store", "rejects", "progress"))
    rejects.start_ingest_with_rejects(
        spark, source, store, kept, progress, ["view"], max_files=2, available_now=True
    ).awaitTermination()
    return P.value_counts(rejects.read_rejected(spark, kept), "reason")


QUERIES = [
    build_cohort, build_cohort_user_scope, cox_intervals, risk_table, cox_fit, cox_summary,
    cox_two_covariates, assign_periods, define_t0, truncate_at_outcome, min_timeline,
    timeline_span, timeline_positions, score_concepts, pivot_scores, compare_encoders,
    encoder_summary, top_k_per_concept, screen_thresholds, apply_thresholds, neighbour_cosine,
    latest_per_user, latest_per_user_paged, build_timelines, keep_existing, append_new, dedup_posts, clean_text,
    expand_contractions, tokenize_post, normalize_token, normalize_post, keyword_track, study_track,
    apply_translations, translate_texts, filter_lang, label_counts, distinct_users, sample_head, day_normalise,
    split_examples, binary_metrics, softmax_class, select_authors, train_and_classify,
    evaluate_classifier, classifier_gradient, reload_classifier, evaluate_stored, epoch_losses, validate_epochs, choose_candidate, network_classes, embed_tfidf, score_texts, predicate_scan, append_sink,
    csv_period_table, labelled_csv, timeline_to_intervals, stream_ingest, stream_ingest_horizon,
    stream_first_copies, rejected_messages,
]


def _as_text(df: DataFrame) -> DataFrame:
    """Days and times as text, which every engine prints alike."""
    formats = {"date": "yyyy-MM-dd", "timestamp": "yyyy-MM-dd HH:mm:ss"}
    return df.withColumns(
        {name: F.date_format(name, formats[kind]) for name, kind in df.dtypes if kind in formats}
    )


def registered() -> dict:
    def prepared(query):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return _as_text(query(tune(spark), folder.rstrip("/")))

        run.__name__, run.__doc__ = query.__name__, query.__doc__
        return run

    return {query.__name__: prepared(query) for query in QUERIES}
