"""A cohort study from messages to hazard ratio, one stored table per stage.

    study = Study(spark, "s3a://bucket/study")
    study.ingest("s3a://bucket/messages").awaitTermination()
    study.train(read_labelled(spark, "s3a://bucket/labelled.csv")).show()
    study.select_authors(directory)
    study.collect_timelines(all_posts)
    study.prepare()
    study.score()
    study.enter()
    study.build_cohort("Comorbidities", "Mental health")
    study.cox().summary(spark).show()

Each stage reads the table of the stage before and writes its own, so a stage can be
repeated with other parameters, and no plan is evaluated twice.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kohorta.functions.text import has_keyword
from kohorta.operators import classify as C
from kohorta.operators import cohort as H
from kohorta.operators import embedding as E
from kohorta.operators import posts as P
from kohorta.operators import scoring as S
from kohorta.operators import survival as V
from kohorta.operators import timeline as L
from kohorta.session import scratch_scope, tune
from kohorta.sources import settings as cfg
from kohorta.sources import tables
from kohorta.streaming import ingest as G

TIMELINE = ("user_id", "id", "created_ts", "normalised_date")


@dataclass
class Study:
    spark: SparkSession
    folder: str
    settings: str = cfg.DIABETES

    def __post_init__(self):
        tune(self.spark)
        self.folder = self.folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def table(self, name: str) -> DataFrame:
        return tables.read_collection(self.spark, self.path(name))

    def store(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.table(name)

    # 1. posts that match the track keywords

    def ingest(
        self,
        messages: str,
        horizon: str | None = None,
        forever: bool = False,
        max_files: int | None = 1000,
    ) -> StreamingQuery:
        """Starts the stream; a batch takes at most ``max_files`` message files. Counts of
        read and dropped messages are in the query's progress under ``ingest``."""
        track = cfg.load_track(self.spark, self.settings)
        stream = G.read_posts_stream(self.spark, messages, track, max_files)
        return G.start_ingest(
            stream, self.path("posts"), self.path("progress"), horizon, available_now=not forever
        )

    # 2. classifier of personal posts, and their authors

    def train(self, labelled: DataFrame, **options) -> DataFrame:
        """Fits and saves the classifier; returns its metrics on the test part.

        Parts are drawn by a digest of the text where the examples carry no id.
        """
        if "id" not in labelled.columns:
            labelled = labelled.withColumn("id", F.md5("text"))
        parts = C.split_examples(labelled)
        model = C.train_classifier(parts.filter("part = 'train'"), **options)
        C.save_classifier(model, self.path("classifier"))
        return C.evaluate(model, parts.filter("part = 'test'"))

    def select_authors(self, directory: DataFrame | None = None, lang: str = "en") -> DataFrame:
        """Authors of personal posts, as far as the directory of users knows them."""
        posts = P.with_full_text(P.filter_lang(self.table("posts"), lang))
        model = C.load_classifier(self.path("classifier"))
        personal = C.classify(posts.select("user_id", "text"), model)
        authors = C.select_authors(personal)
        if directory is not None:
            authors = P.keep_existing(authors, directory)
        return self.store(authors, "authors")

    # 3. and 4. timelines

    def collect_timelines(self, all_posts: DataFrame, n: int = 3240) -> DataFrame:
        """The latest posts of the authors, without reposts."""
        posts = P.with_full_text(all_posts)
        with scratch_scope(self.spark):
            return self.store(L.build_timelines(posts, self.table("authors"), n), "timelines")

    def prepare(self, translations: DataFrame | None = None, min_len: int = 7) -> DataFrame:
        posts = self.table("timelines")
        if translations is not None:
            posts = P.apply_translations(posts, translations)
        clean = L.clean_timelines(posts, min_len)
        return self.store(clean.select(*TIMELINE, "text", "prep"), "timelines_prep")

    # 5. concept scores

    def compare_encoders(self, encoders: Mapping, n: int = 1000) -> DataFrame:
        """Summary of each encoder's similarities on the first ``n`` posts."""
        sample = P.sample_head(self.table("timelines_prep").select("id", "prep"), n)
        concepts = cfg.load_concepts(self.spark, self.settings)
        parts = [
            self._long(sample, concepts, encoder).withColumn("encoder", F.lit(name))
            for name, encoder in encoders.items()
        ]
        scores = parts[0]
        for part in parts[1:]:
            scores = scores.unionByName(part)
        return S.encoder_summary(scores)

    def screen_thresholds(self, encoder=None, n: int = 20_000, k: int = 500) -> DataFrame:
        """Highest similarities per concept with their posts, for reading."""
        sample = P.sample_head(self.table("timelines_prep").select("id", "prep"), n)
        scores = self._long(sample, cfg.load_concepts(self.spark, self.settings), encoder)
        return S.screen_thresholds(scores, sample, k)

    def score(self, encoder=None) -> DataFrame:
        """Similarities to all concepts, and whether an entry keyword occurs."""
        words = cfg.load_entry_keywords(self.spark, self.settings)
        posts = self.table("timelines_prep").withColumn(
            "keyword", has_keyword(F.col("prep"), words)
        )
        posts = posts.select(*TIMELINE, "keyword", "prep")
        concepts = cfg.load_concepts(self.spark, self.settings)
        encoder = self._encoder(encoder)
        if isinstance(encoder, PipelineModel):
            scores = E.score_texts(posts, encoder, concepts, wide=True)
        else:
            vectors = E.embed(posts, encoder).drop("prep")
            scores = S.score_wide(vectors, E.embed_concepts(concepts, encoder))
        return self.store(scores, "scores")

    def _encoder(self, encoder):
        return E.fit_tfidf(self.table("timelines_prep")) if encoder is None else encoder

    def _long(self, posts: DataFrame, concepts: DataFrame, encoder) -> DataFrame:
        encoder = self._encoder(encoder)
        if isinstance(encoder, PipelineModel):
            return E.score_texts(posts, encoder, concepts)
        vectors = E.embed(posts, encoder).drop("prep")
        return S.score_concepts(vectors, E.embed_concepts(concepts, encoder))

    # 6. entry time

    def thresholds(self) -> dict[str, float]:
        return dict(self.read_settings()["thresholds"])

    def read_settings(self):
        return cfg.read_settings(self.spark, self.settings).first()

    def enter(self, threshold: float | None = None) -> DataFrame:
        """Scores from each user's entry time on."""
        concept = self.read_settings()["key_concept"]
        limit = self.thresholds()[concept] if threshold is None else threshold
        hit = F.coalesce(F.col(f"`{concept}`") >= limit, F.lit(False)) | F.col("keyword")
        return self.store(L.define_t0(self.table("scores"), hit), "timelines_t0")

    # 7. and 8. cohort and hazard ratio

    def build_cohort(self, exposure: str, outcome: str, **options) -> DataFrame:
        scores = self.table("timelines_t0")
        narrow = scores.select("user_id", "id", "normalised_date", f"`{exposure}`", f"`{outcome}`")
        periods = H.build_cohort(narrow, exposure, outcome, self.thresholds(), **options)
        stored = self.store(periods, "cohort_periods")
        tables.write_csv(stored, self.path("cohort_periods_csv"))
        return stored

    def intervals(self) -> DataFrame:
        return self.store(H.to_intervals(self.table("cohort_periods")), "cohort_intervals")

    def cox(self, **options) -> V.CoxFit:
        with scratch_scope(self.spark):
            return V.cox_fit(self.intervals(), **options)
