"""Intent classifiers over texts: the majority class, and logistic regression on TF-IDF weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import retrieval
from threadloom.workspace import Workspace, fits

#: Vocabularies of TF-IDF are bounded by ``max_features``, so a table of them may be broadcast; the limit is checked all the same.
VOCABULARY_BYTES = 64 << 20


class Blocked(ValueError):
    """The model cannot be trained; the message says why."""


class IntentModel:
    """``fit`` on ``id, text, intent``; ``predict`` gives ``id, intent`` of ``id, text`` by the majority or by the regression.

    Fewer than two classes, an empty vocabulary or a fit that does not converge block the regression with a reason; the majority stays.
    Texts without a known word get the class of the intercepts. Null texts read as empty, null intents are left out.
    """

    def __init__(self, ngrams: int = 2, max_features: int = 5000, c: float = 1.0, rounds: int = 500):
        self.ngrams, self.max_features, self.c, self.rounds = ngrams, max_features, c, rounds
        self.majority: str | None = None
        self.blocker: str | None = None
        self.model = None

    def fit(self, training: DataFrame) -> IntentModel:
        from pyspark.ml.classification import LogisticRegression

        work = Workspace(training.sparkSession, "intents")
        rows = work.save(training.select("id", F.coalesce("text", F.lit("")).alias("text"), "intent").where("intent is not null"))
        # One row per class.
        classes = rows.groupBy("intent").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "intent").collect()
        self.majority = classes[0]["intent"] if classes else None
        self.classes = sorted(r["intent"] for r in classes)
        if len(classes) < 2:
            self.blocker = f"needs at least two classes; found {len(classes)}"
            return self
        idf, weights = retrieval.fit(rows.select("id", "text"), self.ngrams, self.max_features)
        self.idf = work.save(idf.select("term", "idf", (F.row_number().over(_by_term()) - 1).alias("_at")))
        self.size = self.idf.count()
        if not self.size:
            self.blocker = "empty vocabulary"
            return self
        n = rows.count()
        label = F.create_map(*[F.lit(x) for i, k in enumerate(self.classes) for x in (k, float(i))])
        data = self._vectors(rows.select("id", "text"), weights).join(rows.select("id", label[F.col("intent")].alias("label")), "id")
        data = data.cache()
        fit = LogisticRegression(regParam=1.0 / (self.c * n), elasticNetParam=0.0, standardization=False, family="multinomial", maxIter=self.rounds, tol=1e-4).fit(data)
        data.unpersist()
        if fit.summary.totalIterations >= self.rounds:
            self.blocker = f"no convergence in {self.rounds} rounds"
            return self
        spark = training.sparkSession
        coefficients = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(fit.coefficientMatrix.toArray().T)], "_at int, coefficients array<double>")
        self.model = work.save(self.idf.join(coefficients, "_at").select("term", "idf", "coefficients"))
        self.intercepts = [float(x) for x in fit.interceptVector]
        return self

    def _vectors(self, texts: DataFrame, weights: DataFrame) -> DataFrame:
        """``id, features``: a sparse vector per text, of length one; texts without a known term get the empty one."""
        from pyspark.ml.linalg import SparseVector, VectorUDT

        size = self.size
        places = self.idf.select("term", "_at")
        known = weights.join(F.broadcast(places) if fits(places, VOCABULARY_BYTES) else places, "term")
        # A vector has at most max_features entries.
        packed = known.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("_at").alias("i"), F.col("weight").alias("w")))).alias("_v"))
        sparse = F.udf(lambda v: SparseVector(size, [x["i"] for x in v or []], [x["w"] for x in v or []]), VectorUDT())
        return texts.select("id").join(packed, "id", "left").select("id", sparse("_v").alias("features"))

    def predict(self, texts: DataFrame, trivial: bool = False) -> DataFrame:
        if trivial:
            return texts.select("id", F.lit(self.majority).cast("string").alias("intent"))
        if self.model is None:
            raise Blocked(self.blocker or "not trained")
        counts = texts.select("id", F.coalesce("text", F.lit("")).alias("text")).select("id", F.explode(retrieval.terms(F.col("text"), self.ngrams)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))
        weights = retrieval.weigh(counts, self.model.select("term", "idf"))
        table = self.model.select("term", "coefficients")
        known = weights.join(F.broadcast(table) if fits(table, VOCABULARY_BYTES) else table, "term")
        # One sum per class; they combine on the map side, so a text never has to be gathered.
        sums = known.groupBy("id").agg(*[F.sum(F.col("weight") * F.col("coefficients")[i]).alias(f"_{i}") for i in range(len(self.classes))])
        scores = F.array(*[F.coalesce(F.col(f"_{i}"), F.lit(0.0)) + F.lit(b) for i, b in enumerate(self.intercepts)])
        names = F.array(*[F.lit(c) for c in self.classes])
        best = texts.select("id").join(sums, "id", "left").withColumn("_s", scores)
        return best.select("id", F.element_at(names, F.array_position("_s", F.array_max("_s")).cast("int")).alias("intent"))


def _by_term():  # noqa: ANN202
    from pyspark.sql.window import Window

    # At most max_features rows.
    return Window.orderBy("term")
