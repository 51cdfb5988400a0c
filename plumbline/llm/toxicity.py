"""Toxicity by a classifier chain: categories are predicted one after another, each model seeing the earlier ones' probabilities.

Models are L1 logistic regressions over the words of a text, fitted by Spark ML on a bounded sample of labelled documents.
While fitting, earlier categories enter as out-of-fold probabilities, so that a later model does not lean on answers
its predecessors have learned by heart. Scoring is a projection over all documents and whole texts, without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import discard, stored, text_or_empty

LABEL_SAMPLE = 8_000  # labelled documents that the models are fitted on, at most about this many
FOLDS = 3
VOCABULARY = 20_000  # words that are features: the most frequent of the sample, by documents
PARTITIONS = 4  # of the bounded sample, while its texts are cut into words
PENALTY = 0.001


def _worded(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("__w", F.filter(F.split(F.lower(text_or_empty(text)), r"[^\p{L}]+"), lambda w: w != ""))


class ToxicityChain:
    """Fitted links, in order: (category, model or None, prior). threshold: of the last category."""

    def __init__(self, vocabulary: CountVectorizerModel | None, links: list, threshold: float):
        self.vocabulary, self.links, self.threshold = vocabulary, links, threshold

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with a column p_<category> for each category and flagged (boolean), which must not be names of docs."""
        if self.vocabulary is None:
            priors = {f"p_{name}": F.lit(float(prior)) for name, _, prior in self.links}
            return docs.withColumns(priors | {"flagged": F.lit(False)})
        out = _counted(_worded(docs, text_col), self.vocabulary)
        for k, (name, model, prior) in enumerate(self.links):
            out = _apply(out, model, k, prior).withColumnRenamed(f"__p{k}", f"p_{name}")
            if k + 1 < len(self.links):
                out = _chained(out, k, len(self.vocabulary.vocabulary) + k + 1, f"p_{name}")
        extra = [f"__f{k}" for k in range(len(self.links))]
        return out.withColumn("flagged", F.col(f"p_{self.links[-1][0]}") >= self.threshold).drop(*extra)


def _sized(df: DataFrame, column: str, n: int) -> DataFrame:
    """df with the length of the vectors in column as the only metadata, in place of an entry for each word, which every
    plan on the driver would carry along."""
    return df.withMetadata(column, {"ml_attr": {"num_attrs": n}})


def _counted(worded: DataFrame, vocabulary: CountVectorizerModel) -> DataFrame:
    """The features of the first link, in place of the words."""
    return _sized(vocabulary.transform(worded).drop("__w"), "__f0", len(vocabulary.vocabulary))


def _chained(df: DataFrame, k: int, n: int, p: str) -> DataFrame:
    """The n features of link k+1: those of link k and the probability of its category."""
    return _sized(VectorAssembler(inputCols=[f"__f{k}", p], outputCol=f"__f{k + 1}").transform(df), f"__f{k + 1}", n)


def _sample(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bounded sample as a table of its own, and that table cached. Each step of a fit is a job, which the driver
    sends out with all that the rows come from; from one partition its gradient comes back without a shuffle."""
    table = stored(df, "toxicity-sample")
    return table, table.coalesce(1).cache()


def _apply(df: DataFrame, model, k: int, prior: float) -> DataFrame:
    if model is None:
        return df.withColumn(f"__p{k}", F.lit(float(prior)))
    model = model.copy().setFeaturesCol(f"__f{k}").setPredictionCol("__y").setRawPredictionCol("__raw").setProbabilityCol("__prob")
    return model.transform(df).withColumn(f"__p{k}", vector_to_array("__prob")[1]).drop("__y", "__raw", "__prob")


def _fit(df: DataFrame, k: int, label: str, penalty: float):
    """(model, prior); no model where the label has one value only."""
    prior = df.agg(F.avg(label)).first()[0]
    if prior in (None, 0.0, 1.0):
        return None, float(prior or 0.0)
    lr = LogisticRegression(featuresCol=f"__f{k}", labelCol=label, regParam=penalty, elasticNetParam=1.0, maxIter=30, tol=1e-4, standardization=False)
    return lr.fit(df), float(prior)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", sample: int = LABEL_SAMPLE, penalty: float = PENALTY) -> ToxicityChain:
    """Fit on documents with labels 0/1 in the columns `categories` of labels.

    At most about `sample` labelled documents are drawn, by a hash of the id. Labels with a null are left out, repeated
    ones count once, as the highest. Without labels, or with one value only, a category has its prior as probability and
    flags nothing; so it is without a word that two documents share. Words of one sampled document are no features, but in
    a sample of ten or fewer. The threshold is where the out-of-fold predictions of the last category reach their best F1.
    """
    marks = labels.select(F.col(id_col).alias("__id"), *[F.col(c).cast("double").alias(f"__l{k}") for k, c in enumerate(categories)]).dropna()
    marks = marks.groupBy("__id").agg(*[F.max(f"__l{k}").alias(f"__l{k}") for k in range(len(categories))])
    n = marks.count()
    if n > sample:
        marks = marks.where(F.pmod(F.xxhash64("__id", F.lit(29)), F.lit(1 << 30)) < F.lit(int(sample / n * (1 << 30))))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(marks), "__id")  # the bounded sample
    rows = _worded(rows, "__t").drop("__t").withColumn("__fold", F.pmod(F.xxhash64("__id", F.lit(31)), F.lit(FOLDS)))
    # the sample alone moves, the scan keeps its own tasks; in one order it gives the same models again
    rows = rows.repartition(PARTITIONS).sortWithinPartitions("__id").cache()
    held, links, threshold = [rows], [], 1.1
    if rows.select(F.explode("__w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        rows.unpersist()
        return ToxicityChain(None, [(c, None, 0.0) for c in categories], threshold)
    least = 2 if rows.count() > 10 else 1
    vocabulary = CountVectorizer(inputCol="__w", outputCol="__f0", vocabSize=VOCABULARY, minDF=least, binary=True).fit(rows)
    table, rows = _sample(_counted(rows, vocabulary))
    tables = [table]
    held.append(rows)
    for k, name in enumerate(categories):
        label = f"__l{k}"
        model, prior = _fit(rows, k, label, penalty)
        links.append((name, model, prior))
        parts = []
        for fold in range(FOLDS):
            own, _ = _fit(rows.where(F.col("__fold") != fold), k, label, penalty)
            parts.append(_apply(rows.where(F.col("__fold") == fold), own, k, prior))
        rows = reduce(DataFrame.unionByName, parts)
        if k + 1 < len(categories):
            table, rows = _sample(_chained(rows, k, len(vocabulary.vocabulary) + k + 1, f"__p{k}").drop(f"__f{k}"))
            tables.append(table)
            held.append(rows)
        elif model is not None:
            threshold = _best_f1([(r[0], r[1]) for r in rows.select(f"__p{k}", label).collect()])  # two numbers a sampled document
    for h in held:
        h.unpersist()
    discard(*tables)
    return ToxicityChain(vocabulary, links, threshold)


def _best_f1(pairs: list[tuple[float, float]]) -> float:
    """The threshold of best F1, midway to the next lower probability; ties go to the higher threshold."""
    best, at, hits, seen, wanted = 0.0, 0.5, 0.0, 0, sum(y for _, y in pairs)
    order = sorted(pairs, reverse=True)
    for i, (p, y) in enumerate(order):
        hits, seen = hits + y, seen + 1
        below = order[i + 1][0] if i + 1 < len(order) else 0.0
        if below < p and (f1 := 2 * hits / (seen + wanted)) > best:
            best, at = f1, (p + below) / 2
    return at


def judge(docs: DataFrame, chain: ToxicityChain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, p_<category> of each category, toxic. A null text counts as empty; repeated rows are
    judged alike; an empty table gives no rows; other columns of docs are ignored."""
    out = chain.score(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")), "__t")
    return out.select(F.col("__id").alias(id_col), *[f"p_{c}" for c, _, _ in chain.links], F.col("flagged").alias("toxic"))


def reject_toxic(docs: DataFrame, chain: ToxicityChain, text_col: str = "text") -> DataFrame:
    """docs without the rows that the chain flags; all columns stay, whatever their names."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text_col).alias("__t"))
    return chain.score(packed, "__t").where("not flagged").select("__row.*")
