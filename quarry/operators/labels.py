"""Labels: fusion by precedence, confidence bands, scoring, agreement and quality metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def resolve(labels: DataFrame, uid: str, precedence: dict[str, int], method: str = "method", seq: str = "seq") -> DataFrame:
    """O-C3: one label for each uid: the strongest method, then the first."""
    rank = F.coalesce(*[F.when(F.col(method) == m, p) for m, p in precedence.items()], F.lit(len(precedence)))
    place = F.row_number().over(W.partitionBy(uid).orderBy(rank, seq))
    return labels.withColumn("_p", place).filter("_p = 1").drop("_p")


def bands(confidence: Column, accept: float = 0.50, review: float = 0.35) -> tuple[Column, Column]:
    """O-C10: (accepted, needs review): both edges belong to the band above."""
    return confidence >= review, (confidence < accept) | confidence.isNull()


def softmax_scores(vectors: DataFrame, weights: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """O-C9: id, the class of greatest probability and its probability; weights (class, w, b) are few."""
    classes = weights.agg(F.collect_list(F.struct("class", "w", "b")).alias("classes")).scalar()  # one value, read once
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), classes.alias("classes"))
    score = lambda c: F.aggregate(F.zip_with("v", c["w"], lambda x, y: x.cast("double") * y), c["b"], lambda s, x: s + x)
    rows = rows.select("id", F.transform("classes", lambda c: F.struct(score(c).alias("z"), c["class"].alias("class"))).alias("all"))
    rows = rows.select("id", "all", F.array_max(F.transform("all", lambda x: x["z"])).alias("m"))
    best = F.array_max(F.transform("all", lambda x: F.struct(x["z"].alias("z"), (-x["class"]).alias("c"))))
    total = F.aggregate(F.transform("all", lambda x: F.exp(x["z"] - F.col("m"))), F.lit(0.0), lambda s, x: s + x)
    return rows.select("id", (-best["c"]).alias("class"), (F.lit(1.0) / total).alias("confidence"))


def centroid_classifier(vectors: DataFrame, label: str = "label", vec_col: str = "embedding", scale: float = 8.0) -> DataFrame:
    """Weights (class, w, b) of a linear classifier: each class's scaled mean vector. One row for each class."""
    spread = vectors.select(F.col(label).alias("class"), F.posexplode(vec_col).alias("i", "x"))
    means = spread.groupBy("class", "i").agg((F.avg("x") * scale).alias("m"))
    return means.groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("w")).withColumn("b", F.lit(0.0))


def class_metrics(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """O-C12: class, precision, recall, f1, support over the classes present in either column."""
    pairs = rows.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    hits = pairs.filter("t = g").select(F.col("t").alias("class"), F.col("n").alias("hit"))
    truths = pairs.filter("t IS NOT NULL").groupBy(F.col("t").alias("class")).agg(F.sum("n").alias("support"))
    guesses = pairs.filter("g IS NOT NULL").groupBy(F.col("g").alias("class")).agg(F.sum("n").alias("guessed"))
    met = truths.join(guesses, "class", "full").join(hits, "class", "left").na.fill(0)
    p, r = F.try_divide("hit", "guessed"), F.try_divide("hit", "support")
    met = met.select("class", F.coalesce(p, F.lit(0.0)).alias("precision"), F.coalesce(r, F.lit(0.0)).alias("recall"), "support")
    return met.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def weighted_agreement(pairs: DataFrame, by: list[str], categories: int, weights: str = "quadratic", least: int = 10) -> DataFrame:
    """O-W7: pooled-marginal pi over pairs (a, b) of categories 1..n: n_pairs, observed, expected, kappa, reason.

    Weights fall with distance over the declared span; ``reason`` says why kappa is null.
    """

    def weight(a: Column, b: Column) -> Column:
        if weights == "nominal" or categories < 2:
            return (a == b).cast("double")
        gap = F.abs(a - b) / F.lit(float(categories - 1))
        return F.lit(1.0) - (F.pow(gap, F.lit(2.0)) if weights == "quadratic" else gap)

    observed = pairs.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.avg(weight(F.col("a"), F.col("b"))).alias("observed"))
    marginals = pairs.select(*by, F.explode(F.array("a", "b")).alias("x")).groupBy(*by, "x").agg(F.count("*").alias("n"))
    chance = marginals.join(marginals.select(*by, F.col("x").alias("y"), F.col("n").alias("m")), by)  # categories squared, for each group
    expected = chance.groupBy(*by).agg(F.sum(F.col("n") * F.col("m") * weight(F.col("x"), F.col("y"))).alias("e"))
    met = observed.join(expected, by).withColumn("expected", F.col("e") / (4.0 * F.col("n_pairs") * F.col("n_pairs")))
    reason = F.when(F.col("n_pairs") < least, "poucos_pares").when(F.col("expected") >= 1.0, "sem_variancia")
    kappa = F.when(reason.isNull(), F.round((F.col("observed") - F.col("expected")) / (1.0 - F.col("expected")), 4))
    return met.select(*by, "n_pairs", F.round("observed", 4).alias("observed"), F.round("expected", 4).alias("expected"), kappa.alias("kappa"), reason.alias("reason"))


def batch_agreement(gold: DataFrame, answers: DataFrame, axes: list[str]) -> DataFrame:
    """O-C13: for each batch the share of gold axes answered alike; a missing answer is a miss."""
    met = gold.join(answers.select("batch", "uid", *[F.col(c).alias(f"_{c}") for c in axes]), ["batch", "uid"], "left")
    same = sum((F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False))).cast("int") for c in axes)
    return met.groupBy("batch").agg((F.sum(same) / (F.count("*") * len(axes))).alias("agreement"), F.count("*").alias("n_gold"))


def response_errors(expected: DataFrame, received: DataFrame) -> DataFrame:
    """O-C14: uid and its errors: missing, unexpected, repeated, quality or nsfw out of bounds."""
    counted = received.groupBy("uid").agg(F.count("*").alias("n"), F.min("quality").alias("low"), F.max("quality").alias("high"), F.count("nsfw").alias("told"))
    met = expected.select("uid", F.lit(True).alias("asked")).join(counted, "uid", "full")
    errors = F.array_compact(
        F.array(
            F.when(F.col("n").isNull(), "missing"),
            F.when(F.col("asked").isNull(), "unexpected"),
            F.when(F.col("n") > 1, "repeated"),
            F.when(F.col("n").isNotNull() & ~F.coalesce((F.col("low") >= 1) & (F.col("high") <= 3), F.lit(False)), "quality"),
            F.when(F.col("n").isNotNull() & (F.col("told") < F.col("n")), "nsfw"),
        )
    )
    return met.select("uid", errors.alias("errors")).filter(F.size("errors") > 0)


def agreement_report(scales: dict[str, tuple[DataFrame, int, str]]) -> DataFrame:
    """O-W8: ``weighted_agreement`` of each scale's pairs, one row a scale; a scale without pairs has none.

    Scales are not merged: points of one have no place on another. Categories of a nominal scale may be of any type.
    """
    rows = None
    for field, (pairs, categories, weights) in scales.items():
        one = weighted_agreement(pairs.withColumn("field", F.lit(field)), ["field"], categories, weights)
        rows = one if rows is None else rows.unionByName(one)
    return rows
