"""Evaluation of predictions, and combining several models' predictions.

Predictions are long: ``(id, model, ord, pred, gold)`` with one row per item and model; ``pred`` may be null,
``ord`` is the model's place in the declared order, which breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import DEFAULT_LABEL, LABELS


def filled(pred: Column) -> Column:
    """A missing or empty answer as the default class."""
    return F.coalesce(F.nullif(pred, F.lit("")), F.lit(DEFAULT_LABEL))


def accuracy(p: DataFrame) -> DataFrame:
    """``(model, ord, n, valid, accuracy, valid_accuracy)``: missing answers as the default class, and left out."""
    hit = F.avg((filled(F.col("pred")) == F.col("gold")).cast("double"))
    ok = F.when(F.col("pred").isNotNull(), (F.col("pred") == F.col("gold")).cast("double"))
    return p.groupBy("model", "ord").agg(F.count("*").alias("n"), F.count("pred").alias("valid"), hit.alias("accuracy"), F.avg(ok).alias("valid_accuracy"))


def confusion(p: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """``(model, gold, pred, n)`` for every pair of labels, zeros kept; missing answers as the default class."""
    spark = p.sparkSession
    l = spark.createDataFrame([(x,) for x in labels], "gold string")
    cells = p.select("model").distinct().crossJoin(F.broadcast(l)).crossJoin(F.broadcast(l.toDF("pred")))  # models x labels x labels
    n = p.groupBy("model", "gold", filled(F.col("pred")).alias("pred")).agg(F.count("*").alias("n"))
    return cells.join(n, ["model", "gold", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def report(p: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """``(model, class, precision, recall, f1, support)`` by class, and the rows 'macro avg' and 'weighted avg'; 0 where undefined."""
    gold, said = Window.partitionBy("model", "gold"), Window.partitionBy("model", "pred")
    c = confusion(p, labels).withColumn("support", F.sum("n").over(gold)).withColumn("said", F.sum("n").over(said)).where("gold = pred")
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    j = c.select("model", F.col("gold").alias("class"), "support", div(F.col("n"), F.col("said")).alias("precision"), div(F.col("n"), F.col("support")).alias("recall"))
    j = j.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    # each class row also counts to the two averages: one pass gives all three kinds of rows
    rows = j.withColumn("row", F.explode(F.array("class", F.lit("macro avg"), F.lit("weighted avg"))))
    weight = F.when(F.col("row") == "weighted avg", F.col("support")).otherwise(1)
    mean = lambda x: div(F.sum(F.col(x) * weight), F.sum(weight)).alias(x)
    return rows.groupBy("model", F.col("row").alias("class")).agg(mean("precision"), mean("recall"), mean("f1"), F.sum("support").alias("support"))


def weights(acc: DataFrame, power: int = 1) -> DataFrame:
    """``(model, ord, weight)``: accuracy to a power over the models' sum; all 0 stays 0."""
    w = F.pow("accuracy", F.lit(power))
    total = acc.agg(F.sum(w).alias("total"))
    return acc.crossJoin(F.broadcast(total)).select("model", "ord", F.coalesce(F.try_divide(w, F.col("total")), F.lit(0.0)).alias("weight"))


def vote(p: DataFrame, w: DataFrame | None = None) -> DataFrame:
    """``(id, vote)``: the label with the largest weight (1 each without ``w``); null answers abstain, nobody's vote
    is the default class, ties go to the label that the earliest model gave."""
    v = p.withColumn("weight", F.lit(1.0)) if w is None else p.join(F.broadcast(w.select("model", "weight")), "model")  # one row a model
    s = v.where("pred is not null").groupBy("id", "pred").agg(F.round(F.sum("weight"), 9).alias("s"), F.min("ord").alias("first"))
    best = s.groupBy("id").agg(F.max_by("pred", F.struct("s", (-F.col("first")).alias("f"))).alias("vote"))
    return p.select("id").distinct().join(best, "id", "left").select("id", F.coalesce("vote", F.lit(DEFAULT_LABEL)).alias("vote"))


def meta_features(p: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """``(id, one_hot, agreement, vote_entropy)``: models in order by labels, the largest share of equal votes, the votes' entropy."""
    q = p.withColumn("pred", filled(F.col("pred")))
    hot = F.array(*[F.when(F.col("pred") == l, 1).otherwise(0) for l in labels])
    rows = q.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", hot.alias("h")))), lambda x: x["h"])).alias("one_hot"), F.count("*").alias("m"))
    c = q.groupBy("id", "pred").agg(F.count("*").alias("k"))
    share = c.withColumn("m", F.sum("k").over(Window.partitionBy("id"))).withColumn("share", F.col("k") / F.col("m"))
    listed = F.col("pred").isin(*labels)
    s = share.groupBy("id").agg(F.max("share").alias("agreement"), F.coalesce(-F.sum(F.when(listed, F.col("share") * F.log2("share"))), F.lit(0.0)).alias("vote_entropy"))
    return rows.join(s, "id").select("id", "one_hot", "agreement", "vote_entropy")


def class_experts(p: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """``(class, expert, f1)``: for each class the model with the best F1, the earliest on ties."""
    order = p.select("model", "ord").distinct()
    r = report(p, labels).where(F.col("class").isin(*labels)).join(F.broadcast(order), "model")
    return r.groupBy("class").agg(F.max_by(F.struct("model", "f1"), F.struct(F.round("f1", 9), (-F.col("ord")).alias("o"))).alias("b")).select("class", F.col("b.model").alias("expert"), F.col("b.f1").alias("f1"))


def expert_vote(p: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """``(id, vote)``: the equal vote's class names an expert, whose answer counts; a missing one is the default class."""
    e = class_experts(p, labels)
    routed = vote(p).join(F.broadcast(e.select(F.col("class").alias("vote"), F.col("expert").alias("model"))), "vote", "left").select("id", "model")
    own = p.select("id", "model", "pred")
    return routed.join(own, ["id", "model"], "left").select("id", filled(F.col("pred")).alias("vote"))


def any_right(p: DataFrame) -> DataFrame:
    """``(n, right, bound)``: items at least one model gets right, the upper bound of any combination."""
    r = p.groupBy("id").agg(F.max((filled(F.col("pred")) == F.col("gold")).cast("int")).alias("r"))
    return r.agg(F.count("*").alias("n"), F.sum("r").alias("right"), F.avg("r").alias("bound"))


def rescues(p: DataFrame, base: str) -> DataFrame:
    """``(model, n)``: how many of the base model's errors each other model gets right; 'nobody' for those none does."""
    q = p.withColumn("ok", filled(F.col("pred")) == F.col("gold"))
    wrong = q.where((F.col("model") == base) & ~F.col("ok")).select("id")
    others = q.where(F.col("model") != base).join(wrong, "id", "left_semi")
    by = others.groupBy("model").agg(F.count_if("ok").alias("n"))
    none = others.groupBy("id").agg(F.max(F.col("ok").cast("int")).alias("any")).agg(F.count_if(F.col("any") == 0).alias("n")).select(F.lit("nobody").alias("model"), "n")
    return by.unionByName(none)
