"""Pluggable rankers over feature vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.sources.work import written


def _boosted(**params):
    return GBTRegressor(featuresCol="features", labelCol="label", predictionCol="score", **{"maxIter": 10, "maxDepth": 4, "seed": 1} | params)


def _logistic(**params):
    return LogisticRegression(featuresCol="features", labelCol="label", **{"maxIter": 20, "regParam": 1e-3} | params)


#: Model classes by the names that configurations give.
RANKERS: dict[str, Callable] = {"boosted": _boosted, "logistic": _logistic}


def make_ranker(model_class: str, **params):
    if model_class not in RANKERS:
        raise ValueError(f"unknown model class {model_class}; there are {sorted(RANKERS)}")
    return RANKERS[model_class](**params)


def fit_ranker(df: DataFrame, features: Sequence[str], label: str, model_class: str = "boosted", **params) -> PipelineModel:
    """Fits a pointwise ranker; missing numbers are 0."""
    ready = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features], F.col(label).cast("double").alias("label"))
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), make_ranker(model_class, **params)]).fit(ready)


def score(df: DataFrame, model: PipelineModel, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    ready = df.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features if c not in keys])
    out = model.transform(ready)
    return out.select(*keys, (F.col("score") if "score" in out.columns else vector_to_array("probability")[1]).alias("score"))


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    ready = df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    return VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="features").transform(ready)


def _gap(score: Column, clicked: Column) -> Column:
    return 1 / (1 + F.exp(F.greatest(F.least(clicked - score, F.lit(30.0)), F.lit(-30.0))))


def _of_member(label: Column, score: Column, clicked: Column, gaps: Column, hits: Column) -> tuple[Column, Column]:
    """(gradient, loss) of a member, from its list's mean score of clicked members, sum of the others' gaps and number of clicked members."""
    push = gaps / F.greatest(hits, F.lit(1.0))
    return F.when(label == 1, push).otherwise(-_gap(score, clicked)), F.when(label == 0, F.log1p(F.exp(F.least(score - clicked, F.lit(30.0)))))


def _pulls(score: Column, group: str) -> tuple[Column, Column]:
    """(gradient, loss of the group) of a list's pairs (clicked, other): log(1 + exp(other - clicked)), from window aggregates, no pair is listed."""
    w, label = Window.partitionBy(group), F.col("label")
    clicked = F.avg(F.when(label == 1, score)).over(w)
    gaps = F.sum(F.when(label == 0, _gap(score, clicked))).over(w)
    return _of_member(label, score, clicked, gaps, F.sum("label").over(w))


def _total(members: Column | str, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(members, F.lit(0.0), lambda total, x: total + F.coalesce(value(x), F.lit(0.0)))


def _list_pulls(score: Callable[[Column], Column], members: str = "m") -> Column:
    """What _pulls() gives, for lists that are one row each: *members* (label and more) with pull and loss."""
    scored = F.transform(members, lambda x: F.struct(x["label"].alias("label"), score(x).alias("s"), x.alias("x")))
    hit = lambda x: (x["label"] == 1).cast("double")
    base = F.transform(F.array(scored), lambda m: F.struct(m.alias("m"), (_total(m, lambda x: hit(x) * x["s"]) / _total(m, hit)).alias("clicked"), _total(m, lambda x: x["label"]).alias("hits")))
    known = F.transform(base, lambda g: F.struct(g["m"].alias("m"), g["clicked"].alias("clicked"), g["hits"].alias("hits"), _total(g["m"], lambda x: F.when(x["label"] == 0, _gap(x["s"], g["clicked"]))).alias("gaps")))

    def member(g: Column) -> Callable[[Column], Column]:
        def run(x: Column) -> Column:
            pull, loss = _of_member(x["label"], x["s"], g["clicked"], g["gaps"], g["hits"])
            return F.struct(x["x"].alias("x"), pull.alias("pull"), loss.alias("loss"))

        return run

    return F.flatten(F.transform(known, lambda g: F.transform(g["m"], member(g))))


def _tree_value(node, member: Column) -> Column:
    """What a fitted tree's node gives a member (fields f0, f1, ...): a value where it is a leaf, else that of the side it goes to."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(node.prediction())
    split = node.split()
    left, right = (_tree_value(n, member) for n in (node.leftChild(), node.rightChild()))
    return F.when(member[f"f{split.featureIndex()}"] <= split.threshold(), left).otherwise(right)


#: From so many bytes of gathered lists on a round's gradients are written, as fitting a tree passes over them several times.
ROUND_BYTES = 32 << 20


class GroupedRanker:
    """Boosted trees for lists: each tree follows the gradient of the pairwise logistic loss between a list's clicked member and its others."""

    def __init__(self, features: Sequence[str], group: str, rounds: int = 10, rate: float = 0.3, **tree):
        self.features, self.group, self.rounds, self.rate = list(features), group, rounds, rate
        self.tree = {"maxDepth": 4, "seed": 1, "minInstancesPerNode": 5} | tree
        self.trees: list = []
        self.losses: list[float] = []

    def fit(self, df: DataFrame, label: str) -> GroupedRanker:
        """Lists without a click, or without another member, have no pairs and take no part. losses gets the mean pair loss before each tree.

        Lists are gathered once, into a row each: what a round needs of a list is told there, and no round shuffles rows.
        Gradients are made once a round.
        """
        number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        member = F.struct(F.col(label).cast("double").alias("label"), *[number(c).alias(f"f{i}") for i, c in enumerate(self.features)])
        hits = _total("m", lambda x: x["label"])
        lists = df.groupBy(self.group).agg(F.collect_list(member).alias("m")).filter((hits > 0) & (hits < F.size("m"))).select("m")
        lists = written(lists)
        for _ in range(self.rounds):
            members = lists.select(F.inline(_list_pulls(self._member_score)))
            rows = written(members.select(*[F.col(f"x.f{i}").alias(f"f{i}") for i in range(len(self.features))], "pull", "loss"), ROUND_BYTES)
            ready = VectorAssembler(inputCols=[f"f{i}" for i in range(len(self.features))], outputCol="features").transform(rows)
            self.losses.append(rows.agg(F.avg("loss")).first()[0] or 0.0)
            self.trees.append(DecisionTreeRegressor(featuresCol="features", labelCol="pull", predictionCol="p", **self.tree).fit(ready.select("features", "pull")))
        return self

    def _member_score(self, member: Column) -> Column:
        out = F.lit(0.0)
        for t in self.trees:
            out = out + _tree_value(t._java_obj.rootNode(), member) * F.lit(self.rate)
        return out

    def _applied(self, rows: DataFrame, k: int) -> DataFrame:
        return self.trees[k].setPredictionCol(f"_t{k}").transform(rows)

    def _sum(self) -> Column:
        out = F.lit(0.0)
        for k in range(len(self.trees)):
            out = out + F.col(f"_t{k}") * F.lit(self.rate)
        return out

    def score(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        rows = _vectors(df, self.features).select(*keys, "features")
        for k in range(len(self.trees)):
            rows = self._applied(rows, k)
        return rows.select(*keys, self._sum().alias("score"))


def fit_models(train: DataFrame, configs: Sequence[dict], features: Sequence[str], label: str, group: str) -> dict[str, GroupedRanker | PipelineModel]:
    """One fitted ranker per configuration (name, model_class, params), by name. The class "grouped" is GroupedRanker."""
    fitted = {}
    for c in configs:
        if c["model_class"] == "grouped":
            fitted[c["name"]] = GroupedRanker(features, group, **c.get("params", {})).fit(train, label)
        else:
            fitted[c["name"]] = fit_ranker(train, features, label, c["model_class"], **c.get("params", {}))
    return fitted


def score_models(models: dict[str, GroupedRanker | PipelineModel], rows: DataFrame, features: Sequence[str], label: str, keys: Sequence[str]) -> DataFrame:
    """keys, label and a column of scores per name, each over its deviation in the list + 1."""
    from asofkit.operators.groupwise import normalised

    keys = list(keys)
    out = rows.select(*keys, F.col(label).alias("label"))
    for name, model in models.items():
        scores = model.score(rows, keys) if isinstance(model, GroupedRanker) else score(rows, model, features, keys)
        scored = normalised(scores, keys[0], "score").select(*keys, F.col("by_sd").alias(name))
        out = out.join(scored, keys)
    return out


def validate_models(train: DataFrame, val: DataFrame, configs: Sequence[dict], features: Sequence[str], label: str, keys: Sequence[str]) -> DataFrame:
    """Fits one ranker per configuration (name, model_class, params) and scores *val*: keys (the list, then what tells its members apart), label and a column
    of scores per name, each over its deviation in the list + 1."""
    return score_models(fit_models(train, configs, features, label, keys[0]), val, features, label, keys)


def train_and_submit(train: DataFrame, val: DataFrame, test: DataFrame, configs: Sequence[dict], features: Sequence[str], label: str, keys: Sequence[str], submission: Sequence[str], item: str = "item_id", rounds: int | None = None) -> tuple[dict[str, float], DataFrame]:
    """Fits all configurations once, finds the weights of their scores on *val*, in the search's own time or at most *rounds* of it, and ranks the lists of *test*: the weights, and one row per list of recommendations (columns *submission*)."""
    from asofkit.operators.metrics import blend, fit_blend, recommendations

    names = [c["name"] for c in configs]
    models = fit_models(train, configs, features, label, keys[0])
    stacked = written(score_models(models, val, features, label, keys))
    weights = fit_blend(stacked, names, keys[0], "label", rounds, tie=keys[1])
    scored = score_models(models, test.withColumn(label, F.lit(0)), features, label, keys)
    mixed = blend(test.join(scored.drop("label"), list(keys)), weights)
    return weights, recommendations(mixed, submission, item, "blend")


def usable_runs(runs: DataFrame, rows: int, least: float, group: str, score_column: str, clicked: str, tie: str = "item_id") -> DataFrame:
    """run, n, mrr of runs with exactly *rows* predictions and a mean reciprocal rank above *least*; *runs* has a column run."""
    from asofkit.operators.metrics import reciprocal_ranks

    keyed = runs.withColumn("_group", F.struct("run", group))
    per = reciprocal_ranks(keyed, "_group", score_column, clicked, tie).groupBy(F.col("_group.run").alias("run")).agg(F.avg("rr").alias("mrr"))
    counts = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == rows)
    return counts.join(per, "run").filter(F.col("mrr") > least)


def common_runs(val: DataFrame, submit: DataFrame) -> DataFrame:
    """run: the hashes at the end of file names (name) that both lists have."""
    run = F.regexp_extract("name", r"_([0-9a-f]+)\.[a-z]+$", 1).alias("run")
    return val.select(run).intersect(submit.select(run))
