"""The feature matrix of list members: branches of encoders fitted on some rows and applied to all, as sparse cells.

A cell is (keys, branch, feature, value) with a value other than 0. What is fitted are vocabularies (features with enough rows) and shifts, which are small
tables; cells stay distributed, and to_vectors() gathers the cells of one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.operators import groupwise as gw
from asofkit.operators import vectorize as vz
from asofkit.operators.side_tables import property_codes

#: So many fitted features are a table that fits into each task.
MOST_FEATURES = 1 << 16


@dataclass
class Branches:
    """Which columns go through which encoder."""

    numeric: Sequence[str] = ()  # imputed
    lagged: Sequence[str] = ()  # neighbours one place away, shifted so that the matrix gets sparse
    lagged_2: Sequence[str] = ()  # and two places away
    ranked: Sequence[str] = ()  # ranks in the list, both ways, shifted
    categorical: Mapping[str, int] = field(default_factory=dict)  # column -> least rows of a value
    bags: Mapping[str, int] = field(default_factory=dict)  # array column -> least rows of a term
    ngrams: Mapping[str, tuple[int, int]] = field(default_factory=dict)  # text column -> (n, least rows)
    maps: Sequence[str] = ()  # map<string,double> columns
    at_rank_0: Sequence[str] = ()  # value over that of the list's first member


class FeatureMatrix:
    """Encoders over rows with the columns *keys* (the first is the list, the second the place in it)."""

    def __init__(self, branches: Branches, keys: Sequence[str] = ("seq", "rank"), impute: float = vz.IMPUTE):
        self.branches, self.keys, self.impute = branches, list(keys), impute
        self.shifts: dict[str, float] = {}
        self.kept: DataFrame | None = None

    def _dense(self, df: DataFrame) -> tuple[DataFrame, dict[str, list[str]]]:
        """*df* with the columns of the dense branches, and their names by branch."""
        b, (group, order) = self.branches, self.keys[:2]
        names: dict[str, list[str]] = {"numeric": [f"{c}_imputed" for c in b.numeric]}
        out = df.withColumns({f"{c}_imputed": F.coalesce(F.col(c).cast("double"), F.lit(self.impute)) for c in b.numeric}) if b.numeric else df
        for branch, columns, reach in (("lag", b.lagged, 1), ("lag_2", b.lagged_2, 2)):
            if columns:
                copies = {f"{branch}_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
                out = gw.lag_features(out.withColumns(copies), group, order, list(copies), reach)
                names[branch] = [f"{c}_{way}_{k}{d}" for c in copies for k in range(1, reach + 1) for way in ("prev", "next") for d in ("", "_diff")]
        if b.ranked:
            copies = {f"ranked_{c}": F.col(c) for c in b.ranked}
            out = gw.rank_features(out.withColumns(copies), group, list(copies))
            names["rank"] = [f"{c}_rank_{way}" for c in copies for way in ("asc", "desc")]
        if b.at_rank_0:
            out = gw.value_at_rank(out, group, order, list(b.at_rank_0), 0, difference=False)
            over = {f"{c}_over_rank_0": F.try_divide(F.col(c).cast("double"), F.col(f"{c}_rank_0")) for c in b.at_rank_0}
            out, names["rank_0"] = out.withColumns(over), list(over)
        return out, names

    def _terms(self, df: DataFrame) -> Column:
        """All terms of a row: structs (branch, feature, value)."""
        b = self.branches
        cell = lambda branch, feature, value: F.struct(F.lit(branch).alias("branch"), feature.alias("feature"), value.cast("double").alias("value"))
        counted = lambda branch, prefix: lambda t: cell(branch, F.concat(F.lit(prefix), t), F.lit(1))
        valued = lambda prefix: lambda e: cell("map", F.concat(F.lit(prefix), e["key"]), e["value"])
        parts = [F.array(cell("categorical", F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("UNK"))), F.lit(1))) for c in b.categorical]
        parts += [F.transform(F.coalesce(c, F.array()), counted("bag", f"{c}:")) for c in b.bags]
        parts += [F.transform(vz.char_ngrams(c, n), counted("ngram", f"{c}~")) for c, (n, _) in b.ngrams.items()]
        parts += [F.transform(F.map_entries(F.coalesce(c, F.create_map())), valued(f"{c}.")) for c in b.maps]
        return F.concat(*parts) if parts else F.array().cast("array<struct<branch:string,feature:string,value:double>>")

    def _least(self) -> Column:
        """How many rows a feature needs."""
        out, name = F.lit(1), lambda sep: F.substring_index("feature", sep, 1)
        for branch, sep, table in (("categorical", "=", self.branches.categorical), ("bag", ":", self.branches.bags), ("ngram", "~", {c: n for c, (_, n) in self.branches.ngrams.items()})):
            for c, n in table.items():
                out = F.when((F.col("branch") == branch) & (name(sep) == c), n).otherwise(out)
        return out

    def _cells(self, df: DataFrame) -> DataFrame:
        rows = df.select(*self.keys, F.explode(self._terms(df)).alias("t")).select(*self.keys, "t.*")
        return rows.groupBy(*self.keys, "branch", "feature").agg(F.sum("value").alias("value"))

    def fit(self, df: DataFrame) -> FeatureMatrix:
        """Learns shifts and the features that enough rows have."""
        dense, names = self._dense(df)
        shifted = [c for branch in ("lag", "lag_2", "rank") for c in names.get(branch, [])]
        if shifted:
            # Values are counted as rows: no buffer holds all different values of a column.
            values = dense.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in shifted])).alias("x")).select("x.*").filter("v is not null")
            counts = values.groupBy("c", "v").agg(F.count(F.lit(1)).alias("k"))
            stats = counts.groupBy("c").agg(F.max_by("v", F.struct("k", -F.col("v"))).alias("m"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
            self.shifts = {r["c"]: r["m"] for r in stats if r["m"] in (r["a"], r["b"])}
        found = F.array_distinct(F.transform(self._terms(df), lambda t: F.struct(t["branch"].alias("branch"), t["feature"].alias("feature"))))
        counts = df.select(F.explode(found).alias("t")).select("t.*").groupBy("branch", "feature").agg(F.count(F.lit(1)).alias("rows"))
        self.kept = counts.filter(F.col("rows") >= self._least()).select("branch", "feature")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """The cells of *df*: keys, branch, feature, value."""
        dense, names = self._dense(df)
        cells = []
        for branch, columns in names.items():
            for c in columns:
                value = F.col(c).cast("double") - F.lit(self.shifts.get(c, 0.0))
                cells.append(F.struct(F.lit(branch).alias("branch"), F.lit(c).alias("feature"), F.coalesce(value, F.lit(0.0)).alias("value")))
        sparse = self._cells(df).join(self.kept, ["branch", "feature"]).select(*self.keys, "branch", "feature", "value")
        if cells:
            rows = dense.select(*self.keys, F.explode(F.array(*cells)).alias("t")).select(*self.keys, "t.*")
            sparse = rows.unionByName(sparse)
        return sparse.filter("value <> 0 and not isnan(value)")

    def vectors(self, df: DataFrame) -> DataFrame:
        """keys and features, a sparse vector: one for each row of *df* that has cells. Numbers are places of all fitted features in alphabetical order.

        Up to MOST_FEATURES are looked up where a row is, and no cell becomes a row of its own; beyond that cells are joined.
        """
        dense, names = self._dense(df)
        kept = [tuple(r) for r in self.kept.limit(MOST_FEATURES + 1).collect()]
        parts = sorted([(c, ("dense", c)) for columns in names.values() for c in columns] + [(f, self._owner(b, f)) for b, f in kept if f is not None])
        blocks = [(owner, [f for f, _ in rows]) for owner, rows in groupby(parts, key=lambda x: x[1])]
        if len(kept) > MOST_FEATURES or len({owner for owner, _ in blocks}) < len(blocks):
            columns = df.sparkSession.createDataFrame([(c,) for cs in names.values() for c in cs], "feature string")
            return to_vectors(self.transform(df), columns.union(self.kept.select("feature")).distinct(), self.keys)
        number = lambda c: F.nanvl(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))
        inputs, models, ngrams = {}, [], self.branches.ngrams
        for i, ((kind, c), features) in enumerate(blocks):
            name = f"_part_{i}"
            if kind == "dense":
                inputs[name] = number(F.col(c).cast("double") - F.lit(self.shifts.get(c, 0.0)))
            elif kind == "map":
                inputs[name] = number(F.try_element_at(F.col(c[0]), F.lit(c[1])))
            else:
                terms = {"categorical": lambda: F.array(F.coalesce(F.col(c).cast("string"), F.lit("UNK"))), "bag": lambda: F.coalesce(c, F.array()), "ngram": lambda: vz.char_ngrams(c, ngrams[c][0])}[kind]()
                inputs[f"_terms_{i}"] = terms
                models.append(CountVectorizerModel.from_vocabulary([f[len(c) + 1 :] for f in features], inputCol=f"_terms_{i}", outputCol=name))
        out = dense.select(*self.keys, *[value.alias(name) for name, value in inputs.items()])
        for m in models:
            out = m.transform(out)
        out = VectorAssembler(inputCols=[f"_part_{i}" for i in range(len(blocks))], outputCol="features").transform(out)
        # The array of one keeps the filter from computing the vector again.
        out = out.select(*self.keys, F.explode(F.array("features")).alias("features"))
        return out.filter(F.exists(F.unwrap_udt("features")["values"], lambda v: v != 0))

    def _owner(self, branch: str, feature: str) -> tuple:
        """Which column a fitted feature is of; a key of a map stands alone."""
        b = self.branches
        sep, columns = {"categorical": ("=", b.categorical), "bag": (":", b.bags), "ngram": ("~", b.ngrams), "map": (".", b.maps)}[branch]
        c = next(c for c in sorted(columns, key=len, reverse=True) if feature.startswith(c + sep))
        return ("map", (c, feature[len(c) + 1 :])) if branch == "map" else (branch, c)


def to_vectors(cells: DataFrame, features: DataFrame, keys: Sequence[str] = ("seq", "rank")) -> DataFrame:
    """keys and features, a sparse vector: one for each row that has cells. *features* has feature; its numbers are places in alphabetical order."""
    codes = property_codes(features.groupBy().agg(F.collect_set("feature").alias("properties")).select(F.explode(F.array("properties")).alias("properties")))
    size = codes.count()

    @F.udf(VectorUDT())
    def vector(at, values):
        return SparseVector(size, at, values)

    numbered = cells.join(codes.withColumnRenamed("property", "feature"), "feature")
    rows = numbered.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("code", "value"))).alias("x"))
    return rows.select(*keys, vector("x.code", "x.value").alias("features"))


def engineered(obs: DataFrame, *, codes: Mapping[str, str], continents: Mapping[str, str], tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Derived columns of list members, and what side tables have for them.

    *codes* maps countries to platforms, *continents* platforms to continents; *tables* name -> (table, the columns it is joined by). Of obs are used: city, platform,
    user_id, ts, rank, item_id, last_item, last_index, user_item_clicks, user_item_impressions.
    """
    from asofkit.functions.scalars import country_is_platform, country_of, lookup

    when = F.timestamp_seconds("ts")
    out = obs.withColumns(
        {
            "country": country_of("city"),
            "continent": lookup("platform", dict(continents)),
            "country_eq_platform": country_is_platform("city", "platform", dict(codes)),
            "item_id_cat": F.col("item_id").cast("string"),
            "clicked_before": F.coalesce(F.col("item_id") == F.col("last_item"), F.lit(False)).cast("int"),
            "is_rank_greater_than_prv_click": F.coalesce(F.col("rank") > F.col("last_index"), F.lit(False)).cast("int"),
            "user_item_ctr": F.col("user_item_clicks") / (F.col("user_item_impressions") + 1),
            "user_id_1cat": F.substring(F.col("user_id").cast("string"), 1, 1),
            "hour": F.hour(when),
            "minute": F.minute(when),
        }
    )
    for table, by in tables.values():
        out = out.join(table, list(by), "left")
    return out


def strict_lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """*df* with the *value* that *table* has for its keys; a row without one fails the query."""
    found = table.select(*keys, F.struct(value).alias("_found"))
    missing = F.raise_error(F.concat(F.lit(f"no {value} for "), F.to_json(F.struct(*keys))))
    joined = df.join(found, list(keys), "left")
    return joined.select(*df.columns, F.when(F.col("_found").isNull(), missing.cast(dict(table.dtypes)[value])).otherwise(F.col(f"_found.{value}")).alias(value))


def side_by_side(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The columns of several feature tables of the same rows, put together by their keys and not by their order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(keys))
    return out


def row_range(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """The rows with a key from *low* to *high*: a contiguous slice of a stored matrix, pushed down to the scan."""
    return df.filter(F.col(key).between(low, high))
