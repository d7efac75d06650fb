"""Lab and product effects on measured burden: the model family, both ANOVA types, and their export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutascale.functions.scalar import map_values, not_equal_or_null
from mutascale.operators.anova import LinearModel, anova_table, fit

COVARIATE = "reference wesTMB"

# The known burden of the five reference samples.
REFERENCE_BURDEN = {"A1": 103.0021, "B1": 148.34, "C1": 112.2377, "D1": 4.97, "E1": 0.0}


def with_reference_burden(observations: DataFrame) -> DataFrame:
    """Attach the known burden of the sample; an unknown sample gives null and leaves the fits."""
    return observations.withColumn(COVARIATE, map_values(F.col("sample"), REFERENCE_BURDEN))


def _crossed(first: str, second: str) -> list[tuple[str, ...]]:
    return [(first,), (second,), (first, second)]


def model_family() -> dict[str, tuple[LinearModel, bool]]:
    """Name -> (model, whether it leaves out the group ``other``)."""
    r = (COVARIATE,)
    panel, product, sample, group = ("panel_id",), ("product",), ("sample",), ("group",)

    def model(factors: list[str], terms: list[tuple[str, ...]]) -> LinearModel:
        return LinearModel("wesTMB", tuple(factors), (COVARIATE,), tuple(terms))

    with_sample = ["panel_id", "product", "sample"]
    return {
        "product_crossed": (model(with_sample, [*_crossed("panel_id", "product"), sample, r]), False),
        "product_additive": (model(with_sample, [panel, product, sample, r]), False),
        "sample_by_reference": (model(with_sample, [panel, product, sample, r, ("sample", COVARIATE)]), False),
        "named_groups_crossed": (model(["panel_id", "product"], [*_crossed("panel_id", "product"), r]), True),
        "named_groups_additive": (model(["panel_id", "product"], [panel, product, r]), True),
        "group_crossed": (model(["panel_id", "group"], [*_crossed("panel_id", "group"), r]), False),
        "group_additive": (model(["panel_id", "group"], [panel, group, r]), False),
    }


def effect_tables(observations: DataFrame) -> DataFrame:
    """All ANOVA tables of the family in long form: model, typ, and the columns of ``anova_table``."""
    data = with_reference_burden(observations)
    tables = []
    for name, (model, named_only) in model_family().items():
        rows = data.where(not_equal_or_null(F.col("group"), "other")) if named_only else data
        result = fit(rows, model)
        for typ in (2, 3):
            table = anova_table(rows, model, typ, result)
            tables.append(table.select(F.lit(name).alias("model"), F.lit(typ).alias("typ"), *table.columns))
    return reduce(DataFrame.unionByName, tables)


def effect_export(tables: DataFrame, model: str) -> DataFrame:
    """The exported view of a type 3 table: factor, F, PR(>F), eta_sq."""
    chosen = tables.where((F.col("model") == model) & (F.col("typ") == 3)).orderBy("term_order")
    return chosen.select("factor", "F", F.col("p_value").alias("PR(>F)"), "eta_sq")
