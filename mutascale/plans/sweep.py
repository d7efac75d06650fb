"""The scenario sweep: how well does a panel's burden, calibrated on training samples, predict exome burden?

For each panel and each scenario (class list, hotspot filter, VAF cut-off, recall, precision) the variants inside the
panel are filtered and counted per sample, a line from panel burden to exome burden is fitted on the training samples
(each sample weighted by its number of counted variants) and scored on the test samples.

Nothing here runs once per scenario:

1. ``sample_cells`` reduces the overlapped variants of a panel and sample to a short list of cells and merges samples with
   equal lists; only test samples are told apart by their burden.
2. ``vector_table`` expands the lists to one counter per class group for each cut-off and hotspot flag, of which the count
   under any class list is a sum, and merges equal ones. ``count_table`` expands these to the class lists by projection and
   aggregates at once per (panel, filter, count).
3. From there all fits and scores depend only on how many samples share a count, so the recall/precision pairs are
   expanded on a table that holds one row per (panel, filter, count) and no longer grows with the samples.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutascale.functions.scalar import strip_panel_suffix
from mutascale.session import shuffle_width

# The variant classes always counted and the optional ones, the accuracy scale, the VAF cut-offs.
BASE_CLASSES = ["Frame_Shift_Del", "Frame_Shift_Ins", "In_Frame_Del", "In_Frame_Ins", "Missense_Mutation"]
OPTIONAL_CLASSES = {
    "nonsense": "Nonsense_Mutation",
    "nonstop": "Nonstop_Mutation",
    "synonymous": "Synonymous_Mutation",
    "silent": "Silent",
    "splice_site": "Splice_Site",
    "translation_start_site": "Translation_Start_Site",
}
ACCURACY_SCALE = [1.0, 0.9, 0.8, 0.7, 0.6, 0.5]
VAF_CUTOFFS = [0.01, 0.02, 0.03, 0.05, 0.10]
DEFAULT_VAF_CUTOFF = 0.05
MAX_COSMIC = 20.0
MAX_BURDEN = 100.0
HIGH_BURDEN = 10.0

RESULT_COLUMNS = [
    "panel_id", "method", "exonic_size", "recall", "precision", *OPTIONAL_CLASSES, "hotspot", "vaf_cutoff",
    "coef", "intercept", "whfh", "wlfl", "whfl", "wlfh", "r2", "rmsle", "ccc", "acc",
]


@dataclass(frozen=True)
class Grid:
    """Which dimensions the sweep varies; a dimension switched off keeps its default value."""

    somatic_accuracy: bool = True
    gene_content: bool = True
    hotspot_filter: bool = True
    vaf_cutoff: bool = True
    pairing: str = "product"
    scale: list[float] = field(default_factory=lambda: list(ACCURACY_SCALE))
    cutoffs: list[float] = field(default_factory=lambda: list(VAF_CUTOFFS))
    pairs: list[tuple[float, float]] | None = None
    masks: list[int] | None = None
    kinds: list[tuple[bool, float]] | None = None

    def accuracy_pairs(self) -> dict[tuple[float, float], int]:
        """Distinct (recall, precision) pairs with their number of repeats.

        The admitted pairs have recall above precision, or are both 1. ``zip`` takes them as they are. ``product``
        crosses the recalls of the admitted pairs with their precisions, so pairs repeat. Given ``pairs`` win.
        """
        if self.pairs is not None:
            return dict.fromkeys(self.pairs, 1)
        if self.pairing not in ("product", "zip"):
            raise ValueError("pairing is 'product' or 'zip'")
        if not self.somatic_accuracy:
            return {(1.0, 1.0): 1}
        admitted = [(r, p) for r, p in product(self.scale, self.scale) if r > p or r == p == 1.0]
        if self.pairing == "zip":
            return dict.fromkeys(admitted, 1)
        repeats: dict[tuple[float, float], int] = {}
        for (recall, _), (_, precision) in product(admitted, admitted):
            repeats[recall, precision] = repeats.get((recall, precision), 0) + 1
        return repeats

    def cutoff_values(self) -> list[float]:
        if self.kinds is not None:
            return sorted({cutoff for _, cutoff in self.kinds})
        return self.cutoffs if self.vaf_cutoff else [DEFAULT_VAF_CUTOFF]

    def hotspot_values(self) -> list[bool]:
        return [True, False] if self.hotspot_filter else [False]

    def filter_kinds(self) -> list[tuple[bool, float]]:
        """The (hotspot, VAF cut-off) combinations; a filter's place is its index here. Given ``kinds`` win."""
        return self.kinds if self.kinds is not None else list(product(self.hotspot_values(), self.cutoff_values()))

    def class_masks(self) -> Column:
        """Array of bit masks over the optional classes: all non-empty subsets, only the empty one, or those given."""
        if self.masks is not None:
            return F.array(*[F.lit(m) for m in self.masks])
        if not self.gene_content:
            return F.array(F.lit(0))
        return F.sequence(F.lit(1), F.lit(2 ** len(OPTIONAL_CLASSES) - 1))


def class_in_mask(position: int) -> Column:
    """Is the optional class at this position part of the mask?"""
    return F.col("mask").bitwiseAND(F.lit(1 << position)) > 0


def _pairs_array(grid: Grid) -> Column:
    return F.array(*[
        F.struct(F.lit(r).alias("recall"), F.lit(p).alias("precision"), F.lit(m).cast("long").alias("multiplicity"))
        for (r, p), m in grid.accuracy_pairs().items()
    ])


def with_scenarios(df: DataFrame, grid: Grid) -> DataFrame:
    """Every row (a panel, say) with every distinct scenario of the grid; ``multiplicity`` counts the repeats."""
    filters = F.array(*[
        F.struct(F.lit(h).alias("hotspot"), F.lit(v).alias("vaf_cutoff")) for h, v in grid.filter_kinds()
    ])
    wide = (
        df.withColumn("__pair", F.explode(_pairs_array(grid)))
        .withColumn("mask", F.explode(grid.class_masks()))
        .withColumn("__filter", F.explode(filters))
    )
    chosen = F.array(*[
        F.when(class_in_mask(i), F.lit(name)) for i, name in enumerate(OPTIONAL_CLASSES.values())
    ])
    classes = F.concat(F.array(*[F.lit(c) for c in BASE_CLASSES]), F.array_compact(chosen))
    return wide.select(*df.columns, "__pair.*", "mask", classes.alias("classes"), "__filter.*")


def scenario_filter(variant_class: Column, vaf: Column, hot: Column) -> Column:
    """The filter a scenario row applies to a variant row beside it."""
    kept = F.when(F.col("hotspot"), ~hot).otherwise(F.lit(True))
    return F.array_contains(F.col("classes"), variant_class) & (vaf >= F.col("vaf_cutoff")) & kept


def is_hot() -> Column:
    """Variant removed by the hotspot filter: known hotspot, known clinically, common, or unknown in any of these."""
    plain = ~F.col("cancerhotspot") & ~F.col("civic") & (F.col("cosmic96_coding") < MAX_COSMIC)
    return ~F.coalesce(plain, F.lit(False))


def sample_cells(overlaps: DataFrame, grid: Grid, width: int) -> DataFrame:
    """Samples of a panel with equal ``cells``, and for test samples the same burden y, become one row.

    ``overlaps`` has panel, sample, is_test, type, vaf, hot, wesTMB, rate; the last two of a sample are constant. A cell
    counts the rows of one class group, number of cut-offs reached and hotspot flag; a sample has a few dozen at most.
    Training samples are only ever summed, so they share y = null. The rows are dealt to ``width`` tasks once, by panel and
    sample: the cells and the lists are made where they lie.
    """
    groups = [F.col("type").isin(BASE_CLASSES)]
    if grid.gene_content:
        groups += [F.col("type") == name for name in OPTIONAL_CLASSES.values()]
    group = F.coalesce(*[F.when(member, F.lit(i)) for i, member in enumerate(groups)])
    level = sum((F.when(F.col("vaf") >= c, F.lit(1)).otherwise(F.lit(0)) for c in grid.cutoff_values()), F.lit(0))
    # Kept: a row of unknown flag that reaches a cut-off counts under all of them, where the hotspot filter is off. The SQL of
    # the queries looks at its VAF instead; see REPLY_r03.md.
    level = F.when(F.col("hot").isNull() & (level > 0), F.lit(len(grid.cutoff_values()))).otherwise(level)
    hot = F.coalesce("hot", F.lit(True)).alias("hot")
    constants = [F.max("y").alias("y"), F.bool_or("rate").alias("rate")]
    cells = (
        overlaps.select(
            "panel", "sample", "is_test", F.col("wesTMB").alias("y"), "rate", hot,
            group.alias("group"), level.alias("level"),
        )
        .where(F.col("group").isNotNull() & (F.col("level") > 0))
        .repartition(width, "panel", "sample")
        .groupBy("panel", "sample", "is_test", "group", "level", "hot")
        .agg(F.count(F.lit(1)).alias("m"), *constants)
    )
    listed = F.array_sort(F.collect_list(F.struct("group", "level", "hot", "m")))
    samples = cells.groupBy("panel", "sample", "is_test").agg(*constants, listed.alias("cells"))
    test, train = F.col("is_test"), ~F.col("is_test")
    train_y = F.when(train, F.col("y"))
    return (
        samples.select("panel", "cells", F.when(test, F.col("y")).alias("test_y"), "is_test", "y", "rate")
        .repartition(width, "panel", "cells", "test_y")
        .groupBy("panel", "cells", "test_y")
        .agg(
            F.count_if(train).alias("train"),
            F.coalesce(F.sum(train_y), F.lit(0.0)).alias("train_y"),
            F.min(train_y).alias("train_min"),
            F.max(train_y).alias("train_max"),
            F.count_if(test & F.col("rate")).alias("high"),
            F.count_if(test & ~F.col("rate")).alias("low"),
        )
    )


def _summed() -> list[Column]:
    """What merged rows of samples add up to."""
    return [
        F.sum("train").alias("train"),
        F.sum("train_y").alias("train_y"),
        F.min("train_min").alias("train_min"),
        F.max("train_max").alias("train_max"),
        F.sum("high").alias("high"),
        F.sum("low").alias("low"),
    ]


def vector_table(merged: DataFrame, grid: Grid, width: int) -> DataFrame:
    """Counters g0 (base classes), g1, ... (optional classes) per panel and place ``at`` in the grid's filters.

    Lists of cells with the same counters, and for test samples the same burden, become one row. From here on the work
    follows the number of distinct count vectors, which grows far slower than the samples. Vectors of a base count lie
    together, so that their expansion by ``count_table`` meets most of its equal keys in one task.
    """
    # For each (level, hot) the places of the filters that let it pass.
    cutoffs, kinds = sorted(grid.cutoff_values()), grid.filter_kinds()
    places = F.array(*[
        F.array(*[F.lit(at) for at, (hotspot, cutoff) in enumerate(kinds)
                  if cutoff <= cutoffs[reached] and not (hotspot and hot)]).cast("array<int>")
        for reached in range(len(cutoffs)) for hot in (False, True)
    ])
    passed = F.element_at(places, (F.col("cell.level") - 1) * 2 + F.col("cell.hot").cast("int") + 1)
    counters = [
        F.sum(F.when(F.col("cell.group") == i, F.col("cell.m")).otherwise(F.lit(0))).alias(f"g{i}")
        for i in range(len(OPTIONAL_CLASSES) + 1 if grid.gene_content else 1)
    ]
    sums = [c for c in merged.columns if c not in ("panel", "cells", "test_y")]
    counted = (
        merged.withColumn("cell", F.explode("cells"))
        .withColumn("at", F.explode(passed))
        .groupBy("panel", "cells", "test_y", "at")
        .agg(*counters, *[F.first(c).alias(c) for c in sums])
        .drop("cells")
    )
    names = [f"g{i}" for i in range(len(counters))]
    return counted.repartition(width, "panel", "at", "g0").groupBy("panel", "at", *names, "test_y").agg(*_summed())


def count_table(vectors: DataFrame, grid: Grid, filters: DataFrame | None = None) -> DataFrame:
    """Samples per panel, filter, count n and, for test samples, exome burden y.

    ``filter`` packs the class mask and the place in the grid's filters into one number. With ``filters``, a table of such
    numbers, vectors meet the masks that are listed for their place by an equality; otherwise all masks of the grid.
    """
    n = F.col("g0")
    if grid.gene_content:
        for i in range(len(OPTIONAL_CLASSES)):
            n = n + F.when(class_in_mask(i), F.col(f"g{i + 1}")).otherwise(F.lit(0))
    if filters is None:
        masked = vectors.withColumn("mask", F.explode(grid.class_masks()))
    else:
        masked = vectors.join(filters.select(*_unpacked()).hint("rebalance"), "at")
    expanded = masked.select(
        "panel", (F.col("at") * MASKS + F.col("mask")).alias("filter"), n.alias("n"), F.col("test_y").alias("y"),
        "train", "train_y", "train_min", "train_max", "high", "low",
    )
    return (
        expanded.where(F.col("n") > 0)
        .groupBy(*FILTER, "n", "y")
        .agg(*_summed())
    )


MASKS = 2 ** len(OPTIONAL_CLASSES)
FILTER = ["panel", "filter"]


def _unpacked() -> list[Column]:
    """Place and class mask of a packed filter."""
    return [
        F.floor(F.col("filter") / MASKS).cast("int").alias("at"), F.col("filter").bitwiseAND(F.lit(MASKS - 1)).cast("int").alias("mask"),
    ]


def unpack_filter(grid: Grid) -> dict[str, Column]:
    """Class mask, hotspot flag and VAF cut-off of a packed filter."""
    kinds = grid.filter_kinds()
    at = F.floor(F.col("filter") / MASKS).cast("int") + 1
    return {
        "mask": F.col("filter").bitwiseAND(F.lit(MASKS - 1)),
        "hotspot": F.element_at(F.array(*[F.lit(h) for h, _ in kinds]), at),
        "vaf_cutoff": F.element_at(F.array(*[F.lit(v) for _, v in kinds]), at),
    }


def per_count_moments(table: DataFrame) -> DataFrame:
    """One row per (panel, filter, count n): training sums, test sums and the distinct test burdens at that count.

    Test samples whose prediction is clipped share one predicted value, and concordance looks at distinct
    (prediction, burden) pairs. The prediction is monotone in n, so the clipped counts are the smallest or the largest:
    a burden is counted once there, either at the first or at the last n it occurs with.
    """
    test = F.col("high") + F.col("low")
    seen = F.when(test > 0, F.col("n"))
    # Bounded window: one row per distinct count of the same panel, filter and burden.
    same_burden = Window.partitionBy(*FILTER, "y")
    spread = table.withColumns({"first_n": F.min(seen).over(same_burden), "last_n": F.max(seen).over(same_burden)})
    y = F.col("y")
    log_y = F.log1p(y)

    def points(prefix: str, chosen: Column) -> list[Column]:
        return [
            F.count_if(chosen).alias(f"{prefix}_k"),
            F.sum(F.when(chosen, y).otherwise(0.0)).alias(f"{prefix}_y"),
            F.sum(F.when(chosen, y * y).otherwise(0.0)).alias(f"{prefix}_yy"),
        ]

    return spread.groupBy(*FILTER, "n").agg(
        F.sum("train").alias("train"),
        F.sum("train_y").alias("train_y"),
        F.min("train_min").alias("train_min"),
        F.max("train_max").alias("train_max"),
        F.sum("high").alias("high"),
        F.sum("low").alias("low"),
        F.sum(F.when(test > 0, test * y).otherwise(0.0)).alias("test_y"),
        F.sum(F.when(test > 0, test * y * y).otherwise(0.0)).alias("test_yy"),
        F.sum(F.when(test > 0, test * log_y).otherwise(0.0)).alias("test_l"),
        F.sum(F.when(test > 0, test * log_y * log_y).otherwise(0.0)).alias("test_ll"),
        F.min(F.when(test > 0, y)).alias("min_y"),
        F.max(F.when(test > 0, y)).alias("max_y"),
        *points("here", test > 0),
        *points("first", F.col("n") == F.col("first_n")),
        *points("last", F.col("n") == F.col("last_n")),
    )


def with_fit(moments: DataFrame, lengths: DataFrame) -> DataFrame:
    """Attach to each row the line fitted on the training samples of its panel and filter.

    The windows hold one row per distinct count, not one per sample. Filters without training or without test samples
    are dropped.
    """
    whole = Window.partitionBy(*FILTER)
    x = F.col("n") / F.col("panel_mb")
    w = F.col("n") * F.col("train")
    wy = F.col("n") * F.col("train_y")
    trained = F.when(F.col("train") > 0, F.col("n"))
    totals = {
        "w": F.sum(w), "wx": F.sum(w * x), "wy": F.sum(wy),
        "n_test": F.sum(F.col("high") + F.col("low")), "low_n": F.min(trained), "high_n": F.max(trained),
        "low_y": F.min("train_min"), "high_y": F.max("train_max"),
    }
    # co-moments about the means: raw powers would cancel where x is large against its spread
    mean_x, mean_y = F.col("wx") / F.col("w"), F.try_divide(F.col("wy"), F.col("w"))
    away = x - mean_x
    spreads = {"sxx": F.sum(w * away * away), "sxy": F.sum(away * (wy - w * mean_y))}
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    # A constant side gives exactly 0; rounding in the sums must not invent a slope.
    varies = (F.col("low_n") < F.col("high_n")) & (F.col("low_y") < F.col("high_y"))
    fitted = (
        moments.join(lengths, "panel")
        .withColumns({name: value.over(whole) for name, value in totals.items()})
        .where((F.col("w") > 0) & (F.col("n_test") > 0))
        .withColumns({name: value.over(whole) for name, value in spreads.items()})
        .withColumn("coef", F.when(varies, slope).otherwise(F.lit(0.0)))
        .withColumn("intercept", mean_y - F.col("coef") * mean_x)
    )
    return fitted.where(F.col("high") + F.col("low") > 0).drop(*totals, *spreads, "train", "train_y", "train_min", "train_max")


def score(fitted: DataFrame, grid: Grid, listed: DataFrame | None = None) -> DataFrame:
    """Scores per panel and scenario. The rows are already partitioned by panel and filter: no further shuffle.

    With ``listed`` (filter, recall, precision) a filter meets the pairs that are listed for it, otherwise all of the grid.
    """
    if listed is None:
        pairs = fitted.withColumn("__pair", F.explode(_pairs_array(grid))).select(*fitted.columns, "__pair.*")
    else:
        pairs = fitted.join(listed.withColumn("multiplicity", F.lit(1).cast("long")).hint("rebalance"), "filter")
    factor = F.lit(1.0) + (F.lit(1.0) / F.col("recall") - F.lit(1.0) / F.col("precision"))
    predicted = F.col("n") * factor / F.col("panel_mb") * F.col("coef") + F.col("intercept")
    rows = (
        pairs.withColumn("p", predicted)
        .withColumn("f", F.greatest("p", F.lit(0.0)))
        .withColumn("tilt", F.col("coef") * factor)
        .withColumn("shared", (F.col("tilt") == 0) | (F.col("p") <= 0))
    )
    f, p, n = F.col("f"), F.col("p"), F.col("n")
    test = F.col("high") + F.col("low")
    predicted_high = f >= HIGH_BURDEN

    def votes(flag: Column, samples: str) -> Column:
        return F.sum(F.when(flag, n * F.col(samples)).otherwise(F.lit(0).cast("long")))

    def point(what: str) -> Column:
        clipped = F.when(F.col("tilt") >= 0, F.col(f"first_{what}")).otherwise(F.col(f"last_{what}"))
        return F.when(F.col("shared"), clipped).otherwise(F.col(f"here_{what}"))

    # Points of the concordance: every distinct pair once; the shared prediction is one value.
    k, ky, kyy = point("k"), point("y"), point("yy")
    log_f = F.log1p(f)
    sums = rows.groupBy(*FILTER, "recall", "precision", "multiplicity").agg(
        F.first("panel_mb").alias("panel_mb"),
        F.first("coef").alias("coef"),
        F.first("intercept").alias("intercept"),
        votes(predicted_high, "high").alias("whfh"),
        votes(~predicted_high, "low").alias("wlfl"),
        votes(~predicted_high, "high").alias("whfl"),
        votes(predicted_high, "low").alias("wlfh"),
        F.sum(test).alias("m"),
        F.sum("test_y").alias("sy"),
        F.sum("test_yy").alias("syy"),
        F.sum(F.col("test_yy") - F.lit(2.0) * p * F.col("test_y") + p * p * test).alias("ss_res"),
        F.sum(F.col("test_ll") - F.lit(2.0) * log_f * F.col("test_l") + log_f * log_f * test).alias("ss_log"),
        F.min("min_y").alias("min_y"),
        F.max("max_y").alias("max_y"),
        F.min("f").alias("min_f"),
        F.max("f").alias("max_f"),
        F.sum(k).alias("k"),
        F.sum(ky).alias("ky"),
        F.sum(kyy).alias("kyy"),
        F.sum(k * f).alias("kf"),
        F.sum(k * f * f).alias("kff"),
        F.sum(ky * f).alias("kfy"),
    )
    m, kk = F.col("m"), F.col("k")
    y_varies = F.col("min_y") < F.col("max_y")
    total = F.col("syy") - F.col("sy") * F.col("sy") / m
    var_y = F.col("kyy") / kk - F.pow(F.col("ky") / kk, F.lit(2.0))
    var_f = F.col("kff") / kk - F.pow(F.col("kf") / kk, F.lit(2.0))
    cov = F.col("kfy") / kk - F.col("kf") / kk * F.col("ky") / kk
    shift = F.col("ky") / kk - F.col("kf") / kk
    cells = F.col("whfh") + F.col("wlfl") + F.col("whfl") + F.col("wlfh")
    return sums.withColumns(unpack_filter(grid)).select(
        "panel", "mask", "hotspot", "vaf_cutoff", "recall", "precision", "multiplicity", "panel_mb", "coef", "intercept",
        "whfh", "wlfl", "whfl", "wlfh",
        F.when(y_varies, F.lit(1.0) - F.col("ss_res") / total).alias("r2"),
        F.sqrt(F.greatest(F.col("ss_log"), F.lit(0.0)) / m).alias("rmsle"),
        F.when(
            y_varies & (F.col("min_f") < F.col("max_f")),
            F.lit(2.0) * cov / (var_y + var_f + shift * shift),
        ).alias("ccc"),
        ((F.col("whfh") + F.col("wlfl")) / cells).alias("acc"),
    )


def sweep(overlaps: DataFrame, lengths: DataFrame, grid: Grid | None = None, expand: bool = False) -> DataFrame:
    """Score every panel under every scenario.

    ``overlaps`` holds the variants inside each panel (see ``sample_cells`` for its columns); rows above the largest
    admitted exome burden, or without one, are dropped. ``lengths`` has panel and panel_mb. With ``expand`` a repeated
    scenario appears as often as the grid repeats it.
    """
    grid = grid or Grid()
    admitted = overlaps.where(F.col("wesTMB") <= MAX_BURDEN)
    width = shuffle_width(overlaps)
    vectors = vector_table(sample_cells(admitted, grid, width), grid, width)
    moments = per_count_moments(count_table(vectors, grid))
    named = _named(score(with_fit(moments, lengths), grid))
    if expand:
        copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("multiplicity")))
        return named.withColumn("__copy", copies).select(*RESULT_COLUMNS)
    return named.select(*RESULT_COLUMNS, "multiplicity")


def _named(scored: DataFrame) -> DataFrame:
    """Scores under their published names, with a flag for each optional class."""
    flags = [class_in_mask(i).alias(name) for i, name in enumerate(OPTIONAL_CLASSES)]
    return scored.select(
        F.col("panel").alias("panel_id"),
        strip_panel_suffix(F.col("panel")).alias("method"),
        F.col("panel_mb").alias("exonic_size"),
        "recall", "precision", *flags, "hotspot", "vaf_cutoff", "coef", "intercept",
        "whfh", "wlfl", "whfl", "wlfh", "r2", "rmsle", "ccc", "acc", "multiplicity",
    )


def sweep_scenarios(overlaps: DataFrame, lengths: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Score every panel under a stored list of scenarios (recall, precision, classes, hotspot, vaf_cutoff).

    Each scenario is a packed filter with a pair. Vectors of counters meet the listed masks of their filter, and fitted
    filters the listed pairs, by equality joins on integers, so the work follows the list and not what its values span. Only
    the distinct (hotspot, cut-off) combinations are collected, because cells are expanded to them by projection; they
    are looked up as the doubles that were collected. Every class list must hold the base classes and otherwise optional
    ones. Repeated scenarios count once.
    """
    known = [*BASE_CLASSES, *OPTIONAL_CLASSES.values()]
    odd = (F.size(F.array_except("classes", F.array(*[F.lit(c) for c in known]))) > 0) | (
        F.size(F.array_except(F.array(*[F.lit(c) for c in BASE_CLASSES]), F.col("classes"))) > 0
    )
    if not scenarios.where(odd).isEmpty():
        raise ValueError("a class list lacks a base class or names an unknown class")
    kinds = sorted((r["hotspot"], r["vaf_cutoff"]) for r in scenarios.select("hotspot", "vaf_cutoff").distinct().collect())
    grid = Grid(kinds=kinds)
    flags = [F.array_contains("classes", name).cast("int") * (1 << i) for i, name in enumerate(OPTIONAL_CLASSES.values())]
    mask = sum(flags, F.lit(0))
    places = F.array(*[F.struct(F.lit(h).alias("hotspot"), F.lit(v).alias("vaf_cutoff")) for h, v in kinds])
    at = F.array_position(places, F.struct("hotspot", "vaf_cutoff")) - 1
    listed = scenarios.select((at * MASKS + mask).alias("filter"), "recall", "precision").distinct()
    width = shuffle_width(overlaps)
    cells = sample_cells(overlaps.where(F.col("wesTMB") <= MAX_BURDEN), grid, width)
    table = count_table(vector_table(cells, grid, width), grid, listed.select("filter").distinct())
    scored = score(with_fit(per_count_moments(table), lengths), grid, listed)
    return _named(scored).select(*RESULT_COLUMNS)
