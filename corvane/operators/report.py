"""Tables behind reports: results in foreign layouts, reduction summaries, audits, projections' limits, validated joins, samples."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.functions import keys, naming, stats

# Names that columns go by in foreign tables, first come first.
STAGES = ("scenario", "stage", "evaluation_stage", "evaluation", "set", "dataset", "eval_set")
INPUT_COUNTS = ("n_input", "n_in", "n_total", "input_n", "total_input", "n_before")
REDUCED_COUNTS = ("n_reduced", "n_out", "n_kept", "kept_n", "n_after", "n_retained")
FRACTIONS = ("kept_fraction", "retained_fraction", "fraction_kept", "kept_frac")
PERCENTS = ("retained_percent", "kept_percent", "percent_retained")
PARAMETERS = ("percentile", "min_seq_id", "threshold", "parameter_value")
UNIT_COLUMNS = ("representation", "algorithm", "config", "seed")


def _first(df: DataFrame, names: Iterable[str]) -> str | None:
    there = {c.lower(): c for c in reversed(df.columns)}
    return next((there[n] for n in names if n in there), None)


def as_metric(df: DataFrame, metric: str = "mcc", pattern: str = "mcc|matthews") -> DataFrame:
    """A long table of metric and value as one of that metric; a table that has the metric's column stays."""
    if _first(df, [metric]):
        return df
    name, value = _first(df, ["metric", "metric_name"]), _first(df, ["value", "metric_value", "score"])
    if not name or not value:
        return df
    return df.where(F.lower(F.col(name).cast("string")).rlike(pattern)).withColumn(metric, F.col(value).cast("string").try_cast("double"))


def test_rows(df: DataFrame) -> DataFrame:
    """Rows whose first stage-like column that ever says "test" says so; all rows if none does."""
    for name in STAGES:
        if (c := _first(df, [name])) and (found := df.where(F.lower(F.col(c).cast("string")).contains("test"))).limit(1).count():
            return found
    return df


test_rows.__test__ = False


def evaluation_unit(df: DataFrame, columns: Iterable[str] = UNIT_COLUMNS) -> DataFrame:
    """df with evaluation_unit, of the columns it has."""
    return df.withColumn("evaluation_unit", keys.combo_key(df, columns, "|", "nan"))


def reduction_summary(df: DataFrame, label: str, kind: str) -> DataFrame:
    """A reducer's summary in the common layout, whatever names it uses: parameter, counts, retained and removed percent."""
    parameter = _first(df, PARAMETERS)
    n_in, n_out, fraction, percent = (_first(df, names) for names in (INPUT_COUNTS, REDUCED_COUNTS, FRACTIONS, PERCENTS))
    if not parameter or not (fraction or percent or n_in and n_out):
        raise ValueError(f"no parameter or retained share among {', '.join(df.columns)}")
    number = lambda c: F.col(c).cast("string").try_cast("double") if c else F.lit(None).cast("double")
    named = {"percentile": "percentile", "min_seq_id": "min_seq_id", "threshold": "min_seq_id" if kind == "homology" else "threshold"}
    if fraction:
        # Percentages, if the largest says so: one number over the summary's few rows.
        share = number(fraction) / F.when(F.max(number(fraction)).over(Window.partitionBy(F.lit(1))) > 1.5, 100.0).otherwise(1.0)
    else:
        share = number(percent) / 100 if percent else stats.ratio(number(n_out), number(n_in))
    out = df.select(F.lit(label).alias("dataset_reduction_label"), F.lit(kind).alias("reduction_kind"), F.lit(named.get(parameter, "parameter")).alias("parameter_type"), number(parameter).alias("parameter_value"), number(n_in).cast("long").alias("n_input"), number(n_out).cast("long").alias("n_reduced"), share.alias("retained_fraction"))
    return out.withColumns({"retained_percent": F.col("retained_fraction") * 100, "removed_percent": 100 - F.col("retained_fraction") * 100})


def compact_counts(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """counts: a JSON object of each value's rows, values ascending; groups have few values."""
    each = df.groupBy(*by, column).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("k"), "n")))
    return each.groupBy(*by).agg(F.to_json(F.map_from_entries(pairs)).alias("counts"))


def balance(df: DataFrame, label: str, by: list[str] = ()) -> DataFrame:
    """Distinct classes, their counts and the share of ones."""
    y = F.col(label)
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(y == 1).alias("n_1"), F.count_if(y == 0).alias("n_0"), F.count_distinct(y).alias("n_classes"))
    return out.withColumn("fraction_1", stats.ratio(F.col("n_1"), F.col("n_1") + F.col("n_0")))


def coverage(summary: DataFrame, parameter: float, original: int) -> DataFrame:
    """Retained share and class balance of each model at one parameter of its reduction ladder."""
    at = summary.where(F.abs(F.col("percentile") - parameter) <= 1e-10)
    return at.select("model", "n_reduced", stats.ratio(F.col("n_reduced"), F.lit(original)).alias("coverage"), stats.ratio(F.col("n_1"), F.col("n_0") + F.col("n_1")).alias("fraction_1"))


def limits(df: DataFrame, columns: list[str], by: list[str] = (), padding: float = 0.05) -> DataFrame:
    """Lower and upper limit of each column, widened by a share of its range."""
    out = []
    for c in columns:
        lo, hi = F.min(c).cast("double"), F.max(c).cast("double")
        out += [(lo - (hi - lo) * padding).alias(f"{c}_low"), (hi + (hi - lo) * padding).alias(f"{c}_high")]
    return df.groupBy(*by).agg(*out)


def audit(df: DataFrame, scaler: str, experiment: str, space: str, spaces: list[str]) -> DataFrame:
    """Rows, experiments and rows of unknown spaces for each scaler."""
    return df.groupBy(F.when(naming.unscaled(F.col(scaler)), "none").otherwise(F.col(scaler)).alias("scaler")).agg(F.count("*").alias("n_rows"), F.count_distinct(experiment).alias("n_experiments"), F.count_if(~F.coalesce(F.col(space).isin(spaces), F.lit(False))).alias("n_invalid_spaces"))


def disagreements(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """How many rows say otherwise, where they say anything, than their path: one count for each (column: path's column)."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string").try_cast("double").cast("string"), F.col(c).cast("string"))
    return df.agg(*(F.count_if(F.col(c).isNotNull() & ~as_text(c).eqNullSafe(as_text(p))).alias(c) for c, p in pairs.items()))


def steps(df: DataFrame, order: str, value: str, by: list[str] = ()) -> DataFrame:
    """df with the step from the row before in order, and whether it keeps a falling ladder."""
    along = Window.partitionBy(*(by or [F.lit(1)])).orderBy(order)  # a ladder is a few rows
    return df.withColumn("step", F.col(value) - F.lag(value).over(along)).withColumn("non_increasing", F.coalesce(F.col("step") <= 0, F.lit(True)))


def first_of_each(df: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first by a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*on).orderBy(*order))).where("_n = 1").drop("_n")


def sampled(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, fixed by key and seed; each task offers its n least."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")).cast("binary")), key).limit(n)


def one_to_many(one: DataFrame, many: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join whose first side must be unique by its key."""
    return keys.assert_unique(one, on).join(many, on, how)


def one_to_one(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return keys.assert_unique(a, on).join(keys.assert_unique(b, on), on, how)


def side_by_side(a: DataFrame, b: DataFrame, place: str) -> DataFrame:
    """Two tables whose rows belong together by place, which both have; a row that one side lacks is an error."""
    odd = a.select(place).join(b.select(place), place, "left_anti").limit(1).count() + b.select(place).join(a.select(place), place, "left_anti").limit(1).count()
    if odd:
        raise ValueError("the tables don't have the same rows")
    return a.join(b, place)


def rows_of(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted keys, or an error if some aren't there."""
    if lost := wanted.select(key).distinct().join(df.select(key), key, "left_anti").limit(3).collect():
        raise ValueError(f"no rows for {[r[0] for r in lost]}")
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def union_all(tables: list[DataFrame]) -> DataFrame:
    """Rows of all, columns of all, null where a table has none."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def all_but(df: DataFrame, gone: DataFrame, on: Column | list[str]) -> DataFrame:
    return df.join(gone, on, "left_anti")


# What a metric's results are named, defaults of columns that a table of results may lack, spaces in the order of reports, and algorithms' labels.
RESULT_METRICS = ("mcc_val_mean", "f1_val_mean", "mcc_test_mean")
RESULT_DEFAULTS = {"reduction_strategy_clean": "unknown", "reduction_level": "no_threshold", "reduced_by": "not_applicable", "scaler": "not_reported"}
SPACE_ORDER = ("prot_t5_xl_uniref50", "ankh2_ext1", "esm2_t6_8M_UR50D", "mistral_Prot_v1_134M", "mistral_prot_v1_134M", "esmc_300m", "prot_bert")
ALGORITHM_LABELS = {"KNeighborsClassifier": "k-NN", "RandomForestClassifier": "Random Forest", "DecisionTreeClassifier": "Decision Tree", "LogisticRegression": "Logistic Regression", "GaussianNB": "Gaussian NB", "XGBClassifier": "XGBoost", "SVC": "SVC"}
PRETTY_LABELS = {"Ankh2": "Ankh2-ext1", "ankh2_ext1": "Ankh2-ext1", "esm2_t6_8M_UR50D": "ESM2-8M", "esmc_300m": "ESMC-300M", "mistral_Prot_v1_134M": "Mistral-Prot", "prot_bert": "ProtBERT", "ProtT5": "ProtT5-XL", "prot_t5_xl_uniref50": "ProtT5-XL", "none": "No reduction", "not_applicable": "No reduction", "no_reduction": "No reduction"}


def pretty(value: Column) -> Column:
    """The label of a representation, in any letter case; other texts as they are, and none for what wasn't reduced."""
    text = F.trim(value.cast("string"))
    low = {k.lower(): v for k, v in PRETTY_LABELS.items()}
    known = F.element_at(F.create_map(*(F.lit(x) for pair in low.items() for x in pair)), F.lower(text))
    return F.when(value.isNull(), naming.REDUCTION_LABELS["no_reduction"]).otherwise(F.coalesce(known, text))


def pretty_algorithm(value: Column) -> Column:
    return F.coalesce(naming.labelled(F.trim(value.cast("string")), ALGORITHM_LABELS), F.lit(""))


def prepared_results(df: DataFrame, metrics: Iterable[str] = ("f1_test_mean", "f1_test_std", "mcc_test_mean", "mcc_test_std")) -> DataFrame:
    """Results with the labels of their representations, spaces, partitions and reductions, a level that is never null, and metrics as numbers."""
    rep, part, red = naming.REPRESENTATION_LABELS, naming.PARTITION_LABELS, naming.REDUCTION_LABELS
    text = lambda c: F.col(c).cast("string")
    out = df.withColumns({
        "representation_label": naming.labelled(text("representation_clean"), rep), "reduced_by_label": naming.labelled(text("reduced_by"), rep),
        "partition_label": naming.labelled(text("partition_strategy"), part), "reduction_label": naming.labelled(text("reduction_strategy_clean"), red),
        "reduction_level_label": F.coalesce(text("reduction_level"), F.lit("no_level")),
    })
    return out.withColumns({m: stats.clean(text(m).try_cast("double")) for m in keys.existing(df, metrics)})


def similarity_observations(df: DataFrame, value: str, levels: str = "all", representation: str | None = None) -> DataFrame:
    """Observations of train-test similarity with their threshold, those between 0 and 1 of the wanted levels ("all", or names between commas or blanks)
    and train representation; an error if none is left."""
    keys.require(df, ["split_strategy", "reduction_level", value])
    strategy = F.col("reduction_strategy").cast("string") if "reduction_strategy" in df.columns else None
    out = df.withColumn("threshold", naming.normal_threshold(F.col("reduction_level").cast("string"), strategy))
    if levels != "all":
        asked = [F.lit(x) for x in levels.replace(",", " ").split()]
        out = out.where(F.array_contains(F.array(*(naming.normal_threshold(x) for x in asked)), F.col("threshold")))
    if representation:
        keys.require(df, ["train_representation"])
        out = out.where(F.col("train_representation").cast("string") == representation)
    out = out.withColumn(value, F.col(value).cast("string").try_cast("double")).where(F.col(value).between(0, 1))
    if not out.limit(1).count():
        raise ValueError("no observations are left")
    return out


def result_table(df: DataFrame) -> DataFrame:
    """Results ready for a panel: defaults for columns that are missing, only unscaled rows, labels, a threshold, and only distance reductions and what
    wasn't reduced."""
    keys.require(df, ["partition_strategy", "algorithm", "seed", "cfg_idx", *RESULT_METRICS])
    out = df.withColumns({m: F.col(m).cast("string").try_cast("double") for m in RESULT_METRICS})
    out = out.withColumns({c: F.lit(v) for c, v in RESULT_DEFAULTS.items() if c not in df.columns})
    out = out.where(naming.unscaled(F.col("scaler").cast("string")) | (F.col("scaler") == "not_reported"))
    for clean, label, other in (("representation_clean", "representation_label", "unknown"), ("reduced_by", "reduced_by_label", "not_applicable"), ("split_space_clean", "split_space_label", "reduced_by")):
        if clean not in out.columns:
            given = label if clean == "representation_clean" and label in out.columns else other if other in out.columns else None
            out = out.withColumn(clean, F.col(given) if given else F.lit(other))
        out = out.withColumn(label, pretty(F.col(label) if label in out.columns else F.col(clean)))
    strategy = F.col("reduction_strategy_clean").cast("string")
    out = out.withColumn("threshold", naming.normal_threshold(F.col("reduction_level").cast("string"), strategy)).where("threshold is not null")
    low = F.coalesce(F.lower(strategy), F.lit(""))
    return out.where(low.contains("distance") | low.contains("no_reduction") | (F.col("threshold") == "p100"))


def available_spaces(df: DataFrame, requested: list[str] | None = None, most: int = 4, column: str = "reduced_by") -> list[str]:
    """Spaces that a table of results has: those asked for, else those of the reports, in their order, else the most frequent, ties by name."""
    if column not in df.columns:
        return []
    space = F.col(column).cast("string")
    counts = df.where(space.isNotNull() & (space != "not_applicable")).groupBy(space.alias("s")).agg(F.count("*").alias("n"))
    if requested or counts.where(F.col("s").isin(list(SPACE_ORDER))).limit(1).count():
        order = list(requested or SPACE_ORDER)
        there = {r["s"] for r in counts.where(F.col("s").isin(order)).collect()}
        return [s for s in order if s in there][:most]
    return [r["s"] for r in counts.orderBy(F.col("n").desc(), "s").limit(most).collect()]


def small_difference(value: Column) -> Column:
    """A difference as text, three digits if it is small, two if not."""
    return F.when(F.abs(value) < 5e-4, "0.000").when(F.abs(value) < 0.1, F.format_string("%.3f", value)).otherwise(F.format_string("%.2f", value))


def label_columns(df: DataFrame, label: str, labels: list, by: list[str] = ()) -> DataFrame:
    """n_<label> for each of labels: how many rows have it."""
    return df.groupBy(*by).agg(*(F.count_if(F.col(label) == y).alias(f"n_{y}") for y in labels))


def ordered_union(*columns: Iterable[str]) -> list[str]:
    """The names of several lists, each once, in the order in which they come first."""
    return list(dict.fromkeys(c for own in columns for c in own))


def top_of_each(df: DataFrame, on: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key by a total order, numbered from 1 in place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*on).orderBy(*order))).where(F.col("place") <= n)


def over_levels(df: DataFrame, level: str, values: list[str], by: list[str] = (), order: list = ()) -> DataFrame:
    """The first row of each group at each of a curve's levels, null where it has none, with the fractions of both classes; order says which is first, then
    all columns do."""
    own = list(by)
    every = (df.select(*own).distinct() if own else df.sparkSession.range(1).select()).withColumn(level, F.explode(F.array(*(F.lit(v) for v in dict.fromkeys(values)))))
    once = first_of_each(df, [*own, level], [*order, *(F.col(c) for c in df.columns)])
    out = every.join(once, [*own, level], "left")
    total = F.col("n_0") + F.col("n_1")
    return out.withColumns({f"fraction_{y}": stats.ratio(F.col(f"n_{y}"), total) for y in (0, 1)}) if {"n_0", "n_1"} <= set(df.columns) else out


def projected_density(df: DataFrame, value: str, low: float, high: float, points: int = 200, by: list[str] = ()) -> DataFrame:
    """x and density of a Gaussian kernel estimate (Scott's width) at evenly spaced points, from bins a quarter of the kernel wide: one pass, whatever the rows."""
    own, x = list(by), F.col(value).cast("double")
    rows = df.where(x.isNotNull())
    fit = rows.groupBy(*own).agg(F.count("*").alias("_n"), F.stddev_samp(x).alias("_s"))
    fit = fit.withColumn("_h", F.greatest(F.col("_s") * F.pow(F.col("_n"), F.lit(-0.2)), F.lit(1e-12)))
    rows = rows.join(fit, own) if own else rows.crossJoin(F.broadcast(fit))  # one row
    bins = rows.groupBy(*own, "_n", "_h", F.floor(x / (F.col("_h") / 4)).alias("_b")).agg(F.count("*").alias("_c"), F.avg(x).alias("_x"))
    step = (high - low) / (points - 1)
    at = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_i")
    near = bins.select("*", at).withColumn("x", F.lit(low) + F.col("_i") * step).where(F.abs(F.col("x") - F.col("_x")) <= 8 * F.col("_h"))
    weight = F.col("_c") * F.exp(-0.5 * F.pow((F.col("x") - F.col("_x")) / F.col("_h"), 2.0)) / (F.col("_n") * F.col("_h") * float((2 * 3.141592653589793) ** 0.5))
    return near.groupBy(*own, "x").agg(F.sum(weight).alias("density"))
