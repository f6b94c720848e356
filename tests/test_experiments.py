"""Configuration, files and tables of experiments."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import delta, experiment, report, split
from corvane.sources import parsers, sinks, tables


def one(spark, column, values, kind="string"):
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(column(F.col("v")).alias("x")).collect()]


def test_names_that_are_shown(spark):
    assert one(spark, experiment.parameter_text, ["30.0", "99.9", "0.7", "abc", None, "1234567.25", "0.00001", "1e20", "-2"]) == ["30", "99.9", "0.7", "abc", "no_threshold", "1.23457e+06", "1e-05", "1e+20", "-2"]
    assert one(spark, experiment.parameter_label, ["percentile", "min_seq_id", "no_threshold", "x", None]) == ["Reduction percentile", "Homology min_seq_id", "No reduction", "Reduction parameter", "Reduction parameter"]
    assert one(spark, experiment.parameter_slug, ["min_seq_id", "percentile"]) == ["homology", "percentile"]
    assert one(spark, experiment.short_scenario, ["one_hot_reduced_distance_by_prot_bert"]) == ["One-hot_reduced_distance_by_ProtBERT"]
    assert experiment.percentile_name(30) == "p30_0" and experiment.percentile_name("99.9") == "p99_9"
    assert one(spark, report.pretty, ["ANKH2_ext1", "prot_bert", "none", "x", None]) == ["Ankh2-ext1", "ProtBERT", "No reduction", "x", "No reduction"]
    assert one(spark, report.pretty_algorithm, ["SVC", "RandomForestClassifier", "x", None]) == ["SVC", "Random Forest", "x", ""]
    assert one(spark, report.small_difference, [0.0001, -0.0123, 0.5], "double") == ["0.000", "-0.012", "0.50"]


def test_scenarios_and_splitters():
    assert experiment.scenario_name("onehot", "reduced_distance", "prot_bert", "esm") == "onehot_reduced_distance_by_prot_bert_split_by_esm"
    assert experiment.scenario_name("onehot", "reduced_descriptor", "onehot") == "onehot_reduced_descriptor" and experiment.scenario_name("a", "reduced_homology", "b") == "a_reduced_homology"
    with pytest.raises(ValueError):
        experiment.scenario_name("a", "other")
    pick = experiment.split_representation
    assert (pick("a"), pick("a", "b"), pick("a", "reduction", "r"), pick("a", "reduction"), pick("a", {"a": "z", "default": "y"}), pick("c", {"a": "z", "default": "y"}), pick("a", "b", enabled=False)) == ("a", "b", "r", "a", "z", "y", "a")
    strategies = {"random_kfold": {"enabled": True}, "stratified_kfold": {"enabled": False}, "distance_aware_kfold": {"enabled": True, "descriptor_modes": ["norm", "no_norm"], "n_splits": 3}}
    assert experiment.strategy_folders(strategies, "embeddings") == ["random_kfold", "distance_aware_kfold"]
    folders = experiment.strategy_folders(strategies, "descriptors")
    assert folders == ["random_kfold", "distance_aware_kfold_norm", "distance_aware_kfold_no_norm"] and [experiment.splitter(f) for f in folders] == ["random_kfold", "distance_aware_kfold", "distance_aware_kfold"]
    assert [experiment.standardizes(f) for f in folders] == [False, True, False]
    told = experiment.split_parameters(folders[1], 7, strategies, "label", "descriptors", "euclidean")["distance_aware_kfold"]
    assert told["standardize_descriptors"] and (told["n_splits"], told["seed"], told["metric"]) == (3, 7, "euclidean")
    with pytest.raises(ValueError):
        experiment.split_parameters("other", 1, strategies, "label")
    made = experiment.provenance({"name": "d"}, {"key": "onehot", "method": "one_hot"}, "onehot_descriptor", {"enabled": True, "thresholds": [30]})
    assert made["analysis"]["metric"] == "euclidean" and made["experiment"]["name"] == "onehot_reduced_descriptor" and made["reduction"]["strategy"] == "descriptor_euclidean"


def test_specs_and_inputs(spark):
    assert experiment.summary_specs(["A :: homology::/x", "B::distance::/y", "C::distance::/x"]) == [("A", "homology", "/x"), ("B", "distance", "/y")]
    with pytest.raises(ValueError):
        experiment.summary_spec("A::b")
    assert experiment.reducer_input(spark.createDataFrame([("s", 1, 2)], "sequence string, id int, name int"), "name").columns == ["id", "sequence"]


def test_result_files_by_name_and_marker(spark, tmp_path):
    names = ["e1/p30_0/exploration_by_fold_SVC_scaler_none.csv", "e1/p30_0/exploration_by_fold_SVC_scaler_l2.csv", "e2/exploration_by_fold_SVC_scaler_none.csv", "e1/exploration_by_fold_bad.csv", "e3/exploration_by_fold_LDA_x_scaler_none.csv"]
    files = spark.createDataFrame([(f"file:/r.1/{n}",) for n in names], "path string")
    markers = spark.createDataFrame([("file:/r.1/e1/p30_0/training_done_scaler_none.txt",)], "path string")
    rows, counts = experiment.accepted_files(files, "/r.1", block=["e2"], exclude=["l2"], markers=markers)
    assert [(r.path.rsplit("/", 1)[1], r.experiment, r.algorithm, r.scaler) for r in rows.collect()] == [("exploration_by_fold_SVC_scaler_none.csv", "e1", "SVC", "none")]
    assert {r.outcome: r.n for r in counts.collect()} == {"discovered": 5, "accepted": 1, "inside_experiment_blocklist": 1, "scaler_excluded": 1, "unparsed_filename": 1, "missing_done_marker": 1}
    rows, _ = experiment.accepted_files(files, "/r.1", allow=["e3"], include=["none"])
    assert [r.algorithm for r in rows.collect()] == ["LDA_x"]
    assert [experiment.scaler_suffix(s) for s in (None, "No", "L2 ")] == ["_scaler_none", "_scaler_none", "_scaler_l2"]
    path = sinks.mark_done(spark, f"file://{tmp_path}/run", "training_done_scaler_none.txt", {"n": 1})
    assert [r.path.rsplit("/", 1)[1] for r in experiment.done_markers(spark, f"file://{tmp_path}").collect()] == [path.rsplit("/", 1)[1]]


def test_levels_that_are_kept(spark):
    rows = [("random", "distance_reduction", "p30_0"), ("random", "distance_reduction", "p40_0"), ("random", "homology_reduction", "minseqid_0_3"), ("random", "no_reduction", None), ("other", "no_reduction", None), ("random", "unknown", "p30_0"), ("random", None, None)]
    df = spark.createDataFrame(rows, "split_strategy string, reduction_strategy string, reduction_level string")
    assert {(r.reduction_strategy, r.reduction_level) for r in experiment.kept_by_level(df, ["random"], ["p30_0"], ["minseqid_0_3"]).collect()} == {("distance_reduction", "p30_0"), ("homology_reduction", "minseqid_0_3"), ("no_reduction", None)}


def test_reduced_tables_are_looked_up(spark):
    there = ["/d/p30_0/data_nr.csv", "/d/p40_0/data_nr.csv", "/d/p40_0/data_nr_labeled.csv", "/d/threshold_0.7/data_nr_mmseqs2.csv", "/else/x.csv", "/d/own/y.csv", "/d/own/data_nr_labeled.csv", "/d/p99_5/data_nr.csv"]
    rows = [("distance", "percentile", "30.0", None), ("distance", "percentile", "40", None), ("homology", "min_seq_id", "0.7", None), ("distance", "percentile", "50", "/else/x.csv"), ("distance", "percentile", "60", "own/y.csv"), ("distance", "percentile", "70", " "), ("distance", "percentile", "99.5", "gone.csv")]
    df = spark.createDataFrame(rows, "kind string, parameter_type string, parameter_value string, output_csv string")
    got = {r.parameter_value: r.reduced_dataset for r in experiment.reduced_tables(df, spark.createDataFrame([(p,) for p in there], "path string"), "/d").collect()}
    assert got == {"30.0": "/d/p30_0/data_nr.csv", "40": "/d/p40_0/data_nr_labeled.csv", "0.7": "/d/threshold_0.7/data_nr_mmseqs2.csv", "50": "/else/x.csv", "60": "/d/own/data_nr_labeled.csv", "70": None, "99.5": "/d/p99_5/data_nr.csv"}


def test_runs_of_kept_splits(spark):
    status = spark.createDataFrame([("onehot_no_reduced", "random", "kept"), ("onehot_no_reduced", "random", "kept"), ("a_reduced_distance_by_b", "random", "invalid_split")], "scenario string, strategy string, status string")
    got = experiment.training_matrix(status, ["SVC", "GaussianNB"], ["none"], ["scenario", "strategy"]).collect()
    assert {(r.scenario, r.algorithm, r.scaler, r.representation_strategy, r.redundancy_strategy) for r in got} == {("onehot_no_reduced", a, "none", "onehot", "no_reduction") for a in ("SVC", "GaussianNB")} and len(got) == 2


def test_results_made_ready(spark):
    rows = [("random", "SVC", 1, 0, "0.5", "0.4", "x", "prot_bert", "distance_reduction", "p30_0", "ankh2_ext1", None), ("random", "SVC", 1, 0, "0.5", "0.4", "0.3", "prot_bert", "distance_reduction", "p30_0", "ankh2_ext1", "l2"), ("random", "SVC", 1, 0, "1", "1", "1", "esm", "homology_reduction", "minseqid_0_3", "x", "none"), ("random", "SVC", 2, 0, "1", "1", "1", "onehot", "no_reduction", None, None, "no_norm")]
    df = spark.createDataFrame(rows, "partition_strategy string, algorithm string, seed int, cfg_idx int, mcc_val_mean string, f1_val_mean string, mcc_test_mean string, representation_clean string, reduction_strategy_clean string, reduction_level string, reduced_by string, scaler string")
    got = {r.representation_clean: r for r in report.result_table(df).collect()}
    assert set(got) == {"prot_bert", "onehot"}
    r = got["prot_bert"]
    assert (r.mcc_test_mean, r.mcc_val_mean, r.threshold, r.representation_label, r.reduced_by_label, r.split_space_label) == (None, 0.5, "p30", "ProtBERT", "Ankh2-ext1", "Ankh2-ext1")
    assert (got["onehot"].threshold, got["onehot"].reduced_by_label) == ("p100", "No reduction")
    bare = report.result_table(df.drop("representation_clean", "reduction_strategy_clean", "reduction_level", "reduced_by", "scaler"))
    assert {(r.representation_label, r.threshold, r.reduced_by, r.scaler) for r in bare.collect()} == {("unknown", "p100", "not_applicable", "not_reported")}
    with pytest.raises(ValueError):
        report.result_table(df.drop("seed"))
    plain = report.prepared_results(df.withColumnRenamed("mcc_test_mean", "mcc_test_mean")).where("seed = 2").first()
    assert (plain.representation_label, plain.partition_label, plain.reduction_label, plain.reduction_level_label, plain.mcc_test_mean) == ("One-hot", "random", "No reduction", "no_level", 1.0)
    assert report.available_spaces(df) == ["ankh2_ext1"] and report.available_spaces(df, ["x", "y", "ankh2_ext1"]) == ["x", "ankh2_ext1"] and report.available_spaces(df.where("reduced_by = 'x'")) == ["x"] and report.available_spaces(df.drop("reduced_by")) == []


def test_similarity_observations(spark):
    df = spark.createDataFrame([("random", "p30_0", "0.5", "a", "distance_reduction"), ("random", "p90_0", "1.5", "a", "distance_reduction"), ("random", "none", "0.9", "b", "no_reduction"), ("random", "p90_0", "nan", "a", "distance_reduction"), ("random", "p90_0", "0.1", "a", None)], "split_strategy string, reduction_level string, s string, train_representation string, reduction_strategy string")
    assert {(r.threshold, r.s) for r in report.similarity_observations(df, "s").collect()} == {("p30", 0.5), ("p100", 0.9), ("p90", 0.1)}
    assert {(r.threshold, r.s) for r in report.similarity_observations(df, "s", "30, p100", "b").collect()} == {("p100", 0.9)}
    with pytest.raises(ValueError):
        report.similarity_observations(df, "s", "all", "zzz")


def test_boxes_of_a_ranking(spark):
    ranking = spark.createDataFrame([("a", None, "P", 1), ("b", "x", "P", 2), ("c", "x", "Q", 3), ("d", "x", "Q", None), ("e", "x", "Q", 4)], "model string, scaler string, panel string, rank int")
    deltas = spark.createDataFrame([("a", None, 0.1), ("a", None, 0.3), ("a", None, None), ("b", "x", 0.2), ("d", "x", 0.0), ("e", "x", 0.5), ("zz", "x", 0.9)], "model string, scaler string, delta__mcc double")
    got = {r.model: (r["rank"], r.n, r.minimum, r.median, r.maximum) for r in delta.ranked_distributions(deltas, ranking, ["model", "scaler"], "mcc", "rank").collect()}
    assert got == {"a": (1, 2, 0.1, 0.2, 0.3), "b": (2, 1, 0.2, 0.2, 0.2), "d": (None, 1, 0.0, 0.0, 0.0), "e": (4, 1, 0.5, 0.5, 0.5)}
    panels = delta.ranked_distributions(deltas, ranking, ["model", "scaler"], "mcc", "rank", panel="panel", top=2).collect()
    assert {(r.model, r.panel, r.panel_rank) for r in panels} == {("a", "P", 1), ("b", "P", 1), ("e", "Q", 3)}
    assert {r.model for r in delta.ranked_distributions(deltas, ranking, ["model", "scaler"], "mcc", "rank", filters={"model": ["a", "b"]}).collect()} == {"a", "b"}


def test_curves_densities_and_tops(spark):
    df = spark.createDataFrame([("m", "p30", 1, 3), ("m", "p90", 2, 2)], "model string, level string, n_0 int, n_1 int")
    assert [(r.level, r.fraction_1) for r in report.over_levels(df, "level", ["p30", "p60", "p90"], ["model"]).orderBy("level").collect()] == [("p30", 0.75), ("p60", None), ("p90", 0.5)]
    import numpy as np

    x = np.random.default_rng(1).normal(size=400)
    got = report.projected_density(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", -3, 3, 31).orderBy("x").collect()
    h = x.std(ddof=1) * 400**-0.2
    exact = np.exp(-0.5 * ((np.linspace(-3, 3, 31)[:, None] - x) / h) ** 2).sum(1) / (400 * h * np.sqrt(2 * np.pi))
    assert np.abs(np.array([r.density for r in got]) - exact).max() < 0.01 * exact.max()
    assert [r.level for r in report.top_of_each(df, ["model"], ["level"], 1).collect()] == ["p30"] and report.ordered_union(["a", "b"], ["b", "c"]) == ["a", "b", "c"]
    assert report.label_columns(df.withColumn("y", F.lit(1)), "y", [0, 1]).first().asDict() == {"n_0": 0, "n_1": 2}


def test_levels_in_order_and_feasibility(spark):
    status = spark.createDataFrame([("s", "p90_0", "kept"), ("s", "p30_5", "kept"), ("s", "minseqid_0_3", "invalid_split"), ("t", None, "kept"), ("t", "p90_0", "invalid_split")], "scenario string, level string, status string")
    got = {r.level: (r.level_order, r.level_kind, r.level_value) for r in split.ordered_levels(status, "level").collect()}
    assert got == {None: (1, "none", None), "p30_5": (2, "percentile", 30.5), "p90_0": (3, "percentile", 90.0), "minseqid_0_3": (4, "identity", 0.3)}
    wide = {r.scenario: (r.p90_0, r.p30_5) for r in split.feasibility(status, "scenario", "level", ["p90_0", "p30_5"]).collect()}
    assert wide == {"s": (1.0, 1.0), "t": (0.0, None)}


def test_folds_and_summaries_in_folders(spark, tmp_path):
    for fold in ("fold_0", "fold_1"):
        at = tmp_path / "splits/scen/random_kfold/seed_7" / fold
        at.mkdir(parents=True)
        for part in ("train", "val", "test"):
            (at / f"{part}.csv").write_text(f"id,label\n{part}{fold},1\n")
    got = tables.read_folds(spark, f"file://{tmp_path}/splits", "id string, label int").collect()
    assert {(r.id, r.scenario, r.strategy, r.seed, r.fold, r.part) for r in got} == {(f"{p}fold_{f}", "scen", "random_kfold", 7, f, p) for f in (0, 1) for p in ("train", "val", "test")}
    paths = spark.createDataFrame([("/r/sc/st/seed_1/p30_0/fold_2/x",), ("/r/sc/st/p30_0/seed_1/x",), ("/r/sc/minseqid_0_3/st/seed_1/x",), ("/r/x",)], "p string")
    told = [tuple(r) for r in paths.select(*(c.alias(n) for n, c in tables.path_metadata(F.col("p")).items())).collect()]
    assert told == [("sc", "st", 1, "p30_0", 2), ("sc", "st", 1, "p30_0", None), ("sc", "st", 1, "no_level", None), (None, None, None, "no_level", None)]
    for folder, text in (("s/st/seed_3", "reduction_levels,status,reason\np30_0,kept,\np90_0,,log ERROR: bad\nno_threshold,invalid_split,\n"), ("s/st/split_analysis/seed_3", "reduction_levels,status,reason\np30_0,kept,\n")):
        (tmp_path / "status" / folder).mkdir(parents=True)
        (tmp_path / "status" / folder / "split_summary.csv").write_text(text)
    got = tables.read_seed_summaries(spark, f"file://{tmp_path}/status").collect()
    assert {(r.scenario, r.strategy, r.seed, r.threshold, r.status, r.reason, r.is_kept, r.is_invalid, r.parameter_value) for r in got} == {("s", "st", 3, "p30_0", "kept", "", 1, 0, 30.0), ("s", "st", 3, "p90_0", "unknown", "bad", 0, 1, 90.0), ("s", "st", 3, "", "invalid_split", "", 0, 1, None)}


def test_splits_and_parameters_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0, "x"), ("a", 1, 1, "y"), ("b", 1, 0, "z")], "scenario string, seed int, fold int, id string")
    status = spark.createDataFrame([("a", 1, "kept"), ("b", 1, "kept"), ("b", 1, "invalid_split")], "scenario string, seed int, status string")
    sinks.write_splits(rows, status, f"file://{tmp_path}/w", ["scenario", "seed"])
    assert {r.id for r in spark.read.parquet(f"file://{tmp_path}/w/assignments").collect()} == {"x", "y"} and spark.read.parquet(f"file://{tmp_path}/w/status").count() == 3
    sinks.write_parameters(spark, {"z": 1, "a": [1, 2]}, f"file://{tmp_path}/p.yaml")
    text = (tmp_path / "p.yaml").read_text()
    assert text.index("z") < text.index("a")
    try:
        import yaml

        assert yaml.safe_load(text) == {"z": 1, "a": [1, 2]}
    except ImportError:
        assert json.loads(text) == {"z": 1, "a": [1, 2]}
    with pytest.raises(RuntimeError) if not _openpyxl() else _nothing():
        sinks.write_workbook({"s": rows}, str(tmp_path / "x.xlsx"), csv=f"file://{tmp_path}/csv")
    assert spark.read.option("header", "true").csv(f"file://{tmp_path}/csv/s").count() == 3


def _openpyxl() -> bool:
    try:
        import openpyxl  # noqa: F401
    except ImportError:
        return False
    return True


def _nothing():
    import contextlib

    return contextlib.nullcontext()


def test_sheets_are_chosen_by_their_columns(spark, monkeypatch):
    import pandas as pd

    book = {"notes": pd.DataFrame({"a": [1]}), "data": pd.DataFrame({"Seed ": [1], "MCC": [0.5], "model": ["m"], "Fold": [0], "cfg": [2]})}
    monkeypatch.setattr(pd, "read_excel", lambda path, sheet_name=None: book)
    wanted = {"seed": [], "mcc": ["matthews"], "algorithm": ["model"], "fold": [], "cfg_idx": ["cfg"]}
    assert tables.sheet(spark, "x.xlsx", wanted).first()["MCC"] == 0.5
    with pytest.raises(ValueError):
        tables.sheet(spark, "x.xlsx", wanted, least=6)


def test_sources_by_name(spark, tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)

    put("ANOX/anti_protein_positive_negative.txt", ">p1|x|1\nAC\nD\n>p2|0\r\nEF\n>p3|0\nACD\n>p4|1\nGG\n>p5|1\nGG\n")
    right, wrong, counts = parsers.parsed(spark, f"file://{tmp_path}/ANOX", "ANOX")
    assert {(r.sequence, r.label) for r in right.collect()} == {("EF", 0), ("GG", 1)} and {r.sequence: r.labels for r in wrong.collect()} == {"ACD": ["0", "1"]}
    assert counts.first().asDict() == {"number_of_records": 5, "number_of_unique_sequences": 2, "positive_examples": 1, "negative_examples": 1, "number_of_sequences_with_errors": 1}
    for name, tail in (("test.2023", "ANOXI"), ("test", "1"), ("train", "0")):
        put(f"AOPxSVM/AOPP.{name}.fasta", f">a|{tail}\n{name.replace('.', '').upper()}\n")
    assert {(r.sequence, r.label) for r in parsers.parsed(spark, f"file://{tmp_path}/AOPxSVM", "AOPxSVM")[0].collect()} == {("TEST2023", 0), ("TEST", 1), ("TRAIN", 0)}
    put("Feng/full_text.txt", "junk\n>antioxidant 1\nACD\nEFG\n\f12\n>P12345\nKL\n>other protein\nMM\nnot a line\n")
    assert {(r.sequence, r.label) for r in parsers.parsed(spark, f"file://{tmp_path}/Feng", "Feng et al")[0].collect()} == {("ACDEFG", 1), ("KL", 1), ("MM", 0)}
    put("AMPDB/Antioxidant dataset.tsv", "Id\t Sequence\n1\tAAA\n2\tCCC\n")
    assert {(r.sequence, r.label) for r in parsers.parsed(spark, f"file://{tmp_path}/AMPDB", "AMPDB v1")[0].collect()} == {("AAA", 1), ("CCC", 1)}
    put("AOD/a.txt", '">x"\n"AB\nC"\n">y"\n"DE"')
    assert {(r.sequence, r.label) for r in parsers.parsed(spark, f"file://{tmp_path}/AOD", "AOD")[0].collect()} == {("ABC", 1), ("DE", 1)}
    letters = "ACDEFGHIKLMNPQRSTVWY"
    word = lambda k, i: letters[k] + "".join(letters[i // 20**j % 20] for j in range(3))
    put("Ahmad/independent dataset.txt", "".join(f">r\n{word(0, i)}\n" for i in range(470)))
    put("Ahmad/Training_dataset.txt", "".join(f">r\n{word(1, i)}\n" for i in range(300)))
    got = {r.sequence: r.label for r in parsers.parsed(spark, f"file://{tmp_path}/Ahmad", "Ahmad et al")[0].collect()}
    assert {s for s, y in got.items() if y} == {word(0, i) for i in range(392, 465)} | {word(1, i) for i in range(100, 200)} and len(got) == 770
    put("Pred/nonanti.txt", ">a\nAA\n")
    put("Pred/anti.txt", ">a\nCC\n")
    put("Pred/Indpendent dataset.txt", ">anti1\nDD\n>non\nEE\n")
    put("Pred/independent dataset.txt", "".join(f">r\n{word(2, i)}\n" for i in range(394)))
    put("Pred/Antioxident666.txt", ">x non-antioxidant\nFF\n>non-antioxidant_1\nGG\n>antioxidant_2\nHH\n")
    got = {r.sequence: r.label for r in parsers.parsed(spark, f"file://{tmp_path}/Pred", "PredAoDP")[0].collect()}
    assert {s: got[s] for s in ("AA", "CC", "DD", "EE", "GG", "HH", word(2, 391), word(2, 392))} == {"AA": 0, "CC": 1, "DD": 1, "EE": 0, "GG": 0, "HH": 1, word(2, 391): 0, word(2, 392): 1}
    described = spark.createDataFrame([("ANOX", "b"), ("ANOX", "a"), ("x", "c")], "source string, kind string")
    assert parsers.source_metadata(described, "ANOX").first().asDict() == {"number_of_sources": 2, "source": "ANOX", "kind": "a;b"}
    assert set(parsers.SOURCES) == {"AMPDB v1", "ANOX", "AOD", "AOPxSVM", "Ahmad et al", "Butt et al", "Feng et al", "Lam et al", "PredAoDP", "Thanh-Lam et al", "Zhai et al", "Zhang et al"}


def test_one_split_is_replaced(spark, tmp_path):
    """The others' files aren't touched, a run that fails before its status leaves what was there, and a split that is no longer kept is gone."""
    path, by = f"file://{tmp_path}/s", ["scenario", "seed"]
    kind = "scenario string, seed int, id string"
    said = lambda *rows: spark.createDataFrame(rows, "scenario string, seed int, status string")
    ids = lambda: sorted(r.id for r in sinks.read_splits(spark, path, by).collect())
    sinks.write_splits(spark.createDataFrame([("a", 1, "x"), ("b c", 1, "y"), ("d", 1, "z")], kind), said(("a", 1, "kept"), ("b c", 1, "kept"), ("d", 1, "kept")), path, by)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet") if "scenario=a" in str(p)}
    assert ids() == ["x", "y", "z"] and len(before) == 2
    spark.createDataFrame([("a", 1, "torn")], kind).write.partitionBy(*by).parquet(f"{path}/assignments/run=torn")
    assert ids() == ["x", "y", "z"]
    sinks.write_splits(spark.createDataFrame([("b c", 1, "new"), ("d", 1, "z")], kind), said(("b c", 1, "kept"), ("d", 1, "kept"), ("d", 1, "invalid_split")), path, by)
    assert ids() == ["new", "x"] and all(p.exists() and p.stat().st_mtime_ns == t for p, t in before.items())
    assert not [p for p in (tmp_path / "s").rglob("*.parquet") if "assignments" in str(p) and "scenario=d" in str(p)]
