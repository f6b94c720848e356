from __future__ import annotations

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corvane.functions import keys, naming, stats, vectors


def one(spark, *columns):
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_canonical(spark):
    s = [F.lit(x) for x in ("ACD", "ACX", "", "acd")]
    assert one(spark, *(naming.canonical(x) for x in s)) == (True, False, True, False)
    assert one(spark, naming.canonical(F.lit("ACX"), extended=True)) is True
    assert one(spark, naming.in_length(F.lit("A" * 70)), naming.in_length(F.lit("A" * 1025))) == (True, False)


def test_names(spark):
    level = lambda s: naming.reduction_level(F.lit(s))
    assert one(spark, level("a/p90_0/b"), level("minseqid_3/x"), level("a/threshold_0.7/b"), level("xp90_0/b")) == ("p90_0", "minseqid_3", "no_level", "no_level")
    own = lambda s, p: naming.strategy_from_table(F.lit(s), F.lit(p))
    assert one(spark, own("by distance", "x"), own("Homology", "x"), own("no_reduction", "x"), own("other", "x")) == ("distance_reduction", "homology_reduction", "no_reduction", "x")
    columns = naming.level_columns(F.lit("p30_0"))
    assert one(spark, *columns.values()) == ("p30_0", "not_applicable")
    assert one(spark, naming.longest_prefix(F.lit("prot_t5_xl_reduced"), ["prot", "prot_t5", "x"]), naming.longest_prefix(F.lit("zzz"), ["prot"])) == ("prot_t5", None)
    assert one(spark, naming.unscaled(F.lit(" None ")), naming.unscaled(F.lit(None).cast("string")), naming.unscaled(F.lit("l2"))) == (True, True, False)
    assert one(spark, naming.labelled(F.lit("onehot"), naming.REPRESENTATION_LABELS), naming.labelled(F.lit("else"), naming.REPRESENTATION_LABELS)) == ("One-hot", "else")
    key = lambda s: naming.natural_key(F.lit(s))
    a, b, c = one(spark, key("p9"), key("p10"), key("p100"))
    assert a < b < c
    why = lambda t: naming.clean_reason(F.lit(t).cast("string"))
    got = one(spark, why("INFO x\n ERROR: no   rows\nmore"), why(None), why("Some classes have fewer samples than n_splits"), why("fold 1 has only 1 class(es)"), why("Invalid split input: done"))
    assert got == ("no rows more", "", "Invalid stratified k-fold: at least one class has fewer samples than n_splits. Some classes have fewer samples than n_splits", "Invalid split: at least one train/val/test fold contains fewer than two classes. fold 1 has only 1 class(es)", "Invalid split input: done")
    flags = lambda r, d: naming.context_flags(F.lit(r), F.lit(d), ["ProtT5"])
    context = lambda r, d: naming.baseline_context(*flags(r, d).values())
    assert one(spark, context("One-hot", "No reduction"), context("ProtT5", "unknown"), context("ProtT5", "Distance reduction"), context("Else", "No reduction")) == ("B1: One-hot + No reduction", "B2: Embeddings + No reduction", "Other", "Other")
    combo = lambda r, b, l: tuple(naming.clean_combo(F.lit(r), F.lit(b), F.lit(l).cast("string")).values())  # noqa: E731, E741
    assert one(spark, *combo("Homology reduction", "none", None), *combo("No reduction", "x", "p90"), *combo("Distance reduction", "x", "p90")) == ("homology", "not_applicable", "no_reduction", "no_reduction", "x", "p90")
    run = lambda n: tuple(naming.scenario(F.lit(n), {"odd": ("a", "b")}).values())
    names = ("onehot_no_reduced", "x_reduced_distance_by_y", "x_reduced_descriptor", "x_reduced_homology", "plain", "odd")
    assert one(spark, *(c for n in names for c in run(n))) == ("onehot", "no_reduction", "x", "reduced_distance_by_y", "x", "reduced_descriptor", "x", "reduced_homology", "plain", "unknown", "a", "b")
    assert one(spark, naming.by_spelling(F.lit(" Random_Split "), naming.SPLIT_NAMES), naming.by_spelling(F.lit(">=2"), naming.SUBSET_NAMES), naming.by_spelling(F.lit("My Own"), naming.SUBSET_NAMES)) == ("random", "multi-source", "my-own")
    fixed = naming.corrected_onehot(F.lit("e"), F.lit("Distance_aware"), ["e"], F.lit("r"), F.lit("s"))
    assert one(spark, *fixed.values()) == ("onehot", "onehot")


def test_keys(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "A int, k string")
    assert keys.existing(df, ["k", "x", "A", "k"]) == ["k", "A"]
    assert [r[0] for r in df.select(keys.combo_key(df, ["A", "k", "x"])).collect()] == ["1 | not_applicable", "2 | b"]
    assert keys.resolve(df, {"alpha": ["zz", "a"], "kappa": ["K"], "none": ["q"]}).columns == ["A", "k", "alpha", "kappa"]
    with pytest.raises(ValueError):
        keys.resolve(df, {"none": ["q"]}, required=["none"])
    with pytest.raises(ValueError):
        keys.assert_unique(df.union(df), ["A"])
    with pytest.raises(ValueError):
        keys.require(df, ["A", "zz"])
    assert keys.selected(df, "k", "all").count() == 2 and keys.selected(df, "k", ["b"]).count() == 1


def test_statistics(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    five = df.agg(*(c.alias(n) for n, c in stats.five_numbers(F.col("x")).items())).first()
    assert (five.q1, five.median) == (1.75, 2.5)
    single = df.where("x = 1").agg(stats.half_width_normal(F.col("x")), stats.half_width_t(F.col("x"))).first()
    assert tuple(single) == (0.0, None)
    assert stats.nearest_rank_count(12, 0.10, 5) == 5 and stats.nearest_rank_count(3, 0.5, 5) == 3
    assert stats.T_975[28] == pytest.approx(2.045230)
    m = spark.createDataFrame([(1, 1)] * 2 + [(0, 1)] + [(1, 0)] + [(0, 0)] * 2, "t int, p int").agg(*(c.alias(n) for n, c in stats.confusion(F.col("t"), F.col("p")).items())).first()
    assert m.asDict() == pytest.approx({"accuracy": 2 / 3, "precision": 2 / 3, "recall": 2 / 3, "f1": 2 / 3, "mcc": 1 / 3})
    none = spark.createDataFrame([(1, 0), (0, 0)], "t int, p int").agg(*(c.alias(n) for n, c in stats.confusion(F.col("t"), F.col("p")).items())).first()
    assert (none.precision, none.f1, none.mcc) == (0, 0, 0)


def test_vectors(spark):
    a, b = (F.array(*(F.lit(float(x)) for x in v)) for v in ((3, 4), (4, -3)))
    assert one(spark, vectors.norm(a), vectors.cosine(a, b), vectors.euclidean(a, b)) == pytest.approx((5, 0, 50**0.5))
    assert one(spark, vectors.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0, 0]
    assert one(spark, vectors.one_hot(F.lit("CA"), 3, "AC")) == [0, 1, 1, 0, 0, 0]
    assert one(spark, vectors.ordinal(F.lit("CAX"), 4, "AC")) == [2, 1, 0, 0]
    assert one(spark, vectors.frequencies(F.lit("AAC"), "AC")) == pytest.approx([2 / 3, 1 / 3])
    assert one(spark, vectors.k_mers(F.lit("ABCD"), 3), vectors.k_mers(F.lit("AB"), 3)) == (["ABC", "BCD"], [])
    assert one(spark, vectors.is_finite(F.array(F.lit(1.0), F.lit(float("nan")))), vectors.is_binary(a)) == (False, False)


@settings(max_examples=25, deadline=None)
@given(values=st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=30))
def test_percentiles_interpolate(spark, values):
    import numpy as np

    got = spark.createDataFrame([(v,) for v in values], "x double").agg(*(c.alias(n) for n, c in stats.five_numbers(F.col("x")).items())).first()
    assert list(got) == pytest.approx(list(np.percentile(values, [0, 25, 50, 75, 100])), rel=1e-9, abs=1e-6)


def test_thresholds_in_all_digits(spark):
    from corvane.functions import naming

    said = {"p30_0": "p30", "1e-9": "p1_0000000000000001e-07", "0.9": "p90", "0.07": "p7", "12.3456789": "p12_3456789", "99.95": "p99_95", "0.00025": "p0_025", "p 70": "p70", "x": None, "100000000": "p100000000", "0.000005": "p0_0005"}
    df = spark.createDataFrame([(k,) for k in said], "s string")
    assert {r.s: r.t for r in df.select("s", naming.normal_threshold(F.col("s")).alias("t")).collect()} == said


def test_waves_are_known_before_rows_are_read(spark):
    """Properties of letters (a null has none, other letters count 0) and their Fourier sizes equal numpy's; no row works out a cosine."""
    import numpy as np
    from corvane.functions import vectors

    df = spark.createDataFrame([("KDé😀RHKKKKK",), ("",), (None,)], "s string")
    out = df.select(vectors.property_of(F.col("s"), 9, vectors.CHARGE).alias("v")).select("v", vectors.fourier(F.col("v"), 9).alias("f"))
    expected = [[1.0, -1.0, 0.0, 0.0, 1.0, 0.1, 1.0, 1.0, 1.0], [0.0] * 9, [0.0] * 9]
    for r, v in zip(out.collect(), expected, strict=True):
        assert r.v == v and np.allclose(r.f, np.abs(np.fft.rfft(v)))
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "cos(" not in plan and "sin(" not in plan
