from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.sources import sequences, sinks, tables
from corvane.streaming import results as stream


def test_tables_by_ending(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,p_10,p_2\na,1,2\nb,3,4\n")
    (tmp_path / "t.tsv").write_text("id\tx\na\t1\n")
    df = tables.read_table(spark, f"file://{tmp_path}/t.csv")
    packed = tables.packed_features(df)
    assert {r.id: r.features for r in packed.collect()} == {"a": [2.0, 1.0], "b": [4.0, 3.0]}
    assert tables.wide_features(packed).columns == ["id", "p_0", "p_1"]
    assert tables.read_table(spark, f"file://{tmp_path}/t.tsv", columns=["x"]).collect()[0].x == 1
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.npy")


def test_found_files_and_paths(spark, tmp_path):
    for p in ("sc/random/seed_3/p90_0/fold_02", "sc/random/seed_4/none/fold_00", ".hidden/random/seed_1/x", "sc/analysis/seed_9/y"):
        (tmp_path / p).mkdir(parents=True)
        (tmp_path / p / "r.csv").write_text("m\n0.5\n")
    files = tables.found_files(spark, f"file://{tmp_path}", without=["/analysis/"])
    assert files.count() == 2
    got = {r.seed: (r.scenario, r.strategy, r.reduction_level, r.fold, r.m) for r in tables.read_found(spark, f"file://{tmp_path}/sc", "m double").collect()}
    assert got[3] == ("sc", "random", "p90_0", 2, 0.5) and got[4][2:4] == ("no_level", 0)
    marks = files.limit(1).select("path")
    assert tables.without_done(files, marks, "path").count() == 1


def test_sequences(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">sp|P1|X one GN=abc end\nACD\nEF\n>P2 two GN=abc\nGH\r\n\n>P3\n")
    df = sequences.read_fasta(spark, f"file://{tmp_path}/a.fasta", description=True)
    assert {r.id: (r.sequence, r.description) for r in df.collect()} == {"sp|P1|X": ("ACDEF", "one GN=abc end"), "P2": ("GH", "two GN=abc"), "P3": ("", "")}
    genes = sequences.gene_sequences(df.withColumn("n", F.when(F.col("id") == "P2", 2).otherwise(1)), "n")
    assert [tuple(r) for r in genes.collect()] == [("abc", "GH")]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate([">h1", "ABC", "page 3", "DEF", ">h2", "GG"])], "file string, n int, t string")
    assert sorted((r.id, r.sequence) for r in sequences.running_headers(lines, "file", "n", "t").collect()) == [("h1", "ABCDEF"), ("h2", "GG")]
    assert sorted((r.id, r.sequence) for r in sequences.alternating(lines.where("n in (0, 1, 4, 5)"), "file", "n", "t").collect()) == [(">h1", "ABC"), (">h2", "GG")]
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "x.txt").write_text('">s1"\nAC\nD"\n">s2"\nEE\n')
    assert sorted((r.id, r.sequence) for r in sequences.read_quoted_fasta(spark, f"file://{tmp_path}/q").collect()) == [("s1", "ACD"), ("s2", "EE")]
    one = spark.range(1).select(sequences.last_token(F.lit("a|b|1")).alias("a"), sequences.label_by_place(F.lit(3), 3).alias("b"), sequences.label_if(F.lit(True)).alias("c")).first()
    assert tuple(one) == ("1", 0, 1)


def test_sinks_and_stream(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    sinks.write_parquet(spark.createDataFrame([(1, 0.5)], "cfg int, val double"), path)
    sinks.append_aligned(spark.createDataFrame([(2, "x")], "cfg int, other string"), path)
    assert sorted((r.cfg, r.val) for r in spark.read.parquet(path).collect()) == [(1, 0.5), (2, None)]
    sinks.write_csv(spark.read.parquet(path), f"file://{tmp_path}/csv")
    sinks.write_json(spark, {"b": 1, "a": "é"}, f"file://{tmp_path}/d/doc.json")
    assert (tmp_path / "d" / "doc.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}'
    assert sinks.summary_document(spark.range(2)) == [{"id": 0}, {"id": 1}]
    with pytest.raises(ValueError):
        sinks.summary_document(spark.range(5), limit=3)
    rows = stream.arriving(spark, path, "cfg int, val double")
    for expected in (2, 3):
        stream.drained(stream.kept_up(rows, ["cfg"], ["val"]), f"file://{tmp_path}/sums", f"file://{tmp_path}/state")
        assert spark.read.parquet(f"file://{tmp_path}/sums").count() == expected
        spark.createDataFrame([(3, 0.1)], "cfg int, val double").write.mode("append").parquet(path)


def test_summaries_and_fetching(spark, tmp_path):
    (tmp_path / "ankh2_reduced_distance_reduction_summary.csv").write_text("percentile,n_reduced\n30,24\n90,453\n")
    (tmp_path / "other.csv").write_text("x\n1\n")
    got = tables.read_summaries(spark, f"file://{tmp_path}", "percentile double, n_reduced int").collect()
    assert {(r.model, r.n_reduced) for r in got} == {("ankh2", 24), ("ankh2", 453)}

    def fetch(value):
        if value == "bad":
            raise OSError("no answer")
        return value.upper()

    df = spark.createDataFrame([("a", 1), ("bad", 2)], "k string, n int")
    assert {(r.k, r.content) for r in tables.fetched(df, "k", fetch).collect()} == {("a", "A"), ("bad", "")}
    try:
        import openpyxl  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            sinks.write_workbook({"s": df}, str(tmp_path / "x.xlsx"))


def test_files_by_name(spark, tmp_path):
    from corvane.sources import sinks

    rows = spark.createDataFrame([(i, f"a b/{i % 3}/x=1.csv") for i in range(50)], "i int, file string").repartition(4)
    sinks.write_named(rows, f"file://{tmp_path}/t", "file")
    assert sorted(str(p.relative_to(tmp_path / "t")) for p in (tmp_path / "t").rglob("*.csv")) == [f"a b/{k}/x=1.csv" for k in range(3)]
    assert sorted(r.i for r in spark.read.option("header", True).schema("i int").csv(f"{tmp_path}/t/a b/1/x=1.csv").collect()) == list(range(1, 50, 3))


def test_paths_of_folds_are_read_once_a_file(spark, tmp_path):
    for part, ids in (("train", "1\n2\n3"), ("test", "4")):
        file = tmp_path / "ab" / "random_kfold" / "seed_7" / "fold_1" / f"{part}.csv"
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(f"id\n{ids}\n")
    df = tables.read_folds(spark, str(tmp_path), "id string")
    assert {(r.id, r.part, r.fold, r.seed, r.scenario) for r in df.collect()} == {("1", "train", 1, 7, "ab"), ("2", "train", 1, 7, "ab"), ("3", "train", 1, 7, "ab"), ("4", "test", 1, 7, "ab")}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    rows = plan.split("Join", 1)[1].split("] csv", 1)[0]
    assert "binaryFile" in plan and "regexp_" not in rows
