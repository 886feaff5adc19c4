import pytest
from pyspark.errors import AnalysisException

from tabweave.session import scratch_path
from tabweave.sources import readers, writers


def test_unknown_names_raise(spark):
    registry = readers.default_registry("/nowhere")
    assert registry["balanced_credit_card"].target == "Class" and registry["adult"].target == "income"
    with pytest.raises(ValueError):
        registry.load(spark, "credit")
    with pytest.raises(ValueError):
        writers.write_table(spark.range(1), "/nowhere", "orc")


def test_income_table(spark, tmp_path):
    path = tmp_path / "adult" / "adult.csv"
    path.parent.mkdir()
    path.write_text("age,workclass,income\n30,Private,<=50K\n40,?,>50K\n50,State-gov,>50K\n")
    rows = readers.default_registry(str(tmp_path)).load(spark, "adult").collect()
    assert [tuple(r) for r in rows] == [(30, "Private", 0), (50, "State-gov", 1)]


def test_results_are_not_overwritten(spark):
    path = scratch_path(spark, "once")
    writers.write_table(spark.range(3), path)
    with pytest.raises(AnalysisException):
        writers.write_table(spark.range(3), path)
    writers.write_table(spark.range(2), path, mode="overwrite")
    assert spark.read.parquet(path).count() == 2


def test_params_drop_scores(spark, tmp_path):
    (tmp_path / "p.csv").write_text(",Value\nepochs,150\nbatch_size,5\ntuned_val_roc,0.9\nelapsed_time,36.1\n")
    assert readers.params_dict(readers.read_params(spark, str(tmp_path / "p.csv"))) == {"epochs": "150", "batch_size": "5"}


def test_many_files_of_different_shapes(spark, tmp_path):
    (tmp_path / "experiment1_adult_best.csv").write_text("alpha_1,val_roc\n0.2,0.9\n")
    (tmp_path / "experiment2_adult_best.csv").write_text("alpha_1,val_roc\n0.3,0.8\n")
    (tmp_path / "experiment1_credit_real.csv").write_text("train,val\n10,5\n")
    (tmp_path / "notes_best.csv").write_text("alpha_1,val_roc\n9,9\n")
    out = readers.read_shapes(spark, [f"{tmp_path}/*_best.csv", f"{tmp_path}/*_real.csv", f"{tmp_path}/*_none.csv"],
                              r"experiment(\d+)_(\w+)_", ["experiment", "data"])
    assert sorted((r["experiment"], r["data"], r["alpha_1"], r["train"]) for r in out.collect() if r["data"] == "adult") == [
        ("1", "adult", 0.2, None), ("2", "adult", 0.3, None)]
    assert out.count() == 3


def test_split_and_synthetic_sinks(spark):
    df = spark.createDataFrame([(1, 0, "train"), (2, 1, "val")], "id int, y int, split string")
    path = scratch_path(spark, "split")
    writers.write_split(df, path)
    assert spark.read.parquet(f"{path}/split=val").count() == 1
    path = scratch_path(spark, "synth")
    writers.write_synthetic(df.drop("split"), path, "y", {0: " <=50K", 1: " >50K"}, experiment=3)
    assert {r["y"] for r in spark.read.option("header", True).csv(path).collect()} == {" <=50K", " >50K"}


def test_external_sources(spark):
    both = readers.gather_sources({"a": spark.range(2), "b": spark.range(3).withColumnRenamed("id", "other")})
    assert sorted(r["source"] for r in both.collect()) == ["a", "a", "b", "b", "b"]
