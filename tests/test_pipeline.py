"""One command writes all tables and packages; what it wrote is read again and checked."""

import json
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from newsloom import pipeline
from newsloom.__main__ import main
from newsloom.operators import catalog as C
from newsloom.runtime import FREED_SHUFFLES, Scratch, maybe_broadcast, release, shared_folder
from newsloom.sources.records import PipelineConfig

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("run")
    (out / "run.json").write_text(json.dumps({"data": DATA, "output": f"{out}/a", "stop_on_fail": False, "high_df_ratio": 0.05}))
    assert main(["all", "--config", f"{out}/run.json", "--master", "local[4]"]) == 0
    return out


def test_packages_agree_with_their_manifest(spark, done):
    for name, tables in pipeline.PACKAGES.items():
        manifest = {r["table_name"]: r for r in spark.read.json(f"{done}/a/packages/{name}/manifest.json").collect()}
        assert set(manifest) == set(tables)
        for t, r in manifest.items():
            df = spark.read.parquet(f"{done}/a/packages/{name}/{t}.parquet")
            assert (df.count(), len(df.columns)) == (r["n_rows"], r["n_columns"]) and r["n_bytes"] > 0


def test_masters_and_events_belong_together(spark, done):
    at = lambda t: spark.read.parquet(f"{done}/a/tables/{t}.parquet")
    assert at("article_master").count() == at("train_used_ids").count() > 0
    assert at("validation_article_master").count() == at("validation_only_ids").count()
    assert at("event_master").agg(F.sum("event_article_count")).first()[0] == at("article_events").count()
    assert at("train_sequences").columns[:3] == ["impression_id", "user_id", "impression_time"]


def test_reports_are_whole(done):
    report = json.loads((done / "a/reports/raw_validation_report.json").read_text())
    assert report["overall_status"] == "FAIL" and report["articles"]["row_count"] > 0
    assert (done / "a/reports/raw_validation_report.txt").read_text().startswith("overall status: FAIL\n")
    assert json.loads((done / "a/reports/sequence_counters.json").read_text())["train"]["samples"] > 0


def test_a_run_stops_where_the_tables_fail(spark, done, tmp_path):
    with pytest.raises(pipeline.Stopped):
        pipeline.preprocess(spark, PipelineConfig(DATA, f"{tmp_path}/b"))
    (tmp_path / "run.json").write_text(json.dumps({"data": DATA, "output": f"{tmp_path}/b"}))
    assert main(["validate", "--config", f"{tmp_path}/run.json", "--master", "local[4]"]) == 1
    with pytest.raises(ValueError, match="lacks the columns nothing"):
        pipeline.validate(spark, PipelineConfig(DATA, f"{tmp_path}/b", required={"articles": ["nothing"]}))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        pipeline.validate(spark, PipelineConfig(f"{tmp_path}/none", f"{tmp_path}/b"))


def test_a_run_compared_with_itself(spark, done, tmp_path):
    got = pipeline.compare(spark, f"{done}/a", f"{done}/a", f"{tmp_path}/c")
    assert got["pairs"]["added_pairs"] == got["pairs"]["removed_pairs"] == 0 and all(m["delta"] == 0 for m in got["metrics"].values())
    assert (tmp_path / "c/summary.txt").exists() and spark.read.parquet(f"{tmp_path}/c/pair_diff.parquet").isEmpty()


def test_broken_packages_are_refused(spark, done):
    t = {n: spark.read.parquet(f"{done}/a/tables/{n}.parquet") for n in pipeline.PACKAGES["train"]}
    pipeline.check_package("train", t)
    with pytest.raises(ValueError):
        pipeline.check_package("train", t | {"event_master": t["event_master"].where("event_id > 0")})
    with pytest.raises(ValueError):
        C.require_master(t["article_master"].union(t["article_master"]), 10**6, "m")
    assert C.require_master(t["article_master"], 10**6, "m") is t["article_master"]


def test_embeddings_made_elsewhere_are_checked(spark, done, tmp_path):
    rows = spark.read.parquet(f"{done}/a/tables/embedding_input.parquet").selectExpr("embedding_row", "array(float(0.6), float(0.8)) embedding")
    rows.write.parquet(f"{tmp_path}/e")
    run = pipeline.Run(spark, PipelineConfig(DATA, f"{done}/a", embeddings=f"{tmp_path}/e", embedding_width=2))
    assert "embeddings" in {r["table_name"] for r in pipeline.export_one(run, "train")}
    rows.where("embedding_row > 0").write.parquet(f"{tmp_path}/f")
    with pytest.raises(ValueError):
        pipeline.export_one(pipeline.Run(spark, PipelineConfig(DATA, f"{done}/a", embeddings=f"{tmp_path}/f", embedding_width=2)), "train")


def test_all_scratch_tables_can_be_released(spark):
    s = Scratch(spark, "t")
    s.keep(spark.range(3))
    release()
    assert not Path(s.root.removeprefix("file://")).exists() and not Scratch.open


def test_shuffle_files_of_kept_tables_go_at_once(spark):
    shuffles = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses
    before = shuffles().size()
    with Scratch(spark, "t") as scratch:
        kept = scratch.keep(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count().join(spark.range(7).withColumnRenamed("id", "k").hint("merge"), "k"))
        assert shuffles().size() <= before and kept.count() == 7
        assert spark.conf.get(FREED_SHUFFLES) == "false"


def test_scratch_tables_end_with_their_block(spark):
    with Scratch(spark, "t") as s:
        a, b = s.keep(spark.range(3)), s.keep(spark.range(4))
        s.drop(a)
        assert b.count() == 4 and s.bytes_of(b) > 0
        folder = Path(s.root.removeprefix("file://"))
        assert len([x for x in folder.iterdir() if x.is_dir()]) == 1
    assert not folder.exists()


@pytest.mark.parametrize(("master", "named", "folder"), [("local[4]", None, "file:///"), ("local", None, "file:///"), ("local-cluster[3,2,1024]", "s3://shared/x/", "s3://shared/x"), ("local-cluster[3,2,1024]", None, None), ("spark://host:7077", None, None)])
def test_a_cluster_needs_a_shared_folder(master, named, folder):
    one = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: named), sparkContext=SimpleNamespace(master=master))
    if folder:
        assert shared_folder(one).startswith(folder)
    else:
        with pytest.raises(RuntimeError):
            shared_folder(one)


def test_unions_are_not_taken_for_partitioned(spark, tmp_path):
    """Rows of one key on both sides of a union, each side partitioned by that key."""
    spark.range(2000).selectExpr("id % 300 k", "id v").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    w = t.withColumn("n", F.expr("count(*) over (partition by k)"))
    u = w.unionByName(w.where("k % 7 = 0"))
    got = u.groupBy("k").agg(F.count("*").alias("n"))
    again = got.where("n > 7").join(got.withColumnRenamed("n", "m"), "k")
    assert again.where("n <> m").isEmpty() and got.count() == 300
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    hinted = lambda df, n: "broadcast" in maybe_broadcast(df, n)._jdf.queryExecution().logical().toString().lower()
    narrow, wide = spark.range(1), spark.range(1).select(*[F.lit("x").alias(f"c{i}") for i in range(40)])
    assert hinted(narrow, 400_000) and not hinted(narrow, 400_001)
    assert hinted(wide, 1000) and not hinted(wide, 100_000)
