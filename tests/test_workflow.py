import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import evaluate
from lodestar.plans import config, workflow
from lodestar.sources import matrix


def test_defaults_and_values():
    assert config.parse([]) == config.Config()
    got = config.parse(["--method", "ivf", "--nlist", "32", "--dry-run", "--output", "x"])
    assert (got.method, got.nlist, got.dry_run, got.output) == ("ivf", 32, True, "x")
    assert "--nlist 100" in config.usage()


@pytest.mark.parametrize(
    "arguments, message",
    [
        (["--nonsense", "1"], "unknown option"),
        (["--k"], "missing value"),
        (["--k", "ten"], "invalid value"),
        (["--k", "-1"], "invalid value"),
        (["--k", "0"], "positive"),
        (["--threads", "0"], "threads"),
        (["--parallel", "gpu"], "parallel"),
        (["--split", "odd"], "split"),
        (["--hnsw-layout", "x"], "hnsw-layout"),
        (["--gorder-window", "0"], "gorder-window"),
        (["--hnsw-layout", "rcm"], "needs the method hnsw"),
        (["--method", "hnsw", "--hnsw-layout", "porder", "--porder-profile-queries", "0"], "porder-profile"),
        (["--method", "magic"], "method"),
    ],
)
def test_errors(arguments, message):
    with pytest.raises(ValueError, match=message):
        config.parse(arguments)


def test_labels():
    assert config.Config(method="hnsw", hnsw_layout="gorder").label == "hnsw-gorder-w5"
    assert config.Config(method="mpi-hoh", hnsw_layout="porder", porder_profile_queries=7).label == "mpi-hoh-porder-w5-p7"
    assert config.Config(method="ivf").label == "ivf" and config.Config(method="ivfpq-local-opq").rotation_rounds == 2


def test_argument_file(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", "/home/me")
    path = tmp_path / "x.conf"
    path.write_bytes(b"# a comment\r\n--method\r\nflat\r\n\r\n--output\nfiles/out\n")
    assert config.from_file(str(path)) == ["--method", "flat", "--output", "/home/me/files/out"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("data")
    names = config.Config()
    base, q = matrix.synthetic(spark, 256, 32), matrix.synthetic(spark, 32, 32, 7)
    matrix.write_file(base, str(path / names.base_file))
    matrix.write_file(q, str(path / names.query_file))
    truth = evaluate.ground_truth(base, q.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), 20)
    matrix.write_file(truth.select(F.col("qid").alias("id"), F.col("gt").alias("vec")), str(path / names.ground_truth_file), "i32bin")
    return path


SMALL = "--queries 16 --k 10 --nlist 8 --nprobe 6 --m 8 --ks 16 --train-size 128 --kmeans-iters 2 --rerank-p 64 --hnsw-m 8 --ef-construction 40 --ef-search 32 --porder-profile-queries 4 --warmup-queries 2 --threads 2".split()
RUNS = [["--method", m] for m in config.METHODS]
RUNS += [["--method", m, "--parallel", "list"] for m in ("flat", "pq")] + [["--method", "hnsw", "--hnsw-layout", x] for x in ("rcm", "gorder", "porder")] + [["--method", "mpi-hoh", "--hnsw-layout", "porder"]]


@pytest.mark.parametrize("run", RUNS, ids=["-".join(r[1::2]) for r in RUNS])
def test_smoke(spark, folder, run):
    c = config.parse([*run, *SMALL, "--data-dir", str(folder)])
    row = workflow.run(spark, c).first()
    assert row.queries == (10 if c.hnsw_layout == "porder" else 16) and row.base_count == 256 and row.dimension == 32
    exact = c.method.startswith(("flat", "sq"))
    assert row.recall == 1.0 if exact else row.recall > 0.6


def test_results_are_appended(spark, folder, tmp_path):
    out = str(tmp_path / "results")
    for method in ("flat", "sq"):
        workflow.run(spark, config.parse(["--method", method, *SMALL, "--data-dir", str(folder), "--output", out]))
    got = spark.read.option("header", True).csv(out)
    assert got.columns == [c.split()[0] for c in workflow.COLUMNS.split(", ")] and sorted(r.method for r in got.collect()) == ["flat", "sq"]


def test_dry_run_and_errors(spark, folder, capsys):
    assert workflow.main(["--dry-run", "--data-dir", str(folder), "--k", "10"]) == 0
    assert "data validation: OK" in capsys.readouterr().out
    assert workflow.main(["--dry-run", "--data-dir", str(folder), "--k", "21"]) == 1
    assert "ground-truth width" in capsys.readouterr().err
    assert workflow.main(["--data-dir", "/nowhere"]) == 1 and workflow.main(["--what"]) == 1 and workflow.main(["--help"]) == 0


def test_checks(spark, folder):
    data = workflow.load(spark, config.parse(["--data-dir", str(folder)]))
    short = data.base.withColumn("vec", F.slice("vec", 1, 5))
    with pytest.raises(ValueError, match="dimensions"):
        workflow.checked(config.Config(), short, data.queries, data.truth)
    with pytest.raises(ValueError, match="fewer rows"):
        workflow.checked(config.Config(), data.base, data.queries, data.truth.where("qid < 3"))
    with pytest.raises(ValueError, match="offset"):
        workflow.checked(config.Config(evaluation_query_offset=32), data.base, data.queries, data.truth)
    with pytest.raises(ValueError, match="leave a query"):
        workflow.checked(config.Config(method="hnsw", hnsw_layout="porder"), data.base, data.queries, data.truth)
