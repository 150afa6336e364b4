"""Every command runs over the smallest tables."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from wickerlane import cli


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """The smallest tables, with a registry of runs and submissions beside them."""
    d = tmp_path_factory.mktemp("data")
    for name in os.listdir(DATA):
        (d / name).symlink_to(f"{DATA}/{name}")
    spark.createDataFrame([("a", "{}", 0.02, 0.0221), ("b", "{}", 0.03, None)], "name string, config string, offline double, public double").write.parquet(f"{d}/runs.parquet")
    first = spark.read.parquet(f"{DATA}/articles.parquet").select("article_id").orderBy("article_id").limit(3).agg(F.concat_ws(" ", F.collect_list("article_id")).alias("prediction"))
    rows = spark.read.parquet(f"{DATA}/customers.parquet").select("customer_id").crossJoin(first)  # three articles for each of 150 customers
    for name in ("submission", "submission_1", "submission_2"):
        rows.write.parquet(f"{d}/{name}.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(cli.COMMANDS))
def test_command(spark, tmp_path, data, name):
    out = str(tmp_path / "out")
    cli.run(spark, [name, "--data", data, "--output", out, "--cutoff", "2023-12-01", "--horizon", "14"])
    if cli.COMMANDS[name][1]:
        assert json.loads((tmp_path / "out").read_text())
    else:
        assert spark.read.parquet(out).count() > 0


def test_the_command_surface():
    assert len(cli.COMMANDS) >= 26
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["nothing", "--data", "x", "--output", "y"])
