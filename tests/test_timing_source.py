"""The timing files' data source: filters on paths keep files closed, all others are Spark's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramforge.sources import timings


@pytest.fixture
def folder(tmp_path):
    for gpu, ndev, name, runs in [("a100", 1, "N_64_T_A_128", [3.0, 1.0]), ("a100", 2, "N_64_T_A_16", [9.0]), ("h100", 1, "N_128_chosolve", [4.0]), ("h100", 1, "N_64_T_A_256", [])]:
        at = tmp_path / "x" / gpu / "float64" / f"ndev_{ndev}"
        at.mkdir(parents=True, exist_ok=True)
        np.save(at / f"{name}.npy", np.array(runs))
    broken = tmp_path / "x" / "v100" / "float32" / "ndev_8"
    broken.mkdir(parents=True)
    (broken / "N_32_T_A_8.npy").write_bytes(b"no numbers")
    (tmp_path / "x" / "notes.npy").write_bytes(b"")
    return str(tmp_path)


def rows(df):
    return sorted(map(tuple, df.select("gpu", "ndev", F.coalesce("tile", F.lit(-1)), "n", "run", "seconds").collect()))


@pytest.mark.parametrize(
    "where",
    ["ndev < 8", "gpu in ('a100', 'h100')", "gpu = 'h100'", "tile >= 16", "tile is null", "not (n = 32)", "tile <=> 16", "ndev <= 2 and seconds > 2", "n > 32 and run = 0", "dtype <> 'float32' and gpu like 'a%'", "ndev = 99"],
)
def test_filters(spark, folder, where):
    """The broken file is outside each of these filters: it isn't opened, and what is found is what a filter of all finds."""
    timings.register(spark)
    made = [("a100", 1, 128, 64, 0, 3.0), ("a100", 1, 128, 64, 1, 1.0), ("a100", 2, 16, 64, 0, 9.0), ("h100", 1, None, 128, 0, 4.0)]
    want = spark.createDataFrame([(g, "float64", d, t, n, r, s) for g, d, t, n, r, s in made], timings.SCHEMA).filter(where)
    assert rows(spark.read.format("timings").load(folder).filter(where)) == rows(want)


def test_files_inside_the_filter_are_opened(spark, folder):
    timings.register(spark)
    with pytest.raises(Exception, match="ValueError|magic|EOF|pickle"):
        spark.read.format("timings").load(folder).filter("seconds > 0").collect()
    assert spark.read.format("timings").load(folder).filter("n = 7").count() == 0
    with pytest.raises(Exception, match="folder"):
        spark.read.format("timings").load().collect()


def test_written_files(spark, tmp_path):
    timings.register(spark)
    runs = spark.createDataFrame([(f"g/float64/ndev_{k % 2 + 1}/N_64_T_A_8.npy", float(k)) for k in range(7)], "path string, seconds double")
    assert {r.path[2:16] + str(r.runs) for r in timings.write_timings(runs, f"file://{tmp_path}/out").collect()} == {"float64/ndev_14", "float64/ndev_23"}
    got = spark.read.format("timings").load(f"file://{tmp_path}/out").groupBy("ndev").agg(F.sum("seconds").alias("s")).collect()
    assert {(r.ndev, r.s) for r in got} == {(1, 12.0), (2, 9.0)}
