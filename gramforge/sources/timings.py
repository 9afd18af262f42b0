"""A data source over folders of timing files: a partition for each file, filters on what their paths say before any is opened.

    spark.read.format("timings").load("hdfs://...")   (after register(spark))

Paths end in <gpu>/<dtype>/ndev_<k>/N_<n>_T_A_<tile>.npy or N_<n>_chosolve.npy (a run without tiles: tile is null); other files
are passed over. A row is one number of a file.
"""

from __future__ import annotations

import io
import operator
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
)
from pyspark.sql.types import StructType

from gramforge.sources.folders import ship_code

PATH = re.compile(r"(?:^|/)([^/]+)/([^/]+)/ndev_(\d+)/N_(\d+)_(?:T_A_(\d+)|chosolve)\.npy$")
SCHEMA = "gpu string, dtype string, ndev int, tile int, n long, run int, seconds double"
FIELDS = ("gpu", "dtype", "ndev", "tile", "n")
COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def path_fields(path: str) -> dict | None:
    found = PATH.search(path)
    if not found:
        return None
    gpu, dtype, ndev, n, tile = found.groups()
    return {"gpu": gpu, "dtype": dtype, "ndev": int(ndev), "tile": None if tile is None else int(tile), "n": int(n)}


def holds(f: Filter, fields: dict) -> bool | None:
    """What a filter makes of a file's fields, null (None) as in SQL; KeyError where it isn't about them alone."""
    if isinstance(f, Not):
        inner = holds(f.child, fields)
        return None if inner is None else not inner
    value = fields[f.attribute[0]]
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if type(f) not in COMPARED and not isinstance(f, In):
        raise KeyError(type(f).__name__)
    if value is None:
        return None
    return value in f.value if isinstance(f, In) else COMPARED[type(f)](value, f.value)


class TimingFile(InputPartition):
    def __init__(self, path: str, fields: dict):
        super().__init__(path)
        self.path, self.fields = path, fields


class TimingReader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.filters = root, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the filters that the paths decide; the others stay with Spark."""
        probe = dict.fromkeys(FIELDS)
        for f in filters:
            try:
                holds(f, probe)
            except (KeyError, AttributeError):
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[TimingFile]:
        fs, root = pafs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (pafs.LocalFileSystem(), self.root)
        files = [(x.path, path_fields(x.path)) for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.is_file]
        return [TimingFile(path, fields) for path, fields in sorted(files, key=lambda x: x[0]) if fields and all(holds(f, fields) for f in self.filters)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, TimingFile):
            return  # Spark's own partition where there is no file
        fs = pafs.FileSystem.from_uri(self.root)[0] if "://" in self.root or self.root.startswith("file:") else pafs.LocalFileSystem()
        with fs.open_input_file(partition.path) as f:
            seconds = np.load(io.BytesIO(f.read()), allow_pickle=False).astype(float).reshape(-1)
        m, own = len(seconds), partition.fields
        kinds = {"gpu": pa.string(), "dtype": pa.string(), "ndev": pa.int32(), "tile": pa.int32(), "n": pa.int64()}
        same = [pa.array([own[c]] * m, kind) for c, kind in kinds.items()]
        yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(m), pa.int32()), pa.array(seconds)], names=[*FIELDS, "run", "seconds"])


class TimingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "timings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        if not self.options.get("path"):
            raise ValueError("the folder of the timing files is missing: load(path)")
        return TimingReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format `timings` known to a session, with filters handed to it."""
    ship_code(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TimingSource)


def write_timings(rows: DataFrame, folder: str) -> DataFrame:
    """Writes (path, seconds) as .npy files under a folder that the tasks share, a file for each path: (path, runs). A path's
    numbers are one file's, and are in one task; files are written under another name and moved, so a retry is harmless."""

    def write(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        fs, root = pafs.FileSystem.from_uri(folder)
        at = f"{root}/{key[0]}"
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        held = io.BytesIO()
        np.save(held, group["seconds"].to_numpy(float))
        with fs.open_output_stream(f"{at}.part") as f:
            f.write(held.getvalue())
        fs.move(f"{at}.part", at)
        return pd.DataFrame({"path": [key[0]], "runs": [len(group)]})

    ship_code(rows.sparkSession)
    return rows.select("path", "seconds").groupBy("path").applyInPandas(write, "path string, runs long")
