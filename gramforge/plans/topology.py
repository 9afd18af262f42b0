"""Which set-up a relation of processes and devices describes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(processes: DataFrame) -> DataFrame:
    """From (machine, process, devices, visible): one row machines, devices_per_machine, devices_per_process, mode.

    One process on each machine that sees its devices is SPMD, one device for each process is MPMD, anything else
    INVALID (also SPMD where a process has other devices than it sees).
    """
    by_machine = processes.groupBy("machine").agg(F.count(F.lit(1)).alias("p"), F.sum("devices").alias("d"), F.max("devices").alias("most"), F.max((F.col("devices") != F.col("visible")).cast("int")).alias("odd"))
    whole = by_machine.agg(F.count(F.lit(1)).alias("machines"), F.max("d").alias("devices_per_machine"), F.max("most").alias("devices_per_process"), F.max("p").alias("p"), F.max("odd").alias("odd"))
    mode = F.when((F.col("p") == 1) & (F.col("odd") == 1), "INVALID").when(F.col("p") == 1, "SPMD").when(F.col("devices_per_process") == 1, "MPMD").otherwise("INVALID")
    return whole.select(F.col("machines").cast("long"), F.col("devices_per_machine").cast("long"), F.col("devices_per_process").cast("long"), mode.alias("mode"))
