"""The registered queries of the linear-algebra operators and their DuckDB equivalents."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.functions.dtypes import make
from gramforge.functions.layout import plain_padding
from gramforge.operators import cells as C
from gramforge.operators import eigen, grouped, krylov, layouts, sparse, tiled, vectors
from gramforge.plans import topology
from gramforge.plans.frame import REPLICATED, MatrixFrame, from_rows, matrix, to_rows
from gramforge.sources import tables, timings
from gramforge.sources.folders import remove_folder, shared_base
from gramforge.streaming.regression import SlidingRegression

TILE, DIM, LABELS = 7, 64, 10


def _rounded(c: Column, digits: int) -> Column:
    """A zero is what it is: rounding costs a decimal number each, and most cells of a matrix that falls apart are zero."""
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c, digits) + F.lit(0.0))


def r6(c: Column) -> Column:
    return _rounded(c, 6).alias("v")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _suppliers(spark: SparkSession, sf_dir: str, value: Column, dtype: str = "float64") -> MatrixFrame:
    """A diagonal matrix of one row for each supplier; `value` may use the columns of supplier."""
    t = _read(spark, sf_dir, "supplier")
    return matrix(t.select(F.col("s_suppkey").alias("i"), F.col("s_suppkey").alias("j"), make(value.cast("double"), F.lit(0.0), dtype).alias("v")), t.count())


def _numbers(spark: SparkSession, sf_dir: str, dtype: str = "float64") -> MatrixFrame:
    """diag(1..n) of n suppliers."""
    return _suppliers(spark, sf_dir, F.col("s_suppkey") + 1, dtype)


def _ones(spark: SparkSession, n: int, dtype: str = "float64") -> MatrixFrame:
    one = C.diag(spark, n, F.lit(1.0), dtype)
    return matrix(one.cells.withColumn("j", F.lit(0).cast("long")), n, 1, REPLICATED)


def _tile(a: MatrixFrame) -> int:
    """An eighth of a matrix and a bit, so that tiles don't end with it."""
    return max(3, a.rows // 8 + 2)


def _gram(spark: SparkSession, sf_dir: str) -> MatrixFrame:
    g = tables.gram(_read(spark, sf_dir, "embeddings"), "embedding", DIM)
    return g.with_cells(tiled.cut(g.cells))


def _ridge(spark: SparkSession, sf_dir: str) -> MatrixFrame:
    return C.add(_gram(spark, sf_dir), C.eye(spark, DIM))


def _solved(df: DataFrame) -> DataFrame:
    return df.select("i", "j", r6(F.col("v")), "status")


def _status(df: DataFrame) -> DataFrame:
    return df.select("i", "j", F.isnan("v").alias("is_nan"), "status")


def solve_diag(spark, sf_dir):
    a = _numbers(spark, sf_dir)
    return _solved(tiled.chol_solve(a, _ones(spark, a.rows), _tile(a)))


def solve_f32(spark, sf_dir):
    """Rounded by the digits that a number of single precision has: as a double, 1/800 would lie below the tie that it is."""
    a = _numbers(spark, sf_dir, "float32")
    x = tiled.chol_solve(a, _ones(spark, a.rows, "float32"), _tile(a))
    return x.select("i", "j", (F.round(F.col("v").cast("string").cast("double"), 4) + 0.0).alias("v"), "status")


def _shards(spark, sf_dir) -> MatrixFrame:
    """I of the suppliers, the rows of shard s times s + 1; five rows a shard."""
    return C.scale(_suppliers(spark, sf_dir, F.lit(1)), (F.floor(F.col("i") / 5) + 1).cast("double"))


def solve_shard_scaled(spark, sf_dir):
    a = _shards(spark, sf_dir)
    return _solved(tiled.chol_solve(a, _ones(spark, a.rows), _tile(a)))


def _from_minus_one(spark, sf_dir) -> MatrixFrame:
    """diag(-1, 0, 1, ...) of the suppliers."""
    return _suppliers(spark, sf_dir, F.col("s_suppkey") - 1)


def solve_not_pd(spark, sf_dir):
    a = _from_minus_one(spark, sf_dir)
    return _status(tiled.chol_solve(a, _ones(spark, a.rows), _tile(a)))


def _upper_only(spark, sf_dir, value: float, below: float = 0.0) -> DataFrame:
    """diag(1..n) of the suppliers with a cell beside its first one, and one below it."""
    a = _numbers(spark, sf_dir)
    first = a.cells.filter("i = 0")
    place = lambda i, j, v: first.select(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.lit(v).alias("v"))
    return tiled.chol_solve(a.with_cells(a.cells.unionByName(place(0, 1, value)).unionByName(place(1, 0, below))), _ones(spark, a.rows), 2 + a.rows // 4)


def solve_upper_only_ok(spark, sf_dir):
    return _solved(_upper_only(spark, sf_dir, 1.0))


def solve_upper_only_fail(spark, sf_dir):
    return _status(_upper_only(spark, sf_dir, 2.0))


def solve_lower_ignored(spark, sf_dir):
    return _solved(_upper_only(spark, sf_dir, 1.0, 99.0))


def solve_failed_minor(spark, sf_dir):
    """The Gram matrix with 1000 taken from the diagonal at column 37: its leading minor of order 38 is the first bad one."""
    spoilt = C.add(_gram(spark, sf_dir), C.diag(spark, DIM, F.when(F.col("i") == 37, -1000.0).otherwise(1.0)))
    x = tiled.chol_solve(spoilt, _ones(spark, DIM), 16, failed_minor=True)
    return x.groupBy("status", "failed_minor").agg(F.count(F.lit(1)).alias("cells"))


def _regression(spark, sf_dir):
    items = _read(spark, sf_dir, "lineitem")
    return tables.normal_equations(items, [F.lit(1.0), F.col("l_quantity"), 10 * F.col("l_discount"), 10 * F.col("l_tax")], F.col("l_extendedprice") / 1000)


def solve_regression(spark, sf_dir):
    return _solved(tiled.chol_solve(*_regression(spark, sf_dir), tile=3))


def solve_ridge_multi_rhs(spark, sf_dir):
    b = tables.label_sums(_read(spark, sf_dir, "embeddings"), "embedding", "label", DIM, LABELS)
    return _solved(tiled.chol_solve(_ridge(spark, sf_dir), b, 32))


def solve_residual(spark, sf_dir):
    a = _ridge(spark, sf_dir)
    b = tables.label_sums(_read(spark, sf_dir, "embeddings"), "embedding", "label", DIM, LABELS)
    x = tiled.chol_solve(a, b, 32).select("i", "j", "v")
    return C.residual(a, b.with_cells(x), b).cells.select("i", "j", r6(F.col("v")))


def _hermitian(spark, sf_dir) -> MatrixFrame:
    """Z^H Z + I for the embeddings as complex vectors, the first half of their numbers real, the second imaginary."""
    half, cells = DIM // 2, _gram(spark, sf_dir).cells
    sign = F.when(F.col("i") < half, F.when(F.col("j") < half, 0.0).otherwise(1.0)).otherwise(F.when(F.col("j") < half, -1.0).otherwise(0.0))
    re = F.when((F.col("i") < half) == (F.col("j") < half), F.col("v")).otherwise(0.0)
    at = cells.select((F.col("i") % half).alias("i"), (F.col("j") % half).alias("j"), re.alias("re"), (F.col("v") * sign).alias("im"))
    sums = at.groupBy("i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    one = F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
    return matrix(tiled.cut(sums.select("i", "j", F.struct((F.col("re") + one).alias("re"), F.col("im").alias("im")).alias("v"))), half)


def solve_complex(spark, sf_dir):
    x = tiled.chol_solve(_hermitian(spark, sf_dir), _ones(spark, DIM // 2, "complex128"), 7)
    return x.select("i", "j", (F.round("v.re", 6) + 0.0).alias("re"), (F.round("v.im", 6) + 0.0).alias("im"), "status")


def solve_by_group(spark, sf_dir):
    cells = _group_cells(spark, sf_dir)
    return grouped.solve_by_group(cells, "g").select("g", "i", r6(F.col("v")), "status")


def _group_cells(spark, sf_dir) -> DataFrame:
    """Per nation: account balance in thousands on a constant and the customer's key mod 7."""
    c = _read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("g"), (F.col("c_custkey") % 7).cast("double").alias("x"), (F.col("c_acctbal") / 1000).alias("y"))
    sums = c.groupBy("g").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("y")).alias("xy"))
    cell = lambda i, j, c: F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.col(c).alias("v"))
    return sums.select("g", F.inline(F.array(cell(0, 0, "n"), cell(0, 1, "x"), cell(1, 1, "xx"), cell(0, -1, "y"), cell(1, -1, "xy"))))


def sql_solve(spark, sf_dir):
    grouped.register_sql(spark)
    _group_cells(spark, sf_dir).createOrReplaceTempView("gramforge_groups")
    return spark.sql("SELECT g, i, round(v, 6) + 0.0D AS v, status FROM solve_groups(TABLE(gramforge_groups) PARTITION BY g)")


def inverse_diag(spark, sf_dir):
    a = _numbers(spark, sf_dir)
    return _solved(tiled.spd_inverse(a, _tile(a)))


def inverse_gram(spark, sf_dir):
    return _solved(tiled.spd_inverse(_ridge(spark, sf_dir), 32))


def inverse_upper(spark, sf_dir):
    return _solved(tiled.spd_inverse(_ridge(spark, sf_dir), 32, "upper"))


def inverse_not_pd(spark, sf_dir):
    a = _from_minus_one(spark, sf_dir)
    return _status(tiled.spd_inverse(a, _tile(a)))


def inverse_residual(spark, sf_dir):
    a = _ridge(spark, sf_dir)
    x = tiled.spd_inverse(a, 32).select("i", "j", "v")
    return C.add(C.matmul(a, a.with_cells(x)), C.eye(spark, DIM), -1.0).cells.select("i", "j", r6(F.col("v")))


def symmetrize(spark, sf_dir):
    return C.symmetrize_upper(C.upper(_gram(spark, sf_dir))).cells.select("i", "j", r6(F.col("v")))


def transpose(spark, sf_dir):
    a = tables.label_sums(_read(spark, sf_dir, "embeddings"), "embedding", "label", DIM, LABELS)
    return C.transpose(a).cells.select("i", "j", r6(F.col("v")))


def matmul(spark, sf_dir):
    b = tables.label_sums(_read(spark, sf_dir, "embeddings"), "embedding", "label", DIM, LABELS)
    return C.matmul(_gram(spark, sf_dir), b).cells.select("i", "j", r6(F.col("v")))


def trace_frobenius(spark, sf_dir):
    s = C.summary(_gram(spark, sf_dir))
    return s.select((F.round("trace", 6) + 0.0).alias("trace"), (F.round("frobenius", 6) + 0.0).alias("frobenius"))


def eigvals_diag(spark, sf_dir):
    a = _numbers(spark, sf_dir)
    return eigen.sym_eigen(a, False, _tile(a)).select("k", (F.round("lambda", 6) + 0.0).alias("lambda"), "status")


def eigen_diag(spark, sf_dir):
    a = _numbers(spark, sf_dir)
    e = eigen.eigen_cells(a, _tile(a), lambda lam: F.round(lam, 6) + 0.0)  # rounded once a pair, not in each of its rows
    return e.select("k", "i", "lambda", _rounded(F.col("x"), 6).alias("x"), "status")


def eigvals_invariants(spark, sf_dir):
    e = eigen.sym_eigen(_gram(spark, sf_dir), False, 32)
    return e.agg((F.round(F.sum("lambda"), 5) + 0.0).alias("sum1"), (F.round(F.sum(F.col("lambda") * F.col("lambda")), 4) + 0.0).alias("sum2"), F.count(F.lit(1)).alias("n"))


def _eigen_cells(e: DataFrame) -> DataFrame:
    return e.select("k", "lambda", F.posexplode("vec").alias("i", "v")).select(F.col("i").cast("long").alias("i"), F.col("k").alias("j"), "lambda", "v")


def eigen_residual(spark, sf_dir):
    """A V - V diag(lambda), which is 0."""
    a = _gram(spark, sf_dir)
    v = tiled.cut(_eigen_cells(eigen.sym_eigen(a, True, 16)))
    av = C.matmul(a, matrix(v.select("i", "j", "v"), DIM))
    return C.add(av, matrix(v.select("i", "j", (F.col("v") * F.col("lambda")).alias("v")), DIM), -1.0).cells.select("i", "j", r6(F.col("v")))


def eigen_orthogonality(spark, sf_dir):
    """V^T V, which is I."""
    v = matrix(tiled.cut(_eigen_cells(eigen.sym_eigen(_gram(spark, sf_dir), True, 32)).select("i", "j", "v")), DIM)
    return C.matmul(C.transpose(v), v).cells.select("i", "j", r6(F.col("v")))


def eigvals_2x2_by_group(spark, sf_dir):
    p = _read(spark, sf_dir, "part").withColumn("g", F.col("p_brand"))
    e = grouped.eigvals_by_group(tables.covariance_by_group(p, "g", F.col("p_size").cast("double"), F.col("p_retailprice") / 100), "g")
    return e.select("g", "k", (F.round("lambda", 6) + 0.0).alias("lambda"), "status")


def eigvals_complex(spark, sf_dir):
    e = eigen.sym_eigen(_hermitian(spark, sf_dir), False, 10)
    return e.agg((F.round(F.sum("lambda"), 5) + 0.0).alias("sum1"), (F.round(F.sum(F.col("lambda") * F.col("lambda")), 4) + 0.0).alias("sum2"))


def padding_grid(spark, sf_dir):
    """Part sizes as shards, the quantities they were ordered in as tiles."""
    pairs = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_size").cast("long").alias("shard"), F.col("l_quantity").cast("long").alias("tile")).distinct()
    return pairs.withColumn("pad", plain_padding(F.col("shard"), F.col("tile")))


def cyclic_map(spark, sf_dir):
    """The parts as columns, in tiles of 7 over 4 shards."""
    return layouts.cyclic_map(spark, _read(spark, sf_dir, "part").count(), 7, 4)


def cyclic_identity(spark, sf_dir):
    """Tiles as wide as a shard leave the parts where they are."""
    n = _read(spark, sf_dir, "part").count()
    return layouts.cyclic_map(spark, n, n // 4, 4)


def cyclic_rows(spark, sf_dir):
    dealt = layouts.cyclic_layout(_gram(spark, sf_dir), 5, 4)
    return dealt.groupBy("device").agg(F.count(F.lit(1)).alias("cells"), F.sum("dst").alias("dst_sum"), (F.round(F.sum("v"), 5) + 0.0).alias("v_sum"))


def cyclic_inverse(spark, sf_dir):
    return layouts.blocks_again(layouts.cyclic_layout(_gram(spark, sf_dir), 5, 4), DIM, 5, 4).select("i", "j", r6(F.col("v")))


def cyclic_verify(spark, sf_dir):
    g = _gram(spark, sf_dir)
    return layouts.verify_cyclic(g, layouts.cyclic_layout(g, 5, 4), 5, 4)


def padded_rows(spark, sf_dir):
    return layouts.padded_rows(spark, _read(spark, sf_dir, "part").count(), 7, 4)


def ownership_plot_data(spark, sf_dir):
    return layouts.ownership(spark, _read(spark, sf_dir, "part").count(), 7, 4)


def regather_2d(spark, sf_dir):
    """The parts' columns on four devices, gathered to two hosts."""
    parts = _read(spark, sf_dir, "part")
    owners = parts.select(F.expr(f"cast(p_partkey * 4 div {parts.count()} as int)").alias("device"), F.col("p_partkey").alias("col"))
    hosts = spark.range(4).select(F.expr("cast(id div 2 as int)").alias("host"), F.col("id").cast("int").alias("device"))
    return layouts.regather(owners, hosts)


def topology_mode(spark, sf_dir):
    """Users of events as processes: one on each machine with all devices, many on seven machines with one or two."""
    users = _read(spark, sf_dir, "events").select(F.col("user_id").cast("int").alias("u")).distinct()
    out = None
    for case, (machine, devices, visible) in enumerate([("u", 4, 4), ("u % 7", 1, 1), ("u % 7", 2, 2), ("u", 2, 4)]):
        rows = users.select(F.expr(machine).alias("machine"), F.col("u").alias("process"), F.lit(devices).alias("devices"), F.lit(visible).alias("visible"))
        one = topology.classify(rows).withColumn("case", F.lit(case))
        out = one if out is None else out.union(one)
    return out.select("case", "machines", "devices_per_machine", "devices_per_process", "mode")


def bench_medians(spark, sf_dir):
    return tables.bench_medians(_timings(spark, sf_dir), 128)


def _timings(spark, sf_dir, root: Column | None = None) -> DataFrame:
    """The values of events as seconds of runs: the type is the device's name; users deal out devices, sizes and tiles (one in
    four runs without tiles); errors have paths of another form."""
    e = _read(spark, sf_dir, "events").select("event_type", "value", "event_id", F.col("user_id").alias("u"), F.col("event_id").alias("e"))
    run = F.when(F.col("e") % 4 == 3, F.lit("chosolve")).otherwise(F.concat(F.lit("T_A_"), F.element_at(F.array(F.lit("16"), F.lit("128"), F.lit("256")), (F.col("e") % 4 + 1).cast("int"))))
    path = F.concat(F.lit("runs/") if root is None else root, F.col("event_type"), F.lit("/float64/ndev_"), (1 + F.col("u") % 2).cast("string"), F.lit("/N_"), (64 * (1 + F.col("u") % 3)).cast("string"), F.lit("_"), run, F.when(F.col("event_type") == "error", ".txt").otherwise(".npy"))
    return e.select(path.alias("path"), F.col("value").alias("seconds"))


def timing_by_tile(spark, sf_dir):
    return _line_points(tables.timing_lines(tables.bench_medians(_timings(spark, sf_dir)), "tile"), "ndev")


def timing_by_devices(spark, sf_dir):
    return _line_points(tables.timing_lines(tables.bench_medians(_timings(spark, sf_dir)), "ndev"), "tile")


def _line_points(lines: DataFrame, other: str) -> DataFrame:
    return lines.select("gpu", "dtype", other, "line", F.posexplode(F.arrays_zip("ns", "seconds")).alias("place", "p")).select("gpu", "dtype", other, "line", "place", F.col("p.ns").alias("n"), F.col("p.seconds").alias("median_s"))


def process_status(spark, sf_dir):
    """Events as log lines of 200 processes: errors failed, signups are summaries, views are broken lines."""
    e = _read(spark, sf_dir, "events")
    body = F.to_json(F.struct(F.col("user_id").alias("proc"), F.col("event_type").alias("name"), F.when(F.col("event_type") == "error", "fail").otherwise("ok").alias("status")))
    kind = F.when(F.col("event_type") == "signup", "MPTEST_SUMMARY ").when(F.col("event_type") == "view", "said MPTEST_RESULT ").otherwise("MPTEST_RESULT ")
    return tables.process_status(e.select(F.concat(kind, body).alias("line")), 200)


def solve_complex64(spark, sf_dir):
    h = _hermitian(spark, sf_dir)
    single = h.with_cells(h.cells.withColumn("v", F.col("v").cast("struct<re:float,im:float>")))
    x = tiled.chol_solve(single, _ones(spark, h.rows, "complex64"), 10)
    return x.select("i", "j", (F.round(F.col("v.re").cast("double"), 3) + 0.0).alias("re"), (F.round(F.col("v.im").cast("double"), 3) + 0.0).alias("im"), "status")


def inverse_f32(spark, sf_dir):
    """The inverse in single precision, each row times i + 1: 1 on the diagonal (1/32 itself is a tie of four digits)."""
    a = _numbers(spark, sf_dir, "float32")
    return tiled.spd_inverse(a, _tile(a)).select("i", "j", _rounded(F.col("v").cast("double") * (F.col("i") + 1), 4).alias("v"), "status")


def inverse_complex_residual(spark, sf_dir):
    """A A^-1 - I of a Hermitian matrix, which is 0."""
    a = _hermitian(spark, sf_dir)
    x = a.with_cells(tiled.spd_inverse(a, 9).select("i", "j", "v"))
    return C.add(C.matmul(a, x), C.eye(spark, a.rows, dtype="complex128"), -1.0).cells.select("i", "j", (F.round("v.re", 6) + 0.0).alias("re"), (F.round("v.im", 6) + 0.0).alias("im"))


def eigvals_f32(spark, sf_dir):
    a = _numbers(spark, sf_dir, "float32")
    return eigen.sym_eigen(a, False, _tile(a)).select("k", (F.round(F.col("lambda").cast("double"), 2) + 0.0).alias("lambda"), "status")


def eigen_complex_residual(spark, sf_dir):
    """A V - V diag(lambda) of a Hermitian matrix, which is 0."""
    a = _hermitian(spark, sf_dir)
    v = tiled.cut(_eigen_cells(eigen.sym_eigen(a, True, 10)))
    av = C.matmul(a, matrix(v.select("i", "j", "v"), a.rows))
    scaled = matrix(v.select("i", "j", F.struct((F.col("v.re") * F.col("lambda")).alias("re"), (F.col("v.im") * F.col("lambda")).alias("im")).alias("v")), a.rows)
    return C.add(av, scaled, -1.0).cells.select("i", "j", (F.round("v.re", 6) + 0.0).alias("re"), (F.round("v.im", 6) + 0.0).alias("im"))


def eigvals_shard_scaled(spark, sf_dir):
    a = _shards(spark, sf_dir)
    return eigen.sym_eigen(a, False, _tile(a)).select("k", (F.round("lambda", 6) + 0.0).alias("lambda"), "status")


def eigen_not_finite(spark, sf_dir):
    a = _suppliers(spark, sf_dir, F.when(F.col("s_suppkey") == 2, F.lit(float("nan"))).otherwise(1.0))
    return eigen.sym_eigen(a, False, 4).select("k", F.isnan("lambda").alias("is_nan"), "status")


def random_definite(spark, sf_dir):
    """As large as there are nations: its trace is near n, it equals its transpose, and it is positive definite."""
    n = _read(spark, sf_dir, "nation").count()
    a = C.random_definite(spark, n)
    differs = C.add(a, C.transpose(a), -1.0).cells.agg(F.max(F.abs("v")).alias("d"))
    status = tiled.chol_solve(a, _ones(spark, n), TILE).agg(F.max("status").alias("status"), F.count(F.lit(1)).alias("n"))
    return C.summary(a).crossJoin(differs).crossJoin(status).select(F.col("trace").between(0.5 * n, 1.5 * n).alias("trace_near_n"), (F.col("d") < 1e-12).alias("symmetric"), "status", "n")


def _trade(spark, sf_dir) -> MatrixFrame:
    """How many items customers of a nation (row) had from suppliers of a nation (column); pairs without one have no cell."""
    items = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    cells = items.groupBy(F.col("c_nationkey").cast("long").alias("i"), F.col("s_nationkey").cast("long").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return matrix(cells, _read(spark, sf_dir, "nation").count())


def rows_round_trip(spark, sf_dir):
    """Cells of the nations' trade to rows and back; what has no cell is zero."""
    a = _trade(spark, sf_dir)
    return from_rows(to_rows(a), a.rows).cells.select("i", "j", r6(F.col("v")))


def asymmetric_cells(spark, sf_dir):
    """The nations' trade both ways, one cell of it changed and one gone."""
    a = _trade(spark, sf_dir)
    both = C.add(a, C.transpose(a)).cells.filter("not (i = 5 and j = 2)").withColumn("v", F.when((F.col("i") == 3) & (F.col("j") == 17), F.col("v") + 1).otherwise(F.col("v")))
    return tiled.asymmetric_cells(a.with_cells(both), 4)


def _baskets(spark, sf_dir) -> MatrixFrame:
    """Orders by parts: the quantity of each item; a part that an order has twice has two cells."""
    items = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))
    return matrix(items, _read(spark, sf_dir, "orders").count(), _read(spark, sf_dir, "part").count())


def matvec_orders(spark, sf_dir):
    """What each order would cost at retail prices: quantities times the vector of prices."""
    parts = _read(spark, sf_dir, "part")
    price = matrix(parts.select(F.col("p_partkey").alias("i"), F.lit(0).cast("long").alias("j"), F.col("p_retailprice").alias("v")), parts.count(), 1, REPLICATED)
    return vectors.matvec(_baskets(spark, sf_dir), price).cells.select("i", (F.round("v", 4) + 0.0).alias("v"))


def matmul_sparse(spark, sf_dir):
    """Parts by parts over orders: the shapes allow more products than are joined one by one, the cells don't. By part: how
    many parts stand beside it, and the sum of the products of quantities."""
    b = _baskets(spark, sf_dir)
    return C.matmul(C.transpose(b), b).cells.groupBy("i").agg(F.count(F.lit(1)).alias("parts"), (F.round(F.sum("v"), 4) + 0.0).alias("total"))


def matmul_tiles(spark, sf_dir):
    """All embeddings against all: more products than are joined one by one, so tiles. By row: cells, and their sum and sum
    of squares."""
    rows = _read(spark, sf_dir, "embeddings")
    x = matrix(rows.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")), rows.count(), DIM)
    found = tiled.product_rows(x, C.transpose(x))
    return found.select("i", "cells", *[(F.round(c, 5) + 0.0).alias(c) for c in ("total", "squares")])


def top_eigen_gram(spark, sf_dir):
    """The three largest and smallest eigenpairs of the Gram matrix: the outermost value of either end, and what is left of
    A v - lambda v and of V^T V - I."""
    a = _gram(spark, sf_dir)
    return _ends(a, "largest", krylov.top_eigen(a, 3, "largest", vectors=True, block=8)).unionByName(_ends(a, "smallest", krylov.top_eigen(a, 3, "smallest", vectors=True, block=8)))


def _ends(a: MatrixFrame, name: str, found: DataFrame) -> DataFrame:
    v = found.select("i", F.col("k").alias("j"), "v", "lambda", "status")
    own = a.with_cells(v.select("i", "j", "v"), a.rows, 3)
    left = C.add(vectors.matvec(a, own), own.with_cells(v.select("i", "j", (F.col("v") * F.col("lambda")).alias("v"))), -1.0)
    size = C.summary(left).select((F.round("frobenius", 6) + 0.0).alias("residual"))
    apart = C.summary(C.add(C.matmul(C.transpose(own), own), C.eye(a.spark, 3), -1.0)).select((F.round("frobenius", 6) + 0.0).alias("skew"))
    top = v.filter("j = 0").agg((F.round(F.max("lambda"), 4) + 0.0).alias("lambda"), F.max("status").alias("status"))
    return top.crossJoin(size).crossJoin(apart).select(F.lit(name).alias("which"), "lambda", "residual", "skew", "status")  # one row each


def top_eigen_copurchase(spark, sf_dir):
    """The largest eigenvalue of the sparse matrix of parts that stand in orders together (times of both, by order), and its
    vector's sum, its sign being that of the sum."""
    once = _baskets(spark, sf_dir)
    held = once.with_cells(once.cells.select("i", "j").distinct().withColumn("v", F.lit(1.0)))
    v = krylov.top_eigen(held, 1, vectors=True, confirm=False, block=1, ones=True, gram=True)
    return v.agg((F.round(F.max("lambda"), 4) + 0.0).alias("lambda"), (F.round(F.abs(F.sum("v")), 4) + 0.0).alias("total"), F.count(F.lit(1)).alias("n"), F.max("status").alias("status"))


def pad_rows(spark, sf_dir):
    """Cells a shard has with its padding, 16 rows a shard in tiles of 5."""
    padded = layouts.pad_rows(_blocks(spark, sf_dir), DIM, 5, 4)
    return padded.groupBy("device", "local_off").agg(F.count(F.lit(1)).alias("cells"), F.sum((F.col("v") != 0).cast("long")).alias("filled"))


def unpad_rows(spark, sf_dir):
    padded = layouts.pad_rows(_blocks(spark, sf_dir), DIM, 5, 4)
    return layouts.unpad_rows(padded, DIM, 4).select("device", "local_off", "j", r6(F.col("v")))


def unpad_nothing(spark, sf_dir):
    """Tiles of 4 fill 16 rows: nothing is padded, and nothing goes."""
    padded = layouts.pad_rows(_blocks(spark, sf_dir), DIM, 4, 4)
    return layouts.unpad_rows(padded, DIM, 4).select("device", "local_off", "j", r6(F.col("v")))


def _blocks(spark, sf_dir) -> DataFrame:
    """The Gram matrix as four blocks of rows."""
    return _gram(spark, sf_dir).cells.select(F.expr("cast(i div 16 as int)").alias("device"), (F.col("i") % 16).alias("local_off"), "j", "v")


def cyclic_verify_changed(spark, sf_dir):
    """A layout with one cell changed and one gone."""
    g = _gram(spark, sf_dir)
    dealt = layouts.cyclic_layout(g, 5, 4).filter("not (j = 3 and dst = 7)").withColumn("v", F.when((F.col("j") == 4) & (F.col("dst") == 7), F.col("v") + 1).otherwise(F.col("v")))
    return layouts.verify_cyclic(g, dealt, 5, 4)


def sql_inverse(spark, sf_dir):
    grouped.register_sql(spark)
    _group_cells(spark, sf_dir).createOrReplaceTempView("gramforge_groups")
    return spark.sql("SELECT g, i, j, round(v, 6) + 0.0D AS v, status FROM inverse_groups(TABLE(gramforge_groups) PARTITION BY g)")


def sql_eigvals(spark, sf_dir):
    grouped.register_sql(spark)
    _part_covariance(spark, sf_dir).createOrReplaceTempView("gramforge_covariances")
    return spark.sql("SELECT g, k, round(lambda, 6) + 0.0D AS lambda, status FROM eigvals_groups(TABLE(gramforge_covariances) PARTITION BY g)")


def _part_covariance(spark, sf_dir) -> DataFrame:
    p = _read(spark, sf_dir, "part").withColumn("g", F.col("p_size").cast("long") % 7)
    return tables.covariance_by_group(p, "g", F.col("p_size").cast("double"), F.col("p_retailprice") / 100)


def solve_many_by_group(spark, sf_dir):
    """Two right-hand sides for each nation: the sums, and twice the sums."""
    cells = _group_cells(spark, sf_dir)
    more = cells.filter("j = -1").select("g", "i", F.lit(-2).cast("long").alias("j"), (F.col("v") * 2).alias("v"))
    return grouped.solve_many_by_group(cells.unionByName(more), "g").select("g", "i", "j", r6(F.col("v")), "status")


def solve_group_without_matrix(spark, sf_dir):
    """Nations of odd keys with right-hand sides alone are not definite; they fail alone."""
    x = grouped.solve_by_group(_group_cells(spark, sf_dir).filter("g % 2 = 0 or j < 0"), "g")
    return x.select("g", "i", F.isnan("v").alias("is_nan"), "status")


def timing_source(spark, sf_dir):
    """The runs of events as files, ten thousand events a folder, read again through the source with filters on their paths."""
    timings.register(spark)
    folder = f"{shared_base(spark)}/timings-{uuid.uuid4().hex}"
    runs = _timings(spark, sf_dir, F.concat(F.lit("part_"), F.expr("event_id div 10000").cast("string"), F.lit("/"))).filter("path like '%.npy'")
    timings.write_timings(runs, folder).write.format("noop").mode("overwrite").save()
    found = spark.read.format("timings").load(folder).filter("ndev = 1 and tile >= 128 and n < 192 and seconds > 1")
    out = found.groupBy("gpu", "tile", "n").agg(F.count(F.lit(1)).alias("runs"), (F.round(F.sum("seconds"), 4) + 0.0).alias("total"))
    out = tiled.cut(out)
    remove_folder(spark, folder)
    return out


def sparse_solve(spark, sf_dir):
    """Prices smoothed over the hierarchy of orders, customers, nations and regions: (I + the Laplacian of that tree) x = b, b
    being the price of an order in thousands and 0 above. Orders come first, so nothing is filled in. By kind: how many, and
    sums of x and of its square."""
    orders, customers, nations, regions = (_read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    at = [0, orders.count()]
    for t in (customers, nations, regions):
        at.append(at[-1] + t.count())
    edge = lambda t, low, high, k: t.select((F.col(low) + at[k]).cast("long").alias("i"), (F.col(high) + at[k + 1]).cast("long").alias("j"))
    edges = edge(orders, "o_orderkey", "o_custkey", 0).unionByName(edge(customers, "c_custkey", "c_nationkey", 1)).unionByName(edge(nations, "n_nationkey", "n_regionkey", 2))
    # an edge is a cell and one more on the diagonal for either end, which are summed
    cells = edges.select(F.inline(F.array(*[F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.lit(v).alias("v")) for i, j, v in (("i", "j", -1.0), ("i", "i", 1.0), ("j", "j", 1.0))])))
    a = matrix(cells.unionByName(C.eye(spark, at[-1]).cells), at[-1])
    b = matrix(orders.select(F.col("o_orderkey").alias("i"), F.lit(0).cast("long").alias("j"), (F.col("o_totalprice") / 1000).alias("v")), at[-1], 1, REPLICATED)
    x = sparse.sparse_solve(a, b)
    kind = sum((F.when(F.col("i") >= k, 1).otherwise(0) for k in at[1:-1]), F.lit(0))
    return x.groupBy(kind.cast("int").alias("kind"), "status").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("v"), 3) + 0.0).alias("total"), (F.round(F.sum(F.col("v") * F.col("v")), 2) + 0.0).alias("squares"))


def stream_regression(spark, sf_dir):
    """Values of events on a constant, the user and the type, over the last ten days of the stream. The events come as a
    stream of the files of a copy of the table, some at a time and not in order of time."""
    folder = f"{shared_base(spark)}/stream-{uuid.uuid4().hex}"
    events = _read(spark, sf_dir, "events")
    events.repartitionByRange(6, "ts").write.parquet(f"{folder}/events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/events")
    features = [F.lit(1.0), F.col("user_id") / 100, (F.col("event_type") == "purchase").cast("double")]
    regression = SlidingRegression(f"{folder}/window", "ts", features, F.col("value"), timedelta(days=10))
    query = regression.start(stream, f"{folder}/checkpoint")
    query.awaitTermination()
    found = regression.solution(spark, query.lastProgress["batchId"])
    remove_folder(spark, folder)
    return found.select("i", r6(F.col("v")), "rows", "status")


def _eliminated(aug: str, n: int, wide: int, select: str) -> str:
    """Gauss-Jordan elimination of n rows of `wide` numbers, no pivots: the left part is positive definite."""
    return f"""WITH RECURSIVE {aug},
init AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM aug GROUP BY i)),
ge(k, m) AS (SELECT 1, m FROM init UNION ALL
  SELECT k + 1, list_transform(range(1, {n + 1}), lambda r: CASE WHEN r = k THEN list_transform(m[k], lambda z: z / m[k][k])
    ELSE list_transform(range(1, {wide + 1}), lambda c: m[r][c] - m[r][k] / m[k][k] * m[k][c]) END) FROM ge WHERE k <= {n}),
done AS (SELECT m FROM ge WHERE k = {n + 1})
{select}"""


_PLACES = f"x AS (SELECT vec_id, label, unnest(range({DIM})) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_GRAM = f"{_PLACES}, gram AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM x a JOIN x b USING (vec_id) GROUP BY ALL)"
_B = "b AS (SELECT i, label AS j, sum(x) AS v FROM x GROUP BY ALL)"
_RIDGE = f"{_GRAM}, ridge AS (SELECT i, j, v + CASE WHEN i = j THEN 1 ELSE 0 END AS v FROM gram)"
_RIDGE_B = f"{_RIDGE}, {_B}, aug AS (SELECT i, j, v FROM ridge UNION ALL SELECT t.i, {DIM} + l.j, coalesce(b.v, 0) FROM range({DIM}) t(i) CROSS JOIN range({LABELS}) l(j) LEFT JOIN b ON b.i = t.i AND b.j = l.j)"
_RIDGE_I = f"{_RIDGE}, aug AS (SELECT i, j, v FROM ridge UNION ALL SELECT t.i, {DIM} + l.j, CASE WHEN t.i = l.j THEN 1 ELSE 0 END FROM range({DIM}) t(i) CROSS JOIN range({DIM}) l(j))"


def _square(n: int | str, where: str = "true") -> str:
    return f"FROM range({n}) t(i) CROSS JOIN range({n}) l(j) WHERE {where}"


_TRADE = "trade AS (SELECT c_nationkey::BIGINT AS i, s_nationkey::BIGINT AS j, count(*)::DOUBLE AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"
_N = "(SELECT count(*) FROM supplier)"
_PARTS = "(SELECT count(*) FROM part)"
_RUNS = """SELECT event_type AS gpu, 'float64' AS dtype, (1 + user_id % 2)::INT AS ndev, CASE event_id % 4 WHEN 0 THEN 16 WHEN 1 THEN 128 WHEN 2 THEN 256 END::INT AS tile, (64 * (1 + user_id % 3))::BIGINT AS n, value FROM events WHERE event_type <> 'error'"""
_MEDIANS = f"SELECT gpu, dtype, ndev, tile, n, median(value) AS median_s, count(*) AS runs FROM ({_RUNS}) GROUP BY ALL"
_INVERSE = f"SELECT t.i, l.j, round(m[t.i + 1][{DIM} + 1 + l.j], 6) + 0.0 AS v, 0::INT AS status FROM done CROSS JOIN range({DIM}) t(i) CROSS JOIN range({DIM}) l(j)"
_LAYOUT = """SELECT col::BIGINT AS col, col + pad * (col // shard) AS src, dev * (shard + pad) + off AS dst, dev::INT AS device, tile, off AS local_off FROM (
SELECT *, tile % {d} AS dev, (tile // {d}) * w + col % w AS off FROM (SELECT col, {n} // {d} AS shard, least({t}, {n} // {d}) AS w, CASE WHEN {t} >= {n} // {d} THEN 0 ELSE ({t} - ({n} // {d}) % {t}) % {t} END AS pad, col // least({t}, {n} // {d}) AS tile FROM range({n}) r(col)))"""
_HERMITIAN = f"""{_GRAM}, h AS (SELECT i % 32 AS i, j % 32 AS j, sum(CASE WHEN (i < 32) = (j < 32) THEN v ELSE 0 END) + CASE WHEN i % 32 = j % 32 THEN 1 ELSE 0 END AS re,
sum(CASE WHEN i < 32 AND j >= 32 THEN v WHEN i >= 32 AND j < 32 THEN -v ELSE 0 END) AS im FROM gram GROUP BY i % 32, j % 32)"""
_HERMITIAN_ONE = f"{_HERMITIAN}, aug AS (SELECT i, j, re AS v FROM h UNION ALL SELECT i, j + 32, -im FROM h UNION ALL SELECT i + 32, j, im FROM h UNION ALL SELECT i + 32, j + 32, re FROM h UNION ALL SELECT i, 64, CASE WHEN i < 32 THEN 1 ELSE 0 END FROM range(64) t(i))"
_GROUPS = """SELECT c_nationkey::BIGINT AS g, count(*)::DOUBLE AS n, sum(x) AS x, sum(x * x) AS xx, sum(y) AS y, sum(x * y) AS xy FROM (SELECT c_nationkey, (c_custkey % 7)::DOUBLE AS x, c_acctbal / 1000 AS y FROM customer) GROUP BY 1"""
_BY_GROUP = f"""SELECT g, i::BIGINT AS i, round(CASE WHEN i = 0 THEN (xx * y - x * xy) / (n * xx - x * x) ELSE (n * xy - x * y) / (n * xx - x * x) END, 6) + 0.0 AS v, 0::INT AS status FROM ({_GROUPS}) CROSS JOIN range(2) r(i)"""

ORACLES = {
    "solve_diag": "SELECT s_suppkey AS i, 0::BIGINT AS j, round(1.0::DOUBLE / (s_suppkey + 1), 6) + 0.0 AS v, 0::INT AS status FROM supplier",
    "solve_f32": "SELECT s_suppkey AS i, 0::BIGINT AS j, round(1.0::DOUBLE / (s_suppkey + 1), 4) + 0.0 AS v, 0::INT AS status FROM supplier",
    "solve_shard_scaled": "SELECT s_suppkey AS i, 0::BIGINT AS j, round(1.0::DOUBLE / (s_suppkey // 5 + 1), 6) + 0.0 AS v, 0::INT AS status FROM supplier",
    "solve_not_pd": "SELECT s_suppkey AS i, 0::BIGINT AS j, true AS is_nan, 7::INT AS status FROM supplier",
    "solve_upper_only_ok": "SELECT s_suppkey AS i, 0::BIGINT AS j, round(CASE s_suppkey WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 1.0::DOUBLE / (s_suppkey + 1) END::DOUBLE, 6) + 0.0::DOUBLE AS v, 0::INT AS status FROM supplier",
    "solve_upper_only_fail": "SELECT s_suppkey AS i, 0::BIGINT AS j, true AS is_nan, 7::INT AS status FROM supplier",
    "solve_lower_ignored": "SELECT s_suppkey AS i, 0::BIGINT AS j, round(CASE s_suppkey WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 1.0::DOUBLE / (s_suppkey + 1) END::DOUBLE, 6) + 0.0::DOUBLE AS v, 0::INT AS status FROM supplier",
    "solve_regression": _eliminated(
        "f AS (SELECT [1.0::DOUBLE, l_quantity, 10 * l_discount, 10 * l_tax, l_extendedprice / 1000] AS f FROM lineitem), aug AS (SELECT i, j, sum(f[i + 1] * f[j + 1]) AS v FROM f CROSS JOIN range(4) t(i) CROSS JOIN range(5) l(j) GROUP BY ALL)",
        4, 5, "SELECT i, 0::BIGINT AS j, round(m[i + 1][5], 6) + 0.0 AS v, 0::INT AS status FROM done CROSS JOIN range(4) t(i)"),
    "solve_ridge_multi_rhs": _eliminated(_RIDGE_B, DIM, DIM + LABELS, f"SELECT t.i, l.j, round(m[t.i + 1][{DIM} + 1 + l.j], 6) + 0.0 AS v, 0::INT AS status FROM done CROSS JOIN range({DIM}) t(i) CROSS JOIN range({LABELS}) l(j)"),
    "solve_residual": f"SELECT t.i, l.j, 0.0::DOUBLE AS v FROM range({DIM}) t(i) CROSS JOIN range({LABELS}) l(j)",
    "solve_complex": _eliminated(_HERMITIAN_ONE, 64, 65, "SELECT i, 0::BIGINT AS j, round(m[i + 1][65], 6)::DOUBLE + 0.0::DOUBLE AS re, round(m[i + 33][65], 6)::DOUBLE + 0.0::DOUBLE AS im, 0::INT AS status FROM done CROSS JOIN range(32) t(i)"),
    "solve_by_group": _BY_GROUP,
    "sql_solve": _BY_GROUP,
    "inverse_diag": f"SELECT i, j, CASE WHEN i = j THEN round(1.0::DOUBLE / (i + 1), 6) ELSE 0.0::DOUBLE END AS v, 0::INT AS status {_square(_N)}",
    "inverse_gram": _eliminated(_RIDGE_I, DIM, 2 * DIM, _INVERSE),
    "inverse_upper": _eliminated(_RIDGE_I, DIM, 2 * DIM, f"{_INVERSE} WHERE l.j >= t.i"),
    "inverse_not_pd": f"SELECT i, j, true AS is_nan, 7::INT AS status {_square(_N)}",
    "inverse_residual": f"SELECT i, j, 0.0::DOUBLE AS v {_square(DIM)}",
    "symmetrize": f"WITH {_GRAM} SELECT i, j, round(v, 6) + 0.0 AS v FROM gram",
    "transpose": f"WITH {_PLACES}, {_B} SELECT j::BIGINT AS i, i AS j, round(v, 6) + 0.0 AS v FROM b",
    "matmul": f"WITH {_GRAM}, {_B} SELECT g.i, b.j::BIGINT AS j, round(sum(g.v * b.v), 6) + 0.0 AS v FROM gram g JOIN b ON g.j = b.i GROUP BY ALL",
    "trace_frobenius": f"WITH {_GRAM} SELECT round(sum(v) FILTER (WHERE i = j), 6) + 0.0 AS trace, round(sqrt(sum(v * v)), 6) + 0.0 AS frobenius FROM gram",
    "eigvals_diag": "SELECT s_suppkey AS k, (s_suppkey + 1)::DOUBLE AS lambda, 0::INT AS status FROM supplier",
    "eigen_diag": f"SELECT i AS k, j AS i, (i + 1)::DOUBLE AS lambda, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x, 0::INT AS status {_square(_N)}",
    "eigvals_invariants": f"WITH {_GRAM} SELECT round(sum(v) FILTER (WHERE i = j), 5) + 0.0 AS sum1, round(sum(v * v), 4) + 0.0 AS sum2, {DIM}::BIGINT AS n FROM gram",
    "eigen_residual": f"SELECT i, j, 0.0::DOUBLE AS v {_square(DIM)}",
    "eigen_orthogonality": f"SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v {_square(DIM)}",
    "eigvals_2x2_by_group": "SELECT g, k, round((xx + yy) / 2 + CASE WHEN k = 0 THEN -1 ELSE 1 END * sqrt((xx - yy) * (xx - yy) / 4 + xy * xy), 6) + 0.0 AS lambda, 0::INT AS status FROM (SELECT p_brand AS g, var_pop(p_size::DOUBLE) AS xx, covar_pop(p_size::DOUBLE, p_retailprice / 100) AS xy, var_pop(p_retailprice / 100) AS yy FROM part GROUP BY 1) CROSS JOIN range(2) r(k)",
    "eigvals_complex": f"WITH {_HERMITIAN} SELECT round((sum(re) FILTER (WHERE i = j))::DOUBLE, 5) + 0.0::DOUBLE AS sum1, round(sum(re * re + im * im)::DOUBLE, 4) + 0.0::DOUBLE AS sum2 FROM h",
    "padding_grid": "SELECT DISTINCT p_size::BIGINT AS shard, l_quantity::BIGINT AS tile, (l_quantity::BIGINT - p_size % l_quantity::BIGINT) % l_quantity::BIGINT AS pad FROM lineitem JOIN part ON l_partkey = p_partkey",
    "cyclic_map": _LAYOUT.format(n=_PARTS, t=7, d=4),
    "cyclic_identity": _LAYOUT.format(n=_PARTS, t=f"({_PARTS} // 4)", d=4),
    "cyclic_rows": f"WITH {_GRAM} SELECT device, count(*) AS cells, sum(dst)::BIGINT AS dst_sum, round(sum(v), 5) + 0.0 AS v_sum FROM gram JOIN ({_LAYOUT.format(n=DIM, t=5, d=4)}) l ON l.col = gram.i GROUP BY 1",
    "cyclic_inverse": f"WITH {_GRAM} SELECT i, j, round(v, 6) + 0.0 AS v FROM gram",
    "cyclic_verify": "SELECT 0::BIGINT AS mismatches",
    "padded_rows": f"SELECT d::INT AS device, o AS local_off FROM range(4) t(d) CROSS JOIN range({_PARTS} // 4, {_PARTS} // 4 + (7 - {_PARTS} // 4 % 7) % 7) r(o)",
    "ownership_plot_data": f"""WITH s AS (SELECT {_PARTS} // 4 AS shard, {_PARTS} // 4 + (7 - {_PARTS} // 4 % 7) % 7 AS whole), p AS (SELECT pos, shard, whole FROM s CROSS JOIN range(4 * (SELECT whole FROM s)) r(pos))
SELECT 'before' AS phase, pos, CASE WHEN pos % whole < shard THEN pos // whole ELSE -1 END::INT AS owner FROM p UNION ALL SELECT 'after', pos, CASE WHEN pos >= 4 * shard THEN -1 ELSE (pos // 7) % 4 END::INT FROM p""",
    "regather_2d": f"SELECT (d // 2)::INT AS host, d::INT AS device, p_partkey AS col FROM range(4) t(d) CROSS JOIN part WHERE p_partkey * 2 // {_PARTS} = d % 2",
    "topology_mode": """WITH u AS (SELECT count(DISTINCT user_id) AS n, count(DISTINCT user_id % 7) AS m FROM events), most AS (SELECT max(c) AS c FROM (SELECT user_id % 7, count(DISTINCT user_id) AS c FROM events GROUP BY 1))
SELECT 0::INT AS "case", n AS machines, 4::BIGINT AS devices_per_machine, 4::BIGINT AS devices_per_process, 'SPMD' AS mode FROM u UNION ALL SELECT 1, m, c, 1, 'MPMD' FROM u CROSS JOIN most UNION ALL SELECT 2, m, 2 * c, 2, 'INVALID' FROM u CROSS JOIN most UNION ALL SELECT 3, n, 2, 2, 'INVALID' FROM u""",
    "bench_medians": f"SELECT gpu, dtype, ndev, tile, n, median_s, runs FROM ({_MEDIANS}) WHERE tile IS NULL OR tile >= 128",
    "timing_by_tile": f"SELECT gpu, dtype, ndev, coalesce('tile=' || tile, 'untiled') AS line, (row_number() OVER (PARTITION BY gpu, ndev, tile ORDER BY n) - 1)::INT AS place, n, median_s FROM ({_MEDIANS})",
    "timing_by_devices": f"SELECT gpu, dtype, tile, 'ndev=' || ndev AS line, (row_number() OVER (PARTITION BY gpu, ndev, tile ORDER BY n) - 1)::INT AS place, n, median_s FROM ({_MEDIANS})",
    "process_status": "SELECT count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS ok, count(*) FILTER (WHERE event_type = 'error') AS failed, 200 - count(DISTINCT user_id) FILTER (WHERE event_type <> 'view' AND user_id BETWEEN 0 AND 199) AS silent FROM events",
    "solve_complex64": _eliminated(_HERMITIAN_ONE, 64, 65, "SELECT i, 0::BIGINT AS j, round(m[i + 1][65], 3)::DOUBLE + 0.0::DOUBLE AS re, round(m[i + 33][65], 3)::DOUBLE + 0.0::DOUBLE AS im, 0::INT AS status FROM done CROSS JOIN range(32) t(i)"),
    "inverse_f32": f"SELECT i, j, CASE WHEN i = j THEN round(1.0::DOUBLE / (i + 1) * (i + 1), 4) ELSE 0.0::DOUBLE END AS v, 0::INT AS status {_square(_N)}",
    "inverse_complex_residual": f"SELECT i, j, 0.0::DOUBLE AS re, 0.0::DOUBLE AS im {_square(32)}",
    "eigvals_f32": "SELECT s_suppkey AS k, (s_suppkey + 1)::DOUBLE AS lambda, 0::INT AS status FROM supplier",
    "eigen_complex_residual": f"SELECT i, j, 0.0::DOUBLE AS re, 0.0::DOUBLE AS im {_square(32)}",
    "eigvals_shard_scaled": "SELECT s_suppkey AS k, (s_suppkey // 5 + 1)::DOUBLE AS lambda, 0::INT AS status FROM supplier",
    "eigen_not_finite": "SELECT s_suppkey AS k, true AS is_nan, 7::INT AS status FROM supplier",
    "random_definite": "SELECT true AS trace_near_n, true AS symmetric, 0::INT AS status, count(*) AS n FROM nation",
    "rows_round_trip": f"WITH {_TRADE} SELECT i, j, coalesce(v, 0.0::DOUBLE) AS v FROM range((SELECT count(*) FROM nation)) t(i) CROSS JOIN range((SELECT count(*) FROM nation)) l(j) LEFT JOIN trade USING (i, j)",
    "pad_rows": f"WITH {_GRAM} SELECT (i // 16)::INT AS device, i % 16 AS local_off, count(*) AS cells, sum((v <> 0)::BIGINT)::BIGINT AS filled FROM gram GROUP BY ALL UNION ALL SELECT d::INT, o, {DIM}::BIGINT, 0::BIGINT FROM range(4) t(d) CROSS JOIN range(16, 20) l(o)",
    "unpad_rows": f"WITH {_GRAM} SELECT (i // 16)::INT AS device, i % 16 AS local_off, j, round(v, 6) + 0.0 AS v FROM gram",
    "unpad_nothing": f"WITH {_GRAM} SELECT (i // 16)::INT AS device, i % 16 AS local_off, j, round(v, 6) + 0.0 AS v FROM gram",
    "cyclic_verify_changed": "SELECT 2::BIGINT AS mismatches",
    "sql_inverse": f"""SELECT g, i::BIGINT AS i, j::BIGINT AS j, round(CASE WHEN i = 0 AND j = 0 THEN xx WHEN i = 1 AND j = 1 THEN n ELSE -x END / (n * xx - x * x), 6) + 0.0 AS v, 0::INT AS status FROM ({_GROUPS}) CROSS JOIN range(2) r(i) CROSS JOIN range(2) q(j)""",
    "sql_eigvals": "SELECT g, k, round((xx + yy) / 2 + CASE WHEN k = 0 THEN -1 ELSE 1 END * sqrt((xx - yy) * (xx - yy) / 4 + xy * xy), 6) + 0.0 AS lambda, 0::INT AS status FROM (SELECT p_size::BIGINT % 7 AS g, var_pop(p_size::DOUBLE) AS xx, covar_pop(p_size::DOUBLE, p_retailprice / 100) AS xy, var_pop(p_retailprice / 100) AS yy FROM part GROUP BY 1) CROSS JOIN range(2) r(k)",
    "solve_many_by_group": f"SELECT g, i, j, round(v * (j + 1), 6) + 0.0 AS v, status FROM (SELECT g, i::BIGINT AS i, CASE WHEN i = 0 THEN (xx * y - x * xy) / (n * xx - x * x) ELSE (n * xy - x * y) / (n * xx - x * x) END AS v, 0::INT AS status FROM ({_GROUPS}) CROSS JOIN range(2) r(i)) CROSS JOIN range(2) q(j)",
    "solve_group_without_matrix": "SELECT DISTINCT c_nationkey::BIGINT AS g, i::BIGINT AS i, c_nationkey % 2 = 1 AS is_nan, CASE WHEN c_nationkey % 2 = 1 THEN 7 ELSE 0 END::INT AS status FROM customer CROSS JOIN range(2) r(i)",
    # the pivots of an elimination without exchanges
    "solve_failed_minor": _eliminated(
        f"{_GRAM}, aug AS (SELECT i, j, v + CASE WHEN i <> j THEN 0 WHEN i = 37 THEN -1000 ELSE 1 END AS v FROM gram)", DIM, DIM,
        f"SELECT 7::INT AS status, min(k)::BIGINT AS failed_minor, {DIM}::BIGINT AS cells FROM ge WHERE k <= {DIM} AND m[k][k] <= 0"),
    "stream_regression": _eliminated(
        "f AS (SELECT [1.0::DOUBLE, user_id / 100, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END, value] AS f FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 10 DAY), aug AS (SELECT i, j, sum(f[i + 1] * f[j + 1]) AS v FROM f CROSS JOIN range(3) t(i) CROSS JOIN range(4) l(j) GROUP BY ALL)",
        3, 4, "SELECT i, round(m[i + 1][4], 6) + 0.0 AS v, (SELECT count(*) FROM f) AS rows, 0::INT AS status FROM done CROSS JOIN range(3) t(i)"),
    "timing_source": f"SELECT gpu, tile, n, count(*) AS runs, round(sum(value), 4) + 0.0 AS total FROM ({_RUNS}) WHERE ndev = 1 AND tile >= 128 AND n < 192 AND value > 1 GROUP BY 1, 2, 3",
    # up the hierarchy and down again
    "sparse_solve": """WITH o AS (SELECT o_custkey AS p, 2::DOUBLE AS d, o_totalprice / 1000 AS r FROM orders),
c AS (SELECT c_custkey AS k, c_nationkey AS p, 2 + count(o.d) - coalesce(sum(1 / o.d), 0) AS d, coalesce(sum(o.r / o.d), 0) AS r FROM customer LEFT JOIN o ON o.p = c_custkey GROUP BY 1, 2),
n AS (SELECT n_nationkey AS k, n_regionkey AS p, 2 + count(c.d) - coalesce(sum(1 / c.d), 0) AS d, coalesce(sum(c.r / c.d), 0) AS r FROM nation LEFT JOIN c ON c.p = n_nationkey GROUP BY 1, 2),
g AS (SELECT r_regionkey AS k, 1 + count(n.d) - coalesce(sum(1 / n.d), 0) AS d, coalesce(sum(n.r / n.d), 0) AS r FROM region LEFT JOIN n ON n.p = r_regionkey GROUP BY 1),
xg AS (SELECT k, r / d AS x FROM g), xn AS (SELECT n.k, (n.r + xg.x) / n.d AS x FROM n JOIN xg ON xg.k = n.p), xc AS (SELECT c.k, (c.r + xn.x) / c.d AS x FROM c JOIN xn ON xn.k = c.p), xo AS (SELECT (o.r + xc.x) / o.d AS x FROM o JOIN xc ON xc.k = o.p),
x AS (SELECT 0::INT AS kind, x FROM xo UNION ALL SELECT 1, x FROM xc UNION ALL SELECT 2, x FROM xn UNION ALL SELECT 3, x FROM xg)
SELECT kind, 0::INT AS status, count(*) AS n, round(sum(x), 3) + 0.0 AS total, round(sum(x * x), 2) + 0.0 AS squares FROM x GROUP BY 1""",
    "asymmetric_cells": f"""WITH {_TRADE}, ways AS (SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM trade UNION ALL SELECT j, i, v FROM trade) GROUP BY ALL),
changed AS (SELECT i, j, v + CASE WHEN i = 3 AND j = 17 THEN 1 ELSE 0 END AS v FROM ways WHERE NOT (i = 5 AND j = 2))
SELECT least(i, j) AS i, greatest(i, j) AS j FROM changed a FULL JOIN (SELECT j AS i, i AS j, v AS w FROM changed) b USING (i, j) WHERE coalesce(v, 0) <> coalesce(w, 0) GROUP BY 1, 2""",
    "matvec_orders": "SELECT l_orderkey AS i, round(sum(l_quantity * p_retailprice), 4) + 0.0 AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "matmul_sparse": "SELECT a.l_partkey AS i, count(DISTINCT b.l_partkey) AS parts, round(sum(a.l_quantity * b.l_quantity), 4) + 0.0 AS total FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey GROUP BY 1",
    "matmul_tiles": f"""WITH {_PLACES}, dots AS (SELECT a.vec_id AS i, b.vec_id AS j, sum(a.x * b.x) AS v FROM x a JOIN x b ON a.i = b.i GROUP BY ALL)
SELECT i, count(*) AS cells, round(sum(v), 5) + 0.0 AS total, round(sum(v * v), 5) + 0.0 AS squares FROM dots GROUP BY 1""",
    # power iteration, for the smallest value on trace(A) I - A
    "top_eigen_gram": f"""WITH RECURSIVE {_GRAM}, g AS MATERIALIZED (SELECT * FROM gram), m AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM g GROUP BY i)), c AS (SELECT max(s) AS c FROM (SELECT sum(abs(v)) AS s FROM g GROUP BY i)),
shapes AS (SELECT 'largest' AS which, 0::DOUBLE AS c, 1::DOUBLE AS f, m FROM m UNION ALL SELECT 'smallest', c, -1, m FROM m CROSS JOIN c),
p(which, k, x, l) AS (SELECT which, 0, list_transform(range({DIM}), lambda i: 1.0::DOUBLE + (i * 7 % 11) / 10.0::DOUBLE), 0::DOUBLE FROM shapes UNION ALL
  SELECT which, k + 1, list_transform(y, lambda z: z / sqrt(list_dot_product(y, y))), list_dot_product(x, y) / list_dot_product(x, x) FROM (SELECT p.which, k, x, list_transform(range({DIM}), lambda i: c * x[i + 1] + f * list_dot_product(m[i + 1], x)) AS y FROM p JOIN shapes USING (which) WHERE k < 4000))
SELECT which, round(abs(l - c), 4) + 0.0 AS lambda, 0.0::DOUBLE AS residual, 0.0::DOUBLE AS skew, 0::INT AS status FROM p JOIN shapes USING (which) WHERE k = 4000""",
    "top_eigen_copurchase": """WITH RECURSIVE b AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
a AS MATERIALIZED (SELECT x.p AS i, y.p AS j, count(*)::DOUBLE AS v FROM b x JOIN b y ON x.o = y.o GROUP BY 1, 2),
it(k, i, x, l) AS (SELECT 0, i, 1 / sqrt(count(*) OVER ()), 0::DOUBLE FROM (SELECT DISTINCT i FROM a) UNION ALL
  SELECT k + 1, i, y / sqrt(sum(y * y) OVER ()), sqrt(sum(y * y) OVER ()) FROM (SELECT k, a.i, sum(a.v * it.x) AS y FROM it JOIN a ON a.j = it.i WHERE k < 150 GROUP BY k, a.i))
SELECT round(max(l), 4) + 0.0 AS lambda, round(sum(x), 4) + 0.0 AS total, (SELECT count(*) FROM part) AS n, 0::INT AS status FROM it WHERE k = 150""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
