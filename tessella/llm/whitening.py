"""Embedding whitening from an exact scatter matrix: residues over several primes, reduced sums, Chinese remainders.

An entry c counts as the integer x = floor(SCALE * c) + OFFSET. With n vectors and
S their sum, y = n * x - S is an integer vector n times as long as the centred
one, and the scatter of y (sum of y_i * y_j) is n^3 times the covariance. Its
entries outgrow 64 bits, so they are found modulo primes:

* a bound of the entries, from n, S and the least and greatest x, tells how many
  primes are needed;
* each task multiplies its rows' residues by floating-point matrix products that
  are exact (primes below 2^20, at most BLOCK rows a product), once a prime;
* rows of the residue matrices are summed by (prime, row), modulo the prime;
* the Chinese remainder theorem gives the scatter as integers of any size.

Only a matrix of d x d for each prime reaches the driver, whatever n is, where
the double eigenproblem is solved. Order of rows and partitions can't change it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import bound_batches, kept
from tessella.llm.workers import tidy

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
#: Primes lie below this; (2^20 - 1)^2 times BLOCK rows stays below 2^53, where doubles are exact.
PRIME_TOP = 1 << 20
BLOCK = 8192
#: Tasks that sum residue matrices, at most.
REDUCERS = 64


def primes(product: int, top: int = PRIME_TOP) -> list[int]:
    """The greatest primes below `top` whose product exceeds `product`; one at least."""
    found, at = [], top - 1
    while not found or prod(found) <= product:
        while any(at % k == 0 for k in range(2, isqrt(at) + 1)):
            at -= 1
        found.append(at)
        at -= 1
    return found


def residue_scatter(y: np.ndarray, prime: int) -> np.ndarray:
    """The scatter of the integer rows y modulo a prime, by exact floating-point products of at most BLOCK rows."""
    total = np.zeros((y.shape[1], y.shape[1]), np.int64)
    for k in range(0, len(y), BLOCK):
        part = np.remainder(y[k : k + BLOCK], prime).astype(np.float64)
        total = (total + (part.T @ part).astype(np.int64)) % prime
    return total


def remaindered(residues: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The integers nearest zero with these residues, as Python integers: Chinese remainders."""
    whole = prod(moduli)
    total = np.zeros(residues[0].shape, object)
    for r, p in zip(residues, moduli, strict=True):
        rest = whole // p
        total += r.astype(object) * (rest * pow(rest, -1, p))
    total %= whole
    return np.where(total > whole // 2, total - whole, total)


@dataclass
class Whitening:
    """n, S, the longest |n * x - S|, the scatter n^3 * covariance (integers), and the components by falling eigenvalue."""

    n: int
    sums: list[int]
    longest: int
    scatter: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(v) / self.trace if self.trace else 0.0 for v in self.values]

    @property
    def slopes(self) -> np.ndarray:
        """Columns that whiten a centred vector; a component without variance has zeros."""
        least = self.trace * len(self.sums) * np.finfo(float).eps
        scale = np.array([1 / np.sqrt(v) if v > least else 0.0 for v in self.values])
        return self.vectors * scale


def clean(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector array<double>) of the rows whose vector is finite: not null, not empty, no null, NaN or infinity in it.

    Where vectors differ in length, the commonest length counts (of equals the greatest) and others go.
    """
    vector = F.col(vector_col).cast("array<double>")
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    found = rows.select(F.col(id_col).alias("vec_id"), vector.alias("vector")).where((F.size("vector") > 0) & fine)
    lengths = found.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    return found.where(F.size("vector") == (lengths["d"] if lengths else 0))


def _integers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of long x."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).astype(np.int64).reshape(len(column), -1) + OFFSET


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total, low, high = 0, None, None, None
    for batch in batches:
        if batch.num_rows:
            x = _integers(batch.column(0))
            if total is None:
                total, low, high = np.zeros(x.shape[1], object), x[0], x[0]
            low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
            wide = max(int(high.max()), -int(low.min())) * len(x) >= 1 << 62
            n, total = n + len(x), total + (x.astype(object) if wide else x).sum(axis=0).astype(object)
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(total))), pa.array([n] * len(total)), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)), pa.array(low), pa.array(high)],
            ["at", "n", "total", "low", "high"],
        )


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, vector_col: str = "vector") -> Whitening | None:
    """The whitening of clean vectors (array<double> of one length); None if there are none. vectors is read twice."""
    bound_batches(vectors.sparkSession, BLOCK)
    column = vectors.select(F.col(vector_col).alias("vector"))
    # One row a dimension and task; they are summed before they meet.
    parts = column.mapInArrow(tidy(_sums), "at long, n long, total decimal(38,0), low long, high long")
    by_place = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    rows = sorted(by_place.collect())
    if not rows:
        return None
    n, sums = rows[0]["n"], [int(r["total"]) for r in rows]
    longest = max(max(n * r["high"] - s, s - n * r["low"]) for r, s in zip(rows, sums, strict=True))
    moduli = primes(2 * n * longest**2)
    d = len(sums)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((d, d), np.int64) for _ in moduli]
        for batch in batches:
            if batch.num_rows:
                x = _integers(batch.column(0))
                for k, p in enumerate(moduli):
                    # n * x - S without leaving 64 bits: each factor is reduced first.
                    y = (x % p) * (n % p) - np.array([s % p for s in sums])
                    totals[k] = (totals[k] + residue_scatter(y, p)) % p
        yield from _matrix_rows(totals)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            values = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, d)
            for k, at, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), values, strict=True):
                totals[k, at] = (totals[k, at] + row) % moduli[k] if (k, at) in totals else row.copy()
        if totals:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in totals]), pa.array([at for _, at in totals]), pa.array(list(totals.values()), pa.list_(pa.int64()))],
                ["prime", "at", "row"],
            )

    kind = "prime long, at long, row array<long>"
    partial = column.mapInArrow(tidy(scatter), kind)
    reducers = min(REDUCERS, len(moduli) * d)
    found = partial.repartition(reducers, "prime", "at").mapInArrow(tidy(reduce), kind).collect()
    residues = [np.zeros((d, d), np.int64) for _ in moduli]
    for r in found:
        residues[r["prime"]][r["at"]] = r["row"]
    exact = remaindered(residues, moduli)
    cube = n**3
    covariance = np.array([[int(v) / cube for v in row] for row in exact])
    values, columns = np.linalg.eigh(covariance)
    first = np.argsort(values, kind="stable")[::-1][:components]
    return Whitening(n, sums, longest, exact, values[first], columns[:, first], sum(int(exact[k, k]) for k in range(d)) / cube)


def _matrix_rows(totals: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, total in enumerate(totals):
        yield pa.RecordBatch.from_arrays(
            [pa.array([k] * len(total)), pa.array(range(len(total))), pa.array(list(total), pa.list_(pa.int64()))], ["prime", "at", "row"]
        )


def _deviations(y: np.ndarray) -> list[Decimal | None]:
    """Sum of squares of each row of integers, exact; null beyond 38 digits."""
    if len(y) and int(np.abs(y).max()) ** 2 * y.shape[1] >= 1 << 63:
        y = y.astype(object)
    return [Decimal(v) if v < 10**38 else None for v in map(int, (y * y).sum(axis=1))]


def whitened(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation decimal(38,0), whitened array<double>), a row for each row of vectors (vec_id, vector)."""
    bound_batches(vectors.sparkSession, BLOCK)
    n, slopes = model.n, model.slopes
    # Python integers where 64 bits could overflow.
    kind_of = np.int64 if model.longest + max(map(abs, model.sums)) < 1 << 62 else object
    sums = np.array(model.sums, kind_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = n * _integers(batch.column(1)).astype(kind_of) - sums
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(_deviations(y), pa.decimal128(38, 0)), pa.array(list((y / n).astype(float) @ slopes), pa.list_(pa.float64()))],
                    ["vec_id", "deviation", "whitened"],
                )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "vector").mapInArrow(tidy(run), f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def _covariance_error(table: DataFrame, real: list[bool]) -> float:
    """The largest absolute entry of the whitened columns' covariance minus the identity, over components that have variance."""
    at = [k for k, there in enumerate(real) if there]
    value = [F.col("whitened")[k] for k in range(len(real))]
    entries: list[Column] = [
        F.abs(F.covar_pop(value[i], value[j]) - (1.0 if i == j else 0.0)) for p, i in enumerate(at) for j in at[p:]
    ]
    if not entries:
        return 0.0
    return float(max(table.agg(*entries).first()))


def whitening(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each clean row and component.

    Rows whose vector is null or empty, or holds null or non-finite entries, are
    dropped (see clean). components go from 1, by falling eigenvalue, up to the
    dimension; one without variance has whitened 0. deviation is null beyond 64
    bits. identity_error is measured on the whitened rows. Null and repeated ids
    are rows of their own; no clean rows give none.
    """
    vectors = clean(rows, id_col, vector_col)
    model = fit_whitening(vectors, components)
    kind = rows.schema[id_col].dataType.simpleString()
    if model is None:
        schema = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], schema)
    table = kept(whitened(vectors, model), "whitened")
    error = _covariance_error(table, [bool(s.any()) for s in model.slopes.T])
    return (
        table.select("vec_id", F.expr("try_cast(deviation AS long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
        .select(
            F.col("vec_id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
            F.element_at(F.array(*map(F.lit, model.explained)), F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
        )
    )
