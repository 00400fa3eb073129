"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Vectors are made whole numbers, so the scatter matrix is summed exactly. Its characteristic polynomial is
found modulo primes, one Spark row a prime, and put together by Chinese remainders; its largest
roots are isolated exactly, and each component comes from inverse iteration in fixed point at its root, one
Spark row a root. Only numbers of the dimensions reach the driver, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import charpoly

COMPONENTS = 32
# Whole numbers of entries: floor(64 c). The offset of contracts (1,000,000) changes no deviation, so it is left out.
SCALE = 64
# Whole numbers from here on would not fit a long with a contract's offset; such entries count as infinite.
LARGEST = float((1 << 63) - (1 << 21))
# Sums travel in pieces of 30 bits, so that adding them over any number of tasks stays inside a long.
_PIECE = 30
# Rows multiplied at once, and the size up to which products of rows are exact as doubles.
_ROWS = 8_192
_EXACT = 1 << 20


def whole(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors count, and theirs as whole numbers; shorter ones end in zeros.

    Null vectors, and those with a null, non-finite or over-large entry, do not count.
    """
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), -1), dtype=np.int64)
    values = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(values * SCALE)
        bad = ~(np.abs(scaled) < LARGEST)
    counts = sizes >= 0
    counts[owner[bad]] = False
    # ``counts`` says which rows are kept, ``place`` where a kept row stands among them.
    place = np.cumsum(counts) - 1
    first = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    kept = counts[owner]
    out = np.zeros((int(counts.sum()), int(sizes.max(initial=0))), dtype=np.int64)
    out[place[owner[kept]], (np.arange(len(values)) - first[owner])[kept]] = scaled[kept].astype(np.int64)
    return counts, out


def products(y: np.ndarray) -> np.ndarray:
    """The exact sum of outer products of the rows, as Python numbers."""
    d = y.shape[1]
    total = np.zeros((d, d), dtype=object)
    for start in range(0, len(y), _ROWS):
        rows = y[start : start + _ROWS]
        # Digits to base 2**20, the last one signed; a sum of 8,192 products of two is below 2**53.
        digits = []
        while not digits or (rows.size and np.abs(rows).max() > 0):
            low = rows if rows.size == 0 or np.abs(rows).max() < _EXACT else rows & (_EXACT - 1)
            digits.append(low.astype(np.float64))
            rows = (rows - low) >> 20
        for i, a in enumerate(digits):
            for j, b in enumerate(digits):
                total += (a.T @ b).astype(np.int64).astype(object) * (1 << (20 * (i + j)))
    return total


def _pieces(value: int) -> list[tuple[int, int]]:
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append((len(out), sign * (value & ((1 << _PIECE) - 1))))
        value >>= _PIECE
    return out


def _arrays(df: DataFrame, vector_col: str) -> DataFrame:
    return df.select(F.col(vector_col).cast("array<double>").alias("v"))


def scatter(df: DataFrame, vector_col: str) -> tuple[int, list[int], list[list[int]]]:
    """Rows that count, the sum of each dimension and the sums of products, exact."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, total = 0, np.zeros(0, dtype=object), np.zeros((0, 0), dtype=object)
        for batch in batches:
            _, y = whole(batch.column(0))
            d = max(y.shape[1], len(sums))
            if d > len(sums):
                wider, sums = sums, np.zeros(d, dtype=object)
                sums[: len(wider)] = wider
                wider, total = total, np.zeros((d, d), dtype=object)
                total[: len(wider), : len(wider)] = wider
            own = y.shape[1]
            n += len(y)
            sums[:own] += y.astype(object).sum(0)
            total[:own, :own] += products(y)
        rows = [(-1, -1, *piece) for piece in _pieces(n)]
        for i in range(len(sums)):
            # A dimension is told even if all its sums are 0.
            rows += [(-1, i, *piece) for piece in _pieces(int(sums[i])) or [(0, 0)]]
            rows += [(i, j, *piece) for j in range(i, len(sums)) for piece in _pieces(int(total[i, j]))]
        names = ["i", "j", "place", "part"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("place", pa.int32()), ("part", pa.int64())])
    sums = (
        _arrays(df, vector_col)
        .mapInArrow(summed, "i int, j int, place int, part long")
        .groupBy("i", "j", "place")
        .agg(F.sum("part").alias("part"))
        .collect()
    )
    found: dict[tuple[int, int], int] = {}
    for i, j, place, part in sums:
        found[i, j] = found.get((i, j), 0) + (part << (_PIECE * place))
    d = max((j for _, j in found), default=-1) + 1
    pairs = [[found.get((min(i, j), max(i, j)), 0) for j in range(d)] for i in range(d)]
    return found.get((-1, -1), 0), [found.get((-1, j), 0) for j in range(d)], pairs


def polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Characteristic polynomial, from the highest power down, of a matrix without negative eigenvalues."""
    if not matrix:
        return [1]
    primes = charpoly.primes_over(charpoly.coefficient_bound(matrix))
    shared = spark.sparkContext.broadcast(matrix)

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["prime"].tolist()
            yield pd.DataFrame({"prime": own, "rests": list(charpoly.residues(shared.value, own))})

    parts = _spread(spark, [(p,) for p in primes], "prime long").mapInPandas(reduced, "prime long, rests array<long>")
    return charpoly.combined([(r["prime"], r["rests"]) for r in parts.collect()])


def _spread(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """The rows over the tasks of the session."""
    tasks = min(len(rows), spark.sparkContext.defaultParallelism)
    return spark.createDataFrame(rows, schema).repartition(max(1, tasks))


@dataclass(frozen=True)
class Whitening:
    """Components by falling eigenvalue; where ``variances`` is 0, a component is null and whitens nothing.

    ``sums`` are of floor(64 c) over the ``n`` vectors fitted, ``variances`` the eigenvalues of their
    covariance, ``explained`` the shares of its trace (null if that is 0).
    """

    n: int
    sums: tuple[int, ...]
    variances: tuple[float, ...]
    explained: tuple[float | None, ...]
    components: tuple[tuple[float, ...] | None, ...]

    def weights(self) -> np.ndarray:
        """Rows that a deviation is multiplied by; NaN where there is no variance."""
        out = np.full((len(self.components), len(self.sums)), np.nan)
        for k, (vector, variance) in enumerate(zip(self.components, self.variances)):
            if vector is not None:
                out[k] = np.array(vector) / np.sqrt(variance)
        return out

    def deviations(self, y: np.ndarray) -> np.ndarray:
        """n times each row, less the sums; exact."""
        d = len(self.sums)
        y = np.pad(y, ((0, 0), (0, max(0, d - y.shape[1]))))[:, :d]
        largest = int(np.abs(y).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        kind = np.int64 if largest < 1 << 62 else object
        return y.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def applied(self, vector: Column) -> Column:
        """``struct<deviation, whitened>`` of a vector, null for one that does not count.

        ``deviation`` (decimal, null from 2**125 on) is the squared length of n times the whole
        numbers less their sums; ``whitened`` has one number a component, null without variance.
        Entries beyond the fitted dimensions are left out, missing ones are 0.
        """
        model, mask, top = self, (1 << 62) - 1, (1 << 63) - 1

        def work(vectors: pa.Array) -> pa.Array:
            counts, y = whole(vectors)
            wide = model.deviations(y)
            most = int(np.abs(wide).max(initial=0))
            if most * most * max(1, wide.shape[1]) > top:
                wide = wide.astype(object)
            squares = (wide * wide).sum(1)
            # Where all weights are NaN so is the product; other NaN cannot arise, since entries are finite.
            white = (wide.astype(np.float64) / max(1, model.n)) @ model.weights().T
            place = np.where(counts, np.cumsum(counts) - 1, 0)
            deviations = [int(x) for x in squares]
            high = [deviations[p] >> 62 if ok and deviations[p] >> 125 == 0 else None for ok, p in zip(counts, place)]
            low = [deviations[p] & mask if ok else None for ok, p in zip(counts, place)]
            k = white.shape[1]
            flat = white[place[counts]].ravel()
            inner = pa.array(flat, pa.float64(), mask=np.isnan(flat))
            offsets = np.concatenate([[0], np.cumsum(np.where(counts, k, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), inner)
            return pa.StructArray.from_arrays(
                [pa.array(high, pa.int64()), pa.array(low, pa.int64()), lists],
                ["high", "low", "whitened"],
                mask=pa.array(~counts),
            )

        raw = F.arrow_udf(work, "high long, low long, whitened array<double>")(vector.cast("array<double>"))
        base = F.lit(1 << 62).cast("decimal(19,0)")
        deviation = raw["high"].cast("decimal(19,0)") * base + raw["low"].cast("decimal(19,0)")
        return F.when(
            raw["whitened"].isNotNull(),
            F.struct(deviation.cast("decimal(38,0)").alias("deviation"), raw["whitened"].alias("whitened")),
        )


def fit(df: DataFrame, vector_col: str, components: int = COMPONENTS) -> Whitening:
    """The whitening of all vectors of ``df`` that count.

    Rows whose vector is null, or holds a null, non-finite or over-large entry (``LARGEST``), do not count;
    vectors of several lengths are compared as if the shorter ones ended in zeros. Repeated rows count each time.
    A table without such rows gives a whitening without components. Other columns are not read.
    Memory and driver work depend on the dimensions alone: their square in whole numbers.
    """
    spark = df.sparkSession
    n, sums, pairs = scatter(df, vector_col)
    d = len(sums)
    # n squared times the covariance, in whole numbers.
    matrix = [[n * pairs[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    trace = sum(matrix[i][i] for i in range(d))
    roots = charpoly.largest_roots(polynomial(spark, matrix), components) if trace else []
    vectors = _null_vectors(spark, matrix, roots)
    found = []
    for k, root in enumerate(roots):
        # Quotients of whole numbers are right to the last place of a double.
        value = root.low / (n * n << root.k)
        share = root.low / (trace << root.k)
        found += [(value, share, tuple(v)) for v in vectors[k]]
    found = found[:components]
    empty = min(components, d) - len(found)
    found += [(0.0, 0.0 if trace else None, None)] * empty
    return Whitening(
        n, tuple(sums), tuple(f[0] for f in found), tuple(f[1] for f in found), tuple(f[2] for f in found)
    )


def _null_vectors(spark: SparkSession, matrix: list[list[int]], roots: list[charpoly.Root]) -> list[list[list[float]]]:
    """For each root its unit vectors; one Spark row a root."""
    if not roots:
        return []
    shared = spark.sparkContext.broadcast(matrix)

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for root, low, k, count in batch.itertuples(index=False, name=None):
                found = charpoly.null_vectors(shared.value, int(low), int(k), int(count))
                yield pd.DataFrame({"root": root, "at": range(len(found)), "vector": found})

    rows = [(at, str(r.low), r.k, r.multiplicity) for at, r in enumerate(roots)]
    spread = _spread(spark, rows, "root int, low string, k int, count int")
    out: list[list] = [[None] * r.multiplicity for r in roots]
    for row in spread.mapInPandas(solved, "root int, at int, vector array<double>").collect():
        out[row["root"]][row["at"]] = row["vector"]
    return out


def identity_error(df: DataFrame, vector_col: str, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors less the identity.

    Measured on the rows themselves, in one more pass; 0 if no component has variance.
    """
    weights = model.weights()
    weights = weights[~np.isnan(weights).any(axis=1)]
    c = len(weights)
    if not c:
        return 0.0

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total = np.zeros(c), np.zeros((c, c))
        for batch in batches:
            _, y = whole(batch.column(0))
            white = (model.deviations(y).astype(np.float64) / model.n) @ weights.T
            sums += white.sum(0)
            total += white.T @ white
        i, j = np.triu_indices(c)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.full(c, -1), i]).astype(np.int32)),
                pa.array(np.concatenate([np.arange(c), j]).astype(np.int32)),
                pa.array(np.concatenate([sums, total[i, j]])),
            ],
            names=["i", "j", "part"],
        )

    found = _arrays(df, vector_col).mapInArrow(summed, "i int, j int, part double")
    sums = {(r[0], r[1]): r[2] / model.n for r in found.groupBy("i", "j").agg(F.sum("part")).collect()}
    # Rows are centred before they are multiplied; what is left of their mean is taken off here.
    return max(
        abs(x - sums[-1, i] * sums[-1, j] - (i == j)) for (i, j), x in sums.items() if i >= 0
    )


def whitened(
    df: DataFrame, id_col: str, vector_col: str, components: int = COMPONENTS
) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component.

    Vectors that do not count (see ``fit``) have no rows; null ids and repeated rows are kept. A component without
    variance has a null ``whitened``. Other columns are not read, and an empty table gives no rows.
    """
    model = fit(df, vector_col, components)
    error = identity_error(df, vector_col, model)
    shares = F.array(*[F.lit(x).cast("double") for x in model.explained]).cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), model.applied(F.col(vector_col)).alias("w")).select(
        "id", F.col("w.deviation").alias("deviation"), F.posexplode("w.whitened").alias("at", "whitened")
    )
    return rows.select(
        F.col("id").alias(id_col),
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
