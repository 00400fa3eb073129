"""Exact nearest neighbours with blocks skipped by the triangle inequality, and a graph layout.

References are dealt to the nearest of some centres, which are references themselves. A block is all of a centre's;
no member is farther from it than the block's radius. A query meets its own block first; the distances found there
rule out every block that its centre and radius put farther away. So on clustered vectors most blocks are never met,
and the answers are those of a full comparison.

Blocks of near centres stand together, and so do their queries. Rows travel as packs, once for each pair of a slice of
queries and a part of the references that any of its queries has to meet, never once for each query and block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.operators.blocks import CELLS_AT_ONCE, ROWS_PER_BLOCK, stack
from tidewatch.session import written

# Centres are sent to all tasks, so there are at most so many, and no more than numbers fit 64 MB.
MOST_CENTRES = 1_024
_CENTRE_NUMBERS = 8_000_000
# Distances are rounded; a block is skipped only if it is farther by more than this share.
_SLACK = 1e-6
# A task holds up to so many blocks' rows of each side, and so many numbers (32 MB); fewer while that leaves so few sides.
_BLOCKS_A_TILE = 16
_TILE_NUMBERS = 4_000_000
_SIDES = 6
# Tasks for each pair of a slice and a part, so that few tasks get two.
_TASKS_A_TILE = 3
# Numbers of a pack: larger ones are hard on the JVM, which moves them as one object.
_PACK_NUMBERS = 16_384
# Packs of a file: a task sends each pack of its files to many pairs, so it should read few.
_PACKS_A_FILE = 32
# Largest product of a tile that is held at once, and pairs whose distance is taken directly at once.
_CELLS_OF_TILE = 1_000_000
_MEMBERS_AT_ONCE = 1_024
_PAIRS_AT_ONCE = 16_384


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to all rows of ``b``."""
    sums = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :]
    square = np.maximum(sums - 2 * a @ b.T, 0)
    # Rounding swamps the small difference of near copies, so that is taken directly.
    near = np.nonzero(square <= 1e-6 * sums)
    for start in range(0, len(near[0]), 100_000):
        i, j = (n[start : start + 100_000] for n in near)
        square[i, j] = ((a[i] - b[j]) ** 2).sum(1)
    return np.sqrt(square)


def chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of directions: 0 for equal ones, the square root of 2 for a zero vector and any other."""
    a, b = _directions(a, 0), _directions(b, 1)
    to = euclidean(a, b)
    to[a[:, -2] > 0] = sqrt(2)
    to[:, b[:, -1] > 0] = sqrt(2)
    return to


def _directions(rows: np.ndarray, side: int) -> np.ndarray:
    """Unit rows; a zero row is of a direction that no row of the other side has."""
    norms = np.linalg.norm(rows, axis=1)
    out = np.zeros((len(rows), rows.shape[1] + 2))
    out[:, :-2] = rows / np.where(norms == 0, 1, norms)[:, None]
    out[~out.any(1), side - 2] = 1
    return out


def _euclidean_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(1))


def _chord_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    zero = a[:, -2:].any(1) | b[:, -2:].any(1)
    return np.where(zero, sqrt(2), _euclidean_pairs(a, b))


# Where the rows of each side (0: queries, 1: references) stand so that straight lines are the distance, and that of pairs.
_SPACES = {euclidean: (lambda rows, side: rows, _euclidean_pairs), chord: (_directions, _chord_pairs)}


@dataclass(frozen=True)
class Found:
    """``nearest`` (id, neighbour, rank, distance); ``met`` (id, block): what was compared, of ``blocks`` blocks."""

    nearest: DataFrame
    met: DataFrame
    blocks: int


def search(
    queries: DataFrame,
    references: DataFrame,
    k: int,
    distance=euclidean,
    exclude_same: bool = False,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> Found:
    """The ``k`` nearest references of each query; of equal distances the least key comes first.

    Both have ``id, vector``, ids unique; rows without either, or with a number that is none, are left out. ``distance``
    must keep the triangle inequality. With ``exclude_same`` a reference with the query's own id does not count. Blocks
    of many rows are cut into parts and their queries into slices, small ones share one, so no task holds more than
    16 times ``rows_per_block`` rows of each, or 32 MB.
    """
    spark = queries.sparkSession
    kind, asking = dict(references.dtypes)["id"], dict(queries.dtypes)["id"]
    types = [to_arrow_type(t.schema["id"].dataType) for t in (queries, references)]
    usable = "id IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> abs(x) < double('infinity'))"
    queries = queries.select("id", "vector").where(usable)
    rows = references.select("id", "vector").where(usable)
    total, dims = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    dims = dims or 0
    most = min(MOST_CENTRES, max(1, _CENTRE_NUMBERS // max(1, dims)))
    wanted = min(most, max(1, ceil(sqrt(total))))
    # By hash, so that centres do not depend on how rows are dealt.
    heads = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).toPandas()
    centres = np.unique(stack(heads["vector"]), axis=0) if len(heads) else np.zeros((0, max(1, dims)))
    centres = centres[_in_line(centres, distance)]
    shared = spark.sparkContext.broadcast(centres)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, len(shared.value)):
                vectors = _rows(piece.column("vector"))
                to = distance(vectors, shared.value)
                home = to.argmin(1).astype(np.int32)
                away = to[np.arange(len(home)), home]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), _packed(vectors), pa.array(home), pa.array(away)], ["id", "vector", "block", "away"]
                )

    placed = written(rows.mapInArrow(dealt, f"id {kind}, vector binary, block int, away double"))
    home = written(queries.mapInArrow(dealt, f"id {asking}, vector binary, block int, away double"))
    sizes, radii = _of_blocks(placed, len(centres))
    asked, _ = _of_blocks(home, len(centres))
    parts, slices = (_Shares.of(n, rows_per_block, dims) for n in (sizes, asked))
    pack = min(rows_per_block, max(1, _PACK_NUMBERS // max(1, dims)))
    held = written(_packs(placed, parts, pack, dims, kind, k), _PACKS_A_FILE)
    asks = written(_packs(home, slices, pack, dims, asking))
    tile = _Tile(k, dims, pack, distance, *_SPACES.get(distance, (None, None)), exclude_same, rows_per_block, *types)

    # Each query meets the first part of its own block; one whose block has no member meets part -1, which is empty.
    own = np.where(sizes > 0, parts.first, -1)
    pairs = {(int(s), int(own[b])) for b in np.flatnonzero(asked) for s in slices.range_of(b)}
    lots = spark.sparkContext.broadcast((centres, radii, own, parts))

    def bounded(left: pa.Table, right: pa.Table) -> pa.Table:
        centres, radii, own, _ = lots.value
        part = (left if left.num_rows else right).column("part")[0].as_py()
        return tile.bounds(left, right, centres, radii, own == part)

    bounds = written(
        _met(asks, held, written(spark.createDataFrame(sorted(pairs), "slice int, part int")), len(pairs)).applyInArrow(
            bounded, f"slice int, ids array<{asking}>, vectors binary, bounds array<double>"
        ),
        _PACKS_A_FILE,
    )

    def near(batch: pa.RecordBatch) -> Iterator[tuple[pa.Scalar, pa.Array, np.ndarray]]:
        """The slice and ids of some queries, and which of them have to meet which blocks."""
        centres, radii, _, _ = lots.value
        for row in range(batch.num_rows):
            ids = batch.column("ids")[row].values
            vectors = _unpacked(batch.column("vectors")[row : row + 1], [len(ids)], dims)
            bound = batch.column("bounds")[row].values.to_numpy()
            step = max(1, CELLS_AT_ONCE // max(1, len(centres)))
            for start in range(0, len(ids), step):
                some = slice(start, start + step)
                yield batch.column("slice")[row], ids[some], _may(distance(vectors[some], centres), radii[None, :], bound[some, None])

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = lots.value[-1]
        for batch in batches:
            for number, _, blocks in near(batch):
                found = sorted({p for b in np.flatnonzero(blocks.any(0)) for p in parts.range_of(b)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number.as_py()] * len(found), pa.int32()), pa.array(found, pa.int32())], ["slice", "part"]
                )

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, blocks in near(batch):
                at, block = np.nonzero(blocks)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(block.astype(np.int32))], ["id", "block"])

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        return tile.nearest(left, right, *lots.value[:2])

    tiles = written(bounds.mapInArrow(needed, "slice int, part int").distinct())
    found = _met(bounds, held, tiles, tiles.count()).applyInArrow(nearest, f"id {asking}, neighbour {kind}, distance double")
    return Found(_first(found, k), bounds.mapInArrow(listed, f"id {asking}, block int"), len(centres))


def _in_line(points: np.ndarray, distance) -> np.ndarray:
    """An order in which near points stand together: halved again and again, by which of two far ones is nearer."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        some = todo.pop()
        if len(some) < 3:
            done.append(some)
            continue
        one = distance(points[some[:1]], points[some])[0].argmax()
        to_one = distance(points[some[one : one + 1]], points[some])[0]
        other = to_one.argmax()
        to_other = distance(points[some[other : other + 1]], points[some])[0]
        some = some[np.argsort(to_one - to_other, kind="stable")]
        todo += [some[len(some) // 2 :], some[: len(some) // 2]]
    return np.concatenate(done) if done else np.arange(0)


def _may(to: np.ndarray, radius: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Whether a block can hold a row within the bound, from the distance to its centre."""
    return np.isfinite(radius) & (to - radius <= bound + _SLACK * (1 + bound + to))


def _of_blocks(rows: DataFrame, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    sizes, radii = np.zeros(blocks, dtype=np.int64), np.full(blocks, -np.inf)
    for block, n, away in rows.groupBy("block").agg(F.count("*"), F.max("away")).collect():
        sizes[block], radii[block] = n, away
    return sizes, radii


@dataclass(frozen=True)
class _Shares:
    """The parts or slices that blocks are cut into, or share: of each block the first one's number, and how many it has."""

    first: np.ndarray
    number: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, rows_per_block: int, dims: int) -> _Shares:
        most = min(_BLOCKS_A_TILE * rows_per_block, max(1, _TILE_NUMBERS // max(1, dims)))
        most = min(most, max(rows_per_block, ceil(int(counts.sum()) / _SIDES)))
        first, number = np.zeros(len(counts), dtype=np.int32), np.ones(len(counts), dtype=np.int32)
        last, room = -1, -1
        for block, n in enumerate(counts.tolist()):
            if n > room:
                first[block], number[block] = last + 1, max(1, ceil(n / most))
                last, room = last + int(number[block]), most if number[block] == 1 else 0
            first[block] = first[block] if number[block] > 1 else last
            room -= n
        return cls(first, number)

    def range_of(self, block: int) -> range:
        return range(int(self.first[block]), int(self.first[block] + self.number[block]))

    def of_row(self, seed: int) -> Column:
        def listed(of: np.ndarray) -> Column:
            # At least one, as an array of at most 1,024 numbers.
            return F.get(F.array(*[F.lit(int(n)) for n in of] or [F.lit(1)]), F.col("block"))

        return (listed(self.first) + F.pmod(F.xxhash64("id", F.lit(seed)), listed(self.number))).cast("int")


def _packs(rows: DataFrame, shares: _Shares, most: int, dims: int, kind: str, k: int | None = None) -> DataFrame:
    """``ids, blocks, vectors`` of up to ``most`` rows of a part (with ``k``) or a slice, in order of their blocks."""
    name = "slice" if k is None else "part"

    def packed(table: pa.Table) -> pa.Table:
        ids, blocks = table.column("id").combine_chunks(), table.column("block").to_numpy()
        vectors = _unpacked(table.column("vector"), [1] * len(ids), dims)
        order = np.argsort(blocks, kind="stable") if k is None else _spared(ids, vectors, blocks, k)
        cuts = [order[start : start + most] for start in range(0, len(order), most)]
        return pa.table(
            {
                name: pa.array([table.column(name)[0].as_py() for _ in cuts], pa.int32()),
                "ids": _lists(ids.take(pa.array(order)), most),
                "blocks": _lists(pa.array(blocks[order], pa.int32()), most),
                "vectors": pa.array([_smallest(vectors[c]).tobytes() for c in cuts], pa.binary()),
            }
        )

    dealt = rows.select("id", "vector", "block", shares.of_row(1 if k is None else 2).alias(name))
    return dealt.groupBy(name).applyInArrow(packed, f"{name} int, ids array<{kind}>, blocks array<int>, vectors binary")


def _spared(ids: pa.Array, vectors: np.ndarray, blocks: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows, by block, that can be among the ``k`` nearest of any query.

    Of equal vectors these are the ``k`` + 1 least ids, one of which may be the query's own, and each up to ``k`` times.
    """
    order = pc.sort_indices(ids).to_numpy()
    named = ids.take(pa.array(order)).dictionary_encode().indices.to_numpy()
    plain = np.ascontiguousarray(vectors[order] + 0.0)
    if plain.shape[1]:
        _, same = np.unique(plain.view(np.dtype((np.void, plain.shape[1] * 8))).ravel(), return_inverse=True)
    else:
        same = np.zeros(len(order), dtype=np.int64)
    again = pd.DataFrame({"same": same, "named": named}).groupby(["same", "named"], sort=False).cumcount().to_numpy()
    others = pd.Series(again == 0).astype("int64").groupby(same, sort=False).cumsum().to_numpy()
    order = order[(again < k) & (others <= k + 1)]
    return order[np.argsort(blocks[order], kind="stable")]


def _met(asks: DataFrame, held: DataFrame, pairs: DataFrame, number: int):
    """The packs of each pair of a slice and a part, in one group."""
    keys, tasks = ["slice", "part"], min(4_096, max(1, _TASKS_A_TILE * number))
    left, right = (rows.join(pairs, key).repartition(tasks, *keys) for rows, key in ((asks, "slice"), (held, "part")))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys))


@dataclass(frozen=True)
class _Tile:
    """What a task does with a slice of queries and a part of the references."""

    k: int
    dims: int
    pack: int
    distance: Callable[[np.ndarray, np.ndarray], np.ndarray]
    space: Callable[[np.ndarray, int], np.ndarray] | None
    of_pairs: Callable[[np.ndarray, np.ndarray], np.ndarray] | None
    exclude_same: bool
    rows_per_block: int
    asking: pa.DataType
    kind: pa.DataType

    def bounds(self, left: pa.Table, right: pa.Table, centres: np.ndarray, radii: np.ndarray, here: np.ndarray) -> pa.Table:
        """The queries whose own block is ``here``, with the distance of the last of ``k`` neighbours in it, or infinity."""
        out = [pa.table({"slice": [], "ids": [], "vectors": [], "bounds": []}, self._schema())]
        for ids, vectors, best, _ in self._searched(left, right, centres, radii, here):
            cuts = [slice(start, start + self.pack) for start in range(0, len(ids), self.pack)]
            columns = {
                "slice": pa.array([left.column("slice")[0].as_py()] * len(cuts), pa.int32()),
                "ids": _lists(ids, self.pack),
                "vectors": pa.array([_smallest(vectors[c]).tobytes() for c in cuts], pa.binary()),
                "bounds": _lists(pa.array(best.far[:, -1]), self.pack),
            }
            out.append(pa.table(columns, self._schema()))
        return pa.concat_tables(out)

    def _schema(self) -> pa.Schema:
        kinds = {"slice": pa.int32(), "ids": pa.list_(self.asking), "vectors": pa.binary(), "bounds": pa.list_(pa.float64())}
        return pa.schema([*kinds.items()])

    def nearest(self, left: pa.Table, right: pa.Table, centres: np.ndarray, radii: np.ndarray) -> pa.Table:
        out = []
        for ids, _, best, names in self._searched(left, right, centres, radii):
            row, rank = np.nonzero(np.isfinite(best.far))
            out.append((ids.take(pa.array(row)), names.take(pa.array(best.at[row, rank])), pa.array(best.far[row, rank])))
        kinds = {"id": self.asking, "neighbour": self.kind, "distance": pa.float64()}
        return pa.table({n: pa.chunked_array([x[i] for x in out], kind) for i, (n, kind) in enumerate(kinds.items())})

    def _rows(self, table: pa.Table, kind: pa.DataType, other: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Ids, vectors, and the blocks or bounds."""
        lists = table.column("ids").combine_chunks()
        vectors = _unpacked(table.column("vectors"), pc.list_value_length(lists).to_pylist(), self.dims)
        others = table.column(other).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return lists.flatten().cast(kind), vectors, others

    def _searched(
        self, left: pa.Table, right: pa.Table, centres: np.ndarray, radii: np.ndarray, here: np.ndarray | None = None
    ) -> Iterator[tuple[pa.Array, np.ndarray, _Best, pa.Array]]:
        """Some queries at a time: ids, vectors, and the best as places in the sorted ids of references, which are given too.

        With ``here`` only the queries of these blocks, each in its own block.
        """
        names, members, blocks = self._rows(right, self.kind, "blocks")
        order = pc.sort_indices(names).to_numpy()
        names, blocks = names.take(pa.array(order)), blocks[order]
        codes = _Codes(names if self.exclude_same else None)
        # By block, in a block by id.
        place = np.argsort(blocks, kind="stable")
        present, starts = np.unique(blocks[place], return_index=True)
        ends = np.append(starts[1:], len(place))
        there = _There(members, order[place], codes.of_names[place] if self.exclude_same else np.ones(len(place)), self)
        del members
        most = min(self.rows_per_block, _MEMBERS_AT_ONCE)
        step = max(1, _CELLS_OF_TILE // min(most, max(len(names), 1)) // self.pack)
        for start in range(0, left.num_rows, step):
            ids, vectors, known = self._rows(left.slice(start, step), self.asking, "bounds" if here is None else "blocks")
            if here is not None:
                rows = np.flatnonzero(here[known])
                ids, vectors, known = ids.take(pa.array(rows)), vectors[rows], known[rows]
            if not len(ids):
                continue
            best = _Best(known if here is None else np.full(len(ids), np.inf), self.k, len(names))
            asking = _Here(vectors, codes.of(ids), self.space)
            to = self.distance(vectors, centres[present]) if len(present) else np.zeros((len(ids), 0))
            for at in np.argsort(to.mean(0), kind="stable"):
                for first in range(starts[at], ends[at], most):
                    asked = known == present[at] if here is not None else _may(to[:, at], radii[present[at]], best.bound)
                    some = slice(first, min(first + most, ends[at]))
                    row, member, far = there.within(asking, np.flatnonzero(asked), best.bound, some)
                    best.add(row, far, place[member])
            best.settle()
            yield ids, vectors, best, names


class _Codes:
    """Numbers that are equal where ids are; -1 and 1 without ids."""

    def __init__(self, names: pa.Array | None):
        self.known: dict = {}
        found = [] if names is None else names.to_pylist()
        self.of_names = np.array([self.known.setdefault(v, len(self.known)) for v in found], dtype=np.int64)

    def of(self, ids: pa.Array) -> np.ndarray:
        found = ids.to_pylist() if self.known else [None] * len(ids)
        return np.array([self.known.get(v, -1) for v in found], dtype=np.int64)


class _Here:
    """Some queries, as they stand for a product with the references, and the codes of references that do not count."""

    def __init__(self, vectors: np.ndarray, same: np.ndarray, space):
        self.given, self.same = vectors, same
        self.rows = space(vectors, 0) if space else vectors
        self.squares = (self.rows**2).sum(1)
        self.wide = np.hstack([self.rows, np.ones((len(vectors), 1)), np.zeros((len(vectors), 1))])


class _There:
    """The references of a part, and which of them lie within the bounds of some queries."""

    def __init__(self, members: np.ndarray, order: np.ndarray, codes: np.ndarray, tile: _Tile):
        self.codes, self.tile = codes, tile
        stand = tile.space or (lambda rows, side: rows)
        self.wide = np.ones((len(members), stand(members[:0], 1).shape[1] + 2))
        self.rows = self.wide[:, :-2]
        for start in range(0, len(members), ROWS_PER_BLOCK):
            some = slice(start, start + ROWS_PER_BLOCK)
            self.rows[some] = stand(members[order[some]], 1)
            self.wide[some, -2] = -(self.rows[some] ** 2).sum(1) / 2
        self.most = -2 * self.wide[:, -2].min(initial=0)

    def within(self, here: _Here, asked: np.ndarray, bound: np.ndarray, some: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, member and distance of each pair that is not farther apart than the row's bound.

        Of a row without a bound the ``k`` nearest members, at least.
        """
        if not len(asked):
            return asked, asked, np.zeros(0)
        if self.tile.of_pairs:
            bound = self._bounded(here, asked, bound, some)
            hits = np.flatnonzero(self._left_over(here, asked, bound**2, some) >= 0)
            row, member = asked[hits // (some.stop - some.start)], some.start + hits % (some.stop - some.start)
            far = np.empty(len(row))
            for start in range(0, len(row), _PAIRS_AT_ONCE):
                few = slice(start, start + _PAIRS_AT_ONCE)
                far[few] = self.tile.of_pairs(here.rows[row[few]], self.rows[member[few]])
        else:
            to = self.tile.distance(here.given[asked], self.rows[some])
            at, member = np.nonzero(to <= (bound[asked] * (1 + _SLACK) + _SLACK)[:, None])
            row, member, far = asked[at], some.start + member, to[at, member]
        kept = np.isfinite(far) & (far <= bound[row] * (1 + _SLACK)) & (here.same[row] != self.codes[member])
        return row[kept], member[kept], far[kept]

    def _left_over(self, here: _Here, asked: np.ndarray, square: np.ndarray, some: slice) -> np.ndarray:
        """Half of what a square leaves over the squared distance of each pair, and a bit for rounding."""
        rounding = 1e-15 * here.wide.shape[1] * (here.squares + self.most + square)
        here.wide[:, -1] = (square - here.squares) / 2 + rounding
        return (here.wide if len(asked) == len(here.wide) else here.wide[asked]) @ self.wide[some].T

    def _bounded(self, here: _Here, asked: np.ndarray, bound: np.ndarray, some: slice) -> np.ndarray:
        """The bounds; of rows without one the distance of the last of ``k`` members that count, rounded up."""
        open_, k = asked[np.isinf(bound[asked])], self.tile.k
        if not len(open_) or some.stop - some.start <= k:
            return bound
        over = self._left_over(here, open_, np.zeros(len(bound)), some)
        over[here.same[open_, None] == self.codes[None, some]] = -np.inf
        last = -2 * np.partition(over, -k, axis=1)[:, -k]
        rounding = 4e-15 * here.wide.shape[1] * (here.squares[open_] + self.most)
        bound = bound.copy()
        bound[open_] = np.sqrt(np.maximum(last, 0) + rounding)
        return bound


class _Best:
    """The ``k`` nearest of some queries so far, as distances and places, and the bounds that nearer ones keep."""

    def __init__(self, bounds: np.ndarray, k: int, none: int):
        self.bound = bounds.copy()
        self.far, self.at = np.full((len(bounds), k), np.inf), np.full((len(bounds), k), none)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, row: np.ndarray, far: np.ndarray, at: np.ndarray) -> None:
        if len(row):
            self.waiting.append((row, far, at))
        if sum(len(w[0]) for w in self.waiting) >= self.far.size:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            rows = np.unique(np.concatenate([w[0] for w in self.waiting]))
            k = self.far.shape[1]
            self.waiting.append((np.repeat(rows, k), self.far[rows].ravel(), self.at[rows].ravel()))
            row, far, at = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
            order = np.lexsort((at, far, row))
            best = order[np.searchsorted(row[order], rows)[:, None] + np.arange(k)]
            self.far[rows], self.at[rows] = far[best], at[best]
            self.bound[rows] = np.minimum(self.bound[rows], self.far[rows, -1])
        self.waiting = []


def _pieces(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    step = min(ROWS_PER_BLOCK, max(1, CELLS_AT_ONCE // max(1, width)))
    for start in range(0, batch.num_rows if width else 0, step):
        yield batch.slice(start, step)


def _rows(lists: pa.Array) -> np.ndarray:
    """Lists of equally many numbers as the rows of a matrix."""
    lengths = pc.unique(pc.list_value_length(lists)).to_pylist()
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(lengths)[:5]}")
    numbers = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return numbers.reshape(len(lists), lengths[0] if lengths else 0)


def _smallest(matrix: np.ndarray) -> np.ndarray:
    """In four bytes a number if that loses none, else in eight."""
    with np.errstate(over="ignore"):
        small = matrix.astype(np.float32)
    return small if np.array_equal(small, matrix) else np.ascontiguousarray(matrix)


def _packed(matrix: np.ndarray) -> pa.Array:
    """The rows as bytes."""
    numbers = _smallest(matrix)
    ends = np.arange(len(numbers) + 1, dtype=np.int32) * (numbers.shape[1] * numbers.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(ends), pa.py_buffer(numbers)])


def _lists(values: pa.Array, most: int) -> pa.Array:
    """The values in lists of ``most``."""
    ends = np.append(np.arange(0, len(values), most), len(values)) if len(values) else np.zeros(1)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _unpacked(packs: pa.Array, counts: list[int], dims: int) -> np.ndarray:
    """All rows of packs of so many rows each, in one matrix."""
    out, at = np.empty((sum(counts), dims)), 0
    for pack, n in zip(packs, counts, strict=True):
        buffer = pack.as_buffer()
        kind = np.float32 if buffer.size == 4 * n * dims else np.float64
        out[at : at + n] = np.frombuffer(buffer, kind).reshape(n, dims)
        at += n
    return out


def _first(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query; Spark keeps that many of each task before the shuffle."""
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# Neighbours of a row in the graph, and steps of the layout: rounds of some steps, made orthogonal after each.
NEIGHBOURS = 15
ROUNDS, STEPS = 8, 5
# Directions followed beside the two that are returned; they take up what would slow the two down.
_SPARE = 8


def neighbour_graph(vectors: DataFrame, key: str, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``source, target, weight``: each row and its nearest rows, both ways.

    A neighbour weighs 1 at the distance of the row's first one and less beyond, falling by the
    mean distance over the first; of both directions the larger weight counts.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    found = written(search(rows, rows, neighbours, exclude_same=True).nearest)
    scale = found.groupBy("id").agg(F.min("distance").alias("least"), F.avg("distance").alias("mean"))
    spread = F.greatest(F.col("mean") - F.col("least"), F.lit(1e-12))
    weight = F.exp(-(F.col("distance") - F.col("least")) / spread)
    one_way = found.join(scale, "id").select(F.col("id").alias("source"), F.col("neighbour").alias("target"), weight.alias("weight"))
    both = one_way.unionByName(one_way.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    return both.groupBy("source", "target").agg(F.max("weight").alias("weight"))


def spectral_layout(
    vectors: DataFrame, key: str, neighbours: int = NEIGHBOURS, rounds: int = ROUNDS, steps: int = STEPS
) -> DataFrame:
    """Two plot coordinates per key that keep neighbours together, whatever shape the rows form.

    The coordinates are the slowest directions of a walk over the graph of nearest neighbours after the constant one, by
    power iteration over the edge table: a step gives each row the mean of itself and its neighbours. Every few steps the
    directions are made orthogonal, with sums only on the driver. Unique keys; rows without a vector have no place.
    """
    edges = written(neighbour_graph(vectors, key, neighbours))
    names = [f"d{i}" for i in range(2 + _SPARE)]
    degree = edges.groupBy("source").agg(F.sum("weight").alias("degree"))
    rows = vectors.where(F.col(key).isNotNull() & F.col("vector").isNotNull()).select(F.col(key).alias("id"))
    start = [(F.xxhash64("id", F.lit(i)) / F.lit(float(1 << 63))).alias(n) for i, n in enumerate(names)]
    # A row without neighbours keeps its place.
    own = F.coalesce("degree", F.lit(1.0)).alias("degree")
    now = written(rows.join(degree, rows["id"] == degree["source"], "left").select("id", own, *start))
    # Edges from each row to itself, as heavy as all others: a step is then one join and one sum.
    loops = now.select(F.col("id").alias("source"), F.col("id").alias("target"), F.col("degree").alias("weight"))
    walk = written(edges.unionByName(loops))
    for _ in range(rounds):
        now = _orthogonal(now, names)
        for _ in range(steps):
            now = _stepped(now, walk, names)
        now = written(now)
    final = _orthogonal(now, names)
    return final.select(F.col("id").alias(key), F.col(names[0]).alias("x"), F.col(names[1]).alias("y"))


def _stepped(now: DataFrame, walk: DataFrame, names: list[str]) -> DataFrame:
    return (
        walk.join(now.withColumnRenamed("id", "target").drop("degree"), "target")
        .groupBy(F.col("source").alias("id"))
        .agg(
            (F.sum("weight") / 2).alias("degree"),
            *[(F.sum(F.col("weight") * F.col(n)) / F.sum("weight")).alias(n) for n in names],
        )
    )


def _orthogonal(now: DataFrame, names: list[str]) -> DataFrame:
    """The directions turned to the axes of their own spread, widest first, each of mean 0 and unit length.

    Weighted by degree, as the walk is symmetric under these weights.
    """
    weighted = [F.sum(F.col("degree") * F.col(n)) for n in names]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    products = [F.sum(F.col("degree") * F.col(names[i]) * F.col(names[j])) for i, j in pairs]
    sums = now.agg(F.sum("degree"), *weighted, *products).first()
    total = sums[0] or 1.0
    means = np.array([v or 0.0 for v in sums[1 : 1 + len(names)]]) / total
    gram = np.zeros((len(names), len(names)))
    for (i, j), value in zip(pairs, sums[1 + len(names) :]):
        gram[i, j] = gram[j, i] = (value or 0.0) / total - means[i] * means[j]
    values, turns = np.linalg.eigh(gram)
    order = np.argsort(-values)
    columns = []
    for axis, name in zip(order, names):
        size = sqrt(values[axis]) if values[axis] > 1e-30 else 1.0
        turn = turns[:, axis] * (1 if turns[np.abs(turns[:, axis]).argmax(), axis] >= 0 else -1) / size
        parts = [(F.col(n) - F.lit(float(m))) * F.lit(float(t)) for n, m, t in zip(names, means, turn)]
        columns.append(sum(parts[1:], parts[0]).alias(name))
    return now.select("id", "degree", *columns)
