"""Pruned nearest neighbours against all pairs, and the layout of shapes that no plane parts."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidewatch.operators import cluster, match, neighbours
from tidewatch.session import written

RNG = np.random.default_rng(11)


def frame(spark, x, ids=None):
    rows = [(i if ids is None else ids[i], [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, f"id {'long' if ids is None else 'string'}, vector array<double>")


def nearest(found):
    out = {}
    for r in sorted(found.nearest.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["id"], []).append(r["neighbour"])
    return out


@pytest.mark.parametrize("distance", [neighbours.euclidean, neighbours.chord])
@pytest.mark.parametrize("rows_per_block", [4_096, 5])
def test_neighbours_equal_all_pairs(spark, distance, rows_per_block):
    x = np.vstack([RNG.normal(size=(60, 4)), np.repeat(RNG.normal(size=(1, 4)), 9, 0), np.zeros((2, 4))])
    table = frame(spark, x)
    got = nearest(neighbours.search(table, table, 3, distance, exclude_same=True, rows_per_block=rows_per_block))
    to = distance(x, x)
    np.fill_diagonal(to, np.inf)
    assert got == {i: np.argsort(to[i].round(12), kind="stable")[:3].tolist() for i in range(len(x))}


def test_clustered_vectors_meet_few_blocks(spark):
    centres = RNG.normal(size=(30, 12))
    x = centres[RNG.integers(0, 30, 1_200)] + RNG.normal(0, 0.01, (1_200, 12))
    found = neighbours.search(frame(spark, x[600:]), frame(spark, x[:600]), 1, neighbours.chord)
    scores = neighbours.chord(x[600:], x[:600])
    assert nearest(found) == {i: [int(s.argmin())] for i, s in enumerate(scores)}
    assert found.met.count() < 0.2 * 600 * found.blocks


def test_few_or_no_rows(spark):
    two = frame(spark, np.eye(2), ["a", "b"])
    assert nearest(neighbours.search(two, two, 5)) == {"a": ["a", "b"], "b": ["b", "a"]}
    assert nearest(neighbours.search(two, two, 5, exclude_same=True)) == {"a": ["b"], "b": ["a"]}
    assert nearest(neighbours.search(two, two.limit(0), 1)) == {}
    assert nearest(neighbours.search(two.limit(0), two, 1)) == {}
    odd = spark.createDataFrame([("x", None), (None, [1.0, 0.0])], two.schema)
    assert nearest(neighbours.search(two, two.union(odd), 1)) == {"a": ["a"], "b": ["b"]}


def test_layout_parts_rings_that_components_do_not(spark):
    turn = RNG.uniform(0, 2 * np.pi, 300)
    radius = np.where(np.arange(300) < 100, 1.0, 4.0)
    x = np.c_[radius * np.cos(turn), radius * np.sin(turn)] + RNG.normal(0, 0.05, (300, 2))
    table = written(frame(spark, x))

    def parted(plane):
        """Whether some line through one of the axes parts the rings."""
        rows = {r["id"]: (r["x"], r["y"]) for r in plane.collect()}
        at = np.array([rows[i] for i in range(300)])
        inner, outer = at[:100], at[100:]
        return any(inner[:, k].min() > outer[:, k].max() or inner[:, k].max() < outer[:, k].min() for k in (0, 1))

    assert parted(neighbours.spectral_layout(table, "id"))
    assert not parted(cluster.project_2d(table, "id"))


def test_layout_of_few_rows(spark):
    one = frame(spark, np.eye(1))
    assert [r["id"] for r in neighbours.spectral_layout(one, "id", rounds=1, steps=1).collect()] == [0]
    odd = spark.createDataFrame([(5, None), (None, [1.0])], one.schema)
    table = frame(spark, np.array([[0.0], [0.1], [9.0], [9.1]])).union(odd)
    found = {r["id"]: r["x"] for r in neighbours.spectral_layout(table, "id", neighbours=1).collect()}
    assert set(found) == {0, 1, 2, 3}
    assert found[0] == pytest.approx(found[1], abs=1e-6) and found[2] == pytest.approx(found[3], abs=1e-6)
    assert abs(found[0] - found[2]) > 0.5


def all_pairs(queries, references, k, distance, exclude_same):
    """Of each id the nearest over all rows that have it, as (neighbour, distance), from plain lists of (id, vector)."""
    to = distance(np.array([v for _, v in queries]), np.array([v for _, v in references]))
    out = {}
    for (i, _), row in zip(queries, to):
        pairs = [(round(float(d), 9), j) for (j, _), d in zip(references, row) if not (exclude_same and i == j)]
        out[i] = sorted(out.get(i, []) + pairs)[:k]
    return {i: [(j, d) for d, j in pairs] for i, pairs in out.items() if pairs}


def pairs_of(found):
    out = {}
    for r in sorted(found.nearest.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["id"], []).append((r["neighbour"], round(r["distance"], 9)))
    return out


def rows_written(folder):
    return sum(pq.read_metadata(p).num_rows for p in Path(folder).glob("tidewatch-*/*.parquet"))


def test_vectors_without_clusters_are_not_written_for_each_block(spark):
    """every query meets every block here, 39 of them; its vector stands in no table for each."""
    x = RNG.normal(size=(1_500, 16))
    table, folder = written(frame(spark, x)), spark.conf.get("spark.checkpoint.dir")
    before = rows_written(folder)
    found = neighbours.search(table, table, 4, exclude_same=True)
    assert found.blocks == 39 and len(nearest(found)) == 1_500
    assert before < rows_written(folder) < before + 4 * 1_500
    assert pairs_of(found) == all_pairs([*enumerate(x)], [*enumerate(x)], 4, neighbours.euclidean, True)


@pytest.mark.parametrize("distance", [neighbours.euclidean, neighbours.chord, lambda a, b: np.abs(a[:, None] - b[None]).max(2)])
@pytest.mark.parametrize("exclude_same", [True, False])
def test_repeated_ids_and_vectors(spark, distance, exclude_same):
    """Whole rows twice, one id with two vectors, and one vector of very many ids, cut into slices and parts."""
    x = [*RNG.integers(-3, 4, (60, 3)).astype(float), *RNG.normal(size=(40, 3)), *[np.array([1.0, 2.0, 0.5])] * 90, np.zeros(3)]
    rows = [(i, v) for i, v in enumerate(x)] + [(i, x[i]) for i in range(0, 150, 7)] + [(5, x[70]), (5, x[5])]
    table = written(frame(spark, [v for _, v in rows], [f"{i:03d}" for i, _ in rows]))
    named = [(f"{i:03d}", v) for i, v in rows]
    found = neighbours.search(table, table, 4, distance, exclude_same, rows_per_block=2)
    want = all_pairs(named, named, 4, distance, exclude_same)
    got = pairs_of(found)
    assert {i: [d for _, d in p] for i, p in got.items()} == {i: [d for _, d in p] for i, p in want.items()}
    if distance is neighbours.euclidean:
        assert got == want


def test_numbers_that_fit_four_bytes_and_others(spark):
    wide, narrow = RNG.normal(size=(80, 5)), RNG.normal(size=(80, 5)).astype(np.float32).astype(float)
    for q, r in ((wide, narrow), (narrow, wide), (narrow * 1e30, wide * 1e30), (np.vstack([narrow, wide]), narrow)):
        got = nearest(neighbours.search(frame(spark, q), frame(spark, r), 3, rows_per_block=7))
        assert got == {i: np.argsort(d, kind="stable")[:3].tolist() for i, d in enumerate(neighbours.euclidean(q, r))}


def test_rows_that_are_no_numbers_hide_no_others(spark):
    """Such a reference once made its block's radius no number, so that queries of other blocks passed the block over."""
    x = RNG.normal(size=(50, 3))
    odd = frame(spark, [[float("nan")] * 3, [float("inf"), 0.0, 0.0]], ["nan", "inf"])
    table = frame(spark, x, [f"{i:02d}" for i in range(50)]).union(odd)
    want = {f"{i:02d}": [f"{j:02d}" for j in np.argsort(d, kind="stable")[:6]] for i, d in enumerate(neighbours.euclidean(x, x))}
    assert nearest(neighbours.search(table, table, 6)) == want


def test_one_vector_of_many_rows(spark):
    """2,000 equal rows: each names the least ids, and only some of them are compared."""
    table = written(frame(spark, np.vstack([np.ones((2_000, 4)), RNG.normal(size=(100, 4))])))
    got = nearest(neighbours.search(table, table, 2, exclude_same=True, rows_per_block=64))
    assert all(got[i] == [j for j in (0, 1, 2) if j != i][:2] for i in range(2_000)) and len(got) == 2_100


@pytest.mark.parametrize("counts", [[5, 0, 3, 4, 50, 0, 1], [0, 0], [7], []])
def test_shares_hold_small_blocks_and_cut_large_ones(counts):
    shares = neighbours._Shares.of(np.array(counts, dtype=np.int64), 1, 400_000)
    held = {}
    for block, n in enumerate(counts):
        for share in shares.range_of(block):
            held[share] = held.get(share, 0) + n / len(shares.range_of(block))
    assert sorted(held) == list(range(len(held)))
    assert all(n <= max(1, min(10, -(-sum(counts) // 6))) for n in held.values())


def test_blocked_match_writes_no_vector_for_each_block(spark):
    """the match of more techniques than are sent takes the same way, and the first of equal ones wins."""
    x = RNG.normal(size=(1_500, 16))
    x[1] = x[701]
    ids = frame(spark, x).withColumnRenamed("id", "text_id")
    table, folder = written(ids), spark.conf.get("spark.checkpoint.dir")
    before = rows_written(folder)
    texts, known = table.where("text_id % 2 = 0"), table.where("text_id % 2 = 1").withColumnRenamed("text_id", "ordinal")
    found = match.nearest(texts, known, 16, broadcast_elements=16)
    got = {r["text_id"]: (r["ordinal"], r["score"]) for r in found.collect()}
    assert before < rows_written(folder) < before + 4 * 1_500
    unit = match.unit_rows(x)
    scores = unit[::2] @ unit[1::2].T
    assert {i: o for i, (o, _) in got.items()} == {2 * i: 2 * int(s.round(12).argmax()) + 1 for i, s in enumerate(scores)}
    assert [got[2 * i][1] for i in range(750)] == pytest.approx(scores.max(1), abs=1e-9)
