"""Matching, pooling, summaries and clustering against brute force."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import cluster, features, match
from tidewatch.plans import jobs
from tidewatch.session import written

RNG = np.random.default_rng(7)


def vectors(spark, array, name):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(array)]
    return spark.createDataFrame(rows, f"{name} long, vector array<double>")


@pytest.mark.parametrize("broadcast_elements", [10_000, 8])
def test_nearest_equals_brute_force(spark, broadcast_elements):
    techniques = RNG.normal(size=(23, 8))
    techniques[20] = techniques[3]  # an exact copy: the first one must win
    texts = np.vstack([RNG.normal(size=(60, 8)), techniques[3] * 2.5])
    got = match.nearest(
        vectors(spark, texts, "text_id"), vectors(spark, techniques, "ordinal"), 8,
        broadcast_elements=broadcast_elements, rows_per_block=7,
    ).collect()
    scores = match.unit_rows(texts) @ match.unit_rows(techniques).T
    assert {r.text_id: r.ordinal for r in got} == {i: int(s.argmax()) for i, s in enumerate(scores)}
    assert len(got) == len(texts)
    for r in got:
        assert r.score == pytest.approx(scores[r.text_id].max(), abs=1e-12)


def test_blank_texts_have_no_match(spark):
    texts = spark.createDataFrame(
        [(1, "phishing mail with a link"), (2, "  \n "), (3, None), (4, "zzz unknown")], "id int, body string"
    )
    techniques = spark.createDataFrame(
        [("T1", "Phishing Mail", "d"), ("T2", "Scan Network", "d"), ("T3", None, "d")],
        "technique_id string, technique_name string, description string",
    )
    got = {r.id: r.mitre_match for r in jobs.match_techniques(texts, techniques, "body").collect()}
    assert (got[1].id, got[1].name) == ("T1", "Phishing Mail")
    assert got[2] is None and got[3] is None and got[4] is None
    by_text = jobs.match_techniques(texts, techniques.withColumn("description", F.concat(F.lit("scan "), "technique_id")), "body", "description")
    assert len(by_text.collect()) == 4


@pytest.mark.parametrize("broadcast_postings", [10_000, 0])
def test_one_technique_and_words_of_all_can_be_found(spark, broadcast_postings):
    texts = spark.createDataFrame([(1, "Phishing mail"), (2, "other")], "id int, body string")
    schema = "technique_id string, technique_name string, description string"
    one = spark.createDataFrame([("T1", "Phishing", "d")], schema)
    got = {r.id: r.mitre_match for r in jobs.match_techniques(texts, one, "body", broadcast_postings=broadcast_postings).collect()}
    assert got[1].id == "T1" and got[1].score == pytest.approx(1) and got[2] is None
    two = spark.createDataFrame([("T1", "mail scan", "d"), ("T2", "mail", "d")], schema)
    found = jobs.match_techniques(texts, two, "body", broadcast_postings=broadcast_postings).where("id = 1").first()
    assert found.mitre_match.id == "T2"


@pytest.mark.parametrize("broadcast_postings", [10_000, 0])
def test_every_technique_can_be_found(spark, broadcast_postings):
    """700 techniques that differ in one word; ties, repeated and null ids keep their rows."""
    techniques = spark.createDataFrame(
        [(f"T{i}", f"name {i}", f"shared text word{i}") for i in range(700)] + [("T700", "again", "shared text word3")],
        "technique_id string, technique_name string, description string",
    ).coalesce(1)
    rows = [(i, f"some text has word{i} in it") for i in range(700)]
    rows += [(5, "word5 word5 word6"), (None, "WORD9"), (None, "nothing"), (5, "word5 word5 word6"), (1, None)]
    texts = spark.createDataFrame(rows, "id int, body string")
    found = jobs.match_techniques(texts, techniques, "body", "description", broadcast_postings).collect()
    assert len(found) == len(rows)
    for row in found:
        if row.body is None or row.body == "nothing":
            assert row.mitre_match is None
        elif row.body.startswith("some"):
            assert row.mitre_match.id == f"T{row.id}"
    assert [r.mitre_match.id for r in found if r.body and r.body.startswith("word5")] == ["T5", "T5"]
    assert [r.mitre_match.id for r in found if r.body == "WORD9"] == ["T9"]


def test_flat_match(spark):
    df = spark.sql("SELECT 1 a, named_struct('id','T1','name','n','score',0.5D) mitre_match UNION ALL SELECT 2, null")
    got = match.flatten_match(df)
    assert got.columns == ["a", "technique_id", "similarity"]
    assert sorted(map(tuple, got.collect())) == [(1, "T1", 0.5), (2, None, None)]


def test_match_unmatched_keeps_old_matches(spark):
    cves = spark.sql(
        "SELECT 'C1' cve_id, 'scan network' summary, named_struct('id','T9','name','old','score',1D) mitre_match "
        "UNION ALL SELECT 'C2', 'scan the network', null UNION ALL SELECT 'C3', '', null"
    )
    techniques = spark.createDataFrame(
        [("T1", "n1", "phishing mail"), ("T2", "n2", "scan network"), ("T3", "n3", None)],
        "technique_id string, technique_name string, description string",
    )
    got = {r.cve_id: r.mitre_match for r in jobs.match_unmatched(cves, techniques).collect()}
    assert got["C1"].id == "T9" and got["C2"].id == "T2" and got["C2"].name == "n2" and got["C3"] is None


TEXTS = ["alpha beta beta", "beta gamma", "", "alpha alpha delta", "gamma delta beta epsilon"]


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def brute_weights():
    docs = [words(t) for t in TEXTS if t.strip()]
    df = Counter(w for d in docs for w in set(d))
    return {w: math.log((len(docs) + 1) / (n + 1)) for w, n in df.items()}


def brute_vector(tokens, weights):
    counts = {w: n * weights[w] for w, n in Counter(tokens).items() if weights.get(w)}
    norm = math.sqrt(sum(x * x for x in counts.values()))
    return {w: x / norm for w, x in counts.items()}


def by_id(rows):
    found = {}
    for row in rows.collect():
        found.setdefault(row.id, {})[row.word] = row.weight
    return found


def test_vectors_hold_every_word(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    weights = features.word_weights(df, "t")
    assert {r.word: r.idf for r in weights.collect()} == pytest.approx(brute_weights())
    got = by_id(features.embed(df, weights, "id", "t"))
    assert set(got) == {0, 1, 3, 4}
    for i, vector in got.items():
        assert vector == pytest.approx(brute_vector(words(TEXTS[i]), brute_weights()))


def test_long_texts_are_pooled_over_all_chunks(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    weights = features.word_weights(df, "t")
    long = " ".join(RNG.choice(["alpha", "beta", "gamma", "delta", "epsilon", "other"], 1300))
    texts = spark.createDataFrame([(0, long), (1, "beta"), (2, " ")], "id int, t string")
    got = by_id(features.embed_long_texts(texts, weights, "id", "t"))
    assert set(got) == {0, 1}
    for i, text in ((0, long), (1, "beta")):
        tokens = words(text)
        parts = [brute_vector(tokens[s : s + 510], brute_weights()) for s in range(0, len(tokens), 256)]
        mean = {w: sum(p.get(w, 0) for p in parts) / len(parts) for p in parts for w in p}
        assert got[i] == pytest.approx(mean)


def test_rare_words_meet_their_row(spark):
    """The same vectors whether all words are sent to the tasks, some, or none; null and repeated ids as before."""
    rows = [*enumerate(TEXTS), (None, "alpha beta once"), (20, "delta alpha"), (20, "epsilon"), (21, " "), (22, None)]
    texts = spark.createDataFrame(rows, "id int, t string")
    weights = features.word_weights(texts, "t")
    joined: dict = {}
    for i, t in rows:
        joined.setdefault(i, []).extend(words(t or ""))
    idf = {r.word: r.idf for r in weights.collect()}
    want = {i: {w: x for w, x in brute_vector(ws, idf).items() if x} for i, ws in joined.items() if ws}
    for sent in (0, 3, 200_000):
        got = by_id(features.embed(texts, weights, "id", "t", sent_words=sent))
        assert set(got) == {i for i, vector in want.items() if vector}
        for i, vector in got.items():
            assert vector == pytest.approx(want[i])
        single = {i: vector for i, vector in got.items() if i != 20}
        long = by_id(features.embed_long_texts(texts, weights, "id", "t", sent_words=sent))
        assert {i: long[i] for i in single} == {i: pytest.approx(v) for i, v in single.items()}
        # Windows of the same number are one: those of both texts of id 20.
        assert long[20] == pytest.approx(want[20])


def test_texts_are_weighed_in_their_row(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    weights = features.word_weights(df, "t")
    for found in (features.embed(df, weights, "id", "t"), features.embed_long_texts(df, weights, "id", "t")):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_chunks_start_at_every_stride(spark):
    df = spark.createDataFrame([(["w"] * n,) for n in (1, 256, 257, 600)] + [([],)], "w array<string>")
    sizes = [r[0] and [len(c) for c in r[0]] for r in df.select(features.chunks(F.col("w"))).collect()]
    assert sizes == [[1], [256], [257, 1], [510, 344, 88], None]


def test_summary(spark):
    text = "Ransom groups attack hospitals. Nice day! Ransom groups attack banks and hospitals.\nUnrelated closing words here? The end."
    df = spark.createDataFrame([(1, text), (2, "  "), (3, None), (4, "One only."), (None, "No id."), (4, "One only.")], "id int, t string")
    rows = df.select("id", features.summary(F.col("t"), min_words=3, max_words=10).alias("summary")).collect()
    assert sorted(r.summary for r in rows if r.id in (None, 4)) == ["No id.", "One only.", "One only."]
    got = {r.id: r.summary for r in rows}
    assert got[1] == "Ransom groups attack hospitals. Ransom groups attack banks and hospitals."
    assert got[2] == got[3] == "" and got[4] == "One only."


def test_source_transform_keeps_failed_and_blank_texts(spark):
    df = spark.createDataFrame(
        [("boannews", "t1", "ok"), ("boannews", "t2", "fail"), ("boannews", " ", ""), ("other", "t3", "ok"), (None, "t4", "ok")],
        "source string, title string, content string",
    )

    def shout(batches):
        for batch in batches:
            if (batch["content"] == "fail").any():
                raise ValueError("cannot translate")
            yield batch.assign(title=batch["title"].str.upper(), content=batch["content"].str.upper())

    got = sorted((tuple(r) for r in features.transform_source(df, "boannews", shout).collect()), key=repr)
    assert got == sorted(
        [("boannews", "T1", "OK"), ("boannews", "t2", "fail"), ("boannews", " ", ""), ("other", "t3", "ok"), (None, "t4", "ok")],
        key=repr,
    )


def counts_frame(spark, data):
    """Positive counts in long form, as the jobs make them."""
    rows = [(f"g{i:02d}", f"T{j}", int(x)) for i, row in enumerate(data) for j, x in enumerate(row) if x]
    return spark.createDataFrame(rows, "`group` string, technique_id string, count long")


DATA = np.vstack([RNG.integers(0, 3, (6, 4)), RNG.integers(20, 23, (6, 4)), RNG.integers(50, 53, (5, 4))])
DATA[:, 3] = 7  # a constant column


def scaled(data):
    std = data.std(axis=0)
    return (data - data.mean(axis=0)) / np.where(std == 0, 1, std)


def test_standardize(spark):
    counts = counts_frame(spark, DATA)
    got = {(r.group, r.technique_id): r.z for r in cluster.standardize(counts, "group").collect()}
    vectors_, dims = cluster.scaled_vectors(counts, "group")
    rows = {r.group: np.array(r.vector) for r in vectors_.collect()}
    want = scaled(DATA)
    assert dims == DATA.shape[1]
    for i in range(len(DATA)):
        # Not centred: differences between rows are those of the standardized matrix.
        assert np.allclose(rows[f"g{i:02d}"] - rows["g00"], want[i] - want[0])
        assert np.allclose([got[f"g{i:02d}", f"T{j}"] for j in range(DATA.shape[1])], want[i])


def test_many_techniques(spark):
    """3,000 techniques, planted in three groups of keys."""
    data = np.zeros((12, 3_000), dtype=int)
    for i in range(12):
        data[i, (i % 3) * 1_000 : (i % 3 + 1) * 1_000] = 3 + i
    vectors_, dims = cluster.scaled_vectors(counts_frame(spark, data), "group")
    assert dims == 3_000
    table = written(vectors_)
    sweep = cluster.sweep_k(table, "group", 12, dims, max_k=4)
    labels = {r.group: r.cluster for r in cluster.assign(table, "group", sweep.model).collect()}
    assert sweep.best_k == 3 and len({(labels[f"g{i:02d}"], i % 3) for i in range(12)}) == 3


def brute_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i, own in enumerate(labels):
        mine = labels == own
        if mine.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, mine].sum() / (mine.sum() - 1)
        b = min(d[i, labels == other].mean() for other in set(labels) if other != own)
        out.append((b - a) / max(a, b))
    return out


@pytest.mark.parametrize("broadcast_elements", [10_000, 8])
def test_silhouette_equals_brute_force(spark, broadcast_elements):
    x = RNG.normal(size=(40, 5))
    labels = np.array([0] + [1 + i % 3 for i in range(39)])
    rows = [(i, [float(v) for v in x[i]], int(labels[i])) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, cluster int")
    got = cluster.euclidean_silhouette(df, "id", 5, broadcast_elements, rows_per_block=9)
    want = brute_silhouette(x, labels)
    result = {r.id: r.silhouette for r in got.collect()}
    assert [result[i] for i in range(40)] == pytest.approx(want, abs=1e-9)


def test_sweep_finds_the_planted_clusters(spark):
    vectors_, dims = cluster.scaled_vectors(counts_frame(spark, DATA), "group")
    table = written(vectors_)
    sweep = cluster.sweep_k(table, "group", len(DATA), dims)
    assert [k for k, _, _ in sweep.scores] == list(range(2, 11))
    assert sweep.best_k == 3
    labels = {r.group: r.cluster for r in cluster.assign(table, "group", sweep.model).collect()}
    parts = {tuple(sorted(g for g, c in labels.items() if c == k)) for k in range(3)}
    names = [f"g{i:02d}" for i in range(17)]
    assert parts == {tuple(names[:6]), tuple(names[6:12]), tuple(names[12:])}
    plane = {r.group: (r.x, r.y) for r in cluster.project_2d(table, "group").collect()}
    assert len(plane) == 17
    u, s, vt = np.linalg.svd(scaled(DATA) - scaled(DATA).mean(0), full_matrices=False)
    first = np.array([plane[n][0] for n in names])
    # The origin is not that of the standardized matrix, so positions count from their mean.
    assert np.allclose(np.abs(first - first.mean()), np.abs((scaled(DATA) - scaled(DATA).mean(0)) @ vt[0]), atol=1e-8)


def test_tiny_table_falls_back(spark):
    vectors_, dims = cluster.scaled_vectors(counts_frame(spark, DATA[[0, 7]]), "group")
    table = written(vectors_)
    sweep = cluster.sweep_k(table, "group", 2, dims)
    assert sweep.scores == () and sweep.best_k == 2
    assert cluster.assign(table, "group", sweep.model).count() == 2
