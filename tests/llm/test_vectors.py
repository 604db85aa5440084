import numpy as np
import pytest

from wattframe.llm import ann, topk
from wattframe.llm.topk import search_group

SCHEMA = "vec_id long, vector array<double>, score string, id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA)


def rows_of(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def products(queries, candidates, k):
    out = []
    for i, q in queries.items():
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(q, c)), j) for j, c in candidates.items() if j != i)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def shapes(kind, n=700, dim=8):
    rng = np.random.default_rng(5)
    data = np.floor(rng.normal(size=(n, dim)) * 64)
    if kind == "lengths":
        data = np.floor(data * rng.pareto(1.0, (n, 1)))
    if kind == "clusters":
        data = np.floor(rng.normal(size=(12, dim)) * 4000)[rng.integers(0, 12, n)] + rng.integers(-9, 9, (n, dim))
    if kind == "hot":
        data[: n // 3] = data[0]
    if kind == "large":
        data = np.floor(data * 2.0**21)
    return {int(i): row.tolist() for i, row in enumerate(data)}


@pytest.mark.parametrize("kind", ["plain", "lengths", "clusters", "hot", "large"])
def test_exact_top_k(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "GROUP_ROWS", 150)
    monkeypatch.setattr(topk, "BUCKET_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 30)
    monkeypatch.setattr(topk, "HOLD_BYTES", 9_000)
    rows = shapes(kind)
    asked = {i: v for i, v in rows.items() if i % 10 == 0}
    got = topk.exact_top_k(frame(spark, asked.items()), frame(spark, rows.items()), 20)
    assert rows_of(got) == products(asked, rows, 20)


@pytest.mark.parametrize("held", [1_000_000, 6_000])
def test_each_vector_is_sent_a_bounded_number_of_times(spark, monkeypatch, held):
    """A group goes out once per deal, and deals are bounded by tasks; a block of queries goes out once per run."""
    monkeypatch.setattr(topk, "HOLD_BYTES", held)
    sent = {}
    for n in (600, 2_400):
        rows = frame(spark, shapes("plain", n).items())
        ready = topk.one_per_id(rows, "vec_id", "vector")
        groups, asked = topk._blocks(ready, 8, 100).cache(), topk._blocks(ready, 8, 50).cache()
        asked = asked.selectExpr("*", "0.0D AS need", "CAST('' AS BINARY) AS theta", "-1L AS first")
        runs = topk.held_groups(groups).agg({"held": "max"}).first()[0] + 1
        work, cells = topk._cells(groups, asked, 6)
        bytes_sent = {r.role: r.b for r in work.groupBy("role").agg(topk.F.sum(topk.F.octet_length("data")).alias("b")).collect()}
        once = [df.agg(topk.F.sum(topk.F.octet_length("data"))).first()[0] for df in (groups, asked)]
        deals = cells // runs
        assert deals <= max(1, -(-6 // runs)) and cells >= 6
        assert bytes_sent == {0: once[0] * deals, 1: once[1] * runs}
        sent[n] = deals, runs
    if held == 1_000_000:
        assert sent[600] == sent[2_400]
    else:
        assert sent[2_400][0] == 1 and sent[2_400][1] > 4


def test_buckets_prune():
    """Coordinates and lengths select the same results as multiplying everything."""
    rows = shapes("clusters", 900)
    ids, data = np.array(list(rows)), np.array(list(rows.values()))
    lengths = np.sqrt((data * data).sum(1))
    order = np.argsort(-lengths, kind="stable")
    found = search_group(ids[:50], lengths[:50], data[:50], np.full(50, -np.inf), ids[order], lengths[order], data[order], 7)
    got = [(int(i), r + 1, j, s) for i, js, ss in zip(ids[:50], found.ids, found.scores) for r, (j, s) in enumerate(zip(js, ss))]
    assert sorted(got) == products({int(i): rows[int(i)] for i in ids[:50]}, rows, 7)


ODD = [(0, [3.0, 4.0]), (20, None), (40, [1.0, None]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (100, [0.0, 0.0]),
       (None, [1.0, 1.0]), (1, [3.0, 4.0]), (1, [3.0, 4.0]), (2, [1.0]), (3, []), (120, [3.0, 4.0])]


def test_top_k_odd_rows(spark):
    df = frame(spark, ODD)
    got = rows_of(topk.exact_top_k(df.where("vec_id % 20 = 0"), df, 20))
    kept = {0: [3, 4], 100: [0, 0], 1: [3, 4], 2: [1, 0], 3: [0, 0], 120: [3, 4]}
    assert got == products({i: kept[i] for i in (0, 100, 120)}, kept, 20)
    assert topk.exact_top_k(df.limit(0), df, 3).count() == topk.exact_top_k(df, df.limit(0), 3).count() == 0


def cosines(queries, candidates, k):
    out = []
    ids, data = np.array(list(candidates)), np.array(list(candidates.values()))
    for i, q in queries.items():
        s = (data * np.array(q)).sum(1) / (np.sqrt((data * data).sum(1)) * np.sqrt((np.array(q) ** 2).sum()))
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out += [(i, r + 1, int(ids[j]), float(s[j])) for r, j in enumerate(order)]
    return out


def recall(got, want):
    return len({(q, j) for q, _, j, _ in got} & {(q, j) for q, _, j, _ in want}) / len(want)


@pytest.mark.parametrize("kind", ["plain", "clusters", "hot"])
def test_nearest(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "CELL_ROWS", 60)
    rows = shapes(kind, dim=24)
    asked = {i: v for i, v in rows.items() if i % 10 == 0}
    got = rows_of(ann.nearest(frame(spark, asked.items()), frame(spark, rows.items()), 5))
    want = cosines(asked, rows, 5)
    assert recall(got, want) >= 0.9
    true = {(q, j): s for q, _, j, s in cosines(asked, rows, len(rows))}
    assert all(s == pytest.approx(true[q, j], abs=1e-12) for q, _, j, s in got)
    if kind == "hot":
        assert [j for q, _, j, _ in got if q == 0] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("kind", ["plain", "clusters", "hot"])
def test_nearest_with_several_hashes(spark, monkeypatch, kind):
    """Three hashes in a table; buckets share groups, groups are cut into cells."""
    monkeypatch.setattr(ann, "CELL_ROWS", 60)
    monkeypatch.setattr(ann, "BUCKET_ROWS", 0.05)
    assert len(ann.hash_widths(700, 32)) == 3 and ann.low_bits([32, 32, 2]) > 2
    rows = shapes(kind, dim=24)
    asked = {i: v for i, v in rows.items() if i % 10 == 0}
    got = rows_of(ann.nearest(frame(spark, asked.items()), frame(spark, rows.items()), 5, tables=24, probes=16))
    want = cosines(asked, rows, 5)
    assert recall(got, want) >= 0.9
    true = {(q, j): s for q, _, j, s in cosines(asked, rows, len(rows))}
    assert all(s == pytest.approx(true[q, j], abs=1e-12) for q, _, j, s in got)
    assert len({(q, j) for q, _, j, _ in got}) == len(got)


def test_candidates_grow_more_slowly_than_the_table():
    rng = np.random.default_rng(3)
    met, found = {}, {}
    for n in (4_000, 64_000):
        data = rng.normal(size=(n, 64))
        data /= np.sqrt((data * data).sum(1, keepdims=True))
        asked = data[:50]
        scores = asked @ data.T
        scores[np.arange(50), np.arange(50)] = -2
        best = np.argsort(-scores, axis=1)[:, :5]
        widths = ann.hash_widths(n, 64)
        met[n], hit = 0, np.zeros(best.shape, bool)
        for table in range(ann.TABLES):
            filed = ann.codes(data, table, widths, 1, 7)[:, 0]
            probes = ann.codes(asked, table, widths, ann.n_probes(widths, ann.PROBES), 7)
            sizes = np.bincount(filed, minlength=int(np.prod([2 * w for w in widths])))
            met[n] += sizes[probes].sum() / 50
            hit |= (filed[best][:, :, None] == probes[:, None, :]).any(2)
        found[n] = hit.mean()
    assert met[64_000] < 6 * met[4_000]  # the table is 16 times as large
    assert min(found.values()) >= 0.9


def test_scores_out_of_the_range_of_squares(spark):
    rows = [(0, [1e200, 1e200]), (1, [1.0, 0.0]), (2, [1e-200, 1e-200]), (50, [0.0, 1.0])]
    got = rows_of(ann.nearest(frame(spark, rows), frame(spark, rows), 3, probes=4))
    assert {(q, j): s for q, _, j, s in got} == pytest.approx({
        (q, j): 0.0 if {q, j} == {1, 50} else 1.0 if {q, j} == {0, 2} else 0.5**0.5
        for q in (0, 1, 2, 50) for j in (0, 1, 2, 50) if q != j})


def test_nearest_odd_rows(spark):
    df = frame(spark, ODD)
    got = rows_of(ann.nearest(df.where("vec_id % 20 = 0"), df, 5, tables=20, probes=4))
    assert [(q, j) for q, _, j, _ in got] == [(0, 1), (0, 120), (0, 2), (120, 0), (120, 1), (120, 2)]
    assert [s for q, _, _, s in got if q == 0] == pytest.approx([1, 1, 0.6])
    assert ann.nearest(df.limit(0), df, 3).count() == ann.nearest(df, df.limit(0), 3).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall(spark, folder):
    from wattframe.llm.queries import op3_nearest

    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    got = rows_of(op3_nearest(spark, folder))
    want = cosines({i: v for i, v in rows.items() if i % 50 == 0}, rows, 5)
    assert len(got) == len(want) and recall(got, want) >= 0.9


def test_nearest_prepares_rows_once(spark):
    """Rows are hashed twice; what comes before, one row per id and few of equal vectors, is not in the plan again."""
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i)]) for i in range(40)], "vec_id long, vector array<float>")
    got = ann.nearest(rows.where("vec_id % 20 = 0"), rows, 2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(vector" not in plan and "LocalRelation" not in plan and "LogicalRDD" not in plan
    assert got.count() == 4


def test_hashed_rows_are_not_broadcast(spark):
    """Few queries become many hashed rows, whatever the planner takes them for; the driver must not hold them."""
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i)]) for i in range(40)], "vec_id long, vector array<float>")
    got = ann.nearest(rows.where("vec_id % 20 = 0"), rows, 2)
    assert len(got.collect()) == 4
    run = got._jdf.queryExecution()
    assert "Broadcast" not in run.sparkPlan().toString() + run.executedPlan().toString()
