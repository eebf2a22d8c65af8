import numpy as np
import pytest

from spanloom.operators import memory


def vectors(n, seed=0):
    """Rows (vec_id, label, embedding): near ones, copies, one without length, null ones and other sizes."""
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, 8))
    base[n // 2 :] = base[: n - n // 2] + 0.5 * r.normal(size=(n - n // 2, 8))
    rows = [(int(i) * 7 % 1009, int(i % 2), [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    rows += [(2000 + i, 0, rows[0][2]) for i in range(5)]
    return rows + [(3000, 0, [0.0] * 8), (3001, 0, None), (3002, None, rows[0][2]), (3003, 0, [*rows[0][2][:7], None]), (3004, 0, rows[0][2][:7]), (3005, 0, rows[0][2][:7]), (3006, 1, [])]


def brute(rows, least):
    out = set()
    for a, k, v in rows:
        for b, m, w in rows:
            if a < b and k is not None and k == m and v and w and len(v) == len(w) and None not in (*v, *w) and any(v) and any(w):
                x, y = np.array(v), np.array(w)
                s = round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 6)
                if s >= least:
                    out.add((a, b, k, s))
    return out


def least_ids(ids, pairs):
    label = {i: i for i in ids}
    while True:
        new = dict(label)
        for a, b, *_ in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("cell", [4096, 16])
def test_all_pairs_and_links_in_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(memory, "CELL", cell)
    rows = vectors(150)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = [tuple(r) for r in memory.similar_pairs(df, 0.9, "label").collect()]
    want = brute(rows, 0.9)
    assert len(got) == len(set(got)) and {x[:3] for x in got} == {x[:3] for x in want}
    assert max(abs(s - {x[:2]: x[3] for x in want}[a, b]) for a, b, _, s in got) < 2e-6
    links = [tuple(r) for r in memory.similar_links(df, 0.9, "label").collect()]
    ids = {r[0] for r in rows}
    assert least_ids(ids, links) == least_ids(ids, want)
    assert cell == 16 or len(links) < len(ids)


def test_pairs_are_no_join_of_rows(spark):
    """Products of blocks: no row for a pair that isn't near, whatever the vectors' directions."""
    df = spark.createDataFrame(vectors(50), "vec_id long, label int, embedding array<float>")
    plan = memory.similar_pairs(df, 0.9, "label")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Join") == 1 and "LeftOuter" in plan


def test_links_of_copies_are_a_star(spark):
    df = spark.createDataFrame([(i, 0, [1.0, 2.0]) for i in range(300)], "vec_id long, label int, embedding array<float>")
    assert memory.similar_pairs(df, 0.9, "label").count() == 300 * 299 // 2
    assert memory.similar_links(df, 0.9, "label").count() == 299


def test_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert memory.similar_pairs(df, 0.9, "label").collect() == memory.similar_links(df, 0.9, "label").collect() == []
