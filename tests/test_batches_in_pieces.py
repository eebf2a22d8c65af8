import numpy as np
import pandas as pd

from spanloom.operators import memory, skeleton


def test_nearest_holds_products_of_tiles_only(monkeypatch):
    r = np.random.default_rng(1)
    v = r.normal(size=(90, 6)).round(1)
    v[40:50] = v[3]
    rows = pd.DataFrame({"vec_id": np.arange(90) * 3, "embedding": [*v[:-1], None]})
    queries = rows.iloc[:40:3].reset_index(drop=True)
    shapes = []
    rounded = np.round
    monkeypatch.setattr(memory, "TILE", 8)
    monkeypatch.setattr(memory.np, "round", lambda x, n: (shapes.append(x.shape), rounded(x, n))[1])
    got = pd.concat(memory._best_of(queries, 5)(iter([rows.iloc[:50], rows.iloc[50:50], rows.iloc[50:]])))
    assert max(shapes) <= (8, 8)
    unit = v[:-1] / np.linalg.norm(v[:-1], axis=1, keepdims=True)
    for q in queries["vec_id"]:
        s = rounded(unit @ unit[q // 3], 6)
        best = sorted((-x, i * 3) for i, x in enumerate(s) if i * 3 != q)[:5]
        assert [(-a, b) for a, b in best] == list(zip(*[got[got["query_id"] == q][c] for c in ("similarity", "vec_id")], strict=True))


def test_skeletons_of_a_batch_are_made_in_slices(monkeypatch):
    monkeypatch.setattr(skeleton, "SLICE", 10)
    texts = pd.Series(["a" * 4, None, "b" * 6, "c", "d" * 30, "", "e"])
    parts = [list(x) for x in skeleton._slices(texts)]
    assert parts == [["aaaa", None, "bbbbbb"], ["c"], ["d" * 30], ["", "e"]] and [len(x) for x in skeleton._slices(pd.Series([], dtype=object))] == [0]
    made = list(skeleton._skeletons.func(iter([pd.Series(["１２" * 4, "x", "３" * 9, None])])))
    assert [len(x) for x in made] == [2, 2] and made[0]["text"].tolist() == ["12" * 4, None] and made[1]["text"].tolist() == ["3" * 9, None]
