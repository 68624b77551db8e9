"""The tile grid of an image is found inside its row."""

from layerframe.operators import plans_px as Q


def plain(h, w, lo, hi, tol=1e-3):
    found = []
    for r in range(1, max(1, int(h // lo)) + 1):
        for c in range(1, max(1, int(w // lo)) + 1):
            unit = min(h / r, w / c, hi)
            found.append((not lo - tol <= unit <= hi + tol, max(0.0, h * w - (r * unit) * (c * unit)), abs(unit - (lo + hi) * 0.5), abs(r - c), r, c, unit))
    return min(found)


def test_grids_without_a_row_per_candidate(spark):
    sizes = [(2.0, 3.0), (9.7, 14.2), (30.0, 2.5), (12.0, 12.0), (100.0, 61.3), (1.0, 1.0)]
    images = spark.createDataFrame([(i, h, w) for i, (h, w) in enumerate([*sizes, (0.0, 5.0)])], "id int, height_nm double, width_nm double")
    g = Q.optimal_grid(images.union(images), ["id"], 2.4, 4.8)
    got = {r.id: (r.row, r.col, r.unit_nm, r.loss_nm2) for r in g.collect()}
    want = {i: plain(h, w, 2.4, 4.8) for i, (h, w) in enumerate(sizes)}
    assert got == {i: (p[4], p[5], p[6], p[1]) for i, p in want.items()} and g.count() == len(sizes)
    plan = g._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortAggregate" not in plan
    assert Q.optimal_grid(images, ["id"], -1.0, 0.0).isEmpty()
