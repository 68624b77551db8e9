"""The stacking analysis from pixels to the interlayer table on a planted slip."""

import os

import numpy as np
import pandas as pd
import pytest

from layerframe.plans.stacking import analyse_folders
from layerframe.sources import tables as TB
from tests.test_lattice import patch


# about three minutes; the parts it chains have tests of their own
pytestmark = pytest.mark.skipif(not os.environ.get("RUN_SLOW"), reason="set RUN_SLOW=1 for the end-to-end run")


def image(pts):
    a = np.zeros((128, 128))
    yy, xx = np.mgrid[:128, :128]
    for x, y in pts:
        a = np.maximum(a, 220.0 * np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / (2 * 2.2 ** 2)))
    return np.rint(a + 10)


def test_slip_found_from_pixels(spark):
    base = patch(0, jitter=0.0)
    imgs = {"d/run_2.79x2.79/a_0.png": image(base), "d/run_2.79x2.79/a_1.png": image(base + [2.0, -1.0]), "d/lone/b_0.png": image(base)}
    px = pd.concat([pd.DataFrame({"image_id": k, "x": np.tile(np.arange(128), 128), "y": np.repeat(np.arange(128), 128), "v": a.ravel()}) for k, a in imgs.items()])
    t = analyse_folders(spark.createDataFrame(px).selectExpr("image_id", "int(x) x", "int(y) y", "v"))
    r = t["interlayer"].toPandas().set_index("folder")
    ok, lone = r.loc["d/run_2.79x2.79"], r.loc["d/lone"]
    assert lone.reason == "missing__0_or__1" and lone["class"] == "unknown"
    assert ok["class"] == "slip" and ok.n0 >= 55 and ok.sideA_A == pytest.approx(27.9)
    assert abs(abs(ok.shift_px_x) - 8) <= 1 and abs(abs(ok.shift_px_y) - 4) <= 1
    assert TB.csv_frame(t["stacking"], TB.STACKING_COLUMNS).count() == 2
