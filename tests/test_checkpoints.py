"""Checkpoint names whose step has more than six digits."""

from layerframe.operators import keys as K


def test_long_steps_stay_whole(spark):
    files = spark.createDataFrame([(f"r1/model{s:06d}.pt",) for s in (7, 999999, 1000000, 23456789)] + [("r1/ema_0.9999_23456789.pt",), ("r2/model000012.pt",)], "path string")
    steps = {r.step: r.has_ema for r in K.resume_steps(files).collect()}
    assert steps == {7: False, 999999: False, 1000000: False, 23456789: True, 12: False}
    assert {(r.folder, r.step, r.path) for r in K.latest_checkpoint(files).collect()} == {("r1", 23456789, "r1/model23456789.pt"), ("r2", 12, "r2/model000012.pt")}
