"""A study is resumed, and sessions that fail are rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from flockwise.plans import em as EM
from flockwise.plans import study as SY
from flockwise.session import scratch_path


def test_resume_and_error_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for f, n in ((1, 60), (2, 60), (3, 12)):
        rows.append(pd.DataFrame({"fit_id": f, "event_id": np.arange(n) + 100 * f, "t": np.sort(rng.uniform(0, 60, n)), "actor": rng.integers(0, 3, n), "mark": rng.integers(0, 2, n)}))
    events = spark.createDataFrame(pd.concat(rows))
    sessions = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "b")], "fit_id long, condition string")
    path, shape = scratch_path(spark, "study"), SY.Shape(3, 2, 6.0, 60.0)
    calls = []
    real = SY.scorers

    def counted(*a):
        return {m: (lambda e, s, m=m, f=f: calls.append(m) or f(e, s)) for m, f in real(*a).items()}

    monkeypatch.setattr(SY, "scorers", counted)
    quick = EM.with_settings(EM.REAL_DATA, max_iters=2)
    first = SY.run_study(sessions.where("fit_id <> 2"), events, path, shape, quick, ("b2",)).collect()
    assert {(r.fit_id, r.status, r.attempt) for r in first} == {(1, "ok", 1), (3, "error", 1), (4, "error", 1)}
    got = {(r.fit_id, r.method): r for r in SY.run_study(sessions, events, path, shape, quick, ("b2", "proposed", "b3"), matrix_iters=2).collect()}
    assert len(got) == 12 and calls == ["b2", "b2", "proposed", "b3"]
    assert all((r.status == "ok") == (r.fit_id in (1, 2)) for r in got.values())
    assert {k[0]: got[k].attempt for k in got if k[1] == "b2"} == {1: 1, 2: 1, 3: 2, 4: 2}
    assert got[3, "b2"].message.startswith("fewer than 10 events") and got[4, "b3"].message == "no events inside the model"
    assert np.isfinite(got[1, "proposed"].nll_per_event) and got[2, "b3"].condition == "b"
    again = SY.run_study(sessions.where("fit_id < 3"), events, path, shape, quick, ("b2", "proposed", "b3"))
    assert calls == ["b2", "b2", "proposed", "b3"] and again.count() == 12
    table = {r.method: r for r in SY.summary(again).collect()}
    assert table["b2"].n_ok == 2 and table["b2"].n_error == 2 and table["b3"].nll_per_event_count == 2
