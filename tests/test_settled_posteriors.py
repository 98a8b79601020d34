"""Oracle posteriors: the same steps inside a chunk's task and across chunks, and few jobs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flockwise.operators import smoothing as SM
from flockwise.operators.history import layout
from flockwise.plans import diagnostics as D
from flockwise.plans import em as EM
from flockwise.session import cut_lineage


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(8)
    rows = []
    for f, n in ((1, 20), (2, 60), (3, 25)):
        t = np.sort(rng.uniform(0, 60, n))
        rows.append(pd.DataFrame({"fit_id": f, "event_id": np.arange(n) + 100 * f, "t": t, "actor": rng.integers(0, 3, n), "mark": rng.integers(0, 2, n)}))
    return spark.createDataFrame(pd.concat(rows))


def by_passes(lay, params, n, tol):
    """A job or more for each step, as before."""
    weights, post = EM.start_weights(lay, params, F.col("eta_on") / (F.col("eta_on") + F.col("eta_off"))), None
    for _ in range(n):
        new = cut_lineage(SM.estep(lay, params, weights))
        if post is not None:
            x = new.join(post.select("fit_id", "b", F.col("g1").alias("old")), ["fit_id", "b"]).agg(F.max(F.abs(F.col("g1") - F.col("old")))).first()[0]
            if x < tol:
                return new
        post, weights = new, new.select("fit_id", "b", F.col("g1").alias("w"), "g1")
    return post


def table(post):
    out = post.orderBy("fit_id", "b").toPandas()
    return out[["fit_id", "b", "g0", "g1", "loglik"]].astype(float), out["xi"]


@pytest.mark.parametrize("rows, tol", [(1000, 1e-2), (40, 1e-2), (1000, 0.0)])
def test_steps_inside_chunks_equal_passes(events, rows, tol):
    lay = layout(events, 3, 2, 6.0, 60.0, chunk_rows=rows)
    params = cut_lineage(EM.init_params(lay.events, 3, 2, 60.0, dt=6.0).withColumn("eta_on", F.lit(0.1)))
    (a, x), (b, y) = table(D.oracle_posterior(lay, params, 4, tol)), table(by_passes(lay, params, 4, tol))
    assert len(a) == 30
    np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-12)
    assert [v is None for v in x] == [v is None for v in y]
    np.testing.assert_allclose(np.stack(x.dropna().tolist()), np.stack(y.dropna().tolist()), rtol=1e-8, atol=1e-12)


def test_whole_fits_take_no_job_per_step(events, monkeypatch):
    """Before, each of up to 25 steps shuffled, joined and stored a posterior."""
    lay = layout(events, 3, 2, 6.0, 60.0, chunk_rows=1000)
    params = cut_lineage(EM.init_params(lay.events, 3, 2, 60.0, dt=6.0).drop("g", "h", "u", "v"))  # a posterior needs no gates
    monkeypatch.setattr(SM, "estep", lambda *a, **k: pytest.fail("a pass"))
    assert D.oracle_posterior(lay, params, 25, 0.0).count() == 30


def test_a_fit_without_events_keeps_its_rows(events):
    lay = layout(events, 3, 2, 6.0, 60.0, chunk_rows=1000)
    params = EM.init_params(lay.events, 3, 2, 60.0, dt=6.0)
    more = cut_lineage(params.unionByName(params.filter("fit_id = 1").withColumn("fit_id", F.lit(9).cast("long"))))
    found = D.oracle_posterior(lay, more, 2).groupBy("fit_id").count().collect()
    assert {r.fit_id: r["count"] for r in found} == {1: 10, 2: 10, 3: 10, 9: 10}
