"""Drug classes of interventions."""

from __future__ import annotations

from spindrift.operators import axes
from spindrift.plans import classes
from spindrift.plans.projections import Data


def test_hits_of_interventions_are_made_once(spark):
    data = Data(spark, "/root/testdata/sf0.001")
    found = axes.match_interventions(classes.x(data, "interventions"), classes.x(data, "other"), classes.rules(data), classes.kinds(data))
    assert "LeftOuter" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() > 0
