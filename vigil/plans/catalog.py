"""All registered queries (importing the query modules fills the registry)."""

from __future__ import annotations

from vigil.plans import q_alerts, q_hosts, q_logs, q_misc, q_rules, q_series, q_sources, q_streams  # noqa: F401
from vigil.plans.registry import ORACLES, QUERIES  # noqa: F401
from vigil.sources import fixtures as fx


def flagship(spark, sf_dir):
    from vigil.operators import hosts

    h = hosts.host_snapshot(fx.samples(spark, sf_dir), fx.EVAL_END_US)
    return hosts.host_list(h, sort="cpu_desc")
