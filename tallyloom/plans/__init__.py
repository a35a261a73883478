"""The registered queries, grouped by the tables they read."""

from tallyloom.plans import event_plans, graph_plans, order_plans, stream_plans, text_plans
from tallyloom.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
