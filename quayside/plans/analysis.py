"""The analysis: refuse stale results, then answer from the Gold tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..operators import answers
from ..operators.aggregates import AGGREGATE_BUILDERS
from ..operators.ledger import require_success
from ..operators.monitor import edge_months, monitor_summary
from ..sources.store import Store
from .full_run import RUNS


Gold = Mapping[str, DataFrame]


def _modes(gold: Gold) -> DataFrame:
    return gold["agg_ship_mode_performance"]


def _summary(gold: Gold) -> DataFrame:
    return gold["agg_on_time_summary"]


def _urgency(gold: Gold) -> DataFrame:
    return gold["agg_urgency_fulfillment"]


def _months(gold: Gold) -> DataFrame:
    return edge_months(gold["agg_delay_rate_monthly"])


# Every answer by name, each from the Gold aggregates it needs.
ANSWERS = {
    "q1_ship_mode": lambda gold: answers.q1_table(_modes(gold)),
    "q1_fastest": lambda gold: answers.q1_fastest(_modes(gold)),
    "q1_most_predictable": lambda gold: answers.q1_most_predictable(_modes(gold)),
    "q2_gap": lambda gold: answers.q2_gap(_summary(gold)),
    "q2_by_size": lambda gold: answers.q2_by_size(gold["agg_on_time_by_line_count"]),
    "q3_delay_rate": lambda gold: answers.q3_delay_rate(_modes(gold)),
    "q3_worst": lambda gold: answers.q3_worst(_modes(gold)),
    "q4_urgency": lambda gold: answers.q4_urgency(_urgency(gold)),
    "q4_priority": lambda gold: answers.q4_priority(gold["agg_priority_fulfillment"]),
    "q4_verdict": lambda gold: answers.q4_verdict(_urgency(gold)),
    "monitor_months": _months,
    "monitor_summary": lambda gold: monitor_summary(_months(gold)),
    "answers_text": lambda gold: answers.answers_text(
        _modes(gold), _summary(gold), _urgency(gold), _months(gold), monitor_summary(_months(gold))
    ),
}


def analyse(store: Store) -> dict[str, DataFrame]:
    """Answers of the newest run; raises when that run has not succeeded."""
    require_success(store.read("audit", RUNS) if store.exists("audit", RUNS) else None)
    gold = store.read_all("gold", AGGREGATE_BUILDERS)
    return {name: answer(gold) for name, answer in ANSWERS.items()}
