"""Declarative data-quality expectations: drop, fail, warn, report, quarantine.

An expectation is a named SQL predicate plus an action.  A NULL predicate
result counts as a violation (decision D2), so every rule is evaluated as
``coalesce(predicate, false)``.

* ``drop``  rows that violate are removed (and can be routed to quarantine)
* ``fail``  the first violating row aborts the job that evaluates it
* ``warn``  rows are kept; violations only show in the report / metrics

The fail action is a ``raise_error`` inside a *kept* filter.  As an extra
column it would be pruned away and never fire, and ``limit`` short-circuits
it, so fail rules are enforced where every row is evaluated: the table write.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..constants import VALID_EVENT_TYPES
from ..functions.expressions import col_or_expr

ACTIONS = ("drop", "fail", "warn")


@dataclass(frozen=True)
class Expectation:
    name: str
    predicate: str
    action: str = "drop"

    def __post_init__(self):
        if self.action not in ACTIONS:
            raise ValueError(f"unknown expectation action {self.action!r}; use one of {ACTIONS}")

    def ok(self) -> Column:
        return F.coalesce(col_or_expr(self.predicate), F.lit(False))

    def with_action(self, action: str) -> "Expectation":
        return Expectation(self.name, self.predicate, action)


def expect_or_drop(name: str, predicate: str) -> Expectation:
    return Expectation(name, predicate, "drop")


def expect_or_fail(name: str, predicate: str) -> Expectation:
    return Expectation(name, predicate, "fail")


def expect(name: str, predicate: str) -> Expectation:
    return Expectation(name, predicate, "warn")


_TYPES = ", ".join(f"'{t}'" for t in VALID_EVENT_TYPES)
# The two rules of the silver layer.  Batch default is "drop" for both
# (decision D1); the streaming declaration makes the event-type rule "fail".
SILVER_RULES = (
    expect_or_drop("valid_customer_id", "customer_id IS NOT NULL"),
    expect_or_drop("valid_event_type", f"event_type IN ({_TYPES})"),
)
# The streaming declaration that stops on an unknown event type.
STRICT_SILVER_RULES = (SILVER_RULES[0], SILVER_RULES[1].with_action("fail"))


def _failure_check(rule: Expectation) -> Column:
    message = F.lit(f"expectation '{rule.name}' failed: {rule.predicate}")
    return F.when(rule.ok(), F.lit(True)).otherwise(F.raise_error(message))


def apply_expectations(df: DataFrame, rules=SILVER_RULES) -> DataFrame:
    """Enforce rules in one filter: drop rules remove rows, fail rules raise.

    A drop rule enters the filter as its bare predicate: a WHERE keeps only
    rows where the conjunction is TRUE, so NULL already counts as a
    violation, and the bare form (``IN``, ``IS NOT NULL``, comparisons) is
    what the scan can take as pushed filters.
    """
    cond = None
    for rule in rules:
        term = (col_or_expr(rule.predicate) if rule.action == "drop"
                else _failure_check(rule) if rule.action == "fail" else None)
        if term is not None:
            cond = term if cond is None else cond & term
    return df if cond is None else df.where(cond)


def failed_rules(rules) -> Column:
    """array<string> of the rule names a row violates (in declaration order)."""
    names = [F.when(~rule.ok(), F.lit(rule.name)) for rule in rules]
    return F.filter(F.array(*names), lambda x: x.isNotNull())


def quarantine(df: DataFrame, rules=SILVER_RULES) -> DataFrame:
    """Rows violating at least one rule, with ``failed_rules``; nothing is lost silently."""
    return (df.withColumn("failed_rules", failed_rules(rules))
              .where(F.size("failed_rules") > 0))


def expectation_report(df: DataFrame, rules=SILVER_RULES) -> DataFrame:
    """One row per rule: rule, action, rows_checked, violations.

    One pass over the data: every rule is a ``count_if`` in the same
    aggregate (partial per task, merged once), then unpivoted as an array of structs.
    """
    aggs = [F.count(F.lit(1)).alias("rows_checked")]
    aggs += [F.count_if(~rule.ok()).alias(f"v{i}") for i, rule in enumerate(rules)]
    counts = df.agg(*aggs)
    if not rules:
        return counts.select(F.lit("").alias("rule"), F.lit("").alias("action"), "rows_checked",
                             F.lit(0).cast("long").alias("violations")).where(F.lit(False))
    each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"),
                              F.col(f"v{i}").alias("violations")) for i, r in enumerate(rules)])
    return counts.select("rows_checked", F.inline(each)).select("rule", "action", "rows_checked", "violations")


def observe_violations(df: DataFrame, rules=SILVER_RULES, name: str = "expectations"):
    """Attach violation counters that are filled by whatever action runs ``df``.

    Returns ``(observed_df, observation)``; ``observation.get`` after the
    write gives ``{"rows": n, "<rule>": violations, ...}`` without a second scan.
    A streaming DataFrame is observed by name instead (``observation`` is
    ``None``): each micro-batch reports its counts in the query progress.
    """
    metrics = [F.count(F.lit(1)).alias("rows")]
    metrics += [F.count_if(~rule.ok()).alias(rule.name) for rule in rules]
    if df.isStreaming:
        return df.observe(name, *metrics), None
    obs = Observation(name)
    return df.observe(obs, *metrics), obs
