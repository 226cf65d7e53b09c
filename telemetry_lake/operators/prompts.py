"""Route a table of plain-language prompts to governed calls and answers.

Per prompt row: resolve intent (first customer mention), flag SQL words,
check the proposed call at the governance boundary, execute allowed calls
as a join with the scored gold table, and ground the answer in the returned
numbers and the fleet baseline.  The ordered trace is an array column.

One Catalyst plan: expressions, a join with the registry, one equi-join
with the scores (AQE picks broadcast or skew-split sort-merge from runtime
sizes), and the one-row fleet baseline as a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (ANSWER_FORMAT, BLOCKED_DETAIL, CUSTOMER_ID_PREFIX, CUSTOMER_MENTION_PATTERN,
                         DEFAULT_NAMESPACE, INVOKED_FORMAT, MATCH_FORMAT, NO_MATCH_FORMAT, OUTCOME_REFUSED, OUTCOME_SUCCESS, PROMPT_SQL_WORDS, REFUSAL_FORMAT, SANITISED_DETAIL, SCORE_FUNCTION,
                         SCORE_PARAMETER, SERVING_MODE, STATUS_BLOCKED, STATUS_COMPLETED, STATUS_DENIED,
                         STATUS_GRANTED, STATUS_NEUTRALISED, STATUS_NO_MATCH, STATUS_SUCCESS, STEP_BLOCKED,
                         STEP_BOUNDARY, STEP_EXECUTE, STEP_INTENT, STEP_SANITISE, STEP_SYNTHESIS, SYNTHESIS_DETAIL,
                         UNKNOWN_CUSTOMER_ANSWER, VERDICT_HIGH, VERDICT_HIGH_RISK, VERDICT_NONE, VERDICT_SOME)
from ..functions.expressions import present2, sql_token_regex
from . import analytics, governance

MENTION_REGEX = "(?iU)" + CUSTOMER_MENTION_PATTERN
PROMPT_SQL_REGEX = sql_token_regex(PROMPT_SQL_WORDS)


def resolve_intents(prompts: DataFrame, prompt_col: str = "prompt") -> DataFrame:
    """Add ``target_id``, proposed ``function``/``params_json``, ``rationale``
    and the ``has_sql`` flag (AGT-1, AGT-2)."""
    p = F.col(prompt_col)
    digits = F.regexp_extract(p, MENTION_REGEX, 1)
    target = F.when(F.regexp_like(p, F.lit(MENTION_REGEX)), F.concat(F.lit(CUSTOMER_ID_PREFIX), digits))
    found = F.col("target_id").isNotNull()
    return (prompts
            .withColumn("target_id", target)
            .withColumns({
                "function": F.when(found, F.lit(SCORE_FUNCTION)),
                "params_json": F.when(found, F.to_json(F.struct(F.col("target_id").alias(SCORE_PARAMETER))))
                                .otherwise(F.lit("{}")),
                "rationale": F.when(found, F.format_string(MATCH_FORMAT, F.col("target_id")))
                    .otherwise(F.lit(NO_MATCH_FORMAT % SCORE_FUNCTION)),
                "has_sql": F.coalesce(F.regexp_like(p, F.lit(PROMPT_SQL_REGEX)), F.lit(False)),
            }))


def verdict(risk: Column) -> Column:
    return (F.when(risk >= VERDICT_HIGH_RISK, F.lit(VERDICT_HIGH))
             .when(risk > 0, F.lit(VERDICT_SOME))
             .otherwise(F.lit(VERDICT_NONE)))


def _step(step: str, status: Column | str, detail: Column | str) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(F.lit(step).alias("step"), lit(status).alias("status"), lit(detail).alias("detail"))


def route(prompts: DataFrame, gold_df: DataFrame, fleet: DataFrame, registry: DataFrame, *,
          prompt_col: str = "prompt", namespace: str = DEFAULT_NAMESPACE) -> DataFrame:
    """Full routing: intents -> decisions -> governed lookups -> answers + trace.

    ``fleet`` is the one-row fleet summary (rounded mean and threshold).
    """
    intents = resolve_intents(prompts, prompt_col)
    decided = governance.decide(intents, registry, namespace=namespace)

    scored = analytics.scores(gold_df).select(
        F.col("customer_id").alias("_cid"), "total_events", "total_anomalies",
        present2(F.col("mean_latency_ms")).alias("mean_latency_ms"), "risk_factor")
    # Refused prompts look nothing up.  A NULL key would send all of them to
    # one shuffle partition when gold is too large to broadcast; instead they
    # get a key no customer id can equal (leading NUL) made from a hash of the
    # whole input row, so only fully identical rows share a partition.
    row_key = F.concat(F.lit("\u0000"), F.xxhash64(*[F.col(c) for c in prompts.columns]).cast("string"))
    lookup = F.when(F.col("allowed") & F.col("target_id").isNotNull(), F.col("target_id")).otherwise(row_key)
    joined = (decided.withColumn("_lookup", lookup)
                     .join(scored, F.col("_lookup") == F.col("_cid"), "left"))

    ctx = fleet.select(F.struct(F.col("mean_latency_ms").alias("m"),
                                F.col("anomaly_threshold_ms").alias("t"))).scalar()
    fleet_mean = F.coalesce(ctx["m"], F.lit(0.0))
    fleet_threshold = F.coalesce(ctx["t"], F.lit(0.0))

    executed = F.col("allowed")
    found = F.col("_cid").isNotNull()
    ratio = F.when(fleet_mean != 0, F.col("mean_latency_ms") / fleet_mean).otherwise(F.lit(0.0))
    band = F.when(found, verdict(F.col("risk_factor")))
    answer = (F.when(~executed, F.format_string(REFUSAL_FORMAT, F.col("control"), F.col("detail")))
               .when(~found, F.lit(UNKNOWN_CUSTOMER_ANSWER))
               .otherwise(F.format_string(ANSWER_FORMAT, F.col("_cid"), band, F.col("total_events"),
                                          F.col("total_anomalies"), fleet_threshold, F.col("risk_factor"),
                                          F.col("mean_latency_ms"), fleet_mean, ratio)))
    rows_returned = F.when(found, F.lit(1)).otherwise(F.lit(0))
    trace = F.filter(F.array(
        _step(STEP_INTENT, F.when(F.col("function").isNotNull(), F.lit(STATUS_SUCCESS))
                            .otherwise(F.lit(STATUS_NO_MATCH)), F.col("rationale")),
        F.when(F.col("has_sql"), _step(STEP_SANITISE, STATUS_NEUTRALISED, SANITISED_DETAIL)),
        _step(STEP_BOUNDARY, F.when(executed, F.lit(STATUS_GRANTED)).otherwise(F.lit(STATUS_DENIED)),
              F.col("detail")),
        F.when(~executed, _step(STEP_BLOCKED, STATUS_BLOCKED, BLOCKED_DETAIL)),
        F.when(executed, _step(STEP_EXECUTE, STATUS_COMPLETED, F.format_string(
            INVOKED_FORMAT, F.lit(namespace), F.lit(SCORE_FUNCTION), F.col("target_id"), rows_returned))),
        F.when(executed, _step(STEP_SYNTHESIS, STATUS_COMPLETED,
               SYNTHESIS_DETAIL)),
    ), lambda s: s.isNotNull())

    payload = F.when(found, F.struct(F.col("_cid").alias("customer_id"), "total_events", "total_anomalies",
                                     "mean_latency_ms", "risk_factor"))
    keep = [c for c in prompts.columns]
    return joined.select(
        *keep, "target_id", "function", F.col("params_json").alias("parameters"), "has_sql", "allowed", "control", "detail",
        executed.alias("executed"),
        F.when(executed, F.lit(OUTCOME_SUCCESS)).otherwise(F.lit(OUTCOME_REFUSED)).alias("status"),
        band.alias("verdict"),
        F.col("total_events"), F.col("total_anomalies"), F.col("mean_latency_ms"), F.col("risk_factor"),
        F.when(found, ratio).alias("latency_ratio"),
        fleet_mean.alias("fleet_mean_latency_ms"), fleet_threshold.alias("fleet_threshold_ms"),
        payload.alias("payload"), answer.alias("answer"), trace.alias("trace"),
        F.lit(SERVING_MODE).alias("serving_mode"),
    )
