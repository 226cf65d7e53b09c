"""The governance boundary, evaluated for a whole table of proposed calls.

Input rows: ``(call_id, function, params_json)``, or stored calls (``store_calls``).  Output adds ``allowed``,
``control`` and ``detail``.  Controls, first match wins (code order, D12):

1. FUNCTION_GRANT    function NULL, empty or not in the registry
2. PARAMETER_SCHEMA  parameters are not a JSON object (NULL means ``{}``)
3. SQL_INTERDICTION  any string value holds a SQL token; the first key in
                     the caller's order is reported
4. PARAMETER_SCHEMA  per declared parameter, in declaration order: required
                     but missing; not a string; pattern not fully matched
5. PARAMETER_SCHEMA  undeclared parameters (sorted list)
6. allowed           reported under FUNCTION_GRANT

Everything is a column expression after one join with the registry.  Its rows
are counted first: up to ``BROADCAST_ROWS`` it is broadcast and the calls table
is not shuffled; a longer allowlist takes an ordinary join with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (BOUNDARY_SQL_SYMBOLS, BOUNDARY_SQL_WORDS, CONTROL_GRANT, CONTROL_SCHEMA,
                         CONTROL_SQL, DEFAULT_NAMESPACE, GRANTED_FORMAT, MISSING_PARAMETER_FORMAT, NO_GRANT_FORMAT,
                         NOT_A_STRING_FORMAT, NOT_AN_OBJECT, PATTERN_MISMATCH_FORMAT, SCORE_FUNCTION,
                         SCORE_FUNCTION_DESCRIPTION, SCORE_PARAMETER, SCORE_PARAMETER_DESCRIPTION,
                         SCORE_PARAMETER_PATTERN, SQL_TOKENS_FORMAT, UNDECLARED_FORMAT)
from ..functions.expressions import full_match, sql_token_regex
from ..schemas import REGISTRY

BROADCAST_ROWS = 50_000
BOUNDARY_SQL_REGEX = sql_token_regex(BOUNDARY_SQL_WORDS, BOUNDARY_SQL_SYMBOLS)

# The default allowlist: one function with one required parameter.
DEFAULT_REGISTRY = [
    (SCORE_FUNCTION, SCORE_FUNCTION_DESCRIPTION, 0, SCORE_PARAMETER, SCORE_PARAMETER_PATTERN, True,
     SCORE_PARAMETER_DESCRIPTION),
]


def registry_frame(spark: SparkSession, rows=None) -> DataFrame:
    """Registry as a DataFrame, one row per declared parameter."""
    return spark.createDataFrame(list(DEFAULT_REGISTRY if rows is None else rows), REGISTRY)


def _specs(registry: DataFrame) -> DataFrame:
    """One row per function with its parameter specs in declaration order."""
    spec = F.struct("position", "param", "pattern", "required")
    return (registry.groupBy("function")
                    .agg(F.array_sort(F.collect_list(spec)).alias("_spec"))
                    .withColumn("_registered", F.lit(True)))


def _py_repr(s: Column) -> Column:
    """Python-style repr of a string: its choice of quotes, backslashes and the common control characters escaped."""
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(raw), F.lit(shown))
    return (F.when(F.instr(s, "'") > 0, F.when(F.instr(s, '"') > 0, F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("\\'")), F.lit("'")))
                                         .otherwise(F.concat(F.lit('"'), s, F.lit('"'))))
             .otherwise(F.concat(F.lit("'"), s, F.lit("'"))))


def _py_type(variant_type: Column) -> Column:
    """Name of the Python type a JSON value would have."""
    return (F.when(variant_type.startswith("OBJECT"), F.lit("dict"))
             .when(variant_type.startswith("ARRAY"), F.lit("list"))
             .when(variant_type == "BOOLEAN", F.lit("bool"))
             .when(variant_type.isin("VOID"), F.lit("NoneType"))
             .when(variant_type.startswith("DECIMAL") | variant_type.isin("DOUBLE", "FLOAT"), F.lit("float"))
             .when(variant_type.isin("STRING"), F.lit("str"))
             .otherwise(F.lit("int")))


def _names_list(arr: Column) -> Column:
    """Render an array of names like Python's ``sorted(...)`` list."""
    return F.concat(F.lit("["), F.array_join(F.transform(arr, _py_repr), ", "),
                    F.lit("]"))


def _parsed(params_json: Column) -> tuple[Column, Column]:
    """(the parameters as VARIANT, their names in the caller's order); NULL means no parameters."""
    text = F.coalesce(params_json, F.lit("{}"))
    return F.try_parse_json(text), F.json_object_keys(text)


def store_calls(calls: DataFrame, path: str) -> None:
    """Append proposed calls with their parameters as VARIANT (SCL-12, SCL-14, GOV-4).

    Spark shreds the parameters into Parquet columns by the fields it meets, so a query of one parameter reads that column
    alone.  Objects lose the order of their keys, which a decision reports by, so the names are stored beside them.
    """
    params, keys = _parsed(F.col("params_json"))
    (calls.select("call_id", "function", params.alias("params"), keys.alias("param_keys"))
     .write.mode("append").parquet(path))


def stored_parameter(name: str) -> Column:
    """One parameter of stored calls as text; the scan reads nothing else of ``params``."""
    return F.try_variant_get(F.col("params"), f"$.{name}", "string")


def decide(calls: DataFrame, registry: DataFrame, *, namespace: str = DEFAULT_NAMESPACE,
           sql_regex: str = BOUNDARY_SQL_REGEX) -> DataFrame:
    """Add the decision columns ``allowed``, ``control``, ``detail``."""
    specs = _specs(registry)
    short = registry.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = calls.join(F.broadcast(specs) if short else specs, "function", "left")

    stored = "params_json" not in calls.columns  # calls read back from ``store_calls``
    parsed, keys = (F.col("params"), F.col("param_keys")) if stored else _parsed(F.col("params_json"))
    value_map = F.try_variant_get(parsed, "$", "map<string,variant>")

    def vtype(k: Column) -> Column:
        return F.schema_of_variant(F.try_element_at(F.col("_map"), k))

    def vstr(k: Column) -> Column:
        return F.variant_get(F.try_element_at(F.col("_map"), k), "$", "string")

    sql_key = F.try_element_at(
        F.filter(F.col("_keys"), lambda k: (vtype(k) == "STRING") & F.regexp_like(vstr(k), F.lit(sql_regex))),
        F.lit(1))

    def param_info(p: Column) -> Column:
        # Per declared parameter, looked up once per row: presence, the JSON
        # type of the supplied value and its text when it is a string.
        v = F.try_element_at(F.col("_map"), p["param"])
        return F.struct(p["param"].alias("param"), p["required"].alias("required"), p["pattern"].alias("pattern"),
                        F.map_contains_key(F.col("_map"), p["param"]).alias("present"),
                        F.schema_of_variant(v).alias("vt"), F.try_variant_get(v, "$", "string").alias("vs"))

    def param_error(i: Column) -> Column:
        name, value, vt = i["param"], i["vs"], i["vt"]
        return (F.when(~i["present"] & i["required"],
                       F.format_string(MISSING_PARAMETER_FORMAT, name))
                 .when(~i["present"], F.lit(None))
                 .when(vt != "STRING",
                       F.format_string(NOT_A_STRING_FORMAT, name, _py_type(vt)))
                 .when(~F.coalesce(full_match(value, i["pattern"]), F.lit(False)),
                       F.format_string(PATTERN_MISMATCH_FORMAT, name, _py_repr(value), _py_repr(i["pattern"]))))

    schema_error = F.try_element_at(F.filter(F.transform(F.col("_pinfo"), param_error), lambda e: e.isNotNull()),
                                    F.lit(1))
    undeclared = F.array_sort(F.array_except(F.col("_keys"), F.transform(F.col("_spec"), lambda p: p["param"])))
    registered = registry.agg(_names_list(F.array_sort(F.collect_set("function"))).alias("names")).scalar()
    qualified = F.concat(F.lit(namespace + "."), F.col("function"))

    denied_grant = F.col("_registered").isNull()
    not_object = F.col("_map").isNull()
    control = (F.when(denied_grant, F.lit(CONTROL_GRANT))
                .when(not_object, F.lit(CONTROL_SCHEMA))
                .when(F.col("_sql_key").isNotNull(), F.lit(CONTROL_SQL))
                .when(F.col("_schema_error").isNotNull(), F.lit(CONTROL_SCHEMA))
                .when(F.size("_undeclared") > 0, F.lit(CONTROL_SCHEMA))
                .otherwise(F.lit(CONTROL_GRANT)))
    allowed = (~denied_grant & ~not_object & F.col("_sql_key").isNull() & F.col("_schema_error").isNull()
               & (F.size("_undeclared") == 0))
    detail = (
        F.when(denied_grant, F.format_string(
            NO_GRANT_FORMAT, F.coalesce(_py_repr(F.col("function")), F.lit("None")), F.lit(namespace),
            registered))
         .when(not_object, F.lit(NOT_AN_OBJECT))
         .when(F.col("_sql_key").isNotNull(), F.format_string(SQL_TOKENS_FORMAT, F.col("_sql_key")))
         .when(F.col("_schema_error").isNotNull(), F.col("_schema_error"))
         .when(F.size("_undeclared") > 0, F.format_string(UNDECLARED_FORMAT, _names_list(F.col("_undeclared"))))
         .otherwise(F.format_string(GRANTED_FORMAT, qualified)))

    checked = F.col("_registered").isNotNull() & F.col("_map").isNotNull()
    staged = (joined
              .withColumn("_map", value_map)
              .withColumns({"_keys": F.when(F.col("_map").isNotNull(), keys),
                            "_pinfo": F.when(checked, F.transform(F.col("_spec"), param_info))})
              .withColumns({
                  "_sql_key": F.when(checked, sql_key),
                  "_schema_error": F.when(checked, schema_error),
                  "_undeclared": F.when(checked, undeclared).otherwise(F.array().cast("array<string>")),
              }))
    out_cols = [c for c in calls.columns]
    return staged.select(*out_cols, allowed.alias("allowed"), control.alias("control"), detail.alias("detail"))


def write_audit(decided: DataFrame, path: str, *, partition_col: str = "control") -> None:
    """Append decisions (or routed prompts) to the audit table (SNK-4).

    Append-only, partitioned by control so denied calls of one kind are read
    without scanning the rest; ``audited_at`` is the job's wall clock.
    """
    (decided.withColumn("audited_at", F.current_timestamp())
            .write.mode("append").partitionBy(partition_col).parquet(path))
