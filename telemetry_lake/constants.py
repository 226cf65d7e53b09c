"""Fixed values that must equal the behaviour being reproduced.

Everything in this module is a fixed value: event vocabulary, the anomaly
rule, the governed function's contract, the two SQL-token lists, the
customer-mention pattern, and the wording of verdicts, trace steps and the
grounded answer.  Keep them here, in one place, in natural order.
"""

# --- fixed values: event vocabulary and anomaly rule -----------------------
VALID_EVENT_TYPES = ("click", "purchase", "search", "error")
ANOMALY_SIGMA = 3.0

# --- fixed values: the governed function -----------------------------------
SCORE_FUNCTION = "get_customer_anomaly_score"
SCORE_FUNCTION_DESCRIPTION = "Event and anomaly counts of one customer, and the share of anomalous events in percent."
SCORE_PARAMETER = "target_id"
SCORE_PARAMETER_PATTERN = r"CUST_\d{3}"
SCORE_PARAMETER_DESCRIPTION = "The id of the customer: CUST_ and three digits."

# --- fixed values: SQL-token lists (decision D13: two different lists) ------
# Boundary list, applied to every string parameter value.
BOUNDARY_SQL_WORDS = (
    "select", "insert", "update", "delete", "drop", "alter", "create", "truncate",
    "grant", "revoke", "union", "exec", "execute",
)
BOUNDARY_SQL_SYMBOLS = ("--", ";", "/*")
# Prompt list, applied to the raw prompt text (records, never blocks).
PROMPT_SQL_WORDS = (
    "select", "insert", "update", "delete", "drop", "alter", "create", "truncate",
    "grant", "revoke",
)

# --- fixed values: customer mention in a prompt -----------------------------
# First match wins; any case; optional "_", "-" or whitespace separator.
CUSTOMER_MENTION_PATTERN = r"\bCUST[_\-\s]?(\d{3})\b"
CUSTOMER_ID_PREFIX = "CUST_"

# --- fixed values: governance controls --------------------------------------
CONTROL_GRANT = "FUNCTION_GRANT"
CONTROL_SQL = "SQL_INTERDICTION"
CONTROL_SCHEMA = "PARAMETER_SCHEMA"

# --- fixed values: verdict bands (risk >= 50, risk > 0, otherwise) ----------
VERDICT_HIGH_RISK = 50.0
VERDICT_HIGH = "materially anomalous and warrants investigation"
VERDICT_SOME = "showing intermittent anomalous behaviour"
VERDICT_NONE = "operating within the expected performance envelope"

# --- fixed values: trace step names and statuses ----------------------------
STEP_INTENT = "Intent Resolution"
STEP_SANITISE = "Prompt Sanitisation"
STEP_BOUNDARY = "Governance Boundary Check"
STEP_BLOCKED = "Execution"
STEP_EXECUTE = "Lakehouse Execution"
STEP_SYNTHESIS = "Insight Synthesis"
STATUS_SUCCESS = "Success"
STATUS_NO_MATCH = "No Match"
STATUS_NEUTRALISED = "Neutralised"
STATUS_GRANTED = "Granted"
STATUS_DENIED = "Denied"
STATUS_BLOCKED = "Blocked"
STATUS_COMPLETED = "Completed"

# --- fixed values: outcome of a routed prompt -------------------------------
OUTCOME_SUCCESS = "SUCCESS"
OUTCOME_REFUSED = "REFUSED"
SERVING_MODE = "local-deterministic-planner"

# --- fixed values: grounded answer format -----------------------------------
ANSWER_FORMAT = (
    "Customer %s is %s. Across %,d observed events, %,d exceeded the anomaly threshold "
    "of %.1f ms, giving a risk factor of %.2f (percentage of traffic classified anomalous). "
    "Mean latency is %.2f ms against a fleet baseline of %.2f ms — %.1fx the population average."
)
UNKNOWN_CUSTOMER_ANSWER = (
    "The governed function executed successfully but returned no rows — that customer "
    "identifier has no events in the gold layer. No inference is available for an entity "
    "the lakehouse has not observed."
)
REFUSAL_FORMAT = "This request was refused at the governance boundary.\n\n**Control:** `%s`\n\n**Reason:** %s"

# --- fixed values: messages of decisions and trace steps ---------------------
MISSING_PARAMETER_FORMAT = "Required parameter '%s' was not supplied."
NOT_A_STRING_FORMAT = "parameter '%s' must be a string, received %s"
PATTERN_MISMATCH_FORMAT = "parameter '%s' value %s does not satisfy the declared pattern %s"
UNDECLARED_FORMAT = "Undeclared parameters rejected: %s."
GRANTED_FORMAT = "EXECUTE granted on %s; arguments conform to the declared schema and are bound as parameters."
MATCH_FORMAT = ("Query names customer %s and requests behavioural assessment; "
                "matched to the anomaly scoring function.")
NO_MATCH_FORMAT = "No granted function satisfies this intent. The agent holds EXECUTE on ['%s'] only."
BLOCKED_DETAIL = "No statement was submitted to the lakehouse."
INVOKED_FORMAT = "Invoked %s.%s with bound parameter target_id='%s'. Returned %d row(s) from the gold layer."

# Other messages, in this library's own words.
NO_GRANT_FORMAT = "No EXECUTE grant for %s; the functions registered in %s are %s."
SQL_TOKENS_FORMAT = "Parameter '%s' contains SQL control tokens; only values may be supplied to approved functions."
NOT_AN_OBJECT = "Parameters must be a JSON object with unique keys."
SANITISED_DETAIL = ("Input contained SQL control tokens; only typed parameter values were extracted, "
                    "so the text never reached the engine.")
SYNTHESIS_DETAIL = "Answer composed only from the returned rows and the fleet baseline."

# Default namespace for governed objects; a deployment passes its own.
DEFAULT_NAMESPACE = "main.telemetry"
