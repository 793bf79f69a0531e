"""Fixed values of the telemetry domain; functions take them as defaults of their parameters."""

from pyspark.sql import types as T

TELEMETRY = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("ts", T.DoubleType()), T.StructField("service", T.StringType()), T.StructField("version", T.StringType()),
    T.StructField("latency_ms", T.DoubleType()), T.StructField("error_rate", T.DoubleType()), T.StructField("cpu_pct", T.DoubleType()), T.StructField("mem_pct", T.DoubleType()), T.StructField("rps", T.DoubleType()),
    T.StructField("log", T.StringType()), T.StructField("incident_type", T.StringType()), T.StructField("label", T.IntegerType()),
])

SERVICES = ["checkout-api", "payments-worker", "search-api", "auth-api", "cart-api", "recommend-api"]
NORMAL = "normal"
#: In alphabetical order, which probabilities follow.
CLASSES = ["bad_deploy", "dependency_failure", "memory_leak", "normal", "traffic_spike"]
REMEDIATIONS = {"memory_leak": "restart", "dependency_failure": "failover", "traffic_spike": "scale_out", "bad_deploy": "rollback"}
ACTIONS = ["none", "restart", "failover", "scale_out", "rollback"]
COSTS = {"none": 0.0, "restart": 0.30, "failover": 0.35, "scale_out": 0.25, "rollback": 0.40}
RIGHT_EFFECT, WRONG_EFFECT = 0.75, -0.10
LATENCY_SLO, ERROR_SLO = 500.0, 0.05
BASELINE_S, SLOPE_S, NO_DEPLOY_S, WARM_UP_S = 900.0, 60.0, 3600.0, 60.0
FEATURES = ["latency_ms", "latency_over_baseline", "error_rate", "cpu_over_baseline", "mem_pct", "mem_slope_per_min", "rps_over_baseline", "since_deploy_s"]
#: What the anomaly detector sees.
ANOMALY_FEATURES = [f for f in FEATURES if f not in ("latency_ms", "since_deploy_s")]
ESCALATED_CLASSES = ["bad_deploy", "dependency_failure"]
TEMPORAL_SPLIT, TRAIN_CUT, CALIBRATE_CUT = 0.70, 0.55, 0.75
ALPHA = 0.05
PSI_BINS, PSI_FLOOR, PSI_LIMIT, MEDIAN_TOLERANCE, DRIFT_WINDOW = 10, 1e-4, 0.2, 0.25, 600
CANARY_FRACTION, CANARY_EVENTS, CANARY_TOLERANCE = 0.1, 200, 0.02
#: Log patterns in the order in which they are tried; the first that matches decides.
LOG_PATTERNS = [
    ("dependency_failure", r"upstream \S+ (?:timeout|503)|connection pool exhausted|retrying \("),
    ("bad_deploy", r"Exception in \w+\.\w+|returning 500"),
    ("memory_leak", r"GC pause|heap at \d+%|old-gen"),
    ("traffic_spike", r"queue depth|worker pool saturated|requests shed"),
]
