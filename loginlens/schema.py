"""Column names, types and fixed values of the logon and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

# The successful-logon event code and the raw column order of the CSV export.
LOGON_EVENT_CODE = 4624
RAW_NAMES = ["Event_ID", "Host", "Time", "Logon_ID", "User", "Source", "Source_Port", "Logon_Type"]

LOGON_SCHEMA = T.StructType(
    [
        T.StructField("event_code", T.IntegerType()),
        T.StructField("host", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("logon_id", T.LongType()),
        T.StructField("account", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_port", T.IntegerType()),
        T.StructField("logon_type", T.IntegerType()),
    ]
)
LOGON_COLUMNS = LOGON_SCHEMA.fieldNames()
DEDUP_COLUMNS = [c for c in LOGON_COLUMNS if c != "logon_id"]

VIEWS = {"user": "account", "host": "host", "source": "source"}

# The two distinct counts of each view, as (feature name, counted column).
VIEW_COUNTS = {
    "host": [("Users_per_Host", "account"), ("Sources_per_Host", "source")],
    "user": [("Hosts_per_User", "host"), ("Sources_per_User", "source")],
    "source": [("Users_per_Source", "account"), ("Hosts_per_Source", "host")],
}

# The logon types of the proportion features.
PROPORTION_SETS = [(2,), (3,), (9,), (10,), (11, 12)]

# Fixed pattern: the column names a stored feature table may have.
FEATURE_NAME_PATTERN = (
    "weekday|number_events|proportion_[0-9_]+|hour|day|events_per_second|Identifier|Users_per_Host|"
    "Users_per_Source|Hosts_per_User|Hosts_per_Source|Sources_per_User|Sources_per_Host"
)

KEY = ["entity", "bin"]
TIME_FEATURES = ["weekday", "day", "hour"]
GROUP = "group_id"
RESULT_COLUMNS = ["scores", "anomaly"]

# Fixed value: day numbers handed to the detectors count from this date.
DAY_ZERO = "1900-01-01"


def view_column(view: str) -> str:
    if view not in VIEWS:
        raise ValueError(f"view must be one of {sorted(VIEWS)}, not {view!r}")
    return VIEWS[view]


def numeric_features(df: DataFrame) -> list[str]:
    """The behaviour features of a feature table: no keys, time, group or result columns."""
    skip = {*KEY, *TIME_FEATURES, GROUP, *RESULT_COLUMNS}
    return [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, T.NumericType)]


def model_columns(df: DataFrame) -> list[str]:
    """What a detector sees: time features, behaviour features, then the group number."""
    present = set(df.columns)
    tail = [GROUP] if GROUP in present else []
    return [c for c in TIME_FEATURES if c in present] + numeric_features(df) + tail


def as_model_value(df: DataFrame, name: str) -> Column:
    """A feature as the double a model is given; dates become days since 1900-01-01."""
    if isinstance(df.schema[name].dataType, T.DateType):
        return F.datediff(F.col(name), F.lit(DAY_ZERO).cast("date")).cast("double")
    return F.col(name).cast("double")


def with_field(schema: T.StructType, name: str, data_type: T.DataType) -> T.StructType:
    """The schema with one more field; ``StructType.add`` would change the frame's own schema."""
    return T.StructType([*schema.fields, T.StructField(name, data_type)])
