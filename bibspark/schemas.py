"""Record kinds, sources, priorities and the typed schemas of the engine.

The small dimension tables here have a fixed, proven size (a handful of
rows), so they are the only frames this package ever broadcasts without a
size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- Fixed values that must equal the reference (record kinds, sources,
# priorities, message names, configuration defaults) -----------------------
CLASS_CONFERENCE = 1040
CLASS_JOURNAL = 1030
CLASS_JOURNAL_SINGLE = 1031
CLASS_AUTHOR = 1000
CLASS_PUB = 1010
CLASS_VERSION = 1011
CLASS_CIT = 1020

VARIANT_SCHOLAR = 50
VARIANT_DBLP = 100
VARIANT_CORE = 150
VARIANT_SCIMAGO = 200

PRIO_INTERFACE_REQ = 100
PRIO_ENTITY_SERIAL = 30
PRIO_ENTITY_PACKAGE = 31
PRIO_ENTITY_SEND = 10
PRIO_JOURNAL = 102
PRIO_CONFERENCE = 102
PRIO_PUB = 101
PRIO_AUTHOR = 102

MSG_SERIALIZE_DATA = "serializeJsonData"
MSG_SERIALIZE_ENTITY = "serializeEntity"
MSG_PACKAGE_ENTITY = "validateEntity"
MSG_SEND_ENTITY = "sendEntity"
MSG_SCHOLAR_AUTHOR = "ScholarAuthor"
MSG_DBLP_AUTHOR = "DblpAuthor"
MSG_SCIMAGO_JOURNAL = "ScimagoJournal"
MSG_CORE_CONFERENCE = "CoreConference"
MSG_FETCH_SCHOLAR = "FetchScholarlyData"
MSG_FETCH_DBLP = "FetchDblpData"
MSG_FETCH_SCIMAGO = "FetchScimagoData"

IFACE_SCHOLAR = "google_scholar"
IFACE_DBLP = "dblp"
IFACE_SCIMAGO = "scimago"
IFACE_CORE = "core_edu"

DEPTH_MAX = 4
MIN_SECONDS_BETWEEN_UPDATES = 2592000
CORE_PAGES_NUMBER = 45
FAVORED_ORG = "pisa,cnr"
FIRST_SEED_YEAR = 1999
# --- end of fixed values ----------------------------------------------------

INTERFACES = [
    # iface, variant_id, seed message type, seed phase, seed priority, seed kind
    (IFACE_SCHOLAR, VARIANT_SCHOLAR, MSG_SCHOLAR_AUTHOR, CLASS_AUTHOR, PRIO_AUTHOR, "authors"),
    (IFACE_DBLP, VARIANT_DBLP, MSG_DBLP_AUTHOR, CLASS_PUB, PRIO_PUB, "authors"),
    (IFACE_SCIMAGO, VARIANT_SCIMAGO, MSG_SCIMAGO_JOURNAL, CLASS_JOURNAL, PRIO_JOURNAL, "years"),
    (IFACE_CORE, VARIANT_CORE, MSG_CORE_CONFERENCE, CLASS_CONFERENCE, PRIO_CONFERENCE, "pages"),
]

# Phase -> name.
PHASES = [
    (CLASS_AUTHOR, "AUTHOR"),
    (CLASS_PUB, "PUB"),
    (CLASS_VERSION, "VERSION"),
    (CLASS_CIT, "CIT"),
    (CLASS_JOURNAL, "JOURNAL"),
    (CLASS_JOURNAL_SINGLE, "JOURNAL_SINGLE"),
    (CLASS_CONFERENCE, "CONFERENCE"),
]

# (iface, phase) whose work items keep their parent's depth (fixed values).
ROLL_OVER = {
    (IFACE_SCHOLAR, CLASS_AUTHOR): False,
    (IFACE_SCHOLAR, CLASS_PUB): True,
    (IFACE_SCHOLAR, CLASS_CIT): True,
    (IFACE_SCHOLAR, CLASS_VERSION): True,
    (IFACE_DBLP, CLASS_PUB): False,
    (IFACE_SCIMAGO, CLASS_JOURNAL): True,
    (IFACE_CORE, CLASS_CONFERENCE): False,
}

INTERFACE_SCHEMA = T.StructType([
    T.StructField("iface", T.StringType(), False),
    T.StructField("variant_id", T.IntegerType(), False),
    T.StructField("seed_message_type", T.StringType(), False),
    T.StructField("seed_phase", T.IntegerType(), False),
    T.StructField("seed_priority", T.IntegerType(), False),
    T.StructField("seed_kind", T.StringType(), False),
])

PHASE_SCHEMA = T.StructType([
    T.StructField("phase_ref", T.IntegerType(), False),
    T.StructField("phase_name", T.StringType(), False),
])

WORK_ITEM_SCHEMA = T.StructType([
    T.StructField("iface", T.StringType()),
    T.StructField("phase_ref", T.IntegerType()),
    T.StructField("expected_id", T.StringType()),
    T.StructField("params", T.ArrayType(T.StringType())),
    T.StructField("message_type", T.StringType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("system_message", T.BooleanType()),
    T.StructField("roll_over", T.BooleanType()),
    T.StructField("ts", T.TimestampType()),
])

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("entity_db", T.StringType()),
    T.StructField("_id", T.StringType()),
    T.StructField("_rev", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("update_date", T.TimestampType()),
    T.StructField("update_count", T.IntegerType()),
    T.StructField("serialized", T.BooleanType()),
    T.StructField("sent", T.BooleanType()),
    T.StructField("class_id", T.IntegerType()),
    T.StructField("variant_id", T.IntegerType()),
    T.StructField("multi_result", T.BooleanType()),
    T.StructField("payload", T.StringType()),
])

MESSAGE_SCHEMA = T.StructType([
    T.StructField("message_type", T.StringType()),
    T.StructField("message_id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])


def interfaces(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INTERFACES, INTERFACE_SCHEMA)


def phases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PHASES, PHASE_SCHEMA)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """Typed empty frame (get-or-create of a store that does not exist yet)."""
    return spark.createDataFrame([], schema)
