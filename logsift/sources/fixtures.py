"""Log-line and label fixtures derived from the driver's ``events`` table.

The SQL text is shared verbatim by the Spark side (``spark.sql`` with a
DataFrame argument, no global view) and the DuckDB oracle (``events`` view),
so both engines see identical input lines.  Every row of ``events`` becomes
one line; nothing is sampled.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed fixture definitions (shared with the oracle).
LOG_LINES_SQL = """
SELECT event_id AS line_no,
 CASE WHEN event_id % 101 = 2 THEN '   '
      WHEN event_id % 97 = 1 THEN 'malformed line ' || CAST(event_id AS STRING)
      ELSE (CASE WHEN event_id % 89 = 0 THEN '13' ELSE lpad(CAST(month(ts) AS STRING),2,'0') END) || lpad(CAST(day(ts) AS STRING),2,'0') || '24 '
        || lpad(CAST(hour(ts) AS STRING),2,'0') || lpad(CAST(minute(ts) AS STRING),2,'0') || lpad(CAST(second(ts) AS STRING),2,'0')
        || ' ' || CAST(event_id % 1500 AS STRING) || ' ' || (CASE WHEN event_type='error' THEN 'WARN' ELSE 'INFO' END)
        || ' dfs.' || (CASE WHEN event_type IN ('click','view') THEN 'DataNode$DataXceiver' WHEN event_type='signup' THEN 'DataNode$PacketResponder' ELSE 'FSNamesystem' END) || ': '
        || (CASE WHEN event_type='click' THEN 'Receiving block ' || blk || ' src: /10.0.' || k || '.1:50010 dest: /10.0.0.2:50010'
                 WHEN event_type='view' THEN 'Received block ' || blk || ' of size ' || k || '24 from /10.0.' || k || '.1'
                 WHEN event_type='error' THEN 'writeBlock ' || blk || ' received exception java.io.IOException: Connection reset by peer'
                 WHEN event_type='signup' THEN 'PacketResponder ' || CAST(event_id % 3 AS STRING) || ' for block ' || blk || ' terminating'
                 WHEN event_id % 7 = 0 THEN 'Roll Edit Log from 10.0.' || k || '.1'
                 ELSE 'Verification succeeded for ' || blk END) END AS value
FROM (SELECT *, (CASE WHEN user_id % 2 = 1 THEN 'blk_-' ELSE 'blk_' END) || CAST(user_id AS STRING) AS blk,
             regexp_extract(props,'([0-9]+)',1) AS k FROM {events}) e
"""

LABELS_SQL = """
SELECT (CASE WHEN user_id % 2 = 1 THEN 'blk_-' ELSE 'blk_' END) || CAST(user_id AS STRING) AS BlockId,
 CASE WHEN 4*sum(CASE WHEN event_type='error' THEN 1 ELSE 0 END) > count(*) THEN 'Anomaly' ELSE 'Normal' END AS Label
FROM {events} WHERE user_id % 25 <> 7 GROUP BY user_id
"""

# Stand-in template rule (fixed values) used until mined ids are wanted.
TEMPLATE_RULE_SQL = """CASE WHEN {m} LIKE 'Receiving block %' THEN 1 WHEN {m} LIKE 'Received block %' THEN 2
     WHEN {m} LIKE 'writeBlock %' THEN 3 WHEN {m} LIKE 'PacketResponder %' THEN 4
     WHEN {m} LIKE 'Verification succeeded %' THEN 5 ELSE 6 END"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def log_lines(spark: SparkSession, sf_dir: str, persist: bool = True) -> DataFrame:
    """DataFrame[line_no bigint, value string]: one derived log line per event.

    Persisted by default: the line text is the input of every log query, and
    materialising it keeps the fixture expression out of the parse stage's
    generated code (which would otherwise exceed the JVM method size limit)."""
    df = spark.sql(LOG_LINES_SQL, events=events(spark, sf_dir))
    return df.persist(StorageLevel.MEMORY_AND_DISK) if persist else df


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DataFrame[BlockId string, Label string] as a label CSV would hold it."""
    return spark.sql(LABELS_SQL, events=events(spark, sf_dir))


def fixture_template_id(message_col: str = "message"):
    return F.expr(TEMPLATE_RULE_SQL.format(m=f"`{message_col}`")).cast("int")


def oracle_lines_cte() -> str:
    """``WITH`` prefix for oracle SQL: ``lines`` (the fixture) over the events view."""
    return "lines AS (" + LOG_LINES_SQL.format(events="events") + ")"


def oracle_labels_cte() -> str:
    return "label_rows AS (" + LABELS_SQL.format(events="events") + ")"
