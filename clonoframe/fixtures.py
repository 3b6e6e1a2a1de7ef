"""Views over the test tables that stand in for annotated receptor sequences; the same SQL runs on Spark and DuckDB."""

REPERTOIRE = """SELECT event_id AS sequence_id, event_type AS sample_id, user_id AS clone_id, CAST(1+event_id%9 AS INT) AS duplicate_count,
 concat('Homsap IGHV',CAST(1+user_id%7 AS STRING),'-',CAST(1+event_id%40 AS STRING), CASE WHEN event_id%3=0 THEN 'D' ELSE '' END,
   '*0',CAST(1+event_id%4 AS STRING),' F', CASE WHEN event_id%5=0 THEN concat(',Homsap IGHV',CAST(1+user_id%7 AS STRING),'-',
   CAST(2+event_id%40 AS STRING),'*01 F') ELSE '' END) AS v_call,
 concat('Homsap IGHJ',CAST(1+user_id%6 AS STRING),'*01 F') AS j_call,
 translate(substr(md5(CAST(event_id AS STRING)),1,30),'0123456789abcdef','ACGTACGTACGTACGT') AS junction FROM events"""
CLONES = """SELECT event_id AS sequence_id, event_type AS sample_id, CASE WHEN event_id%3=0 THEN event_id%17 WHEN event_id%3=1
 THEN 100+event_id%211 ELSE 1000+event_id%4001 END AS clone_id FROM events"""
ALIGNED = """SELECT event_id AS sequence_id, user_id AS clone_id, concat(substr(t,1,CAST(event_id%28 AS INT)), substr('ACGTN-.',CAST(1+event_id%7 AS INT),1),
 substr(t,CAST(2+event_id%28 AS INT))) AS sequence_alignment, t AS germline_alignment FROM (SELECT event_id,user_id,
 translate(substr(md5(CAST(user_id AS STRING)),1,30),'0123456789abcdef','ACGTACGTACGTACGT') t FROM events) x"""
TREES = """SELECT tree_id, CASE WHEN rn=1 THEN 'Germline' ELSE concat('S',CAST(CAST(floor(rn/2) AS INT) AS STRING)) END AS from_v,
 concat('S',CAST(rn AS STRING)) AS to_v, CAST(1+event_id%5 AS DOUBLE) AS weight, sample_id FROM (SELECT user_id%50 AS tree_id, event_id,
 event_type AS sample_id, row_number() OVER (PARTITION BY user_id%50 ORDER BY event_id) rn FROM events) x"""


def view(spark, sf_dir: str, sql: str):
    """A view's DataFrame over sf_dir's events."""
    return spark.sql(sql.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
