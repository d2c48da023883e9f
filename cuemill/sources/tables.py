"""The derived timed-text tables: cues, speech, tracks, media, candidates, logs.

Each loader reads only the columns it needs from one parquet table and derives the rows with
column expressions, so the scan is pruned and nothing is shuffled (except the two views that
number or accumulate rows per key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.operators.ordered import Ordered
from cuemill.config import CHUNK_MS


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    """Documents as they are stored. A session can ask for more partitions than the files have row groups."""
    rows = load(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    wanted = spark.conf.get("spark.cuemill.documentPartitions", None)
    return rows.repartition(int(wanted)) if wanted else rows


def doc_cue(spark, sf_dir):
    return spark.sql(
        r"""select doc_id as track_id, lang, pos+1 as cue_ix,
        cast(pos*3000+(doc_id*131+(pos+1)*977)%2000 as bigint) as start_ms,
        cast(pos*3000+(doc_id*131+(pos+1)*977)%2000+500+(length(line)*30)%6000 as bigint) as end_ms,
        line as text
        from (select doc_id, lang, posexplode(split(text,'\n')) as (pos,line) from {t})""",
        t=documents(spark, sf_dir),
    )


def speech(spark, sf_dir):
    return spark.sql(
        """select user_id as media_id, event_id, event_type, start_ms,
        start_ms+100+cast(floor(value*100) as bigint) as end_ms
        from (select *, cast(floor((unix_micros(cast(ts as timestamp))-1704067200000000)/300000)
              as bigint) as start_ms from {t})""",
        t=load(spark, sf_dir, "events"),
    )


def shifted_cue(spark, sf_dir):
    return spark.sql(
        """select media_id, event_id, start_ms-off_ms as start_ms, end_ms-off_ms as end_ms,
        'line number '||event_id||' spoken' as text
        from (select *, (media_id%7-3)*700 as off_ms from {s} where event_type<>'error')
        where start_ms-off_ms>=0""",
        s=speech(spark, sf_dir),
    )


_TRACK_COLUMNS = """case l_partkey%4 when 0 then 'audio' else 'subtitles' end as type,
 case l_suppkey%6 when 0 then 'eng' when 1 then 'chi' when 2 then 'ger' when 3 then 'fre'
      when 4 then 'zh-Hant' else 'und' end as language,
 case l_partkey%5 when 0 then 'English SDH' when 1 then 'Commentary' when 2 then 'Forced only'
      when 3 then 'Simplified' else '' end as name,
 case l_suppkey%5 when 0 then 'AAC' when 1 then 'AC-3' when 2 then 'TrueHD'
      when 3 then 'DTS-HD Master Audio' else 'SubRip/SRT' end as codec,
 l_linestatus='F' as is_default, l_returnflag='R' as is_forced,
 cast(floor(l_quantity*20) as bigint) as frames, l_extendedprice/20 as span_s"""


def track(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem")
    # a film has a few dozen tracks, so a plain window does
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    numbered = items.withColumn("track_id", F.row_number().over(order))
    return spark.sql(
        "select l_orderkey as media_id, cast(track_id as int) as track_id, " + _TRACK_COLUMNS + " from {t}",
        t=numbered,
    )


def media(spark, sf_dir):
    return spark.sql(
        "select o_orderkey as media_id, o_totalprice/25 as duration_s, o_orderpriority as container from {t}",
        t=load(spark, sf_dir, "orders"),
    )


def candidate(spark, sf_dir):
    return spark.sql(
        """select p_partkey as file_id, case p_partkey%2 when 0 then 'a' else 'b' end as provider,
        replace(p_name,' ','.')||'.'||cast(1950+p_size as varchar(8))||'.'||
        case p_partkey%4 when 0 then 'BluRay' when 1 then 'WEB-DL'
             when 2 then 'Extended.Cut.BluRay' else 'HDTS' end||'.x264-'||replace(p_brand,'#','') as release,
        p_name as feature_title, cast(1950+p_size as varchar(8)) as feature_year,
        'u'||cast(p_partkey%9 as varchar(8)) as author from {t}""",
        t=load(spark, sf_dir, "part"),
    )


def identity(spark, sf_dir):
    return spark.sql(
        """select p_partkey as identity_id, p_name as title, cast(1950+p_size as varchar(8)) as year from {p}""",
        p=load(spark, sf_dir, "part"),
    )


def cache_log(spark, sf_dir):
    return spark.sql(
        """select user_id%20 as cue_ix, case user_id%3 when 0 then 'zh-CN' when 1 then 'de' else 'es' end
        as target, event_id as seq, event_type<>'error' as is_valid, 'tr '||event_id as translation from {t}""",
        t=load(spark, sf_dir, "events"),
    )


def progress(spark, sf_dir):
    base = spark.sql(
        "select media_id as proc_id, event_id as seq, start_ms as arrived_ms, end_ms-start_ms as len from {s}",
        s=speech(spark, sf_dir),
    )
    return (
        Ordered(base, ["proc_id"], "arrived_ms", CHUNK_MS, ties=["seq"])
        .running_sum("out_ms", "len")
        .result()
        .drop("len")
    )


# The same tables as DuckDB text, used as common table expressions by the SQL checks.
DUCKDB_VIEWS = {
    "doc_cue": """select doc_id as track_id, lang, pos+1 as cue_ix,
 cast(pos*3000+(doc_id*131+(pos+1)*977)%2000 as bigint) as start_ms,
 cast(pos*3000+(doc_id*131+(pos+1)*977)%2000+500+(length(line)*30)%6000 as bigint) as end_ms, line as text
 from (select doc_id, lang, generate_subscripts(l,1)-1 as pos, unnest(l) as line
       from (select doc_id, lang, string_split(text,chr(10)) as l from documents))""",
    "speech": """select user_id as media_id, event_id, event_type, start_ms,
 start_ms+100+cast(floor(value*100) as bigint) as end_ms
 from (select *, cast(floor((epoch_us(ts)-1704067200000000)/300000) as bigint) as start_ms from events)""",
    "shifted_cue": """select media_id, event_id, start_ms-off_ms as start_ms, end_ms-off_ms as end_ms,
 'line number '||event_id||' spoken' as text
 from (select *, (media_id%7-3)*700 as off_ms from speech where event_type<>'error') where start_ms-off_ms>=0""",
    "track": """select l_orderkey as media_id, cast(row_number() over (partition by l_orderkey
 order by l_linenumber,l_partkey,l_suppkey,l_extendedprice) as int) as track_id, """ + _TRACK_COLUMNS + " from lineitem",
    "media": "select o_orderkey as media_id, o_totalprice/25 as duration_s, o_orderpriority as container from orders",
    "candidate": """select p_partkey as file_id, case p_partkey%2 when 0 then 'a' else 'b' end as provider,
 replace(p_name,' ','.')||'.'||cast(1950+p_size as varchar(8))||'.'||
 case p_partkey%4 when 0 then 'BluRay' when 1 then 'WEB-DL' when 2 then 'Extended.Cut.BluRay' else 'HDTS' end
 ||'.x264-'||replace(p_brand,'#','') as release,
 p_name as feature_title, cast(1950+p_size as varchar(8)) as feature_year,
 'u'||cast(p_partkey%9 as varchar(8)) as author from part""",
    "identity": "select p_partkey as identity_id, p_name as title, cast(1950+p_size as varchar(8)) as year from part",
    "cache_log": """select user_id%20 as cue_ix, case user_id%3 when 0 then 'zh-CN' when 1 then 'de' else 'es' end
 as target, event_id as seq, event_type<>'error' as is_valid, 'tr '||event_id as translation from events""",
    "progress": """select media_id as proc_id, event_id as seq, start_ms as arrived_ms,
 sum(end_ms-start_ms) over (partition by media_id order by start_ms,event_id) as out_ms from speech""",
}
_NEEDS = {"shifted_cue": ["speech"], "progress": ["speech"]}


def duckdb_sql(views: str, body: str) -> str:
    """SQL text for DuckDB: the named derived tables as CTEs, then `body`.

    `body` is a select, or further CTEs followed by a select.
    """
    names: list[str] = []
    for view in views.split():
        for name in [*_NEEDS.get(view, []), view]:
            if name not in names:
                names.append(name)
    ctes = [f"{name} as ({DUCKDB_VIEWS[name]})" for name in names]
    text = body.strip()
    if text[:6].lower() == "select":
        return ("with recursive " + ",\n".join(ctes) + "\n" if ctes else "") + text
    return "with recursive " + ",\n".join([*ctes, text])
