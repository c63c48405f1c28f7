"""The engine's tables, derived from the driver's: the same SQL expressions on Spark and on DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

#: Name: (source table, select list with {K} for the number in the event's properties, or {D} for a double literal's end).
TABLES = {
    "items": ("embeddings", """vec_id as item_id, 'demo' as dataset, concat('id-', cast(vec_id as varchar(20))) as identifier,
  case when vec_id % 3 = 0 then 'gs://bucket/train' when vec_id % 3 = 1 then 'http://host/train' else '/data/train' end as directory,
  concat('img/', cast(vec_id as varchar(20)), '.v1.jpg') as path, vec_id % 5 = 0 as is_val, label"""),
    "alog": ("events", """cast(floor(event_id / 600) as bigint) as batch_id, event_id, 'replace' as kind, event_id % 500 as item_id, cast(user_id as varchar(20)) as user_email, event_type as category,
  case {K} % 6 when 0 then 'POSITIVE' when 1 then 'NEGATIVE' when 2 then 'HARD_NEGATIVE' when 3 then 'UNSURE' when 4 then 'TOMBSTONE' else 'blurry' end as mode,
  {K} % 10 = 9 as is_box, value as x1, value as y1, value + 10 as x2, value + 20 as y2, ts as created"""),
    "emb": ("embeddings", "vec_id as item_id, embedding, label"),
    "scores": ("lineitem", """((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey as item_id, l_quantity / 50.0e0 as score, l_suppkey % 5 = 0 as is_val"""),
    "models": ("orders", """concat('model-', cast(o_custkey % 50 as varchar(20))) as name, o_orderkey as model_id, o_orderdate as last_updated,
  case when o_orderstatus = 'O' then null else 'ckpt' end as checkpoint_path, case when o_orderstatus = 'F' then 'out' end as output_directory, o_custkey % 3 as epochs_to_run,
  o_orderkey % 7 = 0 as resume_training, o_orderkey - o_orderkey % 11 as resume_model_id, cast(o_custkey % 5 as int) as epoch"""),
    "specs": ("orders", """concat('model-', cast(o_orderkey % 400 as varchar(20))) as name, o_orderkey as model_id, case when o_orderstatus = 'O' then null else 'ckpt' end as checkpoint_path,
  case when o_orderstatus = 'F' then 'out' end as output_directory, case when o_custkey % 7 = 0 then null else concat('{"pos_tags":[', case when o_custkey % 3 = 0 then '' else '"click:POSITIVE"' end,
  '],"neg_tags":["view:NEGATIVE","click:NEGATIVE"],"augment_negs":', case when o_custkey % 2 = 0 then 'true' else 'false' end, ',"augment_negs_include":["view:NEGATIVE","buy:', o_orderstatus, '"]}') end as spec"""),
    "datasets": ("nation", "concat('set-', n_name) as name, n_regionkey = 2 as hidden, n_nationkey % 4 = 0 as indexed"),
    "outputs": ("customer", """concat('set-', cast(c_nationkey as varchar(20))) as dataset, concat('out-', cast(c_custkey as varchar(20))) as name,
  case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then '' else 'emb.bin' end as embeddings_path, case when c_acctbal > 0 then 'scores.npy' end as scores_path"""),
    "val": ("labels", "doc_id as item_id, quality = 1 as label, (doc_id * 7919 % 1000) / 1000.0e0 as score, 1.0e0 + doc_id % 4 as weight"),
}
K = {"spark": "cast(get_json_object(props, '$.k') as int)", "duckdb": "cast(json_extract_string(props, '$.k') as int)"}


def derive(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    """A derived table; with ``stream`` its source is read as a stream of files."""
    ship(spark)
    source, columns = TABLES[name]
    path = f"{sf_dir}/{source}.parquet"
    rows = spark.read.parquet(path)
    if stream:  # a file stream wants a folder or a pattern, so a table of one file is named by a pattern
        rows = spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/{source}.parque[t]")
    return rows.selectExpr(*_parts(columns.replace("{K}", K["spark"])))


def _parts(columns: str) -> list[str]:
    """The select list's items: commas outside brackets part them."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [x.strip() for x in [*out, columns[start:]]]


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """A DuckDB query with the derived tables it uses; ``cur`` is the annotations in force."""
    need = list(names)
    if "cur" in need:
        need.remove("cur")
        need += [x for x in ("alog",) if x not in need]
    ctes = [f"{n} as (select {TABLES[n][1].replace('{K}', K['duckdb'])} from {TABLES[n][0]})" for n in need]
    if "cur" in names:
        ctes.append(
            """cur as (select * from (select *, max(batch_id) filter (not is_box) over (partition by item_id, category) as latest from alog)
  where (is_box or batch_id >= latest) and mode <> 'TOMBSTONE')"""
        )
    # a body that begins with a comma brings further common tables
    return f"with {'recursive ' if recursive else ''}{', '.join(ctes)}{'' if body.startswith(',') else ' '}{body}"
