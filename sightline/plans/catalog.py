"""Registered queries over the derived tables, and their DuckDB equivalents."""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import annotations as A
from ..operators import clustering as C
from ..operators import items as I
from ..operators import learning as L
from ..operators import mapping as M
from ..operators import ranking as R
from ..operators import validation as G
from ..operators.indexing import checkpoint_folder, checkpointed, running_totals
from ..sources import image_lists, images, matrices, outputs
from ..streaming import annotation_stream
from .derived import derive, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QUERY_IDS = (3, 17, 42)
POS, NEG = [("click", "POSITIVE")], [("click", "NEGATIVE")]
ANY = [("click", "POSITIVE"), ("view", "POSITIVE"), ("purchase", "HARD_NEGATIVE")]
SEED = 7


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def any_sql(tags: list[tuple[str, str]]) -> str:
    return "(" + " or ".join(f"(category = '{c}' and mode = '{m}')" for c, m in tags) + ")"


def _current(s: SparkSession, d: str) -> DataFrame:
    return A.current(derive(s, d, "alog"))


# Annotation state


@query(sql("select item_id, category, mode, is_box, batch_id, count(*) as n from cur group by all", "cur"))
def current_annotations(s, d):
    return _current(s, d).groupBy("item_id", "category", "mode", "is_box", "batch_id").agg(F.count("*").alias("n"))


@query(sql("select dataset, category, mode, count(*) as n from cur join items using (item_id) group by all", "cur", "items"))
def category_counts(s, d):
    return A.category_counts(_current(s, d), derive(s, d, "items"))


_FIXED = "'POSITIVE', 'NEGATIVE', 'HARD_NEGATIVE', 'UNSURE'"


@query(sql("select category, " + ", ".join(f"count(*) filter (mode = '{m}') as {m}" for m in A.MODES) + f", count(*) filter (mode not in ({_FIXED})) as OTHER from cur join items using (item_id) group by category", "cur", "items"))
def tag_table(s, d):
    return A.tag_table(category_counts(s, d)).select("category", *(F.col(x).cast("long").alias(x) for x in (*A.MODES, "OTHER")))


@query(sql(f"select category, string_agg(distinct mode, ',' order by mode) as modes from cur where mode not in ({_FIXED}) group by category", "cur"))
def custom_modes(s, d):
    return A.custom_modes(_current(s, d)).withColumn("modes", F.array_join("modes", ","))


@query(sql("select item_id, coalesce(string_agg(category || ':' || mode, ',' order by category, mode) filter (not is_box), '') as tags from cur group by item_id", "cur"))
def tags_per_item(s, d):
    return A.per_item(_current(s, d)).select("item_id", X.tag_text(F.col("tags")).alias("tags"))


@query(sql("select item_id, count(*) filter (is_box) as n_boxes, string_agg(category || ':' || mode || '@' || cast(cast(round(x1 * 1000) as bigint) as varchar), ',' order by category, mode, x1, y1, x2, y2) filter (is_box) as boxes from cur group by item_id having count(*) filter (is_box) > 0", "cur"))
def boxes_per_item(s, d):
    found = A.per_item(_current(s, d)).where(F.size("boxes") > 0)
    one = F.transform("boxes", lambda b: F.concat(b["category"], F.lit(":"), b["value"], F.lit("@"), F.round(b["x1"] * 1000).cast("long").cast("string")))
    return found.select("item_id", F.size("boxes").cast("long").alias("n_boxes"), F.array_join(one, ",").alias("boxes"))


@query(sql("select path, string_agg(category || ':' || mode, ',' order by category, mode) filter (not is_box) as tags from cur join items using (item_id) group by path having count(*) filter (not is_box) > 0", "cur", "items"))
def annotations_by_path(s, d):
    found = A.per_path(_current(s, d), derive(s, d, "items")).where(F.size("annotations") > 0)
    return found.select("path", F.array_join(F.transform("annotations", lambda t: F.concat(t["category"], F.lit(":"), t["mode"])), ",").alias("tags"))


@query(sql("""select group_id, category, value from (select group_id, category, mode as value, count(*) as n from (select distinct c.item_id, c.item_id % 250 as group_id, category, mode from cur c join items using (item_id)
  where not is_box) group by all) join (select item_id % 250 as group_id, count(*) as size from items group by all) using (group_id) where n = size""", "cur", "items"))
def common_tags(s, d):
    selection = derive(s, d, "items").select("item_id", (F.col("item_id") % 250).alias("group_id"))
    return A.common_tags(_current(s, d), selection)


@query(sql("select category, mode, coalesce(n, 0) as n from (select distinct category, mode from alog) full join (select category, mode, count(*) as n from cur group by all) using (category, mode)", "cur"))
def merged_counts(s, d):
    fresh = _current(s, d).groupBy("category", "mode").agg(F.count("*").alias("n"))
    return A.merge_counts(derive(s, d, "alog"), fresh)


@query(sql("select item_id, category, mode, is_box from cur where category in ('click', 'view') and mode in ('POSITIVE', 'blurry') and item_id % 3 = 0", "cur"))
def retrieved_annotations(s, d):
    ids = derive(s, d, "items").where("item_id % 3 = 0")
    return A.retrieve(_current(s, d), ids, ["click", "view"], ["POSITIVE", "blurry"]).select("item_id", "category", "mode", "is_box")


@query(sql("select item_id, is_box, case when category = 'click' then 'tap' else category end as category, mode, count(*) as n from cur group by all", "cur"))
def rename_category(s, d):
    return A.rename_category(_current(s, d), "click", "tap").groupBy("item_id", "category", "mode", "is_box").agg(F.count("*").alias("n"))


@query(sql("select item_id, category, mode, is_box, count(*) as n from cur where category <> 'click' group by all", "cur"))
def delete_category(s, d):
    return A.delete_category(_current(s, d), "click").groupBy("item_id", "category", "mode", "is_box").agg(F.count("*").alias("n"))


@query(sql("""select item_id, coalesce(string_agg(category || ':' || mode, ',' order by category, mode), '') as merged from (
  select distinct item_id, category, mode from cur where not is_box and category <> 'click' and not (category = 'view' and mode = 'UNSURE')
  union select distinct item_id, 'click', 'NEGATIVE' from cur) group by item_id""", "cur"))
def tag_merge(s, d):
    tag = lambda c, m: F.struct(F.lit(c).alias("category"), F.lit(m).alias("value"))
    found = A.per_item(_current(s, d)).withColumn("tags", F.array_distinct("tags"))
    # several modes of one category can hold together; only the added category's are merged to one
    others = F.filter("tags", lambda t: t["category"] != "click")
    mine = A.merge_tags(F.filter("tags", lambda t: t["category"] == "click"), F.array(tag("click", "NEGATIVE")), F.array(tag("view", "UNSURE")))
    merged = F.array_sort(F.concat(F.array_except(others, F.array(tag("view", "UNSURE"))), mine))
    return found.select("item_id", X.tag_text(merged).alias("merged"))


_CHANGES = """, t as (select item_id, coalesce(list(distinct category || ':' || mode) filter (batch_id >= 8), []) as a, coalesce(list(distinct category || ':' || mode) filter (batch_id < 8), []) as b from cur where not is_box group by item_id),
  d as (select item_id, list_filter(a, lambda x: not list_contains(b, x)) as added, list_filter(b, lambda x: not list_contains(a, x)) as deleted from t),
  e as (select *, list_transform(added, lambda x: split_part(x, ':', 1)) as c from d)
  select item_id, array_to_string(list_sort(added), ',') as added, array_to_string(list_sort(deleted), ',') as deleted, array_to_string(list_sort(list_filter(deleted, lambda x: not list_contains(c, split_part(x, ':', 1)))), ',') as deleted_only from e"""


@query(sql(_CHANGES, "cur"))
def tag_changes(s, d):
    """Tags of later batches against those of earlier ones, by item."""
    tags = lambda when: F.array_sort(F.collect_set(F.when(when, F.struct("category", F.col("mode").alias("value")))))
    later = F.col("batch_id") >= 8
    both = _current(s, d).where("not is_box").groupBy("item_id").agg(tags(~later).alias("before"), tags(later).alias("after"))
    diff = both.select("item_id", A.tag_difference(F.col("before"), F.col("after")).alias("d"))
    return diff.select("item_id", *(X.tag_text(F.array_sort(F.col(f"d.{x}"))).alias(x) for x in ("added", "deleted", "deleted_only")))


@query(sql(", good as (select event_id, unnest(['click', category, category]) as category, unnest(['x', mode, mode]) as value from alog) select distinct * from good", "alog"))
def tag_lists(s, d):
    """Tags from their text form, blanks and repeats in it."""
    tag = F.concat("category", F.lit(":"), "mode")
    text = derive(s, d, "alog").select("event_id", F.concat(F.lit("click:x,,"), tag, F.lit(","), tag, F.lit(",")).alias("tags"))
    return text.select("event_id", F.explode(X.tags_of(F.col("tags"))).alias("t")).select("event_id", "t.category", "t.value")


@query(sql(", more as (select item_id, case when item_id % 3 = 0 then 'active:m' else 'view' end as category, case when item_id % 3 = 0 then 'NEGATIVE' else 'POSITIVE' end as mode from items where is_val) select item_id, category, mode, is_box, count(*) as n from (select item_id, category, mode, is_box from cur union all select item_id, category, mode, false from more) group by all", "items", "cur"))
def validation_answers(s, d):
    """Answers of a validation, some as other negatives of the model, appended to the log."""
    items, log = derive(s, d, "items"), derive(s, d, "alog")
    asked = items.where("is_val").select("item_id", F.lit("view").alias("category"), F.lit("POSITIVE").alias("mode"), (F.col("item_id") % 3 == 0).alias("is_other_negative"))
    return A.current(log.unionByName(A.validation_rows(asked, items, 1 << 40, "me", "m"), allowMissingColumns=True)).groupBy("item_id", "category", "mode", "is_box").agg(F.count("*").alias("n"))


@query(sql("select item_id, category, mode, is_box, count(*) as n from cur where item_id not in (select item_id from items where item_id % 7 = 3) group by all", "cur", "items"))
def delete_dataset(s, d):
    items = derive(s, d, "items").withColumn("dataset", F.when(F.col("item_id") % 7 == 3, "gone").otherwise("stays"))
    return A.delete_dataset(_current(s, d), items, "gone").groupBy("item_id", "category", "mode", "is_box").agg(F.count("*").alias("n"))


@query(sql("select case when name = 'model-3' then 'best' else name end as name, model_id, epoch from models", "models"))
def rename_model(s, d):
    return A.rename(derive(s, d, "models"), "model-3", "best").select("name", "model_id", "epoch")


@query(sql("select name, model_id, epoch from models where name <> 'model-3'", "models"))
def delete_model(s, d):
    return A.delete(derive(s, d, "models"), "model-3").select("name", "model_id", "epoch")


@query(sql("select event_id, case when event_id % 5 = 0 then null else lower(mode) end as mode from alog", "alog"))
def custom_mode_names(s, d):
    typed = F.when(F.col("event_id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "mode", F.lit("  ")))
    return derive(s, d, "alog").select("event_id", X.custom_mode(typed).alias("mode"))


# Items, datasets, models


def _filter_sql(include: str, exclude: str) -> str:
    return f"""from items i where not is_val and exists (select 1 from cur c where c.item_id = i.item_id and {include})
  and not exists (select 1 from cur c where c.item_id = i.item_id and {exclude})"""


@query(sql("select item_id, identifier " + _filter_sql(any_sql(ANY), any_sql(NEG)), "items", "cur"))
def filter_include_exclude(s, d):
    return I.filter_items(derive(s, d, "items"), _current(s, d), ANY, NEG).select("item_id", "identifier")


@query(sql(f"select item_id, is_val from items i where item_id % 4 = 1 and not exists (select 1 from cur c where c.item_id = i.item_id and {any_sql(NEG)})", "items", "cur"))
def subset_filter(s, d):
    items = derive(s, d, "items")
    return I.filter_items(items, _current(s, d), exclude=NEG, split="val", subset=items.where("item_id % 4 = 1")).select("item_id", "is_val")


@query(sql("select item_id from items where is_val and item_id % 10 <> 0 order by item_id limit 30 offset 10", "items"))
def filter_slice(s, d):
    items = derive(s, d, "items")
    return I.filter_items(items, _current(s, d), split="val", exclude_ids=items.where("item_id % 10 = 0"), offset=10, num=30).select("item_id")


@query(sql(f"select item_id from items i where not is_val and not exists (select 1 from cur c where c.item_id = i.item_id and {any_sql(POS + NEG)})", "items", "cur"))
def unlabelled_pool(s, d):
    return L.unlabelled(derive(s, d, "items"), _current(s, d), POS, NEG).select("item_id")


@query(sql("select dataset, count(*) filter (not is_val) as num_train, count(*) filter (is_val) as num_val from items group by dataset", "items"))
def dataset_info(s, d):
    return I.dataset_info(derive(s, d, "items"))


@query(sql("""select name, arg_max(model_id, (last_updated, model_id)) as latest, arg_max(model_id, (last_updated, model_id)) filter (output_directory is not null) as with_output
  from models where checkpoint_path is not null group by name""", "models"))
def latest_models(s, d):
    return I.latest_models(derive(s, d, "models"))


_SPEC = "struct<pos_tags: array<string>, neg_tags: array<string>, augment_negs: boolean, augment_negs_include: array<string>>"


@query(sql("""select name, model_id, checkpoint_path is not null as has_checkpoint, output_directory is not null as has_output, coalesce(array_to_string(cast(json_extract_string(spec, '$.pos_tags[*]') as varchar[]), ','), '') as pos_tags,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(cast(json_extract_string(spec, '$.neg_tags[*]') as varchar[]), cast(json_extract_string(spec, '$.augment_negs_include[*]') as varchar[])))), ','), '') as neg_tags,
  coalesce(json_extract_string(spec, '$.augment_negs') = 'true', false) as augment_negs, output_directory is not null and spec is not null and contains(spec, 'POSITIVE') as usable from specs""", "specs"))
def model_summary(s, d):
    models = derive(s, d, "specs").withColumn("category_spec", F.from_json("spec", _SPEC))
    found = I.model_summary(models)
    usable = I.usable_models(found).select("model_id", F.lit(True).alias("usable"))
    text = {x: F.array_join(x, ",") for x in ("pos_tags", "neg_tags")}
    return found.join(usable, "model_id", "left").withColumns({**text, "usable": F.coalesce("usable", F.lit(False))})


@query(sql("select name, row_number() over (order by lower(name) desc, name) - 1 as place from (select distinct name from specs)", "specs"))
def models_by_name(s, d):
    ordered = I.by_name(derive(s, d, "specs").select("name").distinct(), descending=True).withColumn("at", F.monotonically_increasing_id())
    return ordered.select("name", (F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("place"))  # a row per model name


@query(sql("select name, row_number() over (order by name) - 1 as place from datasets where not hidden", "datasets"))
def visible_datasets(s, d):
    ordered = I.visible_datasets(derive(s, d, "datasets")).withColumn("at", F.monotonically_increasing_id())
    return ordered.select("name", (F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("place"))  # a row per dataset


@query(sql("select dataset, name, coalesce(embeddings_path <> '', false) as has_embeddings, coalesce(scores_path <> '', false) as has_scores from outputs", "outputs"))
def list_outputs(s, d):
    return I.output_capabilities(derive(s, d, "outputs")).select("dataset", "name", "has_embeddings", "has_scores")


@query(sql(", held as (select * from outputs where name not like '%7') select dataset, name, scores_path from held union all select distinct dataset, name, 'new.npy' from outputs where name like '%7' and name not like '%17'", "outputs"))
def insert_if_absent(s, d):
    every = derive(s, d, "outputs")
    jobs = every.select("dataset", "name", F.lit("x").alias("embeddings_path"), F.lit("new.npy").alias("scores_path"), F.lit(True).alias("finished"), F.col("name").endswith("17").alias("failed"))
    return outputs.insert_if_absent(every.where("name not like '%7'"), jobs.union(jobs)).select("dataset", "name", "scores_path")


@query(sql("select item_id, identifier from items where item_id % 7 <> 0", "items"))
def named_items(s, d):
    blank = F.when(F.col("item_id") % 14 == 0, "").when(F.col("item_id") % 7 == 0, None).otherwise(F.col("identifier"))
    return I.named(derive(s, d, "items").withColumn("identifier", blank)).select("item_id", "identifier")


@query(sql("select m.model_id, m.epochs_to_run - 1 + case when m.resume_training then coalesce(r.epoch + 1, 0) else 0 end as epoch from models m left join models r on r.model_id = m.resume_model_id", "models"))
def model_epochs(s, d):
    return I.epochs(derive(s, d, "models")).select("model_id", "epoch")


@query(sql("""select item_id, case when directory like 'gs://%' then 'https://storage.googleapis.com/' || split_part(directory, '/', 3) || '/' || path
  when directory like 'http%' then path else '/files' || directory || '/' || path end as public_path from items""", "items"))
def resolved_paths(s, d):
    return derive(s, d, "items").select("item_id", X.public_path(F.col("directory"), F.col("path")).alias("public_path"))


@query(sql("select item_id, string_split(path, '/')[-1] as file_name, regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') as result_id, string_split(string_split(path, '/')[-1], '.')[1] as stack_id from items", "items"))
def file_names(s, d):
    path = F.col("path")
    return derive(s, d, "items").select("item_id", X.file_name(path).alias("file_name"), X.result_id(path).alias("result_id"), X.stack_id(path).alias("stack_id"))


# Rankings

_MEAN = f"query as (select list(x order by i) as q from (select i, avg(x) as x from (select unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from emb where item_id in {QUERY_IDS}) group by i))"


def _knn_sql(measure: str, order: str, where: str = "") -> str:
    return f""", {_MEAN}, raw as (select item_id, {measure} as x from emb, query), scaled as (select item_id, (x - min(x) over ()) / nullif(max(x) over () - min(x) over (), 0) as dist from raw)
  select item_id, dist, row_number() over (order by dist {order}, item_id) - 1 as rank from scaled join items using (item_id) where dist between 0 and 1 {where}"""


def _mean_query(s, d) -> DataFrame:
    return R.query_vector(derive(s, d, "emb").where(F.col("item_id").isin(*QUERY_IDS)))


def _ranked(found: DataFrame, metric: str = "l2") -> DataFrame:
    return R.ranked(found.select("item_id", "dist"), R.order(metric))


@query(sql(_knn_sql("list_distance(embedding::double[], q)", "asc", f"and not is_val and exists (select 1 from cur c where c.item_id = items.item_id and {any_sql(ANY)}) and not exists (select 1 from cur c where c.item_id = items.item_id and {any_sql(NEG)})"), "emb", "items", "cur"))
def knn_l2(s, d):
    items = I.filter_items(derive(s, d, "items"), _current(s, d), ANY, NEG)
    return _ranked(R.knn(items, derive(s, d, "emb").select("item_id", "embedding"), _mean_query(s, d)))


@query(sql(_knn_sql("list_dot_product(embedding::double[], q)", "desc", "and dist >= 0.3e0"), "emb", "items"))
def knn_dot(s, d):
    return _ranked(R.knn(derive(s, d, "items"), derive(s, d, "emb").select("item_id", "embedding"), _mean_query(s, d), "dot", low=0.3), "dot")


@query(sql(", q as (select embedding::double[] as q from emb where item_id = 5), raw as (select item_id, list_distance(embedding::double[], q) as x from emb, q) select item_id, (x - (select min(x) from raw)) / (select max(x) - min(x) from raw) as dist from raw order by dist, item_id limit 20", "emb"))
def find_similar(s, d):
    emb = derive(s, d, "emb").select("item_id", "embedding")
    one = emb.where("item_id = 5").select(V.doubles(F.col("embedding")).alias("query"))
    return R.top(R.knn(derive(s, d, "items"), emb, one), 20, R.order()).select("item_id", "dist")


_WEIGHTS = [((i * 37) % 19 - 9) / 10 for i in range(64)]


@query(sql(f", raw as (select item_id, list_dot_product(embedding::double[], {_WEIGHTS}::double[]) as x from emb), scaled as (select item_id, (x - min(x) over ()) / (max(x) over () - min(x) over ()) as dist from raw) select item_id, dist, row_number() over (order by dist desc, item_id) - 1 as rank from scaled where dist between 0.25e0 and 1", "emb"))
def svm_score_query(s, d):
    found = L.svm_query(derive(s, d, "items"), derive(s, d, "emb").select("item_id", "embedding"), _WEIGHTS, low=0.25)
    return _ranked(found, "dot")


@query(sql("select item_id, score as dist, row_number() over (order by score desc, item_id) - 1 as rank from scores where not is_val and score between 0.1e0 and 0.9e0", "scores"))
def score_ranking(s, d):
    scores = derive(s, d, "scores")
    return _ranked(R.score_ranking(scores.where("not is_val").select("item_id"), scores, 0.1, 0.9), "dot")


@query(sql("select * from (select item_id, score as dist, row_number() over (order by score desc, item_id) - 1 as rank from scores) where rank between 1000 and 1499", "scores"))
def ranked_page(s, d):
    return R.page(derive(s, d, "scores").select("item_id", F.col("score").alias("dist")), 2, R.order("dot"))


@query(sql("select item_id, rank from (select item_id, row_number() over (order by score desc, item_id) - 1 as rank, count(*) over () as n from scores where is_val) where rank >= ceil(n * (1e0 - 0.95e0)) and rank < floor(n * (1e0 - 0.25e0))", "scores"))
def bulk_slice(s, d):
    ranking = _ranked(derive(s, d, "scores").where("is_val").select("item_id", F.col("score").alias("dist")), "dot")
    return R.percentile_slice(ranking, 0.25, 0.95).select("item_id", "rank")


@query(sql("select item_id, -1e0 as dist, row_number() over (order by md5(concat_ws('|', item_id, '7')), item_id) - 1 as rank from items where not is_val", "items"))
def browse_random(s, d):
    found = R.browse(derive(s, d, "items").where("not is_val").select("item_id"), "random", SEED)
    return R.ranked(found, ["sort_key", "item_id"]).select("item_id", "dist", "rank")


@query(sql("select item_id from (select item_id, row_number() over (order by item_id) - 1 as rank, count(*) over () as n from scores) where rank % greatest(floor(n / 1000), 1) = 0", "scores"))
def stride_sample(s, d):
    return R.stride_sample(derive(s, d, "scores").select("item_id"), 1000, ["item_id"]).select("item_id")


@query(sql(", r as (select item_id, row_number() over (order by label desc, item_id) - 1 as rank from items), t as (select item_id, string_agg(category || ':' || mode, ',' order by category, mode) filter (not is_box) as tags from cur group by item_id) select item_id, rank, coalesce(tags, '') as tags, case when directory like 'gs://%' then 'https://storage.googleapis.com/' || split_part(directory, '/', 3) || '/' || path when directory like 'http%' then path else '/files' || directory || '/' || path end as public_path from r join items using (item_id) left join t using (item_id) where rank between 100 and 199", "items", "cur"))
def result_page(s, d):
    """The second hundred of a result; its clusters have no SQL form and are tested against a plain version."""
    items, emb = derive(s, d, "items"), derive(s, d, "emb").select("item_id", "embedding")
    found = items.select("item_id", F.col("label").cast("double").alias("dist"))
    shown = R.result_page(found, 1, R.order("dot"), items, _current(s, d), emb, 80, 100)
    return shown.select("item_id", "rank", X.tag_text(F.col("tags")).alias("tags"), "public_path")


@query(sql("select item_id from items where label in (1, 4) and item_id % 5 <> 2", "items"))
def inverted_selection(s, d):
    """What isn't selected of the clusters in which something is."""
    items = derive(s, d, "items")
    return C.inverted(items.where("label in (1, 4)").select("item_id", F.col("label").alias("cluster")), items.where("item_id % 5 = 2")).select("item_id")


@query(sql(", ranked as (select item_id, row_number() over (order by label desc, item_id) - 1 as rank, count(*) over () as n from items), slice as (select item_id from ranked where rank >= ceil(n * (1e0 - 0.6e0)) and rank < floor(n * (1e0 - 0.2e0))) select item_id, category, mode, is_box, count(*) as n from (select item_id, category, mode, is_box from cur where is_box or category <> 'click' or item_id not in (select item_id from slice) union all select item_id, 'click', 'HARD_NEGATIVE', false from slice) group by all", "items", "cur"))
def bulk_tag(s, d):
    items, log = derive(s, d, "items"), derive(s, d, "alog")
    ranking = _ranked(items.select("item_id", F.col("label").cast("double").alias("dist")), "dot")
    tagged = A.set_tag(R.percentile_slice(ranking, 0.2, 0.6), 1 << 40, "me", "click", "HARD_NEGATIVE")
    return A.current(log.unionByName(tagged, allowMissingColumns=True)).groupBy("item_id", "category", "mode", "is_box").agg(F.count("*").alias("n"))


@query(sql("select item_id, -1e0 as dist, row_number() over (order by item_id) - 1 as rank from items where not is_val", "items"))
def browse_ids(s, d):
    return R.ranked(R.browse(derive(s, d, "items").where("not is_val").select("item_id")), ["sort_key"]).select("item_id", "dist", "rank")


# Learning


def _train_sql() -> str:
    return f""", lab as (select item_id, bool_or({any_sql(POS)}) as pos, bool_or({any_sql(NEG)}) as neg from cur group by item_id),
  train as (select item_id, pos::int as label from lab join items using (item_id) where (pos or neg) and not is_val)"""


@query(sql(_train_sql() + ", extra as (select greatest(0, 7 * count(*) filter (label = 1) - count(*) filter (label = 0)) as k from train), pool as (select item_id, row_number() over (order by md5(concat_ws('|', item_id, '7')), item_id) as r from items where not is_val and item_id not in (select item_id from train)) select item_id, label from train union all select item_id, 0 from pool, extra where r <= k", "items", "cur"))
def svm_training_set(s, d):
    items, cur = derive(s, d, "items"), _current(s, d)
    return L.augmented(L.training_set(items, cur, POS, NEG), I.filter_items(items, cur), L.SVM_NEGATIVES, SEED)


@query(sql(f", b as (select item_id, case when bool_or({any_sql(POS)}) then 'pos' when bool_or({any_sql(NEG)}) then 'neg' when bool_or({any_sql([('view', 'POSITIVE')])}) then 'val_pos' when bool_or({any_sql([('view', 'NEGATIVE')])}) then 'val_neg' end as bucket from cur group by item_id) select * from b where bucket is not null", "cur"))
def bucketed_labels(s, d):
    return L.buckets(_current(s, d), POS, NEG, [("view", "POSITIVE")], [("view", "NEGATIVE")])


@query(sql("""select tp / nullif(p, 0) as precision, tp / nullif(pos, 0) as recall, 2 * (tp / p) * (tp / pos) / nullif(tp / p + tp / pos, 0) as f1, pos as num_positives, neg as num_negatives from
  (select (count(*) filter (score > 0.5e0 and label))::double as tp, (count(*) filter (score > 0.5e0))::double as p, count(*) filter (label) as pos, count(*) filter (not label) as neg from val)""", "val"))
def training_metrics(s, d):
    return L.training_metrics(derive(s, d, "val"))


@query()
def svm_fit(s, d):
    emb = derive(s, d, "emb")
    train = emb.select("item_id", (F.col("label") == 3).cast("int").alias("label"))
    weights = L.fit_svm(train, emb.select("item_id", "embedding"))
    return _ranked(L.svm_query(derive(s, d, "items"), emb.select("item_id", "embedding"), weights), "dot")


@query(sql(", n as (select max(len(embedding)) as d from emb) select unnest(range(d + 1)) as i, 0e0 as slope from n", "emb"))
def svm_gradient(s, d):
    """How steep the SVM's loss is at the weights that have been found, for each weight and, last, the intercept."""
    emb = derive(s, d, "emb")
    w = L.fit_svm_weights(emb.select("item_id", (F.col("label") == 3).cast("int").alias("label")), emb.select("item_id", "embedding")).tolist()
    rows = emb.select(F.when(F.col("label") == 3, 1.0).otherwise(-1.0).alias("y"), F.concat(V.doubles(F.col("embedding")), F.array(F.lit(1.0))).alias("x"))
    short = F.greatest(F.lit(0.0), 1 - F.col("y") * V.dot(F.col("x"), F.array(*map(F.lit, w))))
    pull = rows.select(F.posexplode("x").alias("i", "x"), (-0.2 * F.col("y") * short).alias("pull")).groupBy("i").agg(F.sum(F.col("pull") * F.col("x")).alias("g"))
    slope = F.abs(F.round(F.col("g") + F.element_at(F.array(*map(F.lit, w)), F.col("i") + 1), 3))
    return pull.select(F.col("i").cast("long").alias("i"), slope.alias("slope"))


# Validation


def _estimate_sql() -> str:
    parts = []
    for name, share in (("precision", "h"), ("recall", "l"), ("f1", "(0.5e0 * h + 0.5e0 * l)")):
        w = f"(weight * {share})"
        mean = f"sum({w} * c) / nullif(sum({w}), 0)"
        parts.append(f"{mean} as {name}")
        parts.append(
            f"sqrt(((1 - {mean}) ** 2 * sum({w} * {w} * c) + ({mean}) ** 2 * (sum({w} * {w}) - sum({w} * {w} * c))) / count(*) / ((sum({w}) / count(*)) ** 2 * (1 - sum({w} * {w}) / sum({w}) ** 2))) / sqrt(count(*)) as {name}_std"
        )
    return f", x as (select *, (score > 0.5e0)::int::double as h, label::int::double as l, ((score > 0.5e0) = label)::int::double as c from val) select {', '.join(parts)}, count(*) as num_labeled, count(*) filter (h = 1 and l = 0) as num_fp, count(*) filter (h = 0 and l = 1) as num_fn from x"


@query(sql(_estimate_sql(), "val"))
def pr_f1_estimate(s, d):
    return G.estimates(derive(s, d, "val"))


@query(sql(_estimate_sql().replace("from val)", "from val where item_id % 2 = 0)"), "val"))
def metric_query(s, d):
    """Labels with the weights and scores that exist for them."""
    val = derive(s, d, "val")
    return G.estimates(G.metric_sample(val.select("item_id", "label"), val.where("item_id % 2 = 0").select("item_id", "weight"), val.select("item_id", "score")))


@query(sql("select distinct item_id from val where item_id % 4 < 2 and item_id % 9 <> 0", "val"))
def new_ids_to_label(s, d):
    val = derive(s, d, "val")
    return G.to_request(val.where("item_id % 4 < 2").select("item_id", "weight", (F.col("item_id") % 9 == 0).alias("labelled"))).select("item_id")


@query(sql("select item_id, score, 'fp' as kind, row_number() over (order by score desc, item_id) - 1 as rank from val where score > 0.5e0 and not label union all select item_id, score, 'fn', row_number() over (order by score, item_id) - 1 from val where score <= 0.5e0 and label", "val"))
def fp_fn(s, d):
    val = derive(s, d, "val")
    return G.false_positives(val).select("item_id", "score", F.lit("fp").alias("kind"), "rank").union(G.false_negatives(val).select("item_id", "score", F.lit("fn").alias("kind"), "rank"))


@query(sql("select item_id, score, label, weight * case when item_id % 3 = 0 then 3 else 1 end as weight from val", "val"))
def merged_draws(s, d):
    """Rows drawn several times, once with their weights added."""
    val = derive(s, d, "val").select("item_id", "label", "score", "weight")
    again = val.where("item_id % 3 = 0")
    return G.merged_weights(val.union(again).union(again))


@query(sql("select item_id, case when score > 0.5e0 then sqrt(p * 0.49e0 + 0.0225e0 * (1 - p)) else 0.5e0 * sqrt(p * 0.09e0) end as w from (select item_id, score, 0.98e0 * score + 0.01e0 as p from scores)", "scores"))
def sawade_weights(s, d):
    return derive(s, d, "scores").select("item_id", G.sawade_weight(F.col("score"), I.predicted(F.col("score")), 0.3).alias("w"))


@query(sql("select item_id, score from scores order by score desc, item_id limit 777", "scores"))
def top_t_domain(s, d):
    return R.best(derive(s, d, "scores").select("item_id", "score"), 777)


@query(sql(f", lab as (select item_id, bool_or({any_sql(POS)}) as label, bool_or({any_sql([*NEG, ('view', 'blurry')])}) as other from cur group by item_id) select item_id, lab.label from lab join items using (item_id) where is_val and (lab.label or other)", "items", "cur"))
def validation_examples(s, d):
    return G.validation_examples(derive(s, d, "items"), _current(s, d), POS, NEG, [("view", "blurry")])


def _isotonic_sql(name: str, source: str) -> str:
    """CTEs ending in ``name`` (score, p): least-squares monotone fit of ``source`` (score, label), the greatest over beginnings of
    the least over ends of mean labels."""
    return f"""{name}_g as (select score, sum(label::int)::double as y, count(*)::double as c from {source} group by score),
  {name}_k as (select score, row_number() over w as i, sum(y) over w as ys, sum(c) over w as cs, coalesce(sum(y) over (order by score rows between unbounded preceding and 1 preceding), 0) as yb, coalesce(sum(c) over (order by score rows between unbounded preceding and 1 preceding), 0) as cb from {name}_g window w as (order by score)),
  {name}_m as (select a.i as a, b.i as b, min((b.ys - a.yb) / (b.cs - a.cb)) over (partition by a.i order by b.i desc rows unbounded preceding) as low from {name}_k a join {name}_k b on a.i <= b.i),
  {name} as (select k.score, max(m.low) as p from {name}_k k join {name}_m m on m.b = k.i group by k.score)"""


def _draws_sql(name: str, source: str, m: str, seed: int) -> str:
    """CTEs ending in ``name`` (item_id, weight): ``m`` draws with replacement from ``source`` (item_id, w)."""
    return f"""{name}_s as (select item_id, floor(w / max(w) over () * 1099511627776e0)::bigint as share from {source}),
  {name}_p as (select item_id, share, sum(share) over (order by item_id) - share as at, sum(share) over () as total from {name}_s where share > 0),
  {name}_d as (select i, (('0x' || substr(md5(concat_ws('|', i, '{seed}')), 1, 13))::bigint / 4503599627370496e0 * (select max(total)::double from {name}_p))::double as u from range({m}) t(i)),
  {name} as (select p.item_id, p.total::double / (p.share::double * ({m})::double) as weight from (select i, floor(u)::hugeint as at from {name}_d) x asof join {name}_p p on x.at >= p.at)"""


def _worth_sql(p: str, hit: str, g: float) -> str:
    return f"case when {hit} then sqrt((0.98e0 * {p} + 0.01e0) * {1 - g}e0 * {1 - g}e0 + {0.5 * g}e0 * {0.5 * g}e0 * (1 - (0.98e0 * {p} + 0.01e0))) else 0.5e0 * sqrt((0.98e0 * {p} + 0.01e0) * {g}e0 * {g}e0) end"


@query(sql(f", {_isotonic_sql('iso', 'val')} select item_id, round(p, 9) as p from val join iso using (score)", "val"))
def isotonic_calibration(s, d):
    val = derive(s, d, "val")
    return G.calibrated(G.calibrate(val), val.select("item_id", "score")).select("item_id", F.round("p", 9).alias("p"))


@query(sql(f", w as (select item_id, {_worth_sql('score', 'score > 0.5e0', 0.3)} as w from scores), {_draws_sql('drawn', 'w', '2000', SEED)} select item_id, round(weight, 6) as weight from drawn", "scores"))
def weighted_sample(s, d):
    scores = derive(s, d, "scores").select("item_id", "score")
    drawn = G.weighted_draws(scores.select("item_id", G.sawade_weight(F.col("score"), I.predicted(F.col("score")), 0.3).alias("w")), 2000, SEED)
    return drawn.select("item_id", F.round("weight", 6).alias("weight"))


@query(sql(f", w as (select item_id, {_worth_sql('score', 'score > 0.5e0', 0.3)} as w from scores), {_draws_sql('drawn', 'w', '2000', SEED)} select count(*) as num_draws, count(distinct item_id) as num_labeled from drawn", "scores"))
def labels_asked(s, d):
    """What it costs to label a weighted sample."""
    scores = derive(s, d, "scores").select("item_id", "score")
    return G.labels_asked(G.weighted_draws(scores.select("item_id", G.sawade_weight(F.col("score"), I.predicted(F.col("score")), 0.3).alias("w")), 2000, SEED))


_ACTIVE = f"""known as (select item_id, label, score from val where item_id % 9 = 0), sizes as (select (select count(*) from known) as k, count(*) as n, count(*) filter (score > 0.5e0) as positive from val),
  asked as (select *, greatest(2 * k, 10) as budget from sizes), wide as (select *, (3 * (log2(budget / 10e0) + 1) * positive)::bigint as t0, floor(3 * (log2(budget / 10e0) + 1) * positive)::bigint as t from asked),
  domain as (select item_id, score from (select item_id, score, row_number() over (order by score desc, item_id) as r from val) , wide where t >= n or t = 0 or r <= t),
  {_isotonic_sql('iso', 'known')},
  near as (select d.item_id, d.score, max(i.score) filter (i.score <= d.score) as s0, min(i.score) filter (i.score >= d.score) as s1 from domain d cross join iso i group by d.item_id, d.score),
  fitted as (select item_id, near.score, case when s0 is null then b.p when s1 is null or s0 = s1 then a.p else a.p + (b.p - a.p) * (near.score - s0) / (s1 - s0) end as p from near left join iso a on a.score = s0 left join iso b on b.score = s1),
  w as (select item_id, {_worth_sql('p', 'score > 0.5e0', 0.6)} as w from fitted), {_draws_sql('drawn', 'w', '(select budget - k from asked)', SEED)},
  every as (select item_id, 1e0 as weight from known union all select item_id, weight from drawn),
  scaled as (select item_id, max(weight) * (select count(*) from every)::double / (select n from sizes) as weight from every group by item_id)
  select item_id, round(case when k.item_id is null then weight else (select count(*) from every)::double / (select n from sizes) end, 6) as weight, k.item_id is not null as labelled from scaled left join known k using (item_id)"""


@query(sql(f", {_ACTIVE}", "val"))
def active_validation(s, d):
    val = derive(s, d, "val")
    found = G.active_validation(val.select("item_id", "score"), val.where("item_id % 9 = 0").select("item_id", "label", "score"), 0.6, SEED)
    return found.select("item_id", F.round("weight", 6).alias("weight"), "labelled")


@query()
def ais_loop(s, d):
    val = derive(s, d, "val")
    return s.createDataFrame([G.ais_loop(val.select("item_id", "score"), val.select("item_id", "label"), 80, SEED)], "f1 double, f1_std double, num_labeled long")


@query(sql("select item_id, row_number() over (order by score desc, item_id) - 1 as rank from val where item_id % 9 <> 0 order by rank limit 10", "val"))
def labelling_stack(s, d):
    val = derive(s, d, "val")
    stack = R.to_label(_ranked(val.select("item_id", F.col("score").alias("dist")), "dot"), val.where("item_id % 9 = 0"))
    return stack.withColumn("rank", (F.row_number().over(Window.orderBy("rank")) - 1).cast("long")).select("item_id", "rank")  # ten rows


# Reductions and maps


@query(sql("select i, avg(x) as x from (select unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) - 1 as i from emb) group by i", "emb"))
def vector_pool_avg(s, d):
    return M.pool(derive(s, d, "emb"), "avg").select(F.posexplode("embedding").alias("i", "x")).withColumn("i", F.col("i").cast("long"))


@query(sql("select i, max(x) as x from (select unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) - 1 as i from emb) group by i", "emb"))
def vector_pool_max(s, d):
    return M.pool(derive(s, d, "emb"), "max").select(F.posexplode("embedding").alias("i", "x")).withColumn("i", F.col("i").cast("long"))


@query(sql(""", c as (select avg(score) as m, count(*) as n from scores), p as (select avg((score - m) ** 2) as m2, avg((score - m) ** 3) as m3, avg((score - m) ** 4) as m4 from scores, c)
  select count(score) as n, avg(score) as mean, coalesce(stddev_samp(score), 0) as std, coalesce(var_samp(score), 0) as variance, min(score) as min, max(score) as max, round(any_value(m3 / m2 ** 1.5e0), 6) as skewness, round(any_value(m4 / m2 ** 2 - 3), 6) as kurtosis from scores, p""", "scores"))
def running_stats(s, d):
    return M.running_stats(derive(s, d, "scores"), "score").withColumns({x: F.round(x, 6) for x in ("skewness", "kurtosis")})


@query(sql("select * from (select item_id, score, is_val, row_number() over (partition by is_val order by score desc, item_id) - 1 as rank from scores) where rank < 20", "scores"))
def grouped_top_k(s, d):
    return M.grouped_top_k(derive(s, d, "scores"), ["is_val"], "score", 20).withColumn("rank", F.col("rank").cast("long"))


class HarmonicMean:
    """A reduction of one's own: number and harmonic mean of scores."""

    output = "n long, mean double"

    def start(self):
        return 0, 0.0

    def add(self, state, rows):
        return state[0] + len(rows), state[1] + float((1 / rows["score"]).sum())

    def merge(self, state, other):
        return state[0] + other[0], state[1] + other[1]

    def finish(self, state):
        return state[0], round(state[0] / state[1], 9)


@query(sql("select is_val, count(*) as n, round(count(*) / sum(1 / score), 9) as mean from scores group by is_val", "scores"))
def custom_reduction(s, d):
    return M.reduced(derive(s, d, "scores").select("is_val", "score"), ["is_val"], HarmonicMean())


@query(sql("select item_id, score from scores order by score desc, item_id limit 50", "scores"))
def top_k(s, d):
    return M.top_k(derive(s, d, "scores").select("item_id", "score"), "score", 50)


_WORDS = """words as (select doc_id as item_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '\\s+')) as word from documents),
  counts as (select item_id, ('0x' || substr(md5(word), 1, 13))::bigint % 64 as i, sum(case when (('0x' || substr(md5(word), 1, 13))::bigint >> 51) = 1 then 1 else -1 end)::double as x from words where word <> '' group by all),
  places as (select doc_id as item_id, i from documents, range(64) t(i)), sizes as (select item_id, sqrt(sum(x * x)) as size from counts group by item_id),
  embedded as (select item_id, i, (coalesce(x, 0) / greatest(coalesce(size, 0), 1e-12))::float as x from places left join counts using (item_id, i) left join sizes using (item_id))"""


@query(f"with {_WORDS} select item_id, i, x from embedded")
def embed_text(s, d):
    found = M.embed(s.read.parquet(f"{d}/documents.parquet"), M.HashingEmbedder(64), "text", "doc_id")
    return found.select("item_id", F.posexplode("embedding").alias("i", "x")).withColumn("i", F.col("i").cast("long"))


@query(f"""with {_WORDS}, raw as (select e.item_id, sum(e.x::double * q.x::double) as x from embedded e join embedded q on q.item_id = 1 and q.i = e.i group by e.item_id)
select item_id, round((x - min(x) over ()) / (max(x) over () - min(x) over ()), 9) as dist from raw order by dist desc, item_id limit 100""")
def text_search(s, d):
    """Embeds documents and ranks them against the embedding of one of them."""
    emb = checkpointed(M.embed(s.read.parquet(f"{d}/documents.parquet"), M.HashingEmbedder(64), "text", "doc_id"))
    one = emb.where("item_id = 1").select(V.doubles(F.col("embedding")).alias("query"))
    found = R.normalised(checkpointed(R.distances(emb, one, "dot")))
    return R.top(found.withColumn("dist", F.round("dist", 9)), 100, R.order("dot"))


@query(sql("select item_id as id, case when score < 0.1e0 or score > 0.9e0 then null else score * 2 end as output, case when score < 0.1e0 or score > 0.9e0 then 'skipped' else 'processed' end as status, score > 0.9e0 as failed from scores", "scores"))
def chunked_map(s, d):
    return _mapped(s, d).select("id", "output", "status", F.col("error").isNotNull().alias("failed"))


def _mapped(s, d) -> DataFrame:
    def twice(x: float) -> float | None:
        if x > 0.9:
            raise ValueError(x)
        return None if x < 0.1 else x * 2

    return M.map_elements(derive(s, d, "scores"), twice, "score")


@query(sql("select count(*) filter (score between 0.1e0 and 0.9e0)::bigint as processed, count(*) filter (score < 0.1e0 or score > 0.9e0)::bigint as skipped from scores", "scores"))
def map_tallies(s, d):
    return M.tallies(_mapped(s, d)).agg(F.sum("processed").alias("processed"), F.sum("skipped").alias("skipped"))


class Moody(M.Mapper):
    """Doubles scores in chunks; a chunk whose first item 7 divides fails always, one that 3 divides at its first attempt only."""

    def start(self, args: float) -> dict:
        return {"factor": args, "tried": set()}

    def chunk(self, inputs: list, job: dict) -> list:
        first = inputs[0]["item_id"]
        if first % 7 == 0:
            raise ValueError(f"no {first}")
        if first % 3 == 0 and first not in job["tried"]:
            job["tried"].add(first)
            raise RuntimeError("not yet")
        with self.timed("scoring"):
            return [self.element(x["score"], job) for x in inputs]

    def element(self, x: float, job: dict) -> float | None:
        return None if x < 0.1 else x * job["factor"]

    def finish(self, inputs: list, outputs: list, job: dict) -> tuple[float, list]:
        return math.fsum(x for x in outputs if x is not None), outputs


_CHUNKED = """, placed as (select *, (row_number() over (order by item_id) - 1) // 64 as chunk from scores),
firsts as (select chunk, min(item_id) as first, count(*) as n, sum(score * 2) filter (score >= 0.1e0) as total, count(*) filter (score >= 0.1e0) as good from placed group by chunk),
job as (select *, case when first % 7 = 0 then 3 when first % 3 = 0 then 2 else 1 end as attempts, case when first % 7 = 0 then 'skipped' else 'processed' end as state from firsts)"""


def _job(s, d) -> DataFrame:
    rows = derive(s, d, "scores").select("item_id", F.struct("item_id", "score").alias("input"))
    return M.map_chunks(rows, Moody(), "input", args=2.0, size=64, order=["item_id"], chunk_output="double")


@query(sql(f"{_CHUNKED} select chunk, attempts, item_id as id, case when state = 'processed' and score >= 0.1e0 then score * 2 end as output, case when state = 'processed' and score >= 0.1e0 then 'processed' else 'skipped' end as status from placed join job using (chunk)", "scores"))
def chunk_retries(s, d):
    """Elements of chunks that are tried again, or skipped whole after the last attempt."""
    return M.elements(checkpointed(_job(s, d).select("chunk", "attempts", "elements")))


@query(sql(f"{_CHUNKED} select chunk, n, attempts, state as status, case when first % 7 = 0 then 'ValueError: no ' || first when first % 3 = 0 then 'RuntimeError: not yet' end as error, round(case when state = 'processed' then coalesce(total, 0) end, 6) as chunk_output from job", "scores"))
def chunk_outputs(s, d):
    """What post-processing makes of each chunk, and the last failure."""
    return checkpointed(_job(s, d).select("chunk", F.col("n").cast("long").alias("n"), "attempts", "status", "error", F.round("chunk_output", 6).alias("chunk_output")))


@query(sql(f"{_CHUNKED} select count(*) as chunks, sum(attempts)::bigint as attempts, sum(n)::bigint as n_total, sum(case when state = 'processed' then good else 0 end)::bigint as n_processed, sum(case when state = 'processed' then n - good else n end)::bigint as n_skipped from job", "scores"))
def job_counts(s, d):
    return checkpointed(M.job_counts(_job(s, d)))


@query(sql(f"{_CHUNKED} select kind, name, count(*) as n from job, (values ('timing', 'scoring'), ('timing', 'total_time'), ('workers', 'all')) t(kind, name) where state = 'processed' group by all", "scores"))
def job_profile(s, d):
    """How often each named timing was taken, and how many chunks all workers together have processed."""
    done = checkpointed(_job(s, d).select("worker", "status", "seconds", "timings"))
    timings = M.timing_profile(done).select(F.lit("timing").alias("kind"), "name", "n")
    return timings.unionByName(M.utilisation(done).agg(F.sum("chunks").alias("n")).select(F.lit("workers").alias("kind"), F.lit("all").alias("name"), "n"))


@query(sql(f", raw as (select item_id, list_dot_product(embedding::double[], {_WEIGHTS}::double[]) + 0.5e0 as score from emb) select * from raw", "emb"))
def model_inference(s, d):
    return M.infer(derive(s, d, "emb"), _WEIGHTS, 0.5).select("item_id", "score")


# Clusters


def _pages(s, d) -> DataFrame:
    ranking = _ranked(derive(s, d, "emb").select("item_id", F.col("label").cast("double").alias("dist")), "dot")
    paged = ranking.withColumn("page", F.floor(F.col("rank") / 100).cast("long"))
    return paged.join(derive(s, d, "emb").select("item_id", "embedding"), "item_id").select("page", "rank", "item_id", "embedding")


@query()
def ward_merges(s, d):
    return C.page_merges(_pages(s, d))


@query()
def ward_clusters(s, d):
    return C.page_clusters(_pages(s, d), 90)


@query()
def cluster_sizes(s, d):
    return C.by_size(C.page_clusters(_pages(s, d), 90), ("page", "cluster"))


@query()
def bisecting_clusters(s, d):
    return C.coarse_clusters(derive(s, d, "emb").select("item_id", "embedding"), 8).select("item_id", "leaf")


@query()
def whole_result_clusters(s, d):
    """Ward clusters of a whole result, over its clustering features."""
    ranking = _ranked(derive(s, d, "emb").select("item_id", F.col("label").cast("double").alias("dist")), "dot")
    return C.whole_clusters(ranking.join(derive(s, d, "emb").select("item_id", "embedding"), "item_id"), 80)


# Sources and sinks


@query(sql("select concat_ws(' ', case when is_val then 'val' else 'train' end, identifier, path) as value from items", "items"))
def image_list_lines(s, d):
    return image_lists.image_list_lines(derive(s, d, "items"))


@query(sql("select item_id, case when is_val then 'val_images/' else 'train_images/' end || string_split(path, '/')[-1] as export_path from items", "items"))
def export_paths(s, d):
    return image_lists.export_paths(derive(s, d, "items"))


@query(sql("select item_id, event_id from alog join items using (item_id)", "alog", "items"))
def import_by_path(s, d):
    items, log = derive(s, d, "items"), derive(s, d, "alog")
    number = F.col("item_id").cast("string")
    rows = log.join(items.select("item_id"), "item_id", "left_semi").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("id-"), number)).alias("identifier"), F.when(F.col("event_id") % 3 == 1, F.col("item_id")).alias("pk"),
        F.when(F.col("event_id") % 3 == 2, F.concat(F.lit("img/"), number, F.lit(".v1.jpg"))).alias("path"),
    )
    return A.resolve(rows, items).select("item_id", "event_id")


_IMPORTED = """, rows as (select event_id, item_id, category, mode, is_box, x1, y1, x2, y2, case when event_id % 3 = 0 then concat('id-', item_id) end as identifier,
  case when event_id % 3 = 1 then item_id + case when event_id % 13 = 0 then 1000000 else 0 end end as pk, case when event_id % 3 = 2 and event_id % 11 <> 0 then concat('img/', item_id, case when event_id % 5 = 0 then '' else '.v1.jpg' end) end as path,
  case when event_id % 17 = 0 then ' ' else category end as tag, case when event_id % 7 = 0 then null else x2 end as right_x from alog),
named as (select r.*, coalesce(a.item_id, b.item_id, c.item_id) as found, coalesce('i' || r.identifier, 'k' || r.pk, 'p' || r.path) as address from rows r
  left join items a on r.identifier = a.identifier left join items b on r.pk = b.item_id left join items c on r.path = c.path),
done as (select *, case when address is null then 'no address' when found is null then address[2:] || ' names no item' when trim(tag) = '' then 'no category or mode' when is_box and right_x is null then 'box without corners' end as error from named)"""


def _to_import(s, d) -> DataFrame:
    """Rows with addresses of all kinds, some of no item, some without a tag or a corner."""
    n, number = F.col("event_id"), F.col("item_id").cast("string")
    return derive(s, d, "alog").select(
        "event_id", F.when(n % 3 == 0, F.concat(F.lit("id-"), number)).alias("identifier"), F.when(n % 3 == 1, F.col("item_id") + F.when(n % 13 == 0, 1000000).otherwise(0)).alias("pk"),
        F.when((n % 3 == 2) & (n % 11 != 0), F.concat(F.lit("img/"), number, F.when(n % 5 == 0, "").otherwise(".v1.jpg"))).alias("path"),
        F.when(n % 17 == 0, " ").otherwise(F.col("category")).alias("category"), "mode", "is_box", "x1", "y1", F.when(n % 7 != 0, F.col("x2")).alias("x2"), "y2",
    )


@query(sql(f"{_IMPORTED} select event_id, case when error is null then found end as item_id, case when error is null then category end as category, case when error is null then mode end as mode, case when error is null then is_box end as is_box, error from done", "alog", "items"))
def import_with_refusals(s, d):
    """What is imported, and what is refused and why."""
    done = checkpointed(A.addressed(_to_import(s, d), derive(s, d, "items")))
    good = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    return done.select("event_id", "item_id", good("category"), good("mode"), good("is_box"), "error")


@query(sql(f"{_IMPORTED}, into_log as (select found as item_id, category, mode, is_box, 1000000 as batch_id from done where error is null and event_id % 4 = 0), every as (select item_id, category, mode, is_box, batch_id from alog union all from into_log), newest as (select *, max(batch_id) filter (not is_box) over (partition by item_id, category) as latest from every) select category, mode, is_box, batch_id = 1000000 as imported, count(*) as n from newest where (is_box or batch_id >= latest) and mode <> 'TOMBSTONE' group by all", "alog", "items"))
def import_into_log(s, d):
    """An import as one more replacing batch of the log, and the state in force after it."""
    added, _ = A.import_batch(_to_import(s, d).where("event_id % 4 = 0"), derive(s, d, "items"), 1000000, "me")
    after = A.current(derive(s, d, "alog").unionByName(added, allowMissingColumns=True))
    return after.groupBy("category", "mode", "is_box", (F.col("batch_id") == 1000000).alias("imported")).agg(F.count("*").alias("n"))


@query(sql("select 'm' as model, item_id as row_idx, item_id from items", "items"))
def register_output(s, d):
    items = derive(s, d, "items")
    return outputs.add_model_output(items, "m", paths=items.select(F.col("item_id").alias("row_idx"), "path"), embeddings="somewhere")


@query(sql("select item_id, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i from emb", "emb"))
def vector_codec(s, d):
    """Every vector through its text form and back."""
    emb = derive(s, d, "emb").withColumn("back", V.vectors_from_base64(V.vectors_to_base64(F.col("embedding"))))
    return emb.select("item_id", F.posexplode("back").alias("i", "x")).withColumn("i", F.col("i").cast("long"))


@query(sql("select row_number() over (order by item_id) - 1 as row_idx, case when is_val then 'val' else 'train' end as split, identifier, path from items", "items"))
def image_list_file(s, d):
    """An image list written in order of the item, a part a task, and read again, its lines numbered over all parts."""
    path = f"{checkpoint_folder(s)}/image-list-{uuid.uuid4()}"
    image_lists.write_image_list(derive(s, d, "items").orderBy("item_id"), path)
    return image_lists.read_image_list(s, path, large=True)


@query(sql("select row_number() over (order by item_id) - 1 as row_idx, path as line from items where not is_val", "items"))
def file_list(s, d):
    """Paths of training items, a blank line and those of validation items, written and read again: the list ends at the blank line."""
    path = f"{checkpoint_folder(s)}/file-list-{uuid.uuid4()}"
    lines = derive(s, d, "items").select("is_val", "item_id", F.concat(F.lit("  "), "path", F.lit("\t")).alias("value"))
    blank = s.createDataFrame([(True, -1, " \t")], "is_val boolean, item_id long, value string")
    lines.unionByName(blank).orderBy("is_val", "item_id").select("value").write.text(path)
    return image_lists.read_file_list(s, path, large=True)


def _local_folder(s: SparkSession) -> str:
    """A new folder among the intermediate tables, which readers and writers of plain files open as a mounted path."""
    folder = f"{checkpoint_folder(s).removeprefix('file:')}/files-{uuid.uuid4()}"
    os.makedirs(folder)
    return folder


@query(sql("select row_number() over (order by item_id) - 1 as row_idx, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i from emb", "emb"))
def embedding_matrix_file(s, d):
    """Embeddings in order of the item, written as a raw matrix and read again."""
    path = f"{_local_folder(s)}/embeddings.bin"
    ordered = running_totals(derive(s, d, "emb").select("item_id", "embedding"), ["item_id"], index="row_idx")
    first = ordered.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    matrices.write_embedding_matrix(ordered, path, first["dim"])
    found = matrices.read_embedding_matrix(s, path, first["n"])
    return found.select("row_idx", F.posexplode("embedding").alias("i", "x")).withColumn("i", F.col("i").cast("long"))


@query(sql("select row_number() over (order by item_id) - 1 as row_idx, score::float as score from val", "val"))
def score_file(s, d):
    """Scores in order of the item, written as an ``.npy`` array and read again."""
    path = f"{_local_folder(s)}/scores.npy"
    ordered = running_totals(derive(s, d, "val").select("item_id", "score"), ["item_id"], index="row_idx")
    matrices.write_scores(ordered, path, ordered.count())
    return matrices.read_scores(s, path)


@query(sql("select case when is_val then 'val/' else 'train/' end || item_id::varchar || '.jpg' as path, is_val from items where label <> 3", "items"))
def scanned_items(s, d):
    """A file for each item, some of another kind, found again by their directories."""
    folder = _local_folder(s)
    split = F.when(F.col("is_val"), "val/").otherwise("train/")
    name = F.concat(split, F.col("item_id").cast("string"), F.when(F.col("label") == 3, ".gif").otherwise(".jpg"))
    image_lists.write_files(derive(s, d, "items").select(name.alias("path"), F.encode("identifier", "UTF-8").alias("content")), folder)
    found = image_lists.scan_items(s, f"{folder}/train", f"{folder}/val")
    return found.select(F.concat_ws("/", F.element_at(F.split("path", "/"), -2), F.element_at(F.split("path", "/"), -1)).alias("path"), "is_val")


@query(sql(""", pixel as (select item_id, k, c, floor(abs(embedding[k + 1]::double) * (1000 + 37 * c))::bigint % 256 as v from emb, range(64) a(k), range(3) b(c)),
  shown as (select *, k // 8 as y, k % 8 as x from pixel where item_id % 3 = 0 or (item_id % 3 = 1 and k // 8 < 4 and k % 8 < 4) or (item_id % 3 = 2 and k // 8 >= 2 and k % 8 >= 2))
  select item_id, c as i, round(avg(v)::float::double, 2) as x from shown group by item_id, c""", "emb"))
def image_embeddings(s, d):
    """Vectors written as small colour images, decoded again, cropped by item and pooled."""
    folder = _local_folder(s)
    emb = derive(s, d, "emb").select("item_id", V.doubles(F.col("embedding")).alias("v"))
    value = lambda k: F.array(*(F.floor(F.abs(F.get("v", k)) * (1000 + 37 * c)) % 256 for c in range(3)))
    values = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), value)).cast("array<int>")
    images.write_images(emb.select(F.concat(F.col("item_id").cast("string"), F.lit(".png")).alias("path"), F.lit(8).alias("height"), F.lit(8).alias("width"), values.alias("values")), folder)
    found = images.read_images(s, folder).withColumn("item_id", F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long"))
    side = lambda a, b, c: F.element_at(F.array(*(F.lit(x) for x in (a, b, c))), (F.col("item_id") % 3 + 1).cast("int"))
    found = found.withColumn("crop", F.struct(side(0.0, 0.0, 0.25).alias("x1"), side(0.0, 0.0, 0.25).alias("y1"), side(1.0, 0.5, 1.0).alias("x2"), side(1.0, 0.5, 1.0).alias("y2")))
    pooled = M.embed_images(found, M.CroppedImages(images.pixels, lambda x: x, 3), crop_col="crop")
    return pooled.select("item_id", F.posexplode("embedding").alias("i", "x")).select("item_id", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 2).alias("x"))


# Streams


def _streamed(s, d, job, read=annotation_stream.latest_version, only: str = "true") -> DataFrame:
    """Runs a streaming job over all there is of the log, or what ``only`` says, and returns the newest state that it wrote."""
    folder = f"{checkpoint_folder(s)}/stream-{uuid.uuid4()}"
    key, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = s.conf.get(key)
    s.conf.set(key, rocks)
    try:
        job(derive(s, d, "alog", stream=True).where(only), f"{folder}/state", f"{folder}/offsets").awaitTermination()
    finally:
        s.conf.set(key, before)
    return read(s, f"{folder}/state")


@query(sql("select category, mode, count(*) as n from cur group by all", "cur"))
def stream_category_counts(s, d):
    return _streamed(s, d, annotation_stream.running_counts)


@query(sql("select category, mode, count(*) as n from cur group by all", "cur"))
def stream_counts_resumed(s, d):
    """Every other batch of the log compacted by a batch job, the others streamed on top of it."""
    start = checkpointed(annotation_stream.compacted(derive(s, d, "alog").where("batch_id % 2 = 0")))
    return _streamed(s, d, lambda log, target, offsets: annotation_stream.running_counts(log, target, offsets, start), only="batch_id % 2 = 1")


@query(sql("select item_id, category, mode, is_box, batch_id, count(*) as n from cur group by all", "cur"))
def stream_current_annotations(s, d):
    found = annotation_stream.in_force(_streamed(s, d, annotation_stream.current_annotations, annotation_stream.current_state))
    return found.groupBy("item_id", "category", "mode", "is_box", "batch_id").agg(F.count("*").alias("n"))
