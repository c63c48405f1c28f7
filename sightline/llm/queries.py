"""Registered queries of the training-data operators, and their DuckDB equivalents where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, decontam, embed_dedup, html_extract, jaccard_join, language, licenses, packing, pii, quality, sharding, spelling
from .common import table

N_SHARDS = 40


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "n_item", "n_shared")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.maximal_conversations(table(spark, sf_dir, "conversations"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.byte_shards(table(spark, sf_dir, "documents"), N_SHARDS)
    return placed.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages")).withColumnRenamed("key", "page_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    kept = F.coalesce(F.col("key") == F.col("component"), F.lit(False))
    return found.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.centroid_clusters(table(spark, sf_dir, "embeddings"))
    return found.drop("n_cluster").withColumnRenamed("key", "vec_id")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.text_languages(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


QUERIES = {f.__name__: f for f in (op1_quality, op2_decontamination, op3_chat, op4_licenses, op5_packing, op6_sharding, op7_html, op8_pii, op9_jaccard_join, op10_embedding_dedup, op11_centroids, op12_spelling, op13_language)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(name: str, source: str, key: str) -> str:
    """CTEs: ``name`` (key, s), the distinct five-word shingles of each row."""
    return f"""{name}_words as (select {key}, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from {source}),
{name} as (select distinct {key}, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from {name}_words)"""


def _license_sql() -> str:
    values = ", ".join(f"('{k}', '{v}')" for k, v in licenses.SENTENCES.items())
    rules = ", ".join(f"({n}, '{'.*'.join(f' {x} ' for x in need)}', '{name}')" for n, (need, name) in enumerate(licenses.RULES))
    shortest = min(map(len, licenses.SENTENCES))
    norm = "trim(regexp_replace(lower(%s), '[^a-z0-9]+', ' ', 'g'))"
    whole = norm % "piece"
    for pattern, words in licenses.HOLDERS:
        whole = f"regexp_replace({whole}, '{pattern}', '{words}')"
    words = ", ".join(f"'{x}'" for x in licenses.first_words(list(licenses.SENTENCES)))
    return f"""with known(sentence, name) as (values {values}), rules(rule_no, pattern, license) as (values {rules}),
pieces as (select doc_id, unnest(p) as piece, generate_subscripts(p, 1) as i from
  (select doc_id, regexp_split_to_array(coalesce(text, ''), '[.!?;:][)"''\\]]*(?:\\s+|$)|\\n[^A-Za-z0-9\\n]*\\n') as p from documents)),
whole as (select doc_id, i, piece, name from pieces left join known on {whole} = sentence where length(piece) >= {shortest}),
lines as (select doc_id, i, list_filter(list_transform(string_split(piece, chr(10)), lambda x: {norm % "x"}), lambda x: x <> '') as l from whole where name is null and contains(piece, chr(10))),
begins as (select doc_id, i, l, unnest(range(1, len(l) + 1)) as j from lines),
spans as (select doc_id, i, l, j, unnest(range(j, least(len(l), j + {licenses.most_lines(list(licenses.SENTENCES))} - 1) + 1)) as e from begins where split_part(l[j], ' ', 1) in ({words})),
runs as (select doc_id, i, j, max(e) as e, arg_max(name, e) as name from spans join known on array_to_string(l[j:e], ' ') = sentence group by doc_id, i, j),
ids as (select doc_id, i, 0 as j, name from whole where name is not null
  union all select doc_id, i, j, name from runs r where not exists (select 1 from runs o where o.doc_id = r.doc_id and o.i = r.i and o.j < r.j and o.e >= r.e)),
found as (select doc_id, count(*) as n, string_agg(name, ',' order by i, j) as ids, ' ' || string_agg(name, '  ' order by i, j) || ' ' as seq from ids group by doc_id),
first_hit as (select doc_id, license, min(rule_no) as rule_no from found join rules on regexp_matches(seq, pattern) group by all),
hits as (select doc_id, string_agg(license, ',' order by rule_no) as licenses from first_hit h
  where not (license = 'BSD-2-Clause' and exists (select 1 from first_hit o where o.doc_id = h.doc_id and o.license = 'BSD-3-Clause')) group by doc_id)
select doc_id, coalesce(n, 0) as n_sentences, coalesce(ids, '') as sentence_ids, coalesce(licenses, '') as licenses
from documents left join found using (doc_id) left join hits using (doc_id)"""


def _centroid_sql() -> str:
    """The rounds one after the other: z0 holds the first centroids, a0 the assignment to them, z1 what that moves them to."""
    k, rounds, d = centroids.CENTROIDS, centroids.ROUNDS, centroids.DIMENSIONS
    steps = [f"""e as materialized (select row_number() over () as i, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::double)::hugeint) as v from embeddings
  where embedding is not null and len(embedding) = {d} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
z0 as materialized (select row_number() over (order by sha256('2:' || vec_id), v) - 1 as c, v from (select * from e where vec_id is not null order by sha256('2:' || vec_id), v limit {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} as materialized (select i, any_value(vec_id) as vec_id, min({{'s': s, 'c': c}}) as best from
  (select e.i, e.vec_id, z.c, list_sum(list_transform(list_zip(e.v, z.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as s from e cross join z{r} z) group by i)""")
        if r < rounds:
            steps.append(f"""m{r} as (select c, p, sum(x) as s, count(*) as n from (select best['c'] as c, unnest(e.v) as x, generate_subscripts(e.v, 1) as p from a{r} join e using (i)) group by c, p),
n{r} as (select c, list((s - ((s % n) + n) % n) // n order by p) as v from m{r} group by c),
z{r + 1} as materialized (select c, coalesce(n{r}.v, z{r}.v) as v from z{r} left join n{r} using (c))""")
    return f"""with {", ".join(steps)}
select vec_id, c::int as cluster, s::bigint as distance, (sum(s) over (partition by c))::bigint as cluster_inertia, (sum(s) over ())::bigint as inertia, sha256(array_to_string(v, ',')) as centroid_sha256
from (select vec_id, best['c'] as c, best['s'] as s from a{rounds}) join z{rounds} using (c)"""


ORACLES = {
    "op11_centroids": _centroid_sql(),
    "op2_decontamination": f"""with {_shingles("d", "documents", "doc_id")}, {_shingles("b", "benchmark", "item_id")},
sizes as (select item_id, count(*) as n_item from b group by item_id)
select doc_id, item_id, any_value(n_item) as n_item, count(*) as n_shared from d join b using (s) join sizes using (item_id)
group by doc_id, item_id having 100 * count(*) >= 75 * any_value(n_item)""",
    "op3_chat": """with d as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
t as (select *, case when conv_id is null then row_number() over () end as alone from d),
p as (select conv_id, row_number() over w as k, count(*) over (partition by conv_id, alone) as n,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') over (partition by conv_id, alone order by turn nulls first, role, text rows unbounded preceding) as text
  from t window w as (partition by conv_id, alone order by turn nulls first, role, text)),
whole as (select text, min(conv_id) as conv_id, count(*) as n_copies, any_value(n) as n_turns from p where k = n group by text)
select conv_id, n_turns, n_copies, text from whole where not exists (select 1 from p where p.text = whole.text and p.k < p.n)""",
    "op4_licenses": _license_sql(),
    "op9_jaccard_join": f"""with recursive {_shingles("d", "documents", "doc_id")},
sizes as (select doc_id, count(*) as n from d group by doc_id),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as k from d x join d y on x.s = y.s and x.doc_id < y.doc_id group by all),
links as (select a, b from shared join sizes sa on a = sa.doc_id join sizes sb on b = sb.doc_id where 100 * k >= 75 * (sa.n + sb.n - k)),
sides as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from documents union select doc_id, sides.b from reach join sides on other = sides.a)
select doc_id, coalesce(any_value(n), 0) as n_shingles, min(other) as component_id from reach left join sizes using (doc_id) group by doc_id""",
    "op10_embedding_dedup": """with recursive e as (select vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
u as (select vec_id, v, list_dot_product(v, v) as q from e where list_dot_product(v, v) > 0),
links as (select x.vec_id as a, y.vec_id as b from u x join u y on x.vec_id <> y.vec_id and len(x.v) = len(y.v)
  where list_dot_product(x.v, y.v) >= 0.95e0 * sqrt(x.q) * sqrt(y.q)),
reach(vec_id, other) as (select vec_id, vec_id from embeddings union select reach.vec_id, b from reach join links on other = a),
n as (select a as vec_id, count(*) as n_links from links group by a)
select vec_id, coalesce(any_value(n_links), 0)::bigint as n_links, min(other) as component_id, vec_id = min(other) as kept
from reach left join n using (vec_id) group by vec_id""",
}
