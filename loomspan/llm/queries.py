"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loomspan.llm.bpe import with_ids

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = with_ids(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=())
    return out.withColumnRenamed("id", "doc_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.pii import digest, find

    return digest(find(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loomspan.llm.token_files import read_corpus, write_corpus

    manifest = write_corpus(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_corpus(manifest, tokens=False).withColumnRenamed("id", "doc_id")


def op6_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), lambda id_: id_ % 20 == 0).withColumnRenamed("id", "vec_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.ngram_join import jaccard_components

    out = jaccard_components(_table(spark, sf_dir, "documents"))
    return out.selectExpr("id as doc_id", "n_shingles", "component as component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from loomspan.llm.warc import archive, lookup, url_key

    pages = _table(spark, sf_dir, "pages")
    read = lookup(archive(pages), pages.select(url_key(F.col("url")).alias("key")), payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspan.llm.decontam import contaminated

    found = contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from loomspan.llm.whitening import whiten

    rows = _table(spark, sf_dir, "embeddings")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    far = float(1 << 53)
    vector = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(64 * x.cast("double"), F.lit(-far)), F.lit(far))) + 1_000_000)
    out = whiten(rows.where(finite).select("vec_id", vector.alias("vector")))
    return out.withColumn("deviation", F.expr("try_cast(deviation as long)")).withColumnRenamed("id", "vec_id")


def op12_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from loomspan.llm.hmm import score

    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10
    out = score(_table(spark, sf_dir, "documents"), fold != 0)
    return out.select(F.col("id").alias("doc_id"), (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_shared_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from loomspan.llm.negatives import mine

    rows = _table(spark, sf_dir, "embeddings")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    rows = rows.where(finite).select("vec_id", label.alias("label"), vector.alias("vector"))
    out = mine(rows, F.col("vec_id") % 50 == 0)
    return out.withColumnsRenamed({"anchor": "anchor_id", "positive": "positive_id", "negative": "negative_id"})


OP9_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first from p)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to from f
"""

OP8_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as sh
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0)
), n as (select doc_id, count(*) as n from s group by 1
), p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2
), links as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 75 * (nx.n + ny.n - c)
), reach as (select doc_id as a, doc_id as b from documents union select a, y from reach join links on b = x
)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, r.c as component_id
from documents d left join n using (doc_id) join (select a, min(b) as c from reach group by 1) r on r.a = d.doc_id
"""

OP13_SQL = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as a, b.vec_id as b, a.label = b.label as same, cast(list_inner_product(cast(a.v as double[]), cast(b.v as double[])) as bigint) as score from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
), p as (select * from (select *, row_number() over (partition by a order by score desc, b) as r from s where same) where r <= 5
), n as (select p.a, p.b as p, s.b as n, p.score as ps, s.score as ns, row_number() over (partition by p.a, p.b order by s.score desc, s.b) as rank from p join s on s.a = p.a and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select a as anchor_id, p as positive_id, cast(rank as int) as rank, n as negative_id, ps as positive_score, ns as negative_score from n where rank <= 3
"""

QUERIES = {
    "op1_line_blocks": op1_line_blocks,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_pii": op3_pii,
    "op4_language_id": op4_language_id,
    "op5_token_files": op5_token_files,
    "op6_kmeans_tree": op6_kmeans_tree,
    "op7_quality": op7_quality,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_warc": op9_warc,
    "op10_decontamination": op10_decontamination,
    "op11_whitening": op11_whitening,
    "op12_hidden_markov": op12_hidden_markov,
    "op13_shared_lists": op13_shared_lists,
}

ORACLE_SQL = {"op8_ngram_jaccard_join": OP8_SQL, "op9_warc": OP9_SQL, "op13_shared_lists": OP13_SQL}
