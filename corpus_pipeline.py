"""The corpus pipeline: language identification, near duplicates, benchmark decontamination, personal data, tokens.

Each stage takes what the one before kept and returns the columns of documents (the last returns tokens). Rows and
columns that a stage doesn't decide on pass as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.llm import bpe, decontam, langid, ngram_join, pii
from loomspan.llm.memory import small_batches
from loomspan.operators.tables import new_path, passing, removed, settled, ship, written

#: A document goes if it has no letter, or if its best language's score times the share of its trigrams that learning met
#: is less than this part of the value that all but one in a thousand of the labelled texts kept from learning have.
LANGUAGE_PART, LANGUAGE_QUANTILE = 0.6, 0.001
#: A share counted over few trigrams is uncertain: the bound is lower by this over the root of the text's bytes, about three standard errors.
LANGUAGE_ERRORS = 1.5


def _carried(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with all columns but id and text under names that clash with nothing, and these names."""
    names = {c: f"carried_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def _restored(df: DataFrame, names: dict[str, str], columns: list[str]) -> DataFrame:
    back = names | {"doc_id": "id", "text": "text"}
    return df.select(*(F.col(back[c]).alias(c) for c in columns))


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _own(docs: DataFrame) -> list:
    """The columns of the documents, whatever their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language, and fills a missing ``lang``, the column that it learns from.

    Null and empty texts and texts without a letter go; very long ones are judged whole. Repeated rows and null ids stay
    as they are; without labels in the table every text is in no learned language and goes; an empty table stays empty.
    """
    ship(spark)
    small_batches(spark)
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    net = langid.train(docs.where(fold != 1).select("text", "lang", F.xxhash64("doc_id").alias("h")))
    moved, names = _carried(docs)
    sure = F.col("score") * F.col("known")
    held_out = langid.predict(docs.where((fold == 1) & F.col("lang").isNotNull()).select("doc_id", "text", "lang"), net, carry=["lang"])
    low = held_out.where("lang_pred = lang").agg(F.percentile_approx(sure, F.lit(LANGUAGE_QUANTILE), F.lit(10_000))).first()[0]
    found = langid.predict(moved, net, carry=list(names.values()))
    bound = LANGUAGE_PART * (low or 0.0) - LANGUAGE_ERRORS / F.sqrt(F.octet_length("text"))
    kept = found.where((F.col("lang_pred") != "und") & (sure >= bound))
    return _restored(kept.withColumn(names["lang"], F.coalesce(names["lang"], "lang_pred")), names, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest id, a null id last.

    Rows are told apart by a 64-bit hash of id and text, so that rows of one id with unrelated texts all stay, and of rows that repeat
    both one does. Null, empty and blank texts are nobody's duplicates and all stay. Very long texts count whole; an
    empty table gives an empty one; ties go by the row's key.
    """
    ship(spark)
    small_batches(spark)
    key, rank = _fresh(docs, "__key"), _fresh(docs, "__rank")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    groups = settled(spark, lambda: ngram_join.jaccard_components(keyed.select(key, "text"), id_col=key), "groups")
    of = groups.where("n_shingles > 0").groupBy("id", "component").agg(F.count("*").alias("times"))
    named = of.join(keyed.select(F.col(key).alias("id"), "doc_id").distinct(), "id")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id", "times")).alias("x")).select(F.col("x.id").alias(key), "x.times")
    first = written(first, "first")
    once = keyed.join(first.where("times = 1").select(key), key, "left_semi")
    same = Window.partitionBy(key).orderBy(F.to_json(F.struct(*_own(docs))))
    again = keyed.join(first.where("times > 1").select(key), key, "left_semi").withColumn(rank, F.row_number().over(same)).where(F.col(rank) == 1).drop(rank)
    blank = keyed.join(groups.where("n_shingles = 0").select(F.col("id").alias(key)).distinct(), key, "left_semi")
    return once.unionByName(again).unionByName(blank).select(*_own(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage.

    Null and empty texts hold none and stay; very long texts are searched whole; rows that repeat an id go or stay
    together, rows with a null id by their text; an empty table or benchmark drops nothing.
    """
    ship(spark)
    small_batches(spark)
    key = _fresh(docs, "__key")
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("no id: "), F.sha2("text", 256))))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = settled(spark, lambda: decontam.contaminated(keyed, bench, id_col=key).select(F.col("id").alias(key)).distinct(), "leaks")
    return keyed.join(leaks, key, "left_anti").select(*_own(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and the terms that give it away, in the texts; ``n_chars`` is counted anew.

    Every row stays, with repeated rows, null ids and null, empty or very long texts as they are but for the
    replacements (a null text becomes empty); an empty table stays empty.
    """
    ship(spark)
    small_batches(spark)
    moved, names = _carried(docs)
    clean = pii.sanitised(pii.find(moved, keep_text=True, carry=tuple(names.values())))
    if "n_chars" in names:
        clean = clean.withColumn(names["n_chars"], F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return _restored(clean, names, docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, ids_sha256, decoded_sha256)`` of every document; null and empty texts have no tokens, repeated rows and null ids stay, very long texts are encoded whole."""
    import public_tokenizers

    ship(spark)
    small_batches(spark)
    out = bpe.with_ids(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("ids",))
    return out.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: Trained models and tokenizers are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again; what a stage has read or left goes when its result is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with passing(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
