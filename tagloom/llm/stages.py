"""The stages of corpus_pipeline: (spark, docs, sf_dir) -> DataFrame each.

All but the last return the columns of ``docs``, whatever they are besides doc_id and text.
Repeated rows are never multiplied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language compression cannot tell: without a letter, or with a narrow margin."""
    from . import langid

    dictionaries = langid.learn(docs)
    names = docs.columns
    own = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text = f"c{names.index('text')}"
    found = langid.identify(own, dictionaries, text_col=text, keep=own.columns)
    return found.filter("accepted").select(*own.columns).toDF(*names)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, that of least doc_id; rows without an id come after all others.

    Rows of one doc_id with equal texts are one document: one of them stays, even if other columns differ.
    """
    from .ngramjoin import near_duplicates
    from .workspace import Workspace, free_name, quoted

    space, key, names = Workspace(spark, "stage4"), free_name(docs.columns, "key"), [quoted(c) for c in docs.columns]
    nulls = docs.filter("doc_id is null")
    keyed = docs.withColumn(key, F.col("doc_id").cast("long"))
    if not nulls.isEmpty():
        # numbers beyond all ids, fixed by writing them
        nulls = space.write(nulls.withColumn(key, F.monotonically_increasing_id() + F.lit(1 << 62)), "nulls")
        keyed = keyed.filter("doc_id is not null").unionByName(nulls)
    found = space.write(near_duplicates(keyed, id_col=key).select(F.col("doc_id").alias(key), "component_id"), "found")
    others = found.filter(F.col(key) != F.col("component_id")).select(key).distinct()
    kept = keyed.join(others, key, "left_anti")
    # several rows of one doc_id: of those with equal text one stays, whatever their other columns hold
    twice = found.groupBy(key).count().filter("count > 1").select(key)
    if twice.isEmpty():
        return kept.select(*names)
    once = kept.join(twice, key, "left_anti")
    return once.select(*names).union(kept.join(twice, key, "left_semi").dropDuplicates([key, "text"]).select(*names))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut words of repeated passages out of the texts; all else stays as it is, to the byte."""
    from .substr import repeats

    found, columns = repeats(docs, layout=True, keep=docs.columns), []
    changed = F.col("n_removed") > 0
    for i, field in enumerate(docs.schema.fields):
        now = F.col(f"keep_{i}")
        if field.name == "text":
            now = F.when(changed, F.col("kept_text")).otherwise(now)
        elif field.name == "n_chars":
            now = F.when(changed, F.length("kept_text")).otherwise(now).cast(field.dataType)
        columns.append(now.alias(field.name))
    return found.select(*columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a copy of a test item, edited or not; rows without an id are told apart."""
    from .decontam import matches
    from .workspace import Workspace, free_name, quoted

    items, key = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), free_name(docs.columns, "key")
    nulls = docs.filter("doc_id is null")
    keyed = docs.withColumn(key, F.col("doc_id").cast("long"))
    if not nulls.isEmpty():
        nulls = Workspace(spark, "stage9").write(nulls.withColumn(key, F.monotonically_increasing_id() + F.lit(1 << 62)), "nulls")
        keyed = keyed.filter("doc_id is not null").unionByName(nulls)
    leaks = matches(keyed, items, id_col=key).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(leaks, key, "left_anti").select(*map(quoted, docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    import public_tokenizers

    from .packing import pack

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]
