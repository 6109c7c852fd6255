"""A training corpus from the table documents: language ID, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame; ``run`` writes
each as Parquet in the shared folder and reads it back as the next one's docs. All but the last return the columns of
documents. No SQL expresses them; tests hold each stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cipherscope import ship
from cipherscope.llm.common import stage, table
from cipherscope.llm.jaccard import jaccard_components, text_nodes
from cipherscope.llm.langid import UND, fit, labelled
from cipherscope.llm.packing import pack
from cipherscope.llm.registry import MIXTURE, held_out, tokenizer_path
from cipherscope.llm.repeats import remove_spans, repeated_spans

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without words of a learned language (a null text, or no letters); where no row has a language to
    learn, those without letters."""
    model = fit(docs, held_out())
    found = labelled(docs, held_out(), model)
    text = F.col(f"c_{docs.columns.index('text')}")
    kept = F.col("lang_pred") != UND if model.languages else F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return found.where(kept).select([F.col(f"c_{i}").alias(c) for i, c in enumerate(docs.columns)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row, by doc_id (a null first), of each group of texts that five-word shingles link. Several texts of
    one doc_id, also of the null, are documents of their own, in the order of a hash; equal rows are one."""
    rows, several = text_nodes(docs, F.struct("*").alias("row"))
    texts = rows.dropDuplicates(["node"]) if several else rows
    found = jaccard_components(texts.select(F.col("node").alias("doc"), "text"))
    keep = stage(found.where("doc = component").select(F.col("doc").alias("node")), "pipeline-kept")
    kept = rows.join(keep, "node", "left_semi")
    if several:
        first = Window.partitionBy("node").orderBy(F.xxhash64(F.to_json("row")))
        kept = kept.withColumn("place", F.row_number().over(first)).where("place = 1")
    return kept.select("row.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out strings of 100 bytes that stand earlier too (and counts n_chars anew); a document of which nothing but
    blanks is left goes. Other columns stay, whatever their names."""
    names = {c: f"c_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    rest = remove_spans(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in names.items()]), repeated_spans(docs), keep=list(names.values()))
    rest = rest.where((F.col("n_removed") == 0) | F.col("rest").rlike(r"\S"))
    changed = {"doc_id": F.col("doc_id"), "text": F.col("rest"), "n_chars": F.length("rest").cast("long")}
    return rest.select([changed[c].alias(c) if c in changed else F.col(names[c]).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens, every source at its share of the mixture while it lasts."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2, targets=MIXTURE)


def _shipped(step):
    return lambda spark, docs, sf_dir: step(ship(spark), docs, sf_dir)


STAGES = [(f.__name__, _shipped(f)) for f in (language, near_duplicates, repeats, packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
