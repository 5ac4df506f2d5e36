"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  A stage works on all that the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import linededup, minhash, packing, toxicity
from driftloom.llm.names import unused
from driftloom.plans.lineage import discard, shared_folder
from driftloom.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5, learnt from labels outside the held-out fold.

    Null and empty texts are scored like any other; without labels nothing is learnt, and
    then the score says nothing and every document stays.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(~toxicity.held_out())
    weights = toxicity.train(docs, labels)
    if not len(weights[0]):
        return docs
    score = unused(docs, "score")
    return toxicity.score(docs, weights, score_col=score).where(F.col(score) < 0.5).drop(score)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that at least three of them share, but for the document with the largest id.

    ``n_chars`` follows the text where lines went.  No document goes, even if no line of it stays; its text is then empty.

    - Null and empty texts are one empty line, which stays, and become empty texts.  A row with a null id loses no line.
    - Lines of under 20 code points stay.  Of rows that share an id each is cleaned by itself, and they count as one document.
    - Very long texts are cleaned whole.  An empty table gives an empty table.
    """
    lines, dropped = unused(docs, "n_lines"), unused(docs, "n_dropped")
    clean = linededup.drop_repeated_lines(docs, lines_col=lines, dropped_col=dropped)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col(dropped) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.drop(lines, dropped)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by shingles of four words, the one with the smallest id.

    Rows with a null id stay; of rows with one id and equal texts one stays.

    - Null, empty and blank texts are like nothing else, so all of them stay.
    - Texts of fewer than four words are compared as a whole.  Very long texts are compared whole.
    - Of repeated texts under different ids the one with the smallest stays, whatever their number.
    - An empty table gives an empty table.
    """
    kept = minhash.near_duplicates(docs, width=4, percent=80).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    some = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return some.unionByName(docs.where("doc_id IS NULL"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a sequence of at most 4096 tokens.

    - Null and empty texts are one piece, the end token.  Null ids stay null.
    - Documents of more than 4096 tokens, however long, are cut into full pieces and a last one; repeated rows are packed each by itself.
    - Which of equally good packings comes out is open.  An empty table gives an empty table.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash_dedup", drop_near_copies),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder as Parquet and read by the next.

    What the next stage has read is deleted once that one is written too.  The last stage reads its input when it runs, so that stays.
    """
    docs, folder, before = table(spark, sf_dir, "documents"), shared_folder(spark), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            discard(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the toxicity model, the near-duplicate search or the packing.
ORACLE_SQL = None
