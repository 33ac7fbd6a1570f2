"""From documents to training tokens: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import bpe, mixing, toxicity
from quillmesh.llm.jaccard_join import first_of_groups
from quillmesh.llm.shared import stage, table, words_of
from quillmesh.llm.substring_dedup import remove_repeats

_REST = "_qm_rest"


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one, so that no name of theirs meets one that an operator makes."""
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]).alias(_REST))


def _unpacked(rows: DataFrame, columns: list[str], **made: Column) -> DataFrame:
    """The columns of documents again, those in ``made`` as they say."""
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")} | made
    return rows.select(*[own.get(c, F.col(_REST)[c]).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the model learns from all labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _unpacked(toxicity.score(_packed(docs), model, ["text", _REST]).where("score < 0.5"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of five-word Jaccard 0.8 the document of the smallest id stays.

    A null id comes last, and of an id's texts the first by digest.  Documents without words all
    stay, and so do rows that share an id but not their words.
    """
    return first_of_groups(docs, n=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 20 words are cut; texts become their words left, documents all stay."""
    text = F.col("kept_text")
    made = {"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {}
    return _unpacked(remove_repeats(_packed(docs), window=20, carry=[_REST]), docs.columns, text=text, **made)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    sized = _packed(docs).withColumns({"source": F.col(_REST)["source"], "size": F.size(words_of(F.col("text"))).cast("long")})
    return _unpacked(mixing.emit(mixing.mix(sized)), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of them and of what they decode to."""
    out = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"))
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return out.select("doc_id", "lang", "source", n, "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: No stage but mixing has a form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.split()[0])
    return docs
