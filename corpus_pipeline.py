"""Documents to training sequences in five stages; each works on all that the one before kept.

Stages: language ID drops texts without a language (`und`); near-duplicates keep one document of each component; personal data is masked in
the text; mixing repeats or drops documents for the target weights of their sources (a document stands once for each copy taken); packing
gives the pieces of the sequences. All but the last return the columns of documents, with n_chars of the new text.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemetrics.llm import langid, mixing, neardup, packing, pii
from sitemetrics.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was found; the predicted one becomes their lang."""
    found = langid.predict(docs, langid.fit(docs)).filter("lang_pred <> 'und'")
    return _documents(found.withColumn("lang", F.col("lang_pred")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each component of near-duplicates."""
    return _documents(neardup.keep_first(docs))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    return _documents(pii.mask(docs).withColumn("n_chars", F.length("text").cast("long")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(docs).filter("mix_copies > 0 or mix_size = 0")
    # A text without words is of size 0 whatever the copies: it stays once.
    times = F.greatest(F.col("mix_copies"), F.lit(1)).cast("int")
    return _documents(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), times))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    return packing.op10(docs)


STAGES = [("language_id", identify), ("near_duplicates", deduplicate), ("personal_data", redact), ("mixing", mix), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
