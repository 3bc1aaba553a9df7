"""Pipeline stages over whole rows, by a key of their own.

A decision of an operator is made for a document and takes effect on its row.
``doc_id`` alone can't tell rows apart where it is null or repeats, so a stage
gives every row a key: its doc_id, or, where that is null or several rows have
it, a number beyond all ids from a hash of id and text.  Rows of one key are
then equal in id and text, and rows that share only their id are documents of
their own, which come after those with an id of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import contaminated
from .near_dedup import near_duplicates
from .substring_dedup import remove_repeats

#: Keys from here on are not ids (ids are expected to be smaller).
BEYOND = 1 << 62
#: Repeated ids that are broadcast; more are joined.
FEW = 100_000
WORD = r"[^\x20\x09-\x0D]"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (the key), text, and ``rest``: the other columns of ``docs`` as ``own``, and whether the text is null as ``none``.

    The texts are shuffled only where more than FEW ids repeat.
    """
    others = [F.col(c) for c in docs.columns if c != "text"]
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"), F.struct(F.struct(*others).alias("own"), F.col("text").isNull().alias("none")).alias("rest"))
    mark = F.xxhash64(F.col("_id"), F.coalesce("text", F.lit("")), F.col("text").isNull()).bitwiseAND(F.lit((1 << 61) - 1))
    alone = F.col("_id").isNotNull()
    repeated = rows.where("_id is not null").groupBy("_id").count().where("count > 1").select(F.col("_id").alias("_many"))
    n = repeated.limit(FEW + 1).count()
    if n:
        rows = rows.join(F.broadcast(repeated) if n <= FEW else repeated, F.col("_id") == F.col("_many"), "left")
        alone = alone & F.col("_many").isNull()
    return rows.select(F.when(alone, F.col("_id")).otherwise(mark.bitwiseOR(F.lit(BEYOND))).alias("doc_id"), "text", "rest")


def odd_ids(docs: DataFrame) -> bool:
    """Whether any id is null or repeats."""
    ids = docs.select(F.col("doc_id").cast("long").alias("_id"))
    return not (ids.where("_id is null").isEmpty() and ids.groupBy("_id").count().where("count > 1").isEmpty())


def whole(rows: DataFrame, columns: list[str], **new) -> DataFrame:
    """The ``columns`` that ``keyed`` was given, ``new`` ones in place of theirs."""
    text = F.when(~F.col("rest.none"), F.col("text"))
    return rows.select(*(new.get(c, text if c == "text" else F.col("rest.own")[c]).alias(c) for c in columns))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of one document of each group of near duplicates, that of the smallest key.

    Of rows equal in id and text one stays, the smallest, if they have words;
    texts without words, null ones too, are nobody's duplicate and all stay.
    """
    rows = keyed(docs)
    gone = near_duplicates(rows).where("not kept").select("doc_id").distinct()
    left = rows.join(gone, "doc_id", "left_anti")
    several = (F.col("doc_id") >= BEYOND) & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    if not odd_ids(docs):
        return whole(left, docs.columns)
    once = left.where(several).groupBy("doc_id").agg(F.min(F.struct("text", "rest")).alias("row")).select("doc_id", "row.*")
    return whole(left.where(~several).unionByName(once), docs.columns)


def without_repeats(docs: DataFrame) -> DataFrame:
    """All rows, without the words of passages that a row of a smaller key has; n_chars, if there, is the new text's.

    A text that loses all its words stays as an empty one; one that loses none is unchanged.
    """
    out = remove_repeats(keyed(docs), keep=["rest"]).select("n_removed", "text", "row.rest")
    new = {}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest.own.n_chars"))
    return whole(out, docs.columns, **new)


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that contain no benchmark item."""
    rows = keyed(docs)
    found = contaminated(rows, benchmark).select("doc_id").distinct()
    return whole(rows.join(found, "doc_id", "left_anti"), docs.columns)
