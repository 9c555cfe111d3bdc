"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from ..functions.text import folded, let

__all__ = ["SPACE", "crc_mod", "documents", "folded", "in_order", "let", "nested", "orderable", "schema_of", "shared_dir", "spans", "stored"]

#: ASCII white space, the separators of words.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` where the session has one. Where it is unset, as in tests in
    local mode, a temporary folder is set for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="narrata-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    This cuts the lineage with a copy that survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def schema_of(ddl: str, fields) -> StructType:
    """The columns of ``ddl``, then ``fields`` as they are, whatever their names."""
    return StructType([*StructType.fromDDL(ddl).fields, *fields])


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(n))


def spans(text: Column, pattern: Column, group: int = 0) -> Column:
    """Leftmost non-overlapping matches of a pattern: array<struct<start, end, hit>>.

    Offsets count code points, the end is exclusive, and ``hit`` is the text of ``group``. The gaps
    between the matches and the matches themselves, laid end to end, give the offsets.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    both = F.arrays_zip(gaps.alias("gap"), found.alias("all"), *([F.regexp_extract_all(text, pattern, F.lit(group)).alias("hit")] if group else []))
    kind = "struct<start:int,end:int,hit:string>"

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["all"])
        return end, F.array(F.struct(start.alias("start"), end.alias("end"), x["hit" if group else "all"].alias("hit")))

    return F.when(F.regexp_like(text, pattern), folded(F.filter(both, lambda x: x["all"].isNotNull()), F.lit(0), step, kind)).otherwise(F.array().cast(f"array<{kind}>"))


def nested(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all columns of a row in ``_row``, where no name of theirs can clash with another."""
    return docs.select(*names, F.struct("*").alias("_row"))


def orderable(kind: DataType) -> bool:
    """Whether values of a type have an order: maps and variants, and what holds them, have none."""
    if isinstance(kind, StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    return orderable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def in_order(docs: DataFrame, *names: str) -> tuple[DataFrame, str]:
    """As ``nested``, and the name of the column that orders whole rows: ``_row`` itself, or where some column has no
    order, ``_tie``: the columns that have one, then a digest of the others as JSON."""
    if orderable(docs.schema):
        return nested(docs, *names), "_row"
    quoted = lambda f: F.col("`" + f.name.replace("`", "``") + "`")
    plain = [quoted(f).alias(f"_{i}") for i, f in enumerate(docs.schema.fields) if orderable(f.dataType)]
    rest = F.sha2(F.to_json(F.struct(*[quoted(f).alias(f"_{i}") for i, f in enumerate(docs.schema.fields) if not orderable(f.dataType)])), 256)
    return docs.select(*names, F.struct("*").alias("_row"), F.struct(*plain, rest.alias("_rest")).alias("_tie")), "_tie"
