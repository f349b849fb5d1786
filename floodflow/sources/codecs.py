"""JSON codecs and message-bus record shapes for the stream side.

The bus itself is pluggable: the message log (``sources/messages.py``) and
``readStream.format("kafka")`` frames carry the same ``key``/``value`` columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodflow import schemas

CORRUPT = "_corrupt_record"


def encode_record(df: DataFrame, key: str, value_cols: list[str]) -> DataFrame:
    """(key, value): key = the id as text, value = the JSON object; null fields
    are written as null, not left out."""
    return df.select(F.col(key).cast("string").alias("key"),
                     F.to_json(F.struct(*value_cols), {"ignoreNullFields": "false"}).alias("value"))


def decode_strict(text: Column | str, schema: T.StructType = schemas.EVENT,
                  optional: tuple[str, ...] = ()) -> Column:
    """Strict decode: a malformed record, one with anything after the object, with a
    field twice, or without a field that the schema names (null counts as absent,
    ``optional`` fields aside) fails the query. Texts may be null."""
    c = F.col(text) if isinstance(text, str) else text
    needed = [f.name for f in schema.fields if f.name not in optional]
    # from_json stops at the end of the object. Put inside another object, before the
    # checksum of itself, a text must be one whole value for the checksum to be found.
    whole = F.try_parse_json(F.concat(F.lit('{"e":'), c, F.lit(',"end":"'), F.md5(c), F.lit('"}')))
    more = c.isNotNull() & ~F.coalesce(F.try_variant_get(whole, "$.end", "string") == F.md5(c), F.lit(False))

    def complete(e: Column) -> Column:
        lacks = F.lit(False)
        for name in needed:
            lacks = lacks | e[name].isNull()
        return F.when(more, F.raise_error(F.lit("record is not one whole object"))) \
            .when(lacks, F.raise_error(F.lit("record without " + " or ".join(needed)))).otherwise(e)

    # transform of a one-element array parses the text once for all its uses.
    return F.transform(F.array(F.from_json(c, schema, {"mode": "FAILFAST"})), complete)[0]


def _u64(c: Column) -> Column:
    return c.isNull() | (c >= 0)


def decode_tolerant(df: DataFrame, text: str = "value",
                    schema: T.StructType = schemas.UPDATE_AS_READ,
                    required: tuple[str, ...] = ("refugees",)) -> DataFrame:
    """Tolerant decode: records that are not JSON objects, that have a field
    of the wrong type, miss a required field, or hold a negative count are
    dropped silently; unknown fields are ignored. Adds the schema's fields as
    columns and drops ``text``."""
    with_corrupt = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(F.col(text), with_corrupt,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    # explode of a one-element array materialises the parsed struct once; a
    # plain column would let the optimizer copy from_json into every
    # predicate below (one parse per referenced field).
    out = df.select("*", F.explode(F.array(parsed)).alias("_p"))
    ok = F.col("_p").isNotNull() & F.col(f"_p.{CORRUPT}").isNull()
    for f in schema.fields:
        c = F.col(f"_p.{f.name}")
        if f.name in required:
            ok = ok & c.isNotNull()
        if isinstance(f.dataType, (T.LongType, T.IntegerType)):
            ok = ok & _u64(c)
    return (out.where(ok)
               .select(*[c for c in df.columns if c != text],
                       *[F.col(f"_p.{f.name}").alias(f.name) for f in schema.fields]))


def encode_json(*cols: Column | str, keep_nulls: bool = True) -> Column:
    """JSON object text of the given columns; nulls are written as null."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false" if keep_nulls else "true"})


def events_from_records(records: DataFrame, schema: T.StructType = schemas.EVENT,
                        optional: tuple[str, ...] = ()) -> DataFrame:
    """Strictly decode a key/value record frame (a topic of the message log, or
    ``readStream.format("kafka")``) into event columns."""
    return (records.select(decode_strict(F.col("value").cast("string"), schema, optional).alias("e"))
                   .select("e.*"))
