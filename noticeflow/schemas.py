"""Explicit schemas; production reads infer none."""

from pyspark.sql import types as T

NOTICE = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("publication_date", T.StringType()),
    T.StructField("effective_date", T.StringType()),
    T.StructField("citation", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("pdf_downloaded", T.BooleanType()),
    T.StructField("pdf_path", T.StringType()),
    T.StructField("contains_eccn", T.BooleanType()),
    T.StructField("eccn_count", T.IntegerType()),
    T.StructField("eccns_found", T.StringType()),
    T.StructField("flagged_keywords", T.ArrayType(T.StringType())),
    T.StructField("flagged", T.BooleanType()),
])
NEWS = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("url", T.StringType()), T.StructField("date", T.DateType())
])
FETCH_LOG = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("status", T.IntegerType()),
    T.StructField("content_type", T.StringType()), T.StructField("content_length", T.LongType()),
])
DOCUMENT_PAGES = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("page_no", T.IntegerType()), T.StructField("text", T.StringType())
])
#: A snapshot as CSV has it: lists as JSON text.
SNAPSHOT_CSV = T.StructType([
    T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType) for f in NOTICE.fields
])
