"""Row shapes that operators exchange."""

from pyspark.sql import types as T

METADATA = T.StructType([T.StructField("source", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("file_type", T.StringType()), T.StructField("doc_name", T.StringType())])
#: One text file, or one page.
FRAGMENT = T.StructType([T.StructField("page_content", T.StringType()), T.StructField("metadata", METADATA)])
CHUNK_METADATA = T.StructType([*METADATA.fields, T.StructField("chunk_id", T.LongType()), T.StructField("chunk_index", T.IntegerType())])
CHUNK = T.StructType([T.StructField("text", T.StringType()), T.StructField("metadata", CHUNK_METADATA)])
#: The longest text, in bytes, that a collection takes.
MAX_TEXT_BYTES = 65535
