"""The schemas of the public frames."""

from pyspark.sql import types as T

PIECE = T.StructType([T.StructField("text", T.StringType(), False), T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)])
CHUNK_FIELDS = [
    T.StructField("chunk_index", T.IntegerType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("start", T.IntegerType(), False),
    T.StructField("end", T.IntegerType(), False),
    T.StructField("token_count", T.IntegerType(), False),
    T.StructField("context", T.StringType(), False),
]
#: A row of the index: a chunk, its vector and its label. Empty strings stand for what is not given.
RECORD = T.StructType([*CHUNK_FIELDS[1:], T.StructField("vector", T.ArrayType(T.FloatType(), False), False), T.StructField("source", T.StringType(), False)])
