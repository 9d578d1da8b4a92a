"""Fixed row shapes. Jobs declare them; nothing is inferred from data."""

from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("content", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("source", T.StringType()),
    T.StructField("doc_type", T.StringType()),
])

ELEMENT = T.StructType([
    T.StructField("element_index", T.IntegerType()),
    T.StructField("element_type", T.StringType()),
    T.StructField("text", T.StringType()),
])

CHUNK = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("start_char", T.IntegerType()),
    T.StructField("end_char", T.IntegerType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

EMBEDDED_CHUNK = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("model", T.StringType()),
    T.StructField("dimension", T.IntegerType()),
])

VECTOR_RECORD = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType()), False),
    T.StructField("text", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("source", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()),
])

RAG_SAMPLE = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("contexts", T.ArrayType(T.StringType())),
    T.StructField("ground_truth", T.StringType()),
])

TEST_CASE = T.StructType([
    T.StructField("input", T.StringType()),
    T.StructField("actual_output", T.StringType()),
    T.StructField("expected_output", T.StringType()),
    T.StructField("context", T.ArrayType(T.StringType())),
    T.StructField("retrieval_context", T.ArrayType(T.StringType())),
])

SCORE = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("framework", T.StringType()),
    T.StructField("case_id", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("success", T.BooleanType()),
])

TRAINING_LOG = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("step", T.LongType()),
    T.StructField("logs", T.MapType(T.StringType(), T.DoubleType())),
])

CHECKPOINT = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("step", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("metric", T.DoubleType()),
])

REQUEST = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("model", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("latency", T.DoubleType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
])
