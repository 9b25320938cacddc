"""Row types of the engine."""

from pyspark.sql import types as T

FIELD = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
FIELDS = T.ArrayType(FIELD)
#: One definition. ``fields`` is an ordered list of unique keys: a map could neither keep nor be sorted by its order.
TAG = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("fields", FIELDS),
    ]
)
#: A discovered path; content is read late, inside the task that needs it.
FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("rel_path", T.StringType()),
        T.StructField("file_ord", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("is_exec", T.BooleanType()),
        T.StructField("stat", T.StringType()),
    ]
)
EXTRACTED = T.StructType([T.StructField("file_ord", T.LongType()), T.StructField("tag_ord", T.LongType()), *TAG.fields, T.StructField("error", T.StringType())])
