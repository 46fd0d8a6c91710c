"""Schemas of stored datasets. Order is part of the data: row_idx is dense within a split."""

from pyspark.sql import types as T

RAW = T.StructType([T.StructField("row_idx", T.LongType()), T.StructField("dialogue", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("split", T.StringType())])
FEATURES = T.StructType([*RAW.fields[:-1], *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("input_ids", "attention_mask", "labels")), RAW.fields[-1]])
SPLITS = ("train", "test", "validation")
