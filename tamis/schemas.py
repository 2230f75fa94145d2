"""Schemas shared by the operators."""

from pyspark.sql import types as T

BANK = T.StructType([
    T.StructField("word", T.StringType(), False),
    T.StructField("type", T.StringType(), True),
    T.StructField("severity", T.StringType(), True),
    T.StructField("action", T.StringType(), True),
])

RULES = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("pattern", T.StringType(), False),
    T.StructField("type", T.StringType(), True),
    T.StructField("severity", T.StringType(), True),
    T.StructField("action", T.StringType(), True),
])

# One hit inside a per-text array.
HIT_DDL = ("struct<matcher_ord:int,matcher:string,word:string,type:string,"
           "severity:string,idx:int,len:int>")
HITS_DDL = f"array<{HIT_DDL}>"

# Flat hits table.
HITS = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("matcher", T.StringType(), True),
    T.StructField("matcher_ord", T.IntegerType(), True),
    T.StructField("word", T.StringType(), True),
    T.StructField("type", T.StringType(), True),
    T.StructField("severity", T.StringType(), True),
    T.StructField("idx", T.IntegerType(), True),
    T.StructField("len", T.IntegerType(), True),
])

# Hit as rendered in results (documented lower-case keys).
RESULT_HIT_DDL = "struct<word:string,type:string,severity:string,index:int,length:int>"

STANDARD_REQUEST = T.StructType([
    T.StructField("text", T.StringType(), True),
    T.StructField("point", T.StringType(), True),
    T.StructField("app_id", T.StringType(), True),
])

DIFY_REQUEST = T.StructType([
    T.StructField("point", T.StringType(), True),
    T.StructField("params", T.StructType([
        T.StructField("app_id", T.StringType(), True),
        T.StructField("query", T.StringType(), True),
        T.StructField("text", T.StringType(), True),
    ]), True),
])
