"""Schemas of all tables; nothing is inferred."""

from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    types = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "int": T.IntegerType(), "timestamp": T.TimestampType(), "vector": T.ArrayType(T.FloatType())}
    return T.StructType([T.StructField(n, types[t]) for n, t in (f.split() for f in ddl.split(", "))])


VOCABULARY = _struct("surface string, reading string, pos string, category string")
WORD = _struct("surface string, reading string, hangul string")
SENTENCE = T.StructType([T.StructField("category", T.StringType()), T.StructField("words", T.ArrayType(WORD))])
PAIR = _struct("reading string, hangul string, freq long")
ENTRY = _struct("reading string, surface string, frequency long")
EMBEDDING = _struct("word string, vector vector, dim int")
INDEX = _struct("hangul string, reading string, surface string, frequency long")
SELECTION = _struct("input string, selected string, at timestamp")
CLICK = _struct("platform string, clicked_at timestamp, user_agent string, referrer string")
META = _struct("key string, value string")
