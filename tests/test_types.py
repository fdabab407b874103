import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from pelagia.types import WideningError, arrow_to_spark, merge_schemas, spark_to_arrow, widen

NUMBERS = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.NullType()]
number = st.sampled_from(NUMBERS)


@settings(max_examples=300, deadline=None)
@given(number, number, number)
def test_widening_is_a_join(a, b, c):
    assert widen(a, a) == a
    assert widen(a, b) == widen(b, a)
    assert widen(widen(a, b), c) == widen(a, widen(b, c))


def test_families_do_not_mix():
    for a, b in ((T.StringType(), T.IntegerType()), (T.BooleanType(), T.IntegerType()), (T.DateType(), T.TimestampNTZType()), (T.ArrayType(T.LongType()), T.LongType())):
        with pytest.raises(WideningError):
            widen(a, b)
    assert widen(T.IntegerType(), T.FloatType()) == T.DoubleType() and widen(T.ByteType(), T.FloatType()) == T.FloatType()
    assert widen(T.DecimalType(10, 2), T.LongType()) == T.DecimalType(21, 2)
    assert widen(T.TimestampNTZType(), T.TimestampType()) == T.TimestampType()


def test_merge_names_column_and_both_files():
    a = T.StructType([T.StructField("x", T.IntegerType(), False), T.StructField("y", T.StringType(), False)])
    b = T.StructType([T.StructField("z", T.DoubleType()), T.StructField("x", T.LongType(), False)])
    got = merge_schemas([("a.parquet", a), ("b.parquet", b)])
    assert got.names == ["x", "y", "z"] and got["x"].dataType == T.LongType()
    assert not got["x"].nullable and got["y"].nullable and got["z"].nullable
    with pytest.raises(WideningError, match="x.*a.parquet.*c.parquet"):
        merge_schemas([("a.parquet", a), ("c.parquet", T.StructType([T.StructField("x", T.StringType())]))])


def test_arrow_names():
    assert arrow_to_spark("Timestamp(Nanosecond, None)") == "timestamp_ntz"
    assert arrow_to_spark("List(Int32)") == "array<int>" and arrow_to_spark("UInt64") == "decimal(20,0)"
    assert spark_to_arrow(T.ArrayType(T.LongType())) == "List(Int64)"
    with pytest.raises(ValueError):
        arrow_to_spark("")
