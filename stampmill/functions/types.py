"""Return types of the Arrow-batched functions, built without a session."""

from pyspark.sql import functions as F, types as T

DOUBLE = T.DoubleType()
LONG = T.LongType()
DOUBLES = T.ArrayType(T.DoubleType())
LONGS = T.ArrayType(T.LongType())
INTS = T.ArrayType(T.IntegerType())
FLOATS = T.ArrayType(T.FloatType())


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def arrow_function(kind):
    """An Arrow-batched function that the optimiser neither copies nor moves.

    A filter or an exploded column above a plain one would be pushed below it and run it again.
    """

    def wrap(fn):
        return F.pandas_udf(fn, returnType=kind).asNondeterministic()

    return wrap
