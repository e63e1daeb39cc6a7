"""The two streams, run to the end of their files."""

from __future__ import annotations

from pyspark.sql import functions as F

from stampmill.operators import spectra as sp
from stampmill.operators.lineage import scratch_path
from stampmill.queries import query
from stampmill.queries.gate import CUTS, MANIFEST_CTES, with_depth
from stampmill.queries.measures import ACF_CTES, _XI_SQL, rounded_all
from stampmill.queries.views import stamps8, stamps32
from stampmill.streaming import stamp_streams as ss


def _arrived(df, name):
    path = scratch_path(df.sparkSession, name)
    df.repartition(6).write.parquet(path)
    return path, df.schema


@query("st1_stream_extract", MANIFEST_CTES + """SELECT reason, count(*) AS n FROM (
  SELECT DISTINCT s, split_part(unnest(reason_list), ':', 1) AS reason FROM manifest WHERE status <> 'accepted') GROUP BY reason""")
def st1(spark, sf):
    path, schema = _arrived(with_depth(stamps32(spark, sf)), "arriving")
    out = scratch_path(spark, "gated")
    ss.stream_extract(spark, path, out, schema, CUTS, files_per_batch=2).awaitTermination()
    return ss.tallies(spark, out)


@query("st2_stream_acf", ACF_CTES + _XI_SQL)
def st2(spark, sf):
    path, schema = _arrived(stamps8(spark, sf), "arriving")
    out = scratch_path(spark, "acf")
    ss.stream_acf(spark, path, out, schema, 8, files_per_batch=2).awaitTermination()
    return rounded_all(sp.correlation_length(sp.autocorrelation(ss.running_state(spark, out))))
