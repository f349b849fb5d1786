"""Column expressions against small Python models of their specification."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from floodflow.functions.columns import change_ratio, sampling_weight, sq_distance, tolerant_long

WS = "".join(chr(c) for c in range(0x21))


def model_cast(s):
    """Non-ANSI string -> long cast: trim control chars and blanks, accept an
    optional sign, digits and a truncated fraction; else null."""
    if s is None:
        return None
    t = s.strip(WS)
    if not re.fullmatch(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]*)", t):
        return None
    ip = re.match(r"[+-]?[0-9]*", t).group(0)
    if ip in ("", "+", "-"):
        return 0
    v = int(ip)
    return v if -2 ** 63 <= v < 2 ** 63 else None


texts = st.one_of(
    st.none(),
    st.text(alphabet=" \t\n\x00+-.0123456789e,x", max_size=12),
    st.integers(min_value=-2 ** 70, max_value=2 ** 70).map(str),
)


@settings(max_examples=1, deadline=None)
@given(st.lists(texts, min_size=150, max_size=150))
def test_tolerant_long_matches_model(spark, values):
    fixed = [" 12 ", "12.7", "1,000", "1e3", "", ".", ".5", "-.", "+", "9223372036854775808", "\t7\n"]
    data = [(i, v) for i, v in enumerate(values + fixed)]
    df = spark.createDataFrame(data, "i int, s string")
    got = {r.i: r.v for r in df.select("i", tolerant_long("s").alias("v")).collect()}
    assert all(got[i] == model_cast(v) for i, v in data)


def test_scalar_helpers(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0, 6.0, 10, 0, 2)], "a double, b double, c double, d double, p long, ch long, ch2 long")
    r = df.select(sq_distance("a", "b", "c", "d").alias("d2"), sampling_weight("p").alias("w"),
                  change_ratio("ch", "p").alias("r0"), change_ratio("ch2", "p").alias("r1"),
                  change_ratio(F.lit(None), "p").alias("rn")).first()
    assert (r.d2, r.w, r.r0, r.r1, r.rn) == (25.0, 30, 0.0, 0.2, 0.0)
