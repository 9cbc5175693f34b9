from clearstack.operators import register
from clearstack.plans.queries import QUERIES
from clearstack.sources import virtual
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_hamming_matches_among_all_rows(spark):
    d = virtual.spectra(spark, DATA).select("id", register.sign_bits(F.col("bands")).alias("bits"))
    rows = sorted((r.id, r.bits) for r in d.collect())
    # Near pairs, so that some rows match: the last rows again with one bit changed.
    rows += [(10**6 + i, b ^ 2) for i, b in rows[-20:]]
    want = set()
    for i, b in rows:
        (one, match), (two, _) = sorted((bin((b ^ o) & (2**64 - 1)).count("1"), j) for j, o in rows if j != i)[:2]
        if one < 0.75 * two:
            want.add((i, match, one))
    df = spark.createDataFrame(rows, "id long, bits long")
    assert len(want) >= 20 and all({tuple(r) for r in register.hamming_matches_among(df, block=k).collect()} == want for k in (2000, 90))
    among = {tuple(r) for r in QUERIES["hamming_knn"](spark, DATA).collect()}
    assert among == {tuple(r) for r in register.hamming_matches_among(d, 0.95).collect()}
