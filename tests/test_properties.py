"""Properties over generated inputs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.functions.text import ascii_digits, luhn_valid, pesel_valid, utf16_length
from veilspark.operators.gate import Gate

KINDS = ["clean", "detected", "inconclusive", "reset", "delay_complete", "approve", "deny"]


@given(st.lists(st.sampled_from(KINDS), max_size=60), st.integers(1, 4), st.booleans(), st.booleans())
def test_gate_never_opens_early(events, required, by_hand, delayed):
    """An open gate has seen enough clean checks since it was last closed; after a detection with approval asked for, an approval as well."""
    gate, cleans, approved, hit = Gate(), 0, False, False
    for kind in events:
        was = gate.blocked
        gate.event(kind, "why", required, by_hand, delayed)
        if kind in ("detected", "inconclusive", "reset"):
            cleans, approved = 0, False
            hit = kind == "detected" or (hit and kind != "reset")
            assert gate.blocked and not gate.manual and not gate.delay
        cleans += kind == "clean"
        approved = approved or (kind == "approve" and was and not gate.blocked)
        if was and not gate.blocked:
            assert cleans >= required and (approved or not (by_hand and hit))
            hit = False
        assert not (gate.manual and not gate.blocked) and not (gate.delay and not gate.blocked)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="0123456789 -é😀٣", max_size=24), min_size=1, max_size=40))
def test_text_functions(spark, values):
    def luhn(d):
        t = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 13 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in t) % 10 == 0

    def pesel(d):
        return len(d) == 11 and (10 - sum(int(c) * w for c, w in zip(d, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3))) % 10) % 10 == int(d[10])

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string").withColumn("d", ascii_digits(F.col("v")))
    for r in df.withColumns({"n": utf16_length(F.col("v")), "l": luhn_valid(F.col("d")), "p": pesel_valid(F.col("d"))}).collect():
        d = "".join(c.replace("٣", "3") for c in r.v if c in "0123456789٣")
        assert (r.d, r.n, r.l, r.p) == (d, len(r.v.encode("utf-16-be")) // 2, luhn(d), pesel(d))


def test_scans_along_arrays(spark):
    """States and outputs in order, over arrays that end in and between blocks and groups, and 10^5 elements in seconds."""
    import time

    from veilspark.functions.arrays import scan

    sizes = [0, 1, 63, 64, 65, 4095, 4096, 4097, 9000, 100_000]
    rows = spark.createDataFrame([(n,) for n in sizes], "n int").select("n", F.expr("case when n = 0 then cast(array() as array<int>) else sequence(1, n) end").alias("a"))
    at = time.time()
    sums = scan(F.col("a"), F.lit(0).cast("long"), lambda s, x: (s + x, F.when(x % 3 != 0, F.array(s + x)).otherwise(F.expr("cast(array() as array<bigint>)"))), "bigint")
    got = {r.n: r.o for r in rows.select("n", sums.alias("o")).collect()}
    assert time.time() - at < 30
    for n in sizes:
        assert got[n] == [x * (x + 1) // 2 for x in range(1, n + 1) if x % 3]
