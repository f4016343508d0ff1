"""Exact quantiles and cuts against numpy and sorting, on shapes that would break an estimate."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanscope.functions.expressions import HASH_RANGE
from loanscope.operators import order_stats as O
from loanscope.operators.segments import decile_evolution


def _cases():
    rng = random.Random(7)
    return {
        "hot value": [5] * 700 + list(range(1400)),
        "constant": [3] * 50,
        "single": [42],
        "far apart": [0, 1, 2, 10**15, 10**15 + 1, -(10**15)],
        "wide": [int(rng.lognormvariate(13, 2)) for _ in range(3000)],
        "doubles": [rng.gauss(0, 1) ** 3 for _ in range(3000)],
        "tiny gaps": [1.0 + i * 2**-50 for i in range(40)] + [1e300, -1e300],
    }


@pytest.mark.parametrize("name", _cases())
@pytest.mark.parametrize("small_steps", [False, True])
def test_quantiles_match_numpy(spark, monkeypatch, name, small_steps):
    if small_steps:  # force narrowing over many passes
        monkeypatch.setattr(O, "BUCKETS", 8)
    values = _cases()[name]
    kind = "bigint" if isinstance(values[0], int) else "double"
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], f"x {kind}").repartition(3)
    ps = [0.0, 0.3, 0.5, 0.99, 1.0] if not small_steps else [0.5, 0.99]
    got = O.quantiles(df, {"x": ps})
    for p in ps:
        assert got[("x", p)] == pytest.approx(float(np.quantile(np.array(values, dtype=float), p)), rel=1e-12)


def test_several_series_in_shared_passes(spark):
    df = spark.range(5000).select(
        (F.col("id") % 97).alias("a"), (F.col("id") * 3.5).alias("b"), F.when(F.col("id") < 10, F.col("id")).alias("c"))
    got = O.quantiles(df, {"a": [0.5], "b": [0.1, 0.9], "c": [0.5]})
    pdf = df.toPandas()
    for (c, p), v in got.items():
        assert v == pytest.approx(pdf[c].quantile(p))


def test_empty_and_not_a_number(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (3.0,), (None,)], "x double")
    assert O.quantile(df, "x", 0.5) == 2.0
    assert O.quantile(df.filter("x > 100 and not isnan(x)"), "x", 0.5) is None


def test_decile_buckets_match_a_full_sort(spark):
    # a third of the rows share one position
    rows = [(i, 0 if i % 3 == 0 else i // 7, (i * 2654435761) % 2**40, i % 2) for i in range(1, 1203)]
    df = spark.createDataFrame(rows, "i int, pos int, h bigint, defaut int")
    got = {r["bucket"]: r["nb_prets"] for r in decile_evolution(df, "pos", "h").collect()}
    n = len(rows)
    expected = {}
    for k in range(n):
        b = max(-(-10 * k // (n - 1)) - 1, 0)
        expected[b] = expected.get(b, 0) + 1
    assert got == expected
    cuts = O.pair_cuts(df, "pos", "h", lambda rows: [0, 400, rows - 1], HASH_RANGE)
    ordered = sorted((r[1], r[2]) for r in rows)
    assert cuts == [ordered[0], ordered[400], ordered[-1]]


SHAPES = {
    "infinite": ("double", lambda n: [float("inf"), float("-inf")] + [i * 0.5 for i in range(n - 2)]),
    "signed zeros": ("double", lambda n: [0.0, -0.0] * (n // 4) + [float(i % 50) for i in range(n // 2)]),
    "subnormal": ("double", lambda n: [5e-324 * (i % 40) for i in range(n)] + [0.0, 1e-310]),
    "magnitudes": ("double", lambda n: [10.0 ** (i % 600 - 300) for i in range(n)] + [-1e308, 1e308]),
    "full range": ("bigint", lambda n: [-2**63, 2**63 - 1] + [(i * 2654435761) % 2**40 for i in range(n - 2)]),
    "one hot value": ("bigint", lambda n: [7] * (n - n // 3) + list(range(n // 3))),
}


@pytest.mark.parametrize("rows", [100, 60_000])
@pytest.mark.parametrize("name", SHAPES)
def test_extreme_values_at_every_size(spark, name, rows):
    kind, build = SHAPES[name]
    values = sorted(build(rows))
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}").repartition(4)
    ranks = sorted({0, 1, len(values) // 3, len(values) // 2, len(values) - 2, len(values) - 1})
    got = O.SeriesSet(df, {"x": None}).values_at({"x": ranks})
    for rank in ranks:
        hit = got[("x", rank)]
        assert hit.value == values[rank]
        assert hit.below <= rank < hit.below + hit.rows
        assert hit.rows == sum(1 for v in values if v == hit.value)
