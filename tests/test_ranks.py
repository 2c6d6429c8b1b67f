import random

import numpy as np
import pandas as pd
import pytest

from assayline.operators import ranks as R

EDGE = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 4.0), ("a", 100.0), ("b", 5.0),
        ("c", 3.0), ("c", 3.0), ("c", 3.0), ("d", None), (None, 7.0)]


def _pandas_rank(rows, by):
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    if by:
        return pdf.assign(r=pdf.groupby("g")["v"].rank(pct=True))
    return pdf.assign(r=pdf["v"].rank(pct=True))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_average_rank_matches_pandas(spark, by):
    df = spark.createDataFrame(EDGE, "g string, v double")
    got = R.average_rank(df, "v", by, out="r").toPandas()
    exp = _pandas_rank(EDGE, by)
    key = lambda d: d.sort_values(["g", "v"], na_position="last").reset_index(drop=True)  # noqa
    g, e = key(got), key(exp)
    assert np.allclose(g["r"].astype(float), e["r"].astype(float), equal_nan=True)


def test_pandas_example_from_survey(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, 4.0, 100.0)], "v double")
    got = sorted(r["r"] for r in R.average_rank(df, "v", out="r").collect())
    assert got == [0.2, 0.5, 0.5, 0.8, 1.0]


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(7)
    vals = [float(rnd.randint(0, 40)) for _ in range(300)] + [None]
    grp = [rnd.choice("xyz") for _ in vals]
    df = spark.createDataFrame(list(zip(grp, vals)), "g string, v double")
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    got = {r["g"]: r for r in R.exact_quantiles(df, "v", probs, ["g"]).collect()}
    one = R.exact_quantiles(df, "v", probs).first()
    pdf = pd.DataFrame({"g": grp, "v": vals})
    for g, sub in pdf.groupby("g"):
        exp = sub["v"].quantile(probs).tolist()
        assert np.allclose([got[g][f"q{int(p * 100)}"] for p in probs], exp)
    assert np.allclose([one[f"q{int(p * 100)}"] for p in probs], pdf["v"].quantile(probs).tolist())


def test_hot_group_third_of_rows(spark):
    """One group holds a third of all rows: several slices share it."""
    rows = [("hot", float(i)) for i in range(300)] + [(f"g{i % 50}", float(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = R.average_rank(df, "v", ["g"], out="r").where("g = 'hot'").toPandas()
    got = got.sort_values("v")
    assert np.allclose(got["r"].to_numpy(), (np.arange(300) + 1) / 300)


def test_empty_input_quantile_is_one_null_row(spark):
    df = spark.createDataFrame([], "v double")
    row = R.exact_quantiles(df, "v", [0.5], names=["m"]).collect()
    assert len(row) == 1 and row[0]["m"] is None
