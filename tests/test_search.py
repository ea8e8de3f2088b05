"""Places of patterns in sequences, batch by batch."""

import pandas as pd

from strandmill.functions.places import places
from strandmill.functions.regions import INTERVAL
from strandmill.operators import regions


def test_places_at_seams_of_sequences():
    f = places(["ANG", "GN", "CCG"]).func
    for texts in (["AAG", "GACCG", None, "", "A", "GG", "ccgAéG", "ACG"], ["", None], []):
        want = [sorted(k * 2 + n - 2 for n in (2, 3) for k in range(len(x or "") - n + 1) if any(len(p) == n and all(c in ("N", x[k + i]) for i, c in enumerate(p)) for p in ("ANG", "GN", "CCG"))) for x in texts]
        assert [sorted(x.tolist()) for x in f(pd.Series(texts, dtype=object))] == want


def test_search_asks_no_lambda_for_each_place(spark):
    rows = [(1, [("chr1", "+", 11, 18)], "ACGTTTCA"), (2, [("chr1", "-", 11, 18)], "ACGTTTCA"), (3, [("chr1", "+", 1, 2), ("chr1", "+", 5, 10)], "ACGTTTCA"), (4, [("chr1", "+", 1, 3)], None)]
    df = spark.createDataFrame(rows, f"region_id long, iv array<{INTERVAL}>, seq string")
    out = regions.search(df, "ACGN|TTNA||TTTC")
    assert sorted((r.region_id, r.iv[0].start, r.iv[0].stop) for r in out.collect()) == [(1, 11, 14), (1, 14, 17), (1, 15, 18), (2, 11, 14), (2, 12, 15), (2, 15, 18)]
    assert "lambda" not in (plan := out._jdf.queryExecution().executedPlan().toString()).split("ArrowEvalPython")[-1] and "ArrowEvalPython" in plan
    assert regions.search(df, "").count() == 0
