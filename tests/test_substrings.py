"""Substring joins through q-grams equal the comparison of all pairs."""
import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from tunekiln.operators import logs as lg
from tunekiln.operators import substrings
from tunekiln.plans import catalog as cat
from tunekiln.plans import corpus_plan as pl


def test_ten_thousand_signatures(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    sigs = list({" ".join(word() for _ in range(rng.randrange(1, 4))).upper() for _ in range(10_000)}) + ["", None, "a", "DE"]
    lines = [" ".join(word() for _ in range(12)) for _ in range(400)] + ["", None, "a", "no"]
    table = spark.createDataFrame([(i, s, f"cause {i}") for i, s in enumerate(sigs)], "sig_pos int, signature string, cause string")
    df = spark.createDataFrame(list(enumerate(lines)), "n long, line string")
    want = sorted((n, i) for n, t in enumerate(lines) if t is not None for i, s in enumerate(sigs) if s and s.lower() in t.lower())
    for small in (substrings.SMALL_ROWS, 0):
        monkeypatch.setattr(substrings, "SMALL_ROWS", small)
        found = lg.match_signatures(df, signatures=table)
        assert sorted((r.n, r.sig_pos) for r in found.collect()) == want and len(want) > 1000
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert lg.match_signatures(df, signatures=table.limit(0)).count() == 0


def test_a_hundred_thousand_requests(spark):
    rng = random.Random(6)
    names = [m[0] for m in cat.MODELS]

    def request():
        name = rng.choice(names)
        kind = rng.randrange(4)
        if kind == 0:
            return f"org{rng.randrange(5000)}/{name}-v{rng.randrange(90)}"
        if kind == 1:
            return name[rng.randrange(len(name)):][:rng.randrange(1, 9)] + rng.choice(["", "_", "-"])
        return "".join(rng.choice("abq27b-_l") for _ in range(rng.randrange(0, 9)))

    reqs = pd.DataFrame({"id": range(100_000), "request": [request() for _ in range(99_999)] + [None]})
    got = pl.match_models(spark.createDataFrame(reqs), "request").select("id", F.col("matched_model.name").alias("m")).toPandas()
    con = duckdb.connect()
    con.register("reqs", reqs)
    models = cat.sql_values([(i, m[0], m[1]) for i, m in enumerate(cat.MODELS)], ["pos", "name", "params"], "c")
    want = con.sql(f"""WITH d AS (SELECT DISTINCT request, replace(replace(lower(request), '-', ''), '_', '') AS nm FROM reqs),
        h AS (SELECT request, arg_min(name, (abs(params - 7e9::DOUBLE), pos)) AS m FROM d, {models}
              WHERE nm <> '' AND (contains(nm, replace(name, '-', '')) OR contains(replace(name, '-', ''), nm)) GROUP BY request)
        SELECT id, coalesce(m, 'default-7b') AS m FROM reqs LEFT JOIN h USING (request)""").df()
    key = lambda f: dict(zip(f["id"], f["m"]))
    assert key(got) == key(want) and len(set(got["m"])) > 20


def test_a_catalogue_of_ones_own(spark):
    own = spark.createDataFrame([(0, "house-9b", 9e9, 10, 2, False, 9e9), (1, "house-7b", 7e9, 11, 3, False, 7e9)],
                                "pos int, name string, params double, hidden long, layers long, is_moe boolean, total_params double")
    req = spark.createDataFrame([("house",), ("HOUSE_9B",), ("other",), ("house",)], "request string")
    got = pl.match_models(req, "request", own).select("request", "matched_model.name").collect()
    assert sorted(map(tuple, got)) == [("HOUSE_9B", "house-9b"), ("house", "house-7b"), ("house", "house-7b"), ("other", "default-7b")]
