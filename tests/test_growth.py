"""Steps whose cost for each row must not grow with what they look things up in."""

import datetime as dt
import hashlib
import math
import re

import numpy as np
from pyspark.sql import functions as F

from barloom.functions.search import with_place
from barloom.operators import metrics, sequences, splits
from barloom.plans import training

DAY = dt.date(2020, 1, 1)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_places_among_edges(spark):
    for n in (0, 1, 2, 5, 62, 63):
        rows = spark.range(-1, 70).select((F.col("id") / 2).alias("x"), F.array(*[F.lit(float(i // 2)) for i in range(n)]).cast("array<double>").alias("e"))
        found = with_place(rows, "at", "e", 63, lambda e: e <= F.col("x")).withColumn("want", F.size(F.filter("e", lambda e: e <= F.col("x"))))
        assert found.filter("at <> want").count() == 0
    unknown = spark.sql("SELECT CAST(NULL AS ARRAY<DOUBLE>) AS e, 1.0D AS x UNION ALL SELECT array(0.0D), NULL")
    assert {r["at"] for r in with_place(unknown, "at", "e", 63, lambda e: e <= F.col("x")).collect()} == {0}


def test_ranks_are_found_without_lambdas(spark):
    rows = [(None if i == 7 else f"S{i % 90}", None if i == 9 else DAY + dt.timedelta(days=i // 90)) for i in range(270)]
    table = spark.createDataFrame(rows, "Symbol string, Date date")
    ranked = splits.with_rank(table.filter("Date IS NOT NULL"))
    assert "filter(" not in plan(ranked)
    known = sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[0] or ""))
    assert [(r["Symbol"], r["Date"]) for r in ranked.orderBy("rank").collect()] == known
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(len(known)))


def test_areas_are_found_without_lambdas(spark):
    scored = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.2), (None, 1, 0.1), (None, 0, 0.7)], "k string, label int, score double")
    areas = metrics.roc_auc(scored, ["k"])
    assert "filter(" not in plan(areas)
    assert {r["k"]: r["roc_auc"] for r in areas.collect()} == {"a": 1.0, None: 0.0}


def _draw(state, counter):
    x = (state + counter * 2654435769) % (1 << 32)
    x = (x * 747796405 + 2891336453) % (1 << 32)
    x = (x ^ (x >> 16)) * 668265263 % (1 << 32)
    return ((x ^ (x >> 15)) + 1) / float(1 << 32)


def test_augmentation_is_drawn_in_batches(spark):
    rows = [
        ("A", DAY, [[1.5, None], [float("nan"), 2.5]]),
        (None, DAY, [[3.5]]),
        ("B", None, []),
        ("C", DAY, None),
        ("D", DAY, [None, [4.0, 5.0, 6.0]]),
        *[(f"E{i}", DAY, [[None, 7.0], [8.0, None]]) for i in range(8)],
    ]
    table = spark.createDataFrame(rows, "Symbol string, Date date, sequence array<array<float>>")
    noisy = sequences.add_noise(table, 0.5)
    masked = sequences.mask_features(noisy, 0.5)
    assert "transform(" not in plan(masked)
    got = {r["Symbol"]: (r["sequence"], m["sequence"]) for r in noisy.collect() for m in masked.collect() if m["Symbol"] == r["Symbol"]}
    for symbol, day, nested in rows:
        key = "|".join([x for x in (symbol, day and day.isoformat()) if x])
        state = {use: int(hashlib.md5(f"42|{use}|{key}".encode()).hexdigest()[:8], 16) for use in ("noise", "mask")}
        if not nested:
            assert got[symbol] == (nested, nested)
            continue
        for step, cells in enumerate(nested):
            if cells is None:
                assert got[symbol][0][step] is None and got[symbol][1][step] is None
                continue
            for j, x in enumerate(cells):
                place = (step * len(cells) + j) * 2
                a, b = _draw(state["noise"], place), _draw(state["noise"], place + 1)
                want = None if x is None else float(np.float32(x + 0.5 * math.sqrt(-2 * math.log(a)) * math.cos(2 * math.pi * b)))
                stays = j < len(nested[0] or []) and _draw(state["mask"], j) > 0.5
                for value, kept in ((got[symbol][0][step][j], True), (got[symbol][1][step][j], stays)):
                    if not kept:
                        assert value == 0.0
                    elif want is None:
                        assert value is None
                    else:
                        assert (math.isnan(want) and math.isnan(value)) or math.isclose(value, want, rel_tol=1e-6)


def _pairs_by_rank(rows, seed):
    """Label and partner's label of every row with a day, as text keys."""
    low = lambda x: (x is not None, x)
    hashed = lambda r: hashlib.md5("|".join([seed, *[x for x in (r[0], r[1] and r[1].isoformat()) if x]]).encode()).hexdigest()
    one = sorted(rows, key=lambda r: (low(r[1]), low(r[0])))
    other = sorted(rows, key=lambda r: (hashed(r), low(r[0]), low(r[1])))
    return sorted((a[2], b[3]) for a, b in zip(one, other) if a[1] is not None)


def test_partners_stand_at_the_same_position(spark, monkeypatch):
    rows = [(f"S{i % 60}" if i % 60 else None, DAY + dt.timedelta(days=i // 60) if i % 97 else None, i, -float(i)) for i in range(1500)]
    rows += [(f"T{i}", DAY + dt.timedelta(days=3), 2000 + i, None if i % 9 == 0 else float(i)) for i in range(700)]
    rows = list({r[:2]: r for r in rows}.values())
    table = spark.createDataFrame(rows, "Symbol string, Date date, n int, x double")
    drawn = F.md5(F.concat_ws("|", F.lit("7"), "Symbol", F.col("Date").cast("string")))
    sort = lambda pairs: sorted(pairs, key=str)
    want = sort(_pairs_by_rank(rows, "7"))
    for least, busy in ((1 << 12, 1 << 18), (16, 1 << 18), (16, 40)):  # one part, many, and days cut at symbols
        monkeypatch.setattr(splits, "_LEAST_ROWS", least)
        monkeypatch.setattr(splits, "_DAY_ROWS", busy)
        paired = splits.with_partner(table, drawn, ["n"], ["x", "n"], "_mate")
        assert sort((r["n"], r["_mate"]["x"]) for r in paired.collect()) == want
    assert splits.with_partner(table.limit(0), drawn, ["n"], ["x"], "_mate").count() == 0
    assert splits.with_partner(table.filter("Date IS NULL"), drawn, ["n"], ["x"], "_mate").count() == 0


def test_routes_cover_every_position():
    days = {(None, 0): 5} | {(DAY + dt.timedelta(days=d), 0): 1 + d * 37 % 101 for d in range(300)}
    total = sum(days.values())
    prefixes = [(f"{i:04x}", 30) for i in range(total // 30)] + [("ffff", total % 30)]
    own, others, ahead = splits._routes(days, prefixes, 2)
    assert len({r[2] for r in own}) > 1 and len(own) == 300
    begin = dict(zip(days, np.cumsum([0, *days.values()])))
    sizes = dict(prefixes)
    at = dict(zip(sizes, np.cumsum([0, *sizes.values()])))
    for part in {r[2] for r in own}:
        held = [r[:2] for r in own if r[2] == part]
        there = [r[0] for r in others if r[1] == part]
        start, size = begin[held[0]], sum(days[x] for x in held)
        assert at[there[0]] == start - ahead[part] <= start and at[there[-1]] + sizes[there[-1]] >= start + size
        assert sum(sizes[x] for x in there) <= size + 2 * 30  # only prefixes at its edges lie in other parts too


def test_areas_of_numbered_groups(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(3):
        scores = [*np.round(rng.normal(size=900), 2), *[0.25] * 400, *[None] * 30, *[float("nan")] * 30, 0.0, -0.0, float("inf"), float("-inf")]
        rows += [(k, None if i % 50 == 7 else float(rng.random() < 0.4), None if x is None else float(x)) for i, x in enumerate(scores)]
    rows += [(3, 1.0, 0.5), (3, None, 0.1), (4, None, 0.2)]
    scored = spark.createDataFrame(rows, "k int, label double, score double").repartition(3)
    known = {k: [(y, -2e9 if x is None else 2e9 if x != x else max(min(x, 1e9), -1e9)) for g, y, x in rows if g == k and y is not None] for k in range(5)}
    for buckets, some in ((16, scored), (256, scored), (16, scored.limit(0)), (8, scored.filter("k = 1"))):
        got = {r["k"]: r["roc_auc"] for r in metrics.roc_auc_by_number(scored, "k", some, buckets).collect()}
        assert got[3] == got[4] == 0.0
        for k in range(3):
            pos, neg = (np.array([x for y, x in known[k] if y == side]) for side in (1.0, 0.0))
            wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
            assert math.isclose(got[k], wins / (len(pos) * len(neg)), abs_tol=1e-12)
    same = {r["k"]: r["roc_auc"] for r in metrics.roc_auc(scored, ["k"]).collect()}
    assert all(math.isclose(same[k], got[k], abs_tol=1e-12) for k in same)


def test_importance_moves_rows_and_scores_once(spark):
    rng = np.random.default_rng(4)
    days = [DAY + dt.timedelta(days=int(d)) for d in range(40)]
    rows = [(f"S{s}", d, float(rng.normal()), float(rng.normal()), int(rng.random() < 0.5)) for s in range(25) for d in days]
    table = spark.createDataFrame(rows, "Symbol string, Date date, a double, b double, y int")
    found = training.permutation_importance(table, ["a", "b"], lambda t: t.withColumn("score", F.col("a") - F.col("b")), "y")
    text = found._jdf.queryExecution().executedPlan().toString()
    # before, rows went through four shuffles for their ranks and two for a join, and scores were counted by value before their own
    assert not re.search(r"hashpartitioning\((_at|_bucket)#|HashAggregate\(keys=\[Feature#\d+, \S*score#", text)
    one = {r["Feature"]: r for r in found.collect()}
    assert set(one) == {"a", "b"} and {r["place"] for r in one.values()} == {1, 2}
    pairs = dict(_pairs_by_rank([(s, d, i, i) for i, (s, d, *_) in enumerate(rows)], "42"))
    values = {"": [r[2] - r[3] for r in rows], "a": [rows[pairs[i]][2] - r[3] for i, r in enumerate(rows)], "b": [r[2] - rows[pairs[i]][3] for i, r in enumerate(rows)]}
    label = np.array([r[4] for r in rows])
    area = lambda x: np.mean(np.array(x)[label == 1][:, None] > np.array(x)[label == 0])
    for name in ("a", "b"):
        assert math.isclose(one[name]["roc_auc"], area(values[name]), abs_tol=1e-12)
        assert math.isclose(one[name]["Importance"], area(values[""]) - area(values[name]), abs_tol=1e-12)
