"""Golden cases of the operators."""

import datetime
import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitlake.functions import exprs
from pitlake.operators import acceptance, adjust, backtest, costs, evolve, experiments, forward, genomes, identity, learned, metrics, panel, pit, portfolio, quality, timing
from pitlake.operators import fundamental_features as ff
from pitlake.plans import registry
from pitlake.plans import standins as S
from pitlake.sources import ingest as feeds
from pitlake.sources import lake, parse
from pitlake.sources import registry as runlog
from pitlake.streaming import ingest


def frame(spark, rows, schema, *dates):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({d: F.col(d).cast("date") for d in dates})


def bars(spark, closes, start=1):
    return frame(spark, [(1, f"2024-01-{start + i:02d}", c, c, c, c, 1000.0) for i, c in enumerate(closes)], "security_id long, date string, open double, high double, low double, close double, volume double", "date")


def action(spark, kind, value, day=3):
    return frame(spark, [(1, f"2024-01-{day:02d}", kind, value)], "security_id long, date string, action_type string, value double", "date")


def col(df, name, order="date"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_split_as_traded(spark):
    b, a = bars(spark, [100.0, 100.0, 50.0]), action(spark, "split", 2.0)
    f = adjust.compute_factors(b, a)
    assert col(f, "adj_factor") == [0.5, 0.5, 1.0]
    out = adjust.apply_factors(b, f)
    assert col(out, "adj_close") == [50.0, 50.0, 50.0] and col(out, "adj_volume") == [2000.0, 2000.0, 1000.0]
    assert col(adjust.compute_factors(b, a, adjust.SPLIT_ADJUSTED), "adj_factor") == [1.0, 1.0, 1.0]


def test_dividend(spark):
    f = adjust.compute_factors(bars(spark, [100.0, 100.0, 99.0]), action(spark, "dividend", 1.0))
    assert col(f, "adj_factor") == pytest.approx([0.99, 0.99, 1.0])


def test_intervals(spark):
    rows = [("A", m) for m in (1, 2, 3)] + [("B", 1), ("B", 3)] + [("C", 1), ("C", 2)]
    df = frame(spark, [(k, f"2024-{m:02d}-01") for k, m in rows], "ticker string, month string", "month")
    out = {(r.ticker, r.start_date.month): (r.end_date.month if r.end_date else None, r.end_is_open) for r in identity.build_intervals(df, "month", "ticker").collect()}
    assert out == {("A", 1): (None, True), ("B", 1): (1, False), ("B", 3): (None, True), ("C", 1): (2, False)}


def test_rank_ties(spark):
    rows = [(1, 1.0), (1, 2.0), (1, 2.0), (1, 3.0), (2, 5.0), (2, None), (3, 5.0), (3, 1.0), (3, 3.0), (3, None)]
    out = spark.createDataFrame(rows, "date int, x double").withColumn("r", exprs.rank_pct(F.col("x"), ["date"])).collect()
    got = {}
    for r in out:
        got.setdefault(r.date, []).append(r.r)
    assert sorted(got[1]) == [0.0, 0.5, 0.5, 1.0] and got[2] == [None, None]
    assert sorted(x for x in got[3] if x is not None) == [0.0, 0.5, 1.0]


def test_blend_missing(spark):
    out = spark.createDataFrame([(1.0, 0.0), (1.0, None), (None, None)], "a double, b double").select(exprs.blend([(F.col("a"), 1.0), (F.col("b"), 1.0)]).alias("s")).collect()
    assert [r.s for r in out] == [0.5, 1.0, None]


def test_reason_classes(spark):
    want = {"Filed for Chapter 11": "bankruptcy", "Acquired by X": "acquisition", "Market cap change": "index_removal", "Spun off from X after the merger": "index_removal", "": "unresolved", "Taken private": "acquisition"}
    df = spark.createDataFrame([(k,) for k in want], "t string").select("t", identity.classify_reason(F.col("t")).alias("c"))
    assert {r.t: r.c for r in df.collect()} == want


def test_normal(spark):
    z = [-40.0, -8.0, -3.0, -1.0, 0.0, 0.5, 2.0, 6.0, 9.0]
    out = spark.createDataFrame([(x,) for x in z], "z double").select("z", exprs.norm_cdf("z").alias("p")).collect()
    for r in out:
        assert r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), abs=1e-13)
    p = [0.001, 0.02, 0.3, 0.5, 0.9, 0.999]
    back = spark.createDataFrame([(x,) for x in p], "p double").select("p", exprs.norm_ppf("p").alias("z")).collect()
    for r in back:
        assert 0.5 * math.erfc(-r.z / math.sqrt(2)) == pytest.approx(r.p, rel=1e-8)


def test_moments(spark):
    x = np.random.default_rng(0).gamma(2, size=40)
    r = spark.createDataFrame([(float(v),) for v in x], "x double").agg(exprs.skewness(F.col("x")).alias("s"), exprs.kurtosis(F.col("x")).alias("k")).first()
    assert r.s == pytest.approx(pd.Series(x).skew()) and r.k == pytest.approx(pd.Series(x).kurt())


def test_asof_equals_pandas(spark):
    rng = np.random.default_rng(1)
    left = pd.DataFrame({"k": rng.integers(0, 5, 200), "t": rng.integers(0, 50, 200), "i": range(200)})
    right = pd.DataFrame({"k": rng.integers(0, 5, 80), "t": rng.integers(0, 50, 80), "v": rng.random(80), "o": range(80)})
    right.loc[::7, "v"] = np.nan
    want = pd.merge_asof(left.sort_values("t"), right.sort_values(["t", "o"]).drop_duplicates(["k", "t"], keep="last"), on="t", by="k").set_index("i")["v"]
    r = spark.createDataFrame(right).withColumn("v", exprs.nullify(F.col("v")))
    got = pit.asof_join(spark.createDataFrame(left), r, ["k"], "t", "t", ["v"], ["o"]).toPandas().set_index("i")["v"]
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_lookahead(spark):
    p = spark.createDataFrame([(1, i, float(i)) for i in range(10)], "security_id long, session_index int, close double")
    view = panel.PointInTime(p, 5)
    assert view.panel.count() == 6 and view.at(5).count() == 1
    with pytest.raises(panel.LookaheadError):
        view.at(6)


def test_cap(spark):
    rng = random.Random(0)
    rows = []
    for d in range(30):
        w = [rng.paretovariate(1.2) for _ in range(rng.randrange(2, 40))]
        rows += [(d, i, x / sum(w)) for i, x in enumerate(w)]
    out = portfolio.cap_weights(spark.createDataFrame(rows, "date int, security_id long, weight double"), 0.1).toPandas()
    for d, g in out.groupby("date"):
        n = len(g)
        assert g["weight"].sum() == pytest.approx(1)
        assert g["weight"].max() <= max(0.1, 1 / n) + 1e-9
        if n * 0.1 > 1:
            w = np.array([x for a, _, x in rows if a == d])
            for _ in range(500):
                over = np.maximum(w - 0.1, 0).sum()
                room = w < 0.1
                w = np.where(room, w + over * np.where(room, w, 0) / max(w[room].sum(), 1e-12), 0.1)
            assert np.allclose(np.sort(w), np.sort(g["weight"]), atol=1e-6)


def test_construction_checks():
    for bad in ({"scheme": "x"}, {"cap": 0.0}, {"gross": 1.5}):
        with pytest.raises(ValueError):
            portfolio.Construction(**bad)


def constant_panel(spark, days=130, rate=0.001):
    dates = pd.bdate_range("2020-01-01", periods=days)
    rows = []
    for s in (1, 2, 3):
        for i, d in enumerate(dates):
            close = 100 * (1 + rate) ** i
            rows.append((s, d.date(), i, close / (1 + rate), close, 0.0, True, bool(i + 1 == days or dates[i + 1].month != d.month)))
    return spark.createDataFrame(rows, "security_id long, date date, session_index int, open double, close double, half_spread double, in_index boolean, is_month_end boolean")


def test_constant_growth(spark):
    p = constant_panel(spark)
    cal = identity.derive_calendar(p)
    sched = backtest.rebalance_schedule(cal, "2020-01-01")
    w = p.where("is_month_end").select(F.lit("a").alias("run"), "date", "security_id", F.lit(1 / 3).alias("weight"))
    h = backtest.run_backtest(w, p, sched, costs.SETTINGS["free"]).cache()
    nav = backtest.daily_value(h, p).orderBy("session_index").toPandas()["nav"]
    assert np.allclose(nav.to_numpy()[1:] / nav.to_numpy()[:-1], 1.001)
    free = backtest.free_growth(w, p, sched).toPandas().sort_values("period")["growth"]
    runs = backtest.rebalances(h).toPandas().sort_values("period")["nav"]
    assert np.allclose(runs.to_numpy()[1:] / runs.to_numpy()[:-1], free.to_numpy()[:-1])
    assert backtest.equal_weight_reference(p, sched).count() == sched.count() - 1
    dear = backtest.run_backtest(w, p, sched, costs.SETTINGS["pessimistic"])
    assert backtest.rebalances(dear).agg(F.max("nav")).first()[0] < backtest.rebalances(h).agg(F.max("nav")).first()[0]
    assert backtest.reconcile(dear).first().ok


def test_audit_of_large_and_small_accounts(spark):
    """Rounding of a large account is no gap; a part in 1e9 of it is, and two cents of a small one are."""
    p = constant_panel(spark)
    sched = backtest.rebalance_schedule(identity.derive_calendar(p), "2020-01-01")
    w = p.where("is_month_end").select(F.lit("a").alias("run"), "date", "security_id", F.lit(0.3).alias("weight"))
    for capital, off in ((1e25, 1e16), (1e5, 0.02)):
        events = backtest.run_backtest(w, p, sched, costs.SETTINGS["pessimistic"], capital).cache()
        assert backtest.reconcile(events, capital).first().ok
        assert not backtest.reconcile(events, capital + off).first().ok
        wrong = F.when((F.col("kind") == "order") & (F.col("period") == 1) & (F.col("security_id") == 1), F.col("cash_flow") + off).otherwise(F.col("cash_flow"))
        assert not backtest.reconcile(events.withColumn("cash_flow", wrong), capital).first().ok
    assert registry.queries()["backtest_reconcile"](spark, "/root/testdata/sf0.01").first().ok


def plain_backtest(bars, dates, signals_, weights, model, capital, ends):
    """Session by session with dictionaries: bars[name][session] = (open, close, traded open, half spread)."""
    cash, shares, orders, navs, charged = capital, {}, [], {}, 0.0
    last = len(dates) - 1
    fills = {s + 1: s for s in signals_}
    first = min(fills)

    def cost(notional, price, hs):
        if notional == 0:
            return 0.0
        commission = min(max(model.rate * notional / price, model.minimum), model.most * notional)
        return commission + notional * (model.unknown if hs is None else hs) * model.spread + notional * model.bps / 1e4

    for t in range(first, last + 1):
        if t in fills:
            now = {n: shares.get(n, 0.0) * bars[n][t][0] for n in shares}
            nav = cash + sum(now.values())
            want = {n: w for n, w in weights[fills[t]].items()}
            names = sorted({*now, *(n for n in want if t in bars[n])})
            for n in sorted(want):
                if want[n] and t not in bars[n]:
                    orders.append((t, n, "unfilled", round(want[n] * nav, 4), 0.0))
            target = {n: want.get(n, 0.0) * nav for n in names}
            for _ in range(2):
                paid = {n: cost(abs(target[n] - now.get(n, 0.0)), bars[n][t][2], bars[n][t][3]) for n in names}
                target = {n: want.get(n, 0.0) * (nav - sum(paid.values())) for n in names}
            charged += sum(paid.values())
            for n in names:
                move = target[n] - now.get(n, 0.0)
                if move or paid[n]:
                    orders.append((t, n, "rebalance", round(abs(move), 4), round(abs(move) / bars[n][t][2], 4)))
            cash = nav - sum(target.values()) - sum(paid.values())
            shares = {n: v / bars[n][t][0] for n, v in target.items() if v}
        navs[t] = cash + sum(q * bars[n][t][1] for n, q in shares.items())
        for n in sorted(shares):
            if t < last and t + 1 not in bars[n]:
                resumes = any(s > t for s in bars[n])
                factor = 1.0 if resumes else 1 + ends.get(n, (0.0, ""))[0]
                value = shares.pop(n) * bars[n][t][1]
                reason = "exit:price_gap" if resumes else "exit:" + ends.get(n, (0.0, "unresolved"))[1]
                orders.append((t, n, reason, round(value, 4), round(value / bars[n][t][2], 4)))
                cash += value * factor
    return orders, navs, charged


@pytest.mark.parametrize("setting", ["free", "realistic", "pessimistic"])
def test_backtest_against_a_plain_loop(spark, setting):
    """Random prices with gaps, halts on the day of the fill, ends with a loss, splits, and all costs."""
    rng = np.random.default_rng(17)
    dates = pd.bdate_range("2020-01-01", periods=190)
    bars, rows = {}, []
    for n in range(8):
        price, own = 20.0 + 10 * n, {}
        for t in range(len(dates)):
            price *= float(np.exp(rng.normal(0, 0.02)))
            if rng.random() < 0.01 or (n == 3 and t > 120) or (n == 5 and t > 150):
                continue
            split = 4.0 if t < 60 + 10 * n else 1.0
            open_ = price * float(np.exp(rng.normal(0, 0.005)))
            hs = None if n == 2 else 0.0004 * (n + 1)
            own[t] = (open_, price, open_ * split, hs)
            rows.append((n, dates[t].date(), t, open_, price, hs, open_, split))
        bars[n] = own
    panel = spark.createDataFrame(rows, "security_id long, date date, session_index int, open double, close double, half_spread double, raw_open double, cum_split double")
    days = spark.createDataFrame([(d.date(),) for d in dates], "date date")
    sched = backtest.rebalance_schedule(identity.derive_calendar(days), "2020-01-01")
    signals_ = [r.session_index for r in sched.orderBy("period").collect()]
    weights = {}
    for s in signals_:
        w = rng.random(8) * (rng.random(8) < 0.6)
        w[[3, 5]] = 0.3  # held when their bars end
        weights[s] = {n: float(x) for n, x in enumerate(w / max(w.sum(), 1e-9) * rng.choice([0.7, 1.0])) if x}
    given = spark.createDataFrame([("a", dates[s].date(), n, x) for s, own in weights.items() for n, x in own.items()], "run string, date date, security_id long, weight double")
    ends = {3: (-0.5, "bankruptcy"), 5: (0.1, "acquisition")}
    frame_ = spark.createDataFrame([(n, *v) for n, v in ends.items()], "security_id long, delist_return double, reason string")
    events = backtest.run_backtest(given, panel, sched, costs.SETTINGS[setting], 50_000.0, frame_).cache()
    orders, navs, charged = plain_backtest(bars, dates, signals_, weights, costs.SETTINGS[setting], 50_000.0, ends)
    got = sorted((r.session, r.security_id, r.reason if r.status == "filled" else r.status, round(r.notional, 4), round(r.shares or 0.0, 4)) for r in backtest.ledger(events).collect())
    assert [x[:3] for x in got] == [x[:3] for x in sorted(orders)]
    assert np.allclose([x[3:] for x in got], [x[3:] for x in sorted(orders)], atol=2e-3)
    assert {x[2] for x in got} >= {"rebalance", "unfilled", "exit:price_gap", "exit:bankruptcy"}
    found = {r.session_index: r.nav for r in backtest.daily_value(events, panel).collect()}
    assert sorted(found) == sorted(navs) and np.allclose([found[t] for t in sorted(navs)], [navs[t] for t in sorted(navs)])
    audit = backtest.reconcile(events, 50_000.0).first()
    assert audit.ok and audit.charged == pytest.approx(charged)
    both = backtest.run_settings(given, panel, sched, {k: costs.SETTINGS[k] for k in ("free", setting)}, 50_000.0, frame_)
    assert {round(r.nav, 6) for r in backtest.rebalances(both).where(f"run = 'a|{setting}'").collect()} == {round(r.nav, 6) for r in backtest.rebalances(events).collect()}
    assert backtest.last_orders(backtest.ledger(events), 3).count() == 3
    sliced = backtest.ledger_between(backtest.ledger(events), sched, "2020-03-01", "2020-04-30")
    assert {str(r.signal_date)[:7] for r in sliced.select("signal_date").distinct().collect()} == {"2020-03", "2020-04"}


def test_costs(spark):
    rows = [(1000.0, 50.0, 0.001), (100000.0, 10.0, None), (50.0, 5.0, 0.0), (0.0, 5.0, 0.1)]
    out = costs.charge_detail(spark.createDataFrame(rows, "notional double, price double, half_spread double"), costs.SETTINGS["realistic"]).collect()
    assert [round(r.commission, 4) for r in out] == [1.0, 50.0, 0.5, 0.0]
    assert [r.bound for r in out] == ["minimum", "rate", "cap", "none"]
    assert out[1].spread_cost == pytest.approx(50.0)


def test_drawdown_and_holdout(spark):
    c = frame(spark, [(1, f"2024-01-{i + 1:02d}", v) for i, v in enumerate([100.0, 120.0, 90.0, 130.0])], "run_id long, date string, nav double", "date")
    r = metrics.performance(c).first()
    assert r.max_drawdown == pytest.approx(-0.25) and str(r.peak_date) == "2024-01-02" and str(r.trough_date) == "2024-01-03"
    w = frame(spark, [("2020-01-01", "2023-01-01")], "start string, end string", "start", "end")
    assert str(experiments.apply_holdout(w, "exclude").first().end) == "2021-12-31"
    assert experiments.apply_holdout(w, "include").first().touches
    with pytest.raises(ValueError):
        experiments.apply_holdout(w, "other")


def test_timing_legs(spark):
    hold = [False, False, True, True, False]
    b = frame(spark, [(i, f"2024-01-{i + 1:02d}", 1.0, 1.0, h) for i, h in enumerate(hold)], "session_index int, date string, open double, close double, h boolean", "date")
    out = b.withColumns(timing.from_return_days(F.col("h"))).orderBy("session_index").collect()
    assert [r.hold_on for r in out] == [False, True, True, False, False]
    with pytest.raises(ValueError):
        timing.rule("none")


def test_quality_clean_and_broken(spark):
    good = bars(spark, [100.0, 101.0, 102.0])
    assert quality.bar_integrity(good).count() == 0 and quality.primary_key(good, ["security_id", "date"], "bars").count() == 0
    bad = good.withColumn("high", F.when(F.col("close") == 101, 1.0).otherwise(F.col("high")))
    assert {r.detail for r in quality.bar_integrity(bad).collect()} == {"high below low", "high below open", "high below close"}
    assert quality.primary_key(good.union(good.limit(1)), ["security_id", "date"], "bars").first().rows == 2

    def crash():
        raise RuntimeError("x")

    found = quality.run(spark, {"a": lambda: quality.bar_integrity(bad), "b": crash}).collect()
    assert [r.severity for r in found] == ["ERROR"] * 4
    assert quality.schema_contract(good, ["date", "nothing"], ["volume"], ["date"]) == ["missing column nothing", "date is date, not a number", "volume is double, not a date"]


def test_lake(spark, tmp_path):
    lk = lake.Lake(spark, str(tmp_path))
    with pytest.raises(lake.NotBuilt):
        lk.read("silver", "prices/bars")
    for layer, name in (("silver", "prices/bars"), ("silver", "vendor/bars"), ("gold", "spread")):
        lk.write(spark.range(3), layer, name)
    assert set(lk.views()) == {"bars", "vendor_bars", "gold_spread"}
    assert lk.query("select sum(id) as s from bars").first().s == 3
    assert {r.name: r.rows for r in lk.catalog().collect()} == {"bars": 3, "vendor_bars": 3, "gold_spread": 3}
    a = lk.write_bronze("src", "d", "a.txt", b"one", ingest_date="2024-01-01")
    assert lk.write_bronze("src", "d", "a.txt", b"one", ingest_date="2024-01-01") == a
    with pytest.raises(FileExistsError):
        lk.write_bronze("src", "d", "a.txt", b"two", ingest_date="2024-01-01")
    b = lk.write_bronze("src", "d", "b.txt", b"two", ingest_date="2024-01-01")
    c = lk.write_bronze("src", "d", "c.txt", b"three", ingest_date="2024-01-01")
    lk.retire(c, "old")
    with open(b, "wb") as f:
        f.write(b"changed")
    crc = tmp_path / "bronze/src/d/ingest_date=2024-01-01/.b.txt.crc"
    if crc.exists():
        crc.unlink()
    assert {r.path: r.status for r in lk.verify().collect()} == {a: "ok", b: "corrupt", c: "retired"}
    assert lk.manifest().count() == 4


def test_parsers(spark):
    lines = spark.createDataFrame([("2020-01-01,1.5",), ("2020-01-02,.",), ("bad,3",)], "value string")
    assert [(str(r.date), r.value) for r in parse.series_csv(lines, "x").orderBy("date").collect()] == [("2020-01-01", 1.5), ("2020-01-02", None)]
    text = ["A preamble", ",Mkt,SMB", "19630701, 0.10,-99.99", "19630702,-0.20, 0.30", "", "Annual", "1964, 9.0, 8.0"]
    out = parse.factor_csv(spark.createDataFrame(list(enumerate(text)), "n int, value string"), ["mkt", "smb"]).orderBy("date").collect()
    assert [(r.mkt, r.smb) for r in out] == [(0.001, None), (-0.002, 0.003)]
    wiki = '{|\n! Ticker symbol\n! Company\n|-\n| {{NYSE|MMM}}\n| 3M\n|-\n| [[BRK.B]] || Berkshire\n|-\n| AAPL || Apple\n|}'
    got = [r.ticker for r in parse.wiki_constituents(spark.createDataFrame([(1, wiki)], "page int, text string")).collect()]
    assert got == ["MMM", "BRK.B", "AAPL"]
    rows = [("January 5, 2020[1]", "AAA", "", "x"), ("2020-01-05", "AAA", None, "again"), ("never", "B", "C", ""), ("2020-02-01", None, None, "")]
    assert parse.change_events(spark.createDataFrame(rows, "date string, added string, removed string, reason string")).count() == 1
    old, new = spark.createDataFrame([("A", 1), ("B", 1)], "k string, v int"), spark.createDataFrame([("A", 2)], "k string, v int")
    assert {(r.k, r.v) for r in parse.carry_forward(new, old, "k").collect()} == {("A", 2), ("B", 1)}


def test_surrogate_ids(spark):
    known = spark.createDataFrame([("SID000004", "A")], "security_id string, ticker string")
    seen = spark.createDataFrame([("B", 2), ("A", 1), ("C", 1), ("B", 9)], "ticker string, n int")
    out = {r.ticker: r.security_id for r in identity.assign_ids(known, seen, ["ticker"], "n").collect()}
    assert out == {"A": "SID000004", "C": "SID000005", "B": "SID000006"}


def test_stream_upsert(spark, tmp_path):
    schema = "k string, v int, t int"
    src, table, check = (str(tmp_path / x) for x in ("src", "table", "check"))
    from pyspark.sql import types as T

    st = T.StructType().add("k", "string").add("v", "integer").add("t", "integer")
    spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], schema).coalesce(1).write.json(src)
    ingest.upsert_latest(ingest.read_log(spark, src, st), table, check, ["k"], "t").awaitTermination()
    spark.createDataFrame([("a", 2, 2), ("b", 0, 0)], schema).coalesce(1).write.mode("append").json(src)
    ingest.upsert_latest(ingest.read_log(spark, src, st), table, check, ["k"], "t").awaitTermination()
    assert {(r.k, r.v) for r in ingest.current(spark, table).collect()} == {("a", 2), ("b", 1)}


def test_breeding():
    rng = np.random.default_rng(0)
    box, how = genomes.space("price"), evolve.Search(size=30, elite=3, fresh=4)
    x = box.draw(30, rng)
    assert (x >= box.low).all() and (x <= box.high).all() and (x[:, box.whole] == np.rint(x[:, box.whole])).all()
    fit = rng.normal(size=30)
    won = evolve.parents(np.array([0.0, 5.0, 5.0]), 200, rng, 20)
    assert set(won) == {1}
    plain = evolve.Search(cross=1.0, move=0.0, renew=0.0)
    child = evolve.bred(x[:10], x[10:20], evolve.replace(box, whole=np.zeros_like(box.whole)), rng, plain)
    assert (np.abs(child - (x[:10] + x[10:20]) / 2) <= np.abs(x[:10] - x[10:20]) + 1e-9).all()
    assert (evolve.bred(x[:10], x[10:20], box, rng, evolve.Search(cross=0.0, move=0.0, renew=0.0)) == x[:10]).all()
    same = np.repeat(x[:1], 5, axis=0)
    changed, n = evolve.novel(same, box, rng, how, set())
    assert n == 4 and len(set(box.marks(changed))) == 5
    stuck, n = evolve.novel(same, box, rng, evolve.Search(tries=0), set(box.marks(x[:1])))
    assert n == 5 and len(set(box.marks(stuck)) | set(box.marks(x[:1]))) == 6  # drawn anew, not left as they are
    y = evolve.next_generation(x, fit, box, rng, how, set(box.marks(x)))
    assert y.shape == x.shape and (y[:3] == x[np.argsort(-fit)[:3]]).all() and not set(box.marks(y[3:26])) & set(box.marks(x))
    assert evolve.spread_of(same, box) < 1e-12 < evolve.spread_of(x, box)
    folds = evolve.contiguous_folds("2000-01-01", "2004-01-01", 4)
    assert folds[0].start == "2000-01-01" and all(x.end < y.start for x, y in zip(folds, folds[1:]))
    assert evolve.random_folds("2000-01-01", "2010-01-01") == evolve.random_folds("2000-01-01", "2010-01-01")


def test_search_spaces(spark):
    box = genomes.space("families")
    v = box.vector(dict.fromkeys(box.names[:9], 0.5) | {"f_momentum": 0.9, "f_value": 0.8, "f_payout": 0.05} | genomes.PLAIN_SHAPE)
    assert [n for n, _ in genomes.family_weights(box, v)] == ["momentum", "value", "reversal"]  # three at most, of equal ones the first
    assert genomes.live_features(box, v)[:2] == ["mom_12_1", "resid_mom_12_1"] and "div_yield" not in genomes.live_features(box, v)
    said = box.params(v)
    assert said["weighting"] == "equal" and said["top_k"] == 50 and said["f_low_risk"] == 0.0
    assert (box.vector(said) == box.behaving(v)[0]).all() and box.marks(v) == box.marks(box.vector(said))
    assert list(genomes.recipes("families")) == list(genomes.FAMILIES) and set(genomes.recipes("price")) == {"momentum", "residual_momentum", "low_vol", "lottery_averse", "reversal", "trend"}
    night = genomes.space("night")
    w = night.vector({n: 0.05 if i else -0.5 for i, n in enumerate(night.names[: night.signals])} | genomes.PLAIN_SHAPE)
    assert genomes.live_features(night, w) == ["mom_12_1"] and genomes.family_weights(night, w) == []
    assert set(genomes.features_of("families")) >= {"cf_yield", "eps_surprise"} and genomes.space("full").signals == 23
    with pytest.raises(KeyError):
        genomes.space("none")
    with pytest.raises(ValueError):
        box.inside(np.zeros(3))
    x = spark.createDataFrame([(0.1, 0.9, None), (None, None, 0.5), (None, None, None)], "a double, b double, c double")
    got = [r.s for r in x.select(genomes.ensemble(["a", "b", "c"], least=1).alias("s")).collect()]
    assert got == [0.5, 0.5, None]


def test_search_goes_on_from_its_checkpoint(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(d.date(), i, float(rng.random()), float(rng.random()), float(rng.normal(0, 0.05))) for d in pd.date_range("2000-01-31", periods=24, freq="ME") for i in range(8)]
    ranked = spark.createDataFrame(rows, "date date, security_id long, f1 double, f2 double, fwd double").cache()
    folds, box, how = evolve.contiguous_folds("2000-01-01", "2002-01-01", 2), evolve.box(["f1", "f2"]), evolve.Search(size=5, fresh=1)
    best, history = evolve.evolve(ranked, box, folds, 3, 3, 7, how)
    path = str(tmp_path / "search")
    evolve.evolve(ranked, box, folds, 2, 3, 7, how, path)
    again, longer = evolve.evolve(ranked, box, folds, 3, 3, 7, how, path)
    assert history == longer and (best == again).all() and len(evolve.load_history(spark, path)) == 3
    top = evolve.search_best(spark, path, box, 3)
    assert len(top) == 3 and top[0][0] == max(h["best"] for h in history) and evolve.load_history(spark, path + "-none") == []
    genes = [np.array([0.5, -0.25]), np.array([0.0, 0.0])]
    found = {(r.genome, r.date): r.ret for r in evolve.evaluate(evolve.genomes_frame(spark, genes), ranked, ["f1", "f2"], 3).collect()}
    assert {g for g, _ in found} == {0}
    for d in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == d), key=lambda r: -(0.5 * r[2] - 0.25 * r[3]))
        assert found[0, d] == pytest.approx(np.mean([r[4] for r in own[:3]]))


def test_registry(spark, tmp_path):
    reg = runlog.Registry(spark, str(tmp_path / "reg"))
    assert reg.runs().count() == 0 and reg.touches().count() == 0
    kw = {"strategy": "s", "params": {"b": 2, "a": 1}, "setting": "realistic", "start": "2010-01-01", "end": "2020-12-31"}
    with runlog.study("one"):
        first = reg.log_run(**kw, sharpe=0.5)
        with runlog.study("two"):
            reg.log_run(**(kw | {"params": {"a": 1, "b": 2}}), sharpe=0.6)
        assert runlog.current_study() == "one"
    assert runlog.current_study() == runlog.UNNAMED
    runs = reg.runs()
    assert {r.study for r in runs.collect()} == {"one", "two"} and runs.select("fingerprint").distinct().count() == 1
    assert runlog.run_rows(runs).count() == 2 and runs.select(runlog.parameter("params", "b")).first()[0] == "2"
    values = spark.createDataFrame([(pd.Timestamp(d).date(), v) for d, v in (("2020-01-30", 1.0), ("2020-01-31", 2.0), ("2020-02-10", 3.0))], "date date, nav double")
    reg.log_curve(first["run_id"], values.withColumn("nav", F.col("nav") * 10))
    reg.log_curve(first["run_id"], values)
    assert [r.nav for r in reg.curves().orderBy("date").collect()] == [2.0, 3.0]
    window = {"strategy": "s", "start": "2020-01-01", "boundary": "2022-01-01"}
    assert reg.run(lambda: 7, mode="exclude", end="2021-12-31", **window) == 7 and reg.touches().count() == 0
    with pytest.raises(ValueError):
        reg.run(lambda: 7, mode="exclude", end="2022-06-30", **window)
    with pytest.raises(RuntimeError):
        reg.run(lambda: (_ for _ in ()).throw(RuntimeError()), mode="include", end="2022-06-30", **window)
    assert [r.mode for r in reg.touches().collect()] == ["include"]  # a run that fails has looked too
    with pytest.raises(ValueError), runlog.study(" "):
        pass
    a = runlog.data_version(values, ["date"]).first()[0]
    assert a == runlog.data_version(values.orderBy("nav", ascending=False), ["date"]).first()[0] != runlog.data_version(values.limit(2), ["date"]).first()[0]


def test_seals_and_forward(spark):
    runs = spark.createDataFrame([("a", 1, False), ("b", 2, False)], "strategy string, seed int, touches boolean")
    seals = forward.seal(runs, ["strategy", "seed"], " why ", "2024-01-01")
    assert seals.columns == ["seal_id", "sealed_at", "rationale", "strategy", "seed"] and {r.rationale for r in seals.collect()} == {"why"}
    assert forward.new_seals(seals, seals.limit(1)).count() == 1
    with pytest.raises(ValueError):
        forward.seal(runs.withColumn("touches", F.col("seed") == 2), ["strategy"], "why", "2024-01-01")
    with pytest.raises(ValueError):
        forward.seal(runs, ["strategy"], "  ", "2024-01-01")
    ends = frame(spark, [("2021-06-30",)], "data_end string", "data_end")
    with pytest.raises(forward.ForwardError):
        forward.forward_window(ends).first()
    assert forward.forward_window(frame(spark, [("2023-12-31",)], "data_end string", "data_end"), "2000-01-01").first().months == 24
    base = {"sharpe_r": 0.3, "sharpe_f": 0.3, "se_r": 0.1, "se_f": 0.1, "n_f": 30, "ruined_f": False, "cagr_f": 0.1, "bench_sharpe_r": 0.1, "bench_sharpe_f": 0.1, "bench_cagr_f": 0.05, "max_drawdown_f": -0.1, "max_drawdown_r": -0.2, "turnover_f": 1.0, "turnover_r": 1.0}
    cases = [({}, "held"), ({"n_f": 23}, "inconclusive"), ({"ruined_f": True}, "failed"), ({"cagr_f": -0.01}, "failed"), ({"sharpe_f": 0.0, "bench_sharpe_f": -0.5}, "failed"), ({"bench_sharpe_f": 0.4}, "decayed"), ({"sharpe_f": 0.12, "bench_sharpe_f": 0.0}, "decayed"), ({"se_f": None}, "held"), ({"cagr_f": None}, "held")]
    x = spark.createDataFrame([tuple((base | c)[k] for k in base) + (i,) for i, (c, _) in enumerate(cases)], ", ".join(f"{k} {'boolean' if k == 'ruined_f' else 'int' if k == 'n_f' else 'double'}" for k in base) + ", i int")
    got = [r.verdict for r in forward.verdict(forward.checks(forward.comparison(x))).orderBy("i").collect()]
    assert got == [v for _, v in cases]

    def bad():
        raise RuntimeError("no data")

    ok, failed = forward.suite({"good": lambda: runs, "bad": bad, "worse": lambda: runs.select("nothing")}, lambda w: w.select("strategy"))
    assert ok.count() == 2 and set(failed) == {"bad", "worse"} and failed["bad"] == "RuntimeError: no data"
    log = spark.createDataFrame([("s", "realistic", "paired")] * 2, "seal_id string, setting string, mode string")
    assert forward.records(spark.createDataFrame([("s", "realistic"), ("t", "realistic")], "seal_id string, setting string"), log, "now", "paired").orderBy("seal_id").select("look").collect()[0].look == 3


def test_forward_test(spark):
    p = constant_panel(spark, 520, 0.0005)
    cal = identity.derive_calendar(p)
    w = p.where("is_month_end").select(F.lit("a").alias("run"), "date", "security_id", F.lit(1 / 3).alias("weight"))
    bench = cal.select("date", (100 + F.col("session_index") / 100).alias("close"))
    r = forward.forward_test(w, p, cal, bench, "2020-01-01", "2021-01-01", "continuous", {"free": costs.SETTINGS["free"]}, 6).first()
    assert r.run == "a|free" and r.n_r >= 10 and r.n_f >= 10 and r.cagr_f == pytest.approx(1.0005**260.9 - 1, abs=0.01) and not r.ruined_f and r.enough_data
    with pytest.raises(ValueError):
        forward.forward_test(w, p, cal, bench, "2020-01-01", mode="other")


def test_acceptance(spark):
    p = constant_panel(spark)
    assert set(acceptance.cheats_blocked(p, 10).values()) == {True} and acceptance.AsOf(p, 10).at(3).count() == 3
    assert acceptance.differing(p, p).count() == 0 and acceptance.differing(p, p.limit(1)).count() == p.count() - 1
    sched = backtest.rebalance_schedule(identity.derive_calendar(p), "2020-01-01")
    good = p.where("is_month_end").select(F.lit("good").alias("run"), "date", "security_id", F.lit(1 / 3).alias("weight"))
    bad = good.withColumns({"run": F.lit("bad"), "weight": F.when(F.col("security_id") == 1, -0.5).otherwise(1.0)})
    odd = good.withColumns({"run": F.lit("odd"), "weight": F.when(F.col("security_id") == 1, float("nan")).otherwise(0.1)})
    found = {r.run: r for r in acceptance.contract(good.unionByName(bad).unionByName(odd.where("security_id > 1").unionByName(odd.where("security_id = 1").withColumn("weight", F.lit(None).cast("double")))), p, sched, costs.SETTINGS["realistic"], costs.SETTINGS["free"]).collect()}
    assert found["good"].ok and not found["bad"].ok and not found["bad"].not_negative and not found["bad"].no_leverage and not found["odd"].finite
    own = backtest.free_growth(good, p, sched)
    ref = backtest.equal_weight_reference(p, sched)
    assert acceptance.index_reproduced(own, ref, 0.5).first().ok
    c = p.where("security_id = 1").select("date", F.col("close").alias("nav"))
    assert acceptance.calibrated(c, c).first().ok and not acceptance.dividends_in_band(c, c).first().ok
    none = quality.primary_key(p, ["security_id", "date"], "p")
    one = quality.primary_key(p.union(p.limit(1)), ["security_id", "date"], "p")
    assert [s[1] for s in acceptance.stages({"a": lambda: none, "b": lambda: one, "c": lambda: none})] == ["ok", "failed", "skipped"]
    assert acceptance.stages({"a": lambda: none.select("nothing")})[0][1].startswith("failed")


def test_ingest(spark, tmp_path):
    budget = feeds.Budget(10, 3)
    assert budget.spend("a", lambda: b"x", 7) == b"x" and budget.used == 7
    with pytest.raises(feeds.BudgetExhausted):
        budget.spend("b", lambda: b"y")
    assert budget.spend("b", lambda: b"y", cached=lambda: b"z") == b"z"
    with pytest.raises(FileNotFoundError):
        feeds.zip_member(b"PK\x05\x06" + bytes(18))
    head, rows = feeds.html_tables("<table><tr><td>a<td>b<tr><td colspan=2>1</table>")[0]
    assert head == ["a", "b"] and rows == [["1", "1"]]
    with pytest.raises(LookupError):
        feeds.pick_table("<table><tr><th>a</table>", "b", 0)
    asked = []
    got = feeds.pages(lambda t: (asked.append(t), {None: ([{"k": 1, "v": "x"}, {"k": 2, "v": "y"}], "p2"), "p2": ([{"k": 2, "v": "late"}], None)}[t])[1], "k")
    assert [r["v"] for r in got] == ["x", "y"] and asked == [None, "p2"]
    sizes = []
    assert len(feeds.batched(range(120), lambda ks: sizes.append(len(ks)) or {k: k for k in ks})) == 120 and sizes == [50, 50, 20]
    b = bars(spark, [1200.0, 1210.0, 121.0])
    day = str(b.agg(F.max("date")).first()[0])
    assert feeds.split_convention(b, day, 1210.0, 10.0) == "as_traded" and feeds.split_convention(b.withColumn("close", F.lit(121.0)), day, 1210.0, 10.0) == "split_adjusted"
    assert feeds.split_convention(b, "1990-01-01", 1.0, 2.0) == "inconclusive" and feeds.split_convention(b.limit(0), day, 1.0, 2.0) == "no data"
    wide = b.select(F.lit("SPY").alias("ticker"), "date", "close")
    own, cal = feeds.benchmarks(wide.union(wide), {"SPY": "fund"}, "vendor", "SPY")
    assert own.count() == cal.count() == 3 and own.first().description == "fund"
    with pytest.raises(LookupError):
        feeds.benchmarks(wide, {}, "vendor", "IVV")
    assert feeds.lookup(wide, "ticker", "close", "none") is None and feeds.lookup(wide.limit(1), "ticker", "close", "SPY") == 1200.0
    path = str(tmp_path / "result")
    feeds.save_result(spark, path, {"equity": wide, "trades": wide}, {"a": 1}, {"sharpe": 0.5})
    tables, config, stats = feeds.load_result(spark, path)
    assert set(tables) == {"equity", "trades"} and config == {"a": 1} and stats == {"sharpe": 0.5} and spark.read.option("header", True).csv(path + "/trades_csv").count() == 3
    with pytest.raises(FileNotFoundError):
        feeds.load_result(spark, path + "-none")
    with pytest.raises(ValueError):
        feeds.save_result(spark, path, {"other": wide}, {}, {})
    known = spark.createDataFrame([(1,)], "security_id long")
    with pytest.raises(KeyError):
        feeds.aligned(spark.createDataFrame([(1, 0.5), (2, 0.5)], "security_id long, weight double"), known)
    x = spark.createDataFrame([(1, float("nan")), (1, 2.0), (1, 2.0)], "d int, v double")
    assert x.groupBy("d").agg(feeds.first_finite(F.col("v")).alias("v")).first().v == 2.0



def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(t, s, *map(float, rng.normal(size=3))) for t in range(40) for s in range(12)]
    x = spark.createDataFrame(rows, "session_index int, security_id long, a double, b double, y double")
    at = spark.createDataFrame([(35,)], "session_index int")
    got = learned.rolling_ridge(x, ["a", "b"], "y", at, 20, 5, 2.0).first().coef
    use = np.array([r[2:] for r in rows if 10 < r[0] <= 30])
    m = np.column_stack([np.ones(len(use)), use[:, :2]])
    want = np.linalg.solve(m.T @ m + np.diag([0, 2, 2]), m.T @ use[:, 2])
    assert got == pytest.approx(want.tolist())


def test_command_line(spark, tmp_path, tiny, capsys):
    from pitlake import cli
    from pitlake.plans import standins as S

    lk = lake.Lake(spark, str(tmp_path))
    for name, df in (("daily_bars", S.dense_panel(spark, tiny).select("security_id", "date", "open", "high", "low", "close", "volume")), ("corporate_actions", S.actions(spark, tiny)), ("trading_calendar", S.calendar(spark, tiny)), ("membership_intervals", S.intervals(spark, tiny)), ("xbrl_facts", S.facts(spark, tiny))):
        lk.write(df, "silver", name)
    root = str(tmp_path)
    for args in (["status"], ["quality"], ["normalize"], ["features"], ["catalog"], ["query", "select count(*) as n from daily_bars"], ["universe", "1998-06-15"], ["fundamentals", "1998-06-15"], ["backtest", "equal_weight", "--start", "1996-01-01", "--top", "3"]):
        cli.main([root, *args])
    out = capsys.readouterr().out
    assert "daily_bars" in out and "beta_252d" in out
    assert lk.read("gold", "features").count() > 0


def test_market_cap_of_every_bar(spark, tiny):
    bars_ = S.bars(spark, tiny).collect()
    facts, splits = {}, {}
    for f in S.facts(spark, tiny).collect():
        facts.setdefault(f.security_id, {}).setdefault(f.filed_date, []).append(f.value)
    for a in S.actions(spark, tiny).where("action_type = 'split'").collect():
        splits.setdefault(a.security_id, []).append(a.date)
    want = {}
    for b in bars_:
        filed = max((f for f in facts.get(b.security_id, ()) if f <= b.date), default=None)
        cap = max(facts[b.security_id][filed]) * 2.0 ** sum(filed < s <= b.date for s in splits.get(b.security_id, ())) * b.close if filed else 0
        want[b.security_id, b.date.isoformat()] = cap if cap >= 1e8 else None
    rows = registry.queries()["market_cap_whole"](spark, tiny).collect()
    got = {(r.security_id, r.date): r.market_cap for r in rows}
    assert len(rows) == len(got) == len(want) and got.keys() == want.keys()
    assert all(got[k] == (None if v is None else pytest.approx(v, abs=0.06)) for k, v in want.items())
    assert {k[1][8:] for k, v in got.items() if v is not None} > {f"{i:02d}" for i in range(1, 28)}


@pytest.mark.parametrize("seed", range(3))
def test_dividends_at_the_limit(spark, seed):
    """A fall by just 5 % is no cut and sums are the nearest doubles, in whatever order dividends come."""
    rng = random.Random(seed)
    rows, want = [], {}
    for s in range(60):
        cents = [rng.randint(0, 10) for _ in range(rng.randint(5, 40))]
        cents += [20 - sum(cents) % 20]
        before, now = sum(cents), sum(cents) * 19 // 20 - s % 2
        parts = [now // 7] * 6 + [now - now // 7 * 6]
        rows += [(s, datetime.date(2020, 1, 1) + datetime.timedelta(rng.randint(0, 300)), "dividend", c / 100) for c in cents]
        rows += [(s, datetime.date(2021, 3, 1) + datetime.timedelta(rng.randint(0, 200)), "dividend", c / 100) for c in parts]
        want[s] = (float(s % 2), (now / 100) / (before / 100) - 1, (now / 100) / 50.0, 1.0)
    rng.shuffle(rows)
    actions = spark.createDataFrame(rows, "security_id long, date date, action_type string, value double")
    grid = spark.createDataFrame([(s, datetime.date(2021, 12, 31), 50.0) for s in want], "security_id long, date date, close double")
    cutoff = datetime.date(2021, 12, 31) - datetime.timedelta(743)
    assert min(r[1] for r in rows) >= cutoff
    got = {r.security_id: (r.div_cut, r.div_growth_1y, r.div_yield, r.pays_dividend) for r in ff.dividend_features(actions, grid).collect()}
    assert got == want


def test_dividend_due_of_every_security(spark, tiny):
    ex = {}
    for a in S.actions(spark, tiny).where("action_type = 'dividend'").collect():
        ex.setdefault(a.security_id, set()).add(a.date)
    want = {}
    for g in S.panel(spark, tiny).where("is_month_end").collect():
        known = sorted(x for x in ex.get(g.security_id, ()) if x <= g.date)[-5:]
        due = None
        if len(known) >= 3:
            gap = statistics.median((b - a).days for a, b in zip(known, known[1:], strict=False))
            due = float(20 <= gap <= 200 and -10 <= (known[-1] - g.date).days + gap <= 31)
        want[g.security_id, g.date.isoformat()] = due
    rows = registry.queries()["feature_div_due_1m_whole"](spark, tiny).collect()
    assert len(rows) == len(want) and {(r.security_id, r.date): r.div_due_1m for r in rows} == want
    assert {k[0] for k in want} == set(range(10)) and set(want.values()) == {None, 0.0, 1.0}
