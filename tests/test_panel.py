"""Panel ETL, targets, metrics, tuning and file formats."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmament.operators import metrics as M
from firmament.operators import panel as P
from firmament.operators import targets as TG
from firmament.plans import tuning as TU
from firmament.sources import files as S

D = dt.date


def long(spark, X, value="x"):
    base = D(2020, 1, 1)
    return spark.createDataFrame(
        [(base + dt.timedelta(t), t, i, None if np.isnan(v) else float(v)) for t, r in enumerate(X) for i, v in enumerate(r)],
        f"date date, t int, firm long, {value} double")


def test_matrix_round_trip(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("ticker,X20000103,X20000104\nA,0.1,\nB,-0.2,0.3\n")
    got = {(str(r["date"]), r["firm"]): r["value"] for r in S.read_matrix(spark, str(path)).collect()}
    assert got == {("2000-01-03", "A"): 0.1, ("2000-01-04", "A"): None, ("2000-01-03", "B"): -0.2, ("2000-01-04", "B"): 0.3}


def test_small_readers(spark, tmp_path):
    (tmp_path / "cal.csv").write_text("20000103\n20000104\n")
    assert [str(r["date"]) for r in S.read_calendar(spark, str(tmp_path / "cal.csv")).orderBy("date").collect()] == ["2000-01-03", "2000-01-04"]
    (tmp_path / "a.csv").write_text("Ticker,Name,Sector_Wikipedia\nA,x,Tech\nB,y,\n")
    (tmp_path / "b.csv").write_text("1,n,B,Energy\n2,n,C,SPY\n3,n,A,Other\n")
    firms = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "firm string")
    sec = P.resolve_sector(firms, S.read_sector_named(spark, str(tmp_path / "a.csv")), S.read_sector_positional(spark, str(tmp_path / "b.csv")))
    assert {r["firm"]: r["sector"] for r in sec.collect()} == {"A": "Tech", "B": "Energy", "C": "Unknown", "D": "Unknown"}
    (tmp_path / "t.json").write_text(json.dumps(["Q", "R"]))
    assert [(r["idx"], r["firm"]) for r in S.read_ticker_index(spark, str(tmp_path / "t.json")).collect()] == [(0, "Q"), (1, "R")]
    u = str(tmp_path / "uni")
    S.create_universe_if_missing(spark.createDataFrame([("Z", 0), ("A", 1)], "firm string, pos int"), u)
    S.create_universe_if_missing(spark.createDataFrame([("N", 0)], "firm string, pos int"), u)
    assert [(r["pos"], r["firm"]) for r in S.read_universe(spark, u).orderBy("pos").collect()] == [(0, "Z"), (1, "A")]
    lab = tmp_path / "l.csv"
    lab.write_text('id,date,title,universe_tickers,label,reason\n1,1/2/11,"A, ""B"" C","X,Y",acquisition: X-Y,why\n')
    r = S.read_labels(spark, {"p": str(lab)}).first()
    assert r["title"] == 'A, "B" C' and r["panel"] == "p"
    news = tmp_path / "n.csv"
    news.write_text('Unnamed,Date,Article_title,Stock_symbol,Url,Publisher,Body\n0,2010-01-01 00:00:00 UTC,"T, x",A,u,p,zz\n')
    n = S.read_news(spark, str(news)).first()
    assert n["Article_title"] == "T, x" and len(n) == 5


def test_news_with_line_breaks_and_more_columns(spark, tmp_path):
    folder = tmp_path / "news"
    folder.mkdir()
    for i in range(2):
        (folder / f"{i}.csv").write_text(
            'Unnamed,Date,Article_title,Stock_symbol,Url,Publisher,Body\n'
            f'0,2010-01-0{i + 1} 00:00:00 UTC,"T{i}\nsecond line",A,u{i},p,"a\n\n""b"", c"\n'
            f'1,not a date,X,A,v{i},p,z\n2,2030-01-01,late,A,w{i},p,z\n3,2010-01-01,other,N,x{i},p,z\n')
    raw = S.read_news(spark, str(folder))
    assert raw.count() == 8 and {r["Stock_symbol"] for r in raw.collect()} == {"A", "N"}
    from firmament.operators import news as NW
    from firmament.streaming import news as SN
    tickers = spark.createDataFrame([("A",)], "firm string")
    batch = NW.filter_news(raw, tickers)
    q = SN.stream_news(spark, str(folder), tickers, 1).writeStream.format("memory").queryName("news_rows").trigger(
        availableNow=True).start()
    q.awaitTermination()
    streamed = spark.table("news_rows").select(*batch.columns)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect())) and batch.count() == 2


def test_every_line_item_takes_part_in_the_edges(spark, sf_dir):
    from firmament.plans import derive as D
    li = D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", *D.LINE_ORDER[:1]).collect()
    orders = {r["l_orderkey"] for r in li}
    rows = D.line_pairs(spark, sf_dir).collect()
    same = len(li) - len(orders) - len(rows)  # neighbours of one supplier make no edge
    assert 0 <= same < 0.2 * len(li) and len({(r["l_orderkey"], r["seq"]) for r in rows}) == len(rows)


def test_a_saved_panel_comes_back(spark, tmp_path):
    panel = spark.createDataFrame([(0, 7, 1.0), (0, 8, 2.0), (1, 7, 3.0)], "t int, firm long, x double")
    S.write_table(panel, str(tmp_path / "p"))
    uni = spark.createDataFrame([(0, 7)], "pos int, firm long")
    assert sorted((r["t"], r["pos"], r["x"]) for r in S.load_panel(spark, str(tmp_path / "p"), uni).collect()) == [(0, 0, 1.0), (1, 0, 3.0)]
    S.write_table(panel, str(tmp_path / "c"), "csv")
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 3


def test_snapshot_files(spark, tmp_path):
    w = tmp_path / "w60"
    w.mkdir()
    np.savez(w / "multiplex_20200110.npz", **{
        "ACQUIRES__row": np.array([0, 1]), "ACQUIRES__col": np.array([1, 0]), "ACQUIRES__data": np.array([2.0, 3.0], "float32"),
        "ANALYZES__row": np.array([0]), "ANALYZES__col": np.array([2]), "ANALYZES__data": np.array([1.0], "float32")})
    np.savez(w / "unified_20200110.npz", row=np.array([0]), col=np.array([7]), data=np.array([1.5], "float32"))
    got = sorted((str(r["snap_date"]), r["win"], r["layer"], r["src"], r["dst"], r["weight"], r["seq"])
                 for r in S.read_snapshots(spark, str(tmp_path)).collect())
    assert got == [("2020-01-10", 60, "ACQUIRES", 0, 1, 2.0, 0), ("2020-01-10", 60, "ACQUIRES", 1, 0, 3.0, 1),
                   ("2020-01-10", 60, "ANALYZES", 0, 2, 1.0, 0)]
    index = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "idx int, firm string")
    assert S.index_to_firm(S.read_snapshots(spark, str(tmp_path), "unified"), index).isEmpty()
    from firmament.operators import graph as G
    uni = spark.createDataFrame([("A", 0), ("B", 1)], "firm string, pos int")
    g = G.layer_graph(S.index_to_firm(S.read_snapshots(spark, str(tmp_path)), index), uni).collect()
    assert [(r["src"], r["dst"], r["weight"]) for r in g] == [("A", "B", 3.0)]


def test_validation_raises(spark):
    p = long(spark, np.array([[1.0, np.nan], [2.0, 3.0]]), "value")
    cal = p.select("date").distinct()
    assert P.validate_panel(p, cal).where("value is null").isEmpty()
    with pytest.raises(ValueError, match="not trading"):
        P.validate_panel(p, cal.limit(1))
    with pytest.raises(ValueError, match="missing values"):
        P.validate_panel(p, cal, max_missing_cells=0)
    gap = p.where("t = 0").unionByName(p.where("t = 1").withColumn("date", F.date_add("date", 20)))
    days = spark.createDataFrame([(D(2020, 1, 1) + dt.timedelta(i),) for i in range(40)], "date date")
    with pytest.raises(ValueError, match="lacks"):
        P.validate_panel(gap, days)


def test_blocks_and_slices(spark):
    p = long(spark, np.arange(7.0)[:, None])
    got = [(str(r["date"]), r["t"], r["x"]) for r in P.horizon_blocks(p, 3).orderBy("t").collect()]
    assert got == [("2020-01-01", 0, 3.0), ("2020-01-04", 1, 12.0), ("2020-01-07", 2, 6.0)]
    assert P.horizon_blocks(p, 1).count() == 7
    cal = P.calendar_of(p)
    s = P.slice_rows(p, cal, "2020-01-04", "2020-01-05", warmup=2).orderBy("t").collect()
    assert [(r["t"], r["x"]) for r in s] == [(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0)]
    assert P.slice_rows(p, cal, "2019-01-01", "2030-01-01", warmup=2).count() == 7
    assert (P.scaled_lookback(21), P.scaled_lookback(1), P.periods_per_year(5)) == (60, 1008, 50.4)


def test_universe_ties_and_unknown(spark):
    c = spark.createDataFrame([(1, 5.0), (1, None), (2, 5.0), (3, 9.0), (4, 1.0)], "firm long, volume double")
    sec = spark.createDataFrame([(1, "a"), (2, "a"), (3, "Unknown"), (4, "b")], "firm long, sector string")
    assert [(r["pos"], r["firm"]) for r in P.top_by_mean(c, sec, 2).orderBy("pos").collect()] == [(0, 1), (1, 2)]


def test_trailing_mean_counts(spark):
    X = np.arange(1.0, 31.0)[:, None]
    X[3] = np.nan
    got = {r["t"]: r["target"] for r in TG.volume_target(long(spark, X, "volume")).collect()}
    assert min(got) == 22  # 21 known values lie before row 22, one having been missing
    seen = np.log(np.delete(X[:22, 0], 3) + 1e-3)
    assert got[22] == pytest.approx(np.log(23.0 + 1e-3) - seen.mean())


def forecasts(spark, rows):
    return spark.createDataFrame([("m", t, f, float(x), float(p)) for t, f, x, p in rows],
                                 "model string, t int, firm long, x double, pred double")


def test_metrics_identities(spark):
    rng = np.random.default_rng(0)
    rows = [(t, f, rng.normal(), rng.normal()) for t in range(40) for f in range(5)]
    f = forecasts(spark, rows)
    s, e = M.statistical_metrics(f).first(), M.economic_metrics(f, 1.0, 252).first()
    assert s["dir_acc"] == pytest.approx(e["hit_ratio"], abs=1e-15)
    x, p = (np.array([r[i] for r in rows]).reshape(40, 5) for i in (2, 3))
    assert s["oos_r2"] == pytest.approx(1 - ((x - p) ** 2).sum() / (x ** 2).sum())
    pnl = (np.sign(p) * x).sum(1)
    sr = pnl.mean() / pnl.std(ddof=1)
    c = pnl - pnl.mean()
    g3, g4 = (c ** 3).mean() / (c ** 2).mean() ** 1.5, (c ** 4).mean() / (c ** 2).mean() ** 2
    z = sr / np.sqrt((1 - g3 * sr + (g4 - 1) * sr ** 2 / 4) / 39)
    from firmament.functions.stats import normal_two_sided
    assert e["ann_sharpe"] == pytest.approx(sr * np.sqrt(252)) and e["sharpe_p"] == pytest.approx(normal_two_sided(z))
    other = f.withColumn("model", F.lit("n")).withColumn("pred", F.col("pred") * 0.5)
    both = f.unionByName(other)
    ab, ba = (M.diebold_mariano(both, [q]).first()["dm"] for q in (("m", "n"), ("n", "m")))
    assert ab == pytest.approx(-ba)
    d = ((x - p) ** 2 - (x - p / 2) ** 2).mean(1)
    assert ab == pytest.approx(d.mean() / np.sqrt(d.var(ddof=1) / 40))


def test_top_fraction_keeps_ties(spark):
    f = forecasts(spark, [(0, i, 1.0, p) for i, p in enumerate((3, -3, 2, 1))])
    assert M.daily_pnl(f, 0.25).first()["trades"] == 2


def test_constant_pnl_has_no_sharpe(spark):
    f = forecasts(spark, [(t, 0, 1.0, 1.0) for t in range(5)])
    assert M.economic_metrics(f).first()["ann_sharpe"] is None


def test_folds_and_tuning(spark):
    assert TU.expanding_folds(1007) == [(203, 404), (404, 605), (605, 806), (806, 1007)]
    assert TU.fold_sums(np.zeros(3), np.ones(3)) == {"sse": 3.0, "sst": 3.0, "calls": 0.0, "hits": 0.0}
    rng = np.random.default_rng(1)
    X = rng.normal(size=(130, 4))
    X[1:, 1] += 0.8 * X[:-1, 0]
    from firmament.operators import windows as Wn
    s = Wn.firm_series(long(spark, X).withColumn("pos", F.col("firm").cast("int")))
    t = TU.tune(s, 100, [1e-4, 5.0], [1.0], 2)
    rows = {(r["window_end"], r["alpha"]): r for r in t.collect()}
    assert set(rows) == {(100, 1e-4), (100, 5.0), (129, 1e-4), (129, 5.0)}
    assert rows[100, 5.0]["nonzero_per_firm"] == 0 and rows[100, 1e-4]["r2"] > 0
    assert TU.choose_alpha(t, "r2").first()["alpha"] == 1e-4


def test_a_wide_day_keeps_its_strongest_without_ranking_its_rows(spark):
    """Against a sort, with ties, zeros, NULLs and one day of 20,000 firms."""
    import numpy as np
    rng = np.random.default_rng(5)
    days = {0: rng.normal(size=20_000).round(3), 1: np.zeros(9), 2: np.array([1.0]), 3: np.array([2.0, -2.0, 1.0, 0.0, 3.0, 1e-300])}
    rows = [("m", t, i, float(v), 1.0) for t, vs in days.items() for i, v in enumerate(vs)] + [("m", 3, 99, None, 1.0)]
    f = spark.createDataFrame(rows, "model string, t int, firm int, pred double, x double")
    for frac in (0.001, 0.25, 0.5):
        got = {(r["t"], r["firm"]) for r in M.positions(f, frac).where("bet <> 0").collect()}
        want = set()
        for t in days:
            size = sorted((abs(r[3] or 0.0) for r in rows if r[1] == t), reverse=True)
            least = size[max(1, int(np.ceil(frac * len(size)))) - 1]
            want |= {(t, r[2]) for r in rows if r[1] == t and r[3] and abs(r[3]) >= least}
        assert got == want
    assert M.positions(f.where("false"), 0.5).isEmpty()


def test_gaps_lie_between_a_firms_first_and_last_day(spark):
    day = [f"2020-01-0{i}" for i in range(1, 8)]
    panel = spark.createDataFrame([(1, day[1]), (1, day[4]), (1, day[4]), (2, day[0]), (3, None)], "firm int, d string").select("firm", F.to_date("d").alias("date"))
    cal = spark.createDataFrame([(d,) for d in day if d != day[2]], "d string").select(F.to_date("d").alias("date"))
    assert [(r["firm"], str(r["date"])) for r in P.gaps_by_firm(panel, cal).collect()] == [(1, day[3])]
    assert P.gaps_by_firm(panel.where("false"), cal).isEmpty()


def test_a_local_session_without_a_shared_folder_uses_its_own(tmp_path):
    import os
    import subprocess
    import sys
    code = ("from firmament import session as S; s = S.get_session('x', 'local[1]', 1); assert s.conf.get('spark.checkpoint.dir', None) is None; "
            "a = S.shared_dir(s); assert a == S.shared_dir(s); assert S.materialize(s.range(3), 't').count() == 3; print('kept', a)")
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join(sys.path)}
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "kept" in out.stdout, out.stderr[-2000:]
