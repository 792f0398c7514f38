"""What the passes over large tables move, join and hold: one pass per frame, no hot key."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from colvet.operators import derive as DV
from colvet.operators import redundancy as RD
from colvet.operators import shift as SH
from colvet.plans import suffstats as S
from colvet.plans.pipeline import prepare
from colvet.sources import audit_store as ST
from colvet.sources import frames as FR


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A few orders, parts and customers; one order twice, one part and one customer missing."""
    d = str(tmp_path_factory.mktemp("lines"))
    day = dt.datetime(2024, 1, 1)
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    put([(i % 7, i % 5 if i % 4 else None, i % 3, i % 4, float(i), i + 0.5, 0.1, 0.2, "R" if i % 3 else "N", "OF"[i % 2], day + dt.timedelta(days=i))
         for i in range(60)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz", "lineitem")
    put([(i % 6, i % 3, "O", float(i), day, "1-URGENT") for i in range(7)],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string", "orders")
    put([(i, f"n{i}", f"b{i}", f"t{i % 2}", i, float(i)) for i in range(4)],
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", "part")
    put([(i, f"c{i}", i, float(i), "X") for i in range(2)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", "customer")
    return d


def test_counts_join_the_keys_own_table(spark, tables, no_broadcast):
    cols = ["o_custkey", "l_partkey", "p_type"]
    specs = [DV.Derivation(f"{c}_freq", "frequency_encode", (c,)) for c in cols]
    plain = FR.lines_frame(spark, tables)
    maps, _ = DV.fit_frequency_maps(plain, cols)
    brought = DV.apply_derivations(FR.lines_frame(spark, tables, DV.lookups(maps, cols)), specs, maps)
    late = DV.apply_derivations(plain, specs, maps)
    assert brought.columns == late.columns
    assert sorted(map(str, brought.collect())) == sorted(map(str, late.collect()))
    # the lines are in the last two joins only: the maps meet parts and orders below them
    above = plan_of(brought).split("l_orderkey")[0]
    assert above.count("Join") <= 2


def test_whole_number_levels_match_their_spelling_only(spark):
    maps = spark.createDataFrame([("k", "7", 3), ("k", "007", 9), ("k", "x", 4), ("s", "07", 5)], "column string, level string, n long")
    rows = spark.createDataFrame([(7, "07"), (None, None), (8, "7")], "k long, s string")
    specs = [DV.Derivation("k_n", "frequency_encode", ("k",)), DV.Derivation("s_n", "frequency_encode", ("s",))]
    got = {(r["k"], r["s"]): (r["k_n"], r["s_n"]) for r in DV.apply_derivations(rows, specs, maps).collect()}
    assert got == {(7, "07"): (3, 5), (None, None): (None, None), (8, "7"): (None, None)}


def test_maps_are_fitted_in_one_pass_over_the_frame(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    frame = spark.range(40).select(F.col("id").alias("t"), (F.col("id") % 3).alias("k"), F.lit("a").alias("s")).mapInPandas(look, "t long, k long, s string")
    maps, summary = DV.fit_frequency_maps(frame, ["k", "s"])
    assert sorted((r["column"], r["level"], r["n"]) for r in maps.collect()) == [("k", "0", 10), ("k", "1", 10), ("k", "2", 10), ("s", "a", 30)]
    assert {r["train_rows"] for r in summary.collect()} == {30}
    assert seen.value == 40


def test_written_frame_derives_after_the_rows_moved(spark, tables, tmp_path):
    specs = [DV.Derivation("l_partkey_freq", "frequency_encode", ("l_partkey",)), DV.Derivation("is_o", "one_hot", ("l_linestatus",), {"level": "O"})]
    again = lambda lookups=None: FR.lines_frame(spark, tables, lookups).drop("l_shipdate")
    near, late = (ST.build(again(), specs, ["p_size"], again=a) for a in (again, None))
    assert near.bare is not None and "is_o" not in near.bare.columns and late.bare is None
    got = [spark.read.parquet(ST.write(b, f"{tmp_path}/{i}") + "/data") for i, b in enumerate((near, late))]
    assert set(got[0].columns) == set(got[1].columns)
    cols = sorted(got[0].columns)
    assert sorted(map(str, got[0].select(cols).collect())) == sorted(map(str, got[1].select(cols).collect()))


def test_written_frame_moves_packed_by_slices_of_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "SLICE_ROWS", 300)
    monkeypatch.setattr(ST, "PACK_BYTES", 20_000)

    def no(*_):
        raise AssertionError("the rows are dealt one by one")

    monkeypatch.setattr(type(spark.range(0)), "repartitionByRange", no)
    day = dt.date(2024, 1, 1)
    kinds = "t long, lv string, d date, at timestamp, ntz timestamp_ntz, n decimal(20,4), b binary, a array<string>, m map<string,int>, o double"
    rows = []
    for i in range(3000):
        t = None if i % 10 == 0 else (1 << 60) + 7 if i % 3 == 0 else (1 << 60) + i * 37 % 1000 * 1001  # a tenth without, a third alike, beyond a double's steps
        rows.append((t, None if i % 7 == 0 else f"l{i % 4}", day + dt.timedelta(days=i % 50), dt.datetime(2024, 1, 1, i % 24), dt.datetime(2024, 1, 1, i % 24),
                     None if i % 5 == 0 else decimal.Decimal(i) / 8, None if i % 6 == 0 else bytes([i % 256]), ["x", None] if i % 2 else None, {"k": i} if i % 4 else None,
                     float("nan") if i % 9 == 0 else None if i % 8 == 0 else -0.5 * i))
    df = spark.createDataFrame(rows, kinds).repartition(5)
    for frame, time in ((df, "t"), (df.withColumn("t", F.timestamp_micros(F.col("t") - (1 << 60))), "t"), (df, "d"), (df, "o")):
        built = ST.build(frame, [DV.Derivation("lv_n", "frequency_encode", ("lv",))] if frame is df and time == "t" else [], ["lv"], time)
        built.times = built.times or frame.select(time)
        path = ST.write(built, f"{tmp_path}/{time}-{frame.schema['t'].dataType.simpleString()}", time)
        back = spark.read.parquet(f"{path}/data")
        assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in built.frame.schema]
        assert sorted(map(str, back.collect())) == sorted(map(str, built.frame.collect()))
        files = ST.read_manifest(spark, path).collect()
        assert len(files) >= 8 and max(f["rows"] for f in files) <= 900  # neither the common time nor none lands in one file
        timed = sorted((f["first"], f["last"]) for f in files if f["timed_rows"])
        assert all(x[1] <= y[0] for x, y in zip(timed, timed[1:]))


def test_large_writes_drop_their_shuffles(spark, tmp_path, monkeypatch):
    key, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    kind = type(spark.range(0).write)
    plain, asked = kind.parquet, spark.conf.get(key)

    def spy(self, path, *a, **b):
        seen.append((path.rsplit("/")[-1][:5], spark.conf.get(key)))
        return plain(self, path, *a, **b)

    monkeypatch.setattr(kind, "parquet", spy)
    rows = spark.range(6000).select(F.col("id").alias("t"), (F.col("id") % 3).alias("k")).repartition(5)
    path = ST.write(ST.build(rows, [DV.Derivation("k_n", "frequency_encode", ("k",))], ["k"]), f"{tmp_path}/frame")
    assert spark.read.parquet(f"{path}/data").where("k_n is not null").count() == 6000
    assert ("data", "true") in seen and [on for name, on in seen if name == "rows-"] == ["true"] * 2
    assert spark.conf.get(key) == asked


def test_ranks_of_nulls_and_few_values_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(RD, "FEW_VALUES", 50)
    rows = [(i, None if i % 10 else float(i), float(i % 3), float((i * 37) % 400)) for i in range(400)] + [(1000, None, None, None), (1000, None, None, None)]
    fw = spark.createDataFrame(rows, "id long, a double, b double, c double").withColumn("window", F.lit("early")).withColumn("y", F.lit(1))
    spec = FR.FrameSpec(name="x", numeric=("a", "b", "c"), text=(), id="id")
    ranks = RD.rank_columns(S.values_table(fw, spec), spec.numeric, min_nonnull=10)
    wide, feats = RD.ranked_wide(fw, "id", ranks)
    assert feats == ["a", "b", "c"]
    got = {r["id"]: (r["a"], r["b"], r["c"]) for r in wide.collect()}
    mean = {r["feature"]: r["rank"] for r in ranks.where("value is null").collect()}
    rank = {(r["feature"], r["value"]): r["rank"] for r in ranks.collect()}
    assert len(got) == 401 and got[1000] == (mean["a"], mean["b"], mean["c"])
    for i, *vs in rows[:400]:
        assert got[i] == tuple(rank[f, v] for f, v in zip("abc", vs))
    # no null goes into a join by value
    assert "<=>" not in plan_of(wide)


def test_energy_hands_runs_over_one_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(SH, "RUN_ROWS", 8)
    fw = spark.range(200).select("id", (F.col("id") * 13 % 101).cast("double").alias("v"), F.when(F.col("id") < 100, "early").otherwise("late").alias("window"))
    out = SH.energy_test(fw, ["v"], "id", perms=19)
    plan = plan_of(out)
    r = out.collect()[0]
    assert "FlatMapGroupsInPandas" in plan and "MapInPandas partial" not in plan and "counted" not in plan
    v = [(i * 13 % 101, i < 100) for i in range(200)]
    early, late = [x for x, e in v if e], [x for x, e in v if not e]
    m = sum(early) / 100
    sd = (sum((x - m) ** 2 for x in early) / 99) ** 0.5
    mean = lambda a, b: sum(abs(x - y) for x in a for y in b) / (len(a) * len(b))
    want = 100 * 100 / 200 * (2 * mean(early, late) - mean(early, early) - mean(late, late)) / sd
    assert r["statistic"] == pytest.approx(want, rel=1e-9)
    assert (r["n_ref"], r["n_cur"]) == (100, 100)


def test_contract_reads_its_rows_from_one_stored_copy(spark):
    a = prepare(spark, "/root/testdata/sf0.001", frame="planted", store=True)
    plan = plan_of(a.fw)
    assert "Join" not in plan and "Relation" in plan
    b = prepare(spark, "/root/testdata/sf0.001", frame="planted")
    assert sorted(map(str, a.fw.collect())) == sorted(map(str, b.fw.collect()))


def test_group_redundancy_reads_the_frame_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    fw = spark.range(300).select(F.lit("early").alias("window"), F.col("id").cast("double").alias("a"), (F.col("id") * 2 + F.col("id") % 2).cast("double").alias("b"))
    fw = fw.mapInPandas(look, "window string, a double, b double")
    groups = spark.createDataFrame([("g", "a"), ("g", "b")], "group string, feature string")
    got = RD.redundancy_within_groups(fw, groups).collect()
    assert sum(bool(r["predictable"]) for r in got) == 1
    assert seen.value == 300
