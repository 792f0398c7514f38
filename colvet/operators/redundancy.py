"""Redundancy: rank correlation, variable clusters, representatives, and
which columns a spline fit rebuilds from their group.

* Mid-ranks come from bucketed cumulative counts over VALUES (exact, all rows
  of the early window); a null takes its column's mean rank.
* The Spearman matrix is the Pearson correlation of the ranked columns,
  computed by aggregation over rows (no sampling).
* Average-linkage clusters are built on the long pair table by merging
  mutual nearest clusters below the cut, round after round (each round a few
  small joins and aggregations over the F x F pair table).
* Redundancy inside a group regresses each member on a restricted cubic
  spline basis of the others; the only pass over rows is one Gramian per group,
  and the backward elimination runs on that matrix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import corr_long
from ..plans.cumulative import cumulative
from ..policy import RHO2_GRID, RDPolicy
from ..session import cut_lineage, stored
from .binning import type7_quantiles


def rank_columns(values: DataFrame, numeric, window: str = "early", min_nonnull: int = 100) -> DataFrame:
    """(feature, value, rank): mid-rank of every distinct value of each usable
    numeric column (> ``min_nonnull`` non-null, >= 2 distinct), plus a row with
    null value carrying the mean rank."""
    v = (values.where((F.col("window") == window) & F.col("feature").isin(list(numeric)))
               .groupBy("feature", "vnum").agg(F.sum("n").alias("c")))
    st = v.groupBy("feature").agg(F.sum(F.when(F.col("vnum").isNotNull(), F.col("c")).otherwise(0)).alias("nn"),
                                  F.count(F.when(F.col("vnum").isNotNull(), F.lit(1))).alias("d"))
    use = st.where((F.col("nn") > min_nonnull) & (F.col("d") >= 2))
    nn = v.where(F.col("vnum").isNotNull()).join(use.select("feature"), "feature")
    c = cumulative(nn, ["feature"], "vnum", ["c"])
    ranked = c.select("feature", F.col("vnum").alias("value"),
                      (F.col("c_below") + (F.col("c") + 1) / 2.0).alias("rank"))
    means = use.select("feature", F.lit(None).cast("double").alias("value"), ((F.col("nn") + 1) / 2.0).alias("rank"))
    return ranked.unionByName(means)


#: The ranks of columns with so many values or fewer are broadcast: each value may hold many rows.
FEW_VALUES = 5_000


def ranked_wide(frame_w: DataFrame, id_col: str, ranks: DataFrame, window: str = "early"):
    """Rows of the window with every usable column replaced by its rank
    (null -> mean rank). Returns (wide DataFrame, feature list).

    Nulls are filled in from the mean ranks (one number per column) and columns of
    few values look theirs up in a broadcast table, so only columns of many values
    are shuffled by value and no value that holds most rows is met by one task."""
    per = {r["feature"]: r for r in ranks.groupBy("feature").agg(
        F.count("value").alias("values"), F.max(F.when(F.col("value").isNull(), F.col("rank"))).alias("mean")).collect()}
    feats = sorted(per)  # column names
    rows = frame_w.where(F.col("window") == window).select(F.col(id_col).alias("_id"), *[F.col(f).cast("double").alias(f) for f in feats])
    at = {f: i for i, f in enumerate(feats)}
    number = F.coalesce(*[F.when(F.col("feature") == f, F.lit(i)) for f, i in at.items()]) if feats else F.lit(0)
    r = ranks.where(F.col("value").isNotNull()).select(number.alias("f"), "value", "rank")
    none = F.lit(None).cast("int"), F.lit(None).cast("double")
    found = rows.select("_id", none[0].alias("f"), none[1].alias("rank"))  # an id without any value keeps its row
    for few in (True, False):
        names = [f for f in feats if (per[f]["values"] <= FEW_VALUES) == few]
        if names:
            longv = rows.select("_id", F.inline(F.array(*[F.struct(F.lit(at[f]).alias("f"), F.col(f).alias("value")) for f in names])))
            mine = r.where(F.col("f").isin([at[f] for f in names]))
            found = found.unionByName(longv.where(F.col("value").isNotNull()).join(F.broadcast(mine) if few else mine, ["f", "value"])
                                           .select("_id", "f", "rank"))
    wide = found.groupBy(F.col("_id").alias(id_col)).agg(F.count(F.lit(1)).alias("_rows"), *[
        F.coalesce(F.max(F.when(F.col("f") == at[f], F.col("rank"))), F.lit(per[f]["mean"])).alias(f) for f in feats])
    return wide.drop("_rows"), feats


def spearman_long(frame_w: DataFrame, id_col: str, ranks: DataFrame) -> DataFrame:
    """(a, b, rho) for every ordered pair of usable columns, diagonal 1,
    non-finite correlations 0."""
    wide, feats = ranked_wide(frame_w, id_col, cut_lineage(ranks))
    wide = cut_lineage(wide)
    row = corr_long(wide, feats).select("a", "b", F.col("r").alias("rho"))
    row = row.select("a", "b", F.when(F.col("rho").isNull() | F.isnan("rho"), F.lit(0.0))
                     .otherwise(F.col("rho")).alias("rho"))
    sym = row.unionByName(row.select(F.col("b").alias("a"), F.col("a").alias("b"), "rho"))
    diag = wide.sparkSession.createDataFrame([(f, f, 1.0) for f in feats], "a string, b string, rho double")
    return sym.unionByName(diag)


def variable_clusters(rho: DataFrame, max_height: float, record: bool = False):
    """Average linkage on distance 1 - rho^2, merging only below ``max_height``.

    Each round: cluster-to-cluster mean distance over member pairs, each
    cluster's nearest neighbour, merge every mutual nearest pair below the cut
    (ties: smallest id). Returns (membership (feature, cid), merges
    (ca, cb, height)) -- the merges only when ``record``.
    """
    spark = rho.sparkSession
    d = rho.where(F.col("a") != F.col("b")).select("a", "b", (1 - F.col("rho") * F.col("rho")).alias("d"))
    d = cut_lineage(d)
    members = cut_lineage(rho.select(F.col("a").alias("feature")).distinct().withColumn("cid", F.col("feature")))
    merges = []
    while True:
        ca = members.select(F.col("feature").alias("a"), F.col("cid").alias("ca"))
        cb = members.select(F.col("feature").alias("b"), F.col("cid").alias("cb"))
        cd = (d.join(ca, "a").join(cb, "b").where(F.col("ca") != F.col("cb"))
               .groupBy("ca", "cb").agg(F.avg("d").alias("dist")))
        w = Window.partitionBy("ca").orderBy(F.col("dist").asc(), F.col("cb").asc())
        nn = cd.withColumn("rk", F.row_number().over(w)).where(F.col("rk") == 1).select("ca", "cb", "dist")
        back = nn.select(F.col("ca").alias("cb"), F.col("cb").alias("ca2"))
        mutual = (nn.join(back, "cb").where((F.col("ca2") == F.col("ca")) & (F.col("ca") < F.col("cb"))
                                            & (F.col("dist") <= F.lit(max_height)))
                    .select("ca", "cb", "dist"))
        got = mutual.collect()  # at most F/2 merges per round: schema-sized
        if not got:
            break
        merges.extend((r["ca"], r["cb"], float(r["dist"])) for r in got)
        mp = spark.createDataFrame([(r["cb"], r["ca"]) for r in got], "old string, new string")
        members = cut_lineage(members.join(F.broadcast(mp), members["cid"] == mp["old"], "left")
                              .select("feature", F.coalesce(F.col("new"), F.col("cid")).alias("cid")))
    return members, merges


def groups_at(features, merges, height: float) -> dict:
    """Partition after applying merges with height <= ``height`` (union-find on
    the merge list, which has at most F - 1 entries)."""
    parent = {f: f for f in features}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b, h in merges:
        if h <= height:
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    return {f: find(f) for f in features}


def numbered_groups(members: DataFrame, order: list) -> DataFrame:
    """Group numbers in order of each group's first member in column order."""
    spark = members.sparkSession
    pos = spark.createDataFrame([(f, i) for i, f in enumerate(order)], "feature string, position int")
    m = members.join(pos, "feature")
    first = m.groupBy("cid").agg(F.min("position").alias("p0"), F.count(F.lit(1)).alias("size"))
    first = first.withColumn("group", F.row_number().over(Window.orderBy("p0")))
    return m.join(first, "cid").select("feature", F.col("group").cast("string").alias("group"),
                                       F.col("size").cast("long").alias("size"))


def threshold_grid(features, merges, grid=RHO2_GRID) -> list:
    rows = []
    for t in grid:
        g = groups_at(features, merges, 1 - t)
        sizes = pd.Series(list(g.values())).value_counts()
        rows.append((float(t), int(len(sizes)), int((sizes == 1).sum()), int(sizes.max()) if len(sizes) else 0))
    return rows


def representatives(groups: DataFrame, null_rates: DataFrame, iv: DataFrame | None) -> DataFrame:
    """One per group: least null, then highest IV (a missing IV sorts first, as
    the ordering it mirrors places missing values first), then name."""
    g = groups.join(null_rates, "feature", "left")
    g = g.join(iv, "feature", "left") if iv is not None else g.withColumn("iv", F.lit(None).cast("double"))
    w = Window.partitionBy("group").orderBy(F.col("null_rate").asc(), F.col("iv").desc_nulls_first(),
                                            F.col("feature").asc())
    r = g.withColumn("rk", F.row_number().over(w))
    rep = r.where(F.col("rk") == 1).select("group", F.col("feature").alias("representative"))
    out = r.join(rep, "group")
    return out.select("group", "size", F.col("feature").alias("column"), "representative",
                      (F.col("feature") == F.col("representative")).alias("is_representative"), "null_rate", "iv")


# ------------------------------------------------------------- redundancy ---
#: A member with this many values or fewer takes no part.
USABLE = 100


def _r2_all(G: np.ndarray, idx: dict, members: list, spline: bool) -> dict:
    """R^2 of each member (linear) on the basis of the other members."""
    out = {}
    n = G[0, 0]
    for y in members:
        yi = idx[(y, "x")]
        pred = [0] + [idx[(m, k)] for m in members if m != y for k in (("x", "s") if spline else ("x",))]
        A = G[np.ix_(pred, pred)]
        b = G[pred, yi]
        beta = np.linalg.lstsq(A, b, rcond=None)[0]
        sse = G[yi, yi] - b @ beta
        sst = G[yi, yi] - G[0, yi] ** 2 / n
        out[y] = float(1 - sse / sst) if sst > 0 else float("nan")
    return out


def backward_redundancy(G: np.ndarray, idx: dict, members: list, r2: float, spline: bool):
    remaining = list(members)
    removed = []
    while len(remaining) > 1:
        scores = _r2_all(G, idx, remaining, spline)
        best = max(remaining, key=lambda m: (scores[m] if scores[m] == scores[m] else -1, m))
        if not scores[best] >= r2:
            break
        removed.append((best, scores[best]))
        remaining.remove(best)
    return removed


def _place(k) -> tuple:
    """Middle knot and width of a member (0 and 1 without knots)."""
    if not k or None in k:
        return 0.0, 1.0
    return float(k[1]), float(k[2] - k[0]) or max(abs(float(k[1])), 1.0)


def _basis(pdf: pd.DataFrame, members: list, knots: dict, spline: bool) -> np.ndarray:
    """Basis matrix [1, x_1, s_1, x_2, s_2, ...] of complete rows (numpy)."""
    cols = [np.ones(len(pdf))]
    for m in members:
        # centred and scaled on the knots: R^2 does not change, sums of cubes stay small
        at, scale = _place(knots.get(m))
        x = (pdf[m].to_numpy(dtype=float) - at) / scale
        cols.append(x)
        if spline:
            t1, t2, t3 = ((t - at) / scale for t in knots[m])

            def cube(z):
                return np.maximum(z, 0.0) ** 3
            sp = cube(x - t1) - cube(x - t2) * ((t3 - t1) / (t3 - t2)) + cube(x - t3) * ((t2 - t1) / (t3 - t2))
            cols.append(sp)
    return np.column_stack(cols)


def redundancy_within_groups(frame_w: DataFrame, groups: DataFrame, r2: float = 0.9,
                             max_group: int | None = None, window: str = "early") -> DataFrame:
    """Backward removal of the best-predicted member while R^2 >= r2, per group
    of two or more columns (``max_group``: no larger ones; None: all), on the group's complete rows (restricted cubic
    spline basis with 3 knots, else linear).

    Fixed number of passes whatever the number of groups: one exact quantile
    job for every group's knots, one pass over the rows that adds up partial
    Gramians of every group per task (mapInPandas), and one grouped solve.
    """
    spark = frame_w.sparkSession
    rows = frame_w.where(F.col("window") == window)
    gl = {r["group"]: sorted(r["members"]) for r in
          groups.groupBy("group").agg(F.collect_list("feature").alias("members")).collect()}  # column names
    out = []
    eligible = {}
    for g, mem in gl.items():
        if len(mem) < 2:
            out.extend((g, m, False, None, "singleton") for m in mem)
        elif max_group is not None and len(mem) > max_group:
            out.extend((g, m, None, None, "group larger than max_group") for m in mem)
        else:
            eligible[g] = mem
    schema = "group string, column string, predictable boolean, r2 double, note string"
    if not eligible:
        return spark.createDataFrame(out, schema)
    cols = sorted({m for mem in eligible.values() for m in mem})
    # one pass over the frame and its joins; what follows reads these columns only
    rows = stored(rows.select(*[F.col(c).cast("double").alias(c) for c in cols]))

    # members that say nothing (USABLE or fewer values, or constant) leave their group
    seen = rows.agg(*[f for c in cols for f in (F.count(c).alias(f"n_{c}"), (F.min(c) != F.max(c)).alias(f"v_{c}"))]).first()
    usable = {c for c in cols if seen[f"n_{c}"] > USABLE and seen[f"v_{c}"]}
    for g, mem in list(eligible.items()):
        good = [m for m in mem if m in usable]
        bad = mem if len(good) < 2 else [m for m in mem if m not in usable]
        out.extend((g, m, False, None, "not enough usable columns") for m in bad)
        if len(good) < 2:
            del eligible[g]
        else:
            eligible[g] = good
    if not eligible:
        return spark.createDataFrame(out, schema)

    # knots: type-7 quantiles of each member over its group's complete rows
    parts = []
    for g, mem in eligible.items():
        complete = None
        for m in mem:
            nn = F.col(m).isNotNull()
            complete = nn if complete is None else (complete & nn)
        for m in mem:
            parts.append(F.struct(F.lit(g).alias("group"), F.lit(m).alias("feature"),
                                  F.when(complete, F.col(m)).alias("vnum")))
    longv = rows.select(F.inline(F.array(*parts))).where(F.col("vnum").isNotNull())
    counts = stored(longv.groupBy("group", "feature", "vnum").agg(F.count(F.lit(1)).alias("c")))
    nn = counts.groupBy("group", "feature").agg(F.sum("c").alias("nonnull"))
    q = type7_quantiles(counts.join(nn, ["group", "feature"]), ["group", "feature"], [0.1, 0.5, 0.9]).collect()
    knots = {}
    for r in q:  # three numbers per member: schema-sized
        knots.setdefault(r["group"], {}).setdefault(r["feature"], [None, None, None])[r["j"]] = r["q"]
    spline = {g: all(len(set(k)) == 3 and None not in k for k in knots.get(g, {}).values())
              and len(knots.get(g, {})) == len(mem) for g, mem in eligible.items()}
    plan = spark.sparkContext.broadcast((eligible, knots, spline))  # schema-sized

    def partial(it):
        elig, kn, sp = plan.value
        for pdf in it:
            recs = []
            for g, mem in elig.items():
                sub = pdf[mem].dropna()
                if not len(sub):
                    continue
                b = _basis(sub, mem, kn.get(g, {}), sp[g])
                gram = b.T @ b
                k = gram.shape[0]
                for i in range(k):
                    for j in range(i, k):
                        recs.append((g, i, j, float(gram[i, j])))
            yield pd.DataFrame(recs, columns=["group", "i", "j", "v"])

    gram = (rows.mapInPandas(partial, "group string, i int, j int, v double")
                .groupBy("group", "i", "j").agg(F.sum("v").alias("v")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        elig, kn, sp = plan.value
        g = pdf["group"].iloc[0]
        mem = elig[g]
        k = int(max(pdf["i"].max(), pdf["j"].max())) + 1
        G = np.zeros((k, k))
        for i, j, v in zip(pdf["i"], pdf["j"], pdf["v"]):
            G[i, j] = G[j, i] = v
        if G[0, 0] < 3:
            return pd.DataFrame({"group": g, "column": mem, "predictable": False, "r2": None,
                                 "note": "not enough usable columns"})
        idx, pos = {}, 1
        for m in mem:
            idx[(m, "x")] = pos
            pos += 1
            if sp[g]:
                idx[(m, "s")] = pos
                pos += 1
        removed = dict(backward_redundancy(G, idx, mem, r2, sp[g]))
        return pd.DataFrame({"group": g, "column": mem, "predictable": [m in removed for m in mem],
                             "r2": [removed.get(m) for m in mem], "note": "spline" if sp[g] else "linear"})

    solved = gram.groupBy("group").applyInPandas(solve, schema)
    done = {r["group"] for r in gram.select("group").distinct().collect()}
    for g, mem in eligible.items():
        if g not in done:  # no complete rows at all
            out.extend((g, m, False, None, "not enough usable columns") for m in mem)
    return solved.unionByName(spark.createDataFrame(out, schema))


def pinned_blocks(rho: DataFrame, blocks: DataFrame) -> DataFrame:
    """Mean rho^2 inside each block (upper triangle) against its members to all
    other columns; ratio and whether the block holds."""
    cols = rho.select(F.col("a").alias("column")).distinct()
    bm = blocks.select("block", "column").distinct().join(cols, "column")
    r2 = rho.where(F.col("a") != F.col("b")).select("a", "b", (F.col("rho") * F.col("rho")).alias("r2"))
    ma = bm.select("block", F.col("column").alias("a"))
    mb = bm.select(F.col("block").alias("block_b"), F.col("column").alias("b"))
    j = r2.join(ma, "a").join(mb, "b", "left")
    inside = (j.where((F.col("block_b") == F.col("block")) & (F.col("a") < F.col("b")))
               .groupBy("block").agg(F.avg("r2").alias("mean_rho2_within")))
    outside = (j.where(F.col("block_b").isNull() | (F.col("block_b") != F.col("block")))
                .groupBy("block").agg(F.avg("r2").alias("mean_rho2_between")))
    size = bm.groupBy("block").agg(F.count(F.lit(1)).alias("n_members")).where(F.col("n_members") >= 2)
    out = size.join(inside, "block", "left").join(outside, "block", "left")
    return out.select("block", F.col("n_members").cast("long"), "mean_rho2_within", "mean_rho2_between",
                      (F.col("mean_rho2_within") / F.col("mean_rho2_between")).alias("ratio"),
                      (F.col("mean_rho2_within") > F.col("mean_rho2_between")).alias("holds"))


def scan(audit, iv: DataFrame | None = None, policy: RDPolicy = RDPolicy()):
    """Full report: groups, representatives, redundancy verdicts."""
    spec = audit.spec
    ranks = rank_columns(audit.values, spec.numeric)
    rho = cut_lineage(spearman_long(audit.fw, spec.id, ranks))
    members, merges = variable_clusters(rho, 1 - policy.min_rho2)
    groups = numbered_groups(members, list(spec.numeric))
    nulls = (audit.values.where(F.col("window") == "early")
                  .groupBy("feature").agg((F.sum(F.when(F.col("vnum").isNull() & F.col("vtxt").isNull(), F.col("n"))
                                                 .otherwise(0)) / F.sum("n")).alias("null_rate")))
    reps = representatives(groups, nulls, iv)
    red = redundancy_within_groups(audit.fw, groups, policy.redun_r2, policy.max_group)
    rep = reps.join(red.select("column", "predictable", F.col("r2").alias("redun_r2"),
                               F.col("note").alias("redun_note")), "column", "left")
    return rep, rho, merges
