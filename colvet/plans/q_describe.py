"""Registered queries: descriptive (2.16), forensic (2.15), entity keys (2.14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import paste_key
from ..operators import describe as D
from ..operators import entity as E
from ..operators import forensic as X
from ..plans import suffstats as S
from ..sources.frames import EVENTS_SPEC, load_frame
from . import oracle_sql as O
from .pipeline import prepare
from .registry import register

EV = "WITH " + O.FRAME_SQL["events"].lstrip()
Z = 1.959963984540054


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    p = f"({k})::DOUBLE / ({n})"
    z2 = f"{Z * Z!r}::DOUBLE"
    denom = f"(1.0::DOUBLE + {z2} / ({n}))"
    centre = f"(({p} + {z2} / (2 * ({n}))) / {denom})"
    half = f"({Z!r}::DOUBLE * sqrt({p} * (1 - {p}) / ({n}) + {z2} / (4 * ({n}) * ({n}))) / {denom})"
    return (f"greatest(0.0::DOUBLE, {centre} - {half})", f"least(1.0::DOUBLE, {centre} + {half})")


def rate_sql(k="k", n="n"):
    lo, hi = wilson_sql(k, n)
    return f"{k}::DOUBLE / {n} AS rate, {lo} AS lo, {hi} AS hi"


RATE_F = ("rate", "lo", "hi")


# ----------------------------------------------------------- descriptive ---
@register("qd_wilson", sql=EV + f"""
SELECT c_nation, count(*) AS n, sum(y)::BIGINT AS k, {rate_sql('sum(y)', 'count(*)').replace(' AS rate', ' AS rate')}
FROM frame GROUP BY c_nation""".replace("sum(y)::DOUBLE / count(*) AS rate", "sum(y)::DOUBLE / count(*) AS rate"),
          floats=RATE_F)
def q_wilson(spark, sf):
    """Wilson 95 % interval of the label rate per customer nation."""
    fr, spec = load_frame(spark, sf)
    return D.rates_by(fr, "c_nation", spec.label)


@register("qd_base_rate", sql=EV + f"""
SELECT n, k, {rate_sql()}, round((hi_t - lo_t) / 86400.0, 1) AS days FROM (
  SELECT count(*) AS n, sum(y)::BIGINT AS k, min(t) AS lo_t, max(t) AS hi_t FROM frame) x""",
          floats=RATE_F + ("days",))
def q_base_rate(spark, sf):
    """Rows, positives, rate with Wilson interval, calendar days."""
    fr, spec = load_frame(spark, sf)
    return D.base_rate(fr, spec)


@register("qd_daily_rate_ci", sql=EV + f"""
SELECT day, n, k, {rate_sql()} FROM (
  SELECT floor(t / 86400)::BIGINT AS day, count(*) AS n, sum(y)::BIGINT AS k FROM frame GROUP BY ALL) x
WHERE n > 200""", floats=RATE_F)
def q_daily_rate_ci(spark, sf):
    """Daily label rate with its Wilson band (days with more than 200 rows)."""
    fr, spec = load_frame(spark, sf)
    return D.daily_rate_ci(fr, spec)


@register("qd_segment_rates", sql=EV + f"""
SELECT c_mktsegment, n, k, {rate_sql()}, n::DOUBLE / sum(n) OVER () AS share_of_volume,
       (k::DOUBLE / n) / (sum(k) OVER () / sum(n) OVER ()) AS ratio_to_pooled
FROM (SELECT c_mktsegment, count(*) AS n, sum(y)::BIGINT AS k FROM frame GROUP BY ALL) x""",
          floats=RATE_F + ("share_of_volume", "ratio_to_pooled"))
def q_segment_rates(spark, sf):
    """Rate, Wilson interval, share of volume and ratio to pooled, by segment."""
    fr, spec = load_frame(spark, sf)
    return D.segment_rates(fr, spec)


@register("qd_presence_rates", sql=EV + f"""
SELECT present, n, k, {rate_sql()} FROM (
  SELECT s_acctbal IS NOT NULL AS present, count(*) AS n, sum(y)::BIGINT AS k FROM frame GROUP BY ALL) x""",
          floats=RATE_F)
def q_presence_rates(spark, sf):
    """Label rate by whether the supplier side of the join is present."""
    fr, spec = load_frame(spark, sf)
    return D.presence_rates(fr, spec, "s_acctbal")


RARITY_COLS = ("user_id", "k", "c_nation")


def _rarity_sql():
    parts = []
    for c in RARITY_COLS:
        parts.append(f"""
  SELECT '{c}' AS "column", CASE WHEN f.freq < 10 THEN '<10' WHEN f.freq < 100 THEN '10-99'
              WHEN f.freq < 1000 THEN '100-999' WHEN f.freq < 10000 THEN '1k-10k' ELSE '>10k' END AS band,
         r.y
  FROM (SELECT {c}::VARCHAR AS value, y FROM frame WHERE {c} IS NOT NULL) r
  JOIN (SELECT {c}::VARCHAR AS value, count(*) AS freq FROM frame WHERE {c} IS NOT NULL GROUP BY 1) f
    USING (value)""")
    return EV + ",\nrb AS (" + "\n  UNION ALL".join(parts) + f"""),
g AS (SELECT "column", band, count(*) AS n, sum(y)::BIGINT AS k FROM rb GROUP BY ALL)
SELECT "column", band, n, k, {rate_sql()},
       (k::DOUBLE / n) / (sum(k) OVER (PARTITION BY "column") / sum(n) OVER (PARTITION BY "column")) AS ratio
FROM g"""


@register("qd_rarity_profile", sql=_rarity_sql(), floats=RATE_F + ("ratio",))
def q_rarity(spark, sf):
    """Label rate by value-frequency band, against each column's own base."""
    fr, spec = load_frame(spark, sf)
    return D.rarity_profile(fr, spec, RARITY_COLS)


_STORED_SQL = ", ".join(
    f"('{f}', '{s}')" for f, s in (("value", "numeric"), ("k", "integer"), ("s_acctbal", "numeric"),
                                  ("s_nationkey", "integer"), ("c_acctbal", "numeric"),
                                  ("c_nationkey", "integer"), ("c_mktsegment", "character"),
                                  ("c_nation", "character")))
TYPE_SQL = EV + "," + O.values_sql(EVENTS_SPEC, src="frame", by=()) + f""",
st(feature, stored) AS (VALUES {_STORED_SQL}),
per AS (SELECT feature, count(CASE WHEN vnum IS NOT NULL OR vtxt IS NOT NULL THEN 1 END) AS "distinct",
               sum(CASE WHEN vnum IS NULL AND vtxt IS NULL THEN c ELSE 0 END)::DOUBLE / sum(c) AS null_share
        FROM (SELECT feature, vnum, vtxt, sum(n) AS c FROM vals GROUP BY ALL) x GROUP BY feature),
prof AS (SELECT st.feature, st.stored, per."distinct", per.null_share,
                CASE WHEN per."distinct" <= 2 THEN 'binary' WHEN per."distinct" <= 20 THEN 'low-cardinality'
                     WHEN st.stored IN ('character', 'factor') THEN 'categorical' ELSE 'continuous' END AS effectively
         FROM st JOIN per USING (feature))"""


@register("qd_type_profile", sql=TYPE_SQL + """
SELECT feature, stored, "distinct", null_share, effectively,
       count(*) OVER (PARTITION BY stored, effectively) AS pair_count FROM prof""",
          floats=("null_share",))
def q_type_profile(spark, sf):
    """Stored against effective type per column, and how many columns share each pair."""
    fr, spec = load_frame(spark, sf)
    vals = S.values_table(fr, spec, by=())
    return D.type_profile(fr, spec, vals).select("feature", "stored", "distinct", "null_share", "effectively",
                                                 "pair_count")


@register("qd_type_mismatch", sql=TYPE_SQL + """
SELECT feature, "distinct", null_share FROM prof WHERE stored IN ('numeric', 'integer') AND "distinct" <= 20""",
          floats=("null_share",))
def q_type_mismatch(spark, sf):
    """Numeric columns that behave like categories (20 or fewer distinct values)."""
    fr, spec = load_frame(spark, sf)
    vals = S.values_table(fr, spec, by=())
    return D.type_mismatch(D.type_profile(fr, spec, vals))


# -------------------------------------------------------------- forensic ---
@register("fx_benford", sql=EV + """,
d AS (SELECT floor(CASE WHEN floor(log10(value)) >= 0 THEN value / pow(10.0, floor(log10(value)))
                        ELSE value * pow(10.0, -floor(log10(value))) END)::INTEGER AS digit
      FROM frame WHERE y = 1 AND value > 0),
c AS (SELECT digit, count(*) AS n FROM d GROUP BY digit),
g AS (SELECT r.digit::INTEGER AS digit, coalesce(c.n, 0) AS n FROM range(1, 10) r(digit) LEFT JOIN c USING (digit)),
s AS (SELECT digit, n, n::DOUBLE / sum(n) OVER () AS observed, log10(1.0 + 1.0 / digit) AS expected,
             sum(n) OVER () AS tot FROM g)
SELECT digit, n, observed, expected, avg(abs(observed - expected)) OVER () AS mad,
       sum((n - tot * expected) * (n - tot * expected) / (tot * expected)) OVER () AS chi2
FROM s""", floats=("observed", "expected", "mad", "chi2"))
def q_benford(spark, sf):
    """Leading digits of positive ``value`` among label-1 rows against Benford."""
    fr, spec = load_frame(spark, sf)
    return X.benford(fr, spec, "value")


@register("fx_daily_rate", sql=EV + """
SELECT * FROM (SELECT floor(t / 86400)::BIGINT AS day, count(*) AS n, avg(y) AS rate FROM frame GROUP BY ALL) x
WHERE n > 200""", floats=("rate",))
def q_daily_rate(spark, sf):
    """Daily rows and label rate, days with more than 200 rows."""
    fr, spec = load_frame(spark, sf)
    return X.daily_rate(fr, spec)


@register("fx_hour_profile", sql=EV + """
SELECT floor(((t / 3600.0) % 24.0 + 24.0) % 24.0)::INTEGER AS hour, count(*) AS n, avg(y) AS rate
FROM frame GROUP BY ALL""", floats=("rate",))
def q_hour_profile(spark, sf):
    """Rows and label rate by hour of the day."""
    fr, spec = load_frame(spark, sf)
    return X.hour_profile(fr, spec)


RAYLEIGH_SQL = """,
ang AS (SELECT {by}((t / 3600.0) % 24.0) * {k!r}::DOUBLE AS a FROM frame WHERE y = 1),
rg AS (SELECT {by2}count(*) AS n, avg(cos(a)) AS c, avg(sin(a)) AS s FROM ang {grp}),
rz AS (SELECT *, sqrt(c * c + s * s) AS r, n * sqrt(c * c + s * s) * sqrt(c * c + s * s) AS z FROM rg),
ray AS (SELECT {by2}n, r,
        exp(-z) * (1.0 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z * z + 76 * z * z * z - 9 * z * z * z * z) / (288 * n * n)) AS p_value,
        (((atan2(s, c) % {tau!r}) + {tau!r}) % {tau!r}) * {hk!r}::DOUBLE AS peak_hour FROM rz)"""


def _rayleigh_sql(by: str | None):
    import math
    return RAYLEIGH_SQL.format(by=(f"{by}, " if by else ""), by2=(f"{by}, " if by else ""),
                               grp=(f"GROUP BY {by}" if by else ""), k=2 * math.pi / 24,
                               tau=2 * math.pi, hk=24 / (2 * math.pi))


@register("fx_rayleigh", sql=EV + _rayleigh_sql(None) + "\nSELECT n, r, p_value, peak_hour FROM ray",
          floats=("r", "p_value", "peak_hour"))
def q_rayleigh(spark, sf):
    """Rayleigh test on the hour angle of the positives."""
    fr, spec = load_frame(spark, sf)
    return X.rayleigh(fr, spec)


@register("rank_bh", sql=EV + _rayleigh_sql("c_mktsegment") + """,
b0 AS (SELECT c_mktsegment, p_value, row_number() OVER (ORDER BY p_value) AS rk, count(*) OVER () AS m
       FROM ray WHERE p_value IS NOT NULL)
SELECT c_mktsegment, p_value,
       least(1.0, min(p_value * m / rk) OVER (ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_bh
FROM b0""", floats=("p_value", "p_bh"))
def q_rank_bh(spark, sf):
    """Benjamini-Hochberg over a family: the Rayleigh p-value of every segment."""
    from ..operators.rank import bh_adjust
    fr, spec = load_frame(spark, sf)
    r = X.rayleigh(fr, spec, by="c_mktsegment").select("c_mktsegment", "p_value")
    return bh_adjust(r, "p_value", "p_bh")


GINI_KEY_SQL = "user_id::VARCHAR || ' ' || coalesce(s_nationkey::VARCHAR, 'NA')"


@register("fx_gini", sql=EV + f""",
per AS (SELECT {GINI_KEY_SQL} AS uid, count(*) AS n FROM frame GROUP BY 1),
o AS (SELECT n, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS m, sum(n) OVER () AS sx FROM per)
SELECT (2 * sum(i * n) / max(sx) - (max(m) + 1)) / max(m) AS gini, max(m)::BIGINT AS groups FROM o""",
          floats=("gini",))
def q_gini(spark, sf):
    """Gini of transactions per client (client = user and supplier nation)."""
    fr, spec = load_frame(spark, sf)
    per = fr.groupBy(paste_key(["user_id", "s_nationkey"], " ").alias("uid")).agg(F.count(F.lit(1)).alias("n"))
    return X.gini_from_histogram(X.size_histogram(per)).select("gini", F.col("groups").cast("long"))


@register("fx_hhi", sql=EV + f""",
per AS (SELECT {GINI_KEY_SQL} AS uid, count(*) AS n FROM frame GROUP BY 1),
o AS (SELECT n, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS m, sum(n) OVER () AS sx FROM per)
SELECT max(m)::BIGINT AS clients, (2 * sum(i * n) / max(sx) - (max(m) + 1)) / max(m) AS gini,
       sum((n::DOUBLE / sx) * (n::DOUBLE / sx)) AS hhi, avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) AS once_share
FROM o""", floats=("gini", "hhi", "once_share"))
def q_hhi(spark, sf):
    """Clients, Gini, Herfindahl-Hirschman index and once-only share."""
    fr, spec = load_frame(spark, sf)
    return X.concentration(fr, paste_key(["user_id", "s_nationkey"], " "))


@register("fx_level_breaks")
def q_level_breaks(spark, sf):
    """Bai-Perron breaks of the daily rate, pooled and per segment."""
    fr, spec = load_frame(spark, sf)
    return X.level_breaks(fr, spec, series_key="event_type", min_n=200)


# ---------------------------------------------------------------- entity ---
ENTITY_KEYS = {
    "user": (["user_id"], None),
    "user+segment": (["user_id", "c_mktsegment"], None),
    "supplier_nation": (["s_nationkey"], None),
    "nations": (["s_nationkey", "c_nationkey"], None),
}


def _uid_sql(cols):
    null = " OR ".join(f"{c} IS NULL" for c in cols)
    key = " || '|' || ".join(f"coalesce({c}::VARCHAR, 'NA')" for c in cols)
    return f"CASE WHEN {null} THEN NULL ELSE {key} END"


EARLY_SQL = "WITH " + O.FRAME_SQL["events"].lstrip() + "," + O.windows_sql() + """,
early AS (SELECT * FROM fw WHERE "window" = 'early')"""


def _lchoose(a, b):
    return f"(lgamma(({a}) + 1) - lgamma(({b}) + 1) - lgamma(({a}) - ({b}) + 1))"


def _entity_cte(i, cols):
    return f""",
k{i} AS (SELECT {_uid_sql(cols)} AS uid, y, t FROM early),
pe{i} AS (SELECT uid, count(*) AS n, sum(y) AS pos, (max(t) - min(t)) / 86400.0 AS span FROM k{i} GROUP BY uid),
cv{i} AS (SELECT * FROM pe{i} WHERE uid IS NOT NULL),
tot{i} AS (SELECT sum(n) AS nn, sum(pos) AS kk FROM cv{i}),
gi{i} AS (SELECT (2 * sum(i * n) / max(sx) - (max(m) + 1)) / max(m) AS gini FROM (
           SELECT n, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS m, sum(n) OVER () AS sx FROM cv{i}) o),
nm{i} AS (SELECT avg(CASE WHEN c.n > t.kk THEN 0.0 ELSE exp({_lchoose('t.kk', 'c.n')} - {_lchoose('t.nn', 'c.n')}) END
                     + CASE WHEN c.n > t.nn - t.kk THEN 0.0 ELSE exp({_lchoose('t.nn - t.kk', 'c.n')} - {_lchoose('t.nn', 'c.n')}) END) AS null_mean
          FROM cv{i} c, tot{i} t WHERE c.n > 1),
r{i} AS (
  SELECT (SELECT sum(n) FROM cv{i})::DOUBLE / (SELECT sum(n) FROM pe{i}) AS rows_covered,
         (SELECT count(*) FROM cv{i})::BIGINT AS entities,
         (SELECT quantile_cont(n, 0.5) FROM cv{i}) AS median_size,
         (SELECT avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) FROM cv{i}) AS singleton_share,
         (SELECT gini FROM gi{i}) AS gini,
         (SELECT quantile_cont(span, 0.5) FROM cv{i}) AS median_span_days,
         (SELECT avg(CASE WHEN pos = 0 OR pos = n THEN 1.0 ELSE 0.0 END) FROM cv{i} WHERE n > 1) AS pure_share,
         (SELECT null_mean FROM nm{i}) AS null_mean,
         (SELECT avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END) FROM cv{i}) AS multi_row_share,
         (SELECT count(*) FROM cv{i} WHERE n > 1)::BIGINT AS multi_groups)"""


def _compare_sql():
    s = EARLY_SQL
    sel = []
    for i, (name, (cols, anchor)) in enumerate(ENTITY_KEYS.items()):
        s += _entity_cte(i, cols)
        sel.append(f"""SELECT '{name}' AS candidate, '{' + '.join(cols)}' AS components, rows_covered, entities,
       median_size, singleton_share, gini, median_span_days, pure_share, null_mean,
       pure_share - null_mean AS lift_over_null FROM r{i}""")
    return s + "\n" + "\nUNION ALL\n".join(sel)


CMP_F = ("rows_covered", "median_size", "singleton_share", "gini", "median_span_days", "pure_share",
         "null_mean", "lift_over_null")


@register("en_compare_keys", sql=_compare_sql(), floats=CMP_F)
def q_compare_keys(spark, sf):
    """Candidate keys side by side on the early window; lift over the exact null mean."""
    a = prepare(spark, sf)
    early = a.fw.where(F.col("window") == "early")
    return E.compare_keys(early, ENTITY_KEYS, a.spec.label, a.spec.time)


@register("en_key_p_values")
def q_key_p_values(spark, sf):
    """The key table with the 99 % quantile of 200 label shuffles and the p-value of every candidate key."""
    a = prepare(spark, sf)
    early = a.fw.where(F.col("window") == "early")
    return E.compare_keys(early, ENTITY_KEYS, a.spec.label, a.spec.time, draws=200)


@register("en_null_mean", sql=EARLY_SQL + _entity_cte(0, ["user_id"]) + "\nSELECT pure_share, null_mean FROM r0",
          floats=("pure_share", "null_mean"))
def q_en_null_mean(spark, sf):
    """Pure share of the user key's multi-row groups and its exact mean under a label shuffle."""
    a = prepare(spark, sf)
    g = E.groups(a.fw.where(F.col("window") == "early"), E.entity_uid(["user_id"]), a.spec.label)
    one = F.lit(1).alias("_one")
    return E.purity(g).select("*", one).join(E.purity_null_mean(g).select("*", one), "_one").drop("_one")


@register("en_groups", sql=EARLY_SQL + _entity_cte(0, ["user_id"]) + """
SELECT (SELECT count(*) FROM cv0)::BIGINT AS groups, multi_groups, singleton_share,
       (SELECT sum(n) FROM cv0)::BIGINT AS rows_covered FROM r0""", floats=("singleton_share",))
def q_en_groups(spark, sf):
    """Groups, multi-row groups, singleton share and rows covered of the user key."""
    a = prepare(spark, sf)
    early = a.fw.where(F.col("window") == "early")
    g = E.groups(early, E.entity_uid(["user_id"]), a.spec.label)
    return E.group_summary(g).select(F.col("groups").cast("long"), F.col("multi_groups").cast("long"),
                                     "singleton_share", F.col("rows_covered").cast("long"))


@register("en_purity", sql=EARLY_SQL + _entity_cte(0, ["user_id"]) + "\nSELECT pure_share FROM r0",
          floats=("pure_share",))
def q_en_purity(spark, sf):
    """Share of multi-row groups whose labels are all equal."""
    a = prepare(spark, sf)
    early = a.fw.where(F.col("window") == "early")
    return E.purity(E.groups(early, E.entity_uid(["user_id"]), a.spec.label))


@register("en_purity_null")
def q_en_purity_null(spark, sf):
    """Observed purity, exact null mean, q99 and p from label-shuffle draws."""
    a = prepare(spark, sf)
    early = a.fw.where(F.col("window") == "early")
    return E.purity_null(E.groups(early, E.entity_uid(["user_id"]), a.spec.label), draws=200, seed=1)


@register("en_coverage", sql=EARLY_SQL + _entity_cte(0, ["s_nationkey", "c_nationkey"]) + """
SELECT rows_covered, entities, median_size, gini, median_span_days, multi_row_share FROM r0""",
          floats=("rows_covered", "median_size", "gini", "median_span_days", "multi_row_share"))
def q_en_coverage(spark, sf):
    """Rows covered, entities, median size, Gini, median span, multi-row share of a key."""
    a = prepare(spark, sf)
    early = a.fw.where(F.col("window") == "early")
    return E.coverage(early, E.entity_uid(["s_nationkey", "c_nationkey"]), a.spec.time)


@register("en_verify_key", sql=EV + f""",
t AS (SELECT {_uid_sql(['c_nationkey', 'c_mktsegment'])} AS mine, user_id::VARCHAR AS theirs FROM frame),
pairs AS (SELECT mine, theirs, count(*) AS n FROM t WHERE mine IS NOT NULL AND theirs IS NOT NULL GROUP BY ALL),
m1 AS (SELECT mine, count(*) AS k FROM pairs GROUP BY mine),
t1 AS (SELECT theirs, count(*) AS k FROM pairs GROUP BY theirs),
a AS (SELECT coalesce(sum(p.n), 0) AS a FROM pairs p JOIN m1 USING (mine) JOIN t1 USING (theirs)
      WHERE m1.k = 1 AND t1.k = 1)
SELECT (a.a + count(CASE WHEN mine IS NULL AND theirs IS NULL THEN 1 END))::DOUBLE / count(*) AS agreement,
       count(CASE WHEN mine IS NULL THEN 1 END)::DOUBLE / count(*) AS null_here,
       count(CASE WHEN theirs IS NULL THEN 1 END)::DOUBLE / count(*) AS null_pipeline,
       count(DISTINCT mine)::BIGINT AS groups_here, count(DISTINCT theirs)::BIGINT AS groups_pipeline
FROM t, a GROUP BY a.a""", floats=("agreement", "null_here", "null_pipeline"))
def q_verify(spark, sf):
    """Partition agreement of (nation, segment) with the supplied user key."""
    fr, spec = load_frame(spark, sf)
    return E.verify_key(fr, E.entity_uid(["c_nationkey", "c_mktsegment"]), "user_id")


@register("en_history_share", sql=EARLY_SQL + f""",
k AS (SELECT {_uid_sql(['user_id', 's_nationkey'])} AS uid FROM early)
SELECT count(CASE WHEN uid IS NULL THEN 1 END)::DOUBLE / count(*) AS no_key,
       count(DISTINCT uid)::DOUBLE / count(*) AS first_seen,
       (count(uid) - count(DISTINCT uid))::DOUBLE / count(*) AS has_history FROM k""",
          floats=("no_key", "first_seen", "has_history"))
def q_history(spark, sf):
    """Rows with no key / first of their entity / with prior history (early window)."""
    a = prepare(spark, sf)
    early = a.fw.where(F.col("window") == "early")
    return E.history_share(early, E.entity_uid(["user_id", "s_nationkey"]), a.spec.time, a.spec.id)


@register("fx_power_law", sql="WITH " + O.FRAME_SQL["events"].lstrip() + """,
x AS (SELECT value AS v, count(*) AS c FROM frame WHERE y = 1 AND value > 0 GROUP BY value),
tl AS (SELECT v, c, sum(c) OVER (ORDER BY v) AS upto, sum(c) OVER () - (sum(c) OVER (ORDER BY v) - c) AS n,
              sum(c * ln(v)) OVER (ORDER BY v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l,
              row_number() OVER (ORDER BY v DESC) AS rk FROM x),
cd AS (SELECT v AS xmin, upto - c AS before, n, 1 + n / (l - n * ln(v)) AS alpha
       FROM tl WHERE rk > 1 AND v <= 1e5 AND l - n * ln(v) > 1e-12::DOUBLE * n),
ds AS (SELECT xmin, alpha, cd.n AS n_tail, max(greatest(
          abs((upto - before)::DOUBLE / cd.n - (1 - pow(v / xmin, 1 - alpha))),
          abs((upto - c - before + 1)::DOUBLE / cd.n - (1 - pow(v / xmin, 1 - alpha))))) AS ks
       FROM cd JOIN tl ON tl.v >= cd.xmin GROUP BY ALL)
SELECT xmin, alpha, n_tail::BIGINT AS n_tail, ks, alpha > 3 AS finite_variance,
       (SELECT count(*) FROM x WHERE v <= 1e5)::BIGINT AS candidates, (SELECT count(*) FROM x WHERE v > 1e5)::BIGINT AS above_xmax
FROM ds ORDER BY round(ks * 1e12::DOUBLE), xmin LIMIT 1""", floats=("xmin", "alpha", "ks"))
def q_power_law(spark, sf):
    """Power-law tail of positive amounts among label-1 rows: xmin by least KS, alpha by MLE."""
    fr, spec = load_frame(spark, sf)
    return X.power_law(fr, spec, "value")
