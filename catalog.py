"""Queries over the test tables, each with the SQL it must agree with where SQL can say it.

Every query reads whole tables.  ``digits`` rounds the named floating columns
the same way on both sides before they are compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statweave import autopilot as pilot
from statweave import registry
from statweave.functions import dist
from statweave.functions.tails import norm_p
from statweave.operators import (
    anova,
    association,
    assumptions,
    charts,
    cleaning,
    correlation,
    descriptive,
    explore,
    hypothesis,
    multivariate,
    normality,
    profile,
    quality,
    recommend,
    regression,
    reliability,
    resampling,
    survival,
    timeseries,
    validate,
)
from statweave.plans.tables import checkpoint_dir
from statweave.sources import files, sinks
from statweave.sources.store import VersionStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The test tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _digits(text: str) -> dict[str, int]:
    out = {}
    for part in text.split():
        name, _, d = part.partition(":")
        out[name] = int(d or 6)
    return out


def query(name: str, sql: str | None = None, digits: str = ""):
    """Register a query function of (tables) under ``name``."""
    places = _digits(digits)

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = fn(Tables(spark, folder))
            return out.withColumns({c: F.round(F.col(c).cast("double"), d) + F.lit(0.0) for c, d in places.items()}) if places else out

        QUERIES[name] = run
        if sql is not None:
            swaps = ", ".join(f'round("{c}"::double, {d}) + 0.0 as "{c}"' for c, d in places.items())
            ORACLES[name] = f"select * replace ({swaps}) from ({sql}) as answer" if swaps else sql
        return fn

    return register


def scratch(spark: SparkSession) -> str:
    """A fresh folder beside the session's checkpoints, which all executors share."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


# Upper tail of the normal distribution for z >= 0, after Hart (1968) as given by West (2005).
def upper_tail(z: str) -> str:
    top = f"((((((0.0352624965998911*{z}+0.700383064443688)*{z}+6.37396220353165)*{z}+33.912866078383)*{z}+112.079291497871)*{z}+221.213596169931)*{z}+220.206867912376)"
    low = f"(((((((0.0883883476483184*{z}+1.75566716318264)*{z}+16.064177579207)*{z}+86.7807322029461)*{z}+296.564248779674)*{z}+637.333633378831)*{z}+793.826512519948)*{z}+440.413735824752)"
    return f"(exp(-{z}*{z}/2)*{top}/{low})"


# -- mean tests ---------------------------------------------------------------------

GROUP_MOMENTS = """
  g as (select {by} {label} as g, {y} as y from {table}),
  m as (select {by} g, count(*) as n, avg(y) as mean, var_samp(y) as v, quantile_cont(y, 0.5) as med from g group by {by} g),
  z as (select {by0} g.g, abs(g.y - m.med) as z from g join m on {join} g.g = m.g),
  zg as (select {by} g, count(*) as n, avg(z) as mean, var_samp(z) as v from z group by {by} g),
  zt as (select {by} avg(z) as gm from z group by {byl}),
  lev as (select {zby} count(*) as k, sum(n)::bigint as n,
          (sum(n*(mean-gm)*(mean-gm))/(count(*)-1)) / (sum((n-1)*v)/(sum(n)-count(*))) as w
          from zg join zt on {zjoin} true group by {zgroup})
"""


def moments_sql(table: str, y: str, label: str, by: str | None = None) -> str:
    """Shared prelude: group moments and the median-centred Levene statistic."""
    return GROUP_MOMENTS.format(
        table=table,
        y=y,
        label=label,
        by=f"{by}, " if by else "",
        byl=by or "1=1",
        by0=f"g.{by}, " if by else "",
        join=f"g.{by} = m.{by} and" if by else "",
        zby=f"zg.{by}, " if by else "",
        zjoin=f"zg.{by} = zt.{by} and" if by else "",
        zgroup=f"zg.{by}" if by else "1=1",
    ).replace("group by 1=1", "")


def title(c: str) -> str:
    return f"upper(substr({c}, 1, 1)) || lower(substr({c}, 2))"


T_SQL = f"""
with {moments_sql('lineitem', 'l_extendedprice', title('l_linestatus'), 'l_returnflag')},
 p as (select l_returnflag, min(g) as group_1, max(g) as group_2, min_by(n, g) as n_1, max_by(n, g) as n_2, min_by(mean, g) as mean_1,
   max_by(mean, g) as mean_2, min_by(v, g) as v1, max_by(v, g) as v2 from m group by l_returnflag),
 s as (select p.*, lev.w as levene_W, sqrt(((n_1-1)*v1+(n_2-1)*v2)/(n_1+n_2-2)) as sp, lev.w < 3.843 as equal_var from p join lev on p.l_returnflag = lev.l_returnflag)
select l_returnflag,
 case when equal_var then (mean_1-mean_2)/(sp*sqrt(1.0/n_1+1.0/n_2)) else (mean_1-mean_2)/sqrt(v1/n_1+v2/n_2) end as t,
 case when equal_var then n_1+n_2-2 else (v1/n_1+v2/n_2)**2/((v1/n_1)**2/(n_1-1)+(v2/n_2)**2/(n_2-1)) end as df,
 equal_var, levene_W, mean_1, mean_2, sqrt(v1) as sd_1, sqrt(v2) as sd_2, n_1, n_2, group_1, group_2, mean_1-mean_2 as mean_diff,
 (mean_1-mean_2)/sp as cohens_d, (mean_1-mean_2)/sp*(1-3.0/(4*(n_1+n_2)-9)) as hedges_g from s
"""
T_COLUMNS = "l_returnflag t df equal_var levene_W mean_1 mean_2 sd_1 sd_2 n_1 n_2 group_1 group_2 mean_diff cohens_d hedges_g".split()


@query("independent_t", T_SQL, "t df:4 levene_W mean_1 mean_2 sd_1 sd_2 mean_diff cohens_d:8 hedges_g:8")
def _(t):
    return hypothesis.independent_t(t.lineitem, "l_extendedprice", "l_linestatus", by=["l_returnflag"]).statistics.select(*T_COLUMNS)


@query("levene", f"with {moments_sql('lineitem', 'l_extendedprice', title('l_returnflag'))} select w as W, k, n from lev", "W")
def _(t):
    return hypothesis.levene(t.lineitem, "l_extendedprice", "l_returnflag").statistics.select("W", "k", "n")


@query(
    "effect_size",
    """with m as (select l_returnflag, l_linestatus as g, count(*) as n, avg(l_quantity) as mean, var_samp(l_quantity) as v from lineitem group by all),
    p as (select l_returnflag, min_by(n,g) as n_1, max_by(n,g) as n_2, min_by(mean,g)-max_by(mean,g) as d, min_by(v,g) as v1, max_by(v,g) as v2 from m group by 1)
    select l_returnflag, d/sqrt(((n_1-1)*v1+(n_2-1)*v2)/(n_1+n_2-2)) as cohens_d,
    d/sqrt(((n_1-1)*v1+(n_2-1)*v2)/(n_1+n_2-2))*(1-3.0/(4*(n_1+n_2)-9)) as hedges_g, n_1, n_2 from p""",
    "cohens_d:8 hedges_g:8",
)
def _(t):
    return hypothesis.effect_size(t.lineitem, "l_quantity", "l_linestatus", by=["l_returnflag"]).statistics.select("l_returnflag", "cohens_d", "hedges_g", "n_1", "n_2")


@query(
    "power_by_segment",
    """with m as (select l_returnflag, l_linestatus as g, count(*) as n, avg(l_quantity) as mean, var_samp(l_quantity) as v from lineitem group by all)
    select l_returnflag, (min_by(mean,g)-max_by(mean,g))/sqrt(((min_by(n,g)-1)*min_by(v,g)+(max_by(n,g)-1)*max_by(v,g))/(sum(n)-2)) as d,
    min_by(n,g) as n_1, max_by(n,g) as n_2, 0.8 as target_power from m group by 1""",
    "d:8 target_power",
)
def _(t):
    return hypothesis.power_by_segment(t.lineitem, "l_quantity", "l_linestatus", by=["l_returnflag"]).statistics.select("l_returnflag", "d", "n_1", "n_2", "target_power")


@query("power_analysis")
def _(t):
    return hypothesis.power_by_segment(t.lineitem, "l_quantity", "l_linestatus", by=["l_returnflag"]).statistics.drop("warnings")


@query(
    "one_sample_t",
    """select l_returnflag, (avg(l_quantity)-25)/(stddev_samp(l_quantity)/sqrt(count(*))) as t, count(*)-1 as df, avg(l_quantity) as mean,
    stddev_samp(l_quantity)/sqrt(count(*)) as se, count(*) as n, (avg(l_quantity)-25)/stddev_samp(l_quantity) as cohens_d from lineitem group by 1""",
    "t mean se:8 cohens_d:8",
)
def _(t):
    return hypothesis.one_sample_t(t.lineitem, "l_quantity", 25, by=["l_returnflag"]).statistics.select("l_returnflag", "t", "df", "mean", "se", "n", "cohens_d")


@query(
    "z_test",
    f"""with s as (select (avg(l_quantity)-25)/(stddev_samp(l_quantity)/sqrt(count(*))) as z, avg(l_quantity) as mean, stddev_samp(l_quantity) as sigma, count(*) as n from lineitem)
    select z, 2*{upper_tail('abs(z)')} as p_value, mean, sigma, n from s""",
    "z p_value:10 mean sigma",
)
def _(t):
    return hypothesis.z_test(t.lineitem, "l_quantity", 25).statistics.select("z", "p_value", "mean", "sigma", "n")


@query(
    "paired_t",
    """select l_returnflag, avg(l_tax-l_discount)/(stddev_samp(l_tax-l_discount)/sqrt(count(*))) as t, count(*)-1 as df, avg(l_tax-l_discount) as mean_diff,
    stddev_samp(l_tax-l_discount) as sd_diff, count(*) as n, avg(l_tax-l_discount)/stddev_samp(l_tax-l_discount) as cohens_d from lineitem group by 1""",
    "t mean_diff:9 sd_diff:9 cohens_d:8",
)
def _(t):
    return hypothesis.paired_t(t.lineitem, "l_tax", "l_discount", by=["l_returnflag"]).statistics.select("l_returnflag", "t", "df", "mean_diff", "sd_diff", "n", "cohens_d")


# -- rank tests ---------------------------------------------------------------------


@query(
    "mannwhitney",
    f"""with r as (select l_linestatus as g, l_quantity as y, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity)-1)/2.0 as r,
      count(*) over (partition by l_quantity) as tie from lineitem),
    a as (select min(g) as group_1, max(g) as group_2, count(*) filter (g='F') as n_1, count(*) filter (g='O') as n_2, sum(r) filter (g='F') as r1,
      quantile_cont(y,0.5) filter (g='F') as median_1, quantile_cont(y,0.5) filter (g='O') as median_2, sum(tie::double*tie-1) as ties from r),
    b as (select *, r1-n_1*(n_1+1)/2.0 as U, n_1::double*n_2 as nn, (n_1+n_2)::double as n from a),
    c as (select *, (greatest(U, nn-U)-nn/2-0.5)/sqrt(nn/12*((n+1)-ties/(n*(n-1)))) as z from b)
    select U, 2*{upper_tail('z')} as p_value, n_1, n_2, group_1, group_2, median_1, median_2, 1-2*U/nn as rank_biserial, U/nn as CLES from c""",
    "U:1 p_value:9 median_1 median_2 rank_biserial:9 CLES:9",
)
def _(t):
    return hypothesis.mannwhitney(t.lineitem, "l_quantity", "l_linestatus").statistics.select(
        "U", "p_value", "n_1", "n_2", "group_1", "group_2", "median_1", "median_2", "rank_biserial", "CLES"
    )


@query(
    "wilcoxon",
    """with d as (select l_returnflag as f, l_tax-l_discount as d from lineitem where l_tax-l_discount <> 0),
    r as (select f, d, rank() over (partition by f order by abs(d)) + (count(*) over (partition by f, abs(d))-1)/2.0 as r from d)
    select f as l_returnflag, least(sum(r) filter (d>0), sum(r) filter (d<0)) as W, count(*) as n, quantile_cont(d,0.5) as median_diff from r group by 1""",
    "W:1 median_diff:9",
)
def _(t):
    return hypothesis.wilcoxon(t.lineitem, "l_tax", "l_discount", by=["l_returnflag"]).statistics.select("l_returnflag", "W", "n", "median_diff")


KRUSKAL_SQL = """with r as (select c_mktsegment as g, c_acctbal as y, rank() over (order by c_acctbal) + (count(*) over (partition by c_acctbal)-1)/2.0 as r,
  count(*) over (partition by c_acctbal) as tie from customer),
 s as (select g, count(*) as n, sum(r) as rs, sum(tie::double*tie-1) as ties, quantile_cont(y,0.5) as med from r group by 1),
 t as (select count(*) as k, sum(n)::bigint as n, sum(ties) as ties, sum(rs*rs/n) as q from s),
 h as (select k, n, (12*q/(n::double*(n+1))-3*(n+1))/(1-ties/(n::double**3-n)) as H from t)
"""


@query("kruskal", KRUSKAL_SQL + "select H, exp(-H/2)*(1+H/2) as p_value, k, n, (H-k+1)/(n-k) as eta2_approx from h", "H:5 p_value:7 eta2_approx:8")
def _(t):
    return hypothesis.kruskal(t.customer, "c_acctbal", "c_mktsegment").statistics.select("H", "p_value", "k", "n", "eta2_approx")


@query("kruskal_groups", KRUSKAL_SQL + f"select {title('g')} as \"group\", n, med as median, rs/n as mean_rank from s", "median mean_rank:5")
def _(t):
    return hypothesis.kruskal(t.customer, "c_acctbal", "c_mktsegment").tables["groups"]


@query(
    "friedman",
    """with w as (select l_tax as a, l_discount as b, l_quantity/500 as c from lineitem),
    r as (select 1+(b<a)::int+(c<a)::int+((b=a)::int+(c=a)::int)/2.0 as ra, 1+(a<b)::int+(c<b)::int+((a=b)::int+(c=b)::int)/2.0 as rb,
      1+(a<c)::int+(b<c)::int+((a=c)::int+(b=c)::int)/2.0 as rc, (a=b and b=c) as all3, ((a=b)::int+(b=c)::int+(a=c)::int) as eq from w),
    s as (select count(*) as n, sum(ra) as a, sum(rb) as b, sum(rc) as c, sum(case when all3 then 24 when eq=1 then 6 else 0 end) as ties from r)
    select chi2, exp(-chi2/2) as p_value, 3 as k, n from (select (12.0/(n*12)*(a*a+b*b+c*c)-12.0*n)/(1-ties/(n*24.0)) as chi2, n from s)""",
    "chi2:3 p_value:8",
)
def _(t):
    wide = t.lineitem.select("l_tax", "l_discount", (F.col("l_quantity") / 500).alias("q"))
    return hypothesis.friedman(wide, ["l_tax", "l_discount", "q"]).statistics.select("chi2", "p_value", F.col("k").cast("int").alias("k"), "n")


# -- analysis of variance --------------------------------------------------------------

ANOVA_PRELUDE = f"""with {moments_sql('customer', 'c_acctbal', title('c_mktsegment'))},
 gm as (select avg(y) as gm from g),
 s as (select count(*) as k, sum(n)::bigint as n, sum(n*(mean-gm)*(mean-gm)) as ss_between, sum((n-1)*v) as ss_within from m, gm)
"""


@query(
    "oneway_anova",
    ANOVA_PRELUDE
    + """select (ss_between/(s.k-1))/(ss_within/(s.n-s.k)) as F, s.k-1 as df_between, s.n-s.k as df_within, ss_between/(ss_between+ss_within) as eta_squared,
    (ss_between-(s.k-1)*ss_within/(s.n-s.k))/(ss_between+ss_within+ss_within/(s.n-s.k)) as omega_squared, lev.w as levene_W,
    ss_between/1e6 as ss_between, ss_within/1e6 as ss_within, s.k, s.n from s, lev""",
    "F eta_squared:8 omega_squared:8 levene_W ss_between:4 ss_within:4",
)
def _(t):
    stats = anova.oneway_anova(t.customer, "c_acctbal", "c_mktsegment").statistics
    return stats.select("F", "df_between", "df_within", "eta_squared", "omega_squared", "levene_W", (F.col("ss_between") / 1e6).alias("ss_between"), (F.col("ss_within") / 1e6).alias("ss_within"), "k", "n")


@query("oneway_anova_groups", ANOVA_PRELUDE + "select g as \"group\", n, mean, sqrt(v) as sd, med as median from m", "mean sd median")
def _(t):
    return anova.oneway_anova(t.customer, "c_acctbal", "c_mktsegment").tables["group_summaries"]


@query(
    "tukey_hsd",
    """with m as (select c_mktsegment as g, avg(c_acctbal) as mean from customer group by 1)
    select a.g as group1, b.g as group2, b.mean-a.mean as meandiff, b.mean-a.mean as middle from m a join m b on a.g < b.g""",
    "meandiff middle",
)
def _(t):
    table = anova.tukey_hsd(t.customer, "c_acctbal", "c_mktsegment").tables["comparisons"]
    return table.select("group1", "group2", "meandiff", ((F.col("lower") + F.col("upper")) / 2).alias("middle"))


@query("tukey_hsd_intervals")
def _(t):
    return anova.tukey_hsd(t.customer, "c_acctbal", "c_mktsegment").tables["comparisons"]


TWOWAY_SQL = """with r as (select l_linestatus as a, l_returnflag as b, l_extendedprice as y, (l_linestatus='O')::int as d from lineitem),
 w as (select sum(v) as ss, sum(n)::bigint as n, count(*) as cells from (select a, b, var_pop(y)*count(*) as v, count(*) as n from r group by a, b)),
 rb as (select sum(var_pop_y) as rss from (select var_pop(y)*count(*) as var_pop_y from r group by b)),
 ra as (select sum(v) as rss from (select var_pop(y)*count(*) as v from r group by a)),
 p as (select sum(sxy) as sxy, sum(sxx) as sxx from (select covar_pop(d, y)*count(*) as sxy, var_pop(d)*count(*) as sxx from r group by b)),
 t as (select ra.rss as ra, rb.rss as rb, rb.rss-sxy*sxy/sxx as rab, w.ss as ss, w.n-w.cells as dof, sxy*sxy/sxx as ssa from w, ra, rb, p)
"""


@query(
    "twoway_anova",
    TWOWAY_SQL
    + """select term, sum_sq/1e9 as sum_sq, df, case when term='Residual' then null else sum_sq/df/(ss/dof) end as F from (
     select 'C(A)' as term, ssa as sum_sq, 1.0::double as df, ss, dof from t union all select 'C(B)', ra-rab, 2, ss, dof from t
     union all select 'C(A):C(B)', rab-ss, 2, ss, dof from t union all select 'Residual', ss, dof, ss, dof from t)""",
    "sum_sq:3 F:4 df",
)
def _(t):
    table = anova.twoway_anova(t.lineitem, "l_extendedprice", "l_linestatus", "l_returnflag").tables["anova"]
    return table.select("term", (F.col("sum_sq") / 1e9).alias("sum_sq"), "df", "F")


CONTRASTS = """with c as (select o_orderstatus as a, o_orderpriority as b, count(*) as n, avg(o_totalprice) as m, var_samp(o_totalprice) * (count(*) - 1) as ss from orders group by 1, 2),
 z as (select min(a) as a0, min(b) as b0, sqrt(sum(ss) / (sum(n) - count(*))) as s from c),
 j as (select c.a, c.b, a0, b0, s, c.m as m, 1.0 / c.n as v, r.m as rm, 1.0 / r.n as rv, k.m as km, 1.0 / k.n as kv, o.m as om, 1.0 / o.n as ov
  from c, z, c r, c k, c o where r.a = c.a and r.b = b0 and k.a = a0 and k.b = c.b and o.a = a0 and o.b = b0)
 select case when a = a0 and b = b0 then 'Intercept' when b = b0 then 'C(A)[T.' || a || ']' when a = a0 then 'C(B)[T.' || b || ']' else 'C(A)[T.' || a || ']:C(B)[T.' || b || ']' end as term,
  case when a = a0 and b = b0 then m when b = b0 or a = a0 then m - om else m - rm - km + om end as coef,
  s * sqrt(case when a = a0 and b = b0 then v when b = b0 or a = a0 then v + ov else v + rv + kv + ov end) as se from j"""


@query("twoway_anova_coefficients", CONTRASTS, "coef:4 se:4")
def _(t):
    return anova.twoway_anova(t.orders, "o_totalprice", "o_orderstatus", "o_orderpriority").tables["params"].select("term", "coef", "se")


@query("twoway_anova_params")
def _(t):
    return anova.twoway_anova(t.orders, "o_totalprice", "o_orderstatus", "o_orderpriority").tables["params"]


@query(
    "ancova",
    """with r as (select l_returnflag as g, l_quantity as x, l_extendedprice as y from lineitem),
    w as (select sum(xx) as xx, sum(xy) as xy, sum(yy) as yy, sum(n)::bigint as n, count(*) as k from
      (select count(*) as n, var_pop(x)*count(*) as xx, covar_pop(x,y)*count(*) as xy, var_pop(y)*count(*) as yy from r group by g)),
    t as (select var_pop(x)*count(*) as xx, covar_pop(x,y)*count(*) as xy, var_pop(y)*count(*) as yy from r),
    s as (select w.yy-w.xy*w.xy/w.xx as rss, t.yy-t.xy*t.xy/t.xx as r0, w.yy as rg, w.n-w.k-1 as dof, w.k-1 as dg from w, t)
    select 'l_returnflag' as "Source", (r0-rss)/1e9 as SS, dg as DF, (r0-rss)/dg/(rss/dof) as F, (r0-rss)/r0 as np2 from s
    union all select 'l_quantity', (rg-rss)/1e9, 1, (rg-rss)/(rss/dof), (rg-rss)/rg from s
    union all select 'Residual', rss/1e9, dof, null, null from s""",
    "SS:3 F:4 np2:8",
)
def _(t):
    table = anova.ancova(t.lineitem, "l_extendedprice", "l_returnflag", "l_quantity").tables["ancova"]
    return table.select("Source", (F.col("SS") / 1e9).alias("SS"), "DF", "F", "np2")


@query(
    "repeated_anova",
    """with w as (select l_tax as a, l_discount as b, l_quantity/500 as c from lineitem),
    m as (select count(*) as n, avg(a) as ma, avg(b) as mb, avg(c) as mc, (avg(a)+avg(b)+avg(c))/3 as g from w),
    s as (select n, n*((ma-g)**2+(mb-g)**2+(mc-g)**2) as ss_time,
      (select sum((a-ma-(a+b+c)/3+g)**2+(b-mb-(a+b+c)/3+g)**2+(c-mc-(a+b+c)/3+g)**2) from w, m) as ss_error,
      (select sum(3*((a+b+c)/3-g)**2) from w, m) as ss_subj from m)
    select 'time' as "Source", ss_time as SS, 2::bigint as DF, ss_time/2 as MS, (ss_time/2)/(ss_error/(2*(n-1))) as F, ss_time/(ss_time+ss_error+ss_subj) as ng2 from s
    union all select 'Error', ss_error, 2*(n-1), ss_error/(2*(n-1)), null, null from s""",
    "SS MS:9 F:4 ng2:8",
)
def _(t):
    wide = t.lineitem.select("l_tax", "l_discount", (F.col("l_quantity") / 500).alias("q"))
    return anova.repeated_anova(wide, ["l_tax", "l_discount", "q"]).tables["anova"].select("Source", "SS", "DF", "MS", "F", "ng2")


@query("repeated_anova_sphericity")
def _(t):
    wide = t.lineitem.select("l_returnflag", "l_tax", "l_discount", (F.col("l_quantity") / 500).alias("q"))
    return anova.repeated_anova(wide, ["l_tax", "l_discount", "q"], by=["l_returnflag"]).statistics.drop("warnings")


def _items(t: Tables, n: int) -> DataFrame:
    return t.embeddings.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(n)])


ITEM_SQL = "select " + ", ".join(f"embedding[{i + 1}]::double as e{i}" for i in range(64)) + " from embeddings"
ITEMS = [f"e{i}" for i in range(64)]
ITEM_SUM = "+".join(ITEMS)


@query(
    "cronbach_alpha",
    f"with w as ({ITEM_SQL}) select 64.0/63*(1-({'+'.join(f'var_samp({e})' for e in ITEMS)})/var_samp({ITEM_SUM})) as alpha, 64::bigint as n_items, count(*) as n from w",
    "alpha",
)
def _(t):
    return reliability.cronbach_alpha(_items(t, 64), ITEMS).statistics.select("alpha", "n_items", "n")


@query(
    "cronbach_alpha_items",
    f"with w as ({ITEM_SQL}), t as (select *, {ITEM_SUM} as s from w) "
    + " union all ".join(f"select '{e}' as item, corr({e}, s-{e}) as item_total_r, avg({e}) as mean, stddev_samp({e}) as sd from t" for e in ITEMS),
    "item_total_r mean:8 sd:8",
)
def _(t):
    return reliability.cronbach_alpha(_items(t, 64), ITEMS).tables["item_total"].select("item", "item_total_r", "mean", "sd")


# -- description -----------------------------------------------------------------------

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(c: str) -> str:
    return f"""select '{c}' as variable, count({c}) as n, avg({c}) as mean, quantile_cont({c},0.5) as median,
    (select {c} from lineitem group by 1 order by count(*) desc, 1 limit 1) as mode, stddev_samp({c}) as std, var_samp({c}) as variance, min({c}) as min, max({c}) as max,
    max({c})-min({c}) as range, quantile_cont({c},0.25) as q1, quantile_cont({c},0.75) as q3, quantile_cont({c},0.75)-quantile_cont({c},0.25) as iqr,
    quantile_cont({c},0.05) as p05, quantile_cont({c},0.95) as p95, skewness({c}) as skewness, kurtosis({c}) as kurtosis, stddev_samp({c})/sqrt(count({c})) as se from lineitem"""


@query("descriptive", " union all ".join(_describe_sql(c) for c in NUMBERS), "mean median mode std variance:3 min max range:5 q1 q3 iqr p05 p95 skewness kurtosis se")
def _(t):
    table = descriptive.descriptive(t.lineitem, NUMBERS).tables["descriptives"]
    return table.drop("ci95_low", "ci95_high")


def _segment_sql(c: str) -> str:
    by = "l_returnflag, l_linestatus"
    mode = f"(select {by}, {c} as mode from (select {by}, {c}, row_number() over (partition by {by} order by count(*) desc, {c}) as k from lineitem group by {by}, {c}) where k = 1)"
    return _describe_sql(c).replace(f"select '{c}'", f"select {by}, '{c}'").replace(f"(select {c} from lineitem group by 1 order by count(*) desc, 1 limit 1) as mode", "any_value(mode) as mode") + f" join {mode} as m{c} using ({by}) group by {by}"


@query("descriptive_by_segment", " union all ".join(_segment_sql(c) for c in NUMBERS), "mean median mode std variance:3 min max range:5 q1 q3 iqr p05 p95 skewness kurtosis se")
def _(t):
    table = descriptive.descriptive(t.lineitem, NUMBERS, by=["l_returnflag", "l_linestatus"]).tables["descriptives"]
    return table.drop("ci95_low", "ci95_high")


@query(
    "frequency",
    """with c as (select o_orderpriority as level, count(*) as count from orders group by 1),
    p as (select level, count, round(100*count::double/sum(count) over (), 2) as percent from c)
    select level, count, percent, round(sum(percent) over (order by count desc, level rows unbounded preceding), 2) as cum_percent from p""",
    "percent:2 cum_percent:2",
)
def _(t):
    return descriptive.frequency(t.orders, "o_orderpriority").tables["frequencies"]


@query(
    "group_compare",
    """select c_mktsegment as "group", count(*) as n, avg(c_acctbal) as mean, stddev_samp(c_acctbal) as sd, quantile_cont(c_acctbal,0.5) as median,
    quantile_cont(c_acctbal,0.25) as q1, quantile_cont(c_acctbal,0.75) as q3 from customer group by 1""",
    "mean sd median q1 q3",
)
def _(t):
    return explore.group_compare(t.customer, "c_acctbal", "c_mktsegment")


# -- correlation and association -----------------------------------------------------------


@query(
    "pearson",
    """with r as (select l_returnflag, corr(l_quantity, l_extendedprice) as coefficient, count(*) as n from lineitem group by 1)
    select l_returnflag, coefficient, n, tanh(atanh(coefficient)-1.96/sqrt(n-3)) as ci95_low, tanh(atanh(coefficient)+1.96/sqrt(n-3)) as ci95_high,
    case when abs(coefficient)<0.1 then 'negligible' when abs(coefficient)<0.3 then 'weak' when abs(coefficient)<0.5 then 'moderate' else 'strong' end as effect_magnitude from r""",
    "coefficient:9 ci95_low:9 ci95_high:9",
)
def _(t):
    return correlation.pearson(t.lineitem, "l_quantity", "l_extendedprice", by=["l_returnflag"]).statistics.select(
        "l_returnflag", "coefficient", "n", "ci95_low", "ci95_high", "effect_magnitude"
    )


def midrank(x: str, by: str = "") -> str:
    part = f"partition by {by}" if by else ""
    comma = f"{by}, " if by else ""
    return f"rank() over ({part} order by {x}) + (count(*) over (partition by {comma}{x})-1)/2.0"


@query(
    "spearman",
    f"with r as (select {midrank('l_quantity')} as a, {midrank('l_extendedprice')} as b from lineitem) select corr(a,b) as coefficient, count(*) as n from r",
    "coefficient:9",
)
def _(t):
    return correlation.spearman(t.lineitem, "l_quantity", "l_extendedprice").statistics.select("coefficient", "n")


@query(
    "kendall",
    """with p as (select p_size as x, p_retailprice as y from part),
    s as (select sum(sign(a.x-b.x)*sign(a.y-b.y)) as s, sum((a.x<>b.x)::int) as nx, sum((a.y<>b.y)::int) as ny from p a, p b),
    n as (select count(*) as n from p) select s/(sqrt(nx::double)*sqrt(ny::double)) as coefficient, n.n from s, n""",
    "coefficient:9",
)
def _(t):
    return correlation.kendall(t.part, "p_size", "p_retailprice").statistics.select("coefficient", "n")


def _pairs_sql(expr: str) -> str:
    return " union all ".join(f"select '{a}' as x, '{b}' as y, {expr.format(a=a, b=b)} as r, count(*) as n from w" for a in NUMBERS for b in NUMBERS)


@query("correlation_matrix", "with w as (select * from lineitem) " + _pairs_sql("corr({a},{b})"), "r:9")
def _(t):
    return correlation.correlation_matrix(t.lineitem, NUMBERS).tables["pairwise"].select("x", "y", "r", "n")


RANKED = "with w as (select " + ", ".join(f"{midrank(c)} as {c}" for c in NUMBERS) + " from lineitem) "


@query("correlation_matrix_spearman", RANKED + _pairs_sql("corr({a},{b})"), "r:9")
def _(t):
    return correlation.correlation_matrix(t.lineitem, NUMBERS, "spearman").tables["pairwise"].select("x", "y", "r", "n")


@query("top_correlations", RANKED + f"select * from ({_pairs_sql('corr({a},{b})')}) where x < y order by abs(r) desc limit 3", "r:9")
def _(t):
    return correlation.top_correlations(t.lineitem, NUMBERS, 3).select("x", "y", "r", "n")


def contingency_sql(table: str, x: str, y: str) -> str:
    return f"""with o as (select {x}::varchar as x, {y}::varchar as y, count(*) as o from {table} group by 1, 2),
    r as (select x, sum(o) as r from o group by 1), c as (select y, sum(o) as c from o group by 1), n as (select sum(o)::bigint as n from o),
    e as (select r.x, c.y, coalesce(o.o, 0) as o, r.r::double*c.c/n.n as e from r cross join c cross join n left join o on o.x=r.x and o.y=c.y),
    s as (select count(distinct x) as a, count(distinct y) as b from e),
    q as (select case when any_value(a)=2 and any_value(b)=2 then sum((abs(o-e)-least(0.5, abs(o-e)))**2/e) else sum((o-e)**2/e) end as chi2,
      any_value((a-1)*(b-1)) as df, count(*) filter (e<5) as low, any_value(least(a,b)-1) as m from e, s)
    """


@query(
    "chi_square",
    contingency_sql("lineitem", "l_returnflag", "l_linestatus") + "select chi2, exp(-chi2/2) as p_value, df, n, sqrt(chi2/(n*m)) as cramers_v, low as low_expected_cells from q, n",
    "chi2 p_value:8 cramers_v:9",
)
def _(t):
    return association.chi_square(t.lineitem, "l_returnflag", "l_linestatus").statistics.select("chi2", "p_value", "df", "n", "cramers_v", "low_expected_cells")


@query("chi_square_cells", contingency_sql("documents", "lang", "source") + "select x, y, o as observed, e as expected from e where o > 0", "expected")
def _(t):
    return association.chi_square(t.documents, "lang", "source").tables["cells"]


@query("cramers_v", contingency_sql("labels", "quality", "toxic") + "select chi2, df, n, sqrt(chi2/(n*m)) as cramers_v, low as low_expected_cells from q, n", "chi2 cramers_v:9")
def _(t):
    return association.cramers_v(t.labels, "quality", "toxic").statistics.select("chi2", "df", "n", "cramers_v", "low_expected_cells")


FISHER_SQL = """with c as (select count(*) filter (quality=0 and toxic=0) as a, count(*) filter (quality=0 and toxic=1) as b,
 count(*) filter (quality=1 and toxic=0) as c, count(*) filter (quality=1 and toxic=1) as d from labels),
 k as (select unnest(range(greatest(0, a+c-c-d), least(a+b, a+c)+1)) as k, * from c),
 f as (select *, lgamma(a+b+1)-lgamma(k+1)-lgamma(a+b-k+1)+lgamma(c+d+1)-lgamma(a+c-k+1)-lgamma(c+d-a-c+k+1)-lgamma(a+b+c+d+1)+lgamma(a+c+1)+lgamma(b+d+1) as lp from k)
 select any_value(a::double*d/(b::double*c)) as odds_ratio, sum(exp(lp)) filter (lp <= lp0 + 1e-7) as p_value, any_value(a+b+c+d) as n
 from f, (select lp as lp0 from f where k = a)"""


@query("fisher_exact", FISHER_SQL, "odds_ratio p_value:8")
def _(t):
    return association.fisher_exact(t.labels, "quality", "toxic").statistics.select("odds_ratio", "p_value", "n")


# -- regression ---------------------------------------------------------------------------

SIMPLE_FIT = """with r as (select {x} as x, {y} as y{extra} from {table}),
 f as (select count(*) as n, avg(x) as mx, avg(y) as my, var_pop(x)*count(*) as sxx, covar_pop(x,y)*count(*) as sxy, var_pop(y)*count(*) as syy from r),
 b as (select *, sxy/sxx as b1, my-sxy/sxx*mx as b0, syy-sxy*sxy/sxx as rss from f),
 e as (select r.*, y-b0-b1*x as e, 1.0/n+(x-mx)**2/sxx as h, b.* exclude (n), n from r, b)
"""


@query(
    "linear_regression",
    SIMPLE_FIT.format(x="l_quantity", y="l_extendedprice", table="lineitem", extra="")
    + """select 'const' as term, b0 as coef, sqrt(rss/(n-2)*(1.0/n+mx*mx/sxx)) as se, b0/sqrt(rss/(n-2)*(1.0/n+mx*mx/sxx)) as t from b
    union all select 'l_quantity', b1, sqrt(rss/(n-2)/sxx), b1/sqrt(rss/(n-2)/sxx) from b""",
    "coef:5 se t",
)
def _(t):
    return regression.linear_regression(t.lineitem, "l_extendedprice", "l_quantity").tables["coefficients"].select("term", "coef", "se", "t")


@query(
    "regression_diagnostics",
    SIMPLE_FIT.format(x="o_custkey", y="o_totalprice", table="orders", extra=", o_orderkey as k")
    + """, m as (select count(*) as n, avg(e**3)/avg(e**2)**1.5 as s, avg(e**4)/avg(e**2)**2 as k, count(*)*corr(x, e*e)**2 as bp from e),
    d as (select sum((e-p)**2)/sum(e*e) as dw from (select e, lag(e) over (order by k) as p from e)),
    w as (select n, 1-rss/syy as r2, rss, syy, -n/2.0*(ln(2*pi()*rss/n)+1) as llf from b)
    select r2, 1-(1-r2)*(w.n-1)/(w.n-2) as r2_adj, ((syy-rss))/(rss/(w.n-2)) as fvalue, 4-2*llf as aic, 2*ln(w.n)-2*llf as bic, w.n, sqrt(rss/(w.n-2)) as residual_std,
    m.n/6.0*(s*s+(k-3)**2/4) as jarque_bera, bp as breusch_pagan, dw as durbin_watson from w, m, d""",
    "r2:8 r2_adj:8 fvalue:5 aic:4 bic:4 residual_std:4 jarque_bera:3 breusch_pagan:5 durbin_watson",
)
def _(t):
    stats = regression.linear_regression(t.orders, "o_totalprice", "o_custkey", order_by="o_orderkey").statistics
    return stats.select("r2", "r2_adj", "fvalue", "aic", "bic", "n", "residual_std", "jarque_bera", "breusch_pagan", "durbin_watson")


def two_predictors(a: str, b: str, y: str, table: str, na: str, nb: str) -> str:
    return f"""with r as (select {a} as a, {b} as b, {y} as y from {table}),
    s as (select count(*) as n, avg(a) as ma, avg(b) as mb, avg(y) as my, var_pop(a)*count(*) as aa, var_pop(b)*count(*) as bb, covar_pop(a,b)*count(*) as ab,
      covar_pop(a,y)*count(*) as ay, covar_pop(b,y)*count(*) as b_y, var_pop(y)*count(*) as yy from r),
    f as (select *, aa*bb-ab*ab as det, (bb*ay-ab*b_y)/(aa*bb-ab*ab) as b1, (aa*b_y-ab*ay)/(aa*bb-ab*ab) as b2 from s),
    g as (select *, my-b1*ma-b2*mb as b0, yy-b1*ay-b2*b_y as rss from f)
    select 'const' as term, b0 as coef, sqrt(rss/(n-3)*(1.0/n+(ma*ma*bb-2*ma*mb*ab+mb*mb*aa)/det)) as se, null as vif from g
    union all select '{na}', b1, sqrt(rss/(n-3)*bb/det), aa*bb/det from g union all select '{nb}', b2, sqrt(rss/(n-3)*aa/det), aa*bb/det from g"""


def _with_vif(result) -> DataFrame:
    return result.tables["coefficients"].join(result.tables["vif"], "term", "left").select("term", "coef", "se", F.col("VIF").alias("vif"))


@query("multiple_regression", two_predictors("l_quantity", "l_discount", "l_extendedprice", "lineitem", "l_quantity", "l_discount"), "coef:4 se:5 vif:8")
def _(t):
    return _with_vif(regression.linear_regression(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"]))


@query("polynomial_regression", two_predictors("l_quantity", "l_quantity**2", "l_extendedprice", "lineitem", "l_quantity", "l_quantity^2"), "coef:4 se:5 vif:6")
def _(t):
    return _with_vif(regression.polynomial_regression(t.lineitem, "l_extendedprice", "l_quantity"))


@query(
    "robust_regression",
    SIMPLE_FIT.format(x="l_quantity", y="l_extendedprice", table="lineitem", extra="")
    + """select 'const' as term, any_value(b0) as coef, sqrt(sum((1.0/n-mx*(x-mx)/sxx)**2*(e/(1-h))**2)) as se from e
    union all select 'l_quantity', any_value(b1), sqrt(sum(((x-mx)/sxx)**2*(e/(1-h))**2)) from e""",
    "coef:5 se",
)
def _(t):
    return regression.robust_regression(t.lineitem, "l_extendedprice", "l_quantity").tables["coefficients"].select("term", "coef", "se")


@query(
    "logistic_regression",
    f"""with c as (select (count(*) filter (quality=1 and toxic=0))::double as a, count(*) filter (quality=0 and toxic=0) as b,
      count(*) filter (quality=1 and toxic=1) as c, count(*) filter (quality=0 and toxic=1) as d from labels),
    w as (select 'const' as term, ln(a/b) as coef, sqrt(1/a+1.0/b) as se from c union all select 'toxic', ln(c/d/(a/b)), sqrt(1/a+1.0/b+1.0/c+1.0/d) from c)
    select term, coef, se, coef/se as z, exp(coef) as "or", 2*{upper_tail('abs(coef/se)')} as p_value from w""",
    "coef se z or:5 p_value:8",
)
def _(t):
    return regression.logistic_regression(t.labels, "quality", "toxic").tables["coefficients"].select("term", "coef", "se", "z", "or", "p_value")


@query("logistic_regression_documents")
def _(t):
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").withColumn("log_chars", F.log1p("n_chars"))
    return regression.logistic_regression(rows, "quality", ["log_chars", "toxic"]).tables["coefficients"]


def _status(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("open", (F.col("l_linestatus") == "O").cast("int"))


COUNT_GROUPS = """with g as (select (l_linestatus='O')::int as g, count(*) as n, avg(l_linenumber) as m from lineitem group by 1),
 p as (select max(m) filter (g=0) as m0, max(m) filter (g=1) as m1, max(n) filter (g=0) as n0, max(n) filter (g=1) as n1 from g),
 r as (select l_linenumber::double as y, m from lineitem join g on g.g=(l_linestatus='O')::int)
"""


@query("poisson_regression", COUNT_GROUPS + "select 'const' as term, ln(m0) as coef, sqrt(1/(n0*m0)) as se from p union all select 'open', ln(m1/m0), sqrt(1/(n0*m0)+1/(n1*m1)) from p", "coef:7 se:8")
def _(t):
    return regression.poisson_regression(_status(t), "l_linenumber", "open").tables["coefficients"].select("term", "coef", "se")


@query(
    "poisson_regression_fit",
    COUNT_GROUPS
    + """select 2*sum(y*ln(y/m)-(y-m)) as deviance, sum((y-m)**2/m) as pearson_chi2, 2*sum(y*ln(y/m)-(y-m))/(count(*)-2) as dispersion,
    4-2*sum(y*ln(m)-m-lgamma(y+1)) as aic, count(*) as n from r""",
    "deviance:4 pearson_chi2:4 dispersion:7 aic:4",
)
def _(t):
    return regression.poisson_regression(_status(t), "l_linenumber", "open").statistics.drop("warnings")


@query(
    "negative_binomial",
    COUNT_GROUPS
    + "select 'const' as term, ln(m0) as coef, sqrt((1+m0)/(n0*m0)) as se from p union all select 'open', ln(m1/m0), sqrt((1+m0)/(n0*m0)+(1+m1)/(n1*m1)) from p",
    "coef:7 se:8",
)
def _(t):
    return regression.negative_binomial(_status(t), "l_linenumber", "open").tables["coefficients"].select("term", "coef", "se")


@query(
    "negative_binomial_fit",
    COUNT_GROUPS + "select 2*sum(y*ln(y/m)-(y+1)*ln((1+y)/(1+m))) as deviance, 4-2*sum(y*ln(m/(1+m))-ln(1+m)) as aic, count(*) as n from r",
    "deviance:4 aic:4",
)
def _(t):
    return regression.negative_binomial(_status(t), "l_linenumber", "open").statistics.drop("warnings")


# -- normality -----------------------------------------------------------------------------


# Normal quantile after Acklam: fixed values of a rational approximation with relative error 1e-9.
def quantile(p: str) -> str:
    tail = f"sqrt(-2*ln(least({p}, 1-{p})))"
    far = (
        f"(((((-0.007784894002430293*{tail}-0.3223964580411365)*{tail}-2.400758277161838)*{tail}-2.549732539343734)*{tail}+4.374664141464968)*{tail}+2.938163982698783)"
        f"/((((0.007784695709041462*{tail}+0.3224671290700398)*{tail}+2.445134137003754)*{tail}+3.754408661907416)*{tail}+1)"
    )
    q = f"({p}-0.5)"
    r = f"({q}*{q})"
    near = (
        f"(((((-39.69683028665376*{r}+220.9460984245205)*{r}-275.9285104469687)*{r}+138.3577518672690)*{r}-30.66479806614716)*{r}+2.506628277459239)*{q}"
        f"/(((((-54.47609879822406*{r}+161.5858368580409)*{r}-155.6989798598866)*{r}+66.80131188771972)*{r}-13.28068155288572)*{r}+1)"
    )
    return f"(case when {p} < 0.02425 then {far} when {p} > 0.97575 then -({far}) else {near} end)"


def _poly_sql(coefficients: tuple, x: str) -> str:
    return "(" + "+".join(f"({c})*power({x},{i})" for i, c in enumerate(coefficients)) + ")"


def shapiro_sql(rows: str, by: str) -> str:
    """CTEs ending in sw (by, n, w, p) for rows of (by, y), n above 11."""
    z = f"((ln(1-w)-{_poly_sql(dist._SW_MEAN, 'ln(n)')})/exp({_poly_sql(dist._SW_SD, 'ln(n)')}))"
    return f"""v as (select {by}, y, row_number() over (partition by {by} order by y)::double as i, count(*) over (partition by {by})::double as n from ({rows}) where y is not null),
    m as (select *, {quantile('((i-0.375)/(n+0.25))')} as m from v),
    s as (select {by}, any_value(n) as n, sum(m*y) as my, sum(m*m) as mm, var_samp(y)*(count(*)-1) as squares, max(m) filter (i=n) as m1, max(m) filter (i=n-1) as m2,
      max(y) filter (i=n) - max(y) filter (i=1) as d1, max(y) filter (i=n-1) - max(y) filter (i=2) as d2 from m group by {by}),
    a as (select *, m1/sqrt(mm)+{_poly_sql(dist._SW_LAST, '(1/sqrt(n))')} as a1, m2/sqrt(mm)+{_poly_sql(dist._SW_NEXT, '(1/sqrt(n))')} as a2 from s),
    w as (select {by}, n, power((my-m1*d1-m2*d2)/sqrt((mm-2*m1*m1-2*m2*m2)/(1-2*a1*a1-2*a2*a2))+a1*d1+a2*d2, 2)/squares as w from a),
    z as (select *, {z} as z from w),
    sw as (select {by}, n::bigint as n, w, case when z > 0 then {upper_tail('z')} else 1-{upper_tail('(-z)')} end as p from z)"""


@query("shapiro_wilk", f"with {shapiro_sql('select o_orderstatus, o_totalprice as y from orders', 'o_orderstatus')} select o_orderstatus, 'o_totalprice' as variable, w as W, p as p_value, n from sw", "W:6 p_value:5")
def _(t):
    return normality.shapiro_wilk(t.orders, "o_totalprice", by=["o_orderstatus"]).statistics.drop("warnings")


Z_SQL = f"""with s as (select avg({{c}}) as m, stddev_samp({{c}}) as sd, count(*) as n from {{t}}),
 z as (select ({{c}}-m)/sd as z, n, row_number() over (order by {{c}}) as i from {{t}}, s),
 p as (select z, n, i, case when z<0 then {upper_tail('(-z)')} else 1-{upper_tail('z')} end as lo, case when z<0 then 1-{upper_tail('(-z)')} else {upper_tail('z')} end as hi from z)
"""


@query(
    "anderson_darling",
    Z_SQL.format(c="c_acctbal", t="customer")
    + """, a as (select any_value(n) as n, -any_value(n)-sum((2*i-1)*ln(lo)+(2*(n-i)+1)*ln(hi))/any_value(n) as A2 from p)
    select A2, round(0.787/(1+4.0/n-25.0/(n*n)),3) as critical_5_0, A2 > round(0.787/(1+4.0/n-25.0/(n*n)),3) as reject_at_5pct, n from a""",
    "A2:5 critical_5_0:3",
)
def _(t):
    return normality.anderson_darling(t.customer, "c_acctbal").statistics.select("A2", "critical_5_0", "reject_at_5pct", "n")


@query("kolmogorov_smirnov", Z_SQL.format(c="l_extendedprice", t="lineitem") + "select max(greatest(i::double/n-lo, lo-(i-1.0)/n)) as D, any_value(n) as n from p", "D:8")
def _(t):
    return normality.kolmogorov_smirnov(t.lineitem, "l_extendedprice").statistics.select("D", "n")


# -- resampling -----------------------------------------------------------------------------


# Standard errors in large samples: of the mean, and of the standard deviation (from the fourth moment).
BOOT_ERROR = {
    "mean": lambda y: F.stddev_samp(y) / F.sqrt(F.count(y)),
    "std": lambda y: F.stddev_samp(y) * F.sqrt((F.kurtosis(y) + 2) / (4 * F.count(y))),
}


def _boot(t: Tables, stat: str) -> DataFrame:
    """The interval's ends in standard errors from the estimate, to the nearest 1 (2 expected on either side)."""
    stats = resampling.bootstrap_ci(t.lineitem, "l_quantity", stat, n_boot=1000, by=["l_returnflag"]).statistics
    error = t.lineitem.groupBy("l_returnflag").agg(BOOT_ERROR[stat]("l_quantity").alias("e"))
    ends = [F.round((F.col(c) - F.col("estimate")) / F.col("e")).cast("int").alias(f"{c}_errors") for c in ("ci95_low", "ci95_high")]
    return stats.join(error, "l_returnflag").select("l_returnflag", "estimate", *ends, "n_boot", "n")


@query("bootstrap_median", "select l_returnflag, quantile_cont(l_quantity, 0.5) as estimate, true as within_one, 1000::bigint as n_boot, count(*) as n from lineitem group by 1", "estimate")
def _(t):
    """Quantities are whole numbers, so the interval's ends are the median or a neighbour."""
    stats = resampling.bootstrap_ci(t.lineitem, "l_quantity", "median", n_boot=1000, by=["l_returnflag"]).statistics
    low, high = F.col("estimate") - F.col("ci95_low"), F.col("ci95_high") - F.col("estimate")
    return stats.select("l_returnflag", "estimate", (low.between(0, 1) & high.between(0, 1)).alias("within_one"), "n_boot", "n")


for _stat, _sql in (("mean", "avg(l_quantity)"), ("std", "stddev_samp(l_quantity)")):
    query(
        f"bootstrap_{_stat}",
        f"select l_returnflag, {_sql} as estimate, -2 as ci95_low_errors, 2 as ci95_high_errors, 1000::bigint as n_boot, count(*) as n from lineitem group by 1",
        "estimate",
    )(lambda t, s=_stat: _boot(t, s))


@query(
    "permutation_test",
    """select l_returnflag, avg(l_quantity) filter (l_linestatus='F')-avg(l_quantity) filter (l_linestatus='O') as mean_diff, true as near,
    count(*) filter (l_linestatus='F') as n_1, count(*) filter (l_linestatus='O') as n_2 from lineitem group by 1""",
    "mean_diff:7",
)
def _(t):
    stats = resampling.permutation_test(t.lineitem, "l_quantity", "l_linestatus", n_perm=1000, by=["l_returnflag"]).statistics
    # In large samples the permutation distribution is normal with the pooled variance; 1,000 draws give p within 0.06.
    spread = t.lineitem.groupBy("l_returnflag").agg(F.var_samp("l_quantity").alias("v"))
    z = F.col("mean_diff") / F.sqrt(F.col("v") * (1 / F.col("n_1") + 1 / F.col("n_2")))
    near = F.abs(F.col("p_value") - norm_p(z)) < 0.06
    return stats.join(spread, "l_returnflag").select("l_returnflag", "mean_diff", near.alias("near"), "n_1", "n_2")


# -- time series -----------------------------------------------------------------------------


def _daily(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("value"))


DAILY = "d as (select event_type, ts::date as day, sum(value) as value from events group by 1, 2), p as (select *, row_number() over (partition by event_type order by day)-1 as pos from d)"


@query(
    "moving_average",
    f"""with {DAILY} select event_type, pos as position, value, case when count(*) over w >= 3 then avg(value) over w end as ma_7 from p
    window w as (partition by event_type order by pos rows between 6 preceding and current row)""",
    "value:4 ma_7:5",
)
def _(t):
    return timeseries.moving_average(_daily(t), "value", "day", by=["event_type"]).tables["series"].drop("time")


@query(
    "trend_analysis",
    f"""with {DAILY} select event_type, regr_slope(value,pos) as slope, regr_intercept(value,pos) as intercept, corr(value,pos) as r,
    sqrt((1-corr(value,pos)**2)*regr_syy(value,pos)/regr_sxx(value,pos)/(count(*)-2)) as se, count(*) as n from p group by 1""",
    "slope:5 intercept:4 r:8 se:5",
)
def _(t):
    return timeseries.trend_analysis(_daily(t), "value", "day", by=["event_type"]).statistics.select("event_type", "slope", "intercept", "r", "se", "n")


@query(
    "acf_pacf",
    f"""with {DAILY}, m as (select event_type, avg(value) as m, count(*) as n from p group by 1),
    x as (select p.event_type, pos, value-m as d, n from p join m on p.event_type=m.event_type), k as (select unnest(range(0,25)) as lag),
    c as (select a.event_type, k.lag, sum(a.d*b.d) as c, any_value(a.n) as n from x a cross join k join x b on a.event_type=b.event_type and b.pos=a.pos-k.lag group by 1,2)
    select c.event_type, c.lag::int as lag, c.c/z.c as acf from c join c z on c.event_type=z.event_type and z.lag=0 where c.lag <= least(24, greatest(5, c.n//4), c.n-1)""",
    "acf:8",
)
def _(t):
    return timeseries.acf_pacf(_daily(t), "value", "day", by=["event_type"]).tables["lags"].select("event_type", "lag", "acf")


@query(
    "seasonality",
    f"""with {DAILY}, n as (select event_type, count(*) as n from p group by 1)
    select p.event_type, (pos%7+1)::int as season, avg(value) as mean from p join n on p.event_type=n.event_type where pos < (n//7)*7 group by 1,2""",
    "mean:5",
)
def _(t):
    return timeseries.seasonality(_daily(t), "value", "day", 7, by=["event_type"]).tables["profile"]


def _monthly(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", F.trunc(F.to_date("l_shipdate"), "month").alias("month")).agg(F.sum("l_quantity").alias("quantity"))


MONTHLY = """d as (select l_returnflag, date_trunc('month', l_shipdate) as m, sum(l_quantity) as y from lineitem group by 1,2),
 w as (select l_returnflag, m, y, y-lag(y) over w1 as w from d window w1 as (partition by l_returnflag order by m)),
 l as (select *, lag(w) over (partition by l_returnflag order by m) as w1 from w)"""


@query(
    "arima_autoregressive",
    f"""with {MONTHLY}, f as (select l_returnflag, sum(w*w1)/sum(w1*w1) as phi, count(w1) as n from l where w1 is not null group by 1),
    s as (select l.l_returnflag, sum((w-phi*w1)**2)/any_value(f.n) as s2 from l join f on l.l_returnflag=f.l_returnflag where w1 is not null group by 1),
    e as (select l_returnflag, max_by(y,m) as y, max_by(w,m) as w from l group by 1)
    select f.l_returnflag, phi, s2/1e3 as sigma2, e.y+phi*e.w as next from f join s on f.l_returnflag=s.l_returnflag join e on f.l_returnflag=e.l_returnflag""",
    "phi:8 sigma2:4 next:4",
)
def _(t):
    fit = timeseries.arima(_monthly(t), "quantity", "month", (1, 1, 0), by=["l_returnflag"], fit="regression")
    params = fit.tables["params"].groupBy("l_returnflag").agg(F.max(F.when(F.col("term") == "ar.L1", F.col("coef"))).alias("phi"), (F.max(F.when(F.col("term") == "sigma2", F.col("coef"))) / 1e3).alias("sigma2"))
    return params.join(fit.tables["forecast"].where("step = 1").select("l_returnflag", F.col("forecast").alias("next")), "l_returnflag")


# The exact likelihood of an autoregression of the differences, highest on a grid and then on a finer one.
LIKELIEST = """with d as (select l_returnflag, date_trunc('month', l_shipdate) as m, sum(l_quantity)::double as y from lineitem group by 1, 2),
 w as (select l_returnflag, m, y - lag(y) over g as w from d window g as (partition by l_returnflag order by m)),
 p as (select l_returnflag, w, lag(w) over (partition by l_returnflag order by m) as v, row_number() over (partition by l_returnflag order by m) as i from w where w is not null),
 s as (select l_returnflag, count(*) as n, sum(w * w) as ww, sum(w * v) as wv, sum(v * v) as vv, max(case when i = 1 then w * w end) as w1 from p group by 1),
 f as (select l_returnflag, n, ww, wv, vv, w1, unnest(range(-9999, 10000)) / 10000.0 as phi from s),
 g as (select *, -n / 2.0 * (ln(2 * pi() * (ww - 2 * phi * wv + phi * phi * vv - phi * phi * w1) / n) + 1) + ln(1 - phi * phi) / 2 as llf from f),
 c as (select l_returnflag, any_value(n) as n, any_value(ww) as ww, any_value(wv) as wv, any_value(vv) as vv, any_value(w1) as w1, arg_max(phi, llf) as top from g group by 1),
 h as (select *, top + unnest(range(-2000, 2001)) / 10000000.0 as phi from c),
 k as (select *, -n / 2.0 * (ln(2 * pi() * (ww - 2 * phi * wv + phi * phi * vv - phi * phi * w1) / n) + 1) + ln(1 - phi * phi) / 2 as llf from h)
 select l_returnflag, arg_max(phi, llf) as phi, 4 - 2 * max(llf) as aic from k group by 1"""


@query("arima_likelihood", LIKELIEST, "phi:3 aic:3")
def _(t):
    fit = timeseries.arima(_monthly(t), "quantity", "month", (1, 1, 0), by=["l_returnflag"])
    phi = fit.tables["params"].where("term = 'ar.L1'").select("l_returnflag", F.col("coef").alias("phi"))
    return phi.join(fit.statistics.select("l_returnflag", "aic"), "l_returnflag")


@query("arima")
def _(t):
    return timeseries.arima(_monthly(t), "quantity", "month", by=["l_returnflag"]).tables["forecast"]


@query("sarima")
def _(t):
    return timeseries.sarima(_monthly(t), "quantity", "month", by=["l_returnflag"]).tables["forecast"]


@query("exp_smoothing")
def _(t):
    return timeseries.exp_smoothing(_monthly(t), "quantity", "month", seasonal="add", seasonal_periods=12, by=["l_returnflag"]).tables["forecast"]


@query("exp_smoothing_multiplicative")
def _(t):
    return timeseries.exp_smoothing(_monthly(t), "quantity", "month", trend="mul", seasonal="mul", seasonal_periods=12, by=["l_returnflag"]).tables["forecast"]


# -- multivariate ----------------------------------------------------------------------------


@query(
    "pca",
    """with r as (select abs(corr(l_quantity, l_extendedprice)) as r, count(*) as n from lineitem)
    select 'PC1' as component, (1+r)*n/(n-1) as eigenvalue, 50*(1+r) as var_pct, 50*(1+r) as cum_pct from r
    union all select 'PC2', (1-r)*n/(n-1), 50*(1-r), 100 from r""",
    "eigenvalue:8 var_pct cum_pct",
)
def _(t):
    return multivariate.pca(t.lineitem, ["l_quantity", "l_extendedprice"]).tables["variance"]


@query("pca_embeddings")
def _(t):
    return multivariate.pca(_items(t, 64), ITEMS).tables["variance"]


@query("factor_analysis")
def _(t):
    return multivariate.factor_analysis(_items(t, 64), ITEMS, 3).tables["noise"]


@query("kmeans")
def _(t):
    return multivariate.kmeans(t.lineitem, ["l_quantity", "l_extendedprice"], 3).tables["sizes"]


@query(
    "manova",
    """with r as (select l_returnflag as g, l_quantity as a, l_extendedprice/1000 as b from lineitem),
    e as (select sum(aa) as aa, sum(ab) as ab, sum(bb) as bb from (select var_pop(a)*count(*) as aa, covar_pop(a,b)*count(*) as ab, var_pop(b)*count(*) as bb from r group by g)),
    t as (select var_pop(a)*count(*) as aa, covar_pop(a,b)*count(*) as ab, var_pop(b)*count(*) as bb from r),
    m as (select (e.bb*(t.aa-e.aa)-e.ab*(t.ab-e.ab))/(e.aa*e.bb-e.ab**2) as m11, (e.bb*(t.ab-e.ab)-e.ab*(t.bb-e.bb))/(e.aa*e.bb-e.ab**2) as m12,
      (-e.ab*(t.aa-e.aa)+e.aa*(t.ab-e.ab))/(e.aa*e.bb-e.ab**2) as m21, (-e.ab*(t.ab-e.ab)+e.aa*(t.bb-e.bb))/(e.aa*e.bb-e.ab**2) as m22 from e, t),
    l as (select (m11+m22)/2+sqrt(((m11-m22)/2)**2+m12*m21) as l1, (m11+m22)/2-sqrt(((m11-m22)/2)**2+m12*m21) as l2 from m)
    select 'Wilks'' lambda' as statistic, 1/((1+l1)*(1+l2)) as value from l union all select 'Pillai''s trace', l1/(1+l1)+l2/(1+l2) from l
    union all select 'Hotelling-Lawley trace', l1+l2 from l union all select 'Roy''s greatest root', l1 from l""",
    "value:9",
)
def _(t):
    rows = t.lineitem.withColumn("price", F.col("l_extendedprice") / 1000)
    return multivariate.manova(rows, ["l_quantity", "price"], "l_returnflag").tables["mv_test"].select("statistic", "value")


@query(
    "lda",
    """with g as (select l_linestatus as g, count(*) as n, avg(l_extendedprice) as m, var_pop(l_extendedprice)*count(*) as ss from lineitem group by 1),
    v as (select sum(ss)/(sum(n)-count(*)) as v, sum(n) as n from g),
    p as (select l.l_linestatus as y, max_by(g.g, l.l_extendedprice*g.m/v.v-g.m*g.m/(2*v.v)+ln(g.n/v.n)) as pred from (select row_number() over () as i, * from lineitem) l, g, v group by l.i, l.l_linestatus)
    select count(*) as n, avg((y=pred)::int) as accuracy_in_sample, 2::bigint as n_classes from p""",
    "accuracy_in_sample:8",
)
def _(t):
    return multivariate.lda(t.lineitem, "l_linestatus", ["l_extendedprice"]).statistics.drop("warnings")


@query("lda_classes", "select label::varchar as class, count(*) as n, count(*)::double/(select count(*) from embeddings) as prior from embeddings group by 1", "prior:8")
def _(t):
    return multivariate.lda(_items(t, 64), "label", ITEMS).tables["classes"]


# -- survival ------------------------------------------------------------------------------


def _lifetimes(t: Tables) -> DataFrame:
    """Per user: hours from the first event to the first purchase, censored at the last event."""
    users = t.events.groupBy("user_id").agg(
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
        F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("bought"),
        F.min_by("event_type", "ts").alias("start"),
        F.avg("value").alias("spend"),
    )
    end = F.coalesce("bought", "last").cast("timestamp")
    seconds = (F.unix_micros(end) - F.unix_micros(F.col("first").cast("timestamp"))) / 3_600_000_000.0
    return users.select("user_id", F.round(seconds, 1).alias("hours"), F.col("bought").isNotNull().cast("int").alias("event"), "start", F.col("start").isin("click", "view").cast("string").alias("browsing"), "spend")


LIFETIMES = """u as (select user_id, min(ts) as f, max(ts) as l, min(ts) filter (event_type='purchase') as b, min_by(event_type, ts) as start from events group by 1),
 s as (select user_id, round((epoch_us(coalesce(b,l))-epoch_us(f))/3600000000.0, 1) as hours, (b is not null)::int as event, start, (start in ('click','view'))::varchar as browsing from u)"""

KM_SQL = f"""with {LIFETIMES},
 c as (select start as g, hours as t, count(*) as n, sum(event) as d from s group by 1,2),
 r as (select g, t, d, sum(n) over (partition by g order by t desc rows unbounded preceding) as risk from c),
 k as (select g, t, risk, d, case when sum((d=risk)::int) over w > 0 then 0 else exp(sum(case when d<risk then ln(1-d::double/risk) else 0 end) over w) end as survival
   from r window w as (partition by g order by t rows unbounded preceding))"""


@query(
    "kaplan_meier",
    KM_SQL
    + """ select g as "group", t as time, risk::bigint as at_risk, d::double as events, survival from k
    union all select start, 0, count(*), 0, 1 from s group by start having min(hours) > 0""",
    "time:1 events survival:9",
)
def _(t):
    return survival.kaplan_meier(_lifetimes(t), "hours", "event", "start").tables["curve"]


@query(
    "kaplan_meier_medians",
    KM_SQL
    + """, m as (select g, min(t) filter (survival <= 0.5 + 1e-12) as median_survival from k group by 1)
    select start as "group", count(*) as n, sum(event)::bigint as events, any_value(median_survival) as median_survival from s join m on m.g=s.start group by 1""",
    "median_survival:1",
)
def _(t):
    return survival.kaplan_meier(_lifetimes(t), "hours", "event", "start").tables["medians"]


@query(
    "logrank",
    f"""with {LIFETIMES}, c as (select hours as t, count(*) as n, count(*) filter (browsing='true') as n1, sum(event) as d, coalesce(sum(event) filter (browsing='true'),0) as d1 from s group by 1),
    r as (select t, d, d1, sum(n) over w as n, sum(n1) over w as n1 from c window w as (order by t desc rows unbounded preceding))
    select chi2, 2*"""
    + upper_tail("sqrt(chi2)")
    + """ as p_value, 1::bigint as df, n from (select sum(d1-d*n1::double/n)**2/sum(case when n>1 then d*(n1::double/n)*(1-n1::double/n)*(n-d)/(n-1) else 0 end) as chi2, (select count(*) from s) as n from r)""",
    "chi2:5 p_value:7",
)
def _(t):
    return survival.logrank(_lifetimes(t), "hours", "event", "browsing").statistics.select("chi2", "p_value", "df", "n")


@query("logrank_many_groups")
def _(t):
    return survival.logrank(_lifetimes(t), "hours", "event", "start").statistics.drop("warnings")


@query("cox_ph")
def _(t):
    return survival.cox_ph(_lifetimes(t).withColumn("browse", (F.col("browsing") == "true").cast("int")), "hours", "event", ["spend", "browse"]).tables["coefficients"]


@query(
    "concordance",
    f"""with {LIFETIMES}, a as (select user_id, avg(value) as spend from events group by 1), x as (select hours, event, spend from s join a on a.user_id=s.user_id),
    p as (select i.spend as si, j.spend as sj from x i join x j on i.event=1 and (i.hours < j.hours or (i.hours = j.hours and j.event=0)))
    select sum(case when si>sj then 1.0 when si=sj then 0.5 else 0 end)/count(*) as concordance from p""",
    "concordance:8",
)
def _(t):
    scored = _lifetimes(t).select(F.col("hours").alias("_t"), F.col("event").cast("double").alias("_e"), F.col("spend").alias("_eta"))
    return survival.concordance(scored, [], [])


# -- roles, profiles, quality -------------------------------------------------------------


def _names(spark: SparkSession, pairs: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(pairs.items()), "name string, role string")


def _roles_sql(table: str, rules: dict[str, str]) -> str:
    """Roles restated as SQL over the column's type and distinct count."""
    parts = []
    for c, kind in rules.items():
        if kind == "number":
            role = f"case when count(distinct {c}) <= 2 and bool_and({c} in (0, 1)) then 'boolean' else 'numeric' end"
        elif kind == "time":
            role = f"case when count({c}) > 0 then 'datetime' end"
        else:
            role = f"case when count(distinct {c}) <= 50 and count(distinct {c})::double/count({c}) < 0.08 then 'categorical' when count(distinct {c}) <= 20 then 'categorical' else 'text' end"
        parts.append(f"select '{c}' as name, {role} as role from {table}")
    return " union all ".join(parts)


@query("column_roles", _roles_sql("orders", {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "text", "o_totalprice": "number", "o_orderdate": "time", "o_orderpriority": "text"}))
def _(t):
    return _names(t.spark, profile.column_roles(t.orders))


@query("column_roles_labels", _roles_sql("labels", {"doc_id": "number", "quality": "number", "toxic": "number"}))
def _(t):
    return _names(t.spark, profile.column_roles(t.labels))


def _profile_sql(c: str) -> str:
    return f"""select '{c}' as name, count(*) as n, count(*)-count({c}) as n_missing, count(distinct {c}) as n_unique, round(100.0*count(distinct {c})/count({c}), 2) as unique_pct,
    count(distinct {c})<=1 as is_constant, avg({c}) as mean, quantile_cont({c},0.5) as median, stddev_samp({c}) as std, min({c})::double as min, max({c})::double as max,
    quantile_cont({c},0.25) as q1, quantile_cont({c},0.75) as q3, skewness({c}) as skewness, kurtosis({c}) as kurtosis, count(*) filter ({c}=0) as zeros, count(*) filter ({c}<0) as negatives,
    quantile_cont({c},0.01) as p01, quantile_cont({c},0.99) as p99 from customer"""


PROFILED = ["c_custkey", "c_nationkey", "c_acctbal"]


@query("profile_columns", " union all ".join(_profile_sql(c) for c in PROFILED), "unique_pct:2 mean median std min max q1 q3 skewness kurtosis p01 p99")
def _(t):
    table = profile.profile_columns(t.customer, PROFILED)
    return table.select("name", "n", "n_missing", "n_unique", "unique_pct", "is_constant", "mean", "median", "std", "min", "max", "q1", "q3", "skewness", "kurtosis", "zeros", "negatives", "p01", "p99")


@query(
    "profile_text_columns",
    " union all ".join(
        f"select '{c}' as name, count(*) as n, count(distinct {c}) as n_unique, (count(*)>20 and count(distinct {c})=count(*)) as is_id_like, (select max(k) from (select count(*) as k from documents group by {c})) as top_count from documents"
        for c in ("text", "lang", "source")
    ),
)
def _(t):
    table = profile.profile_columns(t.documents, ["text", "lang", "source"])
    return table.select("name", "n", "n_unique", "is_id_like", F.col("top_values")[0]["count"].alias("top_count"))


@query("top_values", "select 'event_type' as variable, row_number() over (order by count(*) desc, event_type)::int as rank, event_type as value, count(*) as count from events group by 3")
def _(t):
    return profile.top_values(t.events, ["event_type"])


@query(
    "profile_dataset",
    """select (select count(*) from events) as n_rows, 6 as n_cols, 0::bigint as missing_cells, (select count(*) from events)-(select count(*) from (select distinct * from events)) as duplicate_rows,
    3 as n_numeric, 1 as n_categorical, 1 as n_datetime, 0 as n_boolean, 1 as n_text, 100.0 as quality_score""",
    "quality_score:1",
)
def _(t):
    table = profile.dataset_summary(t.events)
    return table.select("n_rows", "n_cols", "missing_cells", "duplicate_rows", "n_numeric", "n_categorical", "n_datetime", "n_boolean", "n_text", "quality_score")


@query("duplicate_rows", "select lang, source, n_chars, md5(text) as digest, count(*) as count from documents group by 1,2,3,4,text having count(*) > 1")
def _(t):
    found = profile.duplicate_rows(t.documents.drop("doc_id"))
    return found.select("lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("digest"), "count")


def _dirty(t: Tables) -> DataFrame:
    """Orders with planted gaps, sign errors, spaced and lower-case labels, a constant and a repeated column."""
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    price = F.when(priority == "5-LOW", None).when((priority == "1-URGENT") & (status == "P"), -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    label = F.when(priority == "2-HIGH", F.lower(status)).when(priority == "3-MEDIUM", F.concat(status, F.lit(" "))).otherwise(status)
    return t.orders.select(
        F.col("o_orderkey").alias("order_id"), price.alias("price"), label.alias("status"), F.col("o_orderdate").alias("placed"), F.lit("web").alias("channel"),
        F.col("o_custkey").alias("customer"), F.col("o_custkey").alias("customer_copy"),
    )


DIRTY = """dirty as (select o_orderkey as order_id, case when o_orderpriority='5-LOW' then null when o_orderpriority='1-URGENT' and o_orderstatus='P' then -o_totalprice else o_totalprice end as price,
 case when o_orderpriority='2-HIGH' then lower(o_orderstatus) when o_orderpriority='3-MEDIUM' then o_orderstatus || ' ' else o_orderstatus end as status, o_orderdate as placed, 'web' as channel,
 o_custkey as customer, o_custkey as customer_copy from orders)"""

QUALITY_SQL = f"""with {DIRTY}, b as (select quantile_cont(price,0.25) as q1, quantile_cont(price,0.75) as q3, count(price) as filled, count(*) as n from dirty),
 x as (select sum((price < q1-1.5*(q3-q1) or price > q3+1.5*(q3-q1))::int) as n_out, sum((price < q1-3*(q3-q1) or price > q3+3*(q3-q1))::int) as n_far, any_value(filled) as filled from dirty, b),
 lab as (select distinct status as s from dirty),
 i as (
 select 'missing_values' as kind, 'price' as location, case when 100.0*(n-filled)/n >= 30 then 'high' when 100.0*(n-filled)/n >= 5 then 'medium' else 'low' end as severity, n-filled as n from b
 union all select 'duplicate_columns', 'customer / customer_copy', 'medium', null
 union all select 'constant_variable', 'channel', 'medium', 1
 union all select 'outliers', 'price', case when n_out::double/filled < 0.05 then 'low' else 'medium' end, n_out from x where n_out > 0
 union all select 'extreme_values', 'price', 'medium', n_far from x where n_far > 0
 union all select 'impossible_values', 'price', 'high', (select count(*) from dirty where price < 0)
 union all select 'inconsistent_categories', 'status', 'low', (select count(*) from dirty where trim(status) <> status)
 union all select 'inconsistent_categories', 'status', 'medium', null
 union all select 'potential_data_entry_errors', 'status', 'low', (select count(*) from lab a, lab b where a.s < b.s and lower(trim(a.s)) <> lower(trim(b.s))))
"""


def _issues(t: Tables) -> DataFrame:
    from datetime import datetime

    return quality.assess_quality(_dirty(t), datetime(2025, 1, 1))


@query("quality_issues", QUALITY_SQL + "select kind, location, severity, n::bigint as n from i")
def _(t):
    return _issues(t).select("kind", "location", "severity", "n")


@query(
    "near_labels",
    """with l as (select distinct 'c_name' as variable, lower(trim(c_name)) as s from customer union select distinct 's_name', lower(trim(s_name)) from supplier
      union select distinct 'p_type', lower(trim(p_type)) from part),
     p as (select a.variable, a.s as a, b.s as b, abs(len(a.s) - len(b.s)) as gap from l a join l b on a.variable = b.variable and a.s < b.s and abs(len(a.s) - len(b.s)) <= 2)
     select variable, count(*) as pairs from p where case when contains(a, b) or contains(b, a) then gap = 1 else gap + case when gap = 0 then hamming(a, b)
      else list_sum(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: (a[i] <> b[i])::int)) end <= 2 end group by variable""",
)
def _(t):
    names = t.customer.select("c_name", F.lit(None).cast("string").alias("s_name"), F.lit(None).cast("string").alias("p_type"))
    names = names.union(t.supplier.select(F.lit(None), "s_name", F.lit(None))).union(t.part.select(F.lit(None), F.lit(None), "p_type"))
    return quality.near_labels(names, ["c_name", "s_name", "p_type"])[0]


@query(
    "quality_summary",
    QUALITY_SQL
    + """select greatest(0.0, 100-sum(case severity when 'low' then 1 when 'medium' then 3 else 6 end)) as score, count(*) filter (severity='high') as high,
    count(*) filter (severity='medium') as medium, count(*) filter (severity='low') as low, count(*) as total from i""",
    "score:1",
)
def _(t):
    return quality.quality_summary(_issues(t))


@query(
    "propose_cleaning",
    """select * from (values ('impute','missing_values:price'),('drop_columns','duplicate_columns:customer / customer_copy'),('drop_columns','constant_variable:channel'),
    ('winsorize','outliers:price'),('clip_nonnegative','impossible_values:price'),('strip','inconsistent_categories:status'),('normalize_case','inconsistent_categories:status')) v(operation, from_issue)
    where operation <> 'winsorize' or (select n_out from (""" + QUALITY_SQL + "select n_out from x)) > 0",
)
def _(t):
    return quality.propose_cleaning(_issues(t)).select("operation", "from_issue")


@query("outlier_listing", QUALITY_SQL + "select kind, location, severity, n::bigint as n from i where kind in ('outliers','extreme_values')")
def _(t):
    return quality.outlier_listing(_issues(t)).select("kind", "location", "severity", "n")


# -- cleaning ---------------------------------------------------------------------------


def _clean(df: DataFrame, **op) -> DataFrame:
    return cleaning.apply_operation(df, op)[0]


@query("drop_duplicates", "select distinct text, lang, source, n_chars from documents")
def _(t):
    return _clean(t.documents.drop("doc_id"), operation="drop_duplicates")


@query("drop_columns", f"with {DIRTY} select order_id, price, status, customer from dirty", "price:2")
def _(t):
    return _clean(_dirty(t), operation="drop_columns", columns=["channel", "customer_copy", "placed", "unknown"])


@query("drop_rows_missing", f"with {DIRTY} select order_id, price from dirty where price is not null", "price:2")
def _(t):
    return _clean(_dirty(t), operation="drop_rows_missing", columns=["price"]).select("order_id", "price")


FILLERS = {"mean": "(select avg(price) from dirty)", "median": "(select quantile_cont(price, 0.5) from dirty)", "mode": "(select price from dirty where price is not null group by 1 order by count(*) desc, 1 limit 1)", "constant": "-1"}
for _method, _filler in FILLERS.items():
    query(f"impute_{_method}", f"with {DIRTY} select order_id, coalesce(price, {_filler}) as price from dirty", "price:4")(
        lambda t, m=_method: _clean(_dirty(t), operation="impute", column="price", method=m, value=-1.0).select("order_id", "price")
    )


def _gappy_events(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))


GAPPY = "ev as (select event_id, user_id, ts, case when event_type <> 'error' then value end as value from events)"


def _filled_events(t: Tables, method: str) -> DataFrame:
    return _clean(_gappy_events(t), operation="impute", column="value", method=method, order_by=["ts", "event_id"], by=["user_id"]).select("event_id", "value")


@query("impute_ffill", f"with {GAPPY} select event_id, last_value(value ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as value from ev", "value:4")
def _(t):
    return _filled_events(t, "ffill")


@query("impute_bfill", f"with {GAPPY} select event_id, first_value(value ignore nulls) over (partition by user_id order by ts, event_id rows between current row and unbounded following) as value from ev", "value:4")
def _(t):
    return _filled_events(t, "bfill")


@query("impute_ffill_whole_table", f"with {GAPPY} select event_id, last_value(value ignore nulls) over (order by event_id rows unbounded preceding) as value from ev", "value:4")
def _(t):
    return _clean(_gappy_events(t), operation="impute", column="value", method="ffill", order_by="event_id").select("event_id", "value")


@query(
    "impute_interpolate",
    f"""with {GAPPY}, p as (select *, row_number() over (partition by user_id order by ts, event_id) as i from ev),
    k as (select event_id, value, i, last_value(value ignore nulls) over a as pv, last_value(case when value is not null then i end ignore nulls) over a as pi,
      first_value(value ignore nulls) over b as nv, first_value(case when value is not null then i end ignore nulls) over b as ni from p
      window a as (partition by user_id order by i rows unbounded preceding), b as (partition by user_id order by i rows between current row and unbounded following))
    select event_id, coalesce(value, case when pv is null then null when nv is null then pv else pv+(nv-pv)*(i-pi)/(ni-pi) end) as value from k""",
    "value:4",
)
def _(t):
    return _filled_events(t, "interpolate")


def _gappy_customers(t: Tables) -> DataFrame:
    gap = (F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") < 5)
    return t.customer.select(F.col("c_custkey").alias("_row_id"), "c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"), F.when(~gap, F.col("c_acctbal")).alias("balance"))


@query(
    "impute_knn",
    """with c as (select c_custkey as id, c_nationkey as nk, case when not (c_mktsegment='BUILDING' and c_nationkey<5) then c_acctbal end as b from customer),
    d as (select q.id, o.b, row_number() over (partition by q.id order by (q.id-o.id)**2+(q.nk-o.nk)**2, o.id) as r from c q, c o where q.b is null and o.b is not null),
    g as (select id, avg(b) as b from d where r <= 5 group by 1)
    select c.id as c_custkey, coalesce(c.b, g.b) as balance from c left join g on c.id=g.id""",
    "balance:5",
)
def _(t):
    return _clean(_gappy_customers(t), operation="impute", column="balance", method="knn").select("c_custkey", "balance")


@query(
    "impute_iterative",
    f"with {DIRTY}, f as (select regr_slope(price, customer) as s, regr_intercept(price, customer) as i from dirty) select order_id, coalesce(price, i+s*customer) as price from dirty, f",
    "price:3",
)
def _(t):
    return _clean(_dirty(t).select(F.col("order_id").cast("string").alias("order_id"), "price", "customer"), operation="impute", column="price", method="iterative").select(
        F.col("order_id").cast("long").alias("order_id"), "price"
    )


@query("impute_all", f"with {DIRTY} select order_id, coalesce(price, {FILLERS['median']}) as price, status from dirty", "price:4")
def _(t):
    return _clean(_dirty(t).select("order_id", "price", "status"), operation="impute_all")


@query("to_numeric", "select event_id, (props->>'$.k')::double as k from events", "k:3")
def _(t):
    return _clean(t.events.select("event_id", F.get_json_object("props", "$.k").alias("k")), operation="to_numeric", column="k")


@query("parse_dates", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def _(t):
    text = t.orders.select("o_orderkey", F.date_format("o_orderdate", "M/d/yyyy").alias("day"))
    return _clean(text, operation="parse_dates", column="day").select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("strip", f"with {DIRTY} select order_id, trim(status) as status from dirty")
def _(t):
    return _clean(_dirty(t), operation="strip", column="status").select("order_id", "status")


@query("normalize_case", f"with {DIRTY} select order_id, upper(trim(status)) as status from dirty")
def _(t):
    return _clean(_dirty(t), operation="normalize_case", column="status").select("order_id", "status")


@query("normalize_case_words", "select p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as p_name, lower(p_type) as p_type from part")
def _(t):
    out = _clean(t.part, operation="normalize_case", column="p_name")
    return _clean(out, operation="normalize_case", column="p_type", case="lower").select("p_partkey", "p_name", "p_type")


@query(
    "winsorize",
    "with q as (select quantile_cont(l_extendedprice,0.05) as a, quantile_cont(l_extendedprice,0.95) as b from lineitem) select l_orderkey, l_linenumber, l_partkey, least(greatest(l_extendedprice,a),b) as l_extendedprice from lineitem, q",
    "l_extendedprice:4",
)
def _(t):
    return _clean(t.lineitem, operation="winsorize", column="l_extendedprice", limits=0.05).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("clip_nonnegative", "select c_custkey, case when c_acctbal >= 0 then c_acctbal end as c_acctbal from customer", "c_acctbal:2")
def _(t):
    return _clean(t.customer, operation="clip_nonnegative", column="c_acctbal").select("c_custkey", "c_acctbal")


TRANSFORMS = {
    "log": ("c_acctbal_log", "case when c_acctbal > 0 then ln(c_acctbal) end"),
    "log1p": ("c_acctbal_log1p", "ln(1+greatest(c_acctbal, 0))"),
    "sqrt": ("c_acctbal_sqrt", "sqrt(greatest(c_acctbal, 0))"),
    "zscore": ("c_acctbal_z", "(c_acctbal-(select avg(c_acctbal) from customer))/(select stddev_samp(c_acctbal) from customer)"),
    "minmax": ("c_acctbal_minmax", "(c_acctbal-(select min(c_acctbal) from customer))/((select max(c_acctbal) from customer)-(select min(c_acctbal) from customer))"),
}
for _method, (_out, _sql) in TRANSFORMS.items():
    query(f"transform_{_method}", f"select c_custkey, {_sql} as {_out} from customer", f"{_out}:8")(
        lambda t, m=_method, o=_out: _clean(t.customer, operation="transform", column="c_acctbal", method=m).select("c_custkey", o)
    )


@query("encode_onehot", "select l_orderkey, l_partkey, l_linenumber, l_returnflag='A' as l_returnflag_A, l_returnflag='N' as l_returnflag_N, l_returnflag='R' as l_returnflag_R from lineitem")
def _(t):
    return _clean(t.lineitem, operation="encode", column="l_returnflag").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag_A", "l_returnflag_N", "l_returnflag_R")


@query(
    "encode_label",
    "with f as (select o_orderpriority as p, row_number() over (order by min(o_orderkey))-1 as code from orders group by 1) select o_orderkey, f.code as o_orderpriority_code from orders join f on p=o_orderpriority",
)
def _(t):
    return _clean(t.orders, operation="encode", column="o_orderpriority", method="label", order_by="o_orderkey").select("o_orderkey", "o_orderpriority_code")


@query("rename", "select o_orderkey as order_id, o_orderstatus from orders")
def _(t):
    return _clean(t.orders, operation="rename", column="o_orderkey", new_name="order_id").select("order_id", "o_orderstatus")


@query("filter_expr", "select o_orderkey, o_totalprice from orders where o_totalprice > 100000 and o_orderstatus = 'F'", "o_totalprice:2")
def _(t):
    return _clean(t.orders, operation="filter", query="o_totalprice > 100000 and o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("filter_rows", f"with {DIRTY} select order_id, price, status from dirty where trim(status) <> status and price > 1000 and price < 300000 and status ilike '%f%'", "price:2")
def _(t):
    rules = [{"column": "price", "op": "gt", "value": 1000}]
    rules += [{"column": "price", "op": "lt", "value": "300000"}, {"column": "status", "op": "contains", "value": r"f\s"}, {"column": "unknown", "op": "eq", "value": 1}]
    return explore.filter_rows(_dirty(t), rules).select("order_id", "price", "status")


@query("filter_rows_text", f"with {DIRTY} select order_id, price, status from dirty where status in ('F', 'o') and customer <> 1 and (price is null or price <> 1)", "price:2")
def _(t):
    rules = [{"column": "status", "op": "in", "value": "F, o"}, {"column": "customer", "op": "neq", "value": 1}, {"column": "price", "op": "neq", "value": "1.0"}]
    return explore.filter_rows(_dirty(t), rules).select("order_id", "price", "status")


@query("filter_rows_equal", "select o_orderkey, o_orderstatus from orders where o_orderstatus = 'P'")
def _(t):
    return explore.filter_rows(t.orders, [{"column": "o_orderstatus", "op": "eq", "value": "P"}]).select("o_orderkey", "o_orderstatus")


@query("apply_operations", f"with {DIRTY} select order_id, coalesce(case when price >= 0 then price end, 0) as price, upper(trim(status)) as status from dirty", "price:2")
def _(t):
    ops = [
        {"operation": "clip_nonnegative", "column": "price"},
        {"operation": "impute", "column": "price", "method": "constant", "value": 0.0},
        {"operation": "normalize_case", "column": "status"},
    ]
    return cleaning.apply_operations(_dirty(t), ops)[0].select("order_id", "price", "status")


# -- exploration and charts ------------------------------------------------------------------


@query("explore_frequencies", "with c as (select c_mktsegment as level, count(*) as count from customer group by 1) select 'c_mktsegment' as variable, level, count, round(100.0*count/sum(count) over (), 2) as percent from c", "percent:2")
def _(t):
    return explore.explore(t.customer)["frequencies"]


@query("numeric_snapshot", " union all ".join(f"select '{c}' as name, avg({c}) as mean, quantile_cont({c},0.5) as median, stddev_samp({c}) as sd, count(*)-count({c}) as missing from customer" for c in PROFILED), "mean median sd")
def _(t):
    return explore.numeric_snapshot(t.customer)


@query(
    "histogram_bins",
    """with b as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem),
    h as (select l_returnflag as "group", least(greatest(floor((l_extendedprice-lo)/((hi-lo)/30)),0),29)::int as bin, count(*) as count from lineitem, b group by 1,2)
    select "group", bin, lo+bin*((hi-lo)/30) as low, lo+(bin+1)*((hi-lo)/30) as high, count from h, b""",
    "low:4 high:4",
)
def _(t):
    return charts.histogram_bins(t.lineitem, "l_extendedprice", 30, "l_returnflag")


BOX = """with q as (select o_orderstatus as g, quantile_cont(o_totalprice,0.25) as q1, quantile_cont(o_totalprice,0.5) as median, quantile_cont(o_totalprice,0.75) as q3 from orders group by 1)"""


@query(
    "box_stats",
    BOX
    + """ select g as "group", count(*) as n, any_value(q1) as q1, any_value(median) as median, any_value(q3) as q3, min(o_totalprice) filter (o_totalprice between q1-1.5*(q3-q1) and q3+1.5*(q3-q1)) as whisker_low,
    max(o_totalprice) filter (o_totalprice between q1-1.5*(q3-q1) and q3+1.5*(q3-q1)) as whisker_high, count(*) filter (o_totalprice not between q1-1.5*(q3-q1) and q3+1.5*(q3-q1)) as n_outliers
    from orders join q on g=o_orderstatus group by 1""",
    "q1 median q3 whisker_low whisker_high",
)
def _(t):
    return charts.box_stats(t.orders, "o_totalprice", "o_orderstatus")


@query("violin_density")
def _(t):
    return charts.violin_density(t.orders, "o_totalprice", "o_orderstatus")


@query(
    "scatter_trend",
    'select l_returnflag as "group", regr_slope(l_extendedprice, l_quantity) as slope, regr_intercept(l_extendedprice, l_quantity) as intercept, regr_r2(l_extendedprice, l_quantity) as r2, count(*) as n from lineitem group by 1',
    "slope:5 intercept:4 r2:9",
)
def _(t):
    return charts.scatter_trend(t.lineitem, "l_quantity", "l_extendedprice", "l_returnflag")["line"]


@query("bar_counts", 'select o_orderstatus as x, o_orderpriority as "group", count(*) as count from orders group by 1,2')
def _(t):
    return charts.bar_counts(t.orders, "o_orderstatus", group="o_orderpriority")


@query("bar_totals", "select o_orderstatus as x, sum(o_totalprice)/1000 as y from orders group by 1", "y:3")
def _(t):
    return charts.bar_counts(t.orders, "o_orderstatus", "o_totalprice").withColumn("y", F.col("y") / 1000)


@query(
    "line_series",
    """with b as (select min(epoch_us(ts))::double as lo, max(epoch_us(ts))::double as hi from events)
    select event_type as "group", least(floor((epoch_us(ts)::double-lo)/((hi-lo)/100)), 99)::int as bucket, avg(value) as y, count(*) as n from events, b group by 1,2""",
    "y:6",
)
def _(t):
    return charts.line_series(t.events, "ts", "value", "event_type", 100).drop("x")


@query("corr_heatmap", "with w as (select * from lineitem) select x, y, r from (" + _pairs_sql("corr({a},{b})") + ")", "r:9")
def _(t):
    return charts.corr_heatmap(t.lineitem, NUMBERS)


@query(
    "qq_points",
    f"""with p as (select l_extendedprice as y, row_number() over (order by l_extendedprice)::double as i, count(*) over ()::double as n from lineitem),
    u as (select *, case when i=n then power(0.5, 1/n) when i=1 then 1-power(0.5, 1/n) else (i-0.3175)/(n+0.365) end as u from p)
    select floor((i-1)*500/n)::int as run, avg({quantile('u')}) as theoretical, avg(y) as sample, count(*) as n from u group by 1""",
    "theoretical:6 sample:2",
)
def _(t):
    return charts.qq_points(t.lineitem, "l_extendedprice")["points"].select("run", "theoretical", "sample", "n")


@query("residual_points")
def _(t):
    return charts.residual_points(t.orders, "o_totalprice", "o_custkey")["smooth"]


@query("pca_scores", """with s as (select l_orderkey, l_partkey, l_linenumber, (l_quantity-(select avg(l_quantity) from lineitem))/(select stddev_pop(l_quantity) from lineitem) as a,
    (l_extendedprice-(select avg(l_extendedprice) from lineitem))/(select stddev_pop(l_extendedprice) from lineitem) as b from lineitem) select l_orderkey, l_partkey, l_linenumber, abs(a+sign((select corr(l_quantity,l_extendedprice) from lineitem))*b)/sqrt(2) as pc1 from s""", "pc1:6")  # fmt: skip
def _(t):
    scores = charts.pca_scores(t.lineitem, ["l_quantity", "l_extendedprice"], ["l_orderkey", "l_partkey", "l_linenumber"])
    return scores.select("l_orderkey", "l_partkey", "l_linenumber", F.abs("PC1").alias("pc1"))


@query("auto_eda")
def _(t):
    report = pilot.Report([pilot.Step(f"{kind} {args}", "done", data) for kind, args, data in charts.auto_eda(t.orders)])
    return report.table(t.spark)


# -- checks, validation, choice ------------------------------------------------------------------


@query(
    "check_equal_variance",
    f"with {moments_sql('customer', 'c_acctbal', 'c_mktsegment')} select 'Homogeneity of variance (Levene)' as \"check\", w as statistic from lev",
    "statistic",
)
def _(t):
    return assumptions.check_equal_variance(t.customer, "c_acctbal", "c_mktsegment").select("check", "statistic")


@query(
    "check_expected_counts",
    contingency_sql("labels", "quality", "toxic") + "select case when min(e) < 5 then 'fail' else 'pass' end as status, min(e) as statistic from e",
    "statistic",
)
def _(t):
    return assumptions.check_expected_counts(t.labels, "quality", "toxic").select("status", "statistic")


@query("check_multicollinearity", "select case when v > 5 then 'fail' else 'pass' end as status, v as statistic from (select 1/(1-corr(l_quantity,l_discount)**2) as v from lineitem)", "statistic:8")
def _(t):
    return assumptions.check_multicollinearity(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"]).select("status", "statistic")


@query(
    "check_homoscedasticity",
    SIMPLE_FIT.format(x="o_custkey", y="o_totalprice", table="orders", extra="") + "select 'Homoscedasticity (Breusch–Pagan)' as \"check\", count(*)*corr(x, e*e)**2 as statistic from e",
    "statistic:5",
)
def _(t):
    return assumptions.check_homoscedasticity(t.orders, "o_totalprice", "o_custkey").select("check", "statistic")


@query("check_complete_cases", f"with {DIRTY} select status, case when avg((price is null)::int) > 0.05 then 'warning' else 'info' end as state, avg((price is null)::int) as statistic from dirty group by 1 having avg((price is null)::int) > 0", "statistic:8")
def _(t):
    found = assumptions.check_complete_cases(_dirty(t).withColumnRenamed("status", "label"), ["price", "customer"], ["label"])
    return found.select(F.col("label").alias("status"), F.col("status").alias("state"), "statistic")


@query("check_sample_size", "select n_regionkey, 'warning' as status, count(*)::double as statistic from nation group by 1 having count(*) < 20", "statistic:1")
def _(t):
    return assumptions.check_sample_size(t.nation, ["n_regionkey"]).select("n_regionkey", "status", "statistic")


NORMAL_STATUS = "case when p >= 0.05 then 'pass' else 'fail' end as status"


@query("check_normality", f"with {shapiro_sql('select o_orderstatus, o_totalprice as y from orders', 'o_orderstatus')} select o_orderstatus, {NORMAL_STATUS}, w as statistic, p as p_value from sw", "statistic:6 p_value:5")
def _(t):
    return assumptions.check_normality(t.orders, "o_totalprice", by=["o_orderstatus"]).select("o_orderstatus", "status", "statistic", "p_value")


@query(
    "check_group_normality",
    f"""with {shapiro_sql('select o_orderstatus, o_totalprice as y from orders', 'o_orderstatus')}
    select 'Normality of ''o_totalprice'' in group ' || o_orderstatus as "check", {NORMAL_STATUS}, w as statistic from sw
    union all select 'Central limit theorem', 'info', null from sw having min(n) >= 30""",
    "statistic:6",
)
def _(t):
    return assumptions.check_group_normality(t.orders, "o_totalprice", "o_orderstatus").select("check", "status", "statistic")


@query(
    "check_residual_normality",
    f"""with f as (select regr_slope(o_totalprice, o_custkey) as b, regr_intercept(o_totalprice, o_custkey) as a from orders),
    {shapiro_sql("select 1 as one, o_totalprice-a-b*o_custkey as y from orders, f", 'one')} select {NORMAL_STATUS}, w as statistic from sw""",
    "statistic:6",
)
def _(t):
    return assumptions.check_residual_normality(t.orders, "o_totalprice", "o_custkey").select("status", "statistic")


@query(
    "check_assumptions",
    f"""with {shapiro_sql('select c_mktsegment, c_acctbal as y from customer', 'c_mktsegment')}, l as (with {moments_sql('customer', 'c_acctbal', 'c_mktsegment')} select w as statistic from lev)
    select 'Independence of observations' as "check", null as statistic union all select 'Normality of ''c_acctbal'' in group ' || c_mktsegment, w from sw
    union all select 'Central limit theorem', null from sw having min(n) >= 30 union all select 'Homogeneity of variance (Levene)', statistic from l""",
    "statistic:6",
)
def _(t):
    return assumptions.check_assumptions(t.customer, "oneway_anova", {"y": "c_acctbal", "x": "c_mktsegment"}).select("check", "statistic")


@query(
    "validate_results",
    """with r as (select l_returnflag, corr(l_tax, l_discount) as r, count(*) as n from lineitem group by 1), t as (select *, abs(r)*sqrt((n-2)/(1-r*r)) as t from r)
    select l_returnflag, 'not_causation' as code, 'info' as level from r union all select l_returnflag, 'method_note', 'warning' from r
    union all select l_returnflag, 'significance_not_importance', 'info' from t where t > 1.9602
    union all select l_returnflag, 'sig_small_effect', 'warning' from t where t > 1.9602 and abs(r) < 0.1""",
)
def _(t):
    results = validate.results_table(correlation.pearson(t.lineitem, "l_tax", "l_discount", by=["l_returnflag"]))
    return validate.validate_results(results, by=["l_returnflag"]).select("l_returnflag", "code", "level")


@query(
    "recommend_tests",
    """with g as (select min(a) as a, min(b) as b from (select count(*) filter (l_linestatus='F') as a, count(*) filter (l_linestatus='O') as b from lineitem))
    select 'l_quantity' as y, 'l_linestatus' as x, case when least(a,b) >= 30 then 'independent_t' else 'mannwhitney' end as method from g
    union all select 'l_quantity', 'l_returnflag', 'oneway_anova' from (select min(c) as c from (select count(*) as c from lineitem group by l_returnflag)) where c >= 30
    union all select 'l_returnflag', 'l_linestatus', 'chi_square' union all select 'l_quantity', 'l_extendedprice', 'pearson' from lineitem having count(*) >= 200
    union all select 'l_quantity', 'l_shipdate', 'trend_analysis' union all select 'l_extendedprice', 'l_quantity', 'linear_regression'""",
)
def _(t):
    pairs = [
        {"y": "l_quantity", "x": "l_linestatus", "intent": "difference"},
        {"y": "l_quantity", "x": "l_returnflag", "intent": "difference"},
        {"y": "l_returnflag", "x": "l_linestatus"},
        {"y": "l_quantity", "x": "l_extendedprice", "intent": "relationship"},
        {"y": "l_quantity", "x": "l_shipdate", "intent": "trend"},
        {"y": "l_extendedprice", "x": "l_quantity", "intent": "predict"},
    ]
    return recommend.recommend_tests(t.lineitem, pairs).select("y", "x", "method")


@query("run_method", "select l_returnflag, avg(l_quantity) as mean, count(*) as n from lineitem group by 1", "mean")
def _(t):
    return registry.run_method(t.lineitem, "one_sample_t", {"column": "l_quantity", "mu": 25}, ["l_returnflag"]).statistics.select("l_returnflag", "mean", "n")


@query("analyze")
def _(t):
    return registry.analyze(t.lineitem, "pearson", {"y": "l_tax", "x": "l_discount"}).flags


@query("autopilot")
def _(t):
    return pilot.autopilot(t.customer, [{"y": "c_acctbal", "x": "c_mktsegment", "intent": "difference"}], charts=3).table(t.spark)


# -- sources, sinks and versions -------------------------------------------------------------------


@query("merge_frames", "select n_nationkey, n_name, n_regionkey, null::int as r_regionkey, null::varchar as r_name from nation union all select null, null, null, r_regionkey, r_name from region")
def _(t):
    return files.merge_frames([t.nation, t.region])


@query("preview", "select o_orderkey, o_orderstatus from orders order by o_orderkey limit 200 offset 40")
def _(t):
    return sinks.preview(t.orders.withColumn("_row_id", F.col("o_orderkey")), 40, 500).select("o_orderkey", "o_orderstatus")


@query("infer_datetime", "select o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def _(t):
    text = t.orders.select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day"))
    return files.infer_datetime(text).select("o_orderkey", "o_orderstatus", F.date_format(F.date_add("day", 0), "yyyy-MM-dd").alias("day"))


@query("read_csv", "select c_custkey, c_name, c_acctbal, c_mktsegment, c_nationkey::bigint as c_nationkey from customer", "c_acctbal:2")
def _(t):
    path = scratch(t.spark)
    sinks.export(t.customer, "csv", path)
    return files.read_csv(t.spark, path)


@query("read_tsv", "select p_partkey, p_name, p_retailprice from part", "p_retailprice:2")
def _(t):
    path = scratch(t.spark)
    t.part.select("p_partkey", "p_name", "p_retailprice").write.option("header", True).option("sep", "\t").csv(path)
    return files.read_tsv(t.spark, path)


@query("read_json", "select event_id, event_type, (props->>'$.k')::bigint as \"props.k\" from events")
def _(t):
    path = scratch(t.spark)
    sinks.export(t.events.select("event_id", "event_type", F.from_json("props", "k long").alias("props")), "json", path)
    return files.flatten(files.read_json(t.spark, path))


@query("read_parquet", "select doc_id, quality, toxic from labels")
def _(t):
    path = scratch(t.spark)
    sinks.export(t.labels, "parquet", path)
    return files.read_any(t.spark, path + "/*.parquet")


@query("write_result", "select l_returnflag, count(*) as n from lineitem group by 1")
def _(t):
    path = scratch(t.spark)
    sinks.write_result(hypothesis.one_sample_t(t.lineitem, "l_quantity", by=["l_returnflag"]), "csv", path)
    return files.read_csv(t.spark, path + "/statistics").select("l_returnflag", "n")


@query("version_store", "select version, n_rows from (select 1 as version, count(*) as n_rows from orders union all select 2, count(*) from orders where o_orderstatus = 'F')")
def _(t):
    store = VersionStore(t.spark, scratch(t.spark))
    store.ingest("orders", t.orders)
    store.clean("orders", [{"operation": "filter", "query": "o_orderstatus = 'F'"}])
    store.undo("orders")
    store.restore("orders", 2)
    return store.history("orders")["versions"].select("version", "n_rows")


@query("reproduce", "select 'one_sample_t' as method, true as same, count(*) as n from customer")
def _(t):
    store = VersionStore(t.spark, scratch(t.spark))
    store.ingest("customer", t.customer)
    done = registry.analyze(store.load("customer"), "one_sample_t", {"y": "c_acctbal"}, store=store, dataset="customer")
    result, same = store.reproduce(done.run_id)
    return result.statistics.select(F.lit(store.list_runs("customer").first()["method"]).alias("method"), F.lit(same).alias("same"), "n")
