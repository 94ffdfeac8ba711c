"""Registered queries of the engine's operators and the SQL that an independent engine runs for the same rows.

Floats are rounded on both sides. Queries use the operators of the library; the SQL is written on its own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import losses as L
from ..functions.hashing import hash_features
from ..functions.quantile import summaries, weighted_quantiles
from ..operators import binning, continuous, features as feat, gbdt, metrics, optim, score as scoring
from ..sources import lines as src
from .session import local, remove
from ..sources.models import forest_lines, read_forest

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c, digits: int = 6):
    return F.round(c, digits)


#: Scores have few decimals; this shift keeps them off the edges of rounding, in both engines.
SHIFT = 3.14159e-8


# ---------------------------------------------------------------- sample views
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
S_BIN = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 1.0::DOUBLE + l_linenumber AS w,
 CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, l_quantity::DOUBLE AS quantity, l_extendedprice / 10000.0::DOUBLE AS price,
 l_discount::DOUBLE AS discount, l_tax::DOUBLE AS tax, CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS open FROM lineitem"""
NAMES = ["quantity", "price", "discount", "tax", "open"]
#: Fixed coefficients of the linear score, the bias last.
FIXED = {"quantity": 0.02, "price": -0.3, "discount": 2.0, "tax": -1.5, "open": 0.25}
BIAS = 0.1
Z = "(0.1::DOUBLE + 0.02::DOUBLE*quantity - 0.3::DOUBLE*price + 2.0::DOUBLE*discount - 1.5::DOUBLE*tax + 0.25::DOUBLE*open)"
P = f"(1/(1+exp(-{Z})))"


def s_bin(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(*KEY, (1.0 + F.col("l_linenumber")).alias("w"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"), F.col("l_quantity").cast("double").alias("quantity"), (F.col("l_extendedprice") / 10000.0).alias("price"), F.col("l_discount").cast("double").alias("discount"), F.col("l_tax").cast("double").alias("tax"), F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0).alias("open"))


def z_of():
    return sum((F.col(k) * v for k, v in FIXED.items()), F.lit(BIAS))


def scored_bin(spark, d) -> DataFrame:
    df = s_bin(spark, d).withColumn("z", z_of())
    return df.withColumn("p", L.loss("sigmoid").predict(L.C, F.col("z")))


def long_bin(spark, d) -> DataFrame:
    """Exploded numeric features with the discount missing on every third line number."""
    df = s_bin(spark, d)
    return df.select("w", "y", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), (F.when(F.col("l_linenumber") % 3 == 0, F.lit(None)).otherwise(F.col(n)) if n == "discount" else F.col(n)).cast("double").alias("value")) for n in NAMES])).alias("x")).select("w", "y", "x.feature", "x.value")


LONG = f"""SELECT w, y, u.feature, u.value FROM (SELECT w, y, unnest([{{'feature':'quantity','value':quantity}},{{'feature':'price','value':price}},
 {{'feature':'discount','value':CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE discount END}},{{'feature':'tax','value':tax}},{{'feature':'open','value':open}}]) AS u FROM ({S_BIN}))"""


# ---------------------------------------------------------------- metrics
def _auc_sql(slots: int) -> str:
    return f"""WITH b AS (SELECT least(greatest(floor({P}*{slots}),0),{slots - 1}) AS slot, w, y FROM ({S_BIN})),
 s AS (SELECT slot, sum(CASE WHEN y=1 THEN w ELSE 0 END) pos, sum(CASE WHEN y=1 THEN 0 ELSE w END) neg FROM b GROUP BY slot),
 c AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY slot DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) above FROM s)
 SELECT round(sum(neg*(above+pos/2))/(sum(pos)*sum(neg)),6) AS auc FROM c"""


@query(_auc_sql(100))
def auc_100(spark, d):
    return metrics.auc(scored_bin(spark, d), 100).select(r6(F.col("auc")).alias("auc"))


@query(_auc_sql(100000))
def auc_default(spark, d):
    return metrics.auc(scored_bin(spark, d)).select(r6(F.col("auc")).alias("auc"))


@query(f"SELECT round(sqrt(sum(w*(y-{P})**2)/sum(w)),6) AS rmse, round(sum(w*abs(y-{P}))/sum(w),6) AS mae FROM ({S_BIN})")
def rmse_mae(spark, d):
    return scored_bin(spark, d).agg(r6(metrics.point_metric("rmse")).alias("rmse"), r6(metrics.point_metric("mae")).alias("mae"))


@query(f"SELECT round(sum(w*abs((q-(q*0.9::DOUBLE+1))/q))/sum(w),6) AS mape, round(sum(w*abs(q-(q*0.9::DOUBLE+1))/((q+abs(q*0.9::DOUBLE+1))/2))/sum(w),6) AS smape FROM (SELECT w, quantity AS q FROM ({S_BIN}))")
def mape_smape(spark, d):
    df = s_bin(spark, d).select("w", F.col("quantity").alias("y"), (F.col("quantity") * 0.9 + 1).alias("p"))
    return df.agg(r6(metrics.point_metric("mape")).alias("mape"), r6(metrics.point_metric("smape")).alias("smape"))


@query(f"SELECT round(sum(w*(ln(1+exp(-abs({Z})))+greatest({Z},0)-{Z}*y))/sum(w),6) AS loss, round(avg(ln(1+exp(-abs({Z})))+greatest({Z},0)-{Z}*y),6) AS real_loss FROM ({S_BIN})")
def mean_loss(spark, d):
    loss = L.loss("sigmoid").loss(L.C, F.col("z"), F.col("y"))
    return scored_bin(spark, d).agg(r6(metrics.mean_loss(loss, F.col("w"))).alias("loss"), r6(metrics.mean_loss(loss, F.lit(1.0))).alias("real_loss"))


@query(f"SELECT coalesce(a::INT,-1) AS actual, coalesce(b::INT,-1) AS predicted, sum(w) AS w FROM (SELECT y AS a, CASE WHEN {P}>=0.5 THEN 1 ELSE 0 END AS b, w FROM ({S_BIN})) GROUP BY CUBE(a, b)")
def confusion_binary(spark, d):
    """Margins as class -1."""
    return metrics.confusion(scored_bin(spark, d), F.col("y"), metrics.predicted_class(F.col("p"))).fillna(-1, ["actual", "predicted"])


_MC = """SELECT label, w, [s0, s1, s2] AS s FROM (SELECT l_linenumber % 3 AS label, 1.0::DOUBLE + l_linenumber AS w, (l_quantity-25.5::DOUBLE)/10 AS s0, (l_linenumber-4)/2.0::DOUBLE AS s1, 0.5::DOUBLE*(l_quantity%5)-1 AS s2 FROM lineitem)"""


def s_mc(spark, d) -> DataFrame:
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select(q.alias("q"), n.alias("n"), (n % 3).alias("label"), (1.0 + n).alias("w"), F.array((q - 25.5) / 10, (n - 4) / 2.0, 0.5 * (q % 5) - 1).alias("s"))


@query(f"SELECT label::INT AS actual, (list_position(s, list_max(s))-1)::INT AS predicted, sum(w) AS w FROM ({_MC}) GROUP BY 1, 2")
def confusion_multiclass(spark, d):
    return metrics.confusion(s_mc(spark, d), F.col("label"), metrics.arg_max(F.col("s"))).filter("actual IS NOT NULL AND predicted IS NOT NULL")


@query(f"""WITH c AS (SELECT y AS a, CASE WHEN {P}>=0.5 THEN 1 ELSE 0 END AS b, w FROM ({S_BIN})), k AS (SELECT unnest([0,1]) AS class)
 SELECT class::INT AS class, round(sum(CASE WHEN a=class AND b=class THEN w ELSE 0 END)/nullif(sum(CASE WHEN b=class THEN w ELSE 0 END),0),6) AS precision,
 round(sum(CASE WHEN a=class AND b=class THEN w ELSE 0 END)/sum(CASE WHEN a=class THEN w ELSE 0 END),6) AS recall, round(sum(CASE WHEN a=b THEN w ELSE 0 END)/sum(w),6) AS accuracy FROM c, k GROUP BY class""")
def precision_recall(spark, d):
    got = metrics.precision_recall(scored_bin(spark, d), F.col("y"), metrics.predicted_class(F.col("p")))
    return got.select("class", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "accuracy")])


# ---------------------------------------------------------------- objectives
_GRID = "SELECT DISTINCT l_quantity::DOUBLE AS q, l_linenumber AS n, (l_quantity-25.5::DOUBLE)/4 AS s, (l_linenumber%2)::DOUBLE AS y01, l_linenumber::DOUBLE AS yr FROM lineitem"
_SIG = "(1/(1+exp(-s)))"
_T, _ZM = "(2*y-1)", "((2*y-1)*s)"
#: loss, first and second derivative, in SQL of s and y; whether labels are 0 and 1.
_LOSS_SQL = {
    "sigmoid": (f"ln(1+exp(-abs(s)))+greatest(s,0)-s*y", f"{_SIG}-y", f"{_SIG}*(1-{_SIG})", True),
    "l2": ("(y-s)**2/2", "s-y", "1", False),
    "l1": ("abs(y-s)", "sign(s-y)", "1", False),
    "huber": ("CASE WHEN abs(y-s)<=0.5 THEN (y-s)**2/2 ELSE 0.5*(abs(y-s)-0.25) END", "least(greatest(s-y,-0.5),0.5)", "0", False),
    "hinge": (f"greatest(0,1-{_ZM})", f"CASE WHEN {_ZM}<1 THEN -{_T} ELSE 0 END", "0", True),
    "l2_hinge": (f"greatest(0,1-{_ZM})**2/2", f"CASE WHEN {_ZM}<=1 THEN ({_ZM}-1)*{_T} ELSE 0 END", "1", True),
    "smooth_hinge": (f"CASE WHEN {_ZM}<=0 THEN 0.5-{_ZM} WHEN {_ZM}<1 THEN (1-{_ZM})**2/2 ELSE 0 END", f"CASE WHEN {_ZM}<=0 THEN -{_T} WHEN {_ZM}<1 THEN -{_T}*(1-{_ZM}) ELSE 0 END", f"CASE WHEN {_ZM}<=0 OR {_ZM}>=1 THEN 0 ELSE {_T}**2 END", True),
    "exponential": (f"exp(least(-{_ZM},8))", f"-{_T}*exp(least(-{_ZM},8))", f"exp(least(-{_ZM},8))", True),
    "poisson": ("-y*s+exp(least(s,30))+lgamma(y+1)", "exp(least(s,30))-y", "exp(least(s,30))", False),
    "mape": ("abs((y-s)/y)", "sign((s-y)/y)/y", "1", False),
    "inv_mape": ("abs((y-s)/s)", "sign((s-y)/s)*y/(s*s)", "1", False),
    "smape": ("abs(s-y)/((y+abs(s))/2)", "(sign(s-y)*((y+abs(s))/2)-0.5*sign(s)*abs(s-y))/((y+abs(s))/2)**2", "1", False),
}


def _scalar_loss(name):
    def run(spark, d):
        q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber")
        g = table(spark, d, "lineitem").select(q.alias("q"), n.alias("n"), ((q - 25.5) / 4).alias("s"), (n % 2).cast("double").alias("y01"), n.cast("double").alias("yr")).distinct()
        o = L.loss(name)
        s, y = F.col("s"), F.col("y01" if _LOSS_SQL[name][3] else "yr")
        return g.select("q", "n", r6(o.loss(L.C, s, y)).alias("loss"), r6(o.first(L.C, s, y)).alias("grad"), r6(o.second(L.C, s, y)).alias("hess"), r6(o.predict(L.C, s)).alias("pred"))

    return run


for _name, (_l, _g, _h, _b) in _LOSS_SQL.items():
    _pred = {"sigmoid": _SIG, "poisson": "exp(least(s,30))"}.get(_name, "s")
    query(f"SELECT q, n, round(({_l})::DOUBLE,6)+0 AS loss, round(({_g})::DOUBLE,6)+0 AS grad, round(({_h})::DOUBLE,6)+0 AS hess, round(({_pred})::DOUBLE,6)+0 AS pred FROM (SELECT *, {'y01' if _b else 'yr'} AS y FROM ({_GRID}))", f"loss_{_name}")(_scalar_loss(_name))

_MGRID = "SELECT DISTINCT l_quantity::DOUBLE AS q, l_linenumber AS n, (l_quantity-25.5::DOUBLE)/10 AS a, (l_linenumber-4)/2.0::DOUBLE AS b, 0.5::DOUBLE*(l_quantity%5)-1 AS c, (l_linenumber%3=0)::INT AS ya, (l_linenumber%3=1)::INT AS yb, (l_linenumber%3=2)::INT AS yc FROM lineitem"
_TRUTH = "(CASE WHEN ya=1 THEN a WHEN yb=1 THEN b ELSE c END)"


def _margin_sql(of: str, slope: str, minus: str) -> tuple[str, str, str, str]:
    f = lambda e, x: e.replace("@", f"({x}-{_TRUTH})")
    g = {x: f"(CASE WHEN y{x}=1 THEN 0 ELSE {f(slope, x)} END)" for x in "abc"}
    total = "+".join(g.values())
    return ("+".join(f(of, x) for x in "abc") + f"-{minus}", *[f"CASE WHEN y{x}=1 THEN -({total}) ELSE {g[x]} END" for x in "abc"])


_E = {x: f"exp({x}-greatest(a,b,c))" for x in "abc"}
_SOFT = {x: f"({_E[x]}/({'+'.join(_E.values())}))" for x in "abc"}
_GA, _GB = "(1/(1+exp(-a)))", "(1/(1+exp(-b)))"
_MULTI_SQL = {
    "softmax": (f"ln({'+'.join(_E.values())})+greatest(a,b,c)-{_TRUTH}", *[f"{_SOFT[x]}-y{x}" for x in "abc"]),
    "multiclass_hinge": _margin_sql("greatest(0,@+1)", "CASE WHEN @+1>0 THEN 1 ELSE 0 END", "1"),
    "multiclass_l2_hinge": _margin_sql("greatest(0,@+1)**2/2", "greatest(0,@+1)", "0.5"),
    "multiclass_smooth_hinge": _margin_sql("(CASE WHEN @>=0 THEN 0.5+@ WHEN @>-1 THEN (1+@)**2/2 ELSE 0 END)", "CASE WHEN @>=0 THEN 1 WHEN @>-1 THEN 1+@ ELSE 0 END", "0.5"),
    # heap of 5: node 1 has leaf 3 (class a) on the right and node 2 on the left, which has leaves 4 (b) and 5 (c)
    "hsoftmax": (f"(ln(1+exp(-abs(a)))+greatest(a,0)-(yb+yc)*a)+(yb+yc)*(ln(1+exp(-abs(b)))+greatest(b,0))-yb*b", f"{_GA}-(yb+yc)", f"{_GB}*(yb+yc)-yb", "0"),
}
_MPRED = {"softmax": [_SOFT[x] for x in "abc"], "hsoftmax": [f"1-{_GA}", f"{_GA}*{_GB}", f"{_GA}*(1-{_GB})"]}


def _multi_loss(name):
    def run(spark, d):
        q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber")
        g = table(spark, d, "lineitem").select(q.alias("q"), n.alias("n")).distinct()
        s = [(q_ - 25.5) / 10 for q_ in [F.col("q")]] + [(F.col("n") - 4) / 2.0, 0.5 * (F.col("q") % 5) - 1]
        y = [(F.col("n") % 3 == i).cast("double") for i in range(3)]
        g = g.select("q", "n", *[c.alias(f"s{i}") for i, c in enumerate(s)], *[c.alias(f"y{i}") for i, c in enumerate(y)])
        s, y, o = [F.col(f"s{i}") for i in range(3)], [F.col(f"y{i}") for i in range(3)], L.loss(name)
        return g.select("q", "n", r6(o.loss(L.C, s, y)).alias("loss"), *[r6(c).alias(f"g{i}") for i, c in enumerate(o.first(L.C, s, y))], *[r6(c).alias(f"p{i}") for i, c in enumerate(o.predict(L.C, s))])

    return run


for _name, (_l, *_gs) in _MULTI_SQL.items():
    _ps = _MPRED.get(_name, ["a", "b", "c"])
    query(f"SELECT q, n, round(({_l})::DOUBLE,6)+0 AS loss, {', '.join(f'round(({g})::DOUBLE,6)+0 AS g{i}' for i, g in enumerate(_gs))}, {', '.join(f'round(({p})::DOUBLE,6)+0 AS p{i}' for i, p in enumerate(_ps))} FROM ({_MGRID})", f"loss_{_name}")(_multi_loss(_name))


# ---------------------------------------------------------------- samples and features
@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (1+l_linenumber)::DOUBLE AS weight, (l_returnflag='R')::INT::DOUBLE AS label, round(l_quantity::DOUBLE,6) AS quantity, round(l_tax::DOUBLE,6) AS tax FROM lineitem""")
def parse_lines(spark, d):
    raw = table(spark, d, "lineitem").select(*KEY, F.concat_ws("###", (1 + F.col("l_linenumber")).cast("string"), F.when(F.col("l_returnflag") == "R", "1").otherwise("0"), F.concat(F.lit("tax:7,quantity:"), F.col("l_quantity").cast("string"), F.lit(",tax:"), F.col("l_tax").cast("string"))).alias("value"))
    got = src.parse(raw)
    return got.filter("error IS NULL").select(*KEY, "weight", F.col("label")[0].alias("label"), r6(F.element_at("features", "quantity")).alias("quantity"), r6(F.element_at("features", "tax")).alias("tax"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, '1###' || CASE l_returnflag WHEN 'A' THEN '0' WHEN 'N' THEN '1' ELSE '2' END || '###1:' || l_linenumber || ',2:' || l_partkey AS value FROM lineitem""")
def libsvm_convert(spark, d):
    raw = table(spark, d, "lineitem").select(*KEY, F.concat(F.col("l_returnflag"), F.lit(" 1:"), F.col("l_linenumber"), F.lit("  2:"), F.col("l_partkey")).alias("value"))
    return src.libsvm_to_lines(raw, "multi_classification@A,N,R")


_SPARSE_SQL = "SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, unnest(['brand@' || p_brand, 'type@' || p_type, 'size@' || p_size]) AS feature FROM lineitem JOIN part ON l_partkey = p_partkey"


def s_sparse(spark, d) -> DataFrame:
    got = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    names = F.array(F.concat(F.lit("brand@"), "p_brand"), F.concat(F.lit("type@"), "p_type"), F.concat(F.lit("size@"), F.col("p_size").cast("string")))
    return got.select(*KEY, (F.col("l_discount") > 0.05).cast("double").alias("y"), (1.0 + F.col("l_linenumber")).alias("w"), F.explode(names).alias("feature")).withColumn("value", F.lit(1.0))


@query(f"SELECT feature, count(*) AS cnt FROM ({_SPARSE_SQL}) GROUP BY feature HAVING count(*) >= 1000")
def feature_filter(spark, d):
    return feat.feature_counts(s_sparse(spark, d), 1000)


@query(f"SELECT feature, row_number() OVER (ORDER BY feature) AS idx FROM (SELECT DISTINCT feature FROM ({_SPARSE_SQL})) UNION ALL SELECT '_bias_', 0")
def feature_dict(spark, d):
    return feat.dictionary(s_sparse(spark, d))


@query(f"SELECT feature, count(value) AS cnt, round(sum(value),2) AS sum, round(sum(value*value),2) AS sum2, round(max(value),6) AS max, round(min(value),6) AS min FROM ({LONG}) WHERE value IS NOT NULL GROUP BY feature")
def feature_stats(spark, d):
    s = feat.feature_stats(long_bin(spark, d).filter("value IS NOT NULL"))
    return s.select("feature", "cnt", r6(F.col("sum"), 2).alias("sum"), r6(F.col("sum2"), 2).alias("sum2"), r6(F.col("max")).alias("max"), r6(F.col("min")).alias("min"))


@query(f"""WITH l AS (SELECT * FROM ({LONG}) WHERE value IS NOT NULL), s AS (SELECT feature, avg(value) m, stddev_pop(value) sd FROM l GROUP BY feature)
 SELECT l.feature, round(value,6) AS value, round(CASE WHEN sd<1e-6 THEN value ELSE (value-m)/sd END,4) AS scaled, count(*) AS n FROM l JOIN s ON l.feature=s.feature WHERE l.feature <> 'price' GROUP BY 1,2,3""")
def standardize(spark, d):
    ex = long_bin(spark, d).filter("value IS NOT NULL").withColumn("raw", F.col("value"))
    got = feat.transform_features(ex, feat.feature_stats(ex), "standardization").filter("feature <> 'price'")
    return got.groupBy("feature", r6(F.col("raw")).alias("value"), r6(F.col("value"), 4).alias("scaled")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH l AS (SELECT * FROM ({LONG}) WHERE value IS NOT NULL), s AS (SELECT feature, min(value) lo, max(value) hi FROM l GROUP BY feature)
 SELECT l.feature, round(value,6) AS value, round(CASE WHEN hi-lo<1e-6 THEN 1 ELSE -1+2*(value-lo)/(hi-lo) END,6) AS scaled, count(*) AS n FROM l JOIN s ON l.feature=s.feature WHERE l.feature <> 'price' GROUP BY 1,2,3""")
def scale_range(spark, d):
    ex = long_bin(spark, d).filter("value IS NOT NULL").withColumn("raw", F.col("value"))
    got = feat.transform_features(ex, feat.feature_stats(ex), "scale_range").filter("feature <> 'price'")
    return got.groupBy("feature", r6(F.col("raw")).alias("value"), r6(F.col("value")).alias("scaled")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag='R' AS pos, count(*) AS n, round(sum((1+l_linenumber)*(CASE WHEN l_returnflag='R' THEN 3.0::DOUBLE ELSE 1 END)),4) AS weight FROM lineitem GROUP BY 1")
def upsample_weight(spark, d):
    s = s_bin(spark, d).select("y", F.col("w").alias("weight"))
    got = feat.label_sampling(s, {1.0: 3.0}, "sigmoid", F.col("y"))
    return got.groupBy((F.col("y") == 1).alias("pos")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("weight"), 4).alias("weight"))


@query("SELECT n, CASE WHEN c=0 THEN 1.0::DOUBLE ELSE 0 END AS y0, CASE WHEN c=1 THEN 1.0::DOUBLE ELSE 0 END AS y1, CASE WHEN c=2 THEN 1.0::DOUBLE ELSE 0 END AS y2, cnt FROM (SELECT l_linenumber AS n, l_linenumber%3 AS c, count(*) AS cnt FROM lineitem GROUP BY 1)")
def label_onehot(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("n")).agg(F.count(F.lit(1)).alias("cnt"))
    y = feat.one_hot(F.array((F.col("n") % 3).cast("double")), 3)
    return g.select("n", *[y[i].alias(f"y{i}") for i in range(3)], "cnt")


@query("SELECT l_returnflag AS label, count(*) AS cnt, sum(1.0::DOUBLE+l_linenumber) AS weight FROM lineitem GROUP BY 1")
def label_stats(spark, d):
    rows = table(spark, d, "lineitem").withColumn("weight", 1.0 + F.col("l_linenumber"))
    return feat.label_stats(rows, F.col("l_returnflag"))


@query("SELECT n, round(-ln(1/p-1) + -ln(1/0.3::DOUBLE-1),6)+0 AS init FROM (SELECT DISTINCT l_linenumber AS n, l_linenumber/10.0::DOUBLE AS p FROM lineitem)")
def init_score(spark, d):
    o = L.loss("sigmoid")
    g = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("n")).distinct()
    return g.select("n", (r6(o.inverse(L.C, F.col("n") / 10.0) + o.inverse(L.C, F.lit(0.3))) + 0.0).alias("init"))


@query(f"SELECT feature, round(coalesce(sum(value*w)/sum(CASE WHEN value IS NOT NULL THEN w END),0),6) AS fill FROM ({LONG}) GROUP BY feature")
def missing_mean(spark, d):
    return feat.missing_values(long_bin(spark, d), "mean", "w").select("feature", r6(F.col("fill")).alias("fill"))


_WQ = """WITH v AS (SELECT {k}, {v} AS v, sum({w}) AS w FROM ({t}) WHERE {v} IS NOT NULL GROUP BY 1, 2),
 c AS (SELECT {k}, v, sum(w) OVER (PARTITION BY {k} ORDER BY v) AS cum, sum(w) OVER (PARTITION BY {k}) AS total FROM v)
 SELECT {k}, round(min(v),6) AS {out} FROM c WHERE cum >= {q}*total GROUP BY {k}"""


@query(_WQ.format(k="feature", v="value", w="w", t=LONG, q="0.3::DOUBLE", out="fill"))
def missing_quantile(spark, d):
    return feat.missing_values(long_bin(spark, d), "quantile@0.3", "w").select("feature", r6(F.col("fill")).alias("fill"))


@query(f"SELECT feature, round(coalesce(value,-1),6) AS value, count(*) AS n FROM ({LONG}) WHERE feature IN ('discount','tax') GROUP BY 1,2")
def missing_value(spark, d):
    ex = long_bin(spark, d)
    got = feat.filled(ex, feat.missing_values(ex, "value@-1", "w")).filter(F.col("feature").isin("discount", "tax"))
    return got.groupBy("feature", r6(F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query(_WQ.format(k="l_returnflag", v="l_extendedprice", w="1.0::DOUBLE+l_linenumber", t="lineitem", q="0.5::DOUBLE", out="median"))
def weighted_median(spark, d):
    got = weighted_quantiles(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_extendedprice"), 1.0 + F.col("l_linenumber"))
    return got.select("l_returnflag", r6(F.col("quantile")).alias("median"))


@query()
def feature_hash(spark, d):
    got = hash_features(s_sparse(spark, d), 64, 7, "h_", tuple(KEY))
    return got.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


@query()
def quantile_sketch(spark, d):
    from ..functions.quantile import Summary

    def at(batches):
        for pdf in batches:
            yield pdf.assign(quantiles=[[Summary.from_bytes(b, 500).query(q) for q in (0.1, 0.5, 0.9)] for b in pdf["summary"]])[["feature", "quantiles"]]

    return summaries(long_bin(spark, d).filter("value IS NOT NULL"), "feature", "value", "w", 500).mapInPandas(at, "feature string, quantiles array<double>")


@query(f"SELECT feature, count(DISTINCT value) <= 16 AS whole, true AS close FROM ({LONG}) WHERE value IS NOT NULL GROUP BY feature")
def bins_quantile_sketch(spark, d):
    """The default, by summaries: all values where they are few, else each within 1/64 of its rank."""
    ex = long_bin(spark, d).filter("value IS NOT NULL")
    bins = binning.by_quantile(ex, 16)
    ranks = ex.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("feature").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = ranks.select("feature", "value", (F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy("feature"))).alias("hi"), ((F.sum("n").over(upto) - F.col("n")) / F.sum("n").over(Window.partitionBy("feature"))).alias("lo"), F.count(F.lit(1)).over(Window.partitionBy("feature")).alias("m"))
    # of the wanted ranks i / 16, one lies within the value's own ranks or near them
    got = bins.join(ranks, ["feature", "value"]).withColumn("off", F.array_min(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.greatest(F.col("lo") - i / 16, i / 16 - F.col("hi"), F.lit(0.0)))))
    return got.groupBy("feature").agg(F.first(F.col("m") <= 16).alias("whole"), F.every((F.col("m") <= 16) | (F.col("off") <= 1 / 64)).alias("close"))


# Over all features: price has far more distinct values than the SQL of their namesakes above takes. Tests use brute force.
def _transformed_all(spark, d, mode, digits):
    ex = long_bin(spark, d).filter("value IS NOT NULL").withColumn("raw", F.col("value"))
    got = feat.transform_features(ex, feat.feature_stats(ex), mode)
    return got.groupBy("feature", r6(F.col("raw")).alias("value"), r6(F.col("value"), digits).alias("scaled")).agg(F.count(F.lit(1)).alias("n"))


@query()
def standardize_all(spark, d):
    return _transformed_all(spark, d, "standardization", 4)


@query()
def scale_range_all(spark, d):
    return _transformed_all(spark, d, "scale_range", 6)


@query()
def missing_value_all(spark, d):
    ex = long_bin(spark, d)
    return feat.filled(ex, feat.missing_values(ex, "value@-1", "w")).groupBy("feature", r6(F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query()
def bins_nosample_all(spark, d):
    return binning.no_sample(long_bin(spark, d)).select("feature", r6(F.col("value")).alias("value"))


# ---------------------------------------------------------------- bins
@query(f"SELECT DISTINCT feature, round(value,6) AS value FROM ({LONG}) WHERE value IS NOT NULL AND feature <> 'price'")
def bins_nosample(spark, d):
    return binning.no_sample(long_bin(spark, d)).filter("feature <> 'price'").select("feature", r6(F.col("value")).alias("value"))


@query(f"SELECT DISTINCT feature, floor(value*10)/10 AS value FROM ({LONG}) WHERE value IS NOT NULL")
def bins_precision(spark, d):
    return binning.by_precision(long_bin(spark, d), 1)


@query(f"""WITH v AS (SELECT feature, value, count(*)::DOUBLE AS w FROM ({LONG}) WHERE value IS NOT NULL GROUP BY 1,2), n AS (SELECT feature, count(*) n FROM v GROUP BY 1),
 c AS (SELECT v.feature, value, n, ceil(sum(w) OVER (PARTITION BY v.feature ORDER BY value)/sum(w) OVER (PARTITION BY v.feature)*16-1e-9) AS step FROM v JOIN n ON v.feature=n.feature)
 SELECT feature, round(value,6) AS value FROM c WHERE n <= 16 UNION ALL SELECT feature, round(max(value),6) FROM c WHERE n > 16 GROUP BY feature, step""")
def bins_quantile(spark, d):
    return binning.by_quantile(long_bin(spark, d), 16, exact=True).select("feature", r6(F.col("value")).alias("value"))


_EDGES = [5.0, 12.5, 20.0, 30.0, 44.0]


@query("SELECT quantity, b AS bin, count(*) AS n FROM (SELECT l_quantity::DOUBLE AS quantity, (CASE WHEN l_quantity>=5 THEN 1 ELSE 0 END + CASE WHEN l_quantity>=12.5 THEN 1 ELSE 0 END + CASE WHEN l_quantity>=20 THEN 1 ELSE 0 END + CASE WHEN l_quantity>=30 THEN 1 ELSE 0 END + CASE WHEN l_quantity>=44 THEN 1 ELSE 0 END)::INT AS b FROM lineitem) GROUP BY 1,2")
def bin_assign(spark, d):
    q = F.col("l_quantity").cast("double")
    return table(spark, d, "lineitem").select(q.alias("quantity"), binning.assigned(q, np.array(_EDGES)).alias("bin")).groupBy("quantity", "bin").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- scores
@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round({Z}+{SHIFT}::DOUBLE,6) AS score FROM ({S_BIN})")
def linear_score(spark, d):
    ex = s_bin(spark, d).select(*KEY, F.explode(F.create_map(*[x for n in NAMES for x in (F.lit(n), F.col(n))], F.lit(feat.BIAS), F.lit(1.0))).alias("feature", "value"))
    weights = spark.createDataFrame([*FIXED.items(), (feat.BIAS, BIAS)], "feature string, weight double")
    return scoring.parallel_linear(ex, weights, tuple(KEY)).select(*KEY, r6(F.col("score") + SHIFT).alias("score"))


@query(f"""SELECT label, round(avg(e0/(e0+e1+1)),6) AS p0, round(avg(e1/(e0+e1+1)),6) AS p1, round(avg(1/(e0+e1+1)),6) AS p2 FROM (SELECT label, exp(x) AS e0, exp(y) AS e1 FROM
 (SELECT label, 0.5::DOUBLE*embedding[1]-embedding[2]+0.1::DOUBLE AS x, embedding[3]::DOUBLE+2*embedding[4]-0.2::DOUBLE AS y FROM embeddings)) GROUP BY label""")
def multiclass_score(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.array(*[F.lit(i).cast("long") for i in range(5)]).alias("idx"), F.concat(F.array(F.lit(1.0)), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))).alias("val"))
    w = np.array([[0.1, -0.2], [0.5, 0], [-1, 0], [0, 1], [0, 2]], float).ravel()
    got = continuous.scored(rows, continuous.build("multiclass_linear", 5, 3), w)
    p = L.loss("softmax").predict(L.C, [F.col("scores")[i] for i in range(3)])
    return got.select("label", *[c.alias(f"p{i}") for i, c in enumerate(p)]).groupBy("label").agg(*[r6(F.avg(f"p{i}")).alias(f"p{i}") for i in range(3)])


_FM_W = {"quantity": (0.02, 0.1, -0.05), "price": (-0.3, 0.2, 0.1), "discount": (2.0, -1.0, 0.5), "tax": (-1.5, 0.3, 0.7), "open": (0.25, 0.05, 0.0)}
_FM_SQL = "+".join(f"0.5*(pow({'+'.join(f'({v[f]}::DOUBLE)*{n}' for n, v in _FM_W.items())},2)-({'+'.join(f'pow(({v[f]}::DOUBLE)*{n},2)' for n, v in _FM_W.items())}))" for f in (1, 2))


def _index_rows(spark, d) -> DataFrame:
    return s_bin(spark, d).select(*KEY, "w", "y", F.array(*[F.lit(i).cast("long") for i in range(6)]).alias("idx"), F.array(F.lit(1.0), *[F.col(n) for n in NAMES]).alias("val"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round({Z}+{_FM_SQL}+{SHIFT}::DOUBLE,5) AS score FROM ({S_BIN})")
def fm_score(spark, d):
    m = continuous.build("fm", 6, k=2)
    rows = np.array([(BIAS, 0, 0), *[_FM_W[n] for n in NAMES]])
    w = np.concatenate([rows[:, 0], rows[:, 1:].ravel()])
    return continuous.scored(_index_rows(spark, d), m, w).select(*KEY, r6(F.col("scores")[0] + SHIFT, 5).alias("score"))


#: FFM on three features in two fields (price and quantity in 1, discount in 2): latent pairs by (feature, opposite field).
_FFM_SQL = "(0.1::DOUBLE*0.2::DOUBLE+0.3::DOUBLE*-0.1::DOUBLE)*quantity*price+(0.2::DOUBLE*0.5::DOUBLE+0.1::DOUBLE*0.4::DOUBLE)*quantity*discount+(-0.3::DOUBLE*0.5::DOUBLE+0.2::DOUBLE*0.4::DOUBLE)*price*discount"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(0.02::DOUBLE*quantity-0.3::DOUBLE*price+2*discount+{_FFM_SQL}+{SHIFT}::DOUBLE,5) AS score FROM ({S_BIN})")
def ffm_score(spark, d):
    rows = s_bin(spark, d).select(*KEY, F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)]).alias("idx"), F.array("quantity", "price", "discount").alias("val"), F.array(*[F.lit(i).cast("long") for i in (1, 1, 2)]).alias("fld"))
    m = continuous.build("ffm", 4, k=2, fields=3)
    v = np.zeros((4, 3, 2))
    v[1, 1], v[2, 1] = (0.1, 0.3), (0.2, -0.1)  # quantity and price against field 1
    v[1, 2], v[3, 1] = (0.2, 0.1), (0.5, 0.4)  # quantity against 2, discount against 1
    v[2, 2] = (-0.3, 0.2)  # price against 2
    w = np.concatenate([[0, 0.02, -0.3, 2.0], v.ravel()])
    return continuous.scored(rows, m, w).select(*KEY, r6(F.col("scores")[0] + SHIFT, 5).alias("score"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round((exp(g)*h0+h1)/(exp(g)+1)+{SHIFT}::DOUBLE,6) AS score FROM (SELECT *, 0.5::DOUBLE-0.05::DOUBLE*quantity+3*discount AS g, {Z} AS h0, 1-0.2::DOUBLE*price AS h1 FROM ({S_BIN}))""")
def gbmlr_score(spark, d):
    m = continuous.build("gbmlr", 6, k=2)
    g = {"quantity": -0.05, "discount": 3.0}
    w = np.array([(0.5, BIAS, 1.0), *[(g.get(n, 0.0), FIXED[n], -0.2 if n == "price" else 0.0) for n in NAMES]])
    return continuous.scored(_index_rows(spark, d), m, w.ravel()).select(*KEY, r6(F.col("scores")[0] + SHIFT).alias("score"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(a*b*1.5::DOUBLE + a*(1-b)*-0.5::DOUBLE + (1-a)*0.25::DOUBLE,6) AS score FROM
 (SELECT *, 1/(1+exp(-(0.5::DOUBLE-0.05::DOUBLE*quantity))) AS a, 1/(1+exp(-(-0.2::DOUBLE+3*discount))) AS b FROM ({S_BIN}))""")
def gbhsdt_score(spark, d):
    m = continuous.build("gbhsdt", 6, k=3)
    gates = np.array([(0.5, -0.2), (-0.05, 0.0), (0.0, 0.0), (0.0, 3.0), (0.0, 0.0), (0.0, 0.0)])
    w = np.concatenate([[0.25, 1.5, -0.5], gates.ravel()])
    return continuous.scored(_index_rows(spark, d), m, w).select(*KEY, r6(F.col("scores")[0]).alias("score"))


@query("SELECT label, round(avg(a*b),6) AS leaf4, round(avg(a*(1-b)),6) AS leaf5, round(avg(1-a),6) AS leaf3 FROM (SELECT label, 1/(1+exp(-embedding[1]::DOUBLE)) AS a, 1/(1+exp(-embedding[2]::DOUBLE)) AS b FROM embeddings) GROUP BY label")
def hsoftmax_gate(spark, d):
    s = table(spark, d, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(f"s{i}") for i in range(2)])
    p = L.loss("hsoftmax").predict(L.C, [F.col("s0"), F.col("s1"), F.lit(0.0)])
    return s.select("label", *[c.alias(f"p{i}") for i, c in enumerate(p)]).groupBy("label").agg(r6(F.avg("p1")).alias("leaf4"), r6(F.avg("p2")).alias("leaf5"), r6(F.avg("p0")).alias("leaf3"))


# ---------------------------------------------------------------- objective and optimizer
@query(f"""SELECT round((sum(w*(ln(1+exp(-abs({Z})))+greatest({Z},0)-{Z}*y)) + sum(w)*(0.05::DOUBLE*0.5*(0.02**2+0.3**2+2.0**2+1.5**2+0.25**2) + 0.01::DOUBLE*(0.02+0.3+2.0+1.5+0.25)))/sum(w),6) AS objective FROM ({S_BIN})""")
def reg_objective(spark, d):
    df = scored_bin(spark, d)
    loss = L.loss("sigmoid").loss(L.C, F.col("z"), F.col("y"))
    w = np.array([BIAS, *FIXED.values()])
    l1, l2 = optim.Penalty([(1, 6, 0.01, 0.05)]).vectors(6)
    return df.agg(r6((F.sum(F.col("w") * loss) + F.sum("w") * float(0.5 * (l2 * w * w).sum() + (l1 * np.abs(w)).sum())) / F.sum("w")).alias("objective"))


_OWL = [("quantity", 0.02), ("price", 0.0), ("discount", 2.0), ("tax", -1.5), ("open", 0.0)]


@query(f"""WITH g AS (SELECT sum(w) AS t, {', '.join(f"sum(w*({P}-y)*{n})/sum(w) AS g_{n}" for n in NAMES)} FROM ({S_BIN})) SELECT unnest([{', '.join(f"{{'feature':'{n}','g':round(CASE WHEN {c}>0 THEN g_{n}+0.05 WHEN {c}<0 THEN g_{n}-0.05 WHEN g_{n}+0.05<0 THEN g_{n}+0.05 WHEN g_{n}-0.05>0 THEN g_{n}-0.05 ELSE 0 END,6)}}" for n, c in _OWL)}], recursive := true) FROM g""")
def owlqn_pseudograd(spark, d):
    df = scored_bin(spark, d)
    row = df.agg(*[(F.sum(F.col("w") * (F.col("p") - F.col("y")) * F.col(n)) / F.sum("w")).alias(n) for n in NAMES]).first()
    got = optim.pseudo_gradient(np.array([c for _, c in _OWL]), np.array([row[n] for n in NAMES]), np.full(5, 0.05))
    return spark.createDataFrame([(n, round(float(g), 6)) for n, g in zip(NAMES, got, strict=True)], "feature string, g double")


# ---------------------------------------------------------------- trees
@query(f"SELECT y, round(sum(w*({P}-y)),3) AS g, round(sum(w*{P}*(1-{P})),3) AS h, count(*) AS n FROM ({S_BIN}) GROUP BY y")
def gbdt_gradpairs(spark, d):
    o, df = L.loss("sigmoid"), scored_bin(spark, d)
    g, h = o.first(L.C, F.col("z"), F.col("y")), o.second_for_trees(L.C, F.col("z"), F.col("y"))
    return df.groupBy("y").agg(r6(F.sum(F.col("w") * g), 3).alias("g"), r6(F.sum(F.col("w") * h), 3).alias("h"), F.count(F.lit(1)).alias("n"))


_TREE_FEATURES = ["quantity", "discount", "tax", "open"]


#: Quantile bins of price in the trees over all features.
_PRICE_BINS = 64


def _price_values(spark, d) -> np.ndarray:
    ex = s_bin(spark, d).select(F.lit("price").alias("feature"), F.col("price").alias("value"))
    return np.sort([r["value"] for r in binning.by_quantile(ex, _PRICE_BINS).collect()])


def tree_rows(spark, d, features=_TREE_FEATURES) -> tuple[DataFrame, dict[str, np.ndarray], int]:
    """Binned rows with the gradient pairs of an empty forest at p = 0.5."""
    df = s_bin(spark, d)
    values = {}
    for r in df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("v")) for n in _TREE_FEATURES])).alias("x")).groupBy("x.f").agg(F.sort_array(F.collect_set("x.v")).alias("v")).collect():
        values[r["f"]] = np.array(r["v"])
    if "price" in features:
        values["price"] = _price_values(spark, d)
    samples = df.select(F.array("y").alias("label"), F.col("w").alias("weight"), F.create_map(*[x for n in features for x in (F.lit(n), F.col(n))]).alias("features"))
    return gbdt.begin(samples, features, values, gbdt.Forest(features), gbdt.Params()), values, max(map(len, values.values()))


_HIST = f"""SELECT feature, dense_rank() OVER (PARTITION BY feature ORDER BY value) - 1 AS bin, value, g, h, n FROM (SELECT u.f AS feature, u.v AS value, sum(w*(0.5::DOUBLE-y)) AS g, sum(w*0.25::DOUBLE) AS h, count(*) AS n
 FROM (SELECT w, y, unnest([{', '.join(f"{{'f':'{n}','v':{n}}}" for n in _TREE_FEATURES)}]) AS u FROM ({S_BIN})) GROUP BY 1, 2)"""


@query(f"SELECT feature, bin, round(g,3) AS g, round(h,3) AS h, n FROM ({_HIST})")
def gbdt_hist(spark, d):
    return _hist(spark, d, _TREE_FEATURES)


@query()
def gbdt_hist_all(spark, d):
    return _hist(spark, d, NAMES)


def _hist(spark, d, features):
    rows, values, n_bins = tree_rows(spark, d, features)
    hist = gbdt.histograms(rows, gbdt.Tree([gbdt.Node()]), [0], len(features), n_bins)[0]
    out = [(f, b, round(float(hist[i, b, 0]), 3), round(float(hist[i, b, 1]), 3), int(hist[i, b, 2])) for i, f in enumerate(features) for b in range(len(values[f]))]
    return local(spark, out, "feature string, bin long, g double, h double, n long")


_GAIN = f"""WITH hist AS ({_HIST}), f AS (SELECT feature, CASE feature WHEN 'quantity' THEN 0 WHEN 'discount' THEN 1 WHEN 'tax' THEN 2 ELSE 3 END AS fid, bin, g, h, n, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, sum(g) OVER p AS gt, sum(h) OVER p AS ht, sum(n) OVER p AS nt, value, lead(value) OVER (PARTITION BY feature ORDER BY bin) AS nextv
 FROM hist WINDOW w AS (PARTITION BY feature ORDER BY bin), p AS (PARTITION BY feature)),
 s AS (SELECT *, gl*gl/(hl+1)+(gt-gl)*(gt-gl)/(ht-hl+1)-gt*gt/(ht+1) AS gain FROM f WHERE nextv IS NOT NULL AND hl>=1 AND ht-hl>=1),
 top AS (SELECT * FROM s ORDER BY gain DESC, fid, bin LIMIT 1)"""


@query(_GAIN + " SELECT feature, bin, round(gain,4) AS gain FROM top")
def gbdt_best_split(spark, d):
    rows, values, n_bins = tree_rows(spark, d)
    hist = gbdt.histograms(rows, gbdt.Tree([gbdt.Node()]), [0], len(_TREE_FEATURES), n_bins)[0]
    gain, f, left, _ = gbdt.best_split(hist, gbdt.Params(l2=1.0))
    return local(spark, [(_TREE_FEATURES[f], left, round(gain, 4))], "feature string, bin long, gain double")


@query()
def gbdt_best_split_all(spark, d):
    """Over all features, price by the values of its bins."""
    values = _price_values(spark, d)
    edges, bins = F.array(*map(F.lit, binning.bin_edges(values).tolist())), F.array(*map(F.lit, values.tolist()))
    at = F.size(F.filter(edges, lambda e: e <= F.col("price"))) + 1
    return _best(s_bin(spark, d).withColumn("price", F.element_at(bins, at)), NAMES)


def _best(df, features):
    df = df.select("w", "y", F.explode(F.array(*[F.struct(F.lit(i).alias("fid"), F.lit(n).alias("feature"), F.col(n).alias("value")) for i, n in enumerate(features)])).alias("x")).select("w", "y", "x.*")
    hist = df.groupBy("fid", "feature", "value").agg(F.sum(F.col("w") * (0.5 - F.col("y"))).alias("g"), F.sum(F.col("w") * 0.25).alias("h"))
    by = Window.partitionBy("fid").orderBy("value")
    run, all_ = by.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("fid")
    hist = hist.select("fid", "feature", (F.row_number().over(by) - 1).cast("long").alias("bin"), F.sum("g").over(run).alias("gl"), F.sum("h").over(run).alias("hl"), F.sum("g").over(all_).alias("gt"), F.sum("h").over(all_).alias("ht"), F.lead("value").over(by).alias("next"))
    part = lambda g, h: g * g / (h + 1)
    hist = hist.filter("next IS NOT NULL AND hl >= 1 AND ht - hl >= 1").withColumn("gain", part(F.col("gl"), F.col("hl")) + part(F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")) - part(F.col("gt"), F.col("ht")))
    best = hist.agg(F.max_by(F.struct("feature", "bin", "gain"), F.struct("gain", -F.col("fid"), -F.col("bin"))).alias("b"))
    return best.select("b.feature", "b.bin", r6(F.col("b.gain"), 4).alias("gain"))


@query(_GAIN + """ SELECT 0 AS node, feature, round((value+nextv)/2,6) AS threshold, NULL::DOUBLE AS leaf, round(ht,3) AS hess_sum, nt::BIGINT AS sample_cnt FROM top UNION ALL
 SELECT 1, NULL, NULL, round(-gl/(hl+1)*0.1,6), round(hl,3), nl::BIGINT FROM top UNION ALL SELECT 2, NULL, NULL, round(-(gt-gl)/(ht-hl+1)*0.1,6), round(ht-hl,3), (nt-nl)::BIGINT FROM top""")
def gbdt_stump(spark, d):
    return _stump(spark, d, _TREE_FEATURES)


@query()
def gbdt_stump_all(spark, d):
    return _stump(spark, d, NAMES)


def _stump(spark, d, features):
    rows, values, n_bins = tree_rows(spark, d, features)
    p = gbdt.Params(max_depth=1, l2=1.0, learning_rate=0.1)
    tree = gbdt.grow(rows, len(features), n_bins, p)
    gbdt.finish(tree, [values[f] for f in features], np.zeros(len(features)), "mean")
    forest = gbdt.Forest(features, [tree])
    out = [(n, f, round(t, 6) if f else None, None if v is None else round(v, 6), round(h, 3), c) for _, n, f, t, _, _, _, v, _, h, c in forest.node_rows()]
    return local(spark, out, "node int, feature string, threshold double, leaf double, hess_sum double, sample_cnt long")


#: A small forest in its text form.
FOREST = """uniform_base_prediction=0.5
class_num=1
loss_function=sigmoid
tree_num=2
booster[1] depth=2,node_num=5,leaf_cnt=3
0:[quantity<=24.5] yes=1,no=2,missing=1,gain=3.25,hess_sum=10.0,sample_cnt=40
	1:leaf=-0.12,hess_sum=6.0,sample_cnt=24
	2:[discount<=0.05] yes=3,no=4,missing=4,gain=1.5,hess_sum=4.0,sample_cnt=16
		3:leaf=0.2,hess_sum=2.0,sample_cnt=8
		4:leaf=-0.05,hess_sum=2.0,sample_cnt=8
booster[2] depth=1,node_num=3,leaf_cnt=2
0:[tax<=0.03] yes=1,no=2,missing=2,gain=0.75,hess_sum=9.0,sample_cnt=40
	1:leaf=0.07,hess_sum=5.0,sample_cnt=20
	2:leaf=-0.03,hess_sum=4.0,sample_cnt=20""".split("\n")
_MISS = f"SELECT * REPLACE (CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE discount END AS discount) FROM ({S_BIN})"
_L1 = "(CASE WHEN quantity<=24.5 THEN 1 WHEN discount IS NULL THEN 4 WHEN discount<=0.05 THEN 3 ELSE 4 END)"
_L2 = "(CASE WHEN tax<=0.03 THEN 1 ELSE 2 END)"


def missing_bin(spark, d) -> DataFrame:
    return s_bin(spark, d).withColumn("discount", F.when(F.col("l_linenumber") % 3 == 0, F.lit(None)).otherwise(F.col("discount")))


@query(f"SELECT {_L1} AS leaf1, {_L2} AS leaf2, count(*) AS n FROM ({_MISS}) GROUP BY 1, 2")
def tree_leafid(spark, d):
    f = read_forest(FOREST)
    cols = {n: F.col(n) for n in f.features}
    return missing_bin(spark, d).groupBy(gbdt.routed(f, 0, cols).alias("leaf1"), gbdt.routed(f, 1, cols).alias("leaf2")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(1/(1+exp(-s)),6) AS p FROM (SELECT *, (CASE {_L1} WHEN 1 THEN -0.12::DOUBLE WHEN 3 THEN 0.2 ELSE -0.05 END)+(CASE {_L2} WHEN 1 THEN 0.07::DOUBLE ELSE -0.03 END) AS s FROM ({_MISS}))""")
def tree_route(spark, d):
    maps = missing_bin(spark, d).select(*KEY, F.map_filter(F.create_map(*[x for n in ("quantity", "discount", "tax") for x in (F.lit(n), F.col(n))]), lambda k, v: v.isNotNull()).alias("features"))
    got = scoring.Predictor(read_forest(FOREST), "sigmoid").apply(maps)
    return got.select(*KEY, r6(F.col("predicts")[0]).alias("p"))


@query("SELECT * FROM (VALUES ('quantity', 1::BIGINT, 3.25::DOUBLE), ('discount', 1, 1.5), ('tax', 1, 0.75)) t(feature, splits, gain)")
def feature_importance(spark, d):
    f = read_forest(forest_lines(read_forest(FOREST)))
    nodes = spark.createDataFrame(f.node_rows(), gbdt.NODE_SCHEMA)
    return nodes.filter("feature IS NOT NULL").groupBy("feature").agg(F.count(F.lit(1)).alias("splits"), F.sum("gain").alias("gain"))


@query(_WQ.format(k="leaf", v="left", w="w", t=f"SELECT w, quantity - 20 AS left, CASE WHEN discount<=0.05 THEN 0 ELSE 1 END AS leaf FROM ({S_BIN})", q="0.5::DOUBLE", out="value").replace(" AS left", ' AS "left"').replace("left AS v", '"left" AS v').replace("WHERE left", 'WHERE "left"'))
def lad_leaf(spark, d):
    """Medians of what a forest's start of 20 leaves, in the leaves of a split of the discount."""
    state = s_bin(spark, d).select(F.array("quantity").alias("y"), F.col("w").alias("weight"), F.array(F.when(F.col("discount") <= 0.05, 0).otherwise(1)).alias("bins"), F.array(F.lit(0.0)).alias("sum"), F.lit(True).alias("sampled"))
    tree = gbdt.Tree([gbdt.Node(feature=0, left_bin=0, right_bin=1, left=1, right=2), gbdt.Node(), gbdt.Node()])
    gbdt.lad_refined(state, tree, gbdt.Forest(["discount"], [], "l1", 1, 20.0), gbdt.Params(learning_rate=1.0), 0)
    return spark.createDataFrame([(i, round(tree.nodes[i + 1].value, 6)) for i in (0, 1)], "leaf int, value double")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_linenumber || '###' || (l_linenumber*2)::VARCHAR || ',' || l_partkey::VARCHAR AS labelled, 'x:1,m_label_0:' || (l_linenumber*2)::VARCHAR || ',m_label_1:' || l_partkey::VARCHAR AS features FROM lineitem""")
def save_modes(spark, d):
    df = table(spark, d, "lineitem").select(*KEY, F.array((F.col("l_linenumber") * 2).cast("long"), F.col("l_partkey")).alias("p"), F.col("l_linenumber").cast("string").alias("label"), F.lit("x:1").alias("line"))
    a = scoring.saved_form(df, scoring.LABEL_AND_PREDICT, F.col("p"), F.col("line"), F.col("label"), kind="leafid").withColumnRenamed("value", "labelled")
    return scoring.saved_form(a, scoring.AS_FEATURE, F.col("p").cast("array<string>"), F.col("line"), model="m").select(*KEY, "labelled", F.col("value").alias("features"))


#: Thompson sampling with alpha 0.5: the bias stays, the others move by alpha z / sqrt(precision) with the seed's normal numbers.
_PRECISION = [1.0, 400.0, 25.0, 100.0, 64.0, 16.0]
_NORMAL = np.random.default_rng(3).normal(size=6)
_DRAWN_SQL = "+".join(f"({FIXED[n]}::DOUBLE+({float(_NORMAL[i + 1])!r}::DOUBLE)*0.5/sqrt({_PRECISION[i + 1]}::DOUBLE))*{n}" for i, n in enumerate(NAMES))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(0.1::DOUBLE+{_DRAWN_SQL}+{SHIFT}::DOUBLE,5) AS score FROM ({S_BIN})")
def thompson_score(spark, d):
    w = continuous.thompson(np.array([BIAS, *FIXED.values()]), np.array(_PRECISION), 0.5, 3)
    got = continuous.scored(_index_rows(spark, d), continuous.build("linear", 6), w)
    return got.select(*KEY, r6(F.col("scores")[0] + SHIFT, 5).alias("score"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round((exp(g)*1.5::DOUBLE-0.5::DOUBLE)/(exp(g)+1)+{SHIFT}::DOUBLE,6) AS score FROM (SELECT *, 0.5::DOUBLE-0.05::DOUBLE*quantity+3*discount AS g FROM ({S_BIN}))""")
def gbsdt_score(spark, d):
    m = continuous.build("gbsdt", 6, k=2)
    w = np.array([1.5, -0.5, 0.5, -0.05, 0.0, 3.0, 0.0, 0.0])
    return continuous.scored(_index_rows(spark, d), m, w).select(*KEY, r6(F.col("scores")[0] + SHIFT).alias("score"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(a*b*(1+0.1::DOUBLE*quantity)+a*(1-b)*(-0.5::DOUBLE)+(1-a)*c*(0.25::DOUBLE+discount)+(1-a)*(1-c)*(0.75::DOUBLE-price)+{SHIFT}::DOUBLE,6) AS score FROM
 (SELECT *, 1/(1+exp(-(0.5::DOUBLE-0.05::DOUBLE*quantity))) AS a, 1/(1+exp(-(-0.2::DOUBLE+3*discount))) AS b, 1/(1+exp(-(0.1::DOUBLE+tax))) AS c FROM ({S_BIN}))""")
def gbhmlr_score(spark, d):
    m = continuous.build("gbhmlr", 6, k=4)
    w = np.array([[0.5, -0.2, 0.1, 1, -0.5, 0.25, 0.75], [-0.05, 0, 0, 0.1, 0, 0, 0], [0, 0, 0, 0, 0, 0, -1], [0, 3, 0, 0, 0, 1, 0], [0, 0, 1, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 0]], float)
    return continuous.scored(_index_rows(spark, d), m, w.ravel()).select(*KEY, r6(F.col("scores")[0] + SHIFT).alias("score"))


@query("SELECT n_nationkey, n_name AS value FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT n_nationkey, lower(n_name) FROM nation WHERE n_regionkey <> 0")
def line_hook(spark, d):
    lines = table(spark, d, "nation").select(F.concat_ws("|", "n_regionkey", "n_name").alias("value"), "n_nationkey")
    hook = lambda b: [] if b.startswith(b"0|") else [b.decode()[2:], b.decode()[2:].lower()]
    return src.apply_hook(lines, hook).select("n_nationkey", "value")


@query(f"SELECT round(sqrt(sum(w*(y-{P})**2)/sum(w)),6) AS weighted, round(sqrt(avg((y-{P})**2)),6) AS real FROM ({S_BIN})")
def weighted_vs_real(spark, d):
    got = metrics.evaluate(scored_bin(spark, d), ["rmse"])
    return spark.createDataFrame([(round(got["rmse"], 6), round(got["real_rmse"], 6))], "weighted double, real double")


@query()
def bins_count(spark, d):
    return binning.by_count(long_bin(spark, d), 20)


@query(f"""WITH v AS (SELECT feature, value, count(*) AS rows FROM ({LONG}) WHERE value IS NOT NULL GROUP BY 1,2), n AS (SELECT feature, count(*) AS n FROM v GROUP BY 1)
 SELECT v.feature, round(value,6) AS value FROM v JOIN n ON v.feature=n.feature WHERE n <= 12 OR ('0x' || substr(md5('7:' || v.feature || ':' || value),1,8))::BIGINT/4294967296.0::DOUBLE < 1-pow(0.99::DOUBLE, rows)""")
def bins_rate(spark, d):
    return binning.by_rate(long_bin(spark, d), 0.01, 12).select("feature", r6(F.col("value")).alias("value"))


@query()
def instance_sampling(spark, d):
    rows = s_bin(spark, d).select("y", F.col("w").alias("weight"))
    return feat.instance_sample(rows, 0.5, 11, compensate=True).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


# ---------------------------------------------------------------- training: rows only
@query()
def lbfgs_linear(spark, d):
    rows = _index_rows(spark, d).select(F.array("y").alias("label"), F.col("w").alias("weight"), "idx", "val")
    got = continuous.train(rows, continuous.build("linear", 6), "sigmoid", optim.Settings(max_iter=15), (0.0,), (0.001,))
    return spark.createDataFrame([(n, float(w)) for n, w in zip([feat.BIAS, *NAMES], got.w, strict=True)], "feature string, weight double")


@query()
def gbdt_train(spark, d):
    df = s_bin(spark, d)
    samples = df.select(F.array("y").alias("label"), F.col("w").alias("weight"), F.create_map(*[x for n in NAMES for x in (F.lit(n), F.col(n))]).alias("features"))
    values = {"quantity": np.arange(1.0, 51), "discount": np.arange(11) / 100, "tax": np.arange(9) / 100, "open": np.array([0.0, 1.0]), "price": _price_values(spark, d)}
    forest = gbdt.train(samples, NAMES, values, "sigmoid", gbdt.Params(rounds=3, max_depth=3))
    return local(spark, forest.node_rows(), gbdt.NODE_SCHEMA)


@query()
def softtree_train(spark, d):
    rows = _index_rows(spark, d).select(F.array("y").alias("label"), F.col("w").alias("weight"), "idx", "val")
    e = continuous.train_ensemble(rows, "gbmlr", 6, "sigmoid", 2, optim.Settings(max_iter=4), k=2, l2=(0.01,))
    return spark.createDataFrame([(t, i, float(x)) for t, (_, w) in enumerate(e.trees) for i, x in enumerate(w)], "tree int, i int, w double")


def _train_test(spark, d):
    rows = _index_rows(spark, d).select(F.array("y").alias("label"), F.col("w").alias("weight"), "idx", "val", (F.pmod(F.xxhash64(*KEY), F.lit(5)) == 0).alias("test"))
    return continuous.packed(rows.filter("NOT test").drop("test")), continuous.packed(rows.filter("test").drop("test"))


@query()
def hyper_grid(spark, d):
    tr, te = _train_test(spark, d)
    m = continuous.build("linear", 6)
    fit = lambda a, b: ((t := continuous.train(tr, m, "sigmoid", optim.Settings(max_iter=3), (a,), (b,), test=te)).test_loss, t)
    _, _, tried = optim.grid_search(fit, (0.0, 0.01, 1), (0.001, 0.1, 1))
    remove(tr), remove(te)
    return spark.createDataFrame([(a, b, float(v)) for (a, b), v in tried.items()], "l1 double, l2 double, test_loss double")


@query()
def hyper_hoag(spark, d):
    tr, te = _train_test(spark, d)
    m, mask = continuous.build("linear", 6), np.array([0.0, 1, 1, 1, 1, 1])
    weight = tr.agg(F.sum("weight")).first()[0]

    def fit(lam):
        t = continuous.train(tr, m, "sigmoid", optim.Settings(max_iter=3), (0.0,), (lam,))
        v, g, n = continuous.evaluate(te, m, "sigmoid", t.w)
        return t.result, v / n, g / n

    _, tried = optim.hoag(fit, 0.1, weight, mask, outer_iter=3)
    remove(tr), remove(te)
    return spark.createDataFrame([(float(a), float(b)) for a, b in tried], "l2 double, test_loss double")
