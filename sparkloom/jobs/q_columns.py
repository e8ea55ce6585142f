"""Queries of predicates, scaling, binning, discernibility, association and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import distributions as T
from sparkloom.jobs.catalog import gamma_p, measures_sql, pnorm, query, table, u
from sparkloom.operators import assoc, columns, discern, sketches
from sparkloom.operators.helpers import materialize, unpivot

_GAP = "case when l_orderkey % 10 = 0 then null else l_returnflag end"


@query(f"select indis, count(*) as n from (select (a is null or b is null or a = b) as indis from (select {_GAP} as a, l_linestatus as b from lineitem)) group by 1")
def p1_indiscernible(spark, sf):
    df = table(spark, sf, "lineitem").select(F.expr(_GAP).alias("a"), F.col("l_linestatus").alias("b"))
    return df.select(columns.indiscernible(F.col("a"), F.col("b")).alias("indis")).groupBy("indis").agg(F.count("*").alias("n"))


@query(f"select l_linestatus, sum(coalesce(cast(({_GAP}) = 'R' as double), 0.0)) as hits from lineitem group by 1")
def p2_crisp(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("a", F.expr(_GAP))
    return df.groupBy("l_linestatus").agg(F.sum(columns.crisp(F.col("a"), F.lit("R"))).alias("hits"))


@query("select c_custkey, round((c_acctbal - lo) / (hi - lo), 9) as c_acctbal from customer, (select min(c_acctbal)::double lo, max(c_acctbal)::double hi from customer)")
def p3_scale_unit(spark, sf):
    df = columns.scale_unit(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return df.select("c_custkey", F.round("c_acctbal", 9).alias("c_acctbal"))


@query("select l_returnflag_0, l_returnflag_1, l_returnflag_2, l_linestatus_0, count(*) as n from (select (l_returnflag = 'A')::double l_returnflag_0, (l_returnflag = 'N')::double l_returnflag_1, (l_returnflag = 'R')::double l_returnflag_2, (l_linestatus <> 'F')::double l_linestatus_0 from lineitem) group by all")
def p4_dummify(spark, sf):
    df = columns.dummify(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus"), ["l_returnflag", "l_linestatus"])
    return df.groupBy(*df.columns).agg(F.count("*").alias("n"))


@query("select c_mktsegment, count(*) as n from customer group by 1")
def p5_restore(spark, sf):
    df = table(spark, sf, "customer").select("c_mktsegment")
    known = columns.domains(df, ["c_mktsegment"])
    return columns.restore(columns.dummify(df, ["c_mktsegment"], known), known).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query(f"""with d as (select distinct c_mktsegment v from customer), s as (select c_custkey, d.v, (d.v = c_mktsegment)::int::double + 0.1::double w from customer, d),
c as (select *, sum(w) over (partition by c_custkey order by v) cum, sum(w) over (partition by c_custkey) t from s) select c_custkey, min(v) as c_mktsegment from c where cum >= {u('c_custkey')} * t group by 1""")
def p6_restore_wheel(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    known = columns.domains(df, ["c_mktsegment"])
    soft = columns.dummify(df, ["c_mktsegment"], known)
    soft = soft.withColumns({f"c_mktsegment_{i}": F.col(f"c_mktsegment_{i}") + 0.1 for i in range(len(known["c_mktsegment"]))})
    return columns.restore(soft, known, "wheel", key=["c_custkey"])


_Q5 = "quantile_cont({0}, [0.0, 0.25, 0.5, 0.75, 1.0])"


@query(f"""with q as (select {_Q5.format('l_extendedprice::double')} a from lineitem), c as (select list_transform([1, 2, 3, 4], lambda i: (a[i] + a[i + 1]) / 2) c from q)
select list_sum(list_transform(c, lambda x: (l_extendedprice > x)::int))::int as level, count(*) as n from lineitem, c group by 1""")
def p7_p8_quantile_levels(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_extendedprice").cast("double").alias("x"))
    cuts = columns.cuts_between_quantiles(df, ["x"], 5)["x"]
    return df.select(columns.level(F.col("x"), cuts).alias("level")).groupBy("level").agg(F.count("*").alias("n"))


@query("select i::int as i, round(v, 6) as cut from (select unnest([0, 1, 2]) i, unnest(quantile_cont(o_totalprice::double, [0.25, 0.5, 0.75])) v from orders)")
def p9_inner_quantiles(spark, sf):
    cuts = columns.cuts_inner_quantiles(table(spark, sf, "orders").select(F.col("o_totalprice").cast("double").alias("x")), ["x"], 3)["x"]
    return spark.createDataFrame([(i, c) for i, c in enumerate(cuts)], "i int, cut double").select("i", F.round("cut", 6).alias("cut"))


@query("select i::int as i, round(lo + (hi - lo) * (i + 1) / 5.0, 6) as cut from (select unnest([0, 1, 2, 3]) i), (select min(o_totalprice)::double lo, max(o_totalprice)::double hi from orders)")
def p10_equal_width(spark, sf):
    cuts = columns.cuts_equal_width(table(spark, sf, "orders"), ["o_totalprice"], 4)["o_totalprice"]
    return spark.createDataFrame([(i, c) for i, c in enumerate(cuts)], "i int, cut double").select("i", F.round("cut", 6).alias("cut"))


_TRI = "case when {x} <= {a} then 1.0 when {x} >= {b} then 0.0 else 1 - ({x} - {a}) / ({b} - {a}) end"


@query("""with q as (select quantile_cont(l_quantity::double, [0.25, 0.5, 0.75]) q from lineitem),
m as (select l_quantity::double x, q[1] a, q[2] b, q[3] c from lineitem, q),
t as (select x, 1 - least(greatest((x - a) / (b - a), 0), 1) m0, least(least(greatest((x - a) / (b - a), 0), 1), 1 - least(greatest((x - b) / (c - b), 0), 1)) m1, least(greatest((x - b) / (c - b), 0), 1) m2 from m)
select case when m0 >= m1 and m0 >= m2 then 0 when m1 >= m2 then 1 else 2 end::int as l_quantity, count(*) as n from t group by 1""")
def p11_discretize_fuzzy(spark, sf):
    df = columns.discretize_fuzzy(table(spark, sf, "lineitem").select("l_quantity"), ["l_quantity"], 3)
    return df.groupBy("l_quantity").agg(F.count("*").alias("n"))


@query("""with q as (select unnest([1, 2, 3]) r, quantile_cont(l_quantity::double, [0.0, 0.5, 1.0]) q from lineitem), p as (select r - 1 as level, case when r = 1 then null else q[r - 1] end l, q[r] t, case when r = 3 then null else q[r + 1] end h from q)
select level::int as level, round(sum(least(case when l is null then 1 else least(greatest((l_quantity - l) / (t - l), 0), 1) end, case when h is null then 1 else 1 - least(greatest((l_quantity - t) / (h - t), 0), 1) end)), 4) as mass from lineitem, p group by 1""")
def p12_p13_memberships(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("x"))
    sets = columns.membership_table(df, ["x"], 3)
    every = F.array(*(F.struct(F.lit(r).alias("level"), columns.membership(F.col("x"), a, t, b, variant="open").alias("m")) for _, r, a, t, b in sets))
    return df.select(F.explode(every).alias("s")).groupBy("s.level").agg(F.round(F.sum("s.m"), 4).alias("mass"))


_SKETCHED, _FIVE, _ERROR = ["l_quantity", "l_extendedprice", "l_discount"], [0.0, 0.25, 0.5, 0.75, 1.0], 0.01


@query(f"""with c as (unpivot (select l_quantity, l_extendedprice, l_discount from lineitem) on {', '.join(_SKETCHED)} into name col value v)
select col, i::int as i, count(*) as n, min(v) as low, max(v) as high, true as within from c, (select unnest([0, 1, 2, 3, 4]) i) group by 1, 2""")
def p7_p9_p13_sketched_quantiles(spark, sf):
    """Quantiles from the merged sketches of all ship months, and whether their counted ranks keep the stated error."""
    df = table(spark, sf, "lineitem")
    months = materialize(sketches.sketch(df.withColumn("month", F.date_format("l_shipdate", "yyyy-MM")), _SKETCHED, _ERROR, by=["month"]))
    whole = materialize(sketches.merge(months))
    asked = sketches.at_shares(whole, _FIVE).collect()
    below = [F.sum((F.col(r["col"]) < r["value"]).cast("long")).alias(f"b{j}") for j, r in enumerate(asked)]
    upto = [F.sum((F.col(r["col"]) <= r["value"]).cast("long")).alias(f"u{j}") for j, r in enumerate(asked)]
    ranks = df.agg(*below, *upto)
    checked = F.explode(F.array(*(
        F.struct(F.lit(r["col"]).alias("col"), F.lit(r["i"]).alias("i"), ((F.col(f"b{j}") <= (r["share"] + _ERROR) * r["n"]) & (F.col(f"u{j}") >= (r["share"] - _ERROR) * r["n"])).alias("within"))
        for j, r in enumerate(asked)
    )))
    return ranks.select(checked.alias("x")).select("x.*").join(F.broadcast(whole.select("col", "n", "low", "high")), "col").select("col", "i", "n", "low", "high", "within")


@query("select o_orderstatus, count(*) as n, round(sum(o_totalprice)::double, 2) as total from orders where o_totalprice > 100000 group by 1")
def p14_a15_processor(spark, sf):
    run = columns.Processors()
    run.register("totals", lambda df, digits: df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice").cast("double"), digits).alias("total")), meta={"digits": {"type": int, "default": 2, "low": 0, "high": 6}})
    return run.run(table(spark, sf, "orders"), "totals", F.col("o_totalprice") > 100000, ["o_orderstatus", "o_totalprice"])


@query(f"""with k as (select * from customer order by {u('c_custkey')}, c_custkey limit (select ceil(0.25 * count(*))::long from customer)),
c as (unpivot (select c_custkey::varchar c_custkey, c_name, c_nationkey::varchar c_nationkey, c_acctbal::varchar c_acctbal, c_mktsegment from k) on c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment into name col value v),
o as (select name, row_number() over (order by {u('i', seed=1)}) rn from (select unnest(range(5)) i, unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) name))
select col, count(*) as n, count(distinct v) as kinds from c join o on o.name = c.col where rn <= 2 group by 1 having count(distinct v) > 1""")
def p15_sample_subtable(spark, sf):
    out = columns.sample_subtable(table(spark, sf, "customer"), 0.25, ["c_custkey"])
    return unpivot(out, [], out.columns).groupBy("col").agg(F.count("*").alias("n"), F.count_distinct("value").alias("kinds"))


_PART = ["p_brand", "p_type", "p_size"]


@query("select p_brand, p_size, count(*) as n from part group by all")
def d1_equivalence_classes(spark, sf):
    return discern.equivalence_classes(table(spark, sf, "part"), ["p_brand", "p_size"])


@query("select ((sum(n) * sum(n) - sum(n * n)) / 2)::long as pairs from (select count(*) n from part group by p_brand, p_size)")
def d2_discerned_pairs(spark, sf):
    return discern.discerned_pairs(table(spark, sf, "part"), ["p_brand", "p_size"])


_HOLES = "case when c_custkey % 10 = 0 then null else c_mktsegment end"


@query(f"""with t as (select {_HOLES} a, case when c_custkey % 7 = 0 then null else c_nationkey end b, count(*) n from customer group by all), k as (select row_number() over (order by a, b) i, * from t)
select (sum(case when x.i < y.i and (x.a <> y.a or x.b <> y.b) then x.n * y.n else 0 end))::long as pairs from k x, k y""")
def d3_discerned_pairs_missing(spark, sf):
    df = table(spark, sf, "customer").select(F.expr(_HOLES).alias("a"), F.expr("case when c_custkey % 7 = 0 then null else c_nationkey end").alias("b"))
    return discern.discerned_pairs_missing(df, ["a", "b"])


@query("select count(*) as n from supplier x, supplier y where x.s_suppkey < y.s_suppkey and x.s_nationkey <> y.s_nationkey")
def d4_pair_set(spark, sf):
    return discern.pair_set(table(spark, sf, "supplier"), "s_suppkey", "s_nationkey").agg(F.count("*").alias("n"))


@query("select c.c_custkey from customer c, (select * from customer order by c_custkey limit 1) r where c.c_nationkey <> r.c_nationkey and c.c_mktsegment <> r.c_mktsegment")
def d5_discerned_from(spark, sf):
    df = table(spark, sf, "customer")
    return discern.discerned_from(df, df.orderBy("c_custkey").first().asDict(), "c_nationkey", "c_mktsegment").select("c_custkey")


@query("select p_partkey, concat_ws(',', case when p.p_brand <> r.p_brand then 'p_brand' end, case when p.p_type <> r.p_type then 'p_type' end, case when p.p_size <> r.p_size then 'p_size' end) as differs from part p, (select p_brand, p_type, p_size from part order by p_partkey limit 1) r")
def d6_differing(spark, sf):
    df = table(spark, sf, "part")
    out = discern.differing(df, df.orderBy("p_partkey").first().asDict(), _PART)
    return out.select("p_partkey", F.concat_ws(",", "differs").alias("differs"))


def _cover_sql(gain: str, last: str, cost: str) -> str:
    """Greedy cover: picks in order, by gain over what is left."""
    return f"""with recursive s as (select l_suppkey id, {cost} cost, list(distinct l_partkey % 400) e from lineitem group by 1), t as (select count(distinct l_partkey % 400) n from lineitem),
g as (select 0 as pick, -1::bigint as id, []::bigint[] as covered union all select pick + 1, nid, list_distinct(list_concat(covered, e)) from (select g.pick, g.covered, s.id nid, s.e, row_number() over (partition by g.pick order by {gain} desc, s.id {last}) rn
from g, s where len(g.covered) < (select n from t)) where rn = 1) select (pick - 1)::int as pick, id as set_id from g where pick > 0"""


_LEFT = "len(list_filter(s.e, lambda v: not list_contains(g.covered, v)))"


def _parts_of_suppliers(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("set_id"), F.pmod("l_partkey", F.lit(400)).alias("element"))


@query(_cover_sql(_LEFT, "asc", "1.0"))
def d7_greedy_cover(spark, sf):
    return spark.createDataFrame(list(enumerate(discern.greedy_cover(_parts_of_suppliers(spark, sf)))), "pick int, set_id long")


@query(_cover_sql(f"{_LEFT} / s.cost", "desc", "1.0 + l_suppkey % 3"))
def d8_greedy_cover_cost(spark, sf):
    sets = _parts_of_suppliers(spark, sf)
    cost = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("set_id"), (1.0 + F.col("s_suppkey") % 3).alias("cost"))
    return spark.createDataFrame(list(enumerate(discern.greedy_cover(sets, cost=cost))), "pick int, set_id long")


@query("""with recursive s as (select l_suppkey id, list(distinct l_partkey) e from lineitem group by 1),
g as (select 0 as pick, -1::bigint as id, []::bigint[] as taken, []::bigint[] as covered union all select pick + 1, nid, list_append(taken, nid), list_distinct(list_concat(covered, e)) from (select g.pick, g.taken, g.covered, s.id nid, s.e,
row_number() over (partition by g.pick order by len(list_filter(s.e, lambda v: not list_contains(g.covered, v))), s.id) rn from g, s where g.pick < 3 and not list_contains(g.taken, s.id)) where rn = 1) select (pick - 1)::int as pick, id as set_id from g where pick > 0""")
def d9_min_union(spark, sf):
    sets = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("element"))
    return spark.createDataFrame(list(enumerate(discern.min_union(sets, 3))), "pick int, set_id long")


_ORDERS = ["o_orderstatus", "month", "bucket"]


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus", F.month("o_orderdate").alias("month"), F.floor(F.col("o_totalprice") / 50000).cast("int").alias("bucket"))


_ATTRS = "select o_orderpriority y, o_orderstatus a1, month(o_orderdate)::int a2, floor(o_totalprice / 50000)::int a3 from orders"


def keyed_sql(base: str) -> str:
    """CTEs of base (y, a1, a2, a3): b, t (rows by attribute mask, values on it and y), g (the same without y)."""
    key = "concat_ws('|', " + ", ".join(f"case when m & {1 << i} > 0 then a{i + 1}::varchar else '' end" for i in range(3)) + ")"
    return f"b as ({base}), t as (select m, {key} k, y, count(*) n from b, (select unnest(range(8)) m) group by all), g as (select m, k, sum(n) n, sum(n * n) q from t group by all)"


def _greedy_sql(base: str, goal: str, most: int, names: list[str], select: str) -> str:
    """Attributes added by the pairs of different y that they tell apart, while there are fewer than the goal; select reads st and told."""
    return f"""with recursive {keyed_sql(base)}, w as (select (sum(n) * sum(n) - sum(n * n)) / 2 v from (select count(*) n from b group by y)), told as (select m, (select v from w) - sum((n * n - q) / 2) v from g group by m),
st as (select 0 as pick, 0 as mask, 0 as bit, 0::double as done union all select pick + 1, mask | nbit, nbit, nv from (select st.*, xor(told.m, st.mask) nbit, told.v::double nv, row_number() over (partition by st.pick order by told.v desc, told.m) rn
from st, told where told.m & st.mask = st.mask and bit_count(xor(told.m, st.mask)) = 1 and st.pick < {most} and st.done < {goal}) where rn = 1 and nv > done),
named as (select pick - 1 as pick, {names!r}[bit_count(bit - 1) + 1] attr, done from st where pick > 0) {select}"""


@query(_greedy_sql(_ATTRS, "0.95 * (select v from told where m = 7)", 3, _ORDERS, "select pick::int as pick, attr from named"))
def d10_min_attributes(spark, sf):
    return spark.createDataFrame(list(enumerate(discern.min_attributes(_orders(spark, sf), _ORDERS, "o_orderpriority", 0.95))), "pick int, attr string")


def by_row_sql(base: str, names: list[str], tau: float) -> str:
    """CTEs up to fin: each distinct tuple (y, a1, a2, a3, n) with needed, its attribute list."""
    return f"""{keyed_sql(base)}, u as (select row_number() over () id, * from (select y, a1, a2, a3, count(*) n from b group by all)),
f as (select id, m, g.n - t.n agree from (select id, y, m, concat_ws('|', case when m & 1 > 0 then a1::varchar else '' end, case when m & 2 > 0 then a2::varchar else '' end, case when m & 4 > 0 then a3::varchar else '' end) k from u, (select unnest(range(8)) m)) x join t using (m, k, y) join g using (m, k)),
rec as (select id, 0 as step, 0 as mask, ''::varchar as needed, x.agree as lft, x.agree - {tau} * (x.agree - z.agree) as goal from f x join f z using (id) where x.m = 0 and z.m = 7
union all select id, step + 1, mask | nbit, needed || case when needed = '' then '' else ',' end || {names!r}[bit_count(nbit - 1) + 1], agree, goal from (select rec.*, xor(f.m, rec.mask) nbit, f.agree, row_number() over (partition by rec.id order by f.agree, f.m) rn
from rec join f on f.id = rec.id and f.m & rec.mask = rec.mask and bit_count(xor(f.m, rec.mask)) = 1 where rec.lft > rec.goal) where rn = 1 and agree < lft),
fin as (select u.*, l.needed from u join (select id, arg_max(needed, step) needed from rec group by 1) l using (id))"""


@query(f"with recursive {by_row_sql(_ATTRS, _ORDERS, 0.9)} select y as o_orderpriority, a1 as o_orderstatus, a2 as month, a3 as bucket, n, needed from fin")
def d11_min_attributes_by_row(spark, sf):
    out = discern.min_attributes_by_row(_orders(spark, sf), _ORDERS, "o_orderpriority", 0.9)
    return out.select("o_orderpriority", *_ORDERS, "n", F.concat_ws(",", "needed").alias("needed"))


@query(_greedy_sql(_ATTRS, "1e300", 2, _ORDERS, "select pick::int as pick, attr, ((select v from w) - (select max(done) from named))::long as lo from named"))
def d12_k_attributes(spark, sf):
    picked, left = discern.k_attributes(_orders(spark, sf), _ORDERS, "o_orderpriority", 2)
    return spark.createDataFrame([(i, a, left) for i, a in enumerate(picked)], "pick int, attr string, lo long")


@query(_greedy_sql(_ATTRS, "0.9 * (select v from told where m = 7)", 3, _ORDERS, "select count(*)::int as k from named"))
def d13_needed_attributes(spark, sf):
    return spark.createDataFrame([(discern.needed_attributes(_orders(spark, sf), _ORDERS, "o_orderpriority", 0.1),)], "k int")


@query("select p_brand, p_size, count(*) as n from part group by all")
def g1_contingency(spark, sf):
    return assoc.contingency(table(spark, sf, "part"), "p_brand", "p_size")


_MEASURES = measures_sql(_PART, "part")
_HIST = """v as (""" + " union all ".join(f"select '{c}' col, {c}::varchar v, count(*) n from part group by all" for c in _PART) + """),
h as (select col, row_number() over (partition by col order by n desc) k, n::double / max(n) over (partition by col) h from v), z as (select col, max(k) len from h group by 1),
hd as (select x.col x, y.col y, sum(abs(coalesce(a.h, 0) - coalesce(b.h, 0))) / greatest(max(x.len), max(y.len)) hdiff from z x join z y on x.col < y.col, (select unnest(range(1, 2000)) k) s left join h a on a.col = x.col and a.k = s.k left join h b on b.col = y.col and b.k = s.k group by all)"""


@query(f"with {_MEASURES} select x, y, round(sqrt(chi2 / n), 6) phi, round(sqrt(chi2 / (chi2 + n)), 6) cc, round(sqrt(chi2 / n / (least(nx, ny) - 1)), 6) v from m")
def g2_measures(spark, sf):
    out = assoc.measures(assoc.pair_counts(table(spark, sf, "part"), _PART))
    return out.select("x", "y", *(F.round(c, 6).alias(c) for c in ("phi", "cc", "v")))


@query(f"with {_MEASURES}, h as (select x, y, chi2, (nx - 1) * (ny - 1) / 2.0 a, chi2 / 2 h from m) select x, y, round(chi2, 6) as chi2, round(1 - {gamma_p('a', 'h', 6000)}, 6) as pp from h")
def g3_pearson_p(spark, sf):
    out = assoc.association_edges(table(spark, sf, "part"), _PART, p_value=T.chi2_tail)
    return out.select("x", "y", F.round("chi2", 6).alias("chi2"), F.round("pp", 6).alias("pp"))


@query(f"with {_MEASURES} select x, y, round((vy - gy) / vy, 6) pxy, round((vx - gx) / vx, 6) pyx from m")
def g4_variance_reduction(spark, sf):
    out = assoc.measures(assoc.pair_counts(table(spark, sf, "part"), _PART))
    return out.select("x", "y", F.round("pxy", 6).alias("pxy"), F.round("pyx", 6).alias("pyx"))


@query(f"with {_HIST} select x, y, round(hdiff, 6) hdiff from hd")
def g5_histogram_difference(spark, sf):
    return assoc.histogram_difference(assoc.value_counts(table(spark, sf, "part"), _PART)).select("x", "y", F.round("hdiff", 6).alias("hdiff"))


@query(f"""with s as (select rep, p_brand, p_type, p_size from part, (select unnest(range(1, 101)) rep) qualify row_number() over (partition by rep order by {u('p_partkey', 'rep')}, p_partkey) <= 50), {measures_sql(_PART, 's', 'rep')}
select x, y, round(median(sqrt(chi2 / n)), 6) as phi, round(median(case when least(nx, ny) > 1 then sqrt(chi2 / n / (least(nx, ny) - 1)) else 0 end), 6) as v from m group by all""")
def g6_repeated_measures(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", *_PART)
    out = assoc.repeated(df, lambda s, by: assoc.measures(assoc.pair_counts(s, _PART, by), by), 100, 50, ["p_partkey"], ["x", "y"])
    return out.select("x", "y", F.round("phi", 6).alias("phi"), F.round("v", 6).alias("v"))


@query(f"with {_MEASURES}, {_HIST} select m.x, m.y, round(sqrt(chi2 / n), 6) weight, round(sqrt(chi2 / (chi2 + n)), 6) cc, round((vy - gy) / vy, 6) pxy, round((vx - gx) / vx, 6) pyx, round(hdiff, 6) hdiff from m join hd on least(m.x, m.y) = hd.x and greatest(m.x, m.y) = hd.y")
def g7_association_edges(spark, sf):
    out = assoc.association_edges(table(spark, sf, "part"), _PART)
    return out.select("x", "y", *(F.round(c, 6).alias(c) for c in ("weight", "cc", "pxy", "pyx", "hdiff")))


@query("select name, array_to_string(list(printf('%.6f', p) order by p desc), ',') as freqs, round((1 - sum(p * p)) / 2, 6) as value from (" + " union all ".join(f"select '{c}' as name, count(*)::double / sum(count(*)) over () p from part group by {c}" for c in ("p_brand", "p_size")) + ") group by 1")
def g8_g9_vertices(spark, sf):
    # format_number rounds the double itself, as printf does; format_string rounds its shortest decimal, half up
    out = assoc.vertex_histograms(table(spark, sf, "part"), ["p_brand", "p_size"])
    return out.select("name", F.concat_ws(",", F.transform("freqs", lambda p: F.call_function("format_number", p, F.lit("0.000000")))).alias("freqs"), F.round("value", 6).alias("value"))


@query(f"with {_MEASURES}, d as (select x, y, (vy - gy) / vy pxy, (vx - gx) / vx pyx from m) select case when pxy >= pyx then x else y end as source, case when pxy >= pyx then y else x end as target, round(greatest(pxy, pyx, 0), 6) as weight from d")
def g10_directed_edges(spark, sf):
    out = assoc.directed_edges(assoc.measures(assoc.pair_counts(table(spark, sf, "part"), _PART)))
    return out.select("source", "target", F.round("weight", 6).alias("weight"))


@query(f"""with {_MEASURES}, t as (select x, y, sum(n) t from p group by all),
hx as (select x, y, -sum(m / t * log2(m / t)) h from (select x, y, a, sum(n) m from p group by all) join t using (x, y) group by all), hy as (select x, y, -sum(m / t * log2(m / t)) h from (select x, y, b, sum(n) m from p group by all) join t using (x, y) group by all),
hxy as (select x, y, -sum(n / t * log2(n / t)) h from p join t using (x, y) group by all)
select hx.x, hx.y, round(hx.h + hy.h - hxy.h, 6) gain, round((hx.h + hy.h - hxy.h) / hx.h, 6) gain_ratio from hx join hy using (x, y) join hxy using (x, y)""")
def g11_information_gain(spark, sf):
    out = assoc.information_gain(assoc.pair_counts(table(spark, sf, "part"), _PART))
    return out.select("x", "y", F.round("gain", 6).alias("gain"), F.round("gain_ratio", 6).alias("gain_ratio"))


def _balance(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal").cast("double") / 5000).alias("x"))


@query("select c_custkey, round(exp(-x * x / 2) / sqrt(2 * pi()), 9) as d, round(case when x > 0 then exp(-ln(x) * ln(x) / 2) / sqrt(2 * pi()) / x else 0 end, 9) as dl from (select c_custkey, c_acctbal::double / 5000 x from customer)")
def t1_t2_densities(spark, sf):
    return _balance(spark, sf).select("c_custkey", F.round(T.dnorm(F.col("x")), 9).alias("d"), F.round(T.dlnorm(F.col("x")), 9).alias("dl"))


@query(f"""with c as (select c_custkey, c_acctbal::double / 5000 x from customer), d as (select c_custkey, x, greatest(x, 0) g, least(greatest(x / 2, 0), 1) b, case when x > 0 then ln(x) end l, atan(x / sqrt(7)) o from c)
select c_custkey, round({pnorm('x')}, 9) as pnorm, round(case when x > 0 then {pnorm('l')} else 0 end, 9) as plnorm, round(6 * b * b * (1 - b) * (1 - b) + 4 * b * b * b * (1 - b) + b * b * b * b, 9) as pbeta,
round(0.5 + (o + sin(o) * cos(o) * (1 + 2.0 / 3 * cos(o) * cos(o) + 8.0 / 15 * pow(cos(o), 4))) / pi(), 9) as pt, round({gamma_p('2.5', 'g')}, 9) as pgamma from d""")
def t1_t5_cumulative(spark, sf):
    x = F.col("x")
    return _balance(spark, sf).select("c_custkey", F.round(T.pnorm(x), 9).alias("pnorm"), F.round(T.plnorm(x), 9).alias("plnorm"), F.round(T.pbeta(x / 2, 2.0, 3.0), 9).alias("pbeta"), F.round(T.pt(x, 7.0), 9).alias("pt"), F.round(T.pgamma(F.greatest(x, F.lit(0.0)), 2.5), 9).alias("pgamma"))


@query("select c_custkey, round(case when b > 0 and b < 1 then 12 * b * (1 - b) * (1 - b) else 0 end, 9) as dbeta, round(case when x > 0 then x * exp(-x) else 0 end, 9) as dgamma, round(3.0 / (8.0 * pow(1 + x * x / 4, 2.5)), 9) as dt from (select c_custkey, c_acctbal::double / 5000 x, c_acctbal::double / 10000 b from customer)")
def t3_t5_densities(spark, sf):
    x = F.col("x")
    return _balance(spark, sf).select("c_custkey", F.round(T.dbeta(x / 2, 2.0, 3.0), 9).alias("dbeta"), F.round(T.dgamma(x, 2.0), 9).alias("dgamma"), F.round(T.dt(x, 4.0), 9).alias("dt"))


@query(f"""with recursive v as (select distinct c_custkey % 99 / 100.0 + 0.01 p from customer), z as (select 0 as k, p::double p, -10::double lo, 10::double hi from v
union all select k + 1, p, case when below then (lo + hi) / 2 else lo end, case when below then hi else (lo + hi) / 2 end from (select *, {pnorm('((lo + hi) / 2)')} < p as below from z where k < 60))
select c_custkey, round(hi, 6) as q from customer join (select * from z where k = 60) on abs(p - (c_custkey % 99 / 100.0 + 0.01)) < 1e-9""")
def t6_quantile(spark, sf):
    p = F.pmod("c_custkey", F.lit(99)) / 100 + 0.01
    return _balance(spark, sf).select("c_custkey", F.round(T.quantile(p, T.norm_cdf, -10, 10), 6).alias("q"))


@query("select c_custkey, trunc(x)::long as t, round(case when x = 0 then 0 else round(x * pow(10, 2 - floor(log10(abs(x))))) / pow(10, 2 - floor(log10(abs(x)))) end, 9) as s from (select c_custkey, c_acctbal::double / 5000 x from customer)")
def t7_rounding(spark, sf):
    return _balance(spark, sf).select("c_custkey", T.truncate(F.col("x")).cast("long").alias("t"), F.round(T.to_sig_fig(F.col("x"), 3), 9).alias("s"))
