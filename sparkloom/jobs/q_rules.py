"""Queries of rules, fuzzy inference, matching and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.jobs.catalog import measures_sql, query, table
from sparkloom.jobs.q_columns import by_row_sql
from sparkloom.operators import assoc, fuzzy, matching, rules
from sparkloom.operators.helpers import distinct_rows, materialize, step_path, unpivot
from sparkloom.sources import arff, text_tables

_ATTRS = ["o_orderstatus", "month", "band"]


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.month("o_orderdate").cast("string").alias("month"), F.floor(F.col("o_totalprice") / 100000).cast("string").alias("band"))


#: rules made from the table: the most frequent priority of each status and band, and of each band
_RULE_ROWS = """k as (select o_orderstatus s, floor(o_totalprice / 100000)::long::varchar b, o_orderpriority p, count(*) n from orders group by all),
one as (select s, b, p from (select *, row_number() over (partition by s, b order by n desc, p) rn from k) where rn = 1), two as (select b, p from (select b, p, row_number() over (partition by b order by sum(n) desc, p) rn from k group by b, p) where rn = 1)"""


def _rules(spark, sf):
    k = _orders(spark, sf).groupBy(F.col("o_orderstatus").alias("s"), F.col("band").alias("b"), F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    one = k.withColumn("rn", F.row_number().over(Window.partitionBy("s", "b").orderBy(F.desc("n"), "p"))).filter("rn = 1")
    two = k.groupBy("b", "p").agg(F.sum("n").alias("n")).withColumn("rn", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "p"))).filter("rn = 1")
    a = one.select(F.create_map(F.lit("o_orderstatus"), "s", F.lit("band"), "b").alias("antecedent"), F.col("p").alias("outcome"))
    b = two.select(F.create_map(F.lit("band"), "b").alias("antecedent"), F.col("p").alias("outcome"))
    return rules.distinct_rules(a.unionByName(b))


@query("select o_orderpriority as outcome, round(count(*)::double / (select count(*) from orders), 9) as prior from orders group by 1")
def r1_class_priors(spark, sf):
    return rules.class_priors(_orders(spark, sf), "o_orderpriority").select("outcome", F.round("prior", 9).alias("prior"))


@query("select o_orderpriority, floor(0.3 * count(*))::long as n from orders group by 1")
def r2_stratified_split(spark, sf):
    out = rules.stratified_split(_orders(spark, sf), "o_orderpriority", ["o_orderkey"])
    return out.filter("held").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


_TUPLES = "select o_orderpriority y, o_orderstatus a1, month(o_orderdate)::varchar a2, floor(o_totalprice / 100000)::long::varchar a3 from orders"


@query(f"""with recursive {by_row_sql(_TUPLES, _ATTRS, 0.9)}, l as (select *, string_split(needed, ',') w from fin where needed <> '')
select distinct y as outcome, concat_ws(' & ', case when list_contains(w, 'band') then 'band=' || a3 end, case when list_contains(w, 'month') then 'month=' || a2 end, case when list_contains(w, 'o_orderstatus') then 'o_orderstatus=' || a1 end) || ' => class=' || y as rule from l""")
def r3_r4_induce_rules(spark, sf):
    return rules.format_rules(rules.induce_rules(_orders(spark, sf), _ATTRS, "o_orderpriority", 0.9))


_FULL = f"{_RULE_ROWS}, pt as (select o_orderkey, o_orderstatus s, floor(o_totalprice / 100000)::long::varchar b from orders)"


@query(f"with {_FULL} select outcome, count(*) as n from (select o_orderkey, one.p as outcome from pt join one using (s, b) union all select o_orderkey, two.p from pt join two using (b)) group by 1")
def r5_apply_rules(spark, sf):
    points = distinct_rows(_orders(spark, sf), _ATTRS)
    hit = rules.strengths(rules.apply_rules(points, _rules(spark, sf), "tuple", _ATTRS), "tuple")
    return hit.filter("strength = 1").join(points, "tuple").groupBy("outcome").agg(F.sum("n").alias("n"))


_CLASSIFY = f"""with {_FULL}, hits as (select o_orderkey, one.p outcome, 1.0 strength from pt join one using (s, b) union all select o_orderkey, two.p, 1.0 from pt join two using (b)),
sums as (select o_orderkey, outcome, sum(strength) strength from hits group by all), n as (select *, strength / sum(strength) over (partition by o_orderkey) v from sums)"""


# rules of one status and two bands only: the other points match in part or not at all
@query(f"""with {_FULL}, fewer as (select * from one where s = 'F' and b in ('0', '1')), met as (select o_orderkey, p, (pt.s = f.s)::int + (pt.b = f.b)::int hit from pt join fewer f on pt.s = f.s or pt.b = f.b),
per as (select o_orderkey, p as outcome, sum((hit = 2)::int::double) f, sum(1 / (1 + pow(2 - hit, 2))) h from met group by all), best as (select *, max(f) over (partition by o_orderkey) mf from per),
got as (select o_orderkey, outcome, case when mf > 0 then f else h end v from best where case when mf > 0 then f else h end > 0),
every as (select * from got union all select o_orderkey, outcome, prior from pt anti join got using (o_orderkey), (select o_orderpriority as outcome, count(*)::double / (select count(*) from orders) prior from orders group by 1))
select o_orderkey, outcome, round(v / sum(v) over (partition by o_orderkey), 9) as strength from every""")
def r6_r7_classify(spark, sf):
    df = _orders(spark, sf)
    fewer = _rules(spark, sf).filter("antecedent['o_orderstatus'] = 'F' and antecedent['band'] in ('0', '1')")
    points = distinct_rows(df, _ATTRS)
    scored = rules.strengths(rules.apply_rules(points, fewer, "tuple", _ATTRS), "tuple")
    out = rules.of_rows(df, points, rules.classify(points, scored, rules.class_priors(df, "o_orderpriority"), "tuple"), "o_orderkey", _ATTRS)
    return out.select("o_orderkey", "outcome", F.round("strength", 9).alias("strength"))


@query(f"{_CLASSIFY} select outcome, count(*) as n from (select o_orderkey, outcome, row_number() over (partition by o_orderkey order by strength desc, outcome desc) rn from n) where rn = 1 group by 1")
def r8_call(spark, sf):
    df = _orders(spark, sf)
    points = distinct_rows(df, _ATTRS)
    scored = rules.strengths(rules.apply_rules(points, _rules(spark, sf), "tuple", _ATTRS), "tuple")
    out = rules.call(rules.classify(points, scored, rules.class_priors(df, "o_orderpriority"), "tuple"), "tuple")
    return out.join(points, "tuple").groupBy("outcome").agg(F.sum("n").alias("n"))


@query(f"{_CLASSIFY}, v as (select o_orderkey, max((outcome = '1-URGENT')::int)::double u, max((outcome = '5-LOW')::int)::double l from hits group by 1) select sum(u) as urgent, sum(l) as low from v")
def r9_vote(spark, sf):
    points = distinct_rows(_orders(spark, sf), _ATTRS)
    scored = rules.strengths(rules.apply_rules(points, _rules(spark, sf), "tuple", _ATTRS), "tuple").filter("strength > 0")
    out = rules.vote(points, scored, "tuple", ["1-URGENT", "5-LOW"]).join(points, "tuple")
    return out.agg(F.sum(F.col("1-URGENT") * F.col("n")).alias("urgent"), F.sum(F.col("5-LOW") * F.col("n")).alias("low"))


# rules with their text, points collapsed to (status, band, priority), and the rules that hold for each
_HITS = f"""{_RULE_ROWS}, ru as (select 'band=' || b || ' & o_orderstatus=' || s as ante, s, b, p from one union all select 'band=' || b, null, b, p from two), rn as (select *, ante || ' => ' || p as name from ru),
pc as (select row_number() over () c, * from (select o_orderstatus s, floor(o_totalprice / 100000)::long::varchar b, o_orderpriority y, count(*) n from orders group by all)),
hit as (select c, name, p, n, case when p = y then 1 else -1 end sign from pc join rn on rn.b = pc.b and (rn.s is null or rn.s = pc.s))"""


@query(f"""with recursive {_HITS}, good as (select name, list(c) e from hit where sign = 1 group by 1), t as (select count(distinct c) n from hit where sign = 1),
g as (select 0 as step, ''::varchar as name, []::bigint[] as covered union all select step + 1, nn, list_distinct(list_concat(covered, e)) from (select g.step, g.covered, x.name nn, x.e, row_number() over (partition by g.step order by x.gain desc, x.name) rn
from g, lateral (select good.name, good.e, (select coalesce(sum(pc.n), 0) from pc where list_contains(good.e, pc.c) and not list_contains(g.covered, pc.c)) gain from good) x where len(g.covered) < (select n from t)) where rn = 1)
select p as outcome, ante || ' => class=' || p as rule from rn where name in (select name from g)""")
def r10_filter_rules(spark, sf):
    df, r = _orders(spark, sf), materialize(_rules(spark, sf))
    scored = materialize(rules.strengths(rules.apply_rules(df, r, "o_orderkey", _ATTRS), "o_orderkey"))
    return rules.format_rules(rules.filter_rules(r, scored, df, "o_orderkey", "o_orderpriority"))


@query(f"""with recursive {_HITS}, sz as (select p, count(*) k, (select count(*) from rn) total from rn group by 1), qu as (select p, ceil(10.0 * (total - k)) q from sz),
g as (select 0 as step, []::varchar[] as picks, (select list(c) from (select c from hit group by c having sum(sign) > 0)) as lft, (select list(p) from qu where q > 0) as op
union all select step + 1, list_append(picks, nn), coalesce((select list(c) from (select c from hit where list_contains(lft, c) group by c having sum(case when list_contains(picks, name) or name = nn then sign else 0 end) <= 0)), []), list_filter(op, lambda v: v <> np)
from (select g.step, g.picks, g.lft, g.op, x.name nn, x.p np, row_number() over (partition by g.step order by x.gain desc, x.name desc) rn from g, lateral (select rn.name, rn.p, (select coalesce(sum(hit.n * hit.sign), 0) from hit where hit.name = rn.name and list_contains(g.lft, hit.c))
+ case when list_contains(g.op, rn.p) then (select q from qu where qu.p = rn.p) else 0 end gain from rn) x where not list_contains(g.picks, x.name) and x.gain >= 0 and (len(g.op) > 0 or len(g.lft) > 0)) where rn = 1)
select p as outcome, ante || ' => class=' || p as rule from rn where list_contains((select arg_max(picks, step) from g), name)""")
def r11_filter_rules_weighted(spark, sf):
    df, r = _orders(spark, sf), materialize(_rules(spark, sf))
    scored = materialize(rules.strengths(rules.apply_rules(df, r, "o_orderkey", _ATTRS), "o_orderkey"))
    return rules.format_rules(rules.filter_rules_weighted(r, scored, df, "o_orderkey", "o_orderpriority"))


@query(f"with {_RULE_ROWS} select p as outcome, 'band=' || b || ' & o_orderstatus=' || s || ' => class=' || p as rule from one union select p, 'band=' || b || ' => class=' || p from two")
def r12_format_rules(spark, sf):
    return rules.format_rules(_rules(spark, sf))


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), *(F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_extendedprice")), "l_returnflag")


@query()
def r13_fuzzy_classifier(spark, sf):
    df = _lines(spark, sf)
    model = rules.fit_fuzzy_classifier(df, ["l_quantity", "l_discount"], "l_returnflag", 3)
    out = rules.apply_fuzzy_classifier(model, df, "id")
    return out.agg(F.count("*").alias("points"), *(F.round(F.sum(c), 4).alias(c) for c in model["classes"]))


@query()
def r14_tree_classifier(spark, sf):
    df = _lines(spark, sf)
    apply, _ = rules.fit_tree_classifier(df, ["l_quantity", "l_discount", "l_extendedprice"], "l_returnflag", 3)
    return apply(df).groupBy("predicted").agg(F.count("*").alias("n"))


_SETS = {("q", "low"): (float("-inf"), 1.0, 25.0), ("q", "mid"): (1.0, 25.0, 50.0), ("q", "high"): (25.0, 50.0, float("inf")), ("d", "none"): (float("-inf"), 0.0, 0.05), ("d", "deep"): (0.0, 0.1, float("inf"))}
_FUZZY = [("small", {"q": "low"}, [1.0, 0.5, 0.0]), ("usual", {"q": "mid", "d": "none"}, [0.0, 1.0, 0.0]), ("large", {"q": "high", "d": "deep"}, [0.0, 0.25, 1.0])]
_CLIP = "least(greatest({}, 0), 1)"
_FIRE = f"""f as (select l_orderkey, l_linenumber, 1 - {_CLIP.format('(l_quantity - 1) / 24.0')} small,
least(least({_CLIP.format('(l_quantity - 1) / 24.0')}, 1 - {_CLIP.format('(l_quantity - 25) / 25.0')}), 1 - {_CLIP.format('l_discount / 0.05')}) usual, least({_CLIP.format('(l_quantity - 25) / 25.0')}, {_CLIP.format('l_discount / 0.1')}) large from (select l_orderkey, l_linenumber, l_quantity::double l_quantity, l_discount::double l_discount from lineitem)),
o as (select *, greatest(least(small, 1.0), least(usual, 0.0), least(large, 0.0)) y1, greatest(least(small, 0.5), least(usual, 1.0), least(large, 0.25)) y2, greatest(least(small, 0.0), least(usual, 0.0), least(large, 1.0)) y3 from f)"""


def _inputs(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("d"))


@query(f"with {_FIRE} select l_orderkey, l_linenumber, round(case when y1 + y2 + y3 > 0 then (y1 + 2 * y2 + 3 * y3) / (y1 + y2 + y3) else 0 end, 6) as cog from o")
def f1_f2_f3_inference(spark, sf):
    out = fuzzy.centre_of_gravity(fuzzy.infer(_inputs(spark, sf), _FUZZY, _SETS), [1, 2, 3])
    return out.select("l_orderkey", "l_linenumber", F.round("cog", 6).alias("cog"))


@query(f"with {_FIRE}, l as (unpivot f on small, usual, large into name rule value strength) select rule, count(*) filter (strength > 0) as activations, round(max(case when strength > 0 then strength end), 6) as strongest, min(case when strength > 0 then l_orderkey end) as first_round from l group by 1")
def f4_f5_activations(spark, sf):
    log = fuzzy.activation_log(fuzzy.firing(_inputs(spark, sf), _FUZZY, _SETS), "l_orderkey")
    return fuzzy.activation_summary(log).withColumn("strongest", F.round("strongest", 6))


@query(f"with {_FIRE} select l_orderkey as round, round(sum(small), 6) as small, round(sum(usual), 6) as usual, round(sum(large), 6) as large from f group by 1")
def f6_activation_matrix(spark, sf):
    log = fuzzy.activation_log(fuzzy.firing(_inputs(spark, sf), _FUZZY, _SETS), "l_orderkey")
    return fuzzy.activation_matrix(log, ["small", "usual", "large"]).select("round", *(F.round(c, 6).alias(c) for c in ("small", "usual", "large")))


_COLS = ["o_orderstatus", "o_orderpriority", "month", "band"]


def _graph(spark, sf):
    df = _orders(spark, sf)
    return materialize(assoc.association_edges(df, _COLS).select("x", "y", "weight")), materialize(assoc.vertex_histograms(df, _COLS).select("name", "value"))


_GRAPH = f"""o as (select o_orderstatus, o_orderpriority, month(o_orderdate)::varchar as month, floor(o_totalprice / 100000)::long::varchar as band from orders), {measures_sql(_COLS, 'o')},
ve as (select name, (1 - sum(f * f)) / 2 v from ({' union all '.join(f"select '{c}' as name, count(*)::double / sum(count(*)) over () f from o group by {c}" for c in _COLS)}) group by 1),
e1 as (select x, y, sqrt(chi2 / n) w from m), ed as (select * from e1 union all select y, x, w from e1), sim as (select a.name x, b.name y, 1 - abs(a.v - b.v) sim from ve a, ve b)"""


@query(f"with {_GRAPH} select x, y, round(sim, 9) as sim from sim")
def m1_vertex_similarity(spark, sf):
    _, v = _graph(spark, sf)
    return matching.vertex_similarity(v, v).withColumn("sim", F.round("sim", 9))


_TREES = [[("band", -1), ("o_orderstatus", 0), ("month", 0)], [("month", -1), ("o_orderpriority", 0)]]


# both trees by joins: their best mappings, a row for each pair they map
_MATCH = f"""{_GRAPH}, t3 as (select a.y p0, b.y p1, c.y p2, a.sim + b.sim + c.sim + 2 - abs((select w from ed where x = 'band' and y = 'o_orderstatus') - f.w) - abs((select w from ed where x = 'band' and y = 'month') - g.w) score
from sim a join ed f on f.x = a.y join ed g on g.x = a.y join sim b on b.y = f.y join sim c on c.y = g.y where a.x = 'band' and b.x = 'o_orderstatus' and c.x = 'month' and f.y <> g.y),
t2 as (select a.y p0, b.y p1, a.sim + b.sim + 1 - abs((select w from ed where x = 'month' and y = 'o_orderpriority') - f.w) score from sim a join ed f on f.x = a.y join sim b on b.y = f.y where a.x = 'month' and b.x = 'o_orderpriority'),
b3 as (select * from t3 where score >= (select max(score) from t3) - 1e-9), b2 as (select * from t2 where score >= (select max(score) from t2) - 1e-9)"""


@query(f"""with {_MATCH} select a, b, round(sum(score), 9) as weight from (select 'band' a, p0 b, score from b3 union all select 'o_orderstatus', p1, score from b3 union all select 'month', p2, score from b3
union all select 'month', p0, score from b2 union all select 'o_orderpriority', p1, score from b2) group by all""")
def m2_m4_graph_match(spark, sf):
    e, v = _graph(spark, sf)
    sim = materialize(matching.vertex_similarity(v, v))
    return matching.graph_match(_TREES, lambda t: matching.match_colored(t, e, e, sim)).withColumn("weight", F.round("weight", 9))


@query(f"with {_MATCH} select concat_ws(',', p0, p1, p2) as path, round(score, 9) as score from b3")
def m3_match_exact(spark, sf):
    e, v = _graph(spark, sf)
    out = matching.match_exact(_TREES[0], e, e, materialize(matching.vertex_similarity(v, v)))
    return out.select(F.concat_ws(",", "path").alias("path"), F.round("score", 9).alias("score"))


@query(f"with {_GRAPH} select x, string_agg(y, ',' order by y) as neighbours from ed where w <> 0 group by 1")
def m5_neighbours(spark, sf):
    return matching.neighbours(_graph(spark, sf)[0]).select("x", F.concat_ws(",", "neighbours").alias("neighbours"))


def _renamed(spark, sf):
    w = _orders(spark, sf)
    return w.select("o_orderkey", *(F.concat(F.lit("v_"), c).alias(c) for c in ("o_orderstatus", "o_orderpriority", "band"))), w


_VCOLS = ["o_orderstatus", "o_orderpriority", "band"]


@query("""with w as (select 'o_orderstatus' col, o_orderstatus v, count(*)::double / (select count(*) from orders) f from orders group by 2 union all select 'o_orderpriority', o_orderpriority, count(*)::double / (select count(*) from orders) from orders group by 2 union all select 'band', floor(o_totalprice / 100000)::long::varchar, count(*)::double / (select count(*) from orders) from orders group by 2)
select x.col, 'v_' || x.v as a, y.v as b, round(1 - abs(x.f - y.f), 9) as w from w x join w y using (col)""")
def m6_value_graph(spark, sf):
    return matching.init_value_graph(*_renamed(spark, sf), _VCOLS).withColumn("w", F.round("w", 9))


# a column's own values have a map of weight 1 each, so the best one is the one that loses nothing; equal frequencies may swap
@query("""with w as (select 'o_orderstatus' col, o_orderstatus v, count(*) n from orders group by 2 union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by 2 union all select 'band', floor(o_totalprice / 100000)::long::varchar, count(*) from orders group by 2)
select x.col, x.n as a_rows, y.n as b_rows, count(*) as pairs from w x join w y on x.col = y.col and x.v = y.v group by all""")
def m7_value_map(spark, sf):
    v, w = _renamed(spark, sf)
    maps = materialize(matching.best_value_map(matching.init_value_graph(v, w, _VCOLS)))
    count = lambda df, side: unpivot(df, [], _VCOLS).groupBy(F.col("col"), F.col("value").alias(side)).agg(F.count("*").alias(f"{side}_rows"))
    return maps.join(count(v, "a"), ["col", "a"]).join(count(w, "b"), ["col", "b"]).groupBy("col", "a_rows", "b_rows").agg(F.count("*").alias("pairs"))


# any number of values: both sides have as many, so the places by frequency and value decide
_RANKED = " union all ".join(f"select '{c}' col, {{0}} v, row_number() over (order by count(*), {{0}}) place from lineitem group by {c}".replace("{0}", "{" + c + "}") for c in ("l_partkey", "l_suppkey", "l_orderkey"))
_PLAIN = {c: f"{c}::varchar" for c in ("l_partkey", "l_suppkey", "l_orderkey")}


@query(f"with x as ({_RANKED.format(**_PLAIN)}), y as ({_RANKED.format(**{c: f'md5({t})' for c, t in _PLAIN.items()})}) select col, x.v as a, y.v as b from x join y using (col, place)")
def m6_m7_frequency_map(spark, sf):
    v = table(spark, sf, "lineitem").select(*(F.col(c).cast("string").alias(c) for c in _PLAIN))
    return matching.frequency_map(v, v.select(*(F.md5(c).alias(c) for c in _PLAIN)), list(_PLAIN))


@query("select o_orderstatus, count(*) as n from orders group by 1")
def m8_translate(spark, sf):
    v, w = _renamed(spark, sf)
    maps = materialize(matching.best_value_map(matching.init_value_graph(v, w, ["o_orderstatus"])))
    return matching.translate(v, maps, ["o_orderstatus"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


# distinct tuples with their rows; c: values of each column, q: pairs of values; p: mean probability of b beside the own value a
_PREDICTED = """o as (select row_number() over () k, * from (select o_orderstatus s, o_orderpriority r, floor(o_totalprice / 100000)::long::varchar z, count(*) n from orders group by all)),
l as (select k, n, 'o_orderstatus' col, s v from o union all select k, n, 'o_orderpriority', r from o union all select k, n, 'band', z from o), c as (select col, v b, sum(n) n from l group by all), t as (select col, count(*) kk, sum(n) nn from c group by 1), f as (select t.col, sum(u.kk) f from t join t u on t.col <> u.col group by 1),
q as (select x.col, x.v b, y.col x, y.v, sum(x.n) n from l x join l y on x.k = y.k and x.col <> y.col group by all), d as (select c.*, ln(n + 1) - ln(nn + kk) as start, ln(d + f) as step from c join t using (col) join f using (col) join (select col, b, sum(n) d from q group by all) using (col, b)),
s as (select l.k, d.col, d.b, max(l.n) n, max(start) + sum(ln(coalesce(q.n, 0) + 1)) - 2 * max(step) s from l join d on l.col <> d.col left join q on q.col = d.col and q.b = d.b and q.x = l.col and q.v = l.v group by all),
e as (select *, exp(s - max(s) over (partition by k, col)) e from s), h as (select *, e / sum(e) over (partition by k, col) h from e), p as (select h.col, l.v a, h.b, sum(h.h * h.n) / sum(h.n) p from h join l on h.k = l.k and h.col = l.col group by all)"""


def _triples(spark, sf):
    v, w = _renamed(spark, sf)
    return v, w, matching.value_triples(v, w, matching.value_model(w, _VCOLS), _VCOLS, "o_orderkey")


@query(f"with {_PREDICTED} select col, 'v_' || a as a, b, round(p, 6) as p from p")
def m9_predictors(spark, sf):
    return _triples(spark, sf)[2].select("col", "a", "b", F.round("p", 6).alias("p"))


@query(f"with {_PREDICTED} select col, 'v_' || a as a, b, round(0.75 * (1 - abs(x.n - y.n) / (select sum(n) from o)) + 0.25 * p, 6) as w from p join (select col, b as a, n from c) x using (col, a) join c y using (col, b)")
def m10_update_value_graph(spark, sf):
    v, w, triples = _triples(spark, sf)
    return matching.update_value_graph(matching.init_value_graph(v, w, _VCOLS), triples, 0.25).withColumn("w", F.round("w", 6))


# predicted values of the table itself, by column; a column's share of right first guesses is its run
@query(f"with {_PREDICTED}, g as (select k, col, n, max_by(b, {{'p': round(h, 9), 'b': b}}) b from h group by all), r as (select g.col, sum(case when b = v then g.n else 0 end)::double / sum(g.n) share from g join l using (k, col) group by 1) select 'all' as setting, round(avg(share), 6) as mean, round(stddev_samp(share), 6) as sd from r")
def m12_mapping_report(spark, sf):
    _, w = _renamed(spark, sf)
    rows = distinct_rows(w, _VCOLS)
    p = matching.predict_values(rows, matching.value_model(w, _VCOLS), _VCOLS, "tuple")
    first = p.groupBy("tuple", "col").agg(F.max_by("b", F.struct(F.round("p", 9), "b")).alias("b")).join(unpivot(rows, ["tuple", "n"], _VCOLS), ["tuple", "col"])
    found = matching.mapping_report(first.select(F.lit("all").alias("setting"), F.col("col").alias("run"), (F.col("b") == F.col("value")).alias("right"), "n"), weight="n")
    return found.select("setting", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query()
def m9_m12_recover_values(spark, sf):
    v, w = _renamed(spark, sf)
    found = matching.recover_values(v, w, _VCOLS, "o_orderkey")
    right = found.select(F.lit("all").alias("setting"), F.col("col").alias("run"), (F.col("a") == F.concat(F.lit("v_"), F.col("b"))).alias("right"))
    return matching.mapping_report(right)


@query("select p_partkey, p_size, p_brand from part")
def s1_s2_text_table(spark, sf):
    text_tables.write_table(table(spark, sf, "part").select("p_partkey", "p_size", "p_brand"), path := step_path(spark))
    return text_tables.read_table(spark, path)


@query("""select c_custkey::double as c_custkey, case when c_custkey % 7 = 0 then null else c_mktsegment end as c_mktsegment, c_nationkey::double as c_nationkey, timestamp '2020-01-01 00:00:00' + to_seconds(c_custkey) as seen, false as sparse from customer
union all select c_custkey::double, case when c_custkey % 7 = 0 then null else c_mktsegment end, c_nationkey::double, timestamp '2020-01-01 00:00:00' + to_seconds(c_custkey), true from customer""")
def s3_s4_arff(spark, sf):
    seen = F.timestamp_seconds(F.col("c_custkey") + 1577836800)
    segment = F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment"))
    df = table(spark, sf, "customer").select("c_custkey", segment.alias("c_mktsegment"), "c_nationkey", seen.alias("seen"))
    out = None
    for sparse in (False, True):
        arff.write_arff(df, path := step_path(spark), "customers", sparse, "written and read back")
        part = arff.read_arff(spark, path)[3].withColumn("sparse", F.lit(sparse))
        out = part if out is None else out.unionByName(part)
    return out


@query("with n as (select row_number() over (order by p_partkey) - 1 as i, p_size, p_retailprice::double r from part) select i::int as i, 0 as j, p_size::double as w from n union all select i::int, 1, r from n")
def s5_matrix(spark, sf):
    df = table(spark, sf, "part").orderBy("p_partkey").select("p_size", F.col("p_retailprice").cast("double").alias("r"))
    df.write.csv(path := step_path(spark))
    return text_tables.read_matrix(spark, path)


def _pivoted(select: str) -> str:
    return ", ".join(f"round(coalesce(max(case when {select} = '{c}' then w end), 0), 9) as {c}" for c in sorted(_COLS))


@query(f"with {_GRAPH} select x, {_pivoted('y')} from ed group by 1")
def s6_adjacency(spark, sf):
    return text_tables.adjacency(_graph(spark, sf)[0]).select("x", *(F.round(c, 9).alias(c) for c in sorted(_COLS)))


@query("with v as (select c_mktsegment as name, round(count(*)::double / (select count(*) from customer), 9) as value from customer group by 1) select 'vertex' as part, name as x, name as y, value from v union all select 'edge', name, 'to ' || name, 2 * value from v")
def s7_graph_tables(spark, sf):
    v = matching.frequencies(table(spark, sf, "customer"), ["c_mktsegment"]).select(F.col("value").alias("name"), F.round("f", 9).alias("value"))
    text_tables.write_graph(v, v.select(F.col("name").alias("x"), F.concat(F.lit("to "), "name").alias("y"), (2 * F.col("value")).alias("weight")), path := step_path(spark))
    v, e = text_tables.read_graph(spark, path)
    return v.select(F.lit("vertex").alias("part"), F.col("name").alias("x"), F.col("name").alias("y"), "value").unionByName(e.select(F.lit("edge").alias("part"), "x", "y", F.col("weight").alias("value")))


@query(f"""with {_GRAPH} select 0 as "row", {", ".join(f"round(max(case when name = '{c}' then v end), 9) as {c}" for c in sorted(_COLS))} from ve
union all select list_position({sorted(_COLS)!r}, x)::int, {_pivoted('y')} from ed group by x""")
def s8_graph_matrix(spark, sf):
    e, v = _graph(spark, sf)
    return text_tables.graph_matrix(v, e).select("row", *(F.round(c, 9).alias(c) for c in sorted(_COLS)))
