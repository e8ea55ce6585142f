"""Queries of evaluation, sampling, sequences and private release."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sparkloom.functions import distributions as T
from sparkloom.jobs.catalog import SECRET, cindex_sql, gamma_p, keyed, newton_sql, pnorm, query, table, u, whole_noise
from sparkloom.operators import evaluate, release, sampling


def _scored(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), "quality", F.length(F.regexp_replace("text", "[^ ]", "")).cast("double").alias("spaces"))


_CI = """with s as (select n_chars::double p, quality y from documents join labels using (doc_id)), g as (select p, sum(y)::double ones, sum(1 - y)::double zeros from s group by 1),
r as (select *, sum(zeros) over (order by p) - zeros b0, sum(ones) over () - sum(ones) over (order by p) a1, sum(ones) over () n1, sum(zeros) over () n0 from g),
q as (select sum(ones * (b0 + zeros / 2)) / (max(n0) * max(n1)) c, sum(zeros * (a1 * a1 + a1 * ones + ones * ones / 3)) / (max(n0) * max(n1) * max(n1)) q1, sum(ones * (b0 * b0 + b0 * zeros + zeros * zeros / 3)) / (max(n1) * max(n0) * max(n0)) q2, max(n0) n0, max(n1) n1 from r)"""


@query(f"""{_CI} select round(greatest(c, 1 - c), 9) cindex, round(sqrt((c * (1 - c) + (n1 - 1) * (q1 - c * c) + (n0 - 1) * (q2 - c * c)) / (n0 * n1)), 9) se, round(sqrt(c * (1 - c) / least(n0, n1)), 9) seb, round(abs(c - 0.5) / sqrt((n0 + n1 + 1) / (12 * n0 * n1)), 6) z from q""")
def e1_cindex(spark, sf):
    out = evaluate.cindex(_scored(spark, sf), "n_chars", "quality")
    return out.select(F.round("cindex", 9).alias("cindex"), F.round("se", 9).alias("se"), F.round("seb", 9).alias("seb"), F.round("z", 6).alias("z"))


def _ci_sql(name: str, score: str) -> str:
    """CTE name: c and se of a score in s."""
    return f"""{name}g as (select {score} p, sum(y)::double ones, sum(1 - y)::double zeros from s group by 1), {name}r as (select *, sum(zeros) over (order by p) - zeros b0, sum(ones) over () - sum(ones) over (order by p) a1, sum(ones) over () n1, sum(zeros) over () n0 from {name}g),
{name}q as (select sum(ones * (b0 + zeros / 2)) / (max(n0) * max(n1)) c, sum(zeros * (a1 * a1 + a1 * ones + ones * ones / 3)) / (max(n0) * max(n1) * max(n1)) q1, sum(ones * (b0 * b0 + b0 * zeros + zeros * zeros / 3)) / (max(n1) * max(n0) * max(n0)) q2, max(n0) n0, max(n1) n1 from {name}r),
{name} as (select greatest(c, 1 - c) c, sqrt((c * (1 - c) + (n1 - 1) * (q1 - c * c) + (n0 - 1) * (q2 - c * c)) / (n0 * n1)) se from {name}q)"""


def _rank(score: str) -> str:
    return f"rank() over (partition by y order by {score}) + (count(*) over (partition by y, {score}) - 1) / 2.0"


# the table's four entries around the pair of averages, each by summing the rule over a fine grid of x
_HANLEY = f"""with s as (select l_quantity + l_orderkey % 17 a, l_quantity + l_partkey % 29 b, (l_quantity + l_suppkey % 31 > 40)::int y from lineitem), {_ci_sql('ca', 'a')}, {_ci_sql('cb', 'b')},
k as (select avg(r) corr from (select corr(ra, rb) r from (select y, {_rank('a')} ra, {_rank('b')} rb from s) group by y)),
spot as (select (corr - 0.02) / 0.02 fu, ((ca.c + cb.c) / 2 - 0.7) / 0.025 fv from k, ca, cb), cell as (select fu, fv, least(floor(fu), 43)::int i, least(floor(fv), 10)::int j from spot),
corner as (select i + di i, j + dj j, 0.02 + 0.02 * (i + di) rho, 0.7 + 0.025 * (j + dj) area, (case when di = 1 then fu - i else i + 1 - fu end) * (case when dj = 1 then fv - j else j + 1 - fv end) share from cell, (select unnest([0, 0, 1, 1]) di, unnest([0, 1, 0, 1]) dj)),
z as (select 0 as n, area, -10::double lo, 10::double hi from (select distinct area from corner) union all select n + 1, area, case when below then (lo + hi) / 2 else lo end, case when below then hi else (lo + hi) / 2 end from (select *, {pnorm('((lo + hi) / 2)')} < area as below from z where n < 50)),
x as (select corner.*, sqrt(2) * hi mu, t, exp(-t * t / 2) / sqrt(2 * pi()) * 0.02 w from corner join (select * from z where n = 50) using (area), (select -6 + 0.02 * unnest(range(601)) t)),
f as (select i, j, share, w, {pnorm('(mu + t)')} f, {pnorm('((mu + rho * t) / sqrt(2 - rho * rho))')} g from x),
r as (select sum(share * v) r from (select i, j, any_value(share) share, round((sum(w * f * g) - sum(w * f) * sum(w * f)) / (sum(w * f * f) - sum(w * f) * sum(w * f)), 2) v from f group by i, j)),
d as (select ca.c c1, cb.c c2, corr, r, (ca.c - cb.c) / sqrt(ca.se * ca.se + cb.se * cb.se - 2 * r * ca.se * cb.se) z from ca, cb, k, r)"""


@query(f"{_HANLEY.replace('with s as', 'with recursive s as', 1)} select round(c1, 6) as c1, round(c2, 6) as c2, round(corr, 6) as corr, round(r, 6) as r, round(z, 5) as z, round(1 - {gamma_p('0.5', '(z * z / 2)', 6000)}, 6) as p from d")
def e2_e3_hanley_test(spark, sf):
    df = table(spark, sf, "lineitem").select((F.col("l_quantity") + F.col("l_orderkey") % 17).alias("a"), (F.col("l_quantity") + F.col("l_partkey") % 29).alias("b"), (F.col("l_quantity") + F.col("l_suppkey") % 31 > 40).cast("int").alias("y"))
    out = evaluate.hanley_test(df, "a", "b", "y", "spearman", lambda z: 2 * T.pnorm(-F.abs(z)))
    return out.select(*(F.round(c, 5 if c == "z" else 6).alias(c) for c in ("c1", "c2", "corr", "r", "z", "p")))


@query("""with s as (select (n_chars > 1500) = (quality = 1) c1, (length(text) % 2 = 0) = (quality = 1) c2 from documents join labels using (doc_id)), n as (select count(*) filter (c1 and not c2) rw, count(*) filter (c2 and not c1) wr from s)
select rw, wr, round((abs(rw - wr) - 1) / sqrt(rw + wr), 9) z from n""")
def e4_mcnemar(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    df = df.select(((F.col("n_chars") > 1500) == (F.col("quality") == 1)).alias("c1"), ((F.length("text") % 2 == 0) == (F.col("quality") == 1)).alias("c2"))
    return evaluate.mcnemar(df, "c1", "c2").select("rw", "wr", F.round("z", 9).alias("z"))


@query("select round(avg(((n_chars > 1500)::int = quality)::double), 9) as accuracy from documents join labels using (doc_id)")
def e5_accuracy(spark, sf):
    df = _scored(spark, sf).withColumn("pred", (F.col("n_chars") > 1500).cast("int"))
    return evaluate.accuracy(df, "pred", "quality").select(F.round("accuracy", 9).alias("accuracy"))


_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark, sf):
    # values and target as doubles; the key deals rows to train, hold and test
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *(F.col(c).cast("double").alias(c) for c in _FEATURES), (F.col("l_returnflag") == "R").cast("double").alias("y"))


def _fits_sql(reps: int) -> str:
    """CTEs of the features in common units with a row for each repetition, fits of all features (a) and of the price (p), both's held-out c-indexes."""
    unit = ", ".join(f"({c}::double - avg({c}::double) over ()) / stddev_pop({c}::double) over () z{i}" for i, c in enumerate(_FEATURES, 1))
    deal = " union all ".join(f"select {rep} rep, floor({u('l_orderkey', 'l_linenumber', seed=rep)} * 2)::int own, * from z" for rep in range(reps))
    score = " + ".join(["w0", *(f"z{i} * w{i}" for i in range(1, len(_FEATURES) + 1))])
    return f"""with z as (select l_orderkey, l_linenumber, {unit}, (l_returnflag = 'R')::int::double y from lineitem),
x as materialized (select *, 1 - own as fold from ({deal})), o as (select rep, fold, z2 as z1, y from x),
{newton_sql('a', 'x', ['rep', 'fold'], len(_FEATURES))},
{newton_sql('p', 'o', ['rep', 'fold'], 1)},
s as (select x.rep, a8.fold, 'all' as model, y, {score} as score from x join a8 on a8.rep = x.rep and a8.fold = x.own
union all select x.rep, p8.fold, 'price', y, w0 + z2 * w1 from x join p8 on p8.rep = x.rep and p8.fold = x.own),
{cindex_sql('c', 's', ['rep', 'fold', 'model'])}"""


@query(f"{_fits_sql(1)} select round(c, 4) as cindex from c where fold = 1 and model = 'all'")
def e6_e7_logistic_cindex(spark, sf):
    df = evaluate.folds(_lines(spark, sf), 2, ["l_orderkey", "l_linenumber"])
    c = evaluate.logistic_cindex(df.filter("fold = 0"), df.filter("fold = 1"), _FEATURES, "y")
    return spark.createDataFrame([(c,)], "cindex double").select(F.round("cindex", 4).alias("cindex"))


@query()
def e8_e9_select_variables(spark, sf):
    df = evaluate.folds(_lines(spark, sf), 3, ["l_orderkey", "l_linenumber"])
    part = [df.filter(F.col("fold") == k).drop("fold") for k in range(3)]
    got = evaluate.select_variables(*part, _FEATURES, "y")
    return spark.createDataFrame([(",".join(got["variables"]), got["score"])], "variables string, score double")


@query(f"{_fits_sql(5)} select rep::int as rep, fold, model, round(c, 4) as score from c")
def e10_cross_validation(spark, sf):
    """5 x 2 folds of two models."""
    models = {"all": _FEATURES, "price": ["l_extendedprice"]}
    found = evaluate.cross_validate_logistic(_lines(spark, sf), models, "y", 2, ["l_orderkey", "l_linenumber"], reps=5)
    return found.withColumn("score", F.round("score", 4))


@query(f"""with r as (select o_orderkey, o_totalprice::double w, sum(o_totalprice::double) over (order by o_orderkey) hi, sum(o_totalprice::double) over () t from orders where o_totalprice > 0),
d as (select draw, {u('draw')} v from (select unnest(range(500)) draw)) select draw, o_orderkey from d join r on d.v * r.t > r.hi - r.w and d.v * r.t <= r.hi""")
def q1_weighted_with_replacement(spark, sf):
    return sampling.weighted_with_replacement(table(spark, sf, "orders"), "o_orderkey", "o_totalprice", 500)


@query(f"select o_orderkey from orders where o_totalprice > 0 order by -ln({u('o_orderkey')}) / o_totalprice, o_orderkey limit 200")
def q2_weighted_without_replacement(spark, sf):
    return sampling.weighted_without_replacement(table(spark, sf, "orders"), "o_orderkey", "o_totalprice", 200).select("o_orderkey")


@query("""with r as (select o_orderkey, o_totalprice::double w, sum(o_totalprice::double) over (order by o_totalprice desc, o_orderkey) hi, sum(o_totalprice::double) over () / 1000 step from orders)
select copies, count(*) as n from (select (ceil(round(hi / step, 6) - 0.5) - ceil(round((hi - w) / step, 6) - 0.5))::long as copies from r) group by 1""")
def q3_systematic(spark, sf):
    out = sampling.systematic(table(spark, sf, "orders"), "o_orderkey", "o_totalprice", 1000)
    return out.groupBy("copies").agg(F.count("*").alias("n"))


@query("select o_orderkey, o_totalprice::double as o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def q4_top_k(spark, sf):
    out = sampling.top_k(table(spark, sf, "orders"), F.desc("o_totalprice"), 25, ["o_orderkey"])
    return out.select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))


_SEQ = "select user_id seq_id, row_number() over (partition by user_id order by ts, event_id) pos, event_type item from events"


def _sequences(spark, sf):
    e = table(spark, sf, "events")
    return e.selectExpr("user_id as seq_id", "row_number() over (partition by user_id order by ts, event_id) as pos", "event_type as item", "value")


@query(f"""with s as ({_SEQ}), t as (select seq_id, item, coalesce(lead(item) over w, first(item) over w) nxt from s window w as (partition by seq_id order by pos))
select seq_id, case when bool_or(abs(length(item) - length(nxt)) > 4) then null else round(sum(abs(length(item) - length(nxt)) + 1.0), 6) end as length from t group by 1""")
def q5_tour_length(spark, sf):
    seqs = _sequences(spark, sf)
    gap = F.abs(F.length("i") - F.length("j"))
    steps = sampling.transition_counts(seqs).filter("source is not null").select(F.col("source").alias("i"), F.col("target").alias("j"))
    dist = steps.withColumn("d", F.when(gap > 4, sampling.BARRIER).otherwise(gap + 1.0))
    return sampling.tour_length(seqs, dist).select("seq_id", F.round("length", 6).alias("length"))


_TRANS = f"""with s as ({_SEQ}), t as (select seq_id, pos, item, coalesce(lead(item) over w, first(item) over w) nxt from s window w as (partition by seq_id order by pos)), n as (select count(distinct seq_id) n from s),
c as (select null source, item target, count(*) / max(n)::double weight from t, n where pos = 1 group by item union all select item, nxt, count(*) / max(n)::double from t, n group by 1, 2)"""


@query(f"{_TRANS} select source, target, round(weight, 9) as weight from c")
def q6_transition_counts(spark, sf):
    return sampling.transition_counts(_sequences(spark, sf)).select("source", "target", F.round("weight", 9).alias("weight"))


@query(f"""{_TRANS}, d as (select * from c where source is null or source <> target), o as (select source s, target t, 0.25 w from c where source is not null and source < target),
b as (select coalesce(source, s) source, coalesce(target, t) target, 0.7 * coalesce(weight, 0) + 0.3 * coalesce(w, 0) weight from d full join o on source = s and target = t),
f as (select source, target, case when source is not null and source > target and length(target) = 5 then 1e-12 else weight end weight from b) select source, target, round(weight / sum(weight) over (partition by source), 9) as p from f""")
def q7_transition_matrix(spark, sf):
    counts = sampling.transition_counts(_sequences(spark, sf))
    prior = counts.filter("source < target").select("source", "target", F.lit(0.25).alias("p"))
    forbidden = counts.filter("source > target and length(target) = 5").select("source", "target")
    return sampling.transition_matrix(counts, prior, 0.7, forbidden).select("source", "target", F.round("p", 9).alias("p"))


@query("with s as (select user_id seq_id, event_id, ts, value from events), t as (select seq_id, value, lag(value) over (partition by seq_id order by ts, event_id) prev from s) select seq_id, sum(coalesce((prev <= value)::int, 0))::long as score from t group by 1")
def q8_ascending_score(spark, sf):
    return sampling.ascending_score(_sequences(spark, sf), "value")


@query("select distinct p_brand, p_size from part")
def q9_diversify(spark, sf):
    return sampling.diversify(table(spark, sf, "part").select("p_brand", "p_size"), ["p_brand", "p_size"])


def _masked(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 2000).cast("int").alias("band"))


_GONE = "concat_ws('|', " + ", ".join(f"case when m & {1 << i} = 0 then coalesce({c}::varchar, '-') else '' end" for i, c in enumerate(("c_nationkey", "c_mktsegment", "band"))) + ")"


@query(f"""with recursive c as (select c_custkey, c_nationkey, c_mktsegment, floor(c_acctbal / 2000)::int band from customer), k as (select c.*, m, {_GONE} k from c, (select unnest(range(8)) m)),
h as (select c_custkey, m, count(*) over (partition by m, k) - 1 hits from k),
st as (select c_custkey, 0 as step, 0 as gone, hits from h where m = 0 union all select c_custkey, step + 1, nm, nh from (select st.c_custkey, st.step, h.m nm, h.hits nh, row_number() over (partition by st.c_custkey order by bit_count(xor(h.m, st.gone)), ((h.m & 1) * 4 + (h.m & 2) + (h.m & 4) / 4) desc) rn
from st join h on h.c_custkey = st.c_custkey and h.m & st.gone = st.gone and h.hits > st.hits where st.hits < 5) where rn = 1), fin as (select c_custkey, arg_max(gone, step) g from st group by 1)
select c_custkey, case when g & 1 = 0 then c_nationkey end as c_nationkey, case when g & 2 = 0 then c_mktsegment end as c_mktsegment, case when g & 4 = 0 then band end as band,
concat_ws(',', case when g & 1 > 0 then 'c_nationkey' end, case when g & 2 > 0 then 'c_mktsegment' end, case when g & 4 > 0 then 'band' end) as suppressed from c join fin using (c_custkey)""")
def a1_kambiguate(spark, sf):
    out = release.kambiguate(_masked(spark, sf), ["c_nationkey", "c_mktsegment", "band"], 5)
    return out.withColumn("suppressed", F.concat_ws(",", "suppressed"))


@query("""with m as (select case when c_custkey % 3 = 0 then null else c_nationkey end a, c_mktsegment b from customer), r as (select a, b, count(*) n from m group by all), o as (select c_nationkey a, c_mktsegment b, count(*) n from customer group by all)
select r.a, r.b, r.n, (select sum(o.n) from o where (r.a is null or r.a = o.a) and r.b = o.b)::long as matches from r""")
def a2_match_count(spark, sf):
    df = table(spark, sf, "customer")
    released = df.select(F.expr("case when c_custkey % 3 = 0 then null else c_nationkey end").alias("a"), F.col("c_mktsegment").alias("b"))
    return release.match_count(released, df.select(F.col("c_nationkey").alias("a"), F.col("c_mktsegment").alias("b")), ["a", "b"])


@query()
def a3_spectral_swap(spark, sf):
    return release.spectral_swap(_masked(spark, sf).select("c_custkey", "c_mktsegment", "band"), ["c_mktsegment", "band"], "c_custkey")


def _segments(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("c"))


_PMF = """with k as (select event_type, count(*) c from events group by 1), u as (select event_type, c, r, least(greatest(c, 20), 2000) cc from k, (select unnest(range(20, 2000)) r)),
w as (select event_type, c, r, exp((1.0 / 6) * case when r >= cc then -3.0 * (r - cc) else -1.0 * (cc - r) end) w from u), p as (select *, w / sum(w) over (partition by event_type) p from w)"""


@query(f"{_PMF} select event_type, round(sum(r * p), 6) as mean, round(sum(r * r * p) - sum(r * p) * sum(r * p), 4) as variance from p group by 1")
def a4_a7_noisy_count_pmf(spark, sf):
    pmf = release.release_pmf(_segments(spark, sf), "c", 1.0, 1.0, 3.0, 1.0, 1.0, 20, 2000)
    return release.pmf_summary(pmf).select("event_type", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


@query(f"""with k as (select event_type, count(*) c from events group by 1), o as (select unnest(['neutral', 'over', 'under']) preset, unnest([1.0, 1.0, 3.0]) bp, unnest([1.0, 3.0, 1.0]) bn),
w as (select preset, event_type, r, exp(1.0 / (2 * greatest(bp, bn)) * case when r >= least(c, 2000) then -bp * (r - least(c, 2000)) else -bn * (least(c, 2000) - r) end) w from k, o, (select unnest(range(2000)) r)),
p as (select preset, event_type, r, sum(w) over (partition by preset, event_type order by r) / sum(w) over (partition by preset, event_type) cum from w)
select preset, event_type, coalesce(min(case when cum >= {keyed('release', 'event_type')} then r end), 1999)::int as released from p group by all""")
def a8_a9_draw_release(spark, sf):
    out = None
    for name, p in sorted(release.PRESETS.items()):
        drawn = release.draw_release(release.release_pmf(_segments(spark, sf), "c", 1.0, bp=p["bp"], bn=p["bn"], rmin=0, rmax=2000), ["event_type"], SECRET)
        part = drawn.select(F.lit(name).alias("preset"), "event_type", "released")
        out = part if out is None else out.unionByName(part)
    return out


#: what a release knows beforehand of these columns, and of the number of rows
_BOUNDS, _DOMAIN, _SIZE = {"c_nationkey": (0, 24), "band": (-1, 4)}, {"c_mktsegment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]}, 20_000
_UNIT = "least(floor(greatest({0} - {1}, 0)::double / ({2} - {1})::double * 5), 4)::int"
_COARSE = f"""c as (select {_UNIT.format('c_nationkey', 0, 24)} a1, {_UNIT.format('floor(c_acctbal / 2000)', -1, 4)} a2, c_mktsegment from customer), bin as (select unnest(range(5))::int i), segment as (select unnest({_DOMAIN['c_mktsegment']}) c_mktsegment)"""


def _noisy(cells: str, keys: list[str], k: int) -> str:
    """CTE h: cells (keys, n) with noise on each count, those over the threshold."""
    gamma = release.budget_share(_SIZE, k)
    return f"""z as (select *, n + {whole_noise(gamma * 2.0, 'cells', *keys)} as "count" from {cells}), h as (select * from z where "count" > {0.5 * math.log(_SIZE) / 2.0})"""


@query(f"""with {_COARSE}, d as (select x.i a1, y.i a2, c_mktsegment from bin x, bin y, segment), e as (select d.*, (select count(*) from c where c.a1 = d.a1 and c.a2 = d.a2 and c.c_mktsegment = d.c_mktsegment) n from d),
{_noisy('e', ['a1', 'a2', 'c_mktsegment'], 2)} select a1 as c_nationkey, a2 as band, c_mktsegment, "count" from h""")
def a10_a12_projected_histogram(spark, sf):
    return release.projected_histogram(_masked(spark, sf).select("c_nationkey", "band", "c_mktsegment"), ["c_nationkey", "band"], "c_mktsegment", 2.0, SECRET, _SIZE, _BOUNDS, _DOMAIN)


_TOLD = "(select (select (sum(n) * sum(n) - sum(n * n)) / 2 from (select count(*) n from c group by c_mktsegment)) - sum((k - q) / 2) from (select {0}, sum(n) * sum(n) k, sum(n * n) q from (select {0}, c_mktsegment, count(*) n from c group by all) group by 1))"
_SCORE = f"{(1 - release.budget_share(_SIZE, 1)) * 2.0} * {{0}} / (2 * {_SIZE - 1})"


@query(f"""with {_COARSE}, g as (select {_TOLD.format('a1')} x1, {_TOLD.format('a2')} x2), s as (select {_SCORE.format('x1')} - ln(-ln({keyed('picks', "'c_nationkey'", "'0'")})) s1, {_SCORE.format('x2')} - ln(-ln({keyed('picks', "'band'", "'0'")})) s2 from g),
k as (select case when s1 >= s2 then a1 else a2 end as cell, c_mktsegment from c, s), d as (select i as cell, c_mktsegment from bin, segment), e as (select d.*, (select count(*) from k where k.cell = d.cell and k.c_mktsegment = d.c_mktsegment) n from d),
{_noisy('e', ['cell', 'c_mktsegment'], 1)} select cell, c_mktsegment, unnest(range(1, "count" + 1)) as copy from h where "count" > 0""")
def a10_expanded_rows(spark, sf):
    hist = release.projected_histogram(_masked(spark, sf).select("c_nationkey", "band", "c_mktsegment"), ["c_nationkey", "band"], "c_mktsegment", 2.0, SECRET, _SIZE, _BOUNDS, _DOMAIN, k=1)
    return release.expand(hist).toDF("cell", "c_mktsegment", "copy")


@query(f"with d as (select min(g) d from (select n - lag(n) over (order by n) g from (select distinct c_nationkey::double n from customer))) select c_custkey, round(c_nationkey + (2 * {keyed('jitter', 'c_custkey')} - 1) * d / 5, 9) as x from customer, d")
def a13_jitter(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("x"))
    return release.jitter(df, "x", 1.0, ["c_custkey"], SECRET, release.smallest_gap(df, "x")).select("c_custkey", F.round("x", 9).alias("x"))


@query()
def a14_private_logistic(spark, sf):
    return release.private_logistic(_lines(spark, sf).drop("l_orderkey", "l_linenumber"), "y", ["l_quantity", "l_discount"], 1.0, SECRET)
