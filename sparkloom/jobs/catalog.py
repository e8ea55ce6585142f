"""Queries over the given tables, one or more for each operator, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.functions import private

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def u(*key: str, seed: int = 0) -> str:
    """SQL of helpers.uniform over key (SQL expressions)."""
    text = ", ".join([*(f"coalesce(({k})::varchar, '')" for k in key), f"'{seed}'"])
    return f"((('0x' || substr(md5(concat_ws('|', {text})), 1, 13))::bigint + 0.5) / 4503599627370496.0)"


def gamma_p(a: str, x: str, terms: int = 200) -> str:
    """SQL of the regularised lower incomplete gamma function by its series."""
    return f"(case when {x} <= 0 then 0 else list_sum(list_transform(range({terms}), lambda k: exp(({a} + k) * ln(case when {x} > 0 then {x} else 1 end) - {x} - lgamma({a} + k + 1)))) end)"


def pnorm(z: str) -> str:
    return f"(0.5 + 0.5 * sign({z}) * {gamma_p('0.5', f'(({z}) * ({z}) / 2)')})"


def measures_sql(cols: list[str], tbl: str, by: str = "") -> str:
    """CTEs p (pair counts), .., m (chi2, n, nx, ny, gy, gx, vx, vy) of all column pairs of tbl[, for each by]."""
    b = f"{by}, " if by else ""
    pairs = " union all ".join(f"select {b}'{x}' x, '{y}' y, {x}::varchar a, {y}::varchar b, count(*) n from {tbl} group by all" for i, x in enumerate(cols) for y in cols[i + 1 :])
    return f"""p as ({pairs}),
r as (select {b}x, y, a, sum(n) r, 1 - sum(n * n) / (sum(n) * sum(n)) g from p group by all), c as (select {b}x, y, b, sum(n) c, 1 - sum(n * n) / (sum(n) * sum(n)) g from p group by all),
rr as (select {b}x, y, sum(r) n, count(*) nx, avg(g) gy, 1 - sum(r * r) / (sum(r) * sum(r)) vx from r group by all), cc as (select {b}x, y, count(*) ny, avg(g) gx, 1 - sum(c * c) / (sum(c) * sum(c)) vy from c group by all),
q as (select {b}x, y, sum(n * n / (r * c)) - 1 q from p join r using ({b}x, y, a) join c using ({b}x, y, b) group by all),
m as (select {b}x, y, n::long n, n * q chi2, nx, ny, gy, gx, vx, vy from q join rr using ({b}x, y) join cc using ({b}x, y))"""


def newton_sql(name: str, rows: str, by: list[str], k: int, steps: int = 8) -> str:
    """CTEs {name}0, .. of logistic regressions of y on z1, .., zk for each by of rows; the last, {name}{steps}, has weights w0, .., wk.

    Each step adds up gradients and Hessians and solves for the step by Cholesky factors written out.
    """
    z, keys = ["1.0::double", *(f"z{i}" for i in range(1, k + 1))], ", ".join(by)
    w = [f"w{i}" for i in range(k + 1)]
    places = [(i, j) for i in range(k + 1) for j in range(i + 1)]
    out = [f"{name}0 as materialized (select {keys}, {', '.join(f'0.0::double {x}' for x in w)} from {rows} group by {keys})"]
    for n in range(1, steps + 1):
        linear = " + ".join(f"{a} * {b}" for a, b in zip(z, w))
        sums = [*(f"sum({z[i]} * (y - p)) g{i}" for i in range(k + 1)), *(f"sum({z[i]} * {z[j]} * p * (1 - p)) h{i}_{j}" for i, j in places)]
        factor = []
        for i, j in places:
            rest = "".join(f" - l{i}_{m} * l{j}_{m}" for m in range(j))
            factor.append(f"sqrt(h{i}_{i}{rest}) l{i}_{i}" if i == j else f"(h{i}_{j}{rest}) / l{j}_{j} l{i}_{j}")
        factor += [f"(g{i}{''.join(f' - l{i}_{m} * f{m}' for m in range(i))}) / l{i}_{i} f{i}" for i in range(k + 1)]
        factor += [f"(f{i}{''.join(f' - l{m}_{i} * d{m}' for m in range(i + 1, k + 1))}) / l{i}_{i} d{i}" for i in reversed(range(k + 1))]
        summed = f"select {keys}, {', '.join([*w, *sums])} from (select *, 1 / (1 + exp(-({linear}))) p from {rows} join {name}{n - 1} using ({keys})) group by {', '.join([keys, *w])}"
        # a level for each number, as one that refers to another of its level is expanded, again and again
        for x in factor:
            summed = f"select *, {x} from ({summed})"
        out.append(f"{name}{n} as materialized (select {keys}, {', '.join(f'{x} + d{i} as {x}' for i, x in enumerate(w))} from ({summed}))")
    return ",\n".join(out)


def cindex_sql(name: str, scores: str, by: list[str]) -> str:
    """CTE with by and c: the c-index of score against y (0 or 1) in scores, turned over under one half."""
    keys = ", ".join(by)
    ranks = f"select *, rank() over (partition by {keys} order by score) + (count(*) over (partition by {keys}, score) - 1) / 2.0::double r from {scores}"
    return f"{name} as (select {keys}, greatest(c, 1 - c) c from (select {keys}, (sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) c from ({ranks}) group by {keys}))"


#: the queries' secret; as their SQL repeats the draws it is public, a release needs a secret of its own
SECRET = b"public key of these queries"


def digits(purpose: str, *key: str) -> str:
    """SQL of private.keyed_digits over key (SQL expressions) with the queries' secret."""
    k = private.noise_key(SECRET, purpose)
    text = " || ".join(f"coalesce(length(({x})::varchar)::varchar || ':' || ({x})::varchar, 'n')" for x in key)
    return f"sha256('{k}' || sha256('{k}' || {text}))"


def keyed(purpose: str, *key: str) -> str:
    """SQL of private.keyed_uniform."""
    return f"((('0x' || substr({digits(purpose, *key)}, 1, 13))::bigint + 0.5) / 4503599627370496.0)"


def whole_noise(eps: float, purpose: str, *key: str) -> str:
    """SQL of private.discrete_laplace."""
    draw = lambda side, i, chance: f"case when substr({digits(purpose, *key, repr(f'{side}{i}'))}, 1, {private.DIGITS}) < '{chance}' then {1 << i} else 0 end"
    return "(" + " + ".join(f"{draw('+', i, x)} - {draw('-', i, x)}" for i, x in enumerate(private.laplace_bits(eps))) + ")"


from sparkloom.jobs import q_columns, q_evaluate, q_rules  # noqa: E402,F401  they register their queries
