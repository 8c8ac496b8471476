"""Queries by name and their SQL.

Integers are cast to BIGINT and doubles rounded on both sides; graphs are fixtures given as VALUES.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bnspark.functions.combinatorics import combinations_of, mask_to_array, masks
from bnspark.functions.special import chi2_sf, lgamma
from bnspark.operators import contingency, graph, linalg, metrics
from bnspark.operators.citest import ChiSquare, ci_batch, decide
from bnspark.operators.dsep import ancestors, d_separated, moral_graph, separated_table
from bnspark.operators.graph import PDAG
from bnspark.operators.score import AIC, BIC, K2, BDeu, family_scores, network_score, score_map
from bnspark.plans.annealing import simulated_annealing
from bnspark.plans.exhaustive import exhaustive_search
from bnspark.plans.pc import build_skeleton, pc
from bnspark.plans.rai import rai
from bnspark.sources import io
from bnspark.sources.encoding import EncodedTable, dictionary, ingest
from bnspark.sources.networks import NETWORKS, dag, simulate, simulate_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BN_VARS = ["audit", "disc_hi", "promo", "qty_hi", "rush", "tax_hi"]
# Six 0/1 variables over lineitem: promo <- qty_hi, disc_hi; rush <- promo; audit <- promo, tax_hi.
BN_CTES = """b AS (SELECT l_orderkey o, CAST(l_quantity>25 AS INT) qty_hi, CAST(l_discount>0.045 AS INT) disc_hi, CAST(l_tax>0.035 AS INT) tax_hi,
 (l_orderkey*7919+l_linenumber*104729+l_partkey*31)%101 n1, (l_orderkey*6007+l_suppkey*911+l_linenumber*353)%103 n2, (l_partkey*5003+l_linenumber*769+l_suppkey*17)%107 n3 FROM {lineitem}),
c AS (SELECT *, CASE WHEN qty_hi+disc_hi=2 THEN CAST(n1<90 AS INT) WHEN qty_hi+disc_hi=1 THEN CAST(n1<60 AS INT) ELSE CAST(n1<10 AS INT) END promo FROM b),
bn AS (SELECT qty_hi, disc_hi, tax_hi, promo, CASE WHEN promo=1 THEN CAST(n2<80 AS INT) ELSE CAST(n2<20 AS INT) END rush,
 CASE WHEN promo+tax_hi=2 THEN CAST(n3<90 AS INT) WHEN promo=1 THEN CAST(n3<55 AS INT) WHEN tax_hi=1 THEN CAST(n3<45 AS INT) ELSE CAST(n3<8 AS INT) END audit FROM c)"""
BN_SQL = BN_CTES.replace("{lineitem}", "lineitem")
RAW = ["l_discount", "l_linenumber", "l_linestatus", "l_returnflag", "l_tax"]


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def _long(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bn(spark: SparkSession, sf_dir: str, columns: Sequence[str] = BN_VARS) -> EncodedTable:
    view = spark.sql("WITH " + BN_CTES + " SELECT * FROM bn", lineitem=_table(spark, sf_dir, "lineitem"))
    return EncodedTable(view.select(*columns))


def raw(spark: SparkSession, sf_dir: str, columns: Sequence[str] = RAW) -> EncodedTable:
    return EncodedTable(_table(spark, sf_dir, "lineitem").select(*columns))


def _v(enc: EncodedTable, *names: str) -> tuple[int, ...]:
    return tuple(enc.col_str2idx[n] for n in names)


def _named_codes(df: DataFrame, enc: EncodedTable) -> DataFrame:
    return _long(df.select(*[F.col(c).alias(enc.col_idx2str[int(c[1:])] if c[0] == "v" and c[1:].isdigit() else c) for c in df.columns]))


def _rank(c: str) -> str:
    return f"CAST(dense_rank() OVER (ORDER BY CAST({c} AS VARCHAR)) - 1 AS BIGINT) AS {c}"


CODES_SQL = "codes AS (SELECT " + ", ".join(_rank(c) for c in RAW) + " FROM lineitem)"

# Sources and encoding.


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(5 AS BIGINT) AS n_vars, CAST(count(*) FILTER (" + " OR ".join(f"{c} IS NULL" for c in RAW) + ") AS BIGINT) AS n_nulls FROM lineitem")
def ingest_validate(spark, sf_dir):
    table = ingest(_table(spark, sf_dir, "lineitem").select(*RAW))
    null = F.greatest(*[F.col(c).isNull() for c in RAW])
    return table.agg(F.count("*").alias("n_rows"), F.lit(len(RAW)).cast("long").alias("n_vars"), F.count_if(null).alias("n_nulls"))


@query(" UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS var_id, '{c}' AS variable, CAST(row_number() OVER (ORDER BY value) - 1 AS BIGINT) AS code, value FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS value FROM lineitem)" for i, c in enumerate(RAW)), name="dictionary")
def dictionary_of(spark, sf_dir):
    return _long(dictionary(ingest(_table(spark, sf_dir, "lineitem").select(*RAW))))


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, CAST(count(DISTINCT {c}) AS BIGINT) AS cardinality FROM lineitem" for c in RAW))
def cardinality(spark, sf_dir):
    return dictionary(ingest(_table(spark, sf_dir, "lineitem").select(*RAW))).groupBy("variable").agg(F.count("*").alias("cardinality"))


@query("WITH " + CODES_SQL + " SELECT * FROM codes")
def encode(spark, sf_dir):
    enc = raw(spark, sf_dir)
    return _named_codes(enc.codes, enc)


@query("WITH " + CODES_SQL + " SELECT " + " || ',' || ".join(f"CAST({c} AS VARCHAR)" for c in RAW) + " AS row_codes FROM codes")
def row_vector(spark, sf_dir):
    return raw(spark, sf_dir).data_row_major.select(F.array_join(F.col("row").cast("array<string>"), ",").alias("row_codes"))


def _simulate(name: str, rows: int) -> None:
    query(simulate_sql(name, rows, 7), name="simulate" if name == "asia" else f"simulate_{name}")(lambda spark, sf_dir: simulate(spark, name, rows, 7))


for _name, _rows in (("asia", 10_000), ("cancer", 10_000), ("child", 5_000), ("alarm", 2_000)):
    _simulate(_name, _rows)


# Contingency tables.


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem")
def contingency_0(spark, sf_dir):
    return contingency.counts(raw(spark, sf_dir), ())


def _group_sql(*cols: str) -> str:
    return f"WITH {CODES_SQL} SELECT {', '.join(cols)}, CAST(count(*) AS BIGINT) AS n FROM codes GROUP BY ALL"


@query(_group_sql("l_returnflag"))
def contingency_1(spark, sf_dir):
    enc = raw(spark, sf_dir)
    return _named_codes(contingency.counts(enc, _v(enc, "l_returnflag")), enc)


@query(_group_sql("l_linestatus", "l_returnflag"))
def contingency_2(spark, sf_dir):
    enc = raw(spark, sf_dir)
    return _named_codes(contingency.counts(enc, _v(enc, "l_linestatus", "l_returnflag")), enc)


@query(_group_sql("l_linenumber", "l_linestatus", "l_returnflag"))
def contingency_3(spark, sf_dir):
    enc = raw(spark, sf_dir)
    return _named_codes(contingency.counts(enc, _v(enc, "l_linenumber", "l_linestatus", "l_returnflag")), enc)


CT = ["l_linenumber", "l_linestatus", "l_returnflag"]
CT_SQL = CODES_SQL + """, card AS (SELECT count(DISTINCT l_linestatus) AS c1, count(DISTINCT l_returnflag) AS c2 FROM lineitem),
 cells AS (SELECT l_linenumber * c1 * c2 + l_linestatus * c2 + l_returnflag AS key, c1, c2, count(*) AS n FROM codes, card GROUP BY ALL)"""


def _ct(spark, sf_dir) -> contingency.ContingencyTable:
    enc = raw(spark, sf_dir)
    return contingency.ContingencyTable(_v(enc, *CT), enc)


@query(f"WITH {CT_SQL} SELECT CAST(key AS BIGINT) AS key, CAST(n AS BIGINT) AS n FROM cells")
def ct_key(spark, sf_dir):
    return _ct(spark, sf_dir).cells.select("key", "n")


@query(f"WITH {CT_SQL} SELECT CAST(key AS BIGINT) AS key, CAST(key // (c1 * c2) AS BIGINT) AS s0, CAST(key // c2 % c1 AS BIGINT) AS s1, CAST(key % c2 AS BIGINT) AS s2 FROM cells")
def ct_state_of(spark, sf_dir):
    ct = _ct(spark, sf_dir)
    return ct.cells.select("key", *[ct.state_of(F.col("key"), k).cast("long").alias(f"s{k}") for k in range(3)])


@query(f"WITH {CT_SQL} SELECT CAST(key AS BIGINT) AS key, CAST(key - key // c2 % c1 * c2 AS BIGINT) AS stripped FROM cells")
def ct_strip(spark, sf_dir):
    ct = _ct(spark, sf_dir)
    return ct.cells.select("key", ct.strip(F.col("key"), 1).cast("long").alias("stripped"))


@query(f"WITH {CT_SQL} SELECT CAST(k AS BIGINT) AS key, k IN (SELECT key FROM cells) AS contained FROM range(0, 60) AS r(k)")
def ct_contains(spark, sf_dir):
    return _ct(spark, sf_dir).contains(spark.range(60).select(F.col("id").alias("key")))


@query(_group_sql("l_linenumber", "l_returnflag"))
def ct_marginal(spark, sf_dir):
    ct = _ct(spark, sf_dir)
    enc = ct.encoded
    i, k = _v(enc, "l_linenumber", "l_returnflag")
    return _named_codes(ct.cells.groupBy(f"v{i}", f"v{k}").agg(F.sum("n").alias("n")), enc)


_SETS = [s for k in range(4) for s in combinations(range(6), k)]
_ALL_DIMS = " UNION ALL ".join(
    f"SELECT CAST({sum(1 << i for i in s)} AS BIGINT) AS gid, "
    + ", ".join(f"{'CAST(' + v + ' AS BIGINT)' if i in s else 'CAST(NULL AS BIGINT)'} AS {v}" for i, v in enumerate(BN_VARS))
    + ", CAST(count(*) AS BIGINT) AS n FROM bn"
    + (" GROUP BY " + ", ".join(f"bn.{BN_VARS[i]}" for i in s) if s else "")
    for s in _SETS
)


@query("WITH " + BN_SQL + " " + _ALL_DIMS)
def all_dims(spark, sf_dir):
    enc = bn(spark, sf_dir)
    return _named_codes(contingency.all_dims(enc, 3), enc)


@query(f"WITH {CODES_SQL}, g AS (SELECT * FROM (SELECT DISTINCT l_discount FROM codes), (SELECT DISTINCT l_linenumber FROM codes), (SELECT DISTINCT l_tax FROM codes)), n AS (SELECT l_discount, l_linenumber, l_tax, count(*) AS n FROM codes GROUP BY ALL) SELECT l_discount, l_linenumber, l_tax, CAST(coalesce(n, 0) AS BIGINT) AS n FROM g LEFT JOIN n USING (l_discount, l_linenumber, l_tax)")
def ct_dense(spark, sf_dir):
    enc = raw(spark, sf_dir)
    return _named_codes(contingency.dense(enc, _v(enc, "l_discount", "l_linenumber", "l_tax")), enc)


@query("SELECT o_orderpriority AS model_name, CAST(o_orderkey % 4 AS BIGINT) AS num_threads, CAST(count(*) AS BIGINT) AS count, round(avg(o_custkey % 17), 6) AS shd_mean, round(stddev_samp(o_custkey % 17), 6) AS shd_std, round(avg(o_totalprice / 1000), 6) AS time_mean_s, round(stddev_samp(o_totalprice / 1000), 6) AS time_std_s, round(min(o_totalprice / 1000), 6) AS time_min_s, round(max(o_totalprice / 1000), 6) AS time_max_s FROM orders GROUP BY ALL")
def bench_summary(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    records = orders.select(
        F.col("o_orderpriority").alias("model_name"), (F.col("o_orderkey") % 4).alias("num_threads"), F.lit(0).alias("seed"),
        (F.col("o_custkey") % 17).alias("shd"), (F.col("o_totalprice") / 1000).alias("elapsed_sec"),
    )
    out = io.summary(records)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


# Functions.

_CHI2 = [(x, d) for d in (0, 1, 2, 5, 10, 30, 100) for x in (0.0, 0.5, 3.841458820694124, 12.405322, 18.307038053275146, 124.34)]


@query("WITH t(x, dof) AS (VALUES " + ", ".join(f"({x}::DOUBLE, {d})" for x, d in _CHI2) + ") SELECT x, CAST(dof AS BIGINT) AS dof, CASE WHEN dof = 0 THEN CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END WHEN x = 0 THEN 1.0 ELSE round(abs(1 - (SELECT sum(exp((dof / 2.0 + k) * ln(x / 2) - x / 2 - lgamma(dof / 2.0 + k + 1))) FROM range(0, 400) AS r(k))), 7) END AS p FROM t", name="chi2_sf")
def chi2_tail(spark, sf_dir):
    return spark.createDataFrame([(x, d, round(chi2_sf(x, d), 7)) for x, d in _CHI2], "x double, dof long, p double")


@query("SELECT CAST(k AS BIGINT) AS k, round(lgamma(k / 7.0), 8) AS lg FROM range(1, 5000) AS r(k)", name="lgamma")
def lgamma_table(spark, sf_dir):
    return spark.range(1, 5000).select(F.col("id").alias("k"), F.round(lgamma(F.col("id") / 7.0), 8).alias("lg"))


@query("SELECT CAST(m AS BIGINT) AS mask, list_aggregate(list_filter(range(0, 40), lambda i: (m >> i) & 1 = 1), 'string_agg', ',') AS members FROM (SELECT k * 104729 AS m FROM range(1, 2000) AS r(k))")
def mask_to_vec(spark, sf_dir):
    out = spark.range(1, 2000).select((F.col("id") * 104729).alias("mask"))
    return out.select("mask", F.array_join(mask_to_array(F.col("mask"), 40).cast("array<string>"), ",").alias("members"))


@query("SELECT CAST(k AS BIGINT) AS mask FROM range(0, 4096) AS r(k) WHERE bit_count(k) = 5")
def comb_masks(spark, sf_dir):
    return masks(spark, 12, 5).select("mask")


@query("SELECT a.r_name AS a, b.r_name AS b, c.r_name AS c FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey JOIN region c ON b.r_regionkey < c.r_regionkey")
def combinations_k(spark, sf_dir):
    names = [r[0] for r in _table(spark, sf_dir, "region").orderBy("r_regionkey").select("r_name").collect()]
    return spark.createDataFrame(combinations_of(names, 3), "a string, b string, c string")


@query("SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(sum(CAST(embedding[i + 1] AS DOUBLE) * CAST(embedding[j + 1] AS DOUBLE)), 5) AS v FROM embeddings, range(0, 64) AS a(i), range(0, 64) AS b(j) GROUP BY i, j")
def matmul(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    a = rows.select(F.col("k").cast("long").alias("i"), F.col("vec_id").alias("j"), F.col("v").cast("double").alias("v"))
    b = rows.select(F.col("vec_id").alias("i"), F.col("k").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
    return linalg.matmul(a, b).select("i", "j", F.round("v", 5).alias("v"))


# Independence tests.

_TRIPLES = [
    ("l_returnflag", "l_linestatus", ["l_linenumber"]), ("l_linestatus", "l_discount", ["l_returnflag"]), ("l_discount", "l_tax", ["l_linestatus"]),
    ("l_returnflag", "l_linestatus", []), ("l_discount", "l_tax", ["l_linenumber", "l_returnflag"]),
]


def _stat_sql(x: str, y: str, z: Sequence[str], source: str = "lineitem") -> str:
    """chi2, g2 and dof of one triple, over the whole product of observed rows and columns."""
    zs = "[" + ", ".join(f"CAST({c} AS VARCHAR)" for c in z) + "]" if z else "['']"
    return f"""WITH cells AS (SELECT {zs} AS z, {x} AS x, {y} AS y, count(*) AS n FROM {source} GROUP BY ALL),
 r AS (SELECT z, x, sum(n) AS n FROM cells GROUP BY ALL), c AS (SELECT z, y, sum(n) AS n FROM cells GROUP BY ALL),
 s AS (SELECT z, count(DISTINCT x) AS nr, count(DISTINCT y) AS nc, sum(n) AS n FROM cells GROUP BY z),
 f AS (SELECT (nr - 1) * (nc - 1) AS d, r.n * c.n / CAST(s.n AS DOUBLE) AS e, CAST(coalesce(cells.n, 0) AS DOUBLE) AS n
  FROM r JOIN c USING (z) JOIN s USING (z) LEFT JOIN cells USING (z, x, y)),
 g AS (SELECT d, e, CASE WHEN d = 1 THEN n + sign(e - n) * least(0.5, abs(e - n)) ELSE n END AS o FROM f)
 SELECT sum(CASE WHEN d = 0 THEN 0 ELSE (o - e) ** 2 / e END) AS chi2, sum(CASE WHEN d > 0 AND o > 0 THEN 2 * o * ln(o / e) ELSE 0 END) AS g2,
  (SELECT sum((nr - 1) * (nc - 1)) FROM s) AS dof FROM g"""


def _stats(spark, sf_dir) -> DataFrame:
    enc = raw(spark, sf_dir)
    tests = [(enc.col_str2idx[x], enc.col_str2idx[y], _v(enc, *z)) for x, y, z in _TRIPLES]
    return ci_batch(enc, tests)


def _stats_sql(what: str) -> str:
    return " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS test_id, {what} FROM ({_stat_sql(x, y, z)})" for k, (x, y, z) in enumerate(_TRIPLES))


@query(_stats_sql("round(chi2, 6) AS chi2"))
def chi2_stat(spark, sf_dir):
    return _long(_stats(spark, sf_dir).select("test_id", F.round("chi2", 6).alias("chi2")))


@query(_stats_sql("round(g2, 6) AS g2"))
def g2_stat(spark, sf_dir):
    return _long(_stats(spark, sf_dir).select("test_id", F.round("g2", 6).alias("g2")))


@query(_stats_sql("CAST(dof AS BIGINT) AS dof"))
def ci_dof(spark, sf_dir):
    return _long(_stats(spark, sf_dir).select("test_id", "dof"))


_P_SQL = "(CASE WHEN dof = 0 THEN 1.0 ELSE 1 - (SELECT sum(exp((dof / 2.0 + k) * ln(chi2 / 2) - chi2 / 2 - lgamma(dof / 2.0 + k + 1))) FROM range(0, 600) AS r(k)) END)"


@query(_stats_sql(f"{_P_SQL} >= 0.05 AS independent"))
def ci_decision(spark, sf_dir):
    enc = raw(spark, sf_dir)
    tests = [(enc.col_str2idx[x], enc.col_str2idx[y], _v(enc, *z)) for x, y, z in _TRIPLES]
    return spark.createDataFrame(list(enumerate(decide(enc, tests, ChiSquare(0.05)))), "test_id long, independent boolean")


@query("SELECT CAST(0 AS BIGINT) AS dof, 0.0::DOUBLE AS chi2, 0.0::DOUBLE AS g2, true AS independent")
def ci_dof0(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select("l_returnflag", F.lit("a").alias("same"))
    enc = EncodedTable(lines)
    out = ci_batch(enc, [(0, 1, ())])
    return out.select("dof", "chi2", "g2", F.lit(decide(enc, [(0, 1, ())], ChiSquare(0.05))[0]).alias("independent"))


# All tests over bn with up to two conditioning variables: the compressed rows times the tests in SQL.
_BN_TESTS = [(x, y, z) for k in range(3) for x, y in combinations(range(6), 2) for z in combinations([v for v in range(6) if v not in (x, y)], k)]
_LIST = "[" + ", ".join(BN_VARS) + "]"
_BATCH_CTES = (
    BN_SQL
    + f""", comp AS MATERIALIZED (SELECT {_LIST} AS v, count(*) AS w FROM bn GROUP BY 1),
tests(test_id, x, y, z) AS (VALUES {", ".join(f"({k}, {x}, {y}, {list(z)}::INT[])" for k, (x, y, z) in enumerate(_BN_TESTS))}),
cells AS MATERIALIZED (SELECT test_id, list_transform(tests.z, lambda i: v[i + 1]) AS z, v[x + 1] AS x, v[y + 1] AS y, CAST(sum(w) AS BIGINT) AS n FROM comp, tests GROUP BY ALL),
r AS (SELECT test_id, z, x, sum(n) AS n FROM cells GROUP BY ALL), cc AS (SELECT test_id, z, y, sum(n) AS n FROM cells GROUP BY ALL),
s AS (SELECT test_id, z, count(DISTINCT x) AS nr, count(DISTINCT y) AS nc, sum(n) AS n FROM cells GROUP BY ALL),
full_cells AS (SELECT test_id, (s.nr - 1) * (s.nc - 1) AS d, r.n * cc.n / CAST(s.n AS DOUBLE) AS e, CAST(coalesce(cells.n, 0) AS DOUBLE) AS n
 FROM r JOIN cc USING (test_id, z) JOIN s USING (test_id, z) LEFT JOIN cells USING (test_id, z, x, y)),
adjusted AS (SELECT test_id, d, e, CASE WHEN d = 1 THEN n + sign(e - n) * least(0.5, abs(e - n)) ELSE n END AS o FROM full_cells),
stats AS (SELECT test_id, sum(CASE WHEN d = 0 THEN 0 ELSE (o - e) ** 2 / e END) AS chi2, sum(CASE WHEN d > 0 AND o > 0 THEN 2 * o * ln(o / e) ELSE 0 END) AS g2 FROM adjusted GROUP BY test_id),
dofs AS (SELECT test_id, sum((nr - 1) * (nc - 1)) AS dof FROM s GROUP BY test_id)"""
)


@query("WITH " + _BATCH_CTES + " SELECT CAST(test_id AS BIGINT) AS test_id, round(chi2, 5) AS chi2, round(g2, 5) AS g2, CAST(dof AS BIGINT) AS dof FROM stats JOIN dofs USING (test_id)", name="ci_batch")
def ci_batch_bn(spark, sf_dir):
    out = ci_batch(bn(spark, sf_dir), _BN_TESTS)
    return _long(out.select("test_id", F.round("chi2", 5).alias("chi2"), F.round("g2", 5).alias("g2"), "dof"))


# Scores.


def _family_sql(child: str, parents: Sequence[str], kind: str, ess: float = 1.0, source: str = "lineitem") -> str:
    r, q = f"(SELECT count(DISTINCT {child}) FROM {source})", " * ".join([f"(SELECT count(DISTINCT {p}) FROM {source})" for p in parents] or ["1"])
    given = ", ".join(parents)
    inner = f"(SELECT {given + ',' if given else ''} {child}, count(*) AS n FROM {source} GROUP BY ALL)"
    outer = f"(SELECT {given + ',' if given else ''} count(*) AS n FROM {source} GROUP BY {given or '()'})"
    if kind == "bdeu":
        a, b = f"({ess} / ({r} * {q}))", f"({ess} / ({q}))"
        return f"SELECT (SELECT sum(lgamma(n + {a}) - lgamma({a})) FROM {inner}) - (SELECT sum(lgamma(n + {b}) - lgamma({b})) FROM {outer}) AS score"
    if kind == "k2":
        return f"SELECT (SELECT sum(lgamma(n + 1)) FROM {inner}) + (SELECT sum(lgamma({r}) - lgamma(n + {r})) FROM {outer}) AS score"
    free = f"{q} * ({r} - 1)"
    cost = f"{free} * ln((SELECT count(*) FROM {source})) / 2" if kind == "bic" else free
    return f"SELECT (SELECT sum(n * ln(n)) FROM {inner}) - (SELECT sum(n * ln(n)) FROM {outer}) - {cost} AS score"


_FAMILIES = [("l_returnflag", ["l_linestatus"]), ("l_discount", ["l_linestatus", "l_returnflag"]), ("l_linenumber", [])]


def _scores(spark, sf_dir, score, digits: int = 5) -> DataFrame:
    enc = raw(spark, sf_dir)
    families = [(enc.col_str2idx[c], _v(enc, *p)) for c, p in _FAMILIES]
    return _long(family_scores(enc, families, score, extensions=True)).select("family_id", F.round("score", digits).alias("score"))


def _scores_sql(kind: str) -> str:
    return " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS family_id, round(score, 5) AS score FROM ({_family_sql(c, p, kind)})" for k, (c, p) in enumerate(_FAMILIES))


@query(_scores_sql("bdeu"))
def bdeu_local(spark, sf_dir):
    return _scores(spark, sf_dir, BDeu(1.0))


@query(_scores_sql("bic"))
def bic_local(spark, sf_dir):
    return _scores(spark, sf_dir, BIC())


@query(_scores_sql("aic"))
def aic_local(spark, sf_dir):
    return _scores(spark, sf_dir, AIC())


@query(_scores_sql("k2"))
def k2_local(spark, sf_dir):
    return _scores(spark, sf_dir, K2())


_TRUE = {"audit": ["promo", "tax_hi"], "disc_hi": [], "promo": ["disc_hi", "qty_hi"], "qty_hi": [], "rush": ["promo"], "tax_hi": []}


@query("WITH " + BN_SQL + " SELECT round(sum(score), 4) AS score FROM (" + " UNION ALL ".join(_family_sql(c, p, "bdeu", source="bn") for c, p in _TRUE.items()) + ")")
def bdeu_network(spark, sf_dir):
    enc = bn(spark, sf_dir)
    total = network_score(enc, [_v(enc, *_TRUE[c]) for c in BN_VARS], BDeu(1.0))
    return spark.createDataFrame([(round(total, 4),)], "score double")


_SMALL = ["disc_hi", "promo", "qty_hi", "rush"]
_SMALL_FAMILIES = [(c, list(p)) for c in _SMALL for k in range(4) for p in combinations([v for v in _SMALL if v != c], k)]
_SMALL_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS child, {sum(1 << _SMALL.index(v) for v in p)} AS mask, score FROM ({_family_sql(c, p, 'bdeu', source='bn')})" for c, p in _SMALL_FAMILIES
)


@query(f"WITH {BN_SQL}, f AS ({_SMALL_SQL}) SELECT child, CAST(mask AS BIGINT) AS mask, round(score, 4) AS score FROM f")
def bdeu_all_families(spark, sf_dir):
    enc = bn(spark, sf_dir, _SMALL)
    found = score_map(enc, [(enc.col_str2idx[c], _v(enc, *p)) for c, p in _SMALL_FAMILIES], BDeu(1.0))
    rows = [(enc.col_idx2str[v], sum(1 << u for u in p), round(s, 4)) for (v, p), s in found.items()]
    return spark.createDataFrame(rows, "child string, mask long, score double")


# Graphs.  A fixture with one-way arcs, undirected edges and a separate part.
_ARCS = [(0, 1), (1, 0), (1, 2), (3, 2), (2, 4), (4, 5), (5, 4), (4, 6), (7, 8), (8, 9), (6, 5), (0, 3), (3, 0), (1, 3), (8, 10), (10, 8), (7, 10), (11, 4)]
_N = 13
_EDGES_SQL = "e(src, dst) AS (VALUES " + ", ".join(f"({u}::BIGINT, {v}::BIGINT)" for u, v in _ARCS) + f"), nodes AS (SELECT CAST(id AS BIGINT) AS id FROM range(0, {_N}) AS r(id))"
_ONE_WAY = "ow AS (SELECT src, dst FROM e WHERE (dst, src) NOT IN (SELECT (src, dst) FROM e))"
_BOTH = "bw AS (SELECT src, dst FROM e WHERE (dst, src) IN (SELECT (src, dst) FROM e))"


def _edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_ARCS, "src long, dst long")


def _nodes(spark: SparkSession, n: int = _N) -> DataFrame:
    return spark.range(n)


@query(f"WITH {_EDGES_SQL} SELECT src, dst FROM (SELECT * FROM e UNION SELECT * FROM (VALUES (9::BIGINT, 7::BIGINT), (0::BIGINT, 1::BIGINT)) AS a(src, dst)) WHERE (src, dst) NOT IN (SELECT (2::BIGINT, 4::BIGINT))")
def edge_ops(spark, sf_dir):
    more = spark.createDataFrame([(9, 7), (0, 1)], "src long, dst long")
    return graph.remove_arcs(graph.add_arcs(_edges(spark), more), spark.createDataFrame([(2, 4)], "src long, dst long"))


@query("SELECT CAST(a AS BIGINT) AS src, CAST(b AS BIGINT) AS dst FROM range(0, 13) AS x(a), range(0, 13) AS y(b) WHERE a <> b")
def complete_graph(spark, sf_dir):
    return graph.complete_graph(_nodes(spark))


@query("SELECT CAST(a AS BIGINT) AS src, CAST(b AS BIGINT) AS dst FROM range(0, 6) AS x(a), range(0, 6) AS y(b) WHERE a <> b")
def rai_stub(spark, sf_dir):
    return _long(rai(bn(spark, sf_dir), ChiSquare(0.01), 6).edges(spark))


@query(f"WITH {_EDGES_SQL} SELECT src, dst, (dst, src) IN (SELECT (src, dst) FROM e) AS undirected FROM e")
def edge_kinds(spark, sf_dir):
    return graph.edge_kinds(_edges(spark))


@query(f"WITH {_EDGES_SQL} SELECT src, dst FROM e WHERE (src, dst) NOT IN (SELECT unnest([(1::BIGINT, 0::BIGINT), (4::BIGINT, 5::BIGINT)]))")
def orient(spark, sf_dir):
    return graph.orient(_edges(spark), spark.createDataFrame([(0, 1), (5, 4), (1, 2), (9, 1)], "src long, dst long"))


@query(f"WITH {_EDGES_SQL} SELECT DISTINCT id, neighbor FROM (SELECT src AS id, dst AS neighbor FROM e UNION ALL SELECT dst, src FROM e)")
def neighbors(spark, sf_dir):
    return graph.neighbors(_edges(spark))


@query(f"WITH {_EDGES_SQL}, {_BOTH} SELECT src, dst FROM bw")
def und_neighbors(spark, sf_dir):
    return graph.both_ways(_edges(spark))


@query(f"WITH {_EDGES_SQL}, {_ONE_WAY} SELECT dst AS id, src AS parent FROM ow")
def dir_parents(spark, sf_dir):
    return graph.one_way(_edges(spark)).select(F.col("dst").alias("id"), F.col("src").alias("parent"))


def _closure_sql(arcs: str) -> str:
    return f"WITH RECURSIVE {_EDGES_SQL}, {_ONE_WAY}, t(src, dst) AS (SELECT id, id FROM nodes UNION SELECT t.src, a.dst FROM t JOIN ({arcs}) a ON t.dst = a.src) SELECT src, dst FROM t"


@query(_closure_sql("SELECT src, dst FROM ow"))
def closure_directed(spark, sf_dir):
    return graph.closure(graph.one_way(_edges(spark)), _nodes(spark))


@query(_closure_sql("SELECT src, dst FROM e"))
def closure_semi(spark, sf_dir):
    return graph.closure(_edges(spark), _nodes(spark))


@query(_closure_sql("SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e"))
def closure_conn(spark, sf_dir):
    edges = _edges(spark)
    return graph.closure(edges.unionByName(graph.reversed_arcs(edges)), _nodes(spark))


@query(f"WITH {_EDGES_SQL}, {_ONE_WAY}, {_BOTH} SELECT DISTINCT b.src AS z, b.dst AS y FROM bw b JOIN ow o ON o.dst = b.dst WHERE o.src <> b.src AND (o.src, b.src) NOT IN (SELECT (src, dst) FROM e) AND (b.src, o.src) NOT IN (SELECT (src, dst) FROM e)")
def unshielded_colliders(spark, sf_dir):
    return graph.unshielded_colliders(_edges(spark))


# The edges above, and at higher numbers one place for each of the rules 1, 3 and 4.
_MEEK = [
    *_ARCS, (100, 101), (101, 102), (102, 101), *((110, v) for v in (111, 112, 113)), *((v, 110) for v in (111, 112, 113)), (111, 113), (112, 113),
    *((120, v) for v in (121, 122, 123)), *((v, 120) for v in (121, 122, 123)), (121, 122), (122, 123),
]
_MEEK_SQL = "WITH e(src, dst) AS (VALUES " + ", ".join(f"({u}::BIGINT, {v}::BIGINT)" for u, v in _MEEK) + f"), {_ONE_WAY}, {_BOTH}, adj AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


def _meek_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_MEEK, "src long, dst long")


@query(f"{_MEEK_SQL} SELECT DISTINCT bw.src, bw.dst FROM ow JOIN bw ON ow.dst = bw.src WHERE ow.src <> bw.dst AND (ow.src, bw.dst) NOT IN (SELECT (src, dst) FROM adj)")
def meek_r1(spark, sf_dir):
    return graph.meek_rule1(_meek_edges(spark))


@query(f"{_MEEK_SQL} SELECT DISTINCT bw.src, bw.dst FROM ow a JOIN ow b ON a.dst = b.src JOIN bw ON bw.src = a.src AND bw.dst = b.dst")
def meek_r2(spark, sf_dir):
    return graph.meek_rule2(_meek_edges(spark))


@query(f"""{_MEEK_SQL} SELECT DISTINCT l.src, l.dst FROM bw l JOIN bw p ON p.src = l.src JOIN ow c ON c.src = p.dst AND c.dst = l.dst
 JOIN bw q ON q.src = l.src AND q.dst <> p.dst JOIN ow d ON d.src = q.dst AND d.dst = l.dst WHERE (p.dst, q.dst) NOT IN (SELECT (src, dst) FROM adj)""")
def meek_r3(spark, sf_dir):
    return graph.meek_rule3(_meek_edges(spark))


@query(f"""{_MEEK_SQL} SELECT DISTINCT l.src, l.dst FROM bw l JOIN bw p ON p.src = l.src JOIN ow d ON d.src = p.dst JOIN ow c ON c.src = d.dst AND c.dst = l.dst
 JOIN adj ON adj.src = l.src AND adj.dst = c.src WHERE p.dst <> l.dst AND (p.dst, l.dst) NOT IN (SELECT (src, dst) FROM adj)""")
def meek_r4(spark, sf_dir):
    return graph.meek_rule4(_meek_edges(spark))


_ASIA = dag("asia")
_ASIA_NAMES = sorted(NETWORKS["asia"])
_ASIA_SQL = "e(src, dst) AS (VALUES " + ", ".join(f"({u}::BIGINT, {v}::BIGINT)" for u, v in _ASIA.arcs()) + ")"
_DSEP = [(x, y, z) for k in range(3) for x, y in combinations(range(8), 2) for z in combinations([v for v in range(8) if v not in (x, y)], k)]
_DSEP_SQL = f"""WITH RECURSIVE {_ASIA_SQL}, up(node, a) AS (SELECT id, id FROM range(0, 8) AS r(id) UNION SELECT up.node, e.src FROM up JOIN e ON e.dst = up.a),
t(test_id, x, y, z) AS (VALUES {", ".join(f"({k}, {x}, {y}, {list(z)}::INT[])" for k, (x, y, z) in enumerate(_DSEP))}),
old AS (SELECT DISTINCT test_id, a FROM (SELECT test_id, unnest(list_concat([x, y], z)) AS node FROM t) JOIN up USING (node)),
arc AS (SELECT o.test_id, src, dst FROM e JOIN old o ON o.a = src JOIN old p ON p.a = dst AND p.test_id = o.test_id),
m0 AS (SELECT test_id, src AS a, dst AS b FROM arc UNION SELECT i.test_id, i.src, j.src FROM arc i JOIN arc j ON i.test_id = j.test_id AND i.dst = j.dst AND i.src <> j.src),
m AS (SELECT * FROM m0 UNION SELECT test_id, b, a FROM m0),
seen(test_id, id) AS (SELECT test_id, x FROM t UNION SELECT m.test_id, m.b FROM seen JOIN m ON m.test_id = seen.test_id AND m.a = seen.id JOIN t ON t.test_id = m.test_id WHERE NOT list_contains(t.z, m.b))
SELECT CAST(test_id AS BIGINT) AS test_id, (test_id, y) NOT IN (SELECT (test_id, id) FROM seen) AS separated FROM t"""


@query(_DSEP_SQL)
def dsep(spark, sf_dir):
    tests = spark.createDataFrame([(k, x, y, list(z)) for k, (x, y, z) in enumerate(_DSEP)], "test_id long, x long, y long, z array<long>")
    return separated_table(_long(_ASIA.edges(spark)), _nodes(spark, 8), tests)


@query(_DSEP_SQL)
def oracle_ci(spark, sf_dir):
    return spark.createDataFrame([(k, d_separated(_ASIA, x, y, z)) for k, (x, y, z) in enumerate(_DSEP)], "test_id long, separated boolean")


_ALARM = dag("alarm")
_ALARM_SQL = "e(src, dst) AS (VALUES " + ", ".join(f"({u}::BIGINT, {v}::BIGINT)" for u, v in _ALARM.arcs()) + ")"
_UP_SQL = f"WITH RECURSIVE {_ALARM_SQL}, up(node, ancestor) AS (SELECT CAST(id AS BIGINT), CAST(id AS BIGINT) FROM range(0, 37) AS r(id) UNION SELECT up.node, e.src FROM up JOIN e ON e.dst = up.ancestor)"


@query(_UP_SQL + " SELECT node, ancestor FROM up", name="ancestors")
def ancestors_alarm(spark, sf_dir):
    return ancestors(_long(_ALARM.edges(spark)), _nodes(spark, 37))


@query(_UP_SQL + " SELECT CAST(a AS BIGINT) AS u, CAST(b AS BIGINT) AS v, (b, a) IN (SELECT (node, ancestor) FROM up) AS is_ancestor FROM range(0, 37) AS x(a), range(0, 37) AS y(b)")
def is_ancestor(spark, sf_dir):
    rows = [(u, v, _ALARM.is_ancestor(u, v)) for u in range(37) for v in range(37)]
    return spark.createDataFrame(rows, "u long, v long, is_ancestor boolean")


@query(f"WITH {_ALARM_SQL} SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM e UNION SELECT i.src, j.src FROM e i JOIN e j ON i.dst = j.dst AND i.src < j.src", name="moral_graph")
def moral_graph_alarm(spark, sf_dir):
    return moral_graph(_long(_ALARM.edges(spark)))


_NAMED = [(_ASIA_NAMES[u], _ASIA_NAMES[v]) for u, v in _ASIA.arcs()]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{u}', '{v}')" for u, v in _NAMED) + ") AS t(src_name, dst_name)")
def edges_named(spark, sf_dir):
    return io.named(_ASIA.edges(spark), io.nodes(spark, _ASIA_NAMES))


@query(f"WITH {_ASIA_SQL} SELECT src, dst FROM e")
def edges_indexed(spark, sf_dir):
    return _long(io.indexed(spark.createDataFrame(_NAMED, "src_name string, dst_name string"), io.nodes(spark, _ASIA_NAMES)))


# Metrics.


@query(f"WITH {_EDGES_SQL}, {_ONE_WAY}, {_BOTH} SELECT src, dst, 'directed' AS kind FROM ow UNION ALL SELECT src, dst, 'undirected' FROM bw WHERE src < dst")
def split_edges(spark, sf_dir):
    return metrics.split_edges(_edges(spark))


@query(f"WITH {_EDGES_SQL} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e")
def skeleton(spark, sf_dir):
    return metrics.skeleton(_edges(spark))


def _pattern_ctes(e: str, p: str) -> str:
    """CTEs that end with the pattern `p` of the edges `e`."""
    return f"""{p}ow AS (SELECT src, dst FROM {e} WHERE (dst, src) NOT IN (SELECT (src, dst) FROM {e})),
 {p}sk AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM {e}),
 {p}vs AS (SELECT a.src AS a, a.dst AS mid, b.src AS b FROM {p}ow a JOIN {p}ow b ON a.dst = b.dst AND a.src < b.src WHERE (a.src, b.src) NOT IN (SELECT (src, dst) FROM {p}sk)),
 {p}back AS (SELECT mid AS src, a AS dst FROM {p}vs UNION SELECT mid, b FROM {p}vs),
 {p} AS (SELECT src, dst FROM (SELECT src, dst FROM {p}sk UNION ALL SELECT dst, src FROM {p}sk) WHERE (src, dst) NOT IN (SELECT (src, dst) FROM {p}back))"""


@query(f"WITH {_EDGES_SQL}, {_pattern_ctes('e', 'p')} SELECT a, mid, b FROM pvs")
def v_structures(spark, sf_dir):
    return metrics.v_structures(_edges(spark))


@query(f"WITH {_EDGES_SQL}, {_pattern_ctes('e', 'p')} SELECT src, dst FROM p")
def pattern(spark, sf_dir):
    return metrics.pattern(_edges(spark))


_OTHER = [(1, 0), (1, 2), (2, 3), (3, 2), (2, 4), (5, 4), (4, 6), (7, 8), (9, 8), (3, 0), (8, 10), (10, 8), (7, 10), (11, 4), (12, 4), (0, 12)]
_OTHER_SQL = "o(src, dst) AS (VALUES " + ", ".join(f"({u}::BIGINT, {v}::BIGINT)" for u, v in _OTHER) + ")"
_KIND = "CASE WHEN (dst, src) IN (SELECT (src, dst) FROM {0}) THEN 0 WHEN src < dst THEN 1 ELSE -1 END"


@query(f"""WITH {_EDGES_SQL}, {_OTHER_SQL}, {_pattern_ctes("e", "p")}, {_pattern_ctes("o", "q")},
 tt AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, {_KIND.format("p")} AS t FROM p), pp AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, {_KIND.format("q")} AS p FROM q),
 f AS (SELECT t, p FROM tt FULL JOIN pp USING (a, b)),
 c AS (SELECT count(*) FILTER (p IS NULL) AS me, count(*) FILTER (t IS NULL) AS ee, count(*) FILTER (t = 0 AND p <> 0) AS ed, count(*) FILTER (t <> 0 AND p = 0) AS md, count(*) FILTER (t * p = -1) AS rd FROM f)
 SELECT me + ee + ed + md + rd AS "SHD", me AS "ME", ee AS "EE", ed + md + rd AS "DE", ed AS "ED", md AS "MD", rd AS "RD" FROM c""")
def shd(spark, sf_dir):
    return metrics.structural_errors(_edges(spark), spark.createDataFrame(_OTHER, "src long, dst long"))


# Searches.


def _arcs_sql(arcs: Sequence[tuple[str, str]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{u}', '{v}')" for u, v in sorted(arcs)) + ") AS t(src_name, dst_name)"


def _named_arcs(spark: SparkSession, g: PDAG, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(names[u], names[v]) for u, v in g.arcs()], "src_name string, dst_name string")


_CRITICAL = "CASE dof WHEN 0 THEN true WHEN 1 THEN chi2 <= 6.634896601021214 WHEN 2 THEN chi2 <= 9.21034037197618 END"
_SKELETON = _BATCH_CTES + f""", i AS (SELECT x, y, tests.z AS z, {_CRITICAL} AS ind FROM stats JOIN dofs USING (test_id) JOIN tests USING (test_id)),
l0 AS (SELECT x, y FROM i WHERE len(z) = 0 AND NOT ind), a0 AS (SELECT x, y FROM l0 UNION ALL SELECT y, x FROM l0),
l1 AS (SELECT x, y FROM l0 WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.x = l0.x AND i.y = l0.y AND len(i.z) = 1 AND i.ind AND ((l0.x, i.z[1]) IN (SELECT (x, y) FROM a0) OR (l0.y, i.z[1]) IN (SELECT (x, y) FROM a0))))"""


@query("WITH " + _SKELETON + " SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM l0")
def pc_skeleton_l0(spark, sf_dir):
    return _skeleton_after(spark, sf_dir, 0)


@query("WITH " + _SKELETON + " SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM l1")
def pc_skeleton_l1(spark, sf_dir):
    return _skeleton_after(spark, sf_dir, 1)


def _skeleton_after(spark, sf_dir, k: int) -> DataFrame:
    found, _ = build_skeleton(bn(spark, sf_dir), len(BN_VARS), ChiSquare(0.01), k, True)
    return spark.createDataFrame([(u, v) for u, v in found.arcs() if u < v], "x long, y long")


# The pattern of the true network; promo - rush stays undirected.
_BN_PATTERN = [("disc_hi", "promo"), ("qty_hi", "promo"), ("promo", "audit"), ("tax_hi", "audit"), ("promo", "rush"), ("rush", "promo")]


@query(_arcs_sql(_BN_PATTERN))
def pc_chi2(spark, sf_dir):
    return _named_arcs(spark, pc(bn(spark, sf_dir), ChiSquare(0.01), len(BN_VARS)), BN_VARS)


@query(_arcs_sql([(p, c) for c, ps in _TRUE.items() for p in ps]))
def exhaustive_bdeu(spark, sf_dir):
    return _named_arcs(spark, exhaustive_search(bn(spark, sf_dir), BDeu(1.0), 3), BN_VARS)


# For each order of four variables the best parents among those before; the best order has the best score.
_BEST_SQL = f"""WITH {BN_SQL}, f AS MATERIALIZED ({_SMALL_SQL}), v(child, bit) AS (VALUES {", ".join(f"('{c}', {1 << i})" for i, c in enumerate(_SMALL))}),
 o AS (SELECT a.child AS a, b.child AS b, c.child AS c, d.child AS d, a.bit AS ba, b.bit AS bb, c.bit AS bc FROM v a JOIN v b ON b.bit <> a.bit JOIN v c ON c.bit NOT IN (a.bit, b.bit) JOIN v d ON d.bit NOT IN (a.bit, b.bit, c.bit)),
 best AS (SELECT child, pool, max(score) AS score FROM f, range(0, 16) AS p(pool) WHERE mask & ~pool = 0 GROUP BY ALL)
 SELECT round(max(w.score + x.score + y.score + z.score), 3) AS score FROM o JOIN best w ON w.child = a AND w.pool = 0 JOIN best x ON x.child = b AND x.pool = ba JOIN best y ON y.child = c AND y.pool = ba + bb JOIN best z ON z.child = d AND z.pool = ba + bb + bc"""


@query(_BEST_SQL)
def exhaustive_small(spark, sf_dir):
    enc = bn(spark, sf_dir, _SMALL)
    found = exhaustive_search(enc, BDeu(1.0), 3)
    return spark.createDataFrame([(round(network_score(enc, [found.predecessors(v) for v in range(4)], BDeu(1.0)), 3),)], "score double")


def _pattern_sql(name: str) -> str:
    """The arcs of v-structures, and all other edges both ways, from the network's arcs."""
    arcs = ", ".join(f"('{u}', '{v}')" for v, ps in sorted(NETWORKS[name].items()) for u in ps)
    return f"""WITH a(u, v) AS (VALUES {arcs}), adj AS (SELECT u, v FROM a UNION SELECT v, u FROM a),
 fixed AS (SELECT DISTINCT x.u, x.v FROM a x JOIN a y ON x.v = y.v AND x.u <> y.u WHERE (x.u, y.u) NOT IN (SELECT (u, v) FROM adj))
 SELECT u AS src_name, v AS dst_name FROM adj WHERE (v, u) NOT IN (SELECT (u, v) FROM fixed)"""


def _pc_oracle(name: str) -> None:
    truth = dag(name)
    names = sorted(NETWORKS[name])

    def run(spark, sf_dir):
        from bnspark.operators.citest import OracleGraph

        return _named_arcs(spark, pc(truth.num_vars, OracleGraph(truth), truth.num_vars), names)

    run.__name__ = f"pc_oracle_{name}"
    query(_pattern_sql(name))(run)


for _name in NETWORKS:
    _pc_oracle(_name)


@query(_BEST_SQL)
def sa_best_score(spark, sf_dir):
    enc = bn(spark, sf_dir, _SMALL)
    found = simulated_annealing(enc, BDeu(1.0), 3, 8_000, init_temp=20_000.0, cooling_rate=0.998, seed=1, num_chains=16)
    score = network_score(enc, [found.predecessors(v) for v in range(enc.num_of_vars)], BDeu(1.0))
    return spark.createDataFrame([(round(score, 3),)], "score double")
