"""Example networks from the literature, and samples from them."""

from __future__ import annotations

from itertools import accumulate, product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bnspark.operators.graph import PDAG

# Arcs of published benchmark networks, child: parents.
CANCER = {"Cancer": ["Pollution", "Smoker"], "Dyspnoea": ["Cancer"], "Pollution": [], "Smoker": [], "Xray": ["Cancer"]}
ASIA = {
    "asia": [], "bronc": ["smoke"], "dysp": ["bronc", "either"], "either": ["lung", "tub"], "lung": ["smoke"], "smoke": [],
    "tub": ["asia"], "xray": ["either"],
}
CHILD = {
    "Age": ["Disease", "Sick"], "BirthAsphyxia": [], "CO2": ["LungParench"], "CO2Report": ["CO2"], "CardiacMixing": ["Disease"],
    "ChestXray": ["LungFlow", "LungParench"], "Disease": ["BirthAsphyxia"], "DuctFlow": ["Disease"], "Grunting": ["LungParench", "Sick"],
    "GruntingReport": ["Grunting"], "HypDistrib": ["CardiacMixing", "DuctFlow"], "HypoxiaInO2": ["CardiacMixing", "LungParench"],
    "LVH": ["Disease"], "LVHreport": ["LVH"], "LowerBodyO2": ["HypDistrib", "HypoxiaInO2"], "LungFlow": ["Disease"],
    "LungParench": ["Disease"], "RUQO2": ["HypoxiaInO2"], "Sick": ["Disease"], "XrayReport": ["ChestXray"],
}
ALARM = {
    "ANAPHYLAXIS": [], "ARTCO2": ["VENTALV"], "BP": ["CO", "TPR"], "CATECHOL": ["ARTCO2", "INSUFFANESTH", "SAO2", "TPR"],
    "CO": ["HR", "STROKEVOLUME"], "CVP": ["LVEDVOLUME"], "DISCONNECT": [], "ERRCAUTER": [], "ERRLOWOUTPUT": [],
    "EXPCO2": ["ARTCO2", "VENTLUNG"], "FIO2": [], "HISTORY": ["LVFAILURE"], "HR": ["CATECHOL"], "HRBP": ["ERRLOWOUTPUT", "HR"],
    "HREKG": ["ERRCAUTER", "HR"], "HRSAT": ["ERRCAUTER", "HR"], "HYPOVOLEMIA": [], "INSUFFANESTH": [], "INTUBATION": [],
    "KINKEDTUBE": [], "LVEDVOLUME": ["HYPOVOLEMIA", "LVFAILURE"], "LVFAILURE": [], "MINVOL": ["INTUBATION", "VENTLUNG"],
    "MINVOLSET": [], "PAP": ["PULMEMBOLUS"], "PCWP": ["LVEDVOLUME"], "PRESS": ["INTUBATION", "KINKEDTUBE", "VENTTUBE"],
    "PULMEMBOLUS": [], "PVSAT": ["FIO2", "VENTALV"], "SAO2": ["PVSAT", "SHUNT"], "SHUNT": ["INTUBATION", "PULMEMBOLUS"],
    "STROKEVOLUME": ["HYPOVOLEMIA", "LVFAILURE"], "TPR": ["ANAPHYLAXIS"], "VENTALV": ["INTUBATION", "VENTLUNG"],
    "VENTLUNG": ["INTUBATION", "KINKEDTUBE", "VENTTUBE"], "VENTMACH": ["MINVOLSET"], "VENTTUBE": ["DISCONNECT", "VENTMACH"],
}
NETWORKS = {"cancer": CANCER, "asia": ASIA, "child": CHILD, "alarm": ALARM}
# P(state | parents' states in order): that of the first of two states, or of all states.
CANCER_STATES = {"Cancer": ("True", "False"), "Dyspnoea": ("True", "False"), "Pollution": ("high", "low"), "Smoker": ("True", "False"), "Xray": ("positive", "negative")}
CANCER_TABLES = {
    "Pollution": {(): 0.1}, "Smoker": {(): 0.3},
    "Cancer": {("low", "True"): 0.03, ("high", "True"): 0.05, ("low", "False"): 0.001, ("high", "False"): 0.02},
    "Xray": {("True",): 0.9, ("False",): 0.2}, "Dyspnoea": {("True",): 0.65, ("False",): 0.3},
}
ASIA_STATES = {v: ("yes", "no") for v in ASIA}
ASIA_TABLES = {
    "asia": {(): 0.01}, "tub": {("yes",): 0.05, ("no",): 0.01}, "smoke": {(): 0.5}, "lung": {("yes",): 0.1, ("no",): 0.01},
    "bronc": {("yes",): 0.6, ("no",): 0.3}, "xray": {("yes",): 0.98, ("no",): 0.05},
    "either": {("yes", "yes"): 1.0, ("yes", "no"): 1.0, ("no", "yes"): 1.0, ("no", "no"): 0.0},
    "dysp": {("yes", "yes"): 0.9, ("no", "yes"): 0.7, ("yes", "no"): 0.8, ("no", "no"): 0.1},
}
CHILD_STATES = {
    "Age": ("0-3_days", "4-10_days", "11-30_days"), "BirthAsphyxia": ("yes", "no"), "CO2": ("Normal", "Low", "High"), "CO2Report": ("<7.5", ">=7.5"),
    "CardiacMixing": ("None", "Mild", "Complete", "Transp."), "ChestXray": ("Normal", "Oligaemic", "Plethoric", "Grd_Glass", "Asy/Patch"),
    "Disease": ("PFC", "TGA", "Fallot", "PAIVS", "TAPVD", "Lung"), "DuctFlow": ("Lt_to_Rt", "None", "Rt_to_Lt"), "Grunting": ("yes", "no"),
    "GruntingReport": ("yes", "no"), "HypDistrib": ("Equal", "Unequal"), "HypoxiaInO2": ("Mild", "Moderate", "Severe"), "LVH": ("yes", "no"),
    "LVHreport": ("yes", "no"), "LowerBodyO2": ("<5", "5-12", "12+"), "LungFlow": ("Normal", "Low", "High"),
    "LungParench": ("Normal", "Congested", "Abnormal"), "RUQO2": ("<5", "5-12", "12+"), "Sick": ("yes", "no"),
    "XrayReport": ("Normal", "Oligaemic", "Plethoric", "Grd_Glass", "Asy/Patchy"),
}
# The rows of a table follow its parents' states, the last parent's fastest.
CHILD_ROWS = {
    "BirthAsphyxia": [0.1],
    "Disease": [(0.20, 0.30, 0.25, 0.15, 0.05, 0.05), (0.03061224, 0.33673469, 0.29591837, 0.23469388, 0.05102041, 0.05102041)],
    "LVH": [0.10, 0.10, 0.10, 0.90, 0.05, 0.10],
    "DuctFlow": [(0.15, 0.05, 0.80), (0.10, 0.80, 0.10), (0.80, 0.20, 0.00), (1.00, 0.00, 0.00), (0.33, 0.33, 0.34), (0.20, 0.40, 0.40)],
    "CardiacMixing": [(0.40, 0.43, 0.15, 0.02), (0.02, 0.09, 0.09, 0.80), (0.02, 0.16, 0.80, 0.02), (0.01, 0.02, 0.95, 0.02), (0.01, 0.03, 0.95, 0.01), (0.40, 0.53, 0.05, 0.02)],
    "LungParench": [(0.60, 0.10, 0.30), (0.80, 0.05, 0.15), (0.80, 0.05, 0.15), (0.80, 0.05, 0.15), (0.10, 0.60, 0.30), (0.03, 0.25, 0.72)],
    "LungFlow": [(0.30, 0.65, 0.05), (0.20, 0.05, 0.75), (0.15, 0.80, 0.05), (0.10, 0.85, 0.05), (0.30, 0.10, 0.60), (0.70, 0.10, 0.20)],
    "Sick": [0.4, 0.3, 0.2, 0.3, 0.7, 0.7],
    "Age": [
        (0.95, 0.03, 0.02), (0.85, 0.10, 0.05), (0.80, 0.15, 0.05), (0.70, 0.20, 0.10), (0.70, 0.15, 0.15), (0.25, 0.25, 0.50),
        (0.80, 0.15, 0.05), (0.80, 0.15, 0.05), (0.80, 0.15, 0.05), (0.70, 0.20, 0.10), (0.90, 0.08, 0.02), (0.80, 0.15, 0.05),
    ],
    "LVHreport": [0.90, 0.05],
    "HypDistrib": [0.95, 0.05, 0.95, 0.95, 0.95, 0.50, 0.95, 0.95, 0.95, 0.95, 0.95, 0.50],
    "HypoxiaInO2": [
        (0.93, 0.05, 0.02), (0.15, 0.80, 0.05), (0.70, 0.20, 0.10), (0.10, 0.80, 0.10), (0.10, 0.75, 0.15), (0.10, 0.65, 0.25),
        (0.10, 0.70, 0.20), (0.05, 0.65, 0.30), (0.10, 0.50, 0.40), (0.02, 0.18, 0.80), (0.10, 0.30, 0.60), (0.02, 0.18, 0.80),
    ],
    "CO2": [(0.80, 0.10, 0.10), (0.65, 0.05, 0.30), (0.45, 0.05, 0.50)],
    "ChestXray": [
        (0.90, 0.03, 0.03, 0.01, 0.03), (0.05, 0.02, 0.15, 0.70, 0.08), (0.05, 0.05, 0.05, 0.05, 0.80), (0.14, 0.80, 0.02, 0.02, 0.02),
        (0.05, 0.22, 0.08, 0.50, 0.15), (0.05, 0.15, 0.05, 0.05, 0.70), (0.15, 0.01, 0.79, 0.04, 0.01), (0.05, 0.02, 0.40, 0.40, 0.13),
        (0.24, 0.33, 0.03, 0.34, 0.06),
    ],
    "Grunting": [0.20, 0.05, 0.40, 0.20, 0.80, 0.60],
    "LowerBodyO2": [(0.10, 0.30, 0.60), (0.30, 0.60, 0.10), (0.50, 0.40, 0.10), (0.40, 0.50, 0.10), (0.50, 0.45, 0.05), (0.60, 0.35, 0.05)],
    "RUQO2": [(0.10, 0.30, 0.60), (0.30, 0.60, 0.10), (0.50, 0.40, 0.10)],
    "CO2Report": [0.90, 0.90, 0.10],
    "XrayReport": [
        (0.80, 0.06, 0.06, 0.02, 0.06), (0.10, 0.80, 0.02, 0.02, 0.06), (0.10, 0.02, 0.80, 0.02, 0.06), (0.08, 0.02, 0.10, 0.60, 0.20), (0.08, 0.02, 0.10, 0.20, 0.60),
    ],
    "GruntingReport": [0.80, 0.10],
}
# Numbers of states.
ALARM_CARDS = {
    "ANAPHYLAXIS": 2, "ARTCO2": 3, "BP": 3, "CATECHOL": 2, "CO": 3, "CVP": 3, "DISCONNECT": 2, "ERRCAUTER": 2, "ERRLOWOUTPUT": 2, "EXPCO2": 4,
    "FIO2": 2, "HISTORY": 2, "HR": 3, "HRBP": 3, "HREKG": 3, "HRSAT": 3, "HYPOVOLEMIA": 2, "INSUFFANESTH": 2, "INTUBATION": 3, "KINKEDTUBE": 2,
    "LVEDVOLUME": 3, "LVFAILURE": 2, "MINVOL": 4, "MINVOLSET": 3, "PAP": 3, "PCWP": 3, "PRESS": 4, "PULMEMBOLUS": 2, "PVSAT": 3, "SAO2": 3,
    "SHUNT": 2, "STROKEVOLUME": 3, "TPR": 3, "VENTALV": 4, "VENTLUNG": 4, "VENTMACH": 4, "VENTTUBE": 4,
}
States = dict[str, tuple[str, ...]]
Tables = dict[str, dict[tuple[str, ...], float | tuple[float, ...]]]


def _by_rows(parents: dict[str, list[str]], states: States, rows: dict[str, list]) -> Tables:
    return {v: dict(zip(product(*(states[u] for u in parents[v])), rows[v], strict=True)) for v in parents}


def ruled_tables(parents: dict[str, list[str]], states: States, strength: float = 0.8) -> Tables:
    """Tables by a rule: the states of the parents, weighted by their places, choose the state that has
    `strength`; the others share the rest.  Roots favour their states in descending order."""
    out: Tables = {}
    for v, above in parents.items():
        n = len(states[v])
        out[v] = {}
        for config in product(*(range(len(states[u])) for u in above)):
            likely = sum((i + 1) * s for i, s in enumerate(config)) % n
            p = [strength if k == likely else (1 - strength) / (n - 1) for k in range(n)] if above else [(n - k) / (n * (n + 1) / 2) for k in range(n)]
            out[v][tuple(states[u][s] for u, s in zip(above, config, strict=True))] = tuple(p)
    return out


ALARM_STATES: States = {v: tuple(map(str, range(n))) for v, n in ALARM_CARDS.items()}
# The tables of alarm are ruled_tables(), not the published ones.
TABLES: dict[str, tuple[States, Tables]] = {
    "cancer": (CANCER_STATES, CANCER_TABLES), "asia": (ASIA_STATES, ASIA_TABLES), "child": (CHILD_STATES, _by_rows(CHILD, CHILD_STATES, CHILD_ROWS)),
    "alarm": (ALARM_STATES, ruled_tables(ALARM, ALARM_STATES)),
}


def dag(name: str) -> PDAG:
    """The network with its nodes numbered in the order of their names."""
    parents = NETWORKS[name]
    at = {v: i for i, v in enumerate(sorted(parents))}
    return PDAG(len(at), [(at[u], at[v]) for v, ps in parents.items() for u in ps])


def _order(parents: dict[str, list[str]]) -> list[str]:
    done: list[str] = []
    while len(done) < len(parents):
        done += [v for v in sorted(parents) if v not in done and set(parents[v]) <= set(done)]
    return done


def _limits(p: float | tuple[float, ...]) -> list[float]:
    """Below which draw each state but the last comes up."""
    return [round(x, 12) for x in accumulate((p,) if isinstance(p, float) else p[:-1])]


def simulate(spark: SparkSession, name: str, rows: int, seed: int = 0) -> DataFrame:
    """Rows drawn from a network, each node after its parents; columns in the order of their names.  A draw
    is a hash of seed, row and node, so the rows are the same however many tasks make them."""
    parents, (states, tables) = NETWORKS[name], TABLES[name]
    out = spark.range(rows)
    for v in _order(parents):
        key = F.concat_ws("-", F.lit(seed), F.col("id"), F.lit(v))
        draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / float(1 << 32)
        value = F.lit(None).cast("string")
        for config, p in tables[v].items():
            own = F.lit(states[v][-1])
            for limit, state in reversed(list(zip(_limits(p), states[v], strict=False))):
                own = F.when(F.col("_draw") < limit, state).otherwise(own)
            hit = F.lit(True)
            for u, s in zip(parents[v], config, strict=True):
                hit = hit & (F.col(u) == s)
            value = F.when(hit, own).otherwise(value)
        out = out.withColumn("_draw", draw).withColumn(v, value)
    return out.select(*sorted(parents))


def simulate_sql(name: str, rows: int, seed: int = 0) -> str:
    """simulate() for DuckDB."""
    parents, (states, tables) = NETWORKS[name], TABLES[name]
    ctes, last = [f"n0 AS (SELECT range AS id FROM range({rows}))"], 0
    for v in _order(parents):
        cases = []
        for config, p in tables[v].items():
            hit = " AND ".join([f"\"{u}\" = '{s}'" for u, s in zip(parents[v], config, strict=True)] or ["true"])
            own = " ".join(f"WHEN draw < {limit!r} THEN '{s}'" for limit, s in zip(_limits(p), states[v], strict=False))
            cases.append(f"WHEN {hit} THEN CASE {own} ELSE '{states[v][-1]}' END")
        draw = f"('0x' || substr(md5('{seed}-' || id || '-{v}'), 1, 8))::UBIGINT / 4294967296.0::DOUBLE"
        ctes.append(f"n{last + 1} AS (SELECT * EXCLUDE (draw), CASE {' '.join(cases)} END AS \"{v}\" FROM (SELECT *, {draw} AS draw FROM n{last}))")
        last += 1
    return "WITH " + ",\n".join(ctes) + " SELECT " + ", ".join(f'"{v}"' for v in sorted(parents)) + f" FROM n{last}"
