"""ANSI SQL for the registered queries, written against the star schema alone."""

from __future__ import annotations

import re
from itertools import combinations

# Named parts of the SQL. A part may use parts that stand before it.
PARTS = {
    "coords": """
        SELECT vec_id AS idpozo, embedding[1]::DOUBLE * 60 - 63.5 AS lon,
               embedding[2]::DOUBLE * 60 - 38.5 AS lat, label
        FROM embeddings""",
    "wells": """
        SELECT c_custkey AS idpozo,
               c_name || '(' || CASE WHEN c_acctbal >= 5000 THEN left(c_mktsegment, 1)
                                     ELSE right(c_mktsegment, 1) END || ')' AS sigla,
               r_name AS cuenca, n_name AS provincia,
               nullif('BLOCK ' || (n_nationkey % 6), 'BLOCK 0') AS area,
               n_name || '/' || left(c_mktsegment, 3) AS yacimiento,
               nullif('F' || (n_nationkey % 7), 'F6') AS formprod,
               lower(c_mktsegment) AS formacion,
               CASE WHEN c_acctbal < 0 THEN 'SERVICIO' ELSE 'EXPLOTACION' END AS clasificacion,
               CASE WHEN c_mktsegment = 'BUILDING' THEN 'DESARROLLO' ELSE 'AVANZADA' END AS subclasificacion,
               CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'NO CONVENCIONAL'
                    ELSE 'CONVENCIONAL' END AS tipo_recurso,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'SHALE' WHEN 'MACHINERY' THEN 'TIGHT'
                    WHEN 'AUTOMOBILE' THEN NULL ELSE 'No informado' END AS sub_tipo_recurso,
               c_acctbal AS profundidad, n_nationkey::DOUBLE AS cota,
               c_acctbal >= 0 AS has_production, lon AS coordenadax, lat AS coordenaday
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN coords ON coords.idpozo = c_custkey""",
    "ord": """
        SELECT o_custkey AS idpozo, o_orderdate::DATE AS day, o_orderkey, o_orderstatus AS st,
               o_totalprice AS price, o_orderpriority AS prio
        FROM orders""",
    "production": """
        SELECT idpozo, date_trunc('month', day)::DATE AS fecha,
               round(sum(price) FILTER (WHERE st = 'F'), 2) AS prod_pet,
               round(sum(price) FILTER (WHERE st = 'O'), 2) AS prod_gas,
               round(sum(CASE WHEN prio = '5-LOW' THEN -price ELSE price END) FILTER (WHERE st = 'P'), 2) AS prod_agua,
               round(sum(price) FILTER (WHERE prio = '1-URGENT'), 2) AS iny_agua,
               round(sum(CASE WHEN prio = '2-HIGH' THEN price ELSE 0 END) FILTER (WHERE st = 'O'), 2) AS iny_gas,
               nullif(count(*) FILTER (WHERE st = 'F'), 0) * 300.0::DOUBLE AS tef,
               year(date_trunc('month', day))::INTEGER AS anio
        FROM ord GROUP BY 1, 2, 9""",
    "daily": "SELECT idpozo, day, arg_min(prio, o_orderkey) AS empresa FROM ord GROUP BY 1, 2",
    "starts": """
        SELECT * FROM (
            SELECT *, lag(empresa) OVER (PARTITION BY idpozo ORDER BY day) AS prev FROM daily
        ) WHERE empresa IS DISTINCT FROM prev""",
    "history": """
        SELECT * FROM (
            SELECT idpozo, left(empresa, 1) AS idempresa, empresa, day AS valid_from,
                   (lead(day) OVER (PARTITION BY idpozo ORDER BY day) - 1)::DATE AS valid_to
            FROM starts
        ) WHERE empresa <> '5-LOW'""",
    "wevents": """
        SELECT idpozo, day AS event_date, o_orderkey AS event_id,
               CASE st WHEN 'F' THEN 'Petrolífero' WHEN 'O' THEN 'Gasífero' ELSE 'Inyección de Agua' END AS tipopozo,
               prio AS tipoestado,
               CASE st WHEN 'F' THEN 'Bombeo Mecánico' WHEN 'O' THEN 'Surgencia Natural' END AS tipoextraccion
        FROM ord""",
    "changes": """
        SELECT * FROM wevents
        QUALIFY row_number() OVER (PARTITION BY idpozo, event_date ORDER BY event_id DESC) = 1""",
    "jobs": """
        SELECT l_suppkey AS idpozo,
               CASE WHEN l_tax >= 0.08 AND l_discount >= 0.1 AND l_quantity <= 4 THEN l_extendedprice / 100
                    WHEN l_tax >= 0.08 AND l_discount >= 0.1 AND l_quantity <= 5 THEN 0 END AS lateral_m,
               l_quantity::INTEGER AS stages, l_extendedprice AS sand_a,
               CASE WHEN l_returnflag <> 'N' THEN round(l_tax * 100) END AS sand_b,
               CASE WHEN l_returnflag <> 'R' THEN l_quantity * 10 END AS water,
               l_extendedprice AS psi, CASE WHEN l_returnflag = 'A' THEN l_quantity END AS hp,
               CASE WHEN l_linestatus = 'O' THEN strftime(l_shipdate, '%Y-%m-%d') ELSE 'sin fecha' END AS d0,
               strftime(l_shipdate, '%Y-%m-%d') AS d1,
               CASE l_returnflag WHEN 'A' THEN 'Punzado' WHEN 'N' THEN 'Tapón disparo' ELSE 'Jetteo' END AS completion,
               l_linestatus AS formation
        FROM lineitem""",
    "mode_completion": """
        SELECT idpozo, completion AS completion_type FROM (
            SELECT idpozo, completion, count(*) AS c FROM jobs GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY idpozo ORDER BY c DESC, completion) = 1""",
    "mode_formation": """
        SELECT idpozo, formation AS frac_formation FROM (
            SELECT idpozo, formation, count(*) AS c FROM jobs GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY idpozo ORDER BY c DESC, formation) = 1""",
    "frac": """
        SELECT j.*, completion_type, frac_formation FROM (
            SELECT idpozo, count(*) AS frac_jobs, max(lateral_m) AS lateral_m,
                   sum(stages)::BIGINT AS stages,
                   round(sum(sand_a + coalesce(sand_b, 0)), 2) AS proppant_t,
                   sum(water) AS water_m3, max(psi) AS max_pressure_psi, max(hp) AS max_hhp,
                   min(TRY_CAST(d0 AS DATE)) AS frac_first, max(TRY_CAST(d1 AS DATE)) AS frac_last
            FROM jobs GROUP BY 1) j
        JOIN mode_completion USING (idpozo) JOIN mode_formation USING (idpozo)""",
    "prod_summary": """
        SELECT idpozo,
               min(fecha) FILTER (WHERE coalesce(prod_pet, 0) + coalesce(prod_gas, 0) > 0) AS first_prod_month,
               max(fecha) FILTER (WHERE coalesce(prod_pet, 0) + coalesce(prod_gas, 0) > 0) AS last_prod_month,
               count(*) FILTER (WHERE coalesce(prod_pet, 0) + coalesce(prod_gas, 0) > 0) AS producing_months,
               round(sum(prod_pet), 2) AS cum_oil_m3, round(sum(prod_gas), 2) AS cum_gas_e3m3,
               round(sum(prod_agua), 2) AS cum_water_m3, round(sum(iny_agua), 2) AS cum_water_inj_m3,
               sum(CASE WHEN tef > 24 * day(last_day(fecha)) THEN 24 * day(last_day(fecha)) ELSE tef END) AS total_effective_hours
        FROM production GROUP BY 1""",
    "register": """
        SELECT idpozo, year(day) AS anio, month(day) AS mes FROM ord WHERE st = 'P'""",
    "attrs": """
        SELECT w.idpozo, w.sigla, w.cuenca, w.provincia, w.area, w.yacimiento, w.formprod,
               w.formacion, w.clasificacion, w.subclasificacion, w.tipo_recurso,
               w.sub_tipo_recurso, w.profundidad, w.cota, w.coordenadax AS lon,
               w.coordenaday AS lat, w.has_production,
               o.empresa AS operator_latest, o.idempresa AS operator_code_latest,
               s.tipopozo AS well_fluid_latest, s.tipoestado AS well_state_latest,
               s.tipoextraccion AS lift_method_latest, r.first_prod_declared,
               first_prod_month, last_prod_month, producing_months, cum_oil_m3, cum_gas_e3m3,
               cum_water_m3, cum_water_inj_m3, total_effective_hours,
               frac_jobs, lateral_m, stages, proppant_t, water_m3, max_pressure_psi, max_hhp,
               frac_first, frac_last, completion_type,
               CASE WHEN frac_jobs IS NULL OR lateral_m IS NULL THEN 'Unknown'
                    WHEN lateral_m >= 500 THEN 'Horizontal' ELSE 'Vertical' END AS trajectory,
               CASE WHEN sigla ILIKE '%(h)%' THEN '(h) horizontal'
                    WHEN sigla ILIKE '%(d)%' THEN '(d) directional' ELSE 'Not indicated' END AS name_marker,
               CASE WHEN frac_jobs IS NULL THEN
                        CASE WHEN sigla ILIKE '%(h)%' THEN 'Horizontal'
                             WHEN sigla ILIKE '%(d)%' THEN 'Directional' ELSE 'Unknown' END
                    WHEN lateral_m >= 500 THEN 'Horizontal'
                    WHEN sigla ILIKE '%(d)%' THEN 'Directional' ELSE 'Vertical' END AS trajectory_class,
               proppant_t * 1000 / nullif(lateral_m, 0) AS proppant_kg_per_m,
               water_m3 / nullif(lateral_m, 0) AS water_m3_per_m,
               lateral_m / nullif(stages, 0) AS stage_spacing_m,
               cum_gas_e3m3 * 1000 / nullif(cum_oil_m3, 0) AS gor_m3_m3
        FROM wells w
        LEFT JOIN (SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY idpozo ORDER BY valid_from DESC) = 1) o USING (idpozo)
        LEFT JOIN (SELECT * FROM wevents QUALIFY row_number() OVER (PARTITION BY idpozo ORDER BY event_date DESC, event_id DESC) = 1) s USING (idpozo)
        LEFT JOIN (SELECT idpozo, min(make_date(anio, mes, 1)) AS first_prod_declared FROM register GROUP BY 1) r USING (idpozo)
        LEFT JOIN prod_summary USING (idpozo)
        LEFT JOIN frac USING (idpozo)""",
    "fact": """
        SELECT p.idpozo, p.fecha, p.anio, p.prod_pet, p.prod_gas, p.prod_agua, p.iny_agua, p.iny_gas,
               CASE WHEN p.tef > 24 * day(last_day(p.fecha)) THEN 24 * day(last_day(p.fecha)) ELSE p.tef END AS tef,
               h.empresa AS operator_asof, e.tipopozo AS well_fluid_asof, e.tipoestado AS well_state_asof
        FROM production p
        LEFT JOIN history h ON h.idpozo = p.idpozo
             AND p.fecha BETWEEN h.valid_from AND coalesce(h.valid_to, DATE '9999-12-31')
        ASOF LEFT JOIN changes e ON e.idpozo = p.idpozo AND e.event_date <= p.fecha""",
    "cube": """
        SELECT p.fecha, a.cuenca, a.provincia, a.tipo_recurso, a.sub_tipo_recurso,
               coalesce(a.formprod, 'No informado') AS formation,
               coalesce(p.operator_asof, 'No informado') AS operator,
               coalesce(p.well_fluid_asof, 'No informado') AS well_fluid, a.trajectory,
               count(DISTINCT p.idpozo) AS wells,
               count(DISTINCT p.idpozo) FILTER (WHERE coalesce(prod_pet, 0) + coalesce(prod_gas, 0) > 0) AS wells_producing,
               round(sum(prod_pet), 2) AS oil_m3, round(sum(prod_gas), 2) AS gas_e3m3,
               round(sum(prod_agua), 2) AS water_m3, round(sum(iny_agua), 2) AS water_inj_m3,
               sum(tef) AS effective_hours
        FROM fact p JOIN attrs a USING (idpozo)
        GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9""",
    "block": """
        SELECT p.fecha, a.cuenca, a.area, a.yacimiento,
               coalesce(p.operator_asof, 'No informado') AS operator,
               a.trajectory, a.name_marker, a.trajectory_class,
               count(DISTINCT p.idpozo) AS wells,
               count(DISTINCT p.idpozo) FILTER (WHERE coalesce(prod_pet, 0) + coalesce(prod_gas, 0) > 0) AS wells_producing,
               round(sum(prod_pet), 2) AS oil_m3, round(sum(prod_gas), 2) AS gas_e3m3,
               round(sum(prod_agua), 2) AS water_m3
        FROM fact p JOIN attrs a USING (idpozo) WHERE a.area IS NOT NULL
        GROUP BY 1, 2, 3, 4, 5, 6, 7, 8""",
    "slim": """
        SELECT idpozo, sigla, cuenca, provincia, area, yacimiento, formprod AS formation,
               formacion AS formation_reported, tipo_recurso, sub_tipo_recurso, clasificacion,
               operator_latest AS operator, well_fluid_latest AS well_fluid,
               well_state_latest AS well_state, lift_method_latest AS lift_method,
               trajectory, name_marker, trajectory_class, completion_type,
               round(lon, 6) AS lon, round(lat, 6) AS lat, profundidad AS depth_m,
               first_prod_declared, first_prod_month, last_prod_month, producing_months,
               cum_oil_m3, cum_gas_e3m3, cum_water_m3, lateral_m, stages, proppant_t,
               water_m3 AS frac_water_m3, max_pressure_psi, proppant_kg_per_m, water_m3_per_m,
               stage_spacing_m, gor_m3_m3
        FROM attrs""",
    "curve_rows": """
        SELECT p.idpozo, prod_pet, prod_gas, prod_agua, trajectory,
               coalesce(sub_tipo_recurso, 'No informado') AS subtype, cuenca,
               coalesce(operator_latest, 'No informado') AS operator,
               coalesce(formprod, 'No informado') AS formation,
               coalesce(area, 'No informado') AS area,
               year(first_prod_month)::INTEGER AS vintage,
               date_diff('month', first_prod_month, p.fecha)::INTEGER AS month_on_prod
        FROM fact p JOIN attrs a USING (idpozo)
        WHERE p.fecha >= first_prod_month
          AND date_diff('month', first_prod_month, p.fecha) BETWEEN 0 AND 119""",
    "positive": "SELECT cum_oil_m3 AS v FROM attrs WHERE cum_oil_m3 > 0",
    "official": """
        SELECT strftime(l_shipdate, '%Y-%m') AS ym, r_name AS series, l_linestatus AS st,
               l_returnflag AS flag, l_extendedprice AS price
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
}

FLUIDS = {"prod_pet": "oil", "prod_gas": "gas", "prod_agua": "water"}


def sql(body: str) -> str:
    """``body`` with the parts it uses, and the parts those use, in front."""
    needed: set[str] = set()
    names = list(PARTS)

    def visit(text: str, limit: int) -> None:
        for name in names[:limit]:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                visit(PARTS[name], names.index(name))

    visit(body, len(names))
    head = ",\n".join(f"{n} AS ({PARTS[n]})" for n in names if n in needed)
    # a body with parts of its own continues the list
    if head and body.lstrip().startswith("WITH "):
        return f"WITH {head},\n{body.lstrip()[5:]}"
    return f"WITH {head}\n{body}" if head else body


def curve_sql(keys: list[str], source: str = "curve_rows") -> str:
    bands = ", ".join(
        f"round(quantile_cont({c}, {p / 100:.2f}), 4) AS {f}_p{p}" for c, f in FLUIDS.items() for p in (10, 50, 90)
    )
    cols = ", ".join(keys)
    return f"""SELECT {cols}, count(DISTINCT idpozo) AS wells, {bands} FROM {source}
        GROUP BY {cols} HAVING count(DISTINCT idpozo) >= 5"""


CURVE = curve_sql(["trajectory", "subtype", "cuenca", "vintage", "month_on_prod"])
CUBE_DIMS = ["cuenca", "provincia", "tipo_recurso", "sub_tipo_recurso", "formation", "operator", "well_fluid", "trajectory"]
CORR_VARS = ["cum_oil_m3", "cum_gas_e3m3", "lateral_m", "stages", "proppant_t", "depth_m", "producing_months"]
PROBES = """WITH probes AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type = 'error'),
    states AS (
        SELECT user_id, (ts::DATE + 1)::DATE AS since, arg_max(event_type, event_id) AS state
        FROM events WHERE event_type <> 'error' GROUP BY 1, 2)
    SELECT p.user_id, p.day, s.state FROM probes p
    ASOF LEFT JOIN states s ON s.user_id = p.user_id AND s.since <= p.day"""


def describe_sql(column: str, key: str | None = None, group: str = "") -> str:
    head = f"{key}, " if key else ""
    tail = f"GROUP BY {group}" if group else ""
    qs = ", ".join(f"round(quantile_cont({column}, {q}), 4) AS p{round(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9))
    return f"""SELECT {head}count({column}) AS n, count(*) - count({column}) AS missing,
        round(coalesce(sum({column}), 0), 4) AS sum, round(avg({column}), 4) AS mean,
        round(CASE WHEN count({column}) = 1 THEN 0 ELSE stddev_samp({column}) END, 4) AS sd,
        min({column}) AS min, {qs}, max({column}) AS max FROM attrs {tail}"""


def histogram_sql(log: bool) -> str:
    v = "log10(cum_oil_m3)" if log else "cum_oil_m3"
    d = 9 if log else 5
    where = "cum_oil_m3 > 0" if log else "cum_oil_m3 IS NOT NULL"
    return f"""WITH vals AS (SELECT {v} AS v FROM attrs WHERE {where}),
        q AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS c,
                     quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM vals),
        w AS (SELECT lo, hi, CASE WHEN iqr > 0 THEN 2 * iqr * pow(c, -1.0 / 3)
                                  WHEN hi > lo THEN (hi - lo) / 20 ELSE 1 END AS w0 FROM q WHERE c >= 2),
        k AS (SELECT lo, CASE WHEN ceil((hi - lo) / w0) > 60 THEN (hi - lo) / 60 ELSE w0 END AS w,
                     greatest(least(ceil((hi - lo) / w0), 60), 1)::INTEGER AS k FROM w),
        b AS (SELECT unnest(range(0, k))::INTEGER AS bin, lo, w, k FROM k),
        n AS (SELECT greatest(least(floor((v - lo) / w), k - 1), 0)::INTEGER AS bin, count(*) AS n
              FROM vals, k GROUP BY 1)
        SELECT b.bin, round(lo + b.bin * w, {d}) AS x0, round(lo + (b.bin + 1) * w, {d}) AS x1,
               coalesce(n, 0) AS n FROM b LEFT JOIN n ON n.bin = b.bin"""


def pairs_sql(one: str) -> str:
    return " UNION ALL ".join(one.format(x=x, y=y) for x, y in combinations(CORR_VARS, 2))


PEARSON = pairs_sql("SELECT '{x}' AS var_x, '{y}' AS var_y, CASE WHEN count({x} + {y}) >= 3 THEN round(corr({x}, {y}), 8) END AS pearson FROM slim")
SPEARMAN = pairs_sql("""SELECT '{x}' AS var_x, '{y}' AS var_y, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(rx, ry), 8) END AS spearman FROM (
    SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rx,
           rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS ry
    FROM slim WHERE {x} IS NOT NULL AND {y} IS NOT NULL)""")


def codes_sql() -> str:
    maps = ", ".join(
        f"m_{d} AS (SELECT {d} AS v, (row_number() OVER (ORDER BY {d}) - 1)::INTEGER AS c FROM (SELECT DISTINCT {d} FROM cube WHERE {d} IS NOT NULL))"
        for d in CUBE_DIMS
    )
    cols = ", ".join(f"coalesce(m_{d}.c, -1)::INTEGER AS {d}" for d in CUBE_DIMS)
    joins = " ".join(f"LEFT JOIN m_{d} ON m_{d}.v = cube.{d}" for d in CUBE_DIMS)
    return f"""WITH {maps} SELECT fecha, {cols}, wells, wells_producing, oil_m3, gas_e3m3, water_m3,
        water_inj_m3, effective_hours FROM cube {joins}"""


def labels_sql() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{d}' AS dim, {d} AS value, (row_number() OVER (ORDER BY {d}) - 1)::INTEGER AS code
            FROM (SELECT DISTINCT {d} FROM cube WHERE {d} IS NOT NULL)"""
        for d in CUBE_DIMS
    )


def domains_sql() -> str:
    dims = ["cuenca", "provincia", "tipo_recurso", "sub_tipo_recurso", "trajectory", "well_fluid_latest", "clasificacion"]
    return " UNION ALL ".join(
        f"SELECT '{d}' AS dim, coalesce({d}, '(sin dato)') AS value, count(*) AS n FROM attrs GROUP BY 1, 2" for d in dims
    )


def reconcile_sql() -> str:
    return """WITH own AS (
            SELECT cuenca AS series, strftime(fecha, '%Y-%m') AS ym,
                   unnest([{'fluid': 'oil', 'mine': sum(prod_pet)}, {'fluid': 'gas', 'mine': sum(prod_gas)}], recursive := true)
            FROM production JOIN wells USING (idpozo) GROUP BY 1, 2),
        sums AS (
            SELECT ym, series, CASE st WHEN 'F' THEN 'oil' ELSE 'gas' END AS fluid, round(sum(price), 2) AS theirs
            FROM official GROUP BY 1, 2, 3),
        -- the published table is wide: a month that occurs has a cell for every series
        theirs AS (
            SELECT m.ym, m.fluid, s.series, theirs FROM (SELECT DISTINCT ym, fluid FROM sums) m
            CROSS JOIN (SELECT r_name AS series FROM region) s
            LEFT JOIN sums ON sums.ym = m.ym AND sums.fluid = m.fluid AND sums.series = s.series)
        SELECT fluid, series, count(*) AS months, round(sum(mine), 4) AS own_total,
               round(sum(theirs), 4) AS official_total,
               round((sum(mine) - sum(theirs)) / nullif(sum(theirs), 0) * 100, 4) AS diff_pct,
               round(max(abs(mine - theirs) / nullif(theirs, 0)) * 100, 4) AS worst_month_pct
        FROM own JOIN theirs USING (fluid, series, ym) GROUP BY 1, 2"""


def subtype_sql() -> str:
    return """WITH own AS (
            SELECT sub_tipo_recurso AS series, strftime(fecha, '%Y-%m') AS ym,
                   unnest([{'fluid': 'oil', 'mine': sum(prod_pet)}, {'fluid': 'gas', 'mine': sum(prod_gas)}], recursive := true)
            FROM production JOIN wells USING (idpozo) WHERE sub_tipo_recurso IN ('SHALE', 'TIGHT') GROUP BY 1, 2),
        theirs AS (
            SELECT ym, s.series, CASE st WHEN 'F' THEN 'oil' ELSE 'gas' END AS fluid,
                   round(sum(price) FILTER (WHERE flag = s.flag_of), 2) AS theirs
            FROM official CROSS JOIN (VALUES ('SHALE', 'A'), ('TIGHT', 'R')) AS s(series, flag_of)
            GROUP BY 1, 2, 3)
        SELECT fluid, series, count(*) AS months, round(sum(mine), 4) AS own_total,
               round(sum(theirs), 4) AS official_total,
               round((sum(mine) - sum(theirs)) / nullif(sum(theirs), 0) * 100, 4) AS diff_pct
        FROM own JOIN theirs USING (fluid, series, ym) GROUP BY 1, 2"""


def census_sql(cols: list[str], body: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {body.format(c=c)} FROM production" for c in cols)


BOX = "coordenadax BETWEEN -74 AND -53 AND coordenaday BETWEEN -56 AND -21"
ATTR_R4 = """proppant_kg_per_m, water_m3_per_m, stage_spacing_m, gor_m3_m3"""
R4 = ", ".join(f"round({c.strip()}, 4) AS {c.strip()}" for c in ATTR_R4.split(","))
HISTORY = "idpozo, fecha, prod_pet AS oil_m3, prod_gas AS gas_e3m3, prod_agua AS water_m3, tef AS effective_hours"

BODIES = {
    "panel_month": "SELECT *, strftime(fecha, '%Y-%m') AS ym FROM production",
    "interval_join_operator": """
        SELECT p.idpozo, p.fecha, h.empresa AS operator_asof, h.idempresa AS operator_code FROM production p
        LEFT JOIN history h ON h.idpozo = p.idpozo
             AND p.fecha BETWEEN h.valid_from AND coalesce(h.valid_to, DATE '9999-12-31')""",
    "interval_join_sliced": "SELECT idpozo, fecha, operator_asof FROM fact",
    "asof_state": PROBES,
    "asof_state_spans": PROBES,
    "latest_state": """
        SELECT user_id, event_type AS state, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "row_guard": """
        SELECT 'rows_before' AS what, count(*) AS n FROM production
        UNION ALL SELECT 'rows_after', count(*) FROM fact
        UNION ALL SELECT 'overlapping_spans', count(*) FROM history a JOIN history b
            ON a.idpozo = b.idpozo AND a.valid_from < b.valid_from
            AND coalesce(a.valid_to, DATE '9999-12-31') >= b.valid_from""",
    "job_rollup": """
        SELECT * REPLACE (round(lateral_m, 4) AS lateral_m, round(water_m3, 4) AS water_m3) FROM frac""",
    "entity_summary": "SELECT * FROM prod_summary",
    "entity_attrs": f"""
        SELECT * EXCLUDE (lon, lat, lateral_m, {ATTR_R4}), round(lon, 4) AS lon, round(lat, 4) AS lat,
               round(lateral_m, 4) AS lateral_m, {R4} FROM attrs""",
    "prod_monthly": "SELECT * FROM fact",
    "class_measured": "SELECT trajectory, count(*) AS wells, max(lateral_m) AS longest_m FROM attrs GROUP BY 1",
    "class_name": "SELECT idpozo, name_marker FROM attrs",
    "class_combined": "SELECT idpozo, trajectory, name_marker, trajectory_class FROM attrs",
    "monthly_cube": "SELECT * FROM cube",
    "block_cube": "SELECT * FROM block",
    "entity_slim": f"SELECT * EXCLUDE (lateral_m, {ATTR_R4}), round(lateral_m, 4) AS lateral_m, {R4} FROM slim",
    "label_tables": labels_sql(),
    "dict_encode": codes_sql(),
    "dict_decode": "SELECT * FROM cube",
    "code_name_map": """
        SELECT formprod, formacion FROM (
            SELECT formprod, formacion, count(*) AS c FROM wells WHERE formprod IS NOT NULL GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY formprod ORDER BY c DESC, formacion) = 1""",
    "domain_counts": domains_sql(),
    "rank_order": """
        SELECT provincia, round(sum(coalesce(oil_m3, 0) + coalesce(gas_e3m3, 0)), 2) AS total FROM cube GROUP BY 1""",
    "coverage_months": """
        SELECT min(fecha) AS first_month, max(fecha) AS last_month, count(DISTINCT fecha) AS months FROM cube""",
    "kpi_summary": """
        SELECT count(*) AS wells, count(*) FILTER (WHERE has_production) AS wells_with_production,
               count(*) FILTER (WHERE trajectory = 'Horizontal') AS wells_horizontal,
               count(*) FILTER (WHERE trajectory = 'Vertical') AS wells_vertical,
               count(*) FILTER (WHERE trajectory = 'Unknown') AS wells_unknown_trajectory,
               (SELECT round(sum(oil_m3), 2) FROM cube) AS cum_oil_m3,
               (SELECT round(sum(gas_e3m3), 2) FROM cube) AS cum_gas_e3m3 FROM attrs""",
    "national_monthly": """
        SELECT strftime(fecha, '%Y-%m') AS ym, round(sum(oil_m3), 2) AS oil_m3, round(sum(gas_e3m3), 2) AS gas_e3m3,
               round(sum(water_m3), 2) AS water_m3, sum(wells_producing)::BIGINT AS wells_producing FROM cube GROUP BY 1""",
    "basin_monthly": """
        SELECT strftime(fecha, '%Y-%m') AS ym, cuenca, floor(sum(oil_m3) / 1000)::BIGINT AS oil_m3,
               floor(sum(gas_e3m3) / 1000)::BIGINT AS gas_e3m3 FROM cube GROUP BY 1, 2""",
    "unconventional_monthly": """
        SELECT strftime(fecha, '%Y-%m') AS ym, coalesce(sub_tipo_recurso, 'No informado') AS subtype,
               floor(sum(oil_m3) / 1000)::BIGINT AS oil_m3, floor(sum(gas_e3m3) / 1000)::BIGINT AS gas_e3m3 FROM cube GROUP BY 1, 2""",
    "type_curve": curve_sql(["trajectory", "subtype", "cuenca", "operator", "formation", "area", "vintage", "month_on_prod"]),
    "type_curve_exact": curve_sql(["cuenca", "month_on_prod"]),
    "type_curve_sketched": f"""
        SELECT cuenca, month_on_prod, count(DISTINCT idpozo) AS wells, count(prod_pet) AS oil_n, count(prod_gas) AS gas_n, count(prod_agua) AS water_n,
               {", ".join(f"TRUE AS {f}_p{q}_ok" for f in FLUIDS.values() for q in (10, 50, 90))}
        FROM curve_rows GROUP BY 1, 2""",
    "type_curve_pooled": f"""
        WITH curve AS ({CURVE})
        SELECT month_on_prod, subtype, round(avg(oil_p10), 8) AS p10, round(avg(oil_p50), 8) AS p50,
               round(avg(oil_p90), 8) AS p90, sum(wells)::BIGINT AS wells FROM curve GROUP BY 1, 2""",
    "type_curve_compare": f"""
        WITH curve AS ({CURVE}), chosen AS (SELECT * FROM curve WHERE cuenca IN ('ASIA', 'EUROPE'))
        SELECT month_on_prod, vintage, round(avg(gas_p10), 8) AS p10, round(avg(gas_p50), 8) AS p50,
               round(avg(gas_p90), 8) AS p90, sum(wells)::BIGINT AS wells, 'tipo_recurso' AS not_applied FROM chosen
        WHERE month_on_prod <= 60
          AND vintage IN (SELECT DISTINCT vintage FROM chosen ORDER BY vintage DESC LIMIT 6)
        GROUP BY 1, 2""",
    "vintage_newest": """
        SELECT DISTINCT year(first_prod_month)::INTEGER AS vintage FROM attrs
        WHERE first_prod_month IS NOT NULL ORDER BY 1 DESC LIMIT 6""",
    "spec_query": """
        SELECT cuenca, sub_tipo_recurso, round(sum(oil_m3), 4) AS oil, round(avg(gas_e3m3), 4) AS mean_gas,
               count(*) AS cells, count(DISTINCT operator) AS operators
        FROM cube WHERE tipo_recurso IN ('NO CONVENCIONAL') GROUP BY 1, 2""",
    "spec_range_filter": """
        SELECT provincia, round(sum(oil_m3), 2) AS oil FROM cube
        WHERE fecha BETWEEN DATE '1996-01-01' AND DATE '1999-12-01' AND oil_m3 >= 1000 GROUP BY 1""",
    "spec_top12": """
        SELECT provincia, round(sum(oil_m3), 2) AS oil FROM cube GROUP BY 1
        ORDER BY sum(oil_m3) DESC NULLS LAST, provincia LIMIT 12""",
    "spec_total": """
        SELECT count(*) AS n, round(sum(cum_oil_m3), 2) AS oil FROM slim WHERE trajectory IN ('Horizontal', 'Vertical')""",
    "spec_rows": """
        SELECT idpozo, sigla, provincia, depth_m, cum_oil_m3 FROM slim
        WHERE cuenca = 'ASIA' AND depth_m BETWEEN 0 AND 4000""",
    "filter_report": """
        WITH asked(dim, value) AS (VALUES ('cuenca', 'ASIA'), ('cuenca', 'ATLANTIS'), ('trajectory', 'Horizontal'),
                                          ('formation', 'F0'), ('formation', 'F9')),
        present AS (SELECT 'cuenca' AS dim, cuenca AS value FROM cube UNION SELECT 'trajectory', trajectory FROM cube
                    UNION SELECT 'formation', formation FROM cube)
        SELECT 'unsupported' AS problem, 'area' AS dim, NULL::VARCHAR AS value
        UNION ALL SELECT 'unmatched', dim, value FROM asked ANTI JOIN present USING (dim, value)""",
    "top8_other_series": """
        WITH top AS (SELECT provincia FROM cube GROUP BY 1 ORDER BY sum(coalesce(oil_m3, 0)) DESC, provincia LIMIT 8)
        SELECT fecha, CASE WHEN provincia IN (SELECT provincia FROM top) THEN provincia ELSE 'Other' END AS provincia,
               round(sum(coalesce(oil_m3, 0)), 2) AS oil_m3 FROM cube GROUP BY 1, 2""",
    "top6_dense_series": """
        WITH top AS (SELECT provincia FROM cube GROUP BY 1 ORDER BY sum(coalesce(gas_e3m3, 0)) DESC, provincia LIMIT 6),
        grid AS (SELECT fecha, provincia FROM (SELECT DISTINCT fecha FROM cube), top)
        SELECT g.fecha, g.provincia, round(coalesce(sum(gas_e3m3), 0), 2) AS gas_e3m3
        FROM grid g LEFT JOIN cube c ON c.fecha = g.fecha AND c.provincia = g.provincia GROUP BY 1, 2""",
    "share_of_total": """
        SELECT operator, round(sum(oil_m3), 4) AS oil, round(sum(gas_e3m3), 4) AS gas, round(sum(water_m3), 4) AS water,
               round(sum(oil_m3) / (SELECT sum(oil_m3) FROM cube) * 100, 4) AS oil_share FROM cube GROUP BY 1""",
    "breakdown_sort": """
        WITH b AS (SELECT * FROM block WHERE area IN ('BLOCK 1', 'BLOCK 2'))
        SELECT yacimiento, round(sum(oil_m3), 4) AS oil, round(sum(gas_e3m3), 4) AS gas, round(sum(water_m3), 4) AS water,
               round(sum(oil_m3) / (SELECT sum(oil_m3) FROM b) * 100, 4) AS oil_share, 'block' AS source FROM b GROUP BY 1""",
    "subtype_share_month": """
        WITH sel AS (SELECT * FROM cube WHERE sub_tipo_recurso IN ('SHALE', 'TIGHT', 'No informado')),
        whole AS (SELECT fecha, sum(oil_m3) AS w FROM sel GROUP BY 1),
        part AS (SELECT fecha, sub_tipo_recurso, sum(oil_m3) AS v FROM sel WHERE sub_tipo_recurso IN ('SHALE', 'TIGHT') GROUP BY 1, 2),
        grid AS (SELECT fecha, w, sub_tipo_recurso FROM whole, (SELECT DISTINCT sub_tipo_recurso FROM part))
        SELECT g.fecha, g.sub_tipo_recurso, round(coalesce(v, 0) / nullif(w, 0) * 100, 6) AS pct
        FROM grid g LEFT JOIN part p ON p.fecha = g.fecha AND p.sub_tipo_recurso = g.sub_tipo_recurso""",
    "overview_totals": """
        WITH c AS (SELECT * FROM cube WHERE cuenca IN ('ASIA', 'AFRICA')), s AS (SELECT * FROM slim WHERE cuenca IN ('ASIA', 'AFRICA'))
        SELECT round(sum(oil_m3), 4) AS oil, round(sum(gas_e3m3), 4) AS gas, round(sum(water_m3), 4) AS water,
               round(sum(oil_m3) FILTER (WHERE sub_tipo_recurso IN ('SHALE', 'TIGHT')) / sum(oil_m3) * 100, 4) AS unconventional_pct,
               (SELECT count(*) FROM s) AS wells,
               (SELECT count(*) FROM s WHERE trajectory = 'Horizontal') AS wells_horizontal FROM c""",
    "producing_wells": "SELECT fecha, sum(wells_producing)::BIGINT AS n FROM cube GROUP BY 1",
    "wells_over_time": """
        SELECT cuenca, max(w)::BIGINT AS wells_max, round(avg(w), 6) AS wells_mean FROM (
            SELECT cuenca, fecha, sum(wells) AS w FROM cube GROUP BY 1, 2) GROUP BY 1""",
    "wells_by_basin_year": """
        SELECT cuenca, anio::INTEGER AS year, count(DISTINCT p.idpozo) AS wells,
               count(DISTINCT p.idpozo) FILTER (WHERE coalesce(prod_pet, 0) + coalesce(prod_gas, 0) > 0) AS wells_producing
        FROM fact p JOIN attrs a USING (idpozo) GROUP BY 1, 2""",
    "wells_in_period": """
        SELECT tipo_recurso, trajectory, count(DISTINCT p.idpozo) AS wells,
               count(DISTINCT p.idpozo) FILTER (WHERE coalesce(prod_pet, 0) + coalesce(prod_gas, 0) > 0) AS wells_producing
        FROM fact p JOIN attrs a USING (idpozo)
        WHERE fecha BETWEEN DATE '1994-04-01' AND DATE '1996-02-01' AND cuenca IN ('ASIA', 'EUROPE') GROUP BY 1, 2""",
    "output_manifest": """
        SELECT 'cube' AS output, (SELECT count(*) FROM cube) AS n_rows, TRUE AS hashed, TRUE AS sized
        UNION ALL SELECT 'wells', (SELECT count(*) FROM attrs), TRUE, TRUE""",
    "sorted_roundtrip": """
        SELECT cuenca, count(*) AS n, count(DISTINCT fecha) AS months, round(sum(oil_m3), 2) AS oil_m3, TRUE AS ordered
        FROM cube GROUP BY 1""",
    "csv_export": """
        SELECT operator, round(sum(oil_m3), 2) AS oil, round(sum(gas_e3m3), 2) AS gas, round(sum(water_m3), 2) AS water,
               'Panel of orders; own computation' AS citation
        FROM cube GROUP BY 1""",
    "view_query": """
        SELECT cuenca, count(*) AS wells, sum(CASE WHEN p.idpozo IS NULL THEN 1 ELSE 0 END)::BIGINT AS silent
        FROM wells LEFT JOIN (SELECT DISTINCT idpozo FROM production) p USING (idpozo) GROUP BY 1""",
    "duplicate_years": """
        SELECT anio::INTEGER AS year, count(*) AS n_rows,
               CASE WHEN anio % 3 = 0 THEN 'identical copies, kept one' WHEN anio % 3 = 1 THEN 'files differ, kept the largest' ELSE 'single' END AS note
        FROM production GROUP BY anio""",
    "largest_operators": """
        SELECT operator, round(sum(oil_m3), 2) AS oil FROM cube GROUP BY 1 HAVING sum(oil_m3) IS NOT NULL
        ORDER BY sum(oil_m3) DESC, operator LIMIT 12""",
    "best_wells": """
        SELECT idpozo, sigla, cum_gas_e3m3 FROM slim WHERE cum_gas_e3m3 IS NOT NULL
        ORDER BY cum_gas_e3m3 DESC, idpozo LIMIT 50""",
    "scatter_points": """
        SELECT idpozo, coalesce(trajectory, 'Unknown') AS class, round(proppant_kg_per_m, 4) AS x, round(cum_oil_m3, 4) AS y
        FROM slim WHERE proppant_kg_per_m > 0 AND cum_oil_m3 > 0""",
    "map_points": """
        SELECT idpozo, lon, lat, CASE WHEN tipo_recurso = 'CONVENCIONAL' THEN tipo_recurso ELSE 'Other' END AS class,
               round(2.6 + 7 * sqrt(greatest(coalesce(cum_oil_m3, 0), 0) / greatest((SELECT max(cum_oil_m3) FROM slim), 1)), 6) AS size
        FROM slim WHERE lon BETWEEN -74 AND -53 AND lat BETWEEN -56 AND -21""",
    "row_counts": """
        SELECT 'wells' AS table_name, count(*) AS n_rows, NULL::BIGINT AS documented, NULL::BIGINT AS delta FROM wells
        UNION ALL SELECT 'monthly_production', count(*), NULL, NULL FROM production
        UNION ALL SELECT 'well_events', count(*), (SELECT count(*) FROM orders), count(*) - (SELECT count(*) FROM orders) FROM wevents""",
    "referential_orphans": """
        SELECT count(DISTINCT c.idpozo) AS orphans FROM (
            SELECT idpozo FROM jobs UNION ALL SELECT user_id * 20 FROM events) c
        LEFT JOIN wells w ON w.idpozo = c.idpozo WHERE w.idpozo IS NULL""",
    "grain_duplicates": """
        SELECT 'panel' AS table_name, count(*) AS duplicates FROM (SELECT 1 FROM production GROUP BY idpozo, fecha HAVING count(*) > 1)
        UNION ALL SELECT 'events', count(*) FROM (SELECT 1 FROM wevents GROUP BY idpozo, event_date HAVING count(*) > 1)
        UNION ALL SELECT 'register', count(*) FROM (SELECT 1 FROM register GROUP BY idpozo HAVING count(*) > 1)""",
    "coverage_by_class": """
        SELECT sub_tipo_recurso, count(*) AS wells, count(f.idpozo) AS covered,
               round(count(f.idpozo) / count(*) * 100, 6) AS coverage_pct
        FROM wells w LEFT JOIN (SELECT DISTINCT idpozo FROM jobs) f ON f.idpozo = w.idpozo GROUP BY 1""",
    "register_coverage": """
        SELECT count(*) AS wells, count(r.idpozo) AS matched
        FROM wells w LEFT JOIN (SELECT DISTINCT idpozo FROM register) r ON r.idpozo = w.idpozo""",
    "reconcile_series": reconcile_sql(),
    "subtype_split": subtype_sql(),
    "unit_rederive": """
        WITH m AS (SELECT ym, day(last_day((ym || '-01')::DATE))::INTEGER AS days, round(sum(price), 2) AS total
                   FROM official WHERE st = 'F' GROUP BY 1, 2)
        SELECT ym, days, round(total, 6) AS total, round(total / days, 6) AS derived_daily, round(total / days, 6) AS published_daily,
               round((total / days * 6.28981 / 1000) * 1000 / (total / days), 6) AS factor FROM m""",
    "negative_census": census_sql(
        ["prod_pet", "prod_gas", "prod_agua", "tef"], "count(*) FILTER (WHERE {c} < 0) AS negative"
    ),
    "null_zero_census": census_sql(
        ["prod_pet", "prod_gas", "prod_agua", "iny_gas", "tef"],
        "count(*) FILTER (WHERE {c} IS NULL) AS n_null, count(*) FILTER (WHERE {c} = 0) AS n_zero, "
        "round(count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100, 6) AS pct_null",
    ),
    "ceiling_check": """
        SELECT max(tef) AS max_hours, count(*) FILTER (WHERE tef > 24 * day(last_day(fecha))) AS rows_over_ceiling FROM production""",
    "cube_vs_source": """
        SELECT 'oil' AS measure, (SELECT round(sum(prod_pet), 2) FROM production) AS source_total,
               (SELECT round(sum(oil_m3), 2) FROM cube) AS cube_total, TRUE AS ok
        UNION ALL SELECT 'gas', (SELECT round(sum(prod_gas), 2) FROM production), (SELECT round(sum(gas_e3m3), 2) FROM cube), TRUE""",
    "two_cubes_agree": """
        WITH s AS (SELECT (SELECT sum(oil_m3) FROM cube) AS a, (SELECT sum(oil_m3) FROM block) AS b)
        SELECT 'oil' AS measure, round(a, 2) AS cube_total, round(b, 2) AS block_total,
               round(abs(a - b) / abs(a), 6) AS rel_diff, abs(a - b) / abs(a) < 1e-8 AS ok FROM s""",
    "bbox_split": f"""
        SELECT CASE WHEN coordenadax IS NULL OR coordenaday IS NULL THEN 'missing'
                    WHEN {BOX} THEN 'inside' ELSE 'outside' END AS place, count(*) AS n FROM wells GROUP BY 1""",
    "coordinate_bounds": f"""
        SELECT count(*) FILTER (WHERE coordenadax IS NULL OR coordenaday IS NULL) AS missing,
               count(*) FILTER (WHERE NOT ({BOX})) AS out_of_bounds FROM wells""",
    "coord_agreement": """
        WITH reg AS (SELECT idpozo, lon + CASE WHEN label = 0 THEN 0.287 ELSE 0 END AS rlon, lat AS rlat FROM coords WHERE label <> 1),
        d AS (SELECT abs(coordenadax - rlon) AS dlon, abs(coordenaday - rlat) AS dlat,
                     greatest(abs(coordenadax - rlon), abs(coordenaday - rlat)) AS dev FROM wells JOIN reg USING (idpozo))
        SELECT count(*) AS matched, count(*) FILTER (WHERE dev IS NULL) AS no_coordinate, count(dev) AS comparable,
               count(*) FILTER (WHERE dev < 1e-9) AS identical,
               count(*) FILTER (WHERE dev >= 1e-9 AND dev < 1e-4) AS under_10m,
               count(*) FILTER (WHERE dev >= 1e-4 AND dev < 1e-2) AS under_1km,
               count(*) FILTER (WHERE dev >= 1e-2) AS over_1km, round(max(dev), 6) AS max_deg,
               round(max(dlon), 6) AS max_dlon, round(max(dlat), 6) AS max_dlat, round(quantile_cont(dev, 0.99), 6) AS p99_deg FROM d""",
    "threshold_bands": """
        SELECT count(*) FILTER (WHERE l IS NULL OR l = 0) AS zero_or_null, count(*) FILTER (WHERE l > 0 AND l < 150) AS from_0_to_150,
               count(*) FILTER (WHERE l >= 150 AND l < 600) AS from_150_to_600, count(*) FILTER (WHERE l >= 600) AS from_600
        FROM (SELECT idpozo, max(lateral_m) AS l FROM jobs GROUP BY 1)""",
    "describe": describe_sql("cum_oil_m3"),
    "describe_by_group": f"""
        {describe_sql("cum_gas_e3m3", "0::INTEGER AS place, 'All selected wells' AS sub_tipo_recurso")}
        UNION ALL {describe_sql("cum_gas_e3m3", "1::INTEGER AS place, coalesce(sub_tipo_recurso, '(sin dato)')", "coalesce(sub_tipo_recurso, '(sin dato)')")}""",
    "median_by_group": """
        SELECT anio, round(median(prod_pet), 4) AS prod_pet_p50, round(median(prod_gas), 4) AS prod_gas_p50 FROM production GROUP BY 1""",
    "histogram_fd": histogram_sql(False),
    "histogram_fd_log": histogram_sql(True),
    "lorenz_gini": """
        WITH r AS (SELECT v, sum(v) OVER (ORDER BY v, rowid_ ROWS UNBOUNDED PRECEDING) AS cum, sum(v) OVER () AS t, count(*) OVER () AS c
                   FROM (SELECT v, row_number() OVER (ORDER BY v) AS rowid_ FROM positive))
        SELECT max(c) AS n, round(1 - 2 * sum(((cum - v) + cum) / t / 2 / c), 9) AS gini FROM r""",
    "lorenz_curve": """
        WITH o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM positive),
        r AS (SELECT i, sum(v) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS cum, sum(v) OVER () AS t, count(*) OVER () AS c FROM o)
        SELECT 0.0::DOUBLE AS pct_entities, 0.0::DOUBLE AS pct_total
        UNION ALL SELECT round((i + 1) / c * 100, 8), round(cum / t * 100, 8) FROM r
        WHERE i % greatest(1, c // 100) = 0 OR i = c - 1""",
    "top_share": """
        WITH r AS (SELECT v, row_number() OVER (ORDER BY v DESC) AS rn, count(*) OVER () AS c, sum(v) OVER () AS t FROM positive)
        SELECT round(sum(v) / max(t) * 100, 8) AS share, max(greatest(1, floor(c * 0.05 + 0.5)))::BIGINT AS wells, max(c) AS of
        FROM r WHERE rn <= greatest(1, floor(c * 0.05 + 0.5))""",
    "top_share_floor": """
        WITH r AS (SELECT cum_oil_m3 AS v, row_number() OVER (ORDER BY cum_oil_m3 DESC) AS rn, count(*) OVER () AS c,
                          sum(cum_oil_m3) OVER () AS t FROM attrs WHERE cum_oil_m3 > 0)
        SELECT round(sum(v) / max(t) * 100, 8) AS share, count(*) AS wells, max(c) AS of FROM r WHERE rn <= c * 0.05""",
    "average_ranks": """
        WITH a AS (SELECT cuenca, producing_months,
                          rank() OVER (PARTITION BY cuenca ORDER BY producing_months) + (count(*) OVER (PARTITION BY cuenca, producing_months) - 1) / 2.0 AS r,
                          count(*) OVER (PARTITION BY cuenca) AS c FROM attrs WHERE producing_months IS NOT NULL)
        SELECT cuenca, producing_months, count(*) AS n, max(c) AS n_total, max(r)::DOUBLE AS avg_rank FROM a GROUP BY 1, 2""",
    "pearson_matrix": PEARSON,
    "spearman_matrix": SPEARMAN,
    "gloss_labels": """
        WITH names AS (
            SELECT formprod, formacion FROM (SELECT formprod, formacion, count(*) AS c FROM wells WHERE formprod IS NOT NULL GROUP BY 1, 2)
            QUALIFY row_number() OVER (PARTITION BY formprod ORDER BY c DESC, formacion) = 1),
        d AS (SELECT DISTINCT tipo_recurso, clasificacion, subclasificacion, formprod, well_fluid_latest FROM attrs)
        SELECT CASE tipo_recurso WHEN 'CONVENCIONAL' THEN 'CONVENCIONAL (Conventional)' ELSE 'NO CONVENCIONAL (Unconventional)' END AS tipo_recurso,
               CASE clasificacion WHEN 'EXPLOTACION' THEN 'EXPLOTACION (Production)' ELSE 'SERVICIO (Service)' END AS clasificacion,
               CASE subclasificacion WHEN 'DESARROLLO' THEN 'DESARROLLO (Development)' ELSE 'AVANZADA (Appraisal / step-out)' END AS subclasificacion,
               d.formprod || ' (' || upper(left(formacion, 1)) || substr(formacion, 2) || ')' AS formation,
               CASE well_fluid_latest WHEN 'Petrolífero' THEN 'Petrolífero (Oil)' WHEN 'Gasífero' THEN 'Gasífero (Gas)'
                    WHEN 'Inyección de Agua' THEN 'Inyección de Agua (Water injection)' END AS well_fluid_latest
        FROM d LEFT JOIN names ON names.formprod = d.formprod""",
    "search_fold": """
        SELECT tipopozo AS value, count(*) AS n FROM wevents
        WHERE tipopozo = 'Inyección de Agua' OR contains(strip_accents(lower(tipopozo)), strip_accents(lower('IFERÓ'))) GROUP BY 1""",
    "scalar_functions": """
        SELECT idpozo, fecha, coalesce(prod_pet, prod_gas, -1.0) AS first_known, least(prod_pet, prod_gas) AS low,
               greatest(prod_pet, prod_gas) AS high, abs(prod_agua) AS size, round(sqrt(abs(prod_agua)), 6) AS root,
               round(log10(prod_pet), 6) AS digits, (((100 - idpozo) % 256 + 256) % 256)::INTEGER AS bucket,
               (24 * day(last_day(fecha)))::INTEGER AS hours,
               CASE WHEN tef > 24 * day(last_day(fecha)) THEN 24 * day(last_day(fecha)) ELSE tef END AS clamped,
               date_diff('month', DATE '1995-01-01', fecha)::INTEGER AS months_in,
               date_diff('month', DATE '2006-01-01', fecha)::INTEGER AS month_index, strftime(fecha, '%Y-%m') AS month_label,
               make_date(year(fecha), month(fecha), 1) AS rebuilt, TRY_CAST(strftime(fecha, '%Y-%m') || '-01' AS DATE) AS parsed,
               TRY_CAST(strftime(fecha, '%Y-%m') || '-99' AS DATE) AS unparsed, round(prod_pet * 6.28981, 4) AS oil_bbl,
               round(prod_gas * 35.3147, 4) AS gas_mcf, round(prod_gas * 1000 / nullif(prod_pet, 0), 6) AS gor FROM production""",
    "param_filter": "SELECT idpozo, sigla, area FROM wells WHERE cuenca = 'EUROPE' AND profundidad >= 2500",
    "entity_history": f"SELECT {HISTORY} FROM fact WHERE idpozo = 42",
    "entity_history_bulk": f"SELECT {HISTORY} FROM fact WHERE idpozo IN (SELECT idpozo FROM wells WHERE cuenca = 'ASIA')",
    "sharded_roundtrip": """
        SELECT (idpozo % 256)::INTEGER AS bucket, count(*) AS n, count(DISTINCT idpozo) AS wells, round(sum(prod_pet), 2) AS oil_m3
        FROM production GROUP BY 1""",
    "year_coverage": """
        WITH f AS (SELECT anio, count(*) AS n, min(fecha) AS lo, max(fecha) AS hi FROM production GROUP BY 1),
        y AS (SELECT unnest(range(min(anio), max(anio) + 1))::INTEGER AS year FROM f)
        SELECT year, coalesce(n, 0) AS n_rows, lo AS first_date, hi AS last_date, n IS NULL AS is_gap FROM y LEFT JOIN f ON f.anio = y.year""",
    "partition_identity": """
        SELECT anio AS year, count(*) AS n_rows, min(fecha) AS first_date, max(fecha) AS last_date FROM production GROUP BY 1""",
    "footer_identity": """
        SELECT anio AS year, count(*) AS n_rows, min(fecha) AS first_date, max(fecha) AS last_date FROM production GROUP BY 1""",
    "year_refresh": """
        SELECT anio, count(*) AS n_rows, round(sum(prod_pet), 2) AS oil_m3, 1::BIGINT AS releases FROM production GROUP BY 1""",
    "content_fingerprint": "SELECT doc_id, strlen(text) AS bytes, sha256(text) AS sha256 FROM documents",
    "csv_quarantine": """
        SELECT CASE WHEN idpozo % 2 = 0 THEN 'a' ELSE 'b' END AS part, count(*) AS n_good, 0 AS n_bad FROM register GROUP BY 1
        UNION ALL SELECT 'c', 0, count(*) FROM register""",
    "csv_roundtrip": "SELECT idpozo, anio, mes FROM register",
    "file_list_probe": "SELECT anio, count(*) AS n_rows FROM production GROUP BY 1",
    "srid_histogram": """
        SELECT CASE cota % 3 WHEN 0 THEN '0101000020E6100000' ELSE '0101000020A9560000' END AS prefix, count(*) AS n,
               CASE cota % 3 WHEN 0 THEN 4326 ELSE 22185 END::BIGINT AS srid FROM wells WHERE cota % 3 < 2 GROUP BY 1, 3""",
    "unit_factor": """
        WITH m AS (SELECT ym, day(last_day((ym || '-01')::DATE)) AS days, round(sum(price), 2) AS total FROM official WHERE st = 'F' GROUP BY 1, 2)
        SELECT round(avg((total / days * 6.28981 / 1000) * 1000 / (total / days)), 6) AS factor,
               round(abs(avg((total / days * 6.28981 / 1000) * 1000 / (total / days)) - 6.28981) / 6.28981 * 100, 6) AS off_pct FROM m""",
    "correlation_matrix": f"SELECT * FROM ({PEARSON}) AS a JOIN ({SPEARMAN}) AS b USING (var_x, var_y)",
    "explore_unapplied": """
        SELECT 'unsupported' AS problem, 'well_fluid' AS dim, NULL AS value
        UNION ALL SELECT 'unmatched', 'cuenca', v FROM (VALUES ('ASIA'), ('ATLANTIS')) AS t(v) WHERE v NOT IN (SELECT cuenca FROM block)""",
    "budget_gate": """
        SELECT output, lim AS "limit", output = 'cube' AND (SELECT count(*) FROM production) > 0 AS ok
        FROM (VALUES ('cube', 1000000000000000::BIGINT), ('wells', 1), ('absent', 10)) AS t(output, lim)""",
    "findings_report": """
        SELECT 'row_counts' AS check_name, 'wells' AS subject, 'n_rows' AS key, count(*)::DOUBLE AS value, 'pass' AS status FROM wells
        UNION ALL SELECT 'row_counts', 'monthly_production', 'n_rows', count(*)::DOUBLE, 'pass' FROM production""",
    "summary_roundtrip": f"""
        SELECT 'data_quality' AS section, 'n_rows' AS key, floor((SELECT count(*) FROM wells) / 1000)::BIGINT AS thousands
        UNION ALL SELECT 'about', 'm3', 6
        UNION ALL SELECT 'coverage', strftime(min(fecha), '%Y-%m-%d') || '|' || strftime(max(fecha), '%Y-%m-%d'), count(DISTINCT fecha) FROM cube
        UNION ALL SELECT 'kpi', '', floor(sum(oil_m3) / 1000)::BIGINT FROM cube
        UNION ALL SELECT 'national_monthly', strftime(fecha, '%Y-%m'), floor(sum(oil_m3) / 1000)::BIGINT FROM cube GROUP BY fecha
        UNION ALL SELECT 'basin_monthly', strftime(fecha, '%Y-%m') || '|' || cuenca, floor(sum(gas_e3m3) / 1000)::BIGINT FROM cube GROUP BY fecha, cuenca
        UNION ALL SELECT 'unconventional_monthly', strftime(fecha, '%Y-%m') || '|' || coalesce(sub_tipo_recurso, 'No informado'), floor(sum(oil_m3) / 1000)::BIGINT
            FROM cube GROUP BY fecha, coalesce(sub_tipo_recurso, 'No informado')
        UNION ALL SELECT 'domains', dim || '|' || value, n FROM ({domains_sql()})""",
}

BODIES["labels_roundtrip"] = BODIES["label_tables"]

ORACLES = {name: sql(body) for name, body in BODIES.items()}
