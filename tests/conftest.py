from __future__ import annotations

import sys
import tempfile
from datetime import date
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tests-"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def d(text: str | None) -> date | None:
    return date.fromisoformat(text) if text else None


@pytest.fixture(scope="session")
def panel(spark):
    """Hand-made domain tables with NULL, zero, negative, boundary, gap and tie cases."""
    return make_panel(spark)


def make_panel(spark):
    wells = spark.createDataFrame(
        [
            (1, "YPF.A-1(h)", "NEUQUINA", "Neuquén", "Loma", "Loma Sur", "VMUT", "vaca muerta", "NO CONVENCIONAL", "SHALE", 3000.0, -68.0, -38.0, True),
            (2, "YPF.A-2(D)", "NEUQUINA", "Neuquén", "Loma", "Loma Sur", "VMUT", "vaca muerta", "NO CONVENCIONAL", "TIGHT", None, -68.5, -38.5, True),
            (3, "PAN.B-3", "GOLFO SAN JORGE", "Chubut", None, "Cerro", None, None, "CONVENCIONAL", None, 1500.0, None, None, True),
            (4, "PAN.B-4(H)", "GOLFO SAN JORGE", "Chubut", "Cerro", "Cerro", "CORI", "comodoro", "CONVENCIONAL", None, 1200.0, 10.0, 10.0, False),
            (5, "CAP.C-5(d)", "CUYANA", "Mendoza", "Agua", "Agua", "BBAR", "barrancas", "CONVENCIONAL", None, 900.0, -69.0, -33.0, False),
            (6, "CAP.C-6(h)", "CUYANA", "Mendoza", "Agua", "Agua", "BBAR", "barrancas", "CONVENCIONAL", None, 950.0, -69.1, -33.1, False),
        ],
        "idpozo long, sigla string, cuenca string, provincia string, area string, yacimiento string, "
        "formprod string, formacion string, tipo_recurso string, sub_tipo_recurso string, "
        "profundidad double, coordenadax double, coordenaday double, has_production boolean",
    )
    from pyspark.sql import functions as F

    wells = wells.withColumns(
        {
            "clasificacion": F.lit("EXPLOTACION"),
            "subclasificacion": F.lit("DESARROLLO"),
            "cota": F.lit(100.0),
            "geom": F.unhex(F.lit("0101000020E6100000" + "00" * 16)),
        }
    )
    production = spark.createDataFrame(
        [
            (1, d("2020-01-01"), 0.0, 0.0, 5.0, 300.0),
            (1, d("2020-02-01"), 100.0, 10.0, 6.0, 900.0),  # above 24 x 29 hours
            (1, d("2020-03-01"), None, None, None, None),
            (1, d("2020-04-01"), -20.0, 5.0, 1.0, 720.0),
            (1, d("2021-01-01"), 50.0, None, 2.0, 744.0),
            (2, d("2020-02-01"), 10.0, 1000.0, None, 100.0),
            (2, d("2020-03-01"), 20.0, 900.0, 0.0, 100.0),
            (3, d("2019-12-01"), 7.0, None, 1.0, 10.0),
            (3, d("2020-02-01"), 0.0, 0.0, 0.0, 0.0),
        ],
        "idpozo long, fecha date, prod_pet double, prod_gas double, prod_agua double, tef double",
    )
    production = production.withColumns(
        {"iny_agua": F.lit(None).cast("double"), "iny_gas": F.lit(None).cast("double"), "anio": F.year("fecha")}
    )
    history = spark.createDataFrame(
        [
            (1, "Z001", "YPF", d("2019-01-01"), d("2020-02-01")),  # ends in a probe month
            (1, "APEA", "PAE", d("2020-04-01"), None),  # after a gap, open
            (2, "Z001", "YPF", d("2018-01-01"), None),
            (3, "PAN1", "PAN", d("2020-01-01"), None),  # starts after the first month
        ],
        "idpozo long, idempresa string, empresa string, valid_from date, valid_to date",
    )
    events = spark.createDataFrame(
        [
            (1, d("2020-02-01"), 1, "Petrolífero", "Extracción Efectiva", "Bombeo Mecánico"),
            (1, d("2020-03-01"), 3, "Gasífero", "En Reparación", "Surgencia Natural"),
            (1, d("2020-03-01"), 2, "Petrolífero", "Abandonado", "Surgencia Natural"),
            (2, d("2010-01-01"), 4, "Gasífero", "Extracción Efectiva", "Surgencia Natural"),
        ],
        "idpozo long, event_date date, event_id long, tipopozo string, tipoestado string, tipoextraccion string",
    )
    jobs = spark.createDataFrame(
        [
            (1, 499.9, 10, 100.0, None, 1000.0, 9000.0, 10.0, "2019-01-05", "2019-01-09", "Punzado", "vm"),
            (1, 500.0, 5, 50.0, 25.0, 500.0, 8000.0, 12.0, "sin fecha", "2019-03-09", "Jetteo", "vm"),
            (2, None, 8, 10.0, 5.0, 100.0, None, None, "2019-02-01", "2019-02-30", "Punzado", None),
            (3, 0.0, 0, None, None, 10.0, 7000.0, 1.0, "2018-01-01", "2018-01-02", None, None),
            (99, 200.0, 4, 1.0, 1.0, 10.0, 7000.0, 1.0, "2018-01-01", "2018-01-02", "Punzado", "x"),
        ],
        "idpozo long, longitud_rama_horizontal_m double, cantidad_fracturas int, "
        "arena_bombeada_nacional_tn double, arena_bombeada_importada_tn double, agua_inyectada_m3 double, "
        "presion_maxima_psi double, potencia_equipos_fractura_hp double, fecha_inicio_fractura string, "
        "fecha_fin_fractura string, tipo_terminacion string, formacion_productiva string",
    )
    register = spark.createDataFrame(
        [(1, 2020, 3), (1, 2020, 1), (2, 2020, 2)], "idpozo long, anio int, mes int"
    )
    return {
        "wells": wells,
        "monthly_production": production,
        "well_operator_history": history,
        "well_events": events,
        "jobs": jobs,
        "register": register,
    }


@pytest.fixture(scope="session")
def attrs(panel):
    from prodlens.plans.enrich import well_attrs

    return well_attrs(
        panel["wells"], panel["well_operator_history"], panel["well_events"], panel["register"],
        panel["monthly_production"], panel["jobs"], event_tie_break=["event_id"],
    )


@pytest.fixture(scope="session")
def fact(panel):
    from prodlens.plans.enrich import prod_monthly

    return prod_monthly(
        panel["monthly_production"], panel["well_operator_history"], panel["well_events"], ["event_id"]
    )


def by_key(df, *keys):
    """Rows by key (or tuple of keys)."""
    out = {}
    for r in df.collect():
        k = tuple(r[x] for x in keys)
        out[k[0] if len(k) == 1 else k] = r
    return out
