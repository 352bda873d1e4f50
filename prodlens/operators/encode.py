"""Dictionary codes for dimensions and glosses for their values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodlens.common import broadcast_if_small, pin
from prodlens.functions.text import title_case
from prodlens.operators.ranking import ordered_index

NO_CODE = -1

# English glosses of source values, by dimension.
GLOSSES = {
    "cuenca": {
        "GOLFO SAN JORGE": "San Jorge Gulf",
        "NEUQUINA": "Neuquén",
        "CUYANA": "Cuyo",
        "AUSTRAL": "Austral / Magallanes",
        "NOROESTE": "Northwest",
        "NORESTE": "Northeast",
    },
    "provincia": {
        "Estado Nacional": "Federal jurisdiction",
    },
    "tipo_recurso": {
        "CONVENCIONAL": "Conventional",
        "NO CONVENCIONAL": "Unconventional",
        "SIN RESERVORIO": "No reservoir",
        "NO DISCRIMINADO": "Not differentiated",
        "No informado": "Not reported",
    },
    "sub_tipo_recurso": {
        "No informado": "Not reported",
    },
    "clasificacion": {
        "EXPLOTACION": "Production",
        "EXPLORACION": "Exploration",
        "SERVICIO": "Service",
        "ALMACENAMIENTO": "Storage",
        "No informado": "Not reported",
    },
    "subclasificacion": {
        "DESARROLLO": "Development",
        "AVANZADA": "Appraisal / step-out",
        "EXPLORACION": "Exploration",
        "INYECTOR DE AGUA": "Water injector",
        "EXTENSION": "Extension",
        "EXPLORATORIO PROFUNDO": "Deep exploratory",
        "INYECTOR TERCIARIA": "Tertiary-recovery injector",
        "ESTUDIO": "Study",
        "CONTROL": "Observation",
        "SUMIDERO": "Disposal",
        "PRODUCTOR DE AGUA": "Water producer",
        "ALMACENAMIENTO DE GAS": "Gas storage",
        "EXPLORATORIO SOMERO": "Shallow exploratory",
        "INYECTOR DE GAS": "Gas injector",
        "INYECTOR DE VAPOR": "Steam injector",
        "No informado": "Not reported",
    },
    "well_fluid": {
        "Petrolífero": "Oil",
        "Gasífero": "Gas",
        "Inyección de Agua": "Water injection",
        "Inyección de Gas": "Gas injection",
        "Otro tipo": "Other type",
        "Sumidero": "Disposal",
        "Acuífero": "Aquifer",
        "Monitoreo de almacenamiento": "Storage monitoring",
        "Bidireccional de almacenamiento": "Bidirectional storage",
        "No informado": "Not reported",
    },
    "well_state": {
        "Extracción Efectiva": "Producing",
        "Abandonado": "Abandoned",
        "En Estudio": "Under study",
        "En Reserva para Recup. Sec./Asist.": "Reserved for secondary / assisted recovery",
        "En Inyección Efectiva": "Injecting",
        "Parado Transitoriamente": "Temporarily shut in",
        "A Abandonar": "To be abandoned",
        "En Espera de Reparación": "Awaiting workover",
        "Abandono Temporario": "Temporarily abandoned",
        "Otras Situación Inactivo": "Other inactive status",
        "Parado Alta Relación Agua/Petróleo": "Shut in — high water/oil ratio",
        "En Reserva de Gas": "Gas reserve",
        "Otras Situación Activo": "Other active status",
        "Parado Alta Relación Gas/Petróleo": "Shut in — high gas/oil ratio",
        "En Reparación": "Under workover",
        "Mantenimiento de Presión": "Pressure maintenance",
    },
    "lift_method": {
        "Sin Sistema de Extracción": "No lift system",
        "Bombeo Mecánico": "Rod pump",
        "Surgencia Natural": "Natural flow",
        "Electrosumergible": "ESP",
        "Cavidad Progresiva": "PCP",
        "Bombeo Hidráulico": "Hydraulic pump",
        "Otros Tipos de Extracción": "Other lift types",
    },
    "completion_type": {
        "Tapón disparo": "Plug and perf",
        "Punzado": "Perforated",
        "Camisas deslizables": "Sliding sleeves",
        "Camisas y punzados": "Sleeves and perforations",
        "Jetteo": "Jetting",
    },
}

# Columns that share another dimension's vocabulary.
ALIASES = {
    "well_fluid_latest": "well_fluid",
    "well_state_latest": "well_state",
    "lift_method_latest": "lift_method",
    "formation_reported": "formation",
    "block_cuenca": "cuenca",
    "block_trajectory": "trajectory",
    "block_name_marker": "name_marker",
}


def label_table(df: DataFrame, dims: list[str], prefix: str = "") -> DataFrame:
    """``(dim, value, code)`` for every value of every dimension, in one pass.

    Codes count from 0 in value order within a dimension.
    """
    values = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(prefix + d).alias("dim"), F.col(d).cast("string").alias("value"))
                    for d in dims
                ]
            )
        ).alias("x")
    ).select("x.dim", "x.value")
    return ordered_index(values, ["dim"], "value")


def require_labels(labels: DataFrame, dims: list[str]) -> DataFrame:
    """Raise if a dimension has no labels, or a dimension's labels were never added."""
    asked = labels.where(F.col("dim").isin(dims))
    present = {r.dim for r in asked.select("dim").distinct().collect()}
    missing = [d for d in dims if d not in present]
    if missing:
        raise ValueError(f"label tables missing or empty: {missing}")
    return labels


def _sizes(table: DataFrame, values: str = "value") -> dict[str, tuple[int, int]]:
    """Rows and bytes of the values per dimension: two numbers for each dimension, from one pass."""
    size = F.coalesce(F.sum(F.octet_length(F.col(values))), F.lit(0)).alias("bytes")
    found = table.groupBy("dim").agg(F.count("*").alias("n"), size).collect()
    return {r["dim"]: (r["n"], r["bytes"]) for r in found}


def encode(df: DataFrame, dims: list[str], labels: DataFrame, prefix: str = "") -> DataFrame:
    """Replace dimension values by codes; a value without a label becomes -1."""
    columns, sizes = df.columns, _sizes(labels)
    for d in dims:
        side = labels.where(F.col("dim") == prefix + d).select(
            F.col("value").alias(f"_v_{d}"), F.col("code").alias(f"_c_{d}")
        )
        side = broadcast_if_small(side, sizes.get(prefix + d, (0, 0)))
        df = df.join(side, F.col(d).cast("string") == F.col(f"_v_{d}"), "left")
    return df.select(
        *[
            F.coalesce(F.col(f"_c_{c}"), F.lit(NO_CODE)).cast("int").alias(c) if c in dims else F.col(c)
            for c in columns
        ]
    )


def decode(df: DataFrame, dims: list[str], labels: DataFrame, prefix: str = "") -> DataFrame:
    """Replace codes by values; -1 becomes NULL."""
    columns, sizes = df.columns, _sizes(labels)
    for d in dims:
        side = labels.where(F.col("dim") == prefix + d).select(
            F.col("code").alias(f"_c_{d}"), F.col("value").alias(f"_v_{d}")
        )
        side = broadcast_if_small(side, sizes.get(prefix + d, (0, 0)))
        df = df.join(side, F.col(d) == F.col(f"_c_{d}"), "left")
    return df.select(*[F.col(f"_v_{c}").alias(c) if c in dims else F.col(c) for c in columns])


def gloss_table(spark, names: DataFrame | None = None) -> DataFrame:
    """``(dim, value, gloss)``. ``names`` adds code-name pairs as the ``formation`` dimension."""
    rows = [(d, v, g) for d, pairs in GLOSSES.items() for v, g in pairs.items()]
    table = spark.createDataFrame(rows, "dim string, value string, gloss string")
    if names is None:
        return table
    code, name = names.columns
    spelled = names.where(
        (F.col(name) != "") & (F.lower(F.col(name)) != F.lower(F.col(code)))
    ).select(F.lit("formation").alias("dim"), F.col(code).alias("value"), title_case(name).alias("gloss"))
    return table.unionByName(spelled)


def has_gloss(dim: str) -> bool:
    key = ALIASES.get(dim, dim)
    return key == "formation" or key in GLOSSES


def gloss(df: DataFrame, dims: list[str], glosses: DataFrame) -> DataFrame:
    """Append ``value (gloss)`` to each named column; values without a gloss stay as they are."""
    glosses = pin(glosses)
    columns, sizes = df.columns, _sizes(glosses, "gloss")
    for d in dims:
        key = ALIASES.get(d, d)
        side = glosses.where(F.col("dim") == key).select(
            F.col("value").alias(f"_v_{d}"), F.col("gloss").alias(f"_g_{d}")
        )
        df = df.join(broadcast_if_small(side, sizes.get(key, (0, 0))), F.col(d) == F.col(f"_v_{d}"), "left")
    shown = lambda c: F.when(
        F.col(f"_g_{c}").isNotNull(), F.concat(F.col(c), F.lit(" ("), F.col(f"_g_{c}"), F.lit(")"))
    ).otherwise(F.col(c))
    return df.select(*[shown(c).alias(c) if c in dims else F.col(c) for c in columns])
