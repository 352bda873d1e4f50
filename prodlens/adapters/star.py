"""The order star schema seen as a production panel.

Customers are wells, their orders by month are the production, runs of equal order priority
are operator spans, orders are state changes, line items are fracture jobs keyed by supplier,
and line-item revenue is the independent official series. Every table is derived from whole
input tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prodlens.functions.dates import date_from_parts, days_in_month, month_start, year_month
from prodlens.functions.units import M3_TO_BBL

REGIONS = {"AFRICA": "africa", "AMERICA": "america", "ASIA": "asia", "EUROPE": "europe", "MIDDLE EAST": "middle_east"}
EVENT_TIE_BREAK = ["event_id"]


def _money(c):
    """Sums of cents, free of the order in which doubles were added."""
    return F.round(F.sum(c), 2)


class StarPanel:
    """The panel tables over ``<root>/<table>.parquet``. Nothing is read until used."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._schemas: dict[str, StructType] = {}

    def table(self, name: str) -> DataFrame:
        """The footers of a table are read once per panel; later reads are given the schema."""
        path = f"{self.root}/{name}.parquet"
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[name]).parquet(path)

    @cached_property
    def coordinates(self) -> DataFrame:
        """``(idpozo, lon, lat)`` from the first two numbers of each vector."""
        e = lambda i: F.col("embedding")[i].cast("double")
        return self.table("embeddings").select(
            F.col("vec_id").cast("long").alias("idpozo"),
            (e(0) * 60 - 63.5).alias("lon"),
            (e(1) * 60 - 38.5).alias("lat"),
        )

    @cached_property
    def wells(self) -> DataFrame:
        places = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        seg, nation = F.col("c_mktsegment"), F.col("n_nationkey")
        marker = F.when(F.col("c_acctbal") >= 5000, F.left(seg, F.lit(1))).otherwise(
            F.right(seg, F.lit(1))
        )
        unconventional = seg.isin("BUILDING", "MACHINERY")
        return (
            self.table("customer")
            .join(places, F.col("c_nationkey") == nation)
            .select(
                F.col("c_custkey").alias("idpozo"),
                F.concat("c_name", F.lit("("), marker, F.lit(")")).alias("sigla"),
                F.col("r_name").alias("cuenca"),
                F.col("n_name").alias("provincia"),
                F.nullif(F.concat(F.lit("BLOCK "), (nation % 6).cast("string")), F.lit("BLOCK 0")).alias("area"),
                F.concat("n_name", F.lit("/"), F.left(seg, F.lit(3))).alias("yacimiento"),
                F.nullif(F.concat(F.lit("F"), (nation % 7).cast("string")), F.lit("F6")).alias("formprod"),
                F.lower(seg).alias("formacion"),
                F.when(F.col("c_acctbal") < 0, "SERVICIO").otherwise("EXPLOTACION").alias("clasificacion"),
                F.when(seg == "BUILDING", "DESARROLLO").otherwise("AVANZADA").alias("subclasificacion"),
                F.when(unconventional, "NO CONVENCIONAL").otherwise("CONVENCIONAL").alias("tipo_recurso"),
                F.when(seg == "BUILDING", "SHALE")
                .when(seg == "MACHINERY", "TIGHT")
                .when(seg == "AUTOMOBILE", F.lit(None))
                .otherwise("No informado")
                .alias("sub_tipo_recurso"),
                F.col("c_acctbal").alias("profundidad"),
                nation.cast("double").alias("cota"),
                (F.col("c_acctbal") >= 0).alias("has_production"),
            )
            .join(
                self.coordinates.select(
                    "idpozo", F.col("lon").alias("coordenadax"), F.col("lat").alias("coordenaday")
                ),
                "idpozo",
                "left",
            )
        )

    @cached_property
    def orders(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("idpozo"),
            F.col("o_orderdate").cast("date").alias("day"),
            "o_orderkey",
            "o_orderstatus",
            "o_totalprice",
            "o_orderpriority",
        )

    def combine_days(self) -> DataFrame:
        """All that the panel needs of the orders, one row per well and day, in one pass.

        Combined before the shuffle, so a well with a third of all orders sends one row per day and map
        task; a well has as many rows here as the calendar has days.
        """
        status, prio, price = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice")
        signed = F.when(prio == "5-LOW", -price).otherwise(price)
        kind = F.when(status == "F", "Petrolífero").when(status == "O", "Gasífero").otherwise("Inyección de Agua")
        lift = F.when(status == "F", "Bombeo Mecánico").when(status == "O", "Surgencia Natural")
        state = F.struct(kind.alias("tipopozo"), prio.alias("tipoestado"), lift.alias("tipoextraccion"))
        return self.orders.groupBy("idpozo", "day").agg(
            F.sum(F.when(status == "F", price)).alias("prod_pet"),
            F.sum(F.when(status == "O", price)).alias("prod_gas"),
            F.sum(F.when(status == "P", signed)).alias("prod_agua"),
            F.sum(F.when(prio == "1-URGENT", price)).alias("iny_agua"),
            F.sum(F.when(status == "O", F.when(prio == "2-HIGH", price).otherwise(0.0))).alias("iny_gas"),
            F.count_if(status == "F").alias("n_oil"),
            F.count_if(status == "P").alias("n_pending"),
            F.min_by("o_orderpriority", "o_orderkey").alias("empresa"),
            F.max("o_orderkey").alias("event_id"),
            F.max_by(state, "o_orderkey").alias("state"),
        )

    @cached_property
    def days(self) -> DataFrame:
        return self.combine_days()

    @cached_property
    def monthly_production(self) -> DataFrame:
        volumes = ("prod_pet", "prod_gas", "prod_agua", "iny_agua", "iny_gas")
        return (
            self.days.groupBy("idpozo", month_start("day").alias("fecha"))
            .agg(*[_money(F.col(c)).alias(c) for c in volumes], (F.nullif(F.sum("n_oil"), F.lit(0)) * 300.0).alias("tef"))
            .withColumn("anio", F.year("fecha"))
        )

    @cached_property
    def well_operator_history(self) -> DataFrame:
        """Runs of equal priority, the first order of a day deciding; low priority is no operator."""
        by_day = Window.partitionBy("idpozo").orderBy("day")
        daily = self.days.select("idpozo", "day", "empresa")
        starts = daily.withColumn("previous", F.lag("empresa").over(by_day)).where(
            ~F.col("empresa").eqNullSafe(F.col("previous"))
        )
        runs = starts.select(
            "idpozo",
            F.left("empresa", F.lit(1)).alias("idempresa"),
            "empresa",
            F.col("day").alias("valid_from"),
            F.date_sub(F.lead("day").over(by_day), 1).alias("valid_to"),
        )
        return runs.where(F.col("empresa") != "5-LOW")

    @cached_property
    def daily_events(self) -> DataFrame:
        """The last state change of each well and day, which is all that as-of joins and latest states read."""
        return self.days.select("idpozo", F.col("day").alias("event_date"), "event_id", "state.*")

    @cached_property
    def daily_register(self) -> DataFrame:
        """The register with each well's declared days once."""
        return self.days.where("n_pending > 0").select("idpozo", F.year("day").alias("anio"), F.month("day").alias("mes"))

    @cached_property
    def well_events(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.orders.select(
            "idpozo",
            F.col("day").alias("event_date"),
            F.col("o_orderkey").alias("event_id"),
            F.when(status == "F", "Petrolífero").when(status == "O", "Gasífero").otherwise("Inyección de Agua").alias("tipopozo"),
            F.col("o_orderpriority").alias("tipoestado"),
            F.when(status == "F", "Bombeo Mecánico").when(status == "O", "Surgencia Natural").alias("tipoextraccion"),
        )

    @cached_property
    def jobs(self) -> DataFrame:
        """Line items as jobs of their supplier; a length is reported on few of them."""
        flag, qty, price = F.col("l_returnflag"), F.col("l_quantity"), F.col("l_extendedprice")
        reported = (F.col("l_tax") >= 0.08) & (F.col("l_discount") >= 0.1)
        ship = F.col("l_shipdate").cast("date").cast("string")
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("idpozo"),
            F.when(reported & (qty <= 4), price / 100).when(reported & (qty <= 5), 0.0).alias("longitud_rama_horizontal_m"),
            qty.cast("int").alias("cantidad_fracturas"),
            price.alias("arena_bombeada_nacional_tn"),
            F.when(flag != "N", F.round(F.col("l_tax") * 100)).alias("arena_bombeada_importada_tn"),
            F.when(flag != "R", qty * 10).alias("agua_inyectada_m3"),
            price.alias("presion_maxima_psi"),
            F.when(flag == "A", qty).alias("potencia_equipos_fractura_hp"),
            F.when(F.col("l_linestatus") == "O", ship).otherwise("sin fecha").alias("fecha_inicio_fractura"),
            ship.alias("fecha_fin_fractura"),
            F.when(flag == "A", "Punzado").when(flag == "N", "Tapón disparo").otherwise("Jetteo").alias("tipo_terminacion"),
            F.col("l_linestatus").alias("formacion_productiva"),
        )

    @cached_property
    def register(self) -> DataFrame:
        """First-production register: every pending order, so most wells are listed repeatedly."""
        return self.orders.where(F.col("o_orderstatus") == "P").select(
            "idpozo", F.year("day").alias("anio"), F.month("day").alias("mes")
        )

    @cached_property
    def registry(self) -> DataFrame:
        """A second source of coordinates as GeoJSON text: one label's points are displaced and
        another's have no text."""
        e = lambda i: F.col("embedding")[i].cast("double")
        shift = F.when(F.col("label") == 0, 0.287).otherwise(0.0)
        lon, lat = e(0) * 60 - 63.5 + shift, e(1) * 60 - 38.5
        text = F.concat(F.lit('{"coordinates":['), lon.cast("string"), F.lit(","), lat.cast("string"), F.lit("]}"))
        return self.table("embeddings").select(
            F.col("vec_id").cast("long").alias("idpozo"), F.when(F.col("label") != 1, text).alias("geojson")
        )

    def combine_official(self) -> DataFrame:
        """Both fluids of the independent series from one pass over the items: revenue of a month by line status,
        in all, by region (``F_africa``) and by return flag (``F_flag_A``)."""
        places = (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey", "r_name")
        )
        # summed per supplier before the join: a supplier with very many items sends few rows
        month = year_month(F.col("l_shipdate").cast("date")).alias("indice_tiempo")
        sums = self.table("lineitem").groupBy("l_suppkey", "l_returnflag", "l_linestatus", month).agg(F.sum("l_extendedprice").alias("price"))
        price, cells = F.col("price"), []
        for status in "FO":
            of = lambda c, status=status: F.when((F.col("l_linestatus") == status) & c, price)
            cells += [_money(of(F.lit(True))).alias(status), F.count_if(F.col("l_linestatus") == status).alias(f"{status}_n")]
            cells += [_money(of(F.col("r_name") == r)).alias(f"{status}_{s}") for r, s in REGIONS.items()]
            cells += [_money(of(F.col("l_returnflag") == f)).alias(f"{status}_flag_{f}") for f in "AR"]
        return sums.join(places, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("indice_tiempo").agg(*cells)

    @cached_property
    def official(self) -> DataFrame:
        return self.combine_official()

    def _official(self, status: str, total: str, column: str, subtypes: dict[str, str]) -> DataFrame:
        return self.official.where(F.col(f"{status}_n") > 0).select(
            "indice_tiempo",
            F.col(status).alias(total),
            *[F.col(f"{status}_{s}").alias(column.format(s)) for s in REGIONS.values()],
            *[F.col(f"{status}_flag_{f}").alias(c) for f, c in subtypes.items()],
        )

    @cached_property
    def official_oil(self) -> DataFrame:
        days = days_in_month(date_from_parts(F.left("indice_tiempo", F.lit(4)).cast("int"), F.right("indice_tiempo", F.lit(2)).cast("int")))
        wide = self._official("F", "total", "cuenca_{}", {"A": "shale", "R": "tight"})
        daily = F.col("total") / days
        return wide.withColumn("total_diario", daily).withColumn(
            "kbbl_diario", F.col("total_diario") * M3_TO_BBL / 1000
        )

    @cached_property
    def official_gas(self) -> DataFrame:
        return self._official(
            "O",
            "produccion_gas_natural_total",
            "produccion_gas_natural_cuenca_{}",
            {"A": "produccion_shale_gas", "R": "produccion_tight_gas"},
        )

    @cached_property
    def user_events(self) -> DataFrame:
        """The event stream by user and day."""
        return self.table("events").select(
            "user_id", F.col("ts").cast("date").alias("day"), "event_id", "event_type", "value", "ts"
        )


