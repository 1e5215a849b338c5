"""Enrolment sources: loaders, header normalisation and cleaning.

SRC-1..3, PRJ-1..11.  The output of :func:`clean_enrolments` is the canonical
enrolment table every recommender job starts from.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aularank.fixed_values import (
    CANONICAL_COLUMNS,
    COLUMN_ALIASES,
    OPTIONAL_COLUMNS,
    REQUIRED_COLUMNS,
)
from aularank.functions.columns import (
    round_half_away,
    binary_flag,
    clip,
    numeric_or_null,
    numeric_or_zero_int,
)

log = logging.getLogger(__name__)

ORD = "ord"
PROGRESS = "PORCENTAJE_AVANCE"


# ---- SRC-1 / SRC-2 / SRC-3 -------------------------------------------------

def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Full scan of a catalog table or view (SRC-1)."""
    return spark.table(name)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict,
              column: str | None = None, lower: int | None = None, upper: int | None = None,
              partitions: int = 1) -> DataFrame:
    """Partitioned JDBC scan of one relational table (SRC-1)."""
    if column is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=properties)


def read_files(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Flat-file folder scan (SRC-2).  CSV is read as strings so coercion is exercised.

    Where the files have no order column, ``ORD`` tells where a row stands: its file, and its number in it (Parquet)
    or its block and its place in the block.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true").option("inferSchema", "false")
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.load(path)
    if ORD.upper() in {c.strip().upper() for c in df.columns}:
        return df
    place = [F.col("_metadata.row_index")] if fmt == "parquet" else [F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("f"), *[x.alias(f"r{i}") for i, x in enumerate(place)]).alias(ORD.upper()))


def first_available(loaders: Sequence[tuple[str, Callable[[], DataFrame]]]) -> tuple[DataFrame, str]:
    """Ordered source fallback with provenance (SRC-3).

    Each loader is forced to resolve its schema (missing paths, tables or
    credentials fail here).  Raises naming every source when all fail.
    """
    errors = []
    for name, loader in loaders:
        try:
            df = loader()
            df.schema  # noqa: B018 - forces analysis
            return df, name
        except Exception as exc:  # noqa: BLE001 - any source failure falls through
            log.warning("source %s failed: %s", name, exc)
            errors.append(f"{name}: {exc}")
    raise RuntimeError("no enrolment source could be loaded: " + " | ".join(errors))


# ---- PRJ-1..5 ---------------------------------------------------------------

def normalise_headers(df: DataFrame) -> DataFrame:
    """Strip + uppercase names (PRJ-1); on a collision the first column wins (Q3)."""
    seen: set[str] = set()
    keep = []
    for i, name in enumerate(df.columns):
        new = name.strip().upper()
        if new in seen:
            log.warning("duplicate column %r after normalisation dropped", name)
            continue
        seen.add(new)
        keep.append((i, new))
    # Positional rename first: original names may differ only by case.
    tmp = [f"_c{i}" for i in range(len(df.columns))]
    renamed = df.toDF(*tmp)
    return renamed.select(*[F.col(f"_c{i}").alias(new) for i, new in keep])


def apply_aliases(df: DataFrame) -> DataFrame:
    """Alias -> canonical rename, in order, only when the canonical is absent (PRJ-2)."""
    cols = list(df.columns)
    mapping = {}
    for alias, canonical in COLUMN_ALIASES:
        current = {mapping.get(c, c) for c in cols}
        if alias in current and canonical not in current:
            src = next(c for c in cols if mapping.get(c, c) == alias)
            mapping[src] = canonical
    return df.withColumnsRenamed(mapping) if mapping else df


def select_canonical(df: DataFrame, strict_projection: bool = False) -> DataFrame:
    """Project onto the canonical columns in canonical order (PRJ-3).

    The progress column is kept when present unless ``strict_projection`` (Q11);
    a source-order column ``ord`` is kept when present.
    """
    wanted = list(CANONICAL_COLUMNS)
    if not strict_projection:
        wanted.append(PROGRESS)
    missing = [c for c in CANONICAL_COLUMNS if c not in df.columns]
    if missing:
        log.warning("columns not found: %s", missing)
    present = [c for c in wanted if c in df.columns]
    if ORD.upper() in df.columns:
        present.append(ORD.upper())
    return df.select(*present)


def require_and_default(df: DataFrame) -> DataFrame:
    """Required-column check (PRJ-4) and optional defaults when absent (PRJ-5)."""
    missing = sorted(set(REQUIRED_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    add = {}
    for col, (default, typ) in OPTIONAL_COLUMNS.items():
        if col not in df.columns:
            add[col] = F.lit(default).cast(typ)
    for col in ("TIPO_CONSTANCIA", "FECHA_NACIMIENTO"):
        if col not in df.columns:
            add[col] = F.lit(None).cast("string")
    if PROGRESS not in df.columns:
        add[PROGRESS] = F.lit(0.0)
    return df.withColumns(add) if add else df


# ---- PRJ-6..11 --------------------------------------------------------------

def composite_rating(done: str = "CURSO_CULMINADO", approved: str = "APROBACION",
                     progress: str = PROGRESS):
    """PRJ-11: 2.5*done + not done * (1.5*approved + 1.0*[p>=.8] + .5*[.5<=p<.8]), clip, round 4."""
    d = F.col(done) == 1
    a = F.col(approved) == 1
    p = F.col(progress)
    raw = (
        F.when(d, 2.5).otherwise(0.0)
        + F.when(~d & a, 1.5).otherwise(0.0)
        + F.when(~d & (p >= 0.8), 1.0).otherwise(0.0)
        + F.when(~d & (p >= 0.5) & (p < 0.8), 0.5).otherwise(0.0)
    )
    return round_half_away(clip(raw, 0.0, 5.0), 4)


def source_order(df: DataFrame, order_by: Sequence[str] | None) -> Column:
    """WIN-5: what "first" means.  The declared key of the source, else its ``ORD`` column or the place in its files
    (``read_files``), else (rows of a table have no order of their own) the rows' contents.
    """
    kinds = dict(df.dtypes)
    if order_by:
        return F.struct(*[F.col(c.strip().upper()) for c in order_by])
    if ORD.upper() in kinds:
        return F.col("ORD") if kinds["ORD"].startswith("struct") else F.col("ORD").cast("long")
    return F.struct(*[F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith("map")])


def clean_enrolments(raw: DataFrame, strict_projection: bool = False, order_by: Sequence[str] | None = None) -> DataFrame:
    """Normalise, validate, default and coerce a raw enrolment table.

    Output: canonical typed columns + ``RATING_COMPUESTO`` + ``ord`` (``source_order``: "first" values must not
    depend on how Spark happened to read or shuffle the rows).  Rows with a null user or course key are kept here (they
    are dropped where grouped, Q6).
    """
    named = apply_aliases(normalise_headers(raw))
    if order_by:  # the key need not be one of the projected columns
        named = named.withColumn(ORD.upper(), source_order(named, order_by))
    df = require_and_default(select_canonical(named, strict_projection))
    types = {f.name: f.dataType for f in df.schema.fields}
    ordc = source_order(df, None)
    key = lambda c: F.trim(F.col(c).cast("string"))
    out = df.select(
        ordc.alias(ORD),
        key("USUARIO_DOCUMENTO").alias("USUARIO_DOCUMENTO"),
        key("ID_OFERTA_FORMATIVA").alias("ID_OFERTA_FORMATIVA"),
        F.col("CURSO").cast("string").alias("CURSO"),
        F.col("NIVELNEXUS").cast("string").alias("NIVELNEXUS"),
        numeric_or_zero_int(F.col("APROBACION"), types["APROBACION"]).alias("APROBACION"),
        numeric_or_zero_int(F.col("ACTIVO"), types["ACTIVO"]).alias("ACTIVO"),
        numeric_or_zero_int(F.col("AÑO"), types["AÑO"]).alias("AÑO"),
        clip(F.coalesce(numeric_or_null(F.col(PROGRESS), types[PROGRESS]), F.lit(0.0)), 0.0, 1.0).alias(PROGRESS),
        F.coalesce(numeric_or_null(F.col("HORAS_PROGRAMA"), types["HORAS_PROGRAMA"]), F.lit(0.0))
        .alias("HORAS_PROGRAMA"),
        numeric_or_null(F.col("EDAD"), types["EDAD"]).alias("EDAD"),
        clip(numeric_or_null(F.col("CALIFICACIONES"), types["CALIFICACIONES"]), 0.0, 5.0).alias("CALIFICACIONES"),
        binary_flag(F.col("CURSO_CULMINADO"), types["CURSO_CULMINADO"]).alias("CURSO_CULMINADO"),
        *[F.col(c).cast("string").alias(c) for c in
          ("NOMBRE_DRE", "NOMBRE_UGEL", "PROPOSITO", "NOMBRE_COMPLETO", "PUBLICO_OBJETIVO", "ID_GRUPO",
           "TIPO_CONSTANCIA", "FECHA_NACIMIENTO")],
        F.col("ES_FOCALIZADO").alias("ES_FOCALIZADO"),
    )
    return out.withColumn("RATING_COMPUESTO", composite_rating())


def load_enrolments(spark: SparkSession, loaders: Sequence[tuple[str, Callable[[], DataFrame]]],
                    strict_projection: bool = False, order_by: Sequence[str] | None = None) -> tuple[DataFrame, str]:
    """SRC-3 + cleaning: ``(clean enrolments, source name)``."""
    raw, source = first_available(loaders)
    return clean_enrolments(raw, strict_projection, order_by), source
