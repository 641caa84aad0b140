"""Data-quality reports over the raw tables. Nothing is corrected, imputed or removed.

Each report is one aggregation pass. Counts of distinct keys are taken by grouping on the key
first, so duplicates collapse on the map side and no distinct set is held by a single task.
"""

from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcut.functions.neighbours import with_neighbours
from gridcut.functions.scalars import (
    all_of,
    changed,
    count_if,
    is_finite,
    month_label,
    off_grid,
    outside,
    unix_micros,
)
from gridcut.sources.readers import naive_time, read_parquet
from gridcut.sources.sinks import exists
from gridcut.schemas import (
    CAUSES,
    DATASETS,
    ENTITY,
    HALF_HOUR_SECONDS,
    OBS_KEY,
    ORIGINS,
    SUBSYSTEMS,
    dataset_schema,
)
from gridcut.session import stored

NULL_MARK = "<NULL>"
GROUP_CEG = "-"
GENERATION_TOLERANCE = 0.001


def limited(detail: bool = False) -> Column:
    return F.lit(False) if detail else F.col("val_geracaolimitada").isNotNull()


# --- schema ----------------------------------------------------------------------------------


def read_footers(spark: SparkSession, folder: str) -> DataFrame:
    """(arquivo, linhas, colunas) of every Parquet file under a folder, `colunas` an array of (nome, tipo).

    Files are listed by Spark without their contents, and tasks read footers only, one file at a time.
    """
    shape = "arquivo string, linhas long, colunas array<struct<nome: string, tipo: string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyarrow import parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(quote(path, safe="/:"))
                with store.open_input_file(inner) as opened:
                    footer = pq.ParquetFile(opened)
                    fields = from_arrow_schema(footer.schema_arrow, prefer_timestamp_ntz=True).fields
                    known = [{"nome": f.name, "tipo": f.dataType.simpleString()} for f in fields]
                    rows.append((path, footer.metadata.num_rows, known))
            named = pa.list_(pa.struct([("nome", pa.string()), ("tipo", pa.string())]))
            kinds = [pa.string(), pa.int64(), named]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                names=["arquivo", "linhas", "colunas"],
            )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    paths = files.load(folder).select("path")
    return paths.repartition(spark.sparkContext.defaultParallelism * 4, "path").mapInArrow(run, shape)


def folder_drift(spark: SparkSession, folder: str, wanted: T.StructType) -> DataFrame:
    """(arquivo, linhas, coluna, problema, tipo, esperado): columns of a folder's files that are missing,
    unexpected or of another type than in `wanted`; files that agree give no row."""
    expected = F.array(
        *[F.struct(F.lit(f.name).alias("nome"), F.lit(f.dataType.simpleString()).alias("tipo")) for f in wanted]
    )
    footers = read_footers(spark, folder)
    cells = footers.select("arquivo", "linhas", F.explode("colunas").alias("c"), F.lit("tipo").alias("lado")).unionByName(
        footers.select("arquivo", "linhas", F.explode(expected).alias("c"), F.lit("esperado").alias("lado"))
    )

    def side(name: str) -> Column:
        return F.max(F.when(F.col("lado") == name, F.col("c.tipo"))).alias(name)

    both = cells.groupBy("arquivo", "linhas", F.col("c.nome").alias("coluna")).agg(side("tipo"), side("esperado"))
    kind = F.when(F.col("tipo").isNull(), "ausente").when(F.col("esperado").isNull(), "inesperada").otherwise("tipo")
    return both.where(~F.col("tipo").eqNullSafe(F.col("esperado"))).select(
        "arquivo", "linhas", "coluna", kind.alias("problema"), "tipo", "esperado"
    )


def schema_drift(spark: SparkSession, tables: dict[str, T.StructType], wanted: T.StructType):
    """One row per (table, column) that is missing, unexpected or of another type."""
    rows = []
    expected = {f.name: f.dataType.simpleString() for f in wanted}
    for name, schema in tables.items():
        actual = {f.name: f.dataType.simpleString() for f in schema}
        for column in sorted(expected.keys() | actual.keys()):
            have, need = actual.get(column), expected.get(column)
            if have == need:
                continue
            kind = "ausente" if have is None else "inesperada" if need is None else "tipo"
            rows.append((name, column, kind, have, need))
    return spark.createDataFrame(
        rows, "tabela string, coluna string, problema string, encontrado string, esperado string"
    )


# --- keys and time ---------------------------------------------------------------------------


def key_report(df: DataFrame, sources: Sequence[str], detail: bool = False) -> DataFrame:
    """Missing and foreign keys, number of entities, time span and limited rows, in one row."""
    per_entity = df.groupBy("fonte", "id_ons").agg(
        F.count(F.lit(1)).alias("n"),
        count_if(F.col("din_instante").isNull()).alias("no_time"),
        F.min("din_instante").alias("a"),
        F.max("din_instante").alias("b"),
        count_if(limited(detail)).alias("lim"),
    )
    foreign = F.col("fonte").isNull() | ~F.col("fonte").isin(*sources)
    per_id = per_entity.groupBy("id_ons").agg(
        F.count("fonte").alias("n_sources"),
        F.count(F.lit(1)).alias("n_entities"),
        F.sum("n").alias("n"),
        F.sum("no_time").alias("no_time"),
        F.sum(F.when(F.col("fonte").isNull(), F.col("n"))).alias("no_source"),
        F.sum(F.when(foreign, F.col("n"))).alias("foreign"),
        F.min("a").alias("a"),
        F.max("b").alias("b"),
        F.sum("lim").alias("lim"),
    )

    def total(c: str | Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    return per_id.agg(
        total(F.when(F.col("id_ons").isNull(), F.col("n"))).alias("null_id"),
        total("no_time").alias("null_time"),
        total("no_source").alias("null_source"),
        total("foreign").alias("invalid_source"),
        total("n_entities").alias("entities"),
        F.min("a").alias("start"),
        F.max("b").alias("end"),
        total("lim").alias("limited_rows"),
        count_if(F.col("id_ons").isNotNull() & (F.col("n_sources") > 1)).alias(
            "ids_shared_across_sources"
        ),
    )


def temporal_report(df: DataFrame) -> DataFrame:
    """Duplicates, gaps, off-grid and irregular steps of each entity's time axis, in one row."""
    stamps = (
        df.where(all_of([F.col(c).isNotNull() for c in OBS_KEY]))
        .groupBy(*OBS_KEY)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    steps = with_neighbours(
        stamps, ENTITY, "din_instante", previous={"prev": "din_instante"}
    ).withColumn("s", (unix_micros("din_instante") - unix_micros("prev")) / 1_000_000)
    gap = F.col("s") > HALF_HOUR_SECONDS
    slots_lost = F.floor(F.col("s") / HALF_HOUR_SECONDS) - 1
    repeated = F.when(F.col("n") > 1, F.lit(0.0))
    return steps.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_excess"),
        count_if(F.col("n") > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(off_grid("din_instante"), F.col("n"))), F.lit(0)).alias(
            "off_grid"
        ),
        count_if(gap).alias("gaps"),
        F.coalesce(F.sum(F.when(gap, slots_lost)), F.lit(0)).alias(
            "missing_slots_between_observations"
        ),
        count_if((F.col("s") > 0) & (F.col("s") % HALF_HOUR_SECONDS != 0)).alias(
            "irregular_steps"
        ),
        F.max(F.greatest("s", repeated)).alias("max_step_seconds"),
    )


# --- nulls, numbers, domains -----------------------------------------------------------------


def _null_counts(columns: Sequence[str], lim: Column) -> list[Column]:
    return [
        F.struct(
            F.lit(c).alias("coluna"),
            count_if(F.col(c).isNull()).alias("nulls"),
            count_if(F.col(c).isNull() & lim).alias("limited_nulls"),
        )
        for c in columns
    ]


def null_report(df: DataFrame, by: Sequence[Column] = (), detail: bool = False) -> DataFrame:
    """Nulls per column, all rows and limited rows, optionally per group."""
    lim = limited(detail)
    names = df.columns
    wide = df.groupBy(*by).agg(
        F.array(*_null_counts(names, lim)).alias("__c"),
        F.count(F.lit(1)).alias("rows"),
        count_if(lim).alias("limited_rows"),
    )
    keys = [c for c in wide.columns if c not in {"__c", "rows", "limited_rows"}]
    counts = ["rows", "limited_rows"] if by else []
    return wide.select(*keys, *counts, F.inline("__c"))


def null_report_by_month(df: DataFrame, detail: bool = False) -> DataFrame:
    return null_report(df, [F.col("fonte"), month_label("din_instante").alias("period")], detail)


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]


def numeric_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Negative and non-finite counts and the finite range of every numeric column."""
    parts = []
    for c in columns or float_columns(df):
        finite = is_finite(c)
        value = F.when(finite, F.col(c))
        parts.append(
            F.struct(
                F.lit(c).alias("coluna"),
                count_if(finite & (F.col(c) < 0)).alias("negative"),
                count_if(~finite).alias("nonfinite"),
                F.min(value).alias("min"),
                F.max(value).alias("max"),
            )
        )
    return df.agg(F.array(*parts).alias("__c")).select(F.inline("__c"))


QUANTILES = (0.01, 0.5, 0.99, 0.999)


def numeric_quantiles(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Approximate quantiles of the finite values (a mergeable sketch, relative rank error 1e-4)."""
    parts = []
    for c in columns or float_columns(df):
        sketch = F.percentile_approx(F.when(is_finite(c), F.col(c)), list(QUANTILES), 10_000)
        parts.append(F.struct(F.lit(c).alias("coluna"), sketch.alias("quantiles_approx")))
    wide = df.agg(F.array(*parts).alias("__c")).select(F.inline("__c"))
    values = [F.col("quantiles_approx")[i].alias(f"q{i}") for i in range(len(QUANTILES))]
    return wide.select("coluna", *values)


#: Parts that a value interval is cut into in one pass, and of a doubling (by e) in the first one.
INTERVAL_PARTS, FIRST_PARTS = 4096, 64


def exact_quantiles(
    df: DataFrame, columns: Sequence[str] | None = None, quantiles: Sequence[float] = QUANTILES
) -> DataFrame:
    """(coluna, q0, q1, ..): the least finite value whose rank reaches each share of the finite values.

    Rank selection for all columns and quantiles at once: a pass counts values by interval and part
    of it before the shuffle, running counts tell the part that holds each rank, and the next pass
    looks into these parts alone. Parts are relative to size at first, then even, and an interval
    shrinks to the values found in it, so a handful of passes is enough whatever the distribution.
    Nothing is sorted; the driver sees one row for each quantile. `df` is read in every pass: pass a
    stored table or a scan. A column without finite values has NULLs.
    """
    names = list(columns or float_columns(df))
    spark = df.sparkSession
    wanted = {(c, k): None for c in names for k in range(len(quantiles))}  # -> interval and rank in it
    found: dict[tuple[str, int], float | None] = {}
    passes = 0
    while len(found) < len(wanted):
        passes += 1
        cells = []
        for c in names:
            value = F.col(f"`{c}`").cast("double")
            if passes == 1:
                part = F.floor(F.signum(value) * F.log1p(F.abs(value)) * FIRST_PARTS)
                inside = [(f"{c}", is_finite(f"`{c}`"), part)]
            else:
                open_ = {w[0] for key, w in wanted.items() if key[0] == c and key not in found}
                inside = [
                    (f"{c}:{low!r}", value.between(low, high), F.floor((value - low) / (high - low) * INTERVAL_PARTS))
                    for low, high in sorted(open_)
                ]
            for name, within, part in inside:
                cells.append(F.when(within, F.struct(F.lit(name).alias("i"), part.alias("p"), value.alias("v"))))
        counted = (
            df.select(F.explode(F.array(*cells)).alias("c"))
            .where("c is not null")
            .groupBy("c.i", "c.p")
            .agg(F.count(F.lit(1)).alias("n"), F.min("c.v").alias("low"), F.max("c.v").alias("high"))
        )
        parts = Window.partitionBy("i")
        upto = parts.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = counted.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(parts)})
        asked = []
        for (c, k), w in wanted.items():
            if (c, k) not in found:
                asked.append((c, k, c if w is None else f"{c}:{w[0][0]!r}", None if w is None else w[1], quantiles[k]))
        asks = spark.createDataFrame(asked, "c string, k int, i string, rank long, q double")
        share = F.greatest(F.lit(1), F.col("all") - F.floor(F.col("all") - F.col("q") * F.col("all"))).cast("long")
        rank = F.coalesce("rank", share)
        hits = summed.join(F.broadcast(asks), "i").withColumn("at", rank - (F.col("upto") - F.col("n")))
        got = {(r["c"], r["k"]): r for r in hits.where("at > 0 and at <= n").collect()}  # one row a quantile
        for key in [k for k in wanted if k not in found]:
            r = got.get(key)
            if r is None or r["low"] == r["high"]:
                found[key] = None if r is None else r["low"]
            else:
                wanted[key] = ((r["low"], r["high"]), r["at"])
    shape = "coluna string, " + ", ".join(f"q{k} double" for k in range(len(quantiles)))
    return spark.createDataFrame([(c, *[found[c, k] for k in range(len(quantiles))]) for c in names], shape)


def domains_of(sources: Sequence[str], detail: bool = False) -> dict[str, Sequence]:
    out = {"fonte": tuple(sources), "id_subsistema": SUBSYSTEMS}
    if not detail:
        return out | {"cod_razaorestricao": CAUSES, "cod_origemrestricao": ORIGINS}
    flag = "flg_dadoventoinvalido" if sources[0] == "eolica" else "flg_dadoirradianciainvalido"
    return out | {flag: (0, 1)}


def domain_report(df: DataFrame, domains: dict[str, Sequence]) -> DataFrame:
    """Value counts of the coded columns and how many of the rows are outside the domain."""
    entries = []
    for name, allowed in domains.items():
        value = F.col(name)
        if isinstance(df.schema[name].dataType, T.BooleanType):
            value = value.cast("int")
        entries.append(
            F.struct(
                F.lit(name).alias("coluna"),
                value.cast("string").alias("value"),
                outside(value, allowed).alias("bad"),
            )
        )
    return (
        df.select(F.inline(F.array(*entries)))
        .groupBy("coluna", "value")
        .agg(F.count(F.lit(1)).alias("rows"), count_if(F.col("bad")).alias("invalid_rows"))
    )


# --- coverage and identity -------------------------------------------------------------------


def coverage_report(df: DataFrame, detail: bool = False) -> DataFrame:
    """Rows, entities, span and limited rows by source, entity, state, subsystem and month.

    Rows are first reduced to one per entity, state, subsystem and month; the five groupings then
    run on that small table.
    """
    base = df.groupBy(
        "fonte", "id_ons", "id_estado", "id_subsistema", month_label("din_instante").alias("m")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("din_instante").alias("a"),
        F.max("din_instante").alias("b"),
        count_if(limited(detail)).alias("lim"),
    )
    levels = {
        "source": F.lit(None).cast("string"),
        "entity": F.col("id_ons"),
        "state": F.col("id_estado"),
        "subsystem": F.col("id_subsistema"),
        "month": F.col("m"),
    }
    grid = F.array(
        *[F.struct(F.lit(k).alias("dimension"), v.alias("value")) for k, v in levels.items()]
    )
    return (
        base.select("fonte", "id_ons", "n", "a", "b", "lim", F.inline(grid))
        .groupBy("dimension", "fonte", "value")
        .agg(
            F.sum("n").alias("rows"),
            F.count_distinct("id_ons").alias("entities"),
            F.min("a").alias("start"),
            F.max("b").alias("end"),
            F.sum("lim").alias("limited_rows"),
        )
    )


def granularity_report(df: DataFrame) -> DataFrame:
    """Rows and entities per level: group of plants, individual plant, or unknown."""
    level = (
        F.when(F.col("ceg") == GROUP_CEG, "conjunto")
        .when(F.col("ceg").isNull(), "desconhecida")
        .otherwise("individual")
    )
    return (
        df.groupBy("fonte", level.alias("level"), "id_ons")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("fonte", "level")
        .agg(F.sum("n").alias("rows"), F.count("id_ons").alias("entities"))
    )


def identity_drift(df: DataFrame) -> DataFrame:
    """Entities whose name, state, subsystem or code changed (a switch to NULL counts)."""
    watched = {
        "names": "nom_usina",
        "states": "id_estado",
        "subsystems": "id_subsistema",
        "cegs": "ceg",
    }
    variants = df.select(
        *ENTITY, *[F.coalesce(c, F.lit(NULL_MARK)).alias(n) for n, c in watched.items()]
    ).distinct()
    counted = variants.groupBy(*ENTITY).agg(*[F.count_distinct(n).alias(n) for n in watched])
    return counted.where(F.greatest(*watched) > 1)


# --- consistency -----------------------------------------------------------------------------


def label_consistency(df: DataFrame) -> DataFrame:
    cause, origin = F.col("cod_razaorestricao"), F.col("cod_origemrestricao")
    lim = limited()
    return df.agg(
        count_if(~lim & (cause.isNotNull() | origin.isNotNull())).alias("label_without_limit"),
        count_if(lim & cause.isNull()).alias("limit_without_cause"),
        count_if(
            F.col("val_geracaoreferenciafinal").isNotNull() & changed(cause, F.lit("REL"))
        ).alias("final_reference_without_rel"),
    )


def calendar_mismatches(df: DataFrame) -> DataFrame:
    """Rows whose redundant calendar columns disagree with the timestamp."""
    ts = F.col("din_instante")
    wanted = {
        "ano": F.year(ts),
        "mes": F.month(ts),
        "data": F.to_date(ts),
        "hora": F.hour(ts),
        "minuto": F.minute(ts),
        "ano_mes": month_label(ts),
    }
    return df.agg(*[count_if(changed(c, expr)).alias(c) for c, expr in wanted.items()])


def audit_flags(df: DataFrame, sources: Sequence[str], detail: bool = False) -> DataFrame:
    """Every condition that turns a table's status to `issues`, as (check, count) rows."""

    def long(report: DataFrame, names: Sequence[str]) -> DataFrame:
        pairs = [
            F.struct(F.lit(n).alias("check"), F.col(n).cast("bigint").alias("n")) for n in names
        ]
        return report.select(F.inline(F.array(*pairs)))

    keys = key_report(df, sources, detail)
    time = temporal_report(df)
    numbers = numeric_report(df).agg(
        F.sum("negative").alias("negative"), F.sum("nonfinite").alias("nonfinite")
    )
    domains = domain_report(df, domains_of(sources, detail)).agg(
        F.sum("invalid_rows").alias("invalid_domain")
    )
    auxiliaries = calendar_mismatches(df)
    empty = df.agg((F.count(F.lit(1)) == 0).cast("bigint").alias("no_rows"))
    return (
        long(keys, ["null_id", "null_time", "null_source", "invalid_source"])
        .unionByName(long(time, ["duplicate_excess", "off_grid", "gaps", "irregular_steps"]))
        .unionByName(long(numbers, ["negative", "nonfinite"]))
        .unionByName(long(domains, ["invalid_domain"]))
        .unionByName(long(auxiliaries, auxiliaries.columns))
        .unionByName(long(empty, ["no_rows"]))
    )


def audit_status(flags: DataFrame) -> DataFrame:
    bad = F.sum(F.coalesce("n", F.lit(0)))
    return flags.agg(F.when(bad > 0, "issues").otherwise("ok").alias("status"))


def file_status(spark: SparkSession, path: str, dataset: str) -> str:
    """`missing`, `unreadable`, `invalid_schema`, `issues` or `ok` for one file of the contract."""
    if not exists(spark, path):
        return "missing"
    try:
        df = naive_time(read_parquet(spark, path))
    except AnalysisException:
        return "unreadable"
    except Exception as error:  # a footer that cannot be parsed surfaces as a Spark job failure
        if "footer" in str(error).lower() or "parquet" in str(error).lower():
            return "unreadable"
        raise
    _, sources, detail = DATASETS[dataset]
    if schema_drift(spark, {dataset: df.schema}, dataset_schema(dataset)).count():
        return "invalid_schema"
    return audit_status(audit_flags(df, sources, detail)).first()["status"]


# --- comparisons between tables --------------------------------------------------------------


def month_fingerprints(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(fonte, period, rows, sum1, sum2): a hash of the multiset of rows of each source and month.

    A row's two 64-bit hashes (which tell NULL from absent) are added up, so order does not matter and
    repeats count. Rows are added before the shuffle, of which one row a month comes out.
    """
    told = [F.col(f"`{c}`") for c in columns]
    blanks = [c.isNull() for c in told]
    hashes = {"sum1": F.xxhash64(*told, *blanks), "sum2": F.xxhash64(*blanks, *reversed(told), F.lit(2))}
    return df.groupBy("fonte", month_label("din_instante").alias("period")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(h.cast("decimal(20,0)")).alias(n) for n, h in hashes.items()],
    )


def multiset_difference(main: DataFrame, integrated: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (with multiplicity) of one table that the other lacks, by source and month.

    Months whose fingerprints agree on both sides are equal and go no further: their rows are never
    shuffled. The rest are counted per distinct row in one shuffle; EXCEPT ALL in either direction is
    the positive part of the count difference. The months that differ are calendar-sized.
    """
    own, other = (month_fingerprints(d, columns) for d in (main, integrated))
    facts = ["rows", "sum1", "sum2"]
    renamed = other.select(*[F.col(c).alias(f"o_{c}") for c in other.columns])
    on = F.col("fonte").eqNullSafe(F.col("o_fonte")) & F.col("period").eqNullSafe(F.col("o_period"))
    apart = own.join(renamed, on, "full").where(~all_of([F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in facts]))
    present = F.col("rows").isNotNull()
    apart = apart.select(
        F.when(present, F.col("fonte")).otherwise(F.col("o_fonte")).alias("__f"),
        F.when(present, F.col("period")).otherwise(F.col("o_period")).alias("__p"),
    )
    apart = stored(apart, "meses_diferentes")

    def differing(df: DataFrame, sign: int) -> DataFrame:
        met = F.col("fonte").eqNullSafe(F.col("__f")) & month_label("din_instante").eqNullSafe(F.col("__p"))
        return df.join(F.broadcast(apart), met, "left_semi").select(*columns, F.lit(sign).alias("__d"))

    sides = differing(main, 1).unionByName(differing(integrated, -1))
    net = sides.groupBy(*columns).agg(F.sum("__d").alias("__net")).where("__net <> 0")
    return net.groupBy(
        F.when(F.col("__net") > 0, "main_minus_integrated")
        .otherwise("integrated_minus_main")
        .alias("direction"),
        "fonte",
        month_label("din_instante").alias("period"),
    ).agg(F.sum(F.abs("__net")).alias("rows"))


def detail_overlap(main: DataFrame, detail: DataFrame) -> DataFrame:
    """How many individual plants of the main table appear in the detail table."""
    ids = main.where(F.col("ceg") != GROUP_CEG).select(*ENTITY).distinct()
    known = detail.select(*ENTITY).distinct().withColumn("hit", F.lit(True))
    return ids.join(known, ENTITY, "left").agg(
        F.count(F.lit(1)).alias("main_individual_ids"), F.count("hit").alias("matched_ids")
    )


def detail_values(main: DataFrame, detail: DataFrame) -> DataFrame:
    """Generation of individual plants in both tables; repeated detail rows stay visible.

    The join is on the full key, and the detail side is reduced to one row per key and value
    beforehand, so repeated rows travel once and their number is kept as a weight.
    """
    left = main.where(F.col("ceg") != GROUP_CEG).select(*OBS_KEY, "val_geracao")
    right = detail.groupBy(*OBS_KEY, "val_geracaoverificada").agg(F.count(F.lit(1)).alias("w"))
    gap = F.abs(F.col("val_geracao") - F.col("val_geracaoverificada"))
    either_null = F.col("val_geracao").isNull() | F.col("val_geracaoverificada").isNull()
    weight = F.col("w")
    pairs = left.join(right, OBS_KEY).groupBy(*OBS_KEY).agg(
        F.sum(weight).alias("n"),
        F.sum(F.when(gap > GENERATION_TOLERANCE, weight)).alias("diff"),
        F.sum(F.when(either_null, weight)).alias("missing"),
        F.max(gap).alias("gap"),
    )

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    return pairs.agg(
        total("n").alias("join_rows"),
        F.count(F.lit(1)).alias("matched_intervals"),
        (total("n") - F.count(F.lit(1))).alias("duplicated_join_rows"),
        total("diff").alias("generation_different"),
        total("missing").alias("generation_missing"),
        F.max("gap").alias("max_abs_difference_mw"),
    )


def detail_membership(detail: DataFrame) -> DataFrame:
    """Plants, named groups and rows without a group, per source."""
    per_plant = detail.groupBy("fonte", "id_ons", "nom_conjuntousina").agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_plant.groupBy("fonte").agg(
        F.count_distinct("id_ons").alias("individuals"),
        F.count_distinct("nom_conjuntousina").alias("group_names"),
        F.coalesce(
            F.sum(F.when(F.col("nom_conjuntousina").isNull(), F.col("n"))), F.lit(0)
        ).alias("rows_without_group"),
    )
