"""Readers for the daily and monthly extracts, and report writers."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from prodseries.spec import EXACT, MEASURE, exactly


class LoadError(Exception):
    """A failure that stops the load; nothing is published."""


# Source headers and the raw column each becomes, in source order.
DAILY_COLUMNS = {
    "DATEPRD": ("dateprd", "date"),
    "WELL_BORE_CODE": ("well_bore_code", "string"),
    "NPD_WELL_BORE_CODE": ("npd_well_bore_code", "int"),
    "NPD_WELL_BORE_NAME": ("npd_well_bore_name", "string"),
    "NPD_FIELD_CODE": ("npd_field_code", "int"),
    "NPD_FIELD_NAME": ("npd_field_name", "string"),
    "NPD_FACILITY_CODE": ("npd_facility_code", "int"),
    "NPD_FACILITY_NAME": ("npd_facility_name", "string"),
    "ON_STREAM_HRS": ("on_stream_hrs", "measure"),
    "AVG_DOWNHOLE_PRESSURE": ("avg_downhole_pressure", "measure"),
    "AVG_DOWNHOLE_TEMPERATURE": ("avg_downhole_temperature", "measure"),
    "AVG_DP_TUBING": ("avg_dp_tubing", "measure"),
    "AVG_ANNULUS_PRESS": ("avg_annulus_press", "measure"),
    "AVG_CHOKE_SIZE_P": ("avg_choke_size_p", "measure"),
    "AVG_CHOKE_UOM": ("avg_choke_uom", "string"),
    "AVG_WHP_P": ("avg_whp_p", "measure"),
    "AVG_WHT_P": ("avg_wht_p", "measure"),
    "DP_CHOKE_SIZE": ("dp_choke_size", "measure"),
    "BORE_OIL_VOL": ("bore_oil_vol", "measure"),
    "BORE_GAS_VOL": ("bore_gas_vol", "measure"),
    "BORE_WAT_VOL": ("bore_wat_vol", "measure"),
    "BORE_WI_VOL": ("bore_wi_vol", "measure"),
    "FLOW_KIND": ("flow_kind", "string"),
    "WELL_TYPE": ("well_type", "string"),
}
MONTHLY_COLUMNS = {
    "Wellbore name": ("wellbore_name", "string"),
    "NPDCode": ("npdcode", "int"),
    "Year": ("year", "int"),
    "Month": ("month", "int"),
    "On Stream": ("on_stream", "text"),
    "Oil": ("oil", "text"),
    "Gas": ("gas", "text"),
    "Water": ("water", "text"),
    "GI": ("gi", "text"),
    "WI": ("wi", "text"),
}


def open_extract(spark: SparkSession, path: str, fmt: str = "csv", columns=(), label: str = "Extract") -> DataFrame:
    """Open the files of an exported sheet by header name; CSV columns stay text until converted.

    The header of every file is read before any row: files with other columns, or the same in another order, are lined
    up by name, and a file without one of `columns` is refused by its name. Empty files have no header and no rows.
    """
    try:
        if fmt != "csv":
            return require_columns(spark.read.format(fmt).option("mergeSchema", True).load(path), columns, label)
        files = spark.read.text(path).inputFiles()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise LoadError(f"Source not found at {path}") from e
        raise
    layouts: dict[tuple[str, ...], list[str]] = {}
    for file, header in _headers(spark, files):
        if header is None:
            continue
        missing = [c for c in columns if c not in header]
        if missing:
            raise LoadError(f"{label} is missing required column(s): {missing} in {file}")
        twice = sorted({c for c in header if header.count(c) > 1})
        if twice:
            raise LoadError(f"{label} has column(s) {twice} more than once in {file}")
        layouts.setdefault(header, []).append(file)
    if not layouts:
        raise LoadError(f"No header in the files at {path}")
    parts = []
    for header, of in layouts.items():
        text = T.StructType([T.StructField(c, T.StringType()) for c in header])
        parts.append(spark.read.schema(text).option("header", True).csv(of))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


#: Files whose first lines are read at the same time.
HEADERS_AT_ONCE = 16


def _headers(spark: SparkSession, uris: list[str]) -> list[tuple[str, tuple[str, ...] | None]]:
    """(file, names in its first line) of each file, None for an empty one: one short read a file, by the store's own client."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def read(uri: str):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
        stream = path.getFileSystem(conf).open(path)
        codec = codecs.getCodec(path)
        stream = codec.createInputStream(stream) if codec is not None else stream
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        try:
            line = reader.readLine()
        finally:
            reader.close()
        return path.toString(), None if line is None else tuple(next(csv.reader([line.removeprefix("\ufeff")]), ()))

    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        return [*pool.map(read, sorted(uris))]


def require_columns(df: DataFrame, columns, label: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise LoadError(f"{label} is missing required column(s): {missing}")
    return df


def clean(column: Column, source: T.DataType, kind: str) -> Column:
    """Null-like values become NULL and the value takes its declared type.

    What does not fit its type as a whole raises: nothing is cut, rounded or turned into NULL. A date may come with a
    time of day, as text or as a timestamp, which is left out: a production day has none.
    """
    text = isinstance(source, T.StringType)
    if isinstance(source, (T.DoubleType, T.FloatType)):
        column = F.when(~F.isnan(column), column)
    elif isinstance(source, T.StringType):
        column = F.when(~F.lower(F.trim(column)).isin("", "nan", "nat", "none"), column)
    if kind == "date":
        # date text may carry a time
        if text:
            return F.to_date(F.substring(_checked(F.trim(column), DATE_TEXT, "date"), 1, 10))
        return column.cast("date")
    if kind == "int":
        # 9000.0 is how a column with blanks is exported
        if text:
            return F.regexp_extract(_checked(F.trim(column), WHOLE_TEXT, "whole number"), WHOLE_TEXT, 1).cast("int")
        whole = F.when(column == F.floor(column), column).otherwise(_not("whole number", column))
        return F.when(column.isNotNull(), whole).cast("int")
    if kind == "measure":
        return exact_number(column, source)
    return column.cast("string")


# Dates with an optional time; whole numbers, also as 9000.0; numbers with their fraction and exponent.
DATE_TEXT = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"
WHOLE_TEXT = r"^([+-]?\d+)(?:\.0*)?$"
NUMBER_TEXT = r"^[+-]?\d*\.?(\d*?)0*(?:[eE]([+-]?\d+))?$"


def _not(what: str, column: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"not a {what}: "), column.cast("string")))


def _checked(column: Column, pattern: str, what: str) -> Column:
    """The text, which has to match as a whole."""
    return F.when(column.isNotNull(), F.when(column.rlike(pattern), column).otherwise(_not(what, column)))


def exact_number(column: Column, source: T.DataType) -> Column:
    """A measure with all its decimals; more than EXACT holds is an error."""
    if isinstance(source, T.StringType):
        text = F.trim(column)
        power = F.coalesce(F.nullif(F.regexp_extract(text, NUMBER_TEXT, 2), F.lit("")).cast("int"), F.lit(0))
        decimals = F.length(F.regexp_extract(text, NUMBER_TEXT, 1)) - power
        column = F.when(text.isNotNull(), F.when(decimals <= EXACT.scale, text).otherwise(_not(f"number of at most {EXACT.scale} decimals", text)))
        return column.cast(EXACT)
    return exactly(column, source, EXACT)


def measure_to_text(column: Column, source: T.DataType) -> Column:
    """Numbers become their whole decimal text ("192.0"), NaN becomes NULL, text passes through.

    Decimals and integers keep every digit. Doubles get digits that give the same double again, with an exponent
    ("1e-20", "2.5e+16") below 0.0001 and from 10^16 on.
    """
    if isinstance(source, T.StringType):
        return F.when(~F.lower(F.trim(column)).isin("", "nan"), column)
    text = column.cast("string")
    if isinstance(source, (T.DoubleType, T.FloatType)):
        size = F.abs(column)
        whole = _plain(text.try_cast("decimal(38,22)").cast("string"))
        scientific = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), "E-", "e-"), r"E(\d)", "e+$1")
        fits = (size == 0) | ((size >= 1e-4) & (size < 1e16))
        return F.when(~F.isnan(column), F.when(fits, whole).otherwise(scientific))
    if isinstance(source, T.DecimalType) and source.scale:
        return _plain(text)
    return F.concat(text, F.lit(".0"))


def _plain(digits: Column) -> Column:
    """Digits with a fraction, without the zeros at its end but for one."""
    short = F.rtrim(digits, F.lit("0"))
    return F.when(short.endswith("."), F.concat(short, F.lit("0"))).otherwise(short)


def narrowed(df: DataFrame, columns, measure: T.DecimalType = MEASURE) -> DataFrame:
    """df with the given columns as the measure type; a value that does not fit exactly is an error."""
    return df.withColumns({c: exactly(F.col(c), df.schema[c].dataType, measure) for c in columns})


def convert(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """One projection: pick, rename and type the columns of an extract."""
    outs = []
    for header, (name, kind) in columns.items():
        source = df.schema[header].dataType
        c = F.col(f"`{header}`")
        outs.append((measure_to_text(c, source) if kind == "text" else clean(c, source, kind)).alias(name))
    return df.select(*outs)


def read_daily(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return convert(open_extract(spark, path, fmt, DAILY_COLUMNS, "Daily extract"), DAILY_COLUMNS)


def read_monthly(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return convert(open_extract(spark, path, fmt, MONTHLY_COLUMNS, "Monthly extract"), MONTHLY_COLUMNS)


def write_reports(reports: dict[str, DataFrame], out: str) -> list[str]:
    """One CSV folder per report."""
    for name, df in reports.items():
        df.write.mode("overwrite").option("header", True).csv(f"{out}/{name}")
    return list(reports)
