"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from factorseg.functions.columns import strip

# Fixed value: texts that a CSV cell may hold in place of a missing value.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_csv_table(spark: SparkSession, path: str, dtypes: Mapping[str, str] | None = None,
                   schema: T.StructType | None = None, infer: bool = True,
                   null_tokens: Sequence[str] = NULL_TOKENS, multiline: bool = True) -> DataFrame:
    """CSV with header, quoted as in RFC 4180. Types come from ``schema``, else ``dtypes``, else from the values.

    Cells are read as text, null tokens become null, and only then are types applied, so a
    token in a numeric column does not turn the whole column into text. A quoted cell may hold doubled quotes, commas and,
    with ``multiline``, line breaks; a file is then one task, so pass ``multiline=False`` for large files without such
    breaks. A row with more cells than the header is an error, a shorter one is filled with nulls.
    """
    reader = spark.read.options(header=True, inferSchema=False, quote='"', escape='"', multiLine=multiline)
    names = reader.csv(path).columns
    # one more column takes what is too much; a row that has it stops the read
    spare = "_more_cells"
    wide = T.StructType([T.StructField(c, T.StringType()) for c in [*names, spare]])
    raw = reader.options(enforceSchema=True).schema(wide).csv(path)
    fits = F.when(F.col(spare).isNull(), F.col(f"`{names[0]}`")).otherwise(
        F.raise_error(F.concat(F.lit("a row has more cells than the header: "), F.col(spare))))
    raw = raw.select(fits.alias(names[0]), *[F.col(f"`{c}`") for c in names[1:]])
    text = raw.select(*[F.when(~F.col(f"`{c}`").isin(*null_tokens), F.col(f"`{c}`")).alias(c)
                        for c in raw.columns])
    if schema is not None:
        require_columns(text, schema.fieldNames())
        return text.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])
    dtypes = dict(dtypes or {})
    if infer:
        free = [c for c in text.columns if c not in dtypes]
        dtypes = {**infer_types(text, free), **dtypes}
    return text.select(*[F.col(f"`{c}`").try_cast(dtypes.get(c, "string")).alias(c) for c in text.columns])


def infer_types(text: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """One aggregate over the text columns: bigint, double, boolean or string for each."""
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        v = strip(F.col(f"`{c}`"))
        aggs += [
            F.bool_and(v.rlike(r"^[+-]?[0-9]{1,18}$")).alias(f"i{i}"),
            F.bool_and(F.when(v.isNotNull(), v.try_cast("double").isNotNull() & ~v.rlike("[0-9.][dDfF]$")))
            .alias(f"d{i}"),
            F.bool_and(F.lower(v).isin("true", "false")).alias(f"b{i}"),
            F.bool_or(v.isNull()).alias(f"n{i}"),
        ]
    row = text.agg(*aggs).first()
    out = {}
    for i, c in enumerate(columns):
        if row[f"d{i}"] is None:  # nothing but nulls
            out[c] = "double"
        elif row[f"i{i}"] and not row[f"n{i}"]:
            out[c] = "bigint"
        elif row[f"d{i}"]:
            out[c] = "double"
        elif row[f"b{i}"] and not row[f"n{i}"]:
            out[c] = "boolean"
        else:
            out[c] = "string"
    return out


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"required columns are absent: {absent}; the table has {df.columns}")
    return df


def read_optional(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame | None:
    """The table, or None when the path does not exist."""
    try:
        return spark.read.format(fmt).options(**options).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def literal_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def select_positions(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Columns by position."""
    bad = [i for i in positions if not 0 <= i < len(df.columns)]
    if bad:
        raise IndexError(f"positions {bad} are outside the table's {len(df.columns)} columns")
    return df.select(*[F.col(f"`{df.columns[i]}`") for i in positions])


def select_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def present(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def drop_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*present(df, names))


def find_cluster_column(columns: Sequence[str], tag: str, expected: str | None = None,
                        strict: bool = False) -> str:
    """The label column: the expected one, ``cluster``, ``cluster_<tag>``, else by prefix.

    ``strict`` accepts the expected column or exactly one ``cluster_*`` column.
    """
    expected = expected or f"cluster_{tag}"
    if expected in columns:
        return expected
    if strict:
        found = [c for c in columns if c.startswith("cluster_")]
        if len(found) == 1:
            return found[0]
        raise ValueError(f"no column {expected} and no single cluster_* column in {list(columns)}")
    for name in ("cluster", f"cluster_{tag}"):
        if name in columns:
            return name
    found = [c for c in columns if c.startswith("cluster")]
    if not found:
        raise ValueError(f"no cluster column in {list(columns)}")
    return found[0]


def read_labels(df: DataFrame, tag: str, id_col: str = "customer_id",
                expected: str | None = None, strict: bool = False) -> DataFrame:
    """A label table with its label column renamed to ``cluster``."""
    require_columns(df, [id_col])
    return df.withColumnRenamed(find_cluster_column(df.columns, tag, expected, strict), "cluster")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One result table; array columns need parquet. CSV carries a header."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def write_report(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(line_no, line) as text files whose part order is the line order."""
    lines.orderBy("line_no").select("line").write.mode(mode).text(path)
