"""The ordered quality rules, singly, as one chain, and as a one-pass report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.config import SalesConfig
from salesmart.functions.dates import date_of
from salesmart.functions.numeric import finite, number_from_text
from salesmart.sources.csv import INGEST_ORDER

KEY = "order_id"

# Verdicts in the order of the rules.
MISSING = "missing_value"
NON_POSITIVE = "non_positive"
UNKNOWN_CATEGORY = "unknown_category"
UNKNOWN_REGION = "unknown_region"
BAD_DATE = "bad_date"
CLEAN = "clean"
# Columns of a judged frame. The names are reserved: a feed must not have them.
VERDICT, COPIES, BITS = "__judge_verdict", "__judge_copies", "__judge_missing"
JUDGE_COLUMNS = (VERDICT, COPIES, BITS)


def require_columns(df: DataFrame, config: SalesConfig = SalesConfig()) -> DataFrame:
    """The frame itself, or an error that names every missing or reserved column."""
    reserved = [name for name in df.columns if name in JUDGE_COLUMNS]
    if reserved:
        raise ValueError(f"Reserved columns: {reserved}")
    missing = [name for name in config.required if name not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return df


def typed(df: DataFrame, config: SalesConfig = SalesConfig()) -> DataFrame:
    """Numeric columns as finite doubles; text that is no number becomes NULL."""
    kinds = {field.name: field.dataType for field in df.schema}
    columns = {}
    for name in config.numeric:
        if name in kinds:
            is_text = isinstance(kinds[name], T.StringType)
            columns[name] = number_from_text(F.col(name)) if is_text else finite(F.col(name))
    return df.withColumns(columns)


# --- one row per order -------------------------------------------------------


def keep_first(df: DataFrame, order: Sequence[str] = INGEST_ORDER, key: str = KEY) -> DataFrame:
    """First row of each key in the given order; missing keys are one key.

    Each map task keeps one row per key before the shuffle, so a key that holds
    a large share of the rows does not load one reducer.
    """
    place = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("__place", place).filter(F.col("__place") == 1).drop("__place")


def keep_first_counted(
    df: DataFrame, order: Sequence[str] = INGEST_ORDER, key: str = KEY
) -> DataFrame:
    """``keep_first`` with the number of rows per key as ``COPIES``, in one pass.

    The columns stay in their order. The aggregate carries whole rows, so
    unneeded columns are not pruned: hand in those that are wanted, and none
    that cannot be compared (maps).
    """
    others = [name for name in df.columns if name not in (key, *order)]
    # The smallest row by the order columns; they come first in the comparison.
    first = F.min(F.struct(*order, *others))
    kept = df.groupBy(key).agg(first.alias("__row"), F.count("*").alias(COPIES))
    # The key itself, not a copy in the row: the result stays partitioned by it.
    columns = [F.col(f"`{n}`") if n == key else F.col(f"__row.`{n}`").alias(n) for n in df.columns]
    return kept.select(*columns, COPIES)


# --- rules as predicates -----------------------------------------------------


def missing_bits(config: SalesConfig) -> Column:
    """One bit per required column, set where its value is missing."""
    bits = (f"IF(`{name}` IS NULL, {1 << n}L, 0L)" for n, name in enumerate(config.required))
    return F.expr(" + ".join(bits))


def has_non_positive(config: SalesConfig) -> Column:
    return F.expr(" OR ".join(f"`{name}` <= 0" for name in config.positive))


def bad_category(config: SalesConfig) -> Column:
    return ~F.col("category").isin(*config.categories)


def bad_region(config: SalesConfig) -> Column:
    return ~F.col("region").isin(*config.regions)


# --- rules as filters --------------------------------------------------------


def drop_missing(df: DataFrame, config: SalesConfig = SalesConfig()) -> DataFrame:
    return df.dropna(how="any", subset=list(config.required))


def keep_positive(df: DataFrame, config: SalesConfig = SalesConfig()) -> DataFrame:
    return df.filter(~has_non_positive(config))


def keep_known_categories(df: DataFrame, config: SalesConfig = SalesConfig()) -> DataFrame:
    return df.filter(~bad_category(config))


def keep_known_regions(df: DataFrame, config: SalesConfig = SalesConfig()) -> DataFrame:
    return df.filter(~bad_region(config))


def keep_valid_dates(df: DataFrame, config: SalesConfig = SalesConfig()) -> DataFrame:
    """``date`` parsed; rows whose date does not parse are dropped."""
    parsed = date_of(df, "date", config.date_format)
    return df.withColumn("date", parsed).filter(F.col("date").isNotNull())


RULES = (drop_missing, keep_positive, keep_known_categories, keep_known_regions, keep_valid_dates)


def validate(
    df: DataFrame,
    order: Sequence[str] = INGEST_ORDER,
    config: SalesConfig = SalesConfig(),
    rules: Sequence = RULES,
) -> DataFrame:
    """Clean rows: first row per order, then every rule in turn.

    A shorter ``rules`` gives the rows as they stand after those rules.
    """
    rows = df.transform(require_columns, config).transform(typed, config)
    rows = keep_first(rows, order).drop(*INGEST_ORDER)
    for rule in rules:
        rows = rule(rows, config)
    return rows


# --- one-pass report ---------------------------------------------------------


def judge(
    df: DataFrame, order: Sequence[str] = INGEST_ORDER, config: SalesConfig = SalesConfig()
) -> DataFrame:
    """First row per order with its number of copies and the first rule it breaks.

    ``VERDICT`` is the name of that rule or ``clean``, ``BITS`` tells the missing
    columns. Rejected rows stay, with ``date`` as it came in; all columns of the
    feed stay in their order.
    """
    rows = df.transform(require_columns, config).transform(typed, config)
    rows = keep_first_counted(rows, order).drop(*INGEST_ORDER)
    rows = rows.withColumn(BITS, missing_bits(config))
    verdict = (
        F.when(F.col(BITS) != 0, MISSING)
        .when(has_non_positive(config), NON_POSITIVE)
        .when(bad_category(config), UNKNOWN_CATEGORY)
        .when(bad_region(config), UNKNOWN_REGION)
        .when(date_of(rows, "date", config.date_format).isNull(), BAD_DATE)
        .otherwise(CLEAN)
    )
    return rows.withColumn(VERDICT, verdict)


def without_rejected(judged: DataFrame) -> DataFrame:
    """Judged rows of which the rejected ones keep only what the report reads."""
    kept = (*JUDGE_COLUMNS, "region")
    return judged.select(*[
        F.col(f"`{name}`") if name in kept
        else F.when(F.col(VERDICT) == CLEAN, F.col(f"`{name}`")).alias(name)
        for name in judged.columns
    ])


def clean_rows(judged: DataFrame, config: SalesConfig = SalesConfig()) -> DataFrame:
    """The accepted rows of a judged frame, ``date`` parsed."""
    kept = judged.filter(F.col(VERDICT) == CLEAN).drop(*JUDGE_COLUMNS)
    return kept.withColumn("date", date_of(kept, "date", config.date_format))


def null_profile(df: DataFrame, config: SalesConfig = SalesConfig()) -> DataFrame:
    """Missing values per required column, columns without any left out."""
    counts = df.selectExpr(
        *[f"count_if(`{name}` IS NULL) AS `{name}`" for name in config.required]
    )
    profile = counts.unpivot([], list(config.required), "column_name", "missing")
    return profile.filter("missing > 0")


def tally(judged: DataFrame, config: SalesConfig = SalesConfig()) -> DataFrame:
    """All counts of the report as one row, in one pass over judged rows.

    Of a staged copy it reads the three judge columns and the region only.
    """
    nulls = ", ".join(
        f"count_if(({BITS} & {1 << n}L) <> 0) AS `{name}`"
        for n, name in enumerate(config.required)
    )
    dropped = (MISSING, NON_POSITIVE, UNKNOWN_CATEGORY, BAD_DATE)
    # The region rule reports every unknown region it met, also on rows that
    # the category rule had already taken out.
    met = F.col(VERDICT).isin(UNKNOWN_CATEGORY, UNKNOWN_REGION, BAD_DATE, CLEAN)
    return judged.agg(
        F.expr(f"coalesce(sum({COPIES}), 0) AS rows_in"),
        F.expr("count(*) AS rows_kept"),
        F.expr(f"struct({nulls}) AS missing"),
        *[F.expr(f"count_if({VERDICT} = '{rule}') AS {rule}") for rule in dropped],
        F.count_if(met & bad_region(config)).alias(UNKNOWN_REGION),
        F.expr(f"count_if({VERDICT} = '{CLEAN}') AS rows_clean"),
    )


def issues(tallied: DataFrame, config: SalesConfig = SalesConfig()) -> DataFrame:
    """One line per rule that fired: its place, name, count and message."""
    nulls = ", ".join(
        f"IF(missing.`{name}` > 0, concat(\"'{name}': \", missing.`{name}`), NULL)"
        for name in config.required
    )
    # The wording of the messages.
    lines = (
        ("duplicate_order_id", "rows_in - rows_kept", "'Dropped ', n, ' duplicate order_ids'"),
        (MISSING, MISSING, f"'Nulls found: {{', concat_ws(', ', {nulls}), '}}'"),
        (NON_POSITIVE, NON_POSITIVE, "'Dropped ', n, ' rows with invalid numeric values'"),
        (UNKNOWN_CATEGORY, UNKNOWN_CATEGORY, "'Dropped ', n, ' unknown categories'"),
        (UNKNOWN_REGION, UNKNOWN_REGION, "'Dropped ', n, ' unknown regions'"),
        (BAD_DATE, BAD_DATE, "'Dropped ', n, ' bad dates'"),
    )
    counts = ", ".join(
        f"struct({seq} AS seq, '{rule}' AS rule, bigint({n}) AS n)"
        for seq, (rule, n, _) in enumerate(lines, start=1)
    )
    message = " ".join(f"WHEN '{rule}' THEN concat({text})" for rule, _, text in lines)
    fired = tallied.selectExpr("missing", f"inline(array({counts}))").filter("n > 0")
    return fired.selectExpr("seq", "rule", "n", f"CASE rule {message} END AS message")


def row_totals(tallied: DataFrame) -> DataFrame:
    """Rows before, dropped and after."""
    return tallied.selectExpr("rows_in", "rows_in - rows_clean AS rows_dropped", "rows_clean")
