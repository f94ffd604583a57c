"""Schema catalogue as tables: shard groups, rosters, and schema text within a budget.

``tables``:  db_id, schema_name, table_name, pos (order in the catalogue), ddl (optional)
``columns``: schema_name, table_name, ordinal, column_name, data_type
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.identifiers import quoted, shard_key, shard_prefix
from plumbline.functions.text import TRUNCATED
from plumbline.operators.ordered import first_rows, null_safe_join
from plumbline.session import shared_folder

# Least size of a shard group, names listed, and the layout of the texts.
GROUP_SIZE = 3
NAMES_LISTED = 15
SCHEMA_HEAD = (
    "DATABASE: %s | SCHEMA: %s\n"
    "Full path format: %s.%s.TABLE_NAME\n"
    "IMPORTANT: Quote column names exactly as shown in DDL.\n\n"
)
GROUP_TEXT = (
    "PARTITIONED TABLES — prefix '%s' (%d tables):\n"
    "- Pattern: %s_<KEY> (key range: %s to %s)\n"
    "- Use UNION ALL to query across multiple partitions (no wildcards).\n\n"
    "SAMPLE STRUCTURE (all '%s' tables share this schema):\n"
    "Table: %s.%s.%s_<KEY>\n%s\n\n"
)
GROUP_LABEL = "%s.%s_* (%d partitions, representative: %s)"
TABLE_TEXT = "-- %s.%s.%s\n%s\n\n"
STRUCTURES = "TABLE STRUCTURES:\n\n"
TABLE_START = "\n\n--"


def grouped_tables(tables: DataFrame, *extra: str) -> DataFrame:
    """One row per shard group, and one per table that is in none.

    ``extra`` are further columns of ``tables`` to keep for the listed table. A group of one
    or two falls apart into its tables, which are its first and its last name, so one
    pre-aggregated pass is enough and no heavy group is joined back to its rows.
    """
    scope = [c for c in ("db_id", "schema_name") if c in tables.columns]
    name = F.col("table_name")
    prefix = shard_prefix(name)
    member = F.struct("table_name", "pos", *extra)
    groups = tables.groupBy(
        *scope, prefix.isNotNull().alias("is_shard"), F.coalesce(prefix, name).alias("stem")
    ).agg(
        F.count(F.lit(1)).alias("n_tables"),
        F.min("pos").alias("first_pos"),
        F.min(shard_key(name)).alias("min_key"),
        F.max(shard_key(name)).alias("max_key"),
        F.min(member).alias("_first"),
        F.max(member).alias("_last"),
    )
    is_group = F.col("is_shard") & (F.col("n_tables") >= GROUP_SIZE)
    members = F.when(is_group, F.array("_first")).otherwise(
        F.array_distinct(F.array("_first", "_last"))
    )
    listed = groups.withColumn("is_group", is_group).withColumn("_m", F.explode(members))
    return listed.select(
        *scope,
        "is_group",
        "is_shard",
        F.when(F.col("is_group"), F.col("stem")).alias("prefix"),
        F.when(F.col("is_group"), F.col("n_tables")).otherwise(1).alias("n_tables"),
        F.when(F.col("is_group"), F.col("min_key")).alias("min_key"),
        F.when(F.col("is_group"), F.col("max_key")).alias("max_key"),
        "first_pos",
        *[F.col(f"_m.{c}").alias(c) for c in ("table_name", "pos", *extra)],
    )


def shard_groups(tables: DataFrame) -> DataFrame:
    """Prefixes shared by three tables or more, with key range and representative."""
    scope = [c for c in ("db_id", "schema_name") if c in tables.columns]
    return grouped_tables(tables).filter("is_group").select(
        *scope,
        "prefix",
        "n_tables",
        "min_key",
        "max_key",
        F.col("table_name").alias("representative"),
    )


def name_lists(listed: DataFrame, scope: list[str]) -> DataFrame:
    """Per schema, the line naming its regular tables: at most 15 names and a count.

    Tables of groups too small come after the others.
    """
    regular = listed.filter("NOT is_group").withColumn(
        "_order", F.struct("is_shard", F.when(F.col("is_shard"), F.col("first_pos")), "pos")
    )
    counts = regular.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"))
    top = first_rows(
        regular.select(*scope, "_order", "table_name"), scope, ["_order"], NAMES_LISTED
    )
    names = top.groupBy(*scope).agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("_order", "table_name"))),
                lambda t: t.table_name,
            ),
            ", ",
        ).alias("names")
    )
    more = F.format_string(
        f"TABLES (%d total): %s... (and %d more)\n\n", "n", "names", F.col("n") - NAMES_LISTED
    )
    text = F.when(F.col("n") > NAMES_LISTED, more).otherwise(
        F.format_string("TABLES: %s\n\n", "names")
    )
    return null_safe_join(counts, names, scope).select(*scope, text.alias("text"))


def schema_pieces(tables: DataFrame) -> DataFrame:
    """The schema text of each database in pieces: db_id, part (sort order), text.

    Per schema: a head, the shard groups, the names of the regular tables, and their DDL.
    Tables in a shard group are not listed again.
    """
    scope = ["db_id", "schema_name"]
    listed = grouped_tables(tables, "ddl")

    def part(section: Column, place: Column) -> Column:
        return F.struct(
            F.col("schema_name"), section.alias("section"), place.alias("place")
        ).alias("part")

    none = F.lit(0).cast("long")
    first = Window.partitionBy("db_id").orderBy("schema_name")
    heads = (
        tables.select(*scope)
        .distinct()
        .withColumn("_gap", F.when(F.row_number().over(first) > 1, "\n").otherwise(""))
        .select(
            "db_id",
            part(F.lit(0), none),
            F.concat(
                "_gap",
                F.format_string(SCHEMA_HEAD, "db_id", "schema_name", "db_id", "schema_name"),
            ).alias("text"),
        )
    )
    is_group = F.col("is_group")
    group = F.format_string(
        GROUP_TEXT,
        *["prefix", "n_tables", "prefix", "min_key", "max_key", "prefix"],
        *["db_id", "schema_name", "prefix", "ddl"],
    )
    single = F.format_string(TABLE_TEXT, "db_id", "schema_name", "table_name", "ddl")
    place = F.when(is_group, F.col("first_pos")).otherwise(F.col("pos"))
    section = F.when(is_group, 1).otherwise(3)
    structures = listed.select(
        "db_id", part(section, place), F.when(is_group, group).otherwise(single).alias("text")
    )
    names = name_lists(listed, scope).select(
        "db_id", part(F.lit(2), none), F.concat("text", F.lit(STRUCTURES)).alias("text")
    )
    return heads.unionByName(structures).unionByName(names)


def budgeted_text(
    pieces: DataFrame, key: str, order: str, text: str, budget: int
) -> DataFrame:
    """Per key: ``full_length`` of all pieces in order, and ``head``, their text up to at
    least the budget.

    Empty pieces add nothing and are left out. With the shortest of the others known, only the
    first budget / shortest pieces can start within the budget; no task sees more of a heavy
    key than these. A budget of 0 is off: then the whole text is wanted and built.
    """
    size = F.length(text)
    lengths = pieces.groupBy(key).agg(F.coalesce(F.sum(size), F.lit(0)).alias("full_length"))
    kept = pieces.select(key, order, text).filter(size > 0)
    if budget > 0:
        least = kept.agg(F.min(size)).first()[0] or 1
        before = Window.partitionBy(key).orderBy(order).rowsBetween(
            Window.unboundedPreceding, -1
        )
        kept = (
            first_rows(kept, [key], [order], budget // least + 2)
            .withColumn("_start", F.coalesce(F.sum(F.length(text)).over(before), F.lit(0)))
            .filter(F.col("_start") <= budget)
        )
    heads = kept.groupBy(key).agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))),
                lambda p: p.t,
            ),
            "",
        ).alias("head")
    )
    return null_safe_join(lengths, heads, [key], "left").fillna("", ["head"])


def schema_texts(tables: DataFrame, *budgets: int) -> DataFrame:
    """Schema text per database and budget, cut at the last table that starts within it.

    The pieces are written to the shared folder once and serve their lengths and the texts of
    every budget.
    """
    shared_folder(tables.sparkSession)
    pieces = schema_pieces(tables).checkpoint()
    return reduce(DataFrame.unionByName, [_schema_text(pieces, budget) for budget in budgets])


def _schema_text(pieces: DataFrame, budget: int) -> DataFrame:
    texts = budgeted_text(pieces, "db_id", "part", "text", budget)
    whole, shown = F.col("head"), F.lit(budget).alias("budget")
    if budget <= 0:
        return texts.select("db_id", shown, whole.alias("ddl"), F.lit(False).alias("truncated"))
    prefix = F.left(whole, F.lit(budget))
    found = F.instr(F.reverse(prefix), F.lit(TABLE_START[::-1]))
    before = F.lit(budget) - found - (len(TABLE_START) - 1)
    cut = F.when(found > 0, before).otherwise(F.lit(budget))
    too_long = F.col("full_length") > budget
    ddl = F.when(too_long, F.concat(F.left(whole, cut), F.lit(TRUNCATED))).otherwise(whole)
    return texts.select("db_id", shown, ddl.alias("ddl"), too_long.alias("truncated"))


# Frame of the column roster.
ROSTER_HEAD = (
    "=== VERIFIED COLUMN ROSTER (SOURCE OF TRUTH) ===\n"
    'NOTE: Columns shown with double-quotes (e.g. "my_col") are case-sensitive and MUST be '
    'referenced with double-quotes in SQL (e.g. t."my_col"). Unquoted uppercase columns are '
    "case-insensitive.\n"
)
ROSTER_TAIL = "\n=== END ROSTER — DO NOT USE COLUMNS NOT LISTED ABOVE ===\n\n"


def column_roster(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """One line per table or shard group: its label, then all its columns with types.

    Where both inputs name the database, tables of one name in two of them are kept apart.
    """
    scope = [c for c in ("db_id",) if c in tables.columns and c in columns.columns]
    listed = grouped_tables(tables if scope else tables.drop("db_id"))
    label = F.when(
        F.col("is_group"),
        F.format_string(GROUP_LABEL, "schema_name", "prefix", "n_tables", "table_name"),
    ).otherwise(F.concat_ws(".", "schema_name", "table_name"))
    shown = F.format_string("%s (%s)", quoted(F.col("column_name")), F.col("data_type"))
    return (
        columns.join(
            listed.select(*scope, "schema_name", "table_name", label.alias("label")),
            [*scope, "schema_name", "table_name"],
        )
        .groupBy(*scope, "schema_name", "table_name", "label")
        .agg(
            F.count(F.lit(1)).alias("n_columns"),
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("ordinal", shown.alias("shown")))),
                    lambda c: c.shown,
                ),
                ", ",
            ).alias("_list"),
        )
        .select(
            *scope,
            "schema_name",
            "table_name",
            "n_columns",
            F.concat(F.col("label"), F.lit(": "), F.col("_list")).alias("line"),
        )
    )


def roster_text(lines: DataFrame, key: str, budget: int = 0) -> DataFrame:
    """Roster block per ``key``: all its lines by schema and table, framed."""
    pieces = lines.select(
        key,
        F.struct("schema_name", "table_name").alias("part"),
        F.concat("line", F.lit("\n")).alias("text"),
    )
    texts = budgeted_text(pieces, key, "part", "text", budget)
    body = F.rtrim(F.col("head"), F.lit("\n"))
    return texts.select(
        key, F.concat(F.lit(ROSTER_HEAD), body, F.lit(ROSTER_TAIL)).alias("roster")
    )
