"""Grading of result tables against reference tables.

Tables come as ``tables`` (one row per table) and ``cells`` (one row per non-NULL value):

* ``tables``: instance_id, variant, n_rows, n_cols, readable
* ``cells``:  instance_id, variant, col_idx, row_idx, num, txt, is_truth

``num`` is the numeric reading of a value and ``txt`` its exact text; a value from a typed
numeric column has no text and one from a typed text column no number. NULLs are absent:
they follow from the row count.

Rules. A gold column is satisfied when any predicted column holds the same values in the
same places: numbers within tolerance, texts exactly, NULL with NULL. Names are never read,
extra predicted columns never harm, and one predicted column may serve several gold columns.
With order ignored each column is sorted on its own, numbers by value. A gold table matches
when all its chosen columns are satisfied, an instance when any of its gold tables matches.

Plan. Instances whose tables are small meet whole: the rows of both sides are shuffled once, by
instance, and columns, pairs of columns and verdicts are made in the same tasks.

In the others one pass over the cells, pre-aggregated before any shuffle, gives one row per
column: counts, extremes, sums and two 128-bit content fingerprints (with and without positions).
Text columns and identical numeric columns are settled by fingerprint alone. Only numeric
columns that are close in every statistic yet not identical go back to their cells, once per
distinct content: a column of few values as one sorted array, any other by joins on row or
rank that spread it over many tasks.

Cells of typed tables may also come as ``rows_of`` gives them, one row per row of a table: less is
shuffled that way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import numbers as N
from plumbline.operators.ordered import carry_forward, running_total
from plumbline.session import shared_folder

KEY = ["instance_id", "variant", "col_idx"]
CELL_COLUMNS = [*KEY, "row_idx", "num", "txt", "is_truth"]
TABLE_COLUMNS = ["instance_id", "variant", "n_rows", "n_cols", "readable"]
CELL_SALTS = 16
# Values up to which a column may be one array in one task.
SMALL_COLUMN = 10_000
# Column pairs, of some 100 bytes each, up to which their columns are broadcast.
BROADCAST_PAIRS = 200_000
# Pairs of a gold and a predicted column up to which an instance may be compared in one task.
SMALL_PAIRS = 4096
# Cells of both sides up to which that is done.
SMALL_CELLS = 1_000_000
# Cells of one side that a task is given, where there are many.
TASK_CELLS = 4_000_000

# States of an instance and the kinds and messages of failure records.
CORRECT = "correct"
WRONG = "wrong_result"
BROKEN = "execution_error"
MISSING = "missing"
MISSING_GOLD = "missing_gold"
NO_PREDICTION = "No prediction CSV found"
UNREADABLE = "Could not read prediction CSV: "


# ---------------------------------------------------------------------------- tables


def rows_of(
    df: DataFrame, instance: str, row: str, columns: list[str], variant: str | None = None
) -> DataFrame:
    """Rows of typed tables kept side by side in one DataFrame, one table per instance; the
    values in columns named by their positions."""
    return df.select(
        F.col(instance).cast("string").alias("instance_id"),
        (F.col(variant).cast("int") if variant else F.lit(0)).alias("variant"),
        F.col(row).cast("long").alias("row_idx"),
        *[F.col(c).alias(str(i)) for i, c in enumerate(columns)],
    )


def _cells_of_rows(rows: DataFrame) -> DataFrame:
    """Cells of ``rows_of``; cells stay as they are."""
    if "col_idx" in rows.columns:
        return rows
    kinds = dict(rows.dtypes)

    def cell(name: str) -> Column:
        value, kind = F.col(f"`{name}`"), kinds[name]
        numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double")
        numeric = numeric or kind.startswith("decimal") or kind == "boolean"
        number = value.cast("int").cast("double") if kind == "boolean" else value.cast("double")
        if kind in ("float", "double"):
            number = F.when(~F.isnan(value), number)
        return F.struct(
            F.lit(int(name)).alias("col_idx"),
            (number if numeric else F.lit(None).cast("double")).alias("num"),
            (F.lit(None).cast("string") if numeric else value.cast("string")).alias("txt"),
            F.lit(kind == "boolean").alias("is_truth"),
        )

    names = [c for c in rows.columns if c not in ("instance_id", "variant", "row_idx")]
    spread = rows.select(
        "instance_id", "variant", "row_idx", F.explode(F.array(*map(cell, names))).alias("_c")
    )
    found = spread.filter(F.col("_c.num").isNotNull() | F.col("_c.txt").isNotNull())
    return found.select(
        "instance_id", "variant", "_c.col_idx", "row_idx", "_c.num", "_c.txt", "_c.is_truth"
    )


def cells_of(
    df: DataFrame, instance: str, row: str, columns: list[str], variant: str | None = None
) -> DataFrame:
    """Cells of typed tables kept side by side in one DataFrame, one table per instance."""
    return _cells_of_rows(rows_of(df, instance, row, columns, variant))


def cells_of_text(raw: DataFrame) -> DataFrame:
    """Cells of untyped tables (``raw`` holds the text of each value, as from CSV)."""
    text = F.col("raw")
    return raw.filter(text.isNotNull() & ~text.isin(N.NULL_TEXTS)).select(
        "instance_id",
        "variant",
        "col_idx",
        "row_idx",
        N.number_of_text(text).alias("num"),
        text.alias("txt"),
        N.is_truth_text(text).alias("is_truth"),
    )


def tables_of(
    df: DataFrame, instance: str, columns: list[str], variant: str | None = None
) -> DataFrame:
    """Table rows for ``cells_of``."""
    return (
        df.groupBy(
            F.col(instance).cast("string").alias("instance_id"),
            (F.col(variant).cast("int") if variant else F.lit(0)).alias("variant"),
        )
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumns({"n_cols": F.lit(len(columns)), "readable": F.lit(True)})
    )


# --------------------------------------------------------------------------- columns


_STATS = ["low", "high", "n_finite", "total", "weight"]


def _placed_print(name: str, value: str) -> list[Column]:
    """Two 64-bit hashes of values with their rows. A row occurs once, so XOR loses nothing."""
    return [
        F.expr(f"bit_xor(xxhash64({seed}, row_idx, {value}))").alias(f"{name}{seed}")
        for seed in (0, 1)
    ]


def _loose_print(name: str, value: str) -> list[Column]:
    """The same without rows. Values repeat, so one hash is summed, in thirds that leave room
    for 10^12 copies of one value; the XOR of the other tells which values are odd in number."""
    hashed = f"xxhash64(0, {value})"
    thirds = [f"{hashed} & 2097151", f"shiftright({hashed}, 21) & 2097151"]
    thirds.append(f"shiftrightunsigned({hashed}, 42)")
    return [
        *[F.expr(f"sum({third})").alias(f"{name}{i}") for i, third in enumerate(thirds)],
        F.expr(f"bit_xor(xxhash64(1, {value}))").alias(f"{name}3"),
    ]


_KIND = (
    "CASE WHEN n_values = 0 THEN 'any' "
    "WHEN n_numbers = n_values AND n_truths IN (0, n_values) THEN 'number' ELSE 'text' END"
)


def _summary(cells: DataFrame, key: list[str], *more: Column) -> DataFrame:
    """Counts, extremes, sums and fingerprints of every column with a value."""
    value = F.col("num") + F.lit(0.0)  # -0.0 and 0.0 read the same
    finite = F.when(N.is_finite(value), value)
    return cells.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_values"),
        F.count("num").alias("n_numbers"),
        F.count_if("is_truth").alias("n_truths"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.count(finite).alias("n_finite"),
        F.sum(finite).alias("total"),
        F.sum(F.abs(finite)).alias("weight"),
        *_placed_print("np", "num + 0D"),
        *_placed_print("tp", "txt"),
        *_loose_print("nv", "num + 0D"),
        *_loose_print("tv", "txt"),
        *more,
    )


def column_facts(tables: DataFrame, cells: DataFrame, *side: str) -> DataFrame:
    """One row per column of every readable table, with all that pruning needs.

    ``side`` names further key columns, such as the one that tells gold from prediction.
    """
    key = [*side, *KEY]
    summary = _summary(cells, key)
    columns = tables.filter("readable AND n_cols > 0").select(
        *side,
        "instance_id",
        "variant",
        F.col("n_rows").cast("long").alias("n_rows"),
        F.col("n_cols").cast("int").alias("n_cols"),
        F.explode(F.sequence(F.lit(0), F.col("n_cols").cast("int") - 1)).alias("col_idx"),
    )
    facts = columns.join(summary, key, "left").withColumn(
        "n_values", F.coalesce("n_values", F.lit(0))
    )

    def content(number: str, text: str, parts: int) -> Column:
        numbers, texts = (", ".join(f"{p}{i}" for i in range(parts)) for p in (number, text))
        return F.expr(
            f"CASE kind WHEN 'any' THEN '' WHEN 'number' THEN concat_ws(':', {numbers}) "
            f"ELSE concat_ws(':', {texts}) END"
        )

    return facts.withColumn("kind", F.expr(_KIND)).select(
        *key,
        "n_rows",
        "n_cols",
        "n_values",
        "kind",
        *_STATS,
        content("np", "tp", 2).alias("placed"),
        content("nv", "tv", 4).alias("loose"),
    )


def _is_list(part: Column) -> Column:
    return F.coalesce(part.startswith("["), F.lit(False))


def normal_conditions(raw: Column) -> Column:
    """``condition_cols`` as written -> struct of ``per_gold`` and ``choices``.

    ``[]``, ``[[]]``, ``[null]`` and absent give no choices: all columns are compared. A list
    of lists gives one choice per gold table. A flat list is one choice that holds for every
    gold table, also when there is only one.
    """
    parts = F.from_json(raw, "array<string>")
    given = F.filter(parts, lambda p: p.isNotNull() & (p != "[]"))
    lists = F.transform(
        parts, lambda p: F.coalesce(F.from_json(p, "array<int>"), F.array().cast("array<int>"))
    )
    numbers = F.transform(
        F.filter(parts, lambda p: p.isNotNull()), lambda p: p.try_cast("int")
    )
    nested = F.forall(parts, _is_list)
    choices = (
        F.when(parts.isNull() | (F.size(given) == 0), F.array().cast("array<array<int>>"))
        .when(nested, lists)
        .otherwise(F.array(numbers))
    )
    return F.struct(F.coalesce(nested, F.lit(True)).alias("per_gold"), choices.alias("choices"))


def _rules(standards: DataFrame) -> DataFrame:
    return standards.select(
        "instance_id",
        F.coalesce("ignore_order", F.lit(False)).alias("ignore_order"),
        normal_conditions(F.col("condition_cols_raw")).alias("rule"),
    )


# Positions a gold table must show, from its variant and ``rule``; empty means all. Negative
# positions count from the end. Gold tables beyond the given sublists are compared on all
# columns, and a position the table does not have can never be satisfied.
_WANTED = (
    "array_distinct(transform(coalesce(get(rule.choices, IF(rule.per_gold, variant, 0)), "
    "CAST(array() AS array<int>)), c -> IF(c < 0, c + n_cols, c)))"
)


def asked_columns(standards: DataFrame, gold_tables: DataFrame) -> DataFrame:
    """Number of columns each gold table asks for."""
    return (
        gold_tables.filter("readable")
        .join(_rules(standards), "instance_id")
        .withColumn("wanted", F.expr(_WANTED))
        .selectExpr(
            "instance_id", "variant", "IF(size(wanted) = 0, n_cols, size(wanted)) AS n_asked"
        )
    )


# ------------------------------------------------------------------------- comparison

_SHAPE = ["instance_id", "ignore_order", "n_rows", "n_values", "kind", "content"]
# A column is named by variant and position in one number.
_COLUMN = "CAST(variant AS BIGINT) * 1048576 + col_idx"


def column_contents(
    standards: DataFrame, tables: DataFrame, cells: DataFrame
) -> DataFrame:
    """One row per distinct column content of an instance, both sides together.

    ``g`` and ``p`` name a gold and a predicted column that hold it, NULL where that side has
    none, and ``columns`` all the gold columns that hold it and must be satisfied. Columns of
    equal content are settled here, and copies of a column are looked at once.
    """
    facts = column_facts(tables, cells, "side").join(_rules(standards), "instance_id")
    content = F.expr("CASE WHEN ignore_order THEN loose ELSE placed END")
    needed = facts.withColumn("content", content).withColumn("wanted", F.expr(_WANTED)).filter(
        "side = 'p' OR size(wanted) = 0 OR array_contains(wanted, col_idx)"
    )
    return needed.groupBy(*_SHAPE).agg(
        F.expr(f"min(IF(side = 'g', {_COLUMN}, NULL))").alias("g"),
        F.expr(f"min(IF(side = 'p', {_COLUMN}, NULL))").alias("p"),
        F.expr("collect_list(IF(side = 'g', struct(variant, col_idx), NULL))").alias("columns"),
        *[F.min(s).alias(s) for s in _STATS],
    )


def _near(stat: str, of_g: str = "g_", of_p: str = "p_") -> str:
    """Extremes that a match allows, at twice the tolerance to leave room for rounding."""
    g, p = f"{of_g}{stat}", f"{of_p}{stat}"
    return (
        f"({g} = {p} OR abs({g} - {p}) <= 2 * greatest({N.ABSOLUTE_TOLERANCE}D, "
        f"{N.RELATIVE_TOLERANCE}D * greatest(abs({g}), abs({p}))))"
    )


def _band(x: str) -> str:
    """Number of the band of a value: values that ``_near`` allows are in the same band or in
    neighbouring ones.

    Bands are as wide as the tolerance: even ones where the absolute tolerance rules, ones of
    equal ratio beyond. Missing values have no band; infinite ones have the outermost.
    """
    turn = N.ABSOLUTE_TOLERANCE / N.RELATIVE_TOLERANCE
    # Twice the tolerance, as in ``_near``, and a tenth more against rounding.
    even, ratio = 2.2 * N.ABSOLUTE_TOLERANCE, 2.2 * N.RELATIVE_TOLERANCE
    size = (
        f"least(abs({x}), {turn!r}D) / {even!r}D "
        f"+ ln(greatest(abs({x}) / {turn!r}D, 1D)) / {ratio!r}D"
    )
    return f"floor(greatest(least(signum({x}) * ({size}), 4E18D), -4E18D))"


def _met(gold: DataFrame, pred: DataFrame, on: list[str]) -> DataFrame:
    """Gold and predicted columns of equal keys whose extremes are in the same or neighbouring
    bands."""
    for stat in ("low", "high"):
        around = f"transform(array(-1L, 0L, 1L), d -> {_band(f'g_{stat}')} + d)"
        gold = gold.withColumn(f"{stat}_band", F.explode(F.expr(around)))
        pred = pred.withColumn(f"{stat}_band", F.expr(_band(f"p_{stat}")))
    return gold.join(pred, [*on, "low_band", "high_band"])


def _candidates(contents: DataFrame) -> DataFrame:
    """Numeric column pairs that differ but whose statistics allow a match.

    Every test is necessary for a match, with slack for rounding, so none is lost. Columns meet
    by the bands of both extremes, each gold column in its own and the neighbouring ones.
    """
    on = ["instance_id", "ignore_order", "n_rows", "n_values"]
    numbers = contents.filter("kind = 'number'")

    def side(name: str, rows: DataFrame) -> DataFrame:
        return rows.select(*on, name, *[F.col(s).alias(f"{name}_{s}") for s in _STATS])

    open_gold = side("g", numbers.filter("g IS NOT NULL AND p IS NULL"))
    weight = "(g_weight + p_weight)"
    slack = (
        f"g_n_finite * {2 * N.ABSOLUTE_TOLERANCE}D + {weight} * {2 * N.RELATIVE_TOLERANCE}D "
        f"+ {weight} * g_n_finite * 2.3E-16D"
    )
    pred = side("p", numbers.filter("p IS NOT NULL"))
    return (
        _met(open_gold, pred, on)
        .filter(
            f"{_near('low')} AND {_near('high')} AND g_n_finite = p_n_finite "
            f"AND (g_n_finite = 0 OR abs(g_total - p_total) <= {slack})"
        )
        .select("instance_id", "ignore_order", "n_values", "g", "p")
    )


class _Cells:
    """Cells of one side, and how the columns asked for are brought to them."""

    def __init__(self, cells: DataFrame, side: str, few: bool):
        self.cells, self.side, self.few = cells, side, few

    def pick(self, pairs: DataFrame) -> DataFrame:
        """Numeric cells of this side's columns in the pairs.

        Few columns are broadcast; their number was counted before. More are joined with a
        salt by row, so that the cells of one heavy column meet in many tasks.
        """
        side = self.side
        columns = pairs.select("instance_id", "ignore_order", side).distinct()
        values = self.cells.filter("num IS NOT NULL").selectExpr(
            "instance_id", f"{_COLUMN} AS {side}", "row_idx", "num AS value"
        )
        if self.few:
            return values.join(F.broadcast(columns), ["instance_id", side])
        salt = F.expr(f"CAST(pmod(xxhash64(row_idx), {CELL_SALTS}) AS INT)")
        salts = F.explode(F.sequence(F.lit(0), F.lit(CELL_SALTS - 1))).alias("_salt")
        return (
            values.withColumn("_salt", salt)
            .join(columns.select("*", salts), ["instance_id", side, "_salt"])
            .drop("_salt")
        )


def _verify_small(pairs: DataFrame, gold: _Cells, pred: _Cells) -> DataFrame:
    """Pairs of columns of at most ``SMALL_COLUMN`` values: each column is one sorted array.

    With order ignored the place is 0 for all values, so they are sorted by value alone.
    """

    def arrays(cells: _Cells) -> DataFrame:
        side = cells.side
        place = F.expr("CASE WHEN ignore_order THEN 0L ELSE row_idx END").alias("place")
        listed = F.sort_array(F.collect_list(F.struct(place, "value")))
        return (
            cells.pick(pairs)
            .groupBy("instance_id", side)
            .agg(listed.alias(f"{side}_values"))
        )

    close = N.close_sql("x.value", "y.value")
    fits = (
        "forall(zip_with(g_values, p_values, (x, y) -> "
        f"coalesce(x.place = y.place AND {close}, false)), fit -> fit)"
    )
    return (
        pairs.select("instance_id", "g", "p")
        .join(arrays(gold), ["instance_id", "g"])
        .join(arrays(pred), ["instance_id", "p"])
        .filter(fits)
        .select("instance_id", "g")
    )


def _verify_placed(pairs: DataFrame, gold: _Cells, pred: _Cells) -> DataFrame:
    """Pairs whose values are close row by row. The join keys hold the row, so they spread."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(CELL_SALTS - 1))).alias("_salt")
    left = gold.pick(pairs).selectExpr(
        "instance_id", "g", "row_idx", "value AS a",
        f"CAST(pmod(xxhash64(row_idx), {CELL_SALTS}) AS INT) AS _salt",
    )
    right = pred.pick(pairs).selectExpr("instance_id", "p", "row_idx", "value AS b")
    named = pairs.select("instance_id", "g", "p", "n_values", salts)
    return (
        left.join(named, ["instance_id", "g", "_salt"])
        .drop("_salt")
        .join(right, ["instance_id", "p", "row_idx"])
        .groupBy("instance_id", "g", "p", "n_values")
        .agg(F.count_if(F.expr(N.close_sql("a", "b"))).alias("n_close"))
        .filter("n_close = n_values")
        .select("instance_id", "g")
    )


def _rank_starts(cells: _Cells, pairs: DataFrame, value: str) -> DataFrame:
    """Distinct values of each column, in order, with the first rank each one holds.

    Equal values are counted before anything is sorted, so a value held by most rows is one
    row here; the ranks come from a running total that spreads heavy columns.
    """
    key = ["instance_id", cells.side]
    counted = cells.pick(pairs).groupBy(*key, "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_total(counted, key, ["value"], "n", "last")
    return ranked.select(*key, F.col("value").alias(value), F.expr("last - n + 1").alias("start"))


def _verify_loose(pairs: DataFrame, gold: _Cells, pred: _Cells) -> DataFrame:
    """Pairs whose values are close rank by rank.

    A sorted column changes its value only at the ranks where a new value starts. At each such
    rank of either column the values both hold there are compared, so the work grows with the
    distinct values.
    """
    names = pairs.select("instance_id", "g", "p")
    none = F.lit(None).cast("double")
    left = names.join(_rank_starts(gold, pairs, "a"), ["instance_id", "g"]).withColumn("b", none)
    right = names.join(_rank_starts(pred, pairs, "b"), ["instance_id", "p"]).withColumn("a", none)
    pair = ["instance_id", "g", "p"]
    starts = (
        left.unionByName(right)
        .groupBy(*pair, "start")
        .agg(F.max("a").alias("a"), F.max("b").alias("b"))
    )
    return (
        carry_forward(starts, pair, ["start"], ["a", "b"])
        .groupBy(*pair)
        .agg(F.bool_and(F.expr(N.close_sql("a", "b"))).alias("fits"))
        .filter("fits")
        .select("instance_id", "g")
    )


def _verify(pairs: DataFrame, gold_cells: DataFrame, pred_cells: DataFrame) -> DataFrame | None:
    """(instance_id, g) of the pairs that hold; None when there is nothing to look at.

    The number of values of every column is known, which tells small columns from large.
    """
    small = F.col("n_values") <= SMALL_COLUMN
    loose = F.col("ignore_order")
    routes = [
        (small, _verify_small),
        (~small & ~loose, _verify_placed),
        (~small & loose, _verify_loose),
    ]
    counts = pairs.agg(*[F.count_if(test) for test, _ in routes]).first()
    verified = []
    for (test, verify), count in zip(routes, counts):
        if count:
            few = count <= BROADCAST_PAIRS
            gold, pred = _Cells(gold_cells, "g", few), _Cells(pred_cells, "p", few)
            verified.append(verify(pairs.filter(test), gold, pred))
    return reduce(DataFrame.unionByName, verified).distinct() if verified else None


def _both_sides(gold: DataFrame, pred: DataFrame, columns: list[str]) -> DataFrame:
    gold = gold.select(F.lit("g").alias("side"), *columns)
    return gold.unionByName(pred.select(F.lit("p").alias("side"), *columns))


def _with_error(pred_tables: DataFrame) -> DataFrame:
    if "read_error" in pred_tables.columns:
        return pred_tables
    return pred_tables.withColumn("read_error", F.lit(None).cast("string"))


def _all_tables(gold_tables: DataFrame, pred_tables: DataFrame) -> DataFrame:
    """One row per table of both sides, kept in the shared folder for the later steps."""
    shared_folder(gold_tables.sparkSession)
    gold = gold_tables.withColumn("read_error", F.lit(None).cast("string"))
    columns = [*TABLE_COLUMNS, "read_error"]
    return _both_sides(gold, _with_error(pred_tables), columns).checkpoint()


def _in_one_task(standards: DataFrame, sides: DataFrame, pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Verdicts of instances with small tables, whose rows are brought together once.

    ``sides``: the readable tables of each instance. All steps are keyed by the instance alone,
    so nothing is shuffled after the rows.
    """

    def columns(side: str, cells: DataFrame) -> DataFrame:
        value = F.struct(F.col("row_idx").alias("place"), (F.col("num") + F.lit(0.0)).alias("value"))
        facts = _summary(
            _cells_of_rows(cells),
            KEY,
            F.collect_list(F.when(F.col("num").isNotNull(), value)).alias("numbers"),
        ).withColumn("kind", F.expr(_KIND))

        def content(number: str, text: str, parts: int) -> Column:
            numbers, texts = ([f"{p}{i}" for i in range(parts)] for p in (number, text))
            prints = [F.expr(f"IF(kind = 'number', {n}, {t})") for n, t in zip(numbers, texts)]
            return F.array(*prints)

        numbers = F.expr("IF(kind = 'number', numbers, filter(numbers, x -> false))")
        column = F.struct(
            "variant",
            "col_idx",
            "n_values",
            "kind",
            *["low", "high", "n_finite"],
            content("np", "tp", 2).alias("placed"),
            content("nv", "tv", 4).alias("loose"),
            numbers.alias("numbers"),
        )
        return facts.groupBy("instance_id").agg(F.collect_list(column).alias(side))

    def of_tables(side: str) -> str:
        """Columns with their table's rows, their contents and sorted numbers. With order
        ignored the place is 0 for all values, so they are sorted by value alone."""
        numbers = "IF(ignore_order, transform(c.numbers, v -> named_struct('place', 0L, 'value', v.value)), c.numbers)"
        return (
            f"flatten(transform({side}_tables, t -> transform(filter(coalesce({side}, array()), c -> "
            "c.variant = t.variant AND c.col_idx >= 0 AND c.col_idx < t.n_cols), c -> named_struct("
            "'variant', c.variant, 'col_idx', c.col_idx, 'n_rows', t.n_rows, 'n_values', c.n_values, "
            "'kind', c.kind, 'low', c.low, 'high', c.high, 'n_finite', c.n_finite, 'content', "
            f"IF(ignore_order, c.loose, c.placed), 'numbers', sort_array({numbers})))))"
        )

    close = N.close_sql("x.value", "y.value")
    fits = (
        "p.n_rows = q.n_rows AND p.n_values = q.n_values AND p.kind = q.kind AND (p.content = q.content "
        f"OR (q.kind = 'number' AND q.n_finite = p.n_finite AND {_near('low', 'q.', 'p.')} "
        f"AND {_near('high', 'q.', 'p.')} AND forall(zip_with(q.numbers, p.numbers, (x, y) -> "
        f"coalesce(x.place = y.place AND {close}, false)), fit -> fit)))"
    )
    # A column without a value is not among the columns: any other such column fits it.
    blank = (
        "exists(p_tables, t -> t.n_rows = n_rows AND "
        "size(filter(p_columns, c -> c.variant = t.variant)) < t.n_cols)"
    )
    found = "filter(g_columns, q -> q.variant = variant AND q.col_idx = i)"
    asked = "IF(size(wanted) > 0, wanted, filter(sequence(0, n_cols), i -> i < n_cols))"
    return (
        _rules(standards)
        .join(sides, "instance_id")
        .filter("size(p_tables) > 0 AND size(g_tables) > 0")
        .join(columns("g", gold), "instance_id", "left")
        .join(columns("p", pred), "instance_id", "left")
        .withColumns({"g_columns": F.expr(of_tables("g")), "p_columns": F.expr(of_tables("p"))})
        .select("instance_id", "rule", "g_columns", "p_columns", "p_tables", F.inline("g_tables"))
        .withColumn("wanted", F.expr(_WANTED))
        .selectExpr(
            "instance_id",
            "variant",
            f"coalesce(forall({asked}, i -> i >= 0 AND i < n_cols AND IF(size({found}) = 0, {blank}, "
            f"forall({found}, q -> exists(p_columns, p -> {fits})))), false) AS matched",
        )
    )


def _match(
    standards: DataFrame, tables: DataFrame, pred_cells: DataFrame, gold_cells: DataFrame
) -> DataFrame:
    """Instances with small tables are compared in one task each, all others in steps."""

    def listed(side: str) -> Column:
        table = F.struct("variant", "n_rows", F.col("n_cols").cast("int").alias("n_cols"))
        return F.collect_list(F.when(F.col("side") == side, table)).alias(f"{side}_tables")

    def total(side: str) -> Column:
        return F.sum(F.when(F.col("side") == side, F.col("n_cols")).otherwise(0))

    cells = F.sum(F.col("n_rows") * F.col("n_cols"))
    small = (F.max("n_rows") <= SMALL_COLUMN) & (total("g") * total("p") <= SMALL_PAIRS)
    small = F.coalesce(small & (cells <= SMALL_CELLS), F.lit(False))
    readable = tables.filter("readable")
    kinds = readable.groupBy("instance_id").agg(
        small.alias("small"), cells.alias("n_cells")
    )
    n_small, n_large, n_cells = kinds.agg(
        F.count_if("small"), F.count_if(~F.col("small")), F.sum(F.expr("IF(small, n_cells, 0)"))
    ).first()
    known = F.col("instance_id").isNotNull()
    pred_cells, gold_cells = pred_cells.filter(known), gold_cells.filter(known)
    if not n_small:
        return _in_steps(standards, tables, pred_cells, gold_cells)
    parts = -(-n_cells // (2 * TASK_CELLS))
    usual = int(tables.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own_number = [parts] if parts > usual else []
    sides = readable.groupBy("instance_id").agg(listed("g"), listed("p"))
    if not n_large:
        near = [c.repartition(*own_number, "instance_id") for c in (pred_cells, gold_cells)]
        return _in_one_task(standards, sides, *near)
    large = kinds.filter("NOT small").select("instance_id").checkpoint()
    if n_large <= BROADCAST_PAIRS:
        large = F.broadcast(large)

    def without(df: DataFrame) -> DataFrame:
        return df.join(large, "instance_id", "left_anti")

    def only(df: DataFrame) -> DataFrame:
        return df.join(large, "instance_id", "left_semi")

    near = [without(c).repartition(*own_number, "instance_id") for c in (pred_cells, gold_cells)]
    return _in_one_task(standards, without(sides), *near).unionByName(
        _in_steps(standards, *map(only, (tables, pred_cells, gold_cells)))
    )


def _in_steps(
    standards: DataFrame, tables: DataFrame, pred_cells: DataFrame, gold_cells: DataFrame
) -> DataFrame:
    """The contents of all columns are written to the shared folder once: they are small, and
    every later step starts from them instead of the cells."""
    gold_cells, pred_cells = _cells_of_rows(gold_cells), _cells_of_rows(pred_cells)
    cells = _both_sides(gold_cells, pred_cells, CELL_COLUMNS)
    contents = column_contents(standards, tables, cells).checkpoint()
    pairs = _candidates(contents).checkpoint()
    verified = _verify(pairs, gold_cells, pred_cells)

    settled = contents.filter("g IS NOT NULL AND p IS NOT NULL").select("instance_id", "columns")
    if verified is not None:
        more = contents.join(verified, ["instance_id", "g"]).select("instance_id", "columns")
        settled = settled.unionByName(more)
    found = (
        settled.select("instance_id", F.inline("columns"))
        .groupBy("instance_id", "variant")
        .agg(F.count(F.lit(1)).alias("n_fit"))
    )
    predicted = tables.filter("side = 'p' AND readable").select("instance_id")
    return (
        asked_columns(standards, tables.filter("side = 'g'"))
        .join(predicted, "instance_id", "left_semi")
        .join(found, ["instance_id", "variant"], "left")
        .selectExpr("instance_id", "variant", "coalesce(n_fit, 0) = n_asked AS matched")
    )


def match_golds(
    standards: DataFrame,
    pred_tables: DataFrame,
    pred_cells: DataFrame,
    gold_tables: DataFrame,
    gold_cells: DataFrame,
) -> DataFrame:
    """(instance_id, variant, matched) for every gold table of a graded instance."""
    return _match(standards, _all_tables(gold_tables, pred_tables), pred_cells, gold_cells)


def grade(
    standards: DataFrame,
    pred_tables: DataFrame,
    pred_cells: DataFrame,
    gold_tables: DataFrame,
    gold_cells: DataFrame,
) -> DataFrame:
    """One row per standard: its status, and the shapes of both tables.

    ``pred_tables`` may carry ``read_error``, the reason a prediction could not be read.
    """
    tables = _all_tables(gold_tables, pred_tables)
    matched = (
        _match(standards, tables, pred_cells, gold_cells)
        .groupBy("instance_id")
        .agg(F.bool_or("matched").alias("matched"))
    )
    shapes = tables.groupBy("instance_id").agg(
        F.bool_or(F.expr("IF(side = 'p', readable, NULL)")).alias("readable"),
        F.max("read_error").alias("read_error"),
        F.max(F.expr("IF(side = 'p', struct(n_rows, n_cols), NULL)")).alias("pred"),
        F.min(F.expr("IF(side = 'g' AND readable, struct(variant, n_rows, n_cols), NULL)")).alias(
            "gold"
        ),
    )
    status = (
        F.when(F.col("readable").isNull(), MISSING)
        .when(~F.col("readable"), BROKEN)
        .when(F.col("gold").isNull(), MISSING_GOLD)
        .when(F.coalesce("matched", F.lit(False)), CORRECT)
        .otherwise(WRONG)
    )
    return (
        standards.select("instance_id")
        .join(shapes, "instance_id", "left")
        .join(matched, "instance_id", "left")
        .select("instance_id", status.alias("status"), "read_error", "pred", "gold")
    )


# --------------------------------------------------------------------------- reports


def report(grades: DataFrame) -> DataFrame:
    """One row of counts. ``missing`` holds missing predictions and missing golds alike;
    ``accuracy`` is over all standards, ``accuracy_evaluated`` over the compared ones."""

    def count(*states: str) -> Column:
        return F.count_if(F.col("status").isin(*states))

    correct, wrong = count(CORRECT), count(WRONG)
    total = F.count(F.lit(1))
    return grades.agg(
        total.alias("total"),
        correct.alias("correct"),
        wrong.alias("wrong_result"),
        count(BROKEN).alias("execution_error"),
        count(MISSING, MISSING_GOLD).alias("missing"),
        F.coalesce(F.try_divide(correct, total), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.try_divide(correct, correct + wrong), F.lit(0.0)).alias(
            "accuracy_evaluated"
        ),
    )


def per_instance(grades: DataFrame) -> DataFrame:
    """Status of every instance, by id."""
    return grades.select("instance_id", "status").orderBy("instance_id")


def failures(grades: DataFrame, sql_texts: DataFrame, questions: DataFrame) -> DataFrame:
    """One failure record per instance that is wrong, broken or without prediction.

    A missing prediction is recorded as an execution error; a missing gold is no failure.
    """
    failed = grades.filter(F.col("status").isin(WRONG, BROKEN, MISSING))
    message = (
        F.when(F.col("status") == MISSING, NO_PREDICTION)
        .when(F.col("status") == BROKEN, F.concat(F.lit(UNREADABLE), F.coalesce("read_error", F.lit(""))))
        .otherwise("")
    )
    details = F.when(
        F.col("status") == WRONG,
        F.format_string(
            "Result mismatch: pred shape=(%d, %d), gold shape=(%d, %d)",
            F.col("pred.n_rows"),
            F.col("pred.n_cols"),
            F.col("gold.n_rows"),
            F.col("gold.n_cols"),
        ),
    ).otherwise("")
    return (
        failed.join(sql_texts.select("instance_id", "sql"), "instance_id", "left")
        .join(questions.select("instance_id", "nlq"), "instance_id", "left")
        .select(
            "instance_id",
            F.when(F.col("status") == WRONG, WRONG).otherwise(BROKEN).alias("error_type"),
            F.coalesce("sql", F.lit("")).alias("sql"),
            message.alias("error_message"),
            details.alias("details"),
            F.coalesce("nlq", F.lit("")).alias("nlq"),
        )
    )


# Number of failures shown, and the layout of the digest.
DIGEST_SIZE = 20
DIGEST_SEPARATOR = "\n---\n"


def failure_digest(
    failed: DataFrame, size: int = DIGEST_SIZE, standards: DataFrame | None = None
) -> DataFrame:
    """One text with the first failures, for a reviewer: in the order of the standards (their
    ``pos``) where these are given, failures without one last; else by instance id."""
    place = F.lit(None).cast("bigint")
    if standards is not None:
        failed = failed.join(
            standards.groupBy("instance_id").agg(F.min("pos").alias("_place")), "instance_id", "left"
        )
        place = F.col("_place")
    place = F.coalesce(place, F.lit((1 << 63) - 1)).alias("place")
    block = F.concat(
        F.lit("Instance: "),
        F.col("instance_id"),
        F.lit("\nQuestion: "),
        F.col("nlq"),
        F.lit("\nError Type: "),
        F.col("error_type"),
        F.lit("\nSQL:\n"),
        F.col("sql"),
        F.lit("\nError/Details: "),
        F.when(F.col("error_message") != "", F.col("error_message")).otherwise(F.col("details")),
    )
    top = failed.select(place, "instance_id", block.alias("block"))
    top = top.orderBy("place", "instance_id").limit(size)
    ordered = F.sort_array(F.collect_list(F.struct("place", "instance_id", "block")))
    return top.agg(
        F.count(F.lit(1)).alias("n_failures"),
        F.array_join(F.transform(ordered, lambda r: r.block), DIGEST_SEPARATOR).alias("digest"),
    )


def profile(instances: DataFrame, tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Silent failures of executed queries: no rows, or rows without any value."""
    values = _cells_of_rows(cells).groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_values"))
    rows = tables.groupBy("instance_id").agg(F.max("n_rows").alias("n_rows"))
    counts = (
        instances.select("instance_id")
        .join(rows, "instance_id", "left")
        .join(values, "instance_id", "left")
        .select(
            "instance_id",
            F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
            F.coalesce("n_values", F.lit(0)).cast("long").alias("n_values"),
        )
    )
    kind = (
        F.when(F.col("n_rows") == 0, "empty_result")
        .when(F.col("n_values") == 0, "null_result")
        .otherwise("none")
    )
    return counts.withColumn("error_type", kind)
