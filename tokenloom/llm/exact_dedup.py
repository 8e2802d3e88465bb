"""Exact dedup by distributed MSD radix partitioning.

Documents are split recursively by successive bytes. A digit of a round is the
next ``WIDTHS[r]`` bytes of a text; the first round also splits by the number
of bytes, so that texts of one group end together. A round counts the rows of
each (group, digit), partly before anything moves, and names those that have
more than one; groups of one row leave. Names are numbers given to the table of
groups, which needs no digest and no distinct ids: two texts are equal exactly
if they stay together until they end.

The first round counts sizes and first digits alone. Texts move when their first
digit isn't unique: the table of such digits is broadcast if its bytes, measured,
are at most ``BROADCAST_BYTES``, and then the scan itself leaves all other texts
where they are. If it is larger, rows are shuffled to it, but for groups of more
than ``HOT_ROWS`` rows. Those are few, and are broadcast, so that no task gets
all rows of a hot group.

Cases: rows with a null text or a null id have no equal and aren't reported.
Empty texts are equal to each other. Ids may be of any type with an order. Rows
that repeat id and text are copies of each other (reported as ``duplicate_of``
their own id). Rows that share an id but not the text are told apart by their
texts in :func:`drop_exact`. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import _shared as S

#: Bytes of a round's digit; beyond the last, each round takes four times the one before until all texts have ended.
WIDTHS = (64, 2_048, 65_536, 1_048_576)
BROADCAST_BYTES = 32 << 20
HOT_ROWS = 1_000_000


def _groups(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """A written table of the groups that have more than one row, each with a ``name``, its rows ``n`` and its ``least`` id."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).where("n > 1")
    return S.written(counted.withColumn("name", F.monotonically_increasing_id()), name)


def members(rows: DataFrame, groups: DataFrame, keys: list[str], texts: list[str], *, most: int = BROADCAST_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined to the table of their groups by ``keys``; ``texts`` are the columns of groups whose bytes count."""
    if S.bytes_of(groups, *texts)[1] <= most:
        return rows.join(F.broadcast(groups), keys)
    while S.bytes_of(groups.where(F.col("n") > hot_rows), *texts)[1] > most:
        hot_rows *= 4
    hot, rest = groups.where(F.col("n") > hot_rows), groups.where(F.col("n") <= hot_rows)
    if hot.isEmpty():
        return rows.join(groups, keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(cold.join(rest, keys))


def equal_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", widths: tuple[int, ...] = WIDTHS, most: int = BROADCAST_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(id, turn, name, least)`` for each row whose text another row has too; rows have one ``turn`` and ``name`` exactly if they have one text, and ``least`` is its smallest id."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("bytes")).where("id is not null and bytes is not null")
    rows = base.select("id", F.octet_length("bytes").alias("size"), F.substring("bytes", 1, widths[0]).alias("digit"))
    groups = _groups(rows, ["size", "digit"], "radix")

    def ended(table: DataFrame, turn: int) -> DataFrame:
        return S.written(table.select("id", F.lit(turn).alias("turn"), "name", "least"), "radix-ended")

    first = F.col("size") <= widths[0]
    done = ended(members(rows.where(first), groups.where(first), ["size", "digit"], ["digit"], most=most, hot_rows=hot_rows), 0)
    longer = base.withColumns({"size": F.octet_length("bytes"), "digit": F.substring("bytes", 1, widths[0])}).where(~first)
    met = members(longer, groups.where(~first), ["size", "digit"], ["digit"], most=most, hot_rows=hot_rows)
    rest = S.written(met.select("id", F.col("name").alias("parent"), F.expr(f"substring(bytes, {widths[0] + 1})").alias("rest")), "radix-rest")
    S.drop_written(spark, groups)
    turn = 1
    while not rest.isEmpty():
        width = widths[turn] if turn < len(widths) else widths[-1] * 4 ** (turn - len(widths) + 1)
        digits = rest.select("id", "parent", F.substring("rest", 1, width).alias("digit"))
        groups = _groups(digits, ["parent", "digit"], "radix")
        over = F.octet_length("rest") <= width
        done = done.unionByName(ended(members(digits.where(over), groups, ["parent", "digit"], ["digit"], most=most, hot_rows=hot_rows), turn))
        more = rest.where(~over).withColumn("digit", F.substring("rest", 1, width))
        met = members(more, groups, ["parent", "digit"], ["digit"], most=most, hot_rows=hot_rows)
        following = S.written(met.select("id", F.col("name").alias("parent"), F.expr(f"substring(rest, {width + 1})").alias("rest")), "radix-rest")
        S.drop_written(spark, groups, rest)
        rest, turn = following, turn + 1
    S.drop_written(spark, rest)
    return done


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", widths: tuple[int, ...] = WIDTHS, most: int = BROADCAST_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(doc_id, duplicate_of)`` of every row but one of each group of equal texts; ``duplicate_of`` is the smallest id of the group, which stays."""
    found = equal_groups(docs, id_col=id_col, text_col=text_col, widths=widths, most=most, hot_rows=hot_rows)
    copies = found.where("id <> least").select("id", "least")
    again = found.where("id = least").groupBy("turn", "name", "id", "least").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # n - 1 rows, through two lists of limited length
    block = 1 << 20
    again = again.select("id", "least", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 2) / block).cast("int"))).alias("b"))
    again = again.select("id", "least", F.explode(F.sequence(F.lit(1), F.least(F.lit(block), F.col("n") - 1 - F.col("b") * block).cast("int"))).alias("k"))
    return copies.unionByName(again.select("id", "least")).select(F.col("id").alias(id_col), F.col("least").alias("duplicate_of"))


def drop_exact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", widths: tuple[int, ...] = WIDTHS, most: int = BROADCAST_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``docs`` without the duplicates: of each text the row with the smallest id stays, once. Rows with a null id or text stay."""
    found = equal_groups(docs, id_col=id_col, text_col=text_col, widths=widths, most=most, hot_rows=hot_rows)
    name = S.free_name(docs, "_go")
    key = docs[id_col]
    copies = found.where("id <> least").select(F.col("id").alias(name)).distinct()
    stay = docs.join(copies, key == F.col(name), "left_anti")
    # ids of several rows: whether all of them go can't be told by the id
    ids = docs.select(key.alias("id")).where("id is not null")
    several = ids.join(found.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    if several.isEmpty():
        return stay
    around = found.join(found.join(several, "id", "left_semi").select("turn", "name").distinct(), ["turn", "name"], "left_semi")
    around = S.written(around.select(F.col("id").alias(name)).distinct(), "radix-around")  # all rows of a text are on one side of this
    met = docs.join(around, key == F.col(name), "left_semi")
    least = S.free_name(docs, "_least")
    one = met.where(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias(name)).agg(F.min(id_col).alias(least))
    kept = met.join(one, (F.col(text_col) == F.col(name)) & (F.col(id_col) == F.col(least)), "left_semi").dropDuplicates([id_col, text_col])
    return stay.join(around, stay[id_col] == around[name], "left_anti").unionByName(kept).unionByName(met.where(F.col(text_col).isNull()))
