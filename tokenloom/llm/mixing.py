"""Mixing sources to target weights by capped water-filling.

A source's size is the bytes of its texts. Target weights are given, or are the
sources' shares to the power ``temperature``. Each source gets its weight's
share of ``budget`` bytes. A source that would exceed ``max_epochs`` passes is
clamped there, and what it can't take is given to the others in proportion to
their weights, again and again until none exceeds; if all are clamped, less
than the budget is mixed. A source's amount divided by its size is its number of
epochs: every document is repeated the whole number of times, and the fraction
once more for the documents whose seeded hash of the id is below it.

Cases: rows with a null source are a source of their own. A null text counts as
empty; sources without bytes are kept once. Rows that repeat an id get the same
decision. A null id is hashed as the word null. Sources to which given weights
give nothing, or nothing positive, are left out. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm import _shared as S

TEMPERATURE = 0.7
MAX_EPOCHS = 4.0
SEED = 17


def water_fill(sizes: dict[object, float], weights: dict[object, float], budget: float, max_epochs: float) -> dict[object, float]:
    """Bytes of each source; sources without size or positive weight get none."""
    open_ = {s for s, n in sizes.items() if n > 0 and weights.get(s, 0) > 0}
    amounts = {s: 0.0 for s in sizes}
    left = float(budget)
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > max_epochs * sizes[s]}
        for s in over or open_:
            amounts[s] = max_epochs * sizes[s] if over else level * weights[s]
        if not over:
            break
        left -= sum(amounts[s] for s in over)
        open_ -= over
    return amounts


def source_epochs(
    docs: DataFrame, *, source_col: str = "source", text_col: str = "text", weights: dict[object, float] | None = None, temperature: float = TEMPERATURE, budget: float = 1.0, max_epochs: float = MAX_EPOCHS
) -> list[tuple[object, float, float]]:
    """``(source, bytes, epochs)`` of every source; ``budget`` is a multiple of the table's bytes."""
    rows = docs.groupBy(F.col(source_col).alias("s")).agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint")).alias("n")).collect()  # one row a source
    sizes = {r["s"]: float(r["n"]) for r in rows}
    total = sum(sizes.values())
    if weights is None:
        weights = {s: (n / total) ** temperature if n else 0.0 for s, n in sizes.items()}
        empty_once = {s for s, n in sizes.items() if not n}
    else:
        empty_once = {s for s, n in sizes.items() if not n and weights.get(s, 0) > 0}
    amounts = water_fill(sizes, weights, budget * total, max_epochs)
    return [(s, n, 1.0 if s in empty_once else amounts[s] / n if n else 0.0) for s, n in sizes.items()]


def repeat_by_epochs(docs: DataFrame, epochs: Iterable[tuple[object, float, float]], *, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED, copy_col: str | None = "copy") -> DataFrame:
    """Every document as often as its source's epochs say; ``copy_col`` counts from 1 (None leaves it out)."""
    epochs = list(epochs)
    spark = docs.sparkSession
    columns = docs.columns
    kind = docs.schema[source_col].dataType.simpleString()
    source, number = S.free_name(docs, "_source"), S.free_name(docs, "_epochs")
    table = spark.createDataFrame([(s, e) for s, _, e in epochs], f"{source} {kind}, {number} double")
    table = F.broadcast(table) if len(epochs) <= 10_000 else table
    share = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    whole = F.floor(F.col(number) + F.lit(1e-9))
    times = (whole + F.when(share < F.col(number) - whole, 1).otherwise(0)).cast("int")
    joined = docs.join(table, docs[source_col].eqNullSafe(F.col(source)))
    name = S.free_name(docs, copy_col or "copy")
    out = joined.where(times > 0).select(*[docs[c] for c in columns], F.explode(F.sequence(F.lit(1), times)).alias(name))
    return out if copy_col else out.drop(name)


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: dict[object, float] | None = None,
    temperature: float = TEMPERATURE,
    budget: float = 1.0,
    max_epochs: float = MAX_EPOCHS,
    seed: int = SEED,
    copy_col: str | None = "copy",
) -> DataFrame:
    """The mixture: rows of ``docs``, repeated or left out by their source's epochs."""
    epochs = source_epochs(docs, source_col=source_col, text_col=text_col, weights=weights, temperature=temperature, budget=budget, max_epochs=max_epochs)
    return repeat_by_epochs(docs, epochs, id_col=id_col, source_col=source_col, seed=seed, copy_col=copy_col)
