"""Token counts, prices and costs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import arrow_map

#: Dollars for a million input and output tokens.
PRICES = {"gpt-4o-mini": (0.15, 0.60), "gpt-4o": (2.50, 10.00), "claude-3-5-sonnet-20241022": (3.00, 15.00), "claude-3-5-haiku-20241022": (0.80, 4.00), "llama3": (0.0, 0.0), "mistral": (0.0, 0.0)}
#: The prices of any other model; a completion's share of its prompt; tokens of a summary and of the overview.
OTHER = (0.50, 1.50)
SHARE = 0.25
SUMMARY, OVERVIEW = 150, 800


def tokens(text: Column) -> Column:
    """About four characters to a token."""
    return F.floor(F.length(text) / 4).cast("long")


def count_tokens(text: str, tokenizer: Callable[[str], list] | None = None) -> int:
    """With a tokenizer's own count where one is given."""
    return len(tokenizer(text)) if tokenizer else len(text) // 4


def with_tokens(files: DataFrame, tokenizer: Callable[[str], list], text_col: str = "content") -> DataFrame:
    """Adds `tokens`, counted by a tokenizer in the tasks; null texts have none. The tokenizer travels to the workers, so it must be picklable: a function
    that loads a vocabulary when it is first called, say."""
    schema = T.StructType([*files.schema.fields, T.StructField("tokens", T.LongType())])
    place = files.columns.index(text_col)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            counts = [len(tokenizer(text)) if text else 0 for text in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, "tokens"])

    return arrow_map(files, batches, schema)


def price_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{m}', {a!r}D, {b!r}D)" for m, (a, b) in PRICES.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(model, input, output)")


def priced(models: DataFrame) -> DataFrame:
    """Adds the input and output price of column `model`. The price table has a fixed handful of rows."""
    found = models.join(F.broadcast(price_table(models.sparkSession)), "model", "left")
    return found.fillna({"input": OTHER[0], "output": OTHER[1]})


def dollars(input_tokens: Column, output_tokens: Column, model: str) -> Column:
    into, out = PRICES.get(model, OTHER)
    return input_tokens / F.lit(1e6) * F.lit(into) + output_tokens / F.lit(1e6) * F.lit(out)


def completion(input_tokens: Column, share: float = SHARE) -> Column:
    return (input_tokens * F.lit(share)).cast("long")


def cost(n: int, model: str, share: float = SHARE) -> tuple[float, int, int]:
    """(dollars, input tokens, output tokens) on the driver."""
    into, out = PRICES.get(model, OTHER)
    completed = int(n * share)
    return n / 1e6 * into + completed / 1e6 * out, n, completed


def shown(dollars_: float) -> str:
    """Five places below a cent, else two; rounds as Python does."""
    return f"${dollars_:.5f}" if dollars_ < 0.01 else f"${dollars_:.2f}"


def over_budget(dollars_: float, cents: int | None) -> bool:
    """Strictly above: a cost equal to the budget may run."""
    return cents is not None and dollars_ > cents / 100
