"""Title pages through a vision model: a pluggable call, so that tests and replays need no network."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.functions.json_text import title_page


def stub(content: bytes) -> str:
    """Stands in for a model: it reads nothing."""
    return "{}"


def read_title_pages(images: DataFrame, model: Callable[[bytes], str] = stub, content: str = "content") -> DataFrame:
    """``images`` without their content, with the model's ``answer`` and ``ocr_output``, its fields as a
    struct, null where the answer can't be parsed."""

    @F.pandas_udf("string")
    def answer(contents):
        return contents.map(lambda c: model(bytes(c)))

    return images.withColumn("answer", answer(content)).withColumn("ocr_output", title_page(F.col("answer"))).drop(content)
