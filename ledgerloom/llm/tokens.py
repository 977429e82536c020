"""Token counts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Block, blocks, small_batches, to_arrow
from .units import UnitCoder


def count_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Tokens of every whole text, as the library of a byte-level ``.json`` tokenizer counts them.

    Batches are balanced by bytes, not rows; texts are cut at places no token
    can reach over, and a unit met before is not encoded again. Only lengths
    leave the function. One row comes back per input row; a null or empty text
    has no bytes and no tokens; other columns of the input are not looked at.

    Returns doc_id, n_bytes, n_tokens, over_limit.
    """
    small_batches(df.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        coder = UnitCoder.at(tokenizer_path)
        for table in blocks(batches):
            block = Block(table["text"])
            doc, place = coder.encode(block)
            n_tokens = np.bincount(doc, weights=coder.counts[place], minlength=block.n).astype(np.int64)
            yield to_arrow(schema, {"doc_id": table["doc_id"].combine_chunks(), "n_bytes": np.diff(block.off), "n_tokens": n_tokens, "over_limit": n_tokens > limit})

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
