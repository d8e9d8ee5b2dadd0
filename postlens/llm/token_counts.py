"""Token counts without the tokens: Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from postlens.llm.common import text_bytes, text_slices
from postlens.llm.pieces import piece_tokenizer, tokenizer_path

TOKEN_LIMIT = 4096


def count_tokens(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", limit: int = TOKEN_LIMIT, batch_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    Batches hold about `batch_bytes` of text each, however many rows that is, so a batch of long texts costs no more than
    one of short texts. Texts are cut at spaces where no token can span the cut; equal pieces are encoded once a worker.
    Null and empty texts have no tokens. Rows that repeat are counted each. A null doc_id stays null. Other columns
    are not read. An empty table gives no rows."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_tokenizer(tokenizer_path(tokenizer))
        for batch, texts in text_slices(batches, limit=batch_bytes, keep_held=True):
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(text_bytes(texts)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select("doc_id", "text").mapInArrow(lengths, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
