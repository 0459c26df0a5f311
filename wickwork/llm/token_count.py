"""Token counts: batch encoding inside Arrow functions that return lengths only.

Texts are cut at safe boundaries (ASCII white space, see ``pieces``), long ones first into
segments, so that no call holds a whole long text's encoding; distinct pieces are encoded in
batches balanced by bytes and only their lengths are kept, in a bounded cache per worker.

Defined results: null and empty texts have 0 bytes and 0 tokens; ids may be null or repeat (one
output row per input row); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from wickwork.llm import pieces
from wickwork.llm.common import sliced


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 2048) -> DataFrame:
    """Per row: the id, ``n_bytes``, ``n_tokens`` and ``over_limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = pieces.load(path)
        tok.no_truncation()
        tok.no_padding()
        batched = pieces.Batches(tok)
        cache = pieces.PieceCache(lambda b: [len(ids) for ids in batched.ids(b)])
        for batch in sliced(batches):
            found = batch.column(1).to_pylist()
            n_bytes, n_tokens = [len((t or "").encode()) for t in found], [0] * len(found)
            for group in pieces.grouped(found):
                lengths = cache.load([p for _, p in group])
                for i, p in group:
                    n_tokens[i] += sum(map(lengths.__getitem__, p))
            n = pa.array(n_tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), n, pa.array([x > limit for x in n_tokens], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
