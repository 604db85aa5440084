"""Token counts by a public tokenizer library."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import bounded, safe_parts, slices

#: Bytes that the library gets in one call, about.
CALL_BYTES = 500_000
#: Longer texts are split at safe places, where the library allows it.
PART_CHARS = 50_000

_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    """The library's object for a vocabulary file; a worker process keeps it between tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already gives each task its core
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(path)
            made.no_truncation()
            made.no_padding()
            _loaded[path] = made
    return _loaded[path]


def lengths(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, without tokens added at its ends; special strings inside as the library's default."""
    made = _tokenizer(path)
    if path.endswith(".model"):
        return [len(ids) for ids in made.encode(texts, num_threads=1)]
    owner, parts = [], []
    for i, text in enumerate(texts):
        for part in safe_parts(text, PART_CHARS):
            owner.append(i)
            parts.append(part)
    counts = [0] * len(texts)
    for i, found in zip(owner, made.encode_batch_fast(parts, add_special_tokens=False)):
        counts[i] += len(found)
    return counts


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for each row; only lengths come back from the Arrow function.

    The library gets batches of about ``CALL_BYTES`` bytes, whatever the number of rows. A text without a safe
    place to split goes in one piece. A null counts as empty, with no tokens; repeated rows stay repeated; other
    columns are left out. ``path`` (``.json``: tokenizers, ``.model``: sentencepiece) is one that every worker reads.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CALL_BYTES):
                counts = lengths([t or "" for t in part.column("text").to_pylist()], path)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("n_bytes"), pa.array(counts, pa.int64())],
                    ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = bounded(docs).select(F.col(id_col).alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)
