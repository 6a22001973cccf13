"""Token counts by rank-synchronous merging.

Texts are cut into chunks between white space, and chunks into the tokenizer's pre-tokens. A task remembers the symbols of
short chunks it has met, up to a bound in bytes; the pre-tokens of new chunks are gathered over many texts and merged together in ragged numpy arrays
(``word_bpe.Merges``), in each of them all pairs of lowest rank at once. The surviving symbols are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import whole_text
from gridlore.llm.word_bpe import Known

LIMIT = 2048


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for every row of ``docs``.

    Null and empty texts have no bytes and no tokens. Special strings inside a text are one token each, no others are
    added, and nothing is cut; long texts are read in blocks. Repeated rows are counted each for itself, and an empty table gives
    an empty result. Other columns are not read. ``path`` names a tokenizer file that every executor has.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(path)
        for b in batches:
            tokens = [len(ids) // 4 for ids in known.ids(t.as_py() for t in b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    rows = whole_text(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
