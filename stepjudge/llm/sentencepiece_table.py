"""SentencePiece encoding and decoding through a table of distinct marked words.

In a model whose pieces never hold a marker (U+2581) behind another character, no merge can cross the
start of a run of markers. So a text is cut there, each distinct marked word is segmented once per
task, and the ids are joined back by position. ``crossing_pieces`` tells whether a model allows it.

Null and empty texts have no ids and decode to the empty text. A text without white space is one
marked word, however long. Rows are independent: repeated rows give repeated results, and columns
other than the text column aren't looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from stepjudge.llm.common import slices, slices_of

MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*")
#: Distinct marked words held by a task; the table starts anew beyond it.
TABLE_WORDS = 200_000
ENCODE_WORDS, ENCODE_CHARS = 60_000, 1_000_000

DIGEST_TYPE = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


def crossing_pieces(processor) -> list[str]:
    """Pieces that hold a marker behind another character; must be empty."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    return [p for p in pieces if re.search(f"[^{MARK}]{MARK}", p)]


class ChunkTable:
    """ids, decoded text and token count of each distinct marked word seen so far."""

    def __init__(self, model_file: str, limit: int = TABLE_WORDS):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if bad := crossing_pieces(self.processor):
            raise ValueError(f"pieces cross white-space markers: {bad[:5]}")
        self.limit, self.lead = limit, self.processor.encode("a")
        self.ids: dict[str, list[int]] = {}
        self.text: dict[str, str] = {}
        self.joined: dict[str, str] = {}

    def words(self, text: str | None) -> list[str]:
        """The marked words of a text: the library puts a marker before it and in place of each space."""
        return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, words: set[str]) -> None:
        if len(self.ids) + len(words) > self.limit:
            self.ids, self.text, self.joined = {}, {}, {}
        new = [w for w in words if w not in self.ids]
        if not new:
            return
        # the library adds the first marker itself, but to no empty text: a lone marker is its own piece
        found = self.processor.encode([w[1:] for w in new], num_threads=1)
        found = [[self.processor.piece_to_id(MARK)] if w == MARK else ids for w, ids in zip(new, found, strict=True)]
        texts = self.processor.decode([self.lead + ids for ids in found], num_threads=1)
        for w, ids, text in zip(new, found, texts, strict=True):
            self.ids[w], self.text[w], self.joined[w] = ids, text[1:], ",".join(map(str, ids))

    def decoded(self, words: list[str]) -> str:
        return "".join(map(self.text.__getitem__, words))[1:]


def _rows(texts: pd.Series, table: ChunkTable) -> Iterator[list[str]]:
    for a, b in slices(texts, 2_000_000):
        rows = [table.words(t) for t in texts.iloc[a:b]]
        table.learn(set().union(*rows))
        yield from rows


def digests(text: str | Column, model_file: str) -> Column:
    """Struct of the token count and the digests of the ids and of the decoded text."""

    @F.pandas_udf(DIGEST_TYPE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = ChunkTable(model_file)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for texts in batches:
            out = [
                (sum(map(len, map(table.ids.__getitem__, row))), sha(",".join(map(table.joined.__getitem__, row))), sha(table.decoded(row)))
                for row in _rows(texts, table)
            ]
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"], dtype=object)

    return run(text)


def encoded(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """The documents with ``ids`` and ``decoded`` (which replace columns of these names).

    Rows leave a task in slices of ``ENCODE_CHARS`` characters and its table is small, so that a task
    holds little more than the batch it was given.
    """
    kept = [c for c in docs.columns if c.lower() not in ("ids", "decoded")]
    rows = docs.select(*kept)
    at = kept.index(next(c for c in kept if c.lower() == text.lower()))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute

        table = ChunkTable(model_file, ENCODE_WORDS)
        for batch in batches:
            size = pd.Series(pa.compute.fill_null(pa.compute.utf8_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
            for a, b in slices_of(size.to_numpy(dtype="int64"), ENCODE_CHARS):
                part = batch.slice(a, b - a)
                words = [table.words(t) for t in part.column(at).to_pylist()]
                table.learn(set().union(*words))
                ids = pa.array([[i for w in row for i in table.ids[w]] for row in words], type=pa.list_(pa.int32()))
                decoded = pa.array([table.decoded(row) for row in words], type=pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, ids, decoded], names=[*part.schema.names, "ids", "decoded"])

    schema = StructType([*rows.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
    return rows.mapInArrow(run, schema)
