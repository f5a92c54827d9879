"""Encoding and decoding with a SentencePiece model through a table of distinct marked words.

Where no piece has the whitespace marker behind another character, no merge can cross from a word
into the marker that follows, so a text's ids are those of its marked words put together. A task
keeps a table of the distinct marked words it has met, has the library segment each once, and joins
ids and decoded words back by position.

Cases: null counts as an empty text; an empty text has no ids and decodes to an empty text; whole
texts are encoded however long; repeated rows stay; other columns are not read.
"""

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyfold.llm.common import kind

MARKER = "▁"
MARKED_WORD = re.compile(" +[^ ]*")
#: Entries of a task's table; a fuller one is begun anew, which costs time and changes no result.
TABLE_ENTRIES = 300_000
#: Texts encoded at a time.
ROWS = 500


@functools.lru_cache(1)
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    if any(MARKER in piece.lstrip(MARKER) for piece in pieces):
        raise ValueError("the model has pieces that cross whitespace markers")
    if model.encode("  a ", out_type=str)[-1:] != [MARKER] or model.decode(model.encode("  a\tﬁ ")) != "  a\tﬁ ":
        raise ValueError("the model changes white space or characters, or adds no marker in front")
    return model


class WordTable:
    """ids and decoded text of each marked word met so far."""

    def __init__(self, path: str):
        self.model = _model(path)
        self.entries = {}

    def learn(self, words: set) -> None:
        if len(self.entries) > TABLE_ENTRIES:
            self.entries = {}
        new = [word for word in words if word not in self.entries]
        # The library itself puts the first marker in front.
        for word, ids in zip(new, self.model.encode([word[1:] for word in new], num_threads=1), strict=True):
            ids = ids if len(word) > 1 else [self.model.piece_to_id(MARKER)]
            self.entries[word] = ids, " " + self.model.decode(ids)


def marked_words(text: str) -> list:
    return MARKED_WORD.findall(" " + text.replace(MARKER, " ")) if text else []


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """Columns doc_id, ids array<int>, decoded string for every row of docs."""

    def run(batches):
        table = WordTable(model_path)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                words = [marked_words(text or "") for text in part["text"].to_pylist()]
                table.learn(set(itertools.chain.from_iterable(words)))
                entry = table.entries.__getitem__
                found = [list(map(entry, own)) for own in words]
                ids = [list(itertools.chain.from_iterable(x[0] for x in own)) for own in found]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, ends[-1])
                decoded = ["".join(x[1] for x in own)[1:] for own in found]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(decoded, pa.string())],
                    ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind(docs, 'doc_id')}, ids array<int>, decoded string")
