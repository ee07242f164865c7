"""SentencePiece encoding and decoding over a table of distinct chunks.

A text is marked as the library does it: blanks become whitespace markers and one more stands before the text. Where no piece of the
vocabulary has a marker after another character, nothing can be merged over the place before a marker that follows another character, so
texts are cut there. A task keeps one table of the distinct chunks that it has met; a chunk's ids are found once, when it is new, and the ids of
each text are put together from the table's rows by the chunks' positions. The table belongs to a task, as one for the whole corpus
would have to be joined with every occurrence, which moves several times the corpus.

Chunks longer than LONGEST characters, as of scripts without blanks, are cut further between two characters that stand beside each other in no piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from cuesheet.llm.common import only, table
from cuesheet.llm.tokens import batches_of

MARKER, BLANK = "▁", 0x20
#: chunks of more characters are cut further, and aren't remembered
LONGEST, REMEMBERED = 256, 200_000
IDS, DECODED = "doc_id long, ids array<int>", "doc_id long, ids array<int>, decoded string"


class ChunkTable:
    """Ids of texts as arrays of 32-bit integers, equal to the library's for whole texts."""

    def __init__(self, path: str) -> None:
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules, pieces = model.normalizer_spec, [p.piece for p in model.pieces if p.type in (p.NORMAL, p.USER_DEFINED, p.UNUSED)]
        if any(MARKER in p.lstrip(MARKER) for p in pieces) or model.trainer_spec.model_type != model.trainer_spec.BPE or any(p.type == p.USER_DEFINED for p in model.pieces):
            raise ValueError("pieces that cross whitespace markers can't be found chunk by chunk")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("texts that the normalisation changes can't be cut before it")
        self.prefix = rules.add_dummy_prefix
        rules.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.beside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.chunks, self.sizes, self.flat = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _parts(self, chunk: str) -> list[str]:
        """A long chunk in parts that no piece joins."""
        marked, parts, first = chunk.replace(" ", MARKER), [], 0
        at = LONGEST
        while at < len(marked):
            if marked[at - 1 : at + 1] in self.beside:
                at += 1
            else:
                parts.append(chunk[first:at])
                first, at = at, at + LONGEST
        return [*parts, chunk[first:]]

    def _segmented(self, chunks: list[str]) -> list[list[int]]:
        long = {i: self._parts(x) for i, x in enumerate(chunks) if len(x) > LONGEST}
        found = self.bare.encode([x if i not in long else "" for i, x in enumerate(chunks)], num_threads=1)
        for i, parts in long.items():
            found[i] = [x for ids in self.bare.encode(parts, num_threads=1) for x in ids]
        return found

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The chunks of all texts, and the number of chunks before each text and after the last."""
        marked = pc.replace_substring(texts, MARKER, " ")
        if self.prefix:
            marked = pc.if_else(pc.equal(marked, ""), "", pc.binary_join_element_wise(" ", marked, ""))
        if isinstance(marked, pa.ChunkedArray):
            marked = marked.combine_chunks()
        rows = np.frombuffer(marked.buffers()[1], np.int32, len(marked) + 1, marked.offset * 4)
        data = np.frombuffer(marked.buffers()[2] or b"", np.uint8)[: rows[-1]]
        first = data == BLANK
        first[1:] &= data[:-1] != BLANK
        first[: rows[0]] = False
        first[rows[:-1][rows[:-1] < rows[1:]]] = True
        starts = np.flatnonzero(first)
        offsets = np.append(starts, rows[-1]).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
        return chunks, np.searchsorted(starts, rows)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of an array of strings without nulls: all ids, and where each text's begin, with the end of the last."""
        chunks, cuts = self._cut(texts)
        coded = chunks.dictionary_encode()
        here, at = coded.dictionary, coded.indices.to_numpy()
        row = pc.index_in(here, value_set=self.chunks)
        new = here.filter(row.is_null())
        ids = self._segmented(new.to_pylist())
        row = pc.fill_null(row, -1).to_numpy(zero_copy_only=False).copy()
        row[row < 0] = len(self.chunks) + np.arange(len(new))
        sizes = np.concatenate((self.sizes, np.fromiter(map(len, ids), np.int64, len(ids))))
        flat = np.concatenate((self.flat, np.fromiter((x for some in ids for x in some), np.int32, int(sizes[len(self.sizes) :].sum()))))
        begin = np.cumsum(sizes) - sizes

        def gathered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ends = np.append(0, np.cumsum(sizes[rows]))
            return flat[np.repeat(begin[rows] - ends[:-1], sizes[rows]) + np.arange(ends[-1])], ends

        found, ends = gathered(row[at])
        if len(sizes) > REMEMBERED:  # frequent chunks are among those of this batch
            short = pc.less_equal(pc.utf8_length(here), LONGEST)
            row = row[short.to_numpy(zero_copy_only=False)]
            self.chunks, self.flat, self.sizes = here.filter(short), gathered(row)[0], sizes[row]
        else:
            self.chunks, self.flat, self.sizes = pa.concat_arrays([self.chunks, new]), flat, sizes
        return found, ends[cuts]


def encode_pieces(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row: the ids that the library gives for the whole text, without begin and end ids and without sampling.

    A null text counts as empty and has no ids; rows without doc_id and repeated rows are encoded like any other. Texts of any length are encoded whole;
    a run of characters that may all be joined with each other stays in one piece in memory. Other columns are ignored, whatever their names; an
    empty table gives none. `model` is a path that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for part in batches_of(batches, 1, size=4 << 20):
            encode = encode or ChunkTable(model)
            ids, ends = encode(part.column(1))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return only(docs, doc_id, text).mapInArrow(run, IDS)


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, decoded) of rows with doc_id and ids, by the library's decode of all ids of a row; no ids give an empty text, null ids too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = None
        for b in batches:
            pieces = pieces or sentencepiece.SentencePieceProcessor(model_file=model)
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                ids = [x.values.to_numpy().tolist() if x.is_valid else [] for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([pieces.decode(x) if x else "" for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, DECODED)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = decode_pieces(encode_pieces(table(spark, sf_dir, "documents"), model), model)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
