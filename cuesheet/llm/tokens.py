"""Encoding with a public tokenizer, word by word.

A tokenizer's pre-tokens never cross from a word to the blanks after it, so pieces of a text that start there can be
encoded on their own and remembered. Most pieces are letters and then punctuation, which are two pre-tokens: these go to the
tokenizer's model directly, all new ones of a batch as one text. Any other piece is encoded as it is.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

#: what keeps a byte-level tokenizer's text from being cut before each space and around each line feed: other blanks, longer runs
#: of blanks, and the sign that is put where it is cut
UNCUT = r"[\x00-\x09\x0b-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n]{3}|[ \n]{2}\z"
CUT = "\x01"
#: of lines: letters that no normalisation but lower case changes, and then ASCII punctuation
SIMPLE = re.compile(r"^(?:( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-/:-@\[-`{-~]*)|[^\n]*)$", re.MULTILINE)
LONGEST, REMEMBERED = 64, 200_000
#: the characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SHOWN = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
TABLE = "".join("\n" if b == 0x0A else SHOWN.get(b, chr(b)) for b in range(256))
MARK = SHOWN[0]
#: of tokens: the first of a pre-token with its space, and the end of a word
SPACE, WORD_END = SHOWN[0x20], "</w>"


def batches_of(batches: Iterator[pa.RecordBatch], column: int, rows: int = 2048, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut up, so that a part has few rows and the strings of one column not many more than `size` bytes."""
    for b in batches:
        ends, first = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)), 0
        while first < b.num_rows:
            before = int(ends[first - 1]) if first else 0
            last = max(first + 1, min(first + rows, int(np.searchsorted(ends, before + size))))
            yield b.slice(first, last - first)
            first = last


class Encoder:
    """Token ids of texts as little-endian unsigned 16-bit integers; special tokens' strings are ordinary text."""

    def __init__(self, path: str, blanks_dropped: bool) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("the vocabulary needs more than 16 bits")
        self.lower = blanks_dropped
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        (self.mark,) = self.bare.encode(MARK, add_special_tokens=False).ids
        self.edge = np.zeros(1 << 16, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.edge[i] = token.endswith(WORD_END) if blanks_dropped else token.startswith(SPACE)
        self.parts: dict[str, bytes] = {"": b""}
        self.words, self.sizes, self.flat = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, "<u2")

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u2").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, parts: list[str], marked: bool) -> list[bytes]:
        """Of pre-tokens without line feeds; where tokens show their edges no marks are needed between them."""
        out = []
        for i in range(0, len(parts), 2000):
            some = parts[i : i + 2000]
            shown = codecs.charmap_decode("\n".join(some).encode(), "strict", TABLE)[0]
            if marked:
                shown = shown.replace("\n", f"\n{MARK}\n")
            ids = np.array(self.bare.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u2")
            if marked:
                ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
                firsts = np.concatenate(([0], ends[:-1] + 1))
            else:
                ends = np.flatnonzero(self.edge[ids])
                ends = ends + 1 if self.lower else np.append(ends[1:], len(ids))
                firsts = np.concatenate(([0], ends[:-1]))
            if len(ends) != len(some):
                raise ValueError("an edge between pre-tokens was lost")
            data = ids.tobytes()
            out += [data[2 * a : 2 * b] for a, b in zip(firsts.tolist(), ends.tolist(), strict=True)]
        return out

    def _pieces(self, wanted: list[str]) -> list[bytes]:
        joined = "\n".join(x if "\n" not in x else "" for x in wanted)
        found = SIMPLE.findall(joined.lower() if self.lower else joined) if wanted else []
        if len(self.parts) > REMEMBERED:
            self.parts = {"": b""}
        parts = self.parts
        new = list({p for pair in found for p in pair}.difference(parts))
        spaced = [p for p in new if self.lower or p[0] == " "]
        bare = [] if self.lower else [p for p in new if p[0] != " "]
        parts.update(zip(spaced, self._apart(spaced, marked=False), strict=True))
        parts.update(zip(bare, self._apart(bare, marked=True), strict=True))
        ids = [parts[a] + parts[b] for a, b in found]
        odd = [i for i, (a, _) in enumerate(found) if not a]
        for i, x in zip(odd, self._whole([wanted[i] for i in odd]), strict=True):
            ids[i] = x
        return ids

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        if self.lower:
            return pc.ascii_split_whitespace(texts)
        return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", CUT + " "), "\n", f"{CUT}\n{CUT}"), CUT)

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Of an array of strings without nulls."""
        whole = [] if self.lower else np.flatnonzero(pc.match_substring_regex(texts, UNCUT).to_numpy(zero_copy_only=False)).tolist()
        apart = dict(zip(whole, self._whole([texts[i].as_py() for i in whole]), strict=True))
        if apart:
            texts = pa.array(["" if i in apart else x for i, x in enumerate(texts.to_pylist())], pa.string())
        pieces = self._cut(texts)
        coded = pieces.flatten().dictionary_encode()
        here, at = coded.dictionary, coded.indices.to_numpy()
        row = pc.index_in(here, value_set=self.words)
        new = here.filter(row.is_null())
        ids = self._pieces(new.to_pylist())
        row = pc.fill_null(row, -1).to_numpy(zero_copy_only=False).copy()
        row[row < 0] = len(self.words) + np.arange(len(new))
        sizes = np.concatenate((self.sizes, np.fromiter(map(len, ids), np.int64, len(ids)) // 2))
        flat, starts = np.concatenate((self.flat, np.frombuffer(b"".join(ids), "<u2"))), np.cumsum(sizes) - sizes

        def gathered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            counts = sizes[rows]
            ends = np.cumsum(counts)
            return flat[np.repeat(starts[rows] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)], ends

        data, ends = gathered(row[at])
        data = data.tobytes()
        if len(sizes) > REMEMBERED:  # frequent pieces are among those of this batch
            short = pc.less_equal(pc.utf8_length(here), LONGEST)
            row = row[short.to_numpy(zero_copy_only=False)]
            self.words, self.flat, self.sizes = here.filter(short), gathered(row)[0], sizes[row]
        else:
            self.words, self.flat, self.sizes = pa.concat_arrays([self.words, new]), flat, sizes
        cuts = np.concatenate(([0], ends))[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()].tolist()
        made = [data[2 * a : 2 * b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for i, x in apart.items():
            made[i] = x
        return made
