"""Whole-text encoding with the tokenizers library, sped up by a cache of word encodings.

Both vocabularies cut a text before they merge, and never merge across a space that stands
between two non-space characters, nor between a letter and a run of marks or a line end.
So a text may be cut there, each distinct piece be encoded once by the library, and the ids
be put together again: the result equals the library's encoding of the whole text. Texts
with runs of spaces are cut more cautiously, and those that hold the string of a special
token go to the library whole, which reads it as that token (its default). `tests/llm`
holds this against the library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries that a worker's cache may have (some 170 bytes each). Beyond it the older half, which has the frequent words, stays.
CACHE_ENTRIES = 600_000
#: Longer pieces (texts without spaces) are encoded each time, so that entries bound a cache's bytes too.
KEPT_CHARACTERS = 64
#: Bytes of texts that are cut at a time; a longer text goes by itself.
SLICE_ROWS, SLICE_BYTES = 2000, 4 << 20

#: Letters and a run of ASCII marks; an apostrophe may begin a piece with letters behind it.
_WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)\Z")
_CAREFUL_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Byte-level vocabularies write a byte as itself where it prints, else as the next code point from 256 on.
_PRINTING = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + n for n, b in enumerate(x for x in range(256) if x not in _PRINTING)}
_SPACE_LETTER = chr(_BYTE_LETTERS[32])


class PieceCache(dict):
    """Piece -> its ids as little-endian uint32 bytes. `before` stands before each piece when it is encoded."""

    def __init__(self, owner: "WordCachedEncoder", before: str):
        super().__init__()
        self.owner, self.before = owner, before
        self.letter_before = _SPACE_LETTER if before and not owner.drops_space else ""

    def __missing__(self, piece: str) -> bytes:
        made = self._encode(piece)
        if len(piece) <= KEPT_CHARACTERS:
            self[piece] = made
        return made

    def _encode(self, piece: str) -> bytes:
        owner = self.owner
        # Words of Latin letters are neither cut nor normalised (but for case), so the library's model can have them at once.
        if piece.isalpha():
            if piece.isascii():
                return owner.model_ids(self.letter_before + (piece.lower() if owner.lower_case else piece))
            if max(piece) <= "\xff":
                low = piece.lower() if owner.lower_case else piece
                return owner.model_ids(self.letter_before + low.encode().decode("latin-1").translate(_BYTE_LETTERS))
            return owner.library_ids(self.before + piece)
        # Marks behind a word are a piece of their own. Beyond Latin letters, lower case may end in a mark that merges with what follows.
        if (cut := _WORD_AND_MARKS.match(piece)) and max(piece) <= "\xff":
            return self[cut[1]] + owner.bare[cut[2]]
        head, line_end, tail = piece.partition("\n")
        if line_end and tail[:1].isalpha() and head and head[-1].isprintable() and head[-1] != " ":
            return self[head] + owner.bare["\n"] + owner.bare[tail]
        return owner.library_ids(self.before + piece)


class WordCachedEncoder:
    """Ids of whole texts as the library gives them by default, with add_special_tokens=False."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        of = lambda text: self.library.encode(text, add_special_tokens=False).ids
        self.lower_case, self.drops_space = of("A") == of("a"), of(" ") == []
        self.id_bytes = [np.uint32(x).tobytes() for x in range(self.library.get_vocab_size() + 1)]
        self.cache_entries = cache_entries
        self.bare, self.spaced = PieceCache(self, ""), PieceCache(self, " ")

    def model_ids(self, word: str) -> bytes:
        made = self.id_bytes
        return b"".join([made[t.id] for t in self.model.tokenize(word)])

    def library_ids(self, piece: str) -> bytes:
        return np.array(self.library.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def cut(self, text: str) -> list[str]:
        """Pieces of the text; one space (or line end, where the vocabulary drops it) stood between each two."""
        if self.drops_space:
            if text.isascii() or max(text) <= "\xff":
                text = text.lower()
            return text.replace("\n", " ").split(" ")
        return _CAREFUL_CUT.split(text) if "  " in text else text.split(" ")

    def encode(self, text: str | None) -> bytes:
        low = (text or "").lower() if self.lower_case else text or ""
        if any(x in low for x in self.special):
            return self.library_ids(text)
        first, *rest = self.cut(text or "")
        return b"".join([self.bare[first], *map(self.spaced.__getitem__, rest)])

    def trim(self) -> None:
        for known in (self.spaced, self.bare):
            if len(known) > self.cache_entries:
                kept = list(islice(known.items(), self.cache_entries // 2))
                known.clear()
                known.update(kept)

    def encode_column(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all texts (null counts as empty), `end_id` behind each, end to end as uint32, and where each text's begin.

        Arrow cuts the texts and numbers their distinct pieces; the cache is asked once for
        each of these, and the ids of all pieces are then gathered by number. Texts that are
        cut with more care are encoded one by one.
        """
        self.trim()
        texts = pc.fill_null(texts, "")
        if self.drops_space:
            odd = pc.match_substring_regex(texts, "[^\\x{00}-\\x{ff}]")
            texts_cut = pc.replace_substring(pc.utf8_lower(texts), "\n", " ")
        else:
            odd, texts_cut = pc.match_substring(texts, "  "), texts
        for x in self.special:
            odd = pc.or_(odd, pc.match_substring(texts_cut, x))
        alone = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(alone):
            texts_cut = pc.if_else(odd, "", texts_cut)
        pieces = pc.split_pattern(texts_cut, " ")
        bounds = pieces.offsets.to_numpy()
        coded = pieces.values.dictionary_encode()
        numbers, names = coded.indices.to_numpy().copy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # The first piece of a text has no space before it, and an end follows the last; both have numbers of their own.
        firsts = np.unique(numbers[bounds[:-1]])
        made = [*map(self.spaced.__getitem__, names), *[self.bare[names[x]] for x in firsts], np.uint32(end_id).tobytes()]
        numbers[bounds[:-1]] = len(names) + np.searchsorted(firsts, numbers[bounds[:-1]])
        last = len(made) - 1
        made += [self.encode(texts[int(x)].as_py()) for x in alone]
        numbers[bounds[:-1][alone]] = last + 1 + np.arange(len(alone))
        # Arrow gathers the pieces' bytes in their order: the result's data are the ids of all texts.
        closes = bounds[1:] + np.arange(len(texts))
        sequence, inner = np.full(len(numbers) + len(texts), last, np.int32), np.ones(len(numbers) + len(texts), bool)
        inner[closes] = False
        sequence[inner] = numbers
        taken = pa.array(made, pa.large_binary()).take(pa.array(sequence))
        data = taken.buffers()[2]
        ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(sequence) + 1] // 4
        ids = np.frombuffer(data, "<u4")[: ends[-1]] if len(sequence) else np.zeros(0, "<u4")
        return ids, np.concatenate([[0], ends[closes + 1]]).astype(np.int64)


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `rows` rows and `size` bytes of the column; a row of more is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(lengths, dtype=np.int64), 0
    while at < batch.num_rows:
        fitting = int(np.searchsorted(ends, ends[at] - lengths[at] + size, side="right")) - at
        n = min(rows, max(1, fitting))
        yield batch.slice(at, n)
        at += n


_ENCODERS: dict[str, WordCachedEncoder] = {}


def encoder(path: str) -> WordCachedEncoder:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordCachedEncoder(path)
    return _ENCODERS[path]
