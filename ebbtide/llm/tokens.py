"""Token ids of a public tokenizer file, computed once per distinct piece of a word.

The tokenizer splits at white space before anything else, so a text's ids are its words'
ids in a row. A word of plain letters with signs behind it is two pieces to the tokenizer:
the letters in lower case, and the signs. Each task keeps the ids of the pieces it has met
and asks the library for new ones alone, many at once; the rest is done on whole columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from ebbtide.llm.common import kept, text_slices

#: Pieces a task remembers before it starts anew.
MEMORY = 1 << 19
#: Pieces asked for at once.
AT_ONCE = 4096
#: Words whose ids are put in a row at once.
ROW = 1 << 18

# Letters that lower-case and normalise the same way everywhere, then signs that no
# contraction starts with.
_PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[!-&(-/:-@\[-`{-~]*)$"


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each row, count many, in a row."""
    ends = np.cumsum(count, dtype=np.int32)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)


class Ids:
    """Ids of pieces, kept in one array with the place and number of each piece's."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.vocabulary_size = max(vocabulary.values()) + 1
        self.width = np.uint16 if self.vocabulary_size <= 1 << 16 else np.uint32
        self.last = np.zeros(self.vocabulary_size, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # The shortcut holds for vocabularies whose words end in a token of their own and
        # whose texts are lower-cased; any other goes word by word.
        self.joined = bool(self.last.any()) and self._ids("AÉ b") == self._ids("aé b")
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {"": 0}
        self.start, self.count, self.ids, self.used = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.empty(4096, self.width), 0

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _add(self, pieces: list[str], ids: np.ndarray, count: np.ndarray) -> None:
        first, end = len(self.slot), self.used + len(ids)
        while first + len(pieces) > len(self.start):
            self.start, self.count = np.resize(self.start, 2 * len(self.start)), np.resize(self.count, 2 * len(self.count))
        if end > len(self.ids):
            self.ids = np.resize(self.ids, 2 * end)
        self.ids[self.used : end] = ids
        self.start[first : first + len(pieces)] = self.used + np.cumsum(count) - count
        self.count[first : first + len(pieces)] = count
        self.slot.update(zip(pieces, range(first, first + len(pieces))))
        self.used = end

    def _learn_alone(self, pieces: list[str]) -> None:
        found = [self._ids(p) for p in pieces]
        self._add(pieces, np.array([i for f in found for i in f], self.width), np.array([len(f) for f in found], np.int32))

    def _learn_letters(self, pieces: list[str]) -> None:
        """Ask for many words of letters in one text, and cut its ids behind each token that ends a word."""
        for i in range(0, len(pieces), AT_ONCE):
            part = pieces[i : i + AT_ONCE]
            ids = np.array(self._ids(" ".join(part)), self.width)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part):
                self._add(part, ids, np.diff(ends, prepend=0).astype(np.int32))
            else:
                self._learn_alone(part)

    def _slots(self, pieces: pa.Array, letters: np.ndarray) -> np.ndarray:
        """The slot of each piece; ``letters`` marks those of letters alone."""
        coded = pieces.dictionary_encode()
        names, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        found = list(map(self.slot.get, names))
        if None in found:
            plain = np.zeros(len(names), bool)
            plain[index] = letters
            new = [(n, p) for n, f, p in zip(names, found, plain.tolist()) if f is None]
            self._learn_letters([n for n, p in new if p])
            self._learn_alone([n for n, p in new if not p])
            found = list(map(self.slot.get, names))
        return np.array(found, np.int32)[index]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words in a row, and how many each has."""
        split = pc.extract_regex(words, pattern=_PLAIN)
        plain = pc.and_(split.is_valid(), pa.scalar(self.joined))
        letters = pc.if_else(plain, pc.utf8_lower(split.field(0)), words)
        signs = pc.if_else(plain, split.field(1), "")
        plain = plain.to_numpy(zero_copy_only=False)
        slots = np.empty(2 * len(words), np.int32)
        slots[0::2], slots[1::2] = self._slots(letters, plain), self._slots(signs, np.zeros(len(words), bool))
        count = self.count[slots]
        return self.ids[_spread(self.start[slots], count)], count[0::2] + count[1::2]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column in a row, and how many each text has; none for null.

        The column should be a slice of some megabytes (``text_slices``).
        """
        if len(self.slot) > MEMORY:
            self.clear()
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        bounds, words = parts.offsets.to_numpy(), parts.flatten()
        rows, counts = [], np.zeros(len(words) + 1, np.int64)
        for at in range(0, len(words), ROW):
            coded = words.slice(at, ROW).dictionary_encode()
            ids, count = self._words(coded.dictionary)
            index = coded.indices.to_numpy()
            here = count[index]
            rows.append(ids[_spread((np.cumsum(count, dtype=np.int32) - count)[index], here)])
            counts[at + 1 : at + 1 + len(here)] = here
        total = np.cumsum(counts)[bounds - bounds[0]]
        return np.concatenate(rows) if rows else np.empty(0, self.width), np.diff(total)


def ids_of(path: str) -> Ids:
    """The encoder of this worker process for a tokenizer file; kept until other work begins."""
    return kept(f"ids:{path}", lambda: Ids(path))


def encoded_slices(path: str, texts: pa.Array):
    """Per slice of a text column: its first row, the ids in a row, and the count per text."""
    encoder = ids_of(path)
    for start, part in text_slices(texts):
        yield start, *encoder.encode(part)
