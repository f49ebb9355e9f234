"""Token ids of whole texts by a public tokenizer, fast on repetitive vocabulary."""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"
# Words a Python worker remembers the ids of, about 200 bytes each; the table is emptied
# when it is full.
KNOWN = 400_000
# Punctuation that always ends a run of letters. The apostrophe is not among it, because
# it starts contractions, nor are the signs around special tokens.
ENDS = ".,;:!?|#$%&*+-/=@^_~()[]{}"
# Letters below this code point are single after normalization and lower-casing, but for
# one that lower-cases to two characters.
SIMPLE, DOTTED_I = "ɐ", "İ"


def byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level BPE writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (byte for byte in range(256) if byte not in plain)
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + n) for n, b in enumerate(others)}}


class WordIds(dict):
    """Ids of texts from the ids of their words.

    This vocabulary splits at white space before anything else, so the ids of a text are
    those of its words one after another. A word of plain letters goes to the BPE model
    itself, without the punctuation behind it; every other word goes through the whole
    tokenizer. Both are remembered, each word as it stands in the text. Equality with encoding the whole text at once is
    tested.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self._reset()

    def _reset(self):
        self.clear()
        self.starts, self.counts, self.pool = array("q"), array("q"), array("I")
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        """The word's number; its ids follow with those of all new words of a batch."""
        known = self[word] = len(self)
        self.new.append(word)
        return known

    def _settle(self):
        """Ids of the new words, in the order of their numbers."""
        tokenize, get, settled = self.model.tokenize, self.get, len(self.starts)
        starts, counts, pool, tails = self.starts, self.counts, self.pool, {}
        found: list[int] = []
        ends = array("q")
        for word in self.new:
            core = word.rstrip(ENDS)
            # Others can have marks behind them after normalization, which join punctuation.
            if core.isalpha() and (core.isascii() or (max(core) < SIMPLE and DOTTED_I not in core)):
                known = get(core, settled)
                if known < settled:
                    found += pool[starts[known] : starts[known] + counts[known]]
                else:
                    written = core.lower()
                    if not core.isascii():
                        written = written.encode().decode("latin-1").translate(self.letters)
                    found += [token.id for token in tokenize(written)]
                if core != word:
                    tail = word[len(core) :]
                    if tail not in tails:
                        tails[tail] = self._whole(tail)
                    found += tails[tail]
            else:
                found += self._whole(word)
            ends.append(len(found))
        before = len(pool)
        at = np.frombuffer(ends, np.int64)
        sizes = np.diff(at, prepend=0)
        starts.frombytes((before + at - sizes).tobytes())
        counts.frombytes(sizes.tobytes())
        pool.extend(found)
        self.new = []

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def of(self, texts: pa.Array | list, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has; ``end`` is put behind each.

        Each word of the batch is looked up once.
        """
        if len(self) > KNOWN:
            self._reset()
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        parts = pc.split_pattern(pc.replace_substring(column.fill_null(""), "\n", " "), " ")
        words = pc.list_value_length(parts).to_numpy()
        every = parts.flatten().dictionary_encode()
        names = every.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.__getitem__, names), np.int64, len(names))
        if self.new:
            self._settle()
        which = numbers[every.indices.to_numpy()]
        starts, pool = np.frombuffer(self.starts, np.int64), np.frombuffer(self.pool, np.uint32)
        counts = np.frombuffer(self.counts, np.int64)[which]
        before = np.concatenate([[0], np.cumsum(counts)])
        ids = pool[np.repeat(starts[which] - before[:-1], counts) + np.arange(before[-1])]
        ends = before[np.cumsum(words)]
        lengths = np.diff(ends, prepend=0)
        if end is not None:
            ids, lengths = np.insert(ids, ends, end), lengths + 1
        return ids.astype(np.uint32), lengths


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The worker's table for a tokenizer, kept from task to task."""
    return WordIds(path)


def vocabulary(name: str = WORD_BPE) -> str:
    """Where a public tokenizer's file lies; the same on every machine that has it."""
    return public_tokenizers.path(name)
