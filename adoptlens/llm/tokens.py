"""Ids of whole texts by a public tokenizer, each distinct word encoded once.

``word_bpe_49k`` drops white space and never joins across it, so the ids of a text are the
ids of its words one after the other. A worker keeps the ids of the words it has met and
asks the library only for new ones; the result is the library's, word by word. The few
texts whose ids don't follow from their words are encoded whole; see ``TextEncoder``.
"""

from __future__ import annotations

import array
import functools
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Words that a worker remembers, about 200 MB; it then starts afresh.
REMEMBERED = 700_000
#: Stops between a letter and white space; no token holds a letter and a stop.
STOPS = re.compile("(?<=[a-z\u00df-\u00f6\u00f8-\u00ff])[.,!?;:]+(?= |$)")
#: Words that normalising and splitting leave as they are.
LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Code points that are looked up together.
SLICE = 1 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder(dict):
    """Word -> its number among the words met so far; a new one is encoded on demand.

    Words know no special tokens: their strings are ordinary text here.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # lower-casing a word can make the string of a special token that the text doesn't hold
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        letters = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in letters}
        self.clear()

    def clear(self) -> None:
        super().clear()
        self[""] = 0
        self.ids, self.ends = array.array("I"), array.array("q", [0])

    def __missing__(self, word: str) -> int:
        if LETTERS.fullmatch(word):
            letters = word if word.isascii() else word.translate(self.as_bytes)
            self.ids.extend([t.id for t in self.model.tokenize(letters)])
        else:
            self.ids.extend(self.tokenizer.encode(word, add_special_tokens=False).ids)
        self[word] = number = len(self.ends)
        self.ends.append(len(self.ids))
        return number

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, END_ID after each, and how many each has."""
        if len(self) > REMEMBERED:
            self.clear()
        words = [STOPS.sub(r" \g<0>", _lower(t or "").replace("\n", " ")).split(" ") for t in texts]
        counts = np.array([len(ws) for ws in words], dtype=np.int64)
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        flat, stops = np.array(self.ids, dtype=np.uint32), np.array(self.ends, dtype=np.int64)
        sizes = np.diff(stops, prepend=0)[at]
        ends = np.cumsum(sizes)
        # ids before the end of each text, then one end id per text
        lengths = np.diff(ends[np.cumsum(counts) - 1], prepend=0) + 1 if len(texts) else counts
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(stops[at] - ends, sizes) + np.arange(total)
        out = np.empty(total + len(texts), np.uint32)
        doc = np.repeat(np.arange(len(texts)), lengths - 1)
        out[np.arange(total) + doc] = flat[source]
        out[np.cumsum(lengths) - 1] = END_ID
        return out, lengths


def _lower(text: str) -> str:
    """Lower-cases A-Z; the tokenizer does the rest, so the ids are the same."""
    if text.isascii():
        return text.lower()
    return text.encode("utf-8", "surrogatepass").translate(FOLD).decode("utf-8", "surrogatepass")


class TextEncoder(WordEncoder):
    """The ids that the unaltered library gives, ``encode(text, add_special_tokens=False)``.

    A text is encoded whole, not by words, if it holds the string of a special token, which
    is then one id, or A-Z before a combining mark: the library composes the two before it
    lower-cases, and some pairs compose as small letters only.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        marks = "".join(c for c in map(chr, range(0x300, 0x1F000)) if unicodedata.combining(c))
        self.marked = re.compile(f"[A-Z][{marks}]")

    def by_words(self, text: str) -> bool:
        if any(s in text for s in self.special):
            return False
        try:
            text.encode("latin-1")  # much faster than the search, and without marks
            return True
        except UnicodeEncodeError:
            return not self.marked.search(text)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        whole = [i for i, t in enumerate(texts) if t and not self.by_words(t)]
        if not whole:
            return super().encode(texts)
        words = [*texts]
        for i in whole:
            words[i] = None
        flat, lengths = super().encode(words)
        parts = np.split(flat, np.cumsum(lengths)[:-1])
        for i in whole:
            ids = self.library.encode(texts[i], add_special_tokens=False).ids
            parts[i] = np.array([*ids, END_ID], np.uint32)
            lengths[i] = len(parts[i])
        return np.concatenate(parts), lengths


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder per worker process; it outlives the task."""
    return TextEncoder(path)


def slices(texts: list[str | None], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows with ``most`` code points in all, or one row that has more."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
