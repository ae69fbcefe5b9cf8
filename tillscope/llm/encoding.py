"""Encoding of whole texts by a public tokenizer, a word at a time.

The tokenizer drops white space and never joins across it, so a text's ids are the ids of its words in
turn. Words repeat, so each worker keeps the ids of words that it has met, up to a bound. Long words, such as
whole texts without blanks, are encoded each time.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tillscope.llm.shared import worker_cache

#: Bytes of texts whose words are encoded together.
TOGETHER = 8_000_000
#: Characters of the longest word whose ids are kept.
LONGEST = 40
#: New words that are encoded as one text.
TEXT = 100
MARKS = (".", ",", "!", "?", ";", ":")


def letters(word: str) -> bool:
    """Whether a word is letters alone, also in lower case (which may part a letter from its mark)."""
    return word.isalpha() and (word.isascii() or word.lower().isalpha())


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    Only for tokenizers that treat blanks as boundaries and drop them, and have no upper case. Twice `max_words` words
    of LONGEST characters bound the memory, with the words of one call.
    """

    def __init__(self, path: str, max_words: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_words = max_words
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Ids that end a word.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(1 + max(vocabulary.values(), default=0), bool)
        if suffix:
            self.is_end[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def learn(self, words: list[str]) -> None:
        # Words of letters alone are one stretch of the tokenizer each. Where it marks their ends, many are encoded as one text.
        plain = [w for w in words if letters(w)] if self.is_end.any() else []
        alone = [w for w in words if not letters(w)] if plain else words
        for start in range(0, len(plain), 10_000):
            groups = [plain[k : k + TEXT] for k in range(start, min(start + 10_000, len(plain)), TEXT)]
            for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(found.ids, "<u4")
                ends = ((np.flatnonzero(self.is_end[ids]) + 1) * 4).tolist()
                if len(ends) != len(group) or ends[-1] != 4 * len(ids):
                    alone += group
                    continue
                data = ids.tobytes()
                for word, low, high in zip(group, [0, *ends], ends, strict=False):
                    self.known[word] = data[low:high]
        for start in range(0, len(alone), 10_000):
            part = alone[start : start + 10_000]
            for word, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[word] = array("I", found.ids).tobytes()

    def ids_of_words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words. All that are new are encoded together."""
        if len(self.known) > self.max_words:  # words met since the last time stay, others go
            self.older, self.known = self.known, {}
        # The tokenizer cuts letters from a mark after them, so "word." is "word" and ".".
        bases = [w[:-1] if w[-1:] in MARKS and letters(w[:-1]) else w for w in words]
        known, new = self.known, []
        for word in {*bases, *MARKS}.difference(known):
            held = self.older.get(word)
            if held is None:
                new.append(word)
            else:
                known[word] = held
        self.learn(new)
        found = [known[base] if len(base) == len(word) else known[base] + known[word[-1]] for word, base in zip(words, bases, strict=True)]
        for word in new:
            if len(word) > LONGEST:
                del known[word]
        return found

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each has. Null counts as empty.

        Each different word is looked up once; its ids are then taken to all its places.
        """
        # Lower case is the tokenizer's own first step; done here it makes fewer different words. Texts with the start of
        # a special token are left alone, since those are matched before lower case.
        texts = pc.fill_null(texts, "")
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        found = self.ids_of_words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(size) - size
        word = coded.indices.to_numpy(zero_copy_only=False)
        each = size[word]
        before = np.concatenate([[0], np.cumsum(each)])
        place = np.repeat(first[word] - before[:-1], each) + np.arange(before[-1])
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        return np.frombuffer(b"".join(found), "<u4")[place], np.diff(before[offsets])

    def encode(self, *texts: str | None) -> list[bytes]:
        """The ids of each text; an empty one has none."""
        ids, counts = self.ids(pa.array(texts, pa.string()))
        return [part.tobytes() for part in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process."""
    return worker_cache(("encoder", path), lambda: WordEncoder(path))


def slices(texts: pa.Array, size: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts of about `size` bytes, or one longer text."""
    before = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(before, (before[start - 1] if start else 0) + size, "right")))
        yield start, end - start
        start = end


def encoded(batches: Iterable, path: str, end: int | None) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids as bytes) of Arrow batches with doc_id and text; `end` is appended to each document."""
    words, tail = encoder(path), b"" if end is None else array("I", [end]).tobytes()
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        for start, length in slices(texts):
            found, counts = words.ids(texts.slice(start, length))
            data, at = memoryview(found).cast("B"), 0
            for doc_id, n in zip(ids.slice(start, length).to_pylist(), counts.tolist(), strict=True):
                yield doc_id, b"".join((data[at : at + 4 * n], tail))
                at += 4 * n
