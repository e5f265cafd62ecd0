"""Token counts of whole texts by a whole-token shortcut.

A byte-level vocabulary splits a text into pre-tokens by a pattern and merges bytes within each. Before
any text is read, ``WholeTokens`` proves for every string of the vocabulary whether the file's own merges
give it alone as one token. A pre-token that equals a proven string counts one, without merging; only
the others are merged, by the library's model, once for all their occurrences in a text. Counts are the
library's own, whatever the text:

* the pattern's classes are those of the ``regex`` module, whose Unicode is newer than the library's;
  texts with characters that Python's own, older table doesn't assign are split by the library;
* the file's added tokens are recognised inside texts, as the library does by default;
* files of another scheme (``.model`` files, word-end vocabularies, normalizers) are counted by their
  library from beginning to end, as nothing is proven of them.

Texts longer than ``WINDOW`` are split in windows that end before a blank between two words, where a
pre-token ends in any case; a text without such a place is one window.

Defined cases: a null text is empty, an empty text has 0 tokens; equal rows are counted each; a null id
stays null; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import SPLIT
from .shared import arrow_kernel, slices

#: Tokens that a document may have.
LIMIT = 512
#: Characters that are split at a time.
WINDOW = 1 << 20
#: Merged pre-tokens that are remembered from text to text, and the longest of them; what isn't is merged again.
REMEMBERED, REMEMBERED_CHARS = 1 << 16, 64
#: Below this code point the two tables of Unicode agree in full.
SETTLED = 0x530

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

_INNER_BLANK = regex.compile(r"(?<=\S) (?=\S)")


def unsettled(text: str) -> bool:
    """Whether Python's table of Unicode leaves a character unassigned; newer tables may give it a class."""
    return not text.isascii() and any(c >= chr(SETTLED) and unicodedata.category(c) == "Cn" for c in set(text))


def byte_level(file: dict) -> bool:
    """Whether a tokenizers file splits by ``SPLIT`` and merges bytes within, with no other step before, between or after."""
    model, before = file["model"], file.get("pre_tokenizer") or {}
    if (model.get("type", "BPE"), before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) != ("BPE", "ByteLevel", False, True):
        return False
    return not file.get("normalizer") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))


def written() -> dict[int, str]:
    """How the scheme writes bytes: printable ones of Latin-1 as themselves, the others as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}


class WholeTokens:
    """Counts the tokens that the file's library gives; ``whole`` holds the pre-tokens proven to be one token."""

    def __init__(self, vocabulary: str) -> None:
        self.merged_before: dict[str, int] = {}
        self.library = self.pieces = None
        if not vocabulary.endswith(".json"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
            return
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        with open(vocabulary, encoding="utf-8") as f:
            file = json.load(f)
        added = file.get("added_tokens") or []
        contents = sorted((t["content"] for t in added), key=len, reverse=True)
        # Added tokens that take in blanks or stand alone only are left to the library.
        self.shortcut = byte_level(file) and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.added = regex.compile("|".join(map(regex.escape, contents))) if contents else None
        self.written = written()
        self.split = regex.compile(SPLIT)
        self.whole = self.proven(file["model"]["vocab"]) if self.shortcut else frozenset()

    def proven(self, vocab: dict[str, int]) -> frozenset[str]:
        """The vocabulary's strings that the merges give alone as one token, as they stand in texts.

        A string whose bytes aren't UTF-8 is no pre-token and left out; so is one that other merges
        overtake, so that its own bytes never come together.
        """
        byte = {c: b for b, c in self.written.items()}
        out = set()
        for s in vocab:
            if all(c in byte for c in s) and len(self.library.model.tokenize(s)) == 1:
                try:
                    out.add(bytes(byte[c] for c in s).decode())
                except UnicodeDecodeError:
                    continue
        return frozenset(out)

    def __call__(self, text: str) -> int:
        if self.pieces is not None:
            return len(self.pieces.encode(text, num_threads=1))
        if not self.shortcut:
            return len(self.library.encode(text, add_special_tokens=False).ids)
        if self.added is None or not self.added.search(text):
            return self.ordinary(text)
        n, at = 0, 0
        for m in self.added.finditer(text):
            n, at = n + self.ordinary(text[at : m.start()]) + 1, m.end()
        return n + self.ordinary(text[at:])

    def ordinary(self, text: str) -> int:
        """Tokens of a text without added tokens."""
        if len(text) <= WINDOW:
            return self.window(text)
        n = start = 0
        while start < len(text):
            cut = _INNER_BLANK.search(text, start + WINDOW) if len(text) - start > WINDOW else None
            stop = cut.start() if cut else len(text)
            n, start = n + self.window(text[start:stop]), stop
        return n

    def window(self, text: str) -> int:
        if unsettled(text):
            found = Counter(text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text))
        else:
            found = Counter(self.split.findall(text))
        return sum(k if t in self.whole else k * self.merged(t) for t, k in found.items())

    def merged(self, token: str) -> int:
        """Tokens of a pre-token that is none by itself."""
        n = self.merged_before.get(token)
        if n is None:
            n = len(self.library.model.tokenize("".join(self.written[b] for b in token.encode())))
            if len(token) <= REMEMBERED_CHARS:
                if len(self.merged_before) >= REMEMBERED:
                    self.merged_before.clear()
                self.merged_before[token] = n
        return n


@lru_cache(4)
def counter(vocabulary: str) -> WholeTokens:
    """One for each file and Python worker."""
    return WholeTokens(vocabulary)


def count(docs: DataFrame, vocabulary: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_bytes, n_tokens, over_limit``."""

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        tokens = counter(vocabulary)
        for part in slices(batch, "text"):
            texts = part.column("text")
            n = [tokens(t) if t else 0 for t in texts.to_pylist()]
            yield {"doc_id": part.column("doc_id"), "n_bytes": pc.fill_null(pc.binary_length(texts), 0), "n_tokens": n, "over_limit": [x > limit for x in n]}

    return arrow_kernel(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), COUNTS, rows)
