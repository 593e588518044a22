"""Token ids of many texts at once with a public tokenizer, word by word.

A whole text costs the library about a second per megabyte. Its normaliser and splitter never look across ASCII white
space, so every different word of a batch is encoded once and the ids are dealt out to its occurrences. Words of plain
Latin letters, digits and signs go straight to the library's merge model; all others go through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_WORDS = 250_000  # words remembered between batches of one task

# Letters whose lower case is one letter of the same block, no combining marks: nothing to normalise.
PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-įı-ňŊ-ž]*")
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # the splitting rule of such vocabularies
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-z0-9ß-öø-ž]+")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself, or the next free letter above 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(shown))
    return table


ALPHABET = byte_alphabet()


def place_of(vocabulary: str) -> str:
    """The file of a vocabulary: a path, or the name of a public one installed on this machine."""
    if os.path.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


class Encoder:
    """Encodes texts with a vocabulary file; strings of special tokens are ordinary text.

    Vocabularies that lower-case and split as `SPLIT` does are read word by word, others text by text.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        place = place_of(vocabulary)
        self.tokenizer = Tokenizer.from_file(place)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.words: dict[str, list[int]] = {}
        self.parts: dict[str, list[int]] = {}
        with open(place, encoding="utf-8") as f:
            said = json.load(f)
        steps = [n["type"] for n in (said.get("normalizer") or {}).get("normalizers", [])]
        splits = [p.get("pattern", {}).get("Regex") for p in (said.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and splits == [RULE, None]

    def part(self, part: str) -> list[int]:
        ids = self.parts.get(part)
        if ids is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(ALPHABET)
            ids = self.parts[part] = [t.id for t in self.model.tokenize(shown)]
        return ids

    def word(self, word: str) -> list[int]:
        ids = self.words.get(word)
        if ids is None:
            if PLAIN.fullmatch(word):
                parts = SPLIT.findall(word.lower())
                ids = self.part(parts[0]) if len(parts) == 1 else [i for p in parts for i in self.part(p)]
            else:
                ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            self.words[word] = ids
        return ids

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text); `end` closes every text, null is an empty one."""
        texts = pc.fill_null(texts, "")
        if self.by_word:
            if len(self.words) > CACHED_WORDS:
                self.words, self.parts = {}, {}
            split = pc.ascii_split_whitespace(texts)  # at least one word a text, be it an empty one
            coded = pc.dictionary_encode(split.flatten())
            found = pa.array([self.word(w) for w in coded.dictionary.to_pylist()], pa.list_(pa.uint32()))
            dealt = pc.take(found, coded.indices)
            flat = dealt.flatten().to_numpy(zero_copy_only=False)
            starts = np.asarray(split.offsets)[:-1] - split.offsets[0].as_py()
            counts = pc.list_value_length(dealt).to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.add.reduceat(counts, starts) if len(starts) else np.zeros(0, dtype=np.int64)
        else:
            each = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            flat = np.array([i for ids in each for i in ids], dtype=np.uint32)
            counts = np.array([len(ids) for ids in each], dtype=np.int64)
        counts = counts + 1
        ends = np.cumsum(counts) - 1
        out = np.full(int(counts.sum()), end, dtype=np.uint32)
        inside = np.ones(len(out), dtype=bool)
        inside[ends] = False
        out[inside] = flat
        return out, counts


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(vocabulary)
