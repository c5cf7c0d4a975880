"""Token ids of whole texts by the ``tokenizers`` library, inside tasks.

For tokenizers that never join across white space, the ids of a text are those of its words in order. Words repeat,
so each worker keeps the ids of words it has met (at most ``MAX_WORDS``) and asks the library for new ones only.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from functools import lru_cache

import numpy as np
from pyspark.sql import SparkSession

MAX_WORDS = 1_000_000
AT_ONCE = 200  # words given to the library in one text
PUNCTUATION = b".,"

# The settings of a tokenizer for which words may be encoded one by one.
_WORDWISE_NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
_WORDWISE_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def tokenizer_spec(path: str) -> str:
    """The tokenizer file as text, to be sent to the tasks; workers need no path of their own."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def broadcast_spec(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(tokenizer_spec(path))


@lru_cache(maxsize=2)
def _encoder(_key: str, spec: str, max_words: int) -> Encoder:
    return Encoder(spec, max_words)


def encoder(spec: str, max_words: int = MAX_WORDS) -> Encoder:
    """The worker's encoder for a tokenizer; it lives as long as the worker, so later tasks find the words known."""
    return _encoder(hashlib.sha256(spec.encode()).hexdigest(), spec, max_words)


def _settings(tokenizer) -> dict[str, dict | None]:
    """What goes on around the model, as in the tokenizer's file; the vocabulary itself is not unfolded once more."""
    parts = {k: getattr(tokenizer, k) for k in ("normalizer", "pre_tokenizer", "post_processor")}
    return {k: part and json.loads(part.__getstate__()) for k, part in parts.items()}


class Encoder:
    def __init__(self, spec: str, max_words: int = MAX_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs as many tasks as there are cores
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(spec)
        settings = _settings(self.tokenizer)
        self.wordwise = (
            (settings["normalizer"] or {}).get("normalizers") == _WORDWISE_NORMALIZERS
            and _WORDWISE_PATTERN in json.dumps(settings["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")
            and getattr(self.tokenizer.model, "end_of_word_suffix", None) == "</w>"
            and not settings["post_processor"]
        )
        # the same model (one copy in memory) without the normal form, which words in lower-case Latin-1 letters have already
        self.plain = None
        if self.wordwise:
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
            added = self.tokenizer.get_added_tokens_decoder()
            self.plain.add_tokens([added[i] for i in sorted(added)])
        vocabulary = self.tokenizer.get_vocab()
        self.ids = max(vocabulary.values(), default=-1) + 1
        self.ends_word = np.zeros(self.ids, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}
        self.max_words = max_words
        self.marks = {bytes([c]): self._whole(chr(c)) for c in PUNCTUATION} if self.wordwise else {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, new: list[bytes]) -> None:
        """Encode words met for the first time; plain ones (letters and perhaps one mark) in one call."""
        plain: list[tuple[bytes, str, bytes]] = []
        for w in new:
            s, mark = w.decode(), b""
            if w[-1:] in self.marks and len(w) > 1:
                s, mark = s[:-1], w[-1:]
                known = self.words.get(w[:-1])
                if known is not None and s.isalpha():
                    self.words[w] = known + self.marks[mark]
                    continue
            if s.isalpha():
                plain.append((w, s, mark))
            else:
                self.words[w] = self._whole(w.decode())
        for i in range(0, len(plain), AT_ONCE):
            part = plain[i : i + AT_ONCE]
            ids = self.plain.encode_batch_fast([" ".join(s for _, s, _ in part)], add_special_tokens=False)[0].ids
            ids = np.asarray(ids, dtype="<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part):  # a word of several pieces among them
                for w, s, _ in part:
                    self.words[w] = self._whole(w.decode())
                continue
            raw, at = ids.tobytes(), 0
            for (w, _, mark), end in zip(part, ends.tolist(), strict=True):
                self.words[w] = raw[at : 4 * end] + (self.marks[mark] if mark else b"")
                at = 4 * end

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers, without special tokens.

        Word by word where lower case and normal form of the text are plain (all of Latin-1, no special tokens).
        """
        if not self.wordwise or "<|" in text:
            return self._whole(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._whole(text)
        words = text.lower().encode().split()
        new = list(set(words).difference(self.words))
        if new:
            if len(self.words) + len(new) > self.max_words:
                self.words.clear()
                new = list(set(words))
            self._learn(new)
        return b"".join(map(self.words.__getitem__, words))


def ids_with_end(spec: str, texts, end_id: int, max_words: int = MAX_WORDS):
    """Ids of each text with the end id, as little-endian unsigned 32-bit integers."""
    end = np.asarray([end_id], dtype="<u4").tobytes()
    known = encoder(spec, max_words)
    return itertools.chain.from_iterable(([known.encode(t or "") + end]) for t in texts)
