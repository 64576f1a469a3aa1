"""Token ids of whole texts by a public byte-level BPE vocabulary.

The ids are those of the tokenizers library. tiktoken, with the same vocabulary as
ranks, makes them several times faster; texts with what might be a special token,
or with characters that libraries class differently as white space, go to the
tokenizer itself.
"""

from __future__ import annotations

import array
import base64
import re

import numpy as np

ODD_SPACE = re.compile("[\x1c-\x1f\x85᠎​⁠﻿]")
ODD = re.compile(ODD_SPACE.pattern + "|<\\|")

_LOADED: dict[str, Encoder] = {}


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of tokens and their bytes, each in a row filled up with zeros."""
    lengths = np.array([len(x) for x in tokens], np.int64)
    padded = np.zeros((len(tokens), int(lengths.max())), np.uint8)
    padded[np.arange(padded.shape[1]) < lengths[:, None]] = np.frombuffer(b"".join(tokens), np.uint8)
    return lengths, padded


def join_bytes(ids: np.ndarray, lengths: np.ndarray, padded: np.ndarray) -> bytes:
    """The bytes of a sequence of tokens."""
    size = lengths[ids]
    if not len(ids):
        return b""
    width = int(size.max())
    return padded[ids, :width][np.arange(width) < size[:, None]].tobytes()


class Encoder:
    """Encodes texts to unsigned 32-bit ids."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path, self.tokenizer = path, None
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain_tokenizer = None
        self.lengths, self.padded = byte_table(sorted(ranks, key=ranks.get))

    def encode(self, text: str) -> np.ndarray:
        if not ODD.search(text):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def plain(self, text: str) -> np.ndarray:
        """Ids of a text in which the strings of special tokens are plain text."""
        if not ODD_SPACE.search(text):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        if self.plain_tokenizer is None:
            from tokenizers import Tokenizer

            self.plain_tokenizer = Tokenizer.from_file(self.path)
            self.plain_tokenizer.encode_special_tokens = True
        return np.array(self.plain_tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def joined(self, ids: np.ndarray) -> bytes:
        return join_bytes(ids, self.lengths, self.padded)


class Pieces:
    """Encodes texts by a piece vocabulary with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.lengths, self.padded = byte_table([bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("\u2581", " ").encode() for i, x in enumerate(names)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self.model.encode(texts, num_threads=1)]

    def joined(self, ids: np.ndarray) -> bytes:
        return join_bytes(ids, self.lengths, self.padded)


def pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


#: What the word vocabulary splits texts of these characters into, once they are lower case.
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
NOT_PLAIN = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ¿¡«»“”„‘’‚–—…•]|<\\|")


class WordEncoder:
    """Encodes texts by a BPE vocabulary with word ends that folds case and drops white space.

    The library's model encodes each different word of plain texts once (at most
    ``memo`` words are kept); texts with other characters, whose composition or case
    needs the library's own rules, or with what might be a special token, go to the
    tokenizer as a whole.
    """

    def __init__(self, path: str, memo: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.known = Tokenizer.from_file(path), memo, {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.chars = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    def word(self, word: str) -> bytes:
        name = word if word.isascii() else word.encode().decode("latin-1").translate(self.chars)
        return array.array("I", [t.id for t in self.tokenizer.model.tokenize(name)]).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if NOT_PLAIN.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        words = PLAIN_WORDS.findall(text.lower())
        try:
            found = b"".join(map(self.known.__getitem__, words))
        except KeyError:
            known = self.known
            new = {x for x in words if x not in known}
            if len(self.known) + len(new) > self.memo:
                self.known, new = {}, set(words)
            self.known.update(zip(new, map(self.word, new), strict=True))
            found = b"".join(map(self.known.__getitem__, words))
        return np.frombuffer(found, np.uint32)


def word_encoder(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
