"""Public vocabularies inside tasks: encoders that a worker loads once, and the bytes that each of their tokens stands for."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

# How a byte-level vocabulary splits a text before it merges bytes: a fixed value of its format.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_character() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones are themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def sizes_of(table: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, table), np.int64, len(table))


def read_ranks(path: str) -> dict[bytes, int] | None:
    """Ids by the bytes of each token, where the file of a byte-level vocabulary is one of ranks: every merge of two tokens, in the
    order of ids, after the 256 bytes, and nothing else that changes a text. None where it isn't."""
    with open(path, encoding="utf-8") as file:
        settings = json.load(file)
    model, before = settings["model"], settings.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or settings.get("normalizer") or before.get("type") != "ByteLevel":
        return None
    if before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    byte_of, added = byte_of_character(), {t["content"] for t in settings.get("added_tokens") or ()}
    ranks = {bytes(map(byte_of.__getitem__, t)): k for t, k in model["vocab"].items() if t not in added and all(c in byte_of for c in t)}
    merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    in_order = all(model["vocab"].get("".join(m)) == 256 + k for k, m in enumerate(merges))
    whole = len(ranks) == len(model["merges"]) + 256 and all(bytes([b]) in ranks for b in range(256))
    return ranks if in_order and whole else None


def ranked_encoder(path: str):
    """The fast encoder for such a file, or None; special strings are plain text for its ``encode_ordinary``."""
    import tiktoken

    ranks = read_ranks(path)
    if ranks is None:
        return None
    return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


class ByteVocabulary:
    """A byte-level vocabulary file; special strings in a text are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.ranked = ranked_encoder(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        byte_of, known = byte_of_character(), self.tokenizer.get_vocab(with_added_tokens=True)
        self.table = [b""] * (max(known.values()) + 1)
        for token, k in known.items():
            self.table[k] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        self.sizes = sizes_of(self.table)

    def encode(self, text: str) -> list[int]:
        if self.ranked is not None:
            return self.ranked.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class PieceVocabulary:
    """A sentence-piece model; it puts a space before a text and spells characters it lacks byte by byte."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.pieces = SentencePieceProcessor(model_file=path)
        names = [self.pieces.id_to_piece(k) for k in range(self.pieces.get_piece_size())]
        self.table = [
            bytes([int(name[3:5], 16)]) if self.pieces.is_byte(k) else name.replace("▁", " ").encode() for k, name in enumerate(names)
        ]
        self.sizes = sizes_of(self.table)
        # By code point: bytes it is spelled with, 0 where the vocabulary has the character.
        self.spelled = np.repeat(np.array([1, 2, 3, 4], np.uint8), [0x80, 0x780, 0xF800, 0x100000])
        self.spelled[[ord(name.replace("▁", " ")) for name in names if len(name) == 1]] = 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.pieces.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def byte_vocabulary(path: str) -> ByteVocabulary:
    return ByteVocabulary(path)


@lru_cache(maxsize=4)
def piece_vocabulary(path: str) -> PieceVocabulary:
    return PieceVocabulary(path)


def batches_of(texts: list[str], most_rows: int, most_chars: int):
    """Bounds of slices of at most so many texts and characters; a longer text is a slice of its own."""
    start = 0
    while start < len(texts):
        end, chars = start, 0
        while end < len(texts) and (end == start or (end - start < most_rows and chars + len(texts[end]) <= most_chars)):
            chars += len(texts[end])
            end += 1
        yield start, end
        start = end
