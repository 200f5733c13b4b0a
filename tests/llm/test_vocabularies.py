"""Fast encoders against the libraries that own the files."""

import json
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from keyspan.llm import bpe
from keyspan.llm.vocabularies import batches_of, byte_vocabulary, piece_vocabulary, read_ranks

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", " ", "it's 'S don't", "a  b\n\n c", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "東京 😀́ é", "\x00\x01", "#" * 700, "'" * 9]


def by_library(text: str, special: bool) -> list[int]:
    tokenizer = byte_vocabulary(BYTES).tokenizer
    tokenizer.encode_special_tokens = not special
    try:
        return tokenizer.encode(text, add_special_tokens=False).ids
    finally:
        tokenizer.encode_special_tokens = True


def same(text: str) -> None:
    code = bpe.coder(BYTES)
    assert code.encode([text])[0] == by_library(text, True)
    assert byte_vocabulary(BYTES).encode(text) == by_library(text, False)


def test_file_is_one_of_ranks(tmp_path):
    assert len(read_ranks(BYTES)) == 50_256 and byte_vocabulary(BYTES).ranked is not None and bpe.coder(BYTES).ranked is not None
    with open(BYTES, encoding="utf-8") as file:
        other = json.load(file)
    other["model"]["merges"][:2] = other["model"]["merges"][1::-1]
    changed = tmp_path / "other.json"
    changed.write_text(json.dumps(other))
    assert read_ranks(str(changed)) is None
    assert bpe.Coder(str(changed)).encode(["to be"]) == bpe.coder(BYTES).encode(["to be"])


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" '\nstrevld<|endoftext|>12#."), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text(text):
    same(text)
    same(text + "<|endoftext|>" + text)


def test_hard_texts_and_joined_tokens():
    table, draw = byte_vocabulary(BYTES).table, random.Random(3)
    for text in HARD:
        same(text)
    for _ in range(3000):
        same(b"".join(draw.choices(table, k=8)).decode("utf-8", "ignore"))


def test_decode_of_any_ids():
    code, draw = bpe.coder(BYTES), random.Random(4)
    for _ in range(2000):
        ids = draw.choices(range(50_257), k=draw.randrange(9))
        assert code.decode(ids) == code.tokenizer.decode(ids, skip_special_tokens=False)
    assert code.decode([99_999_999]) == code.tokenizer.decode([99_999_999], skip_special_tokens=False)


def test_characters_spelled_byte_by_byte():
    vocabulary = piece_vocabulary(PIECES)
    for text in [*HARD, "naïve Ωμέγα ሀለ ꙮ 東京", "\n\t\r"]:
        spelled = sum(vocabulary.spelled[ord(c)] for c in text)
        assert spelled == sum(map(vocabulary.pieces.is_byte, vocabulary.encode([text])[0]))


def test_slices():
    assert list(batches_of(["a"] * 5, 2, 99)) == [(0, 2), (2, 4), (4, 5)]
    assert list(batches_of(["aaa", "b" * 50, "c"], 9, 10)) == [(0, 1), (1, 2), (2, 3)]
    assert list(batches_of([], 2, 2)) == []
