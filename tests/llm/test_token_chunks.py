"""op4's short ways to a chunk's ids against the library on whole texts."""

from __future__ import annotations

import functools
import json
import struct

import public_tokenizers
import pyarrow as pa

from prescriva.llm import binary_ids


@functools.cache
def _library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _same(texts, path):
    wanted = [[*_library(path).encode(t, add_special_tokens=False).ids, 2] for t in texts]
    for text, ids, got in zip(texts, wanted, binary_ids.encode(pa.array(texts), path, 2), strict=True):
        assert got == struct.pack(f"<{len(ids)}I", *ids), text


def test_words_that_differ_by_case_and_punctuation_are_worked_out_once(monkeypatch):
    asked = []

    class Counting(binary_ids.ChunkTable):
        def __init__(self, work_out, *more):
            super().__init__(lambda part: (asked.extend(part), work_out(part))[1], *more)

    monkeypatch.setattr(binary_ids, "ChunkTable", Counting)
    monkeypatch.setattr(binary_ids, "_TABLES", {})
    stems = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(500)]
    forms = [s.title() + "," for s in stems] + [s + "." for s in stems] + [s.upper() + "***" for s in stems] + stems
    _same([" ".join(forms)], public_tokenizers.path(binary_ids.TOKENIZER))
    assert len(asked) == len(set(asked)) <= 503


def test_each_character_beside_letters_and_punctuation():
    chars = [chr(i) for i in [*range(0x370), 0x1100, 0x1161, 0x11A8, 0x1E9E, *range(0x2000, 0x2070), 0x212A, 0x20DD, 0xE000, 0xFB01, 0x1F600]]
    _same([f"A{c}e.{c} h{c}H{c}'{c}S 1{c}{c}. ({c}'Re" for c in chars], public_tokenizers.path(binary_ids.TOKENIZER))


def test_mixed_texts():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    parts = st.sampled_from(["'s", "'RE", "'Ll", "<|endoftext|>", "<|EndOfText|>", "<|", "end", "A", "h", "ÀÖßÿ", "ª", "µ", "×", "²", "½", "\xa0", "\xad", "ǅ", "İ", "̱", "́", "̸", "’", "“", "=", "...", "**", "'", "7", "04", " ", "\n", "\x1d", "\x7f", "Σ"])

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.lists(parts, max_size=12).map("".join), max_size=4))
    def same(texts):
        _same(["", *texts], public_tokenizers.path(binary_ids.TOKENIZER))

    same()


def test_a_tokenizer_with_other_rules(tmp_path):
    with open(public_tokenizers.path(binary_ids.TOKENIZER), encoding="utf-8") as file:
        rules = json.load(file)
    rules["normalizer"]["normalizers"].pop()
    path = tmp_path / "capitals.json"
    path.write_text(json.dumps(rules))
    _same(["Some Words, some WORDS. It's <|endoftext|> É 12", ""], str(path))
