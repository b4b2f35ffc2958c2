"""Token counts by piece against the library's counts of whole texts."""

from __future__ import annotations

import random

import public_tokenizers
import pyarrow as pa
import pytest

from veraframe.llm import token_counts
from veraframe.llm.common import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
BLANKS = [chr(c) for c in (9, 10, 11, 12, 13, 28, 31, 32, 0x85, 0xA0, 0x1680, 0x180E, 0x2000, 0x200A, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
ODD = [*BLANKS, *"aesS'tlr12.,!_-\xe9\xf1\u0301\xb2\u4e2d\u3042\u2026\u201d\u2014\U0001f600\0\x7f", "'s", "'ll", "<|endoftext|>", "<|endof", "text|>", " <|", " the"]


class Spy:
    """A tokenizer that notes the texts which it encodes."""

    def __init__(self, tok):
        self.tok, self.seen = tok, []

    def __getattr__(self, name):
        return getattr(self.tok, name)

    def encode_batch_fast(self, texts, **options):
        self.seen += texts
        return self.tok.encode_batch_fast(texts, **options)


def odd_texts(n: int) -> list[str]:
    rng = random.Random(n)
    return ["".join(rng.choices(ODD, k=rng.choice([0, 1, 2, 5, 20, 60]))) for _ in range(n)]


@pytest.mark.parametrize("most", [1 / 3, 1])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_are_the_library_s(monkeypatch, name, most):
    monkeypatch.setattr(token_counts, "MOST_MISSES", most)
    tok, kept = token_counts.loaded(public_tokenizers.path(name)), {}
    for n in (1, 700, 3000):
        texts = odd_texts(n)
        got = token_counts.count_texts(tok, pa.array(["é pad", *texts, "pad"])[1:-1], kept)
        assert got.tolist() == [len(tok.encode(t, add_special_tokens=False)) for t in texts]
    assert token_counts.count_texts(tok, pa.array([], pa.string()), kept).tolist() == []


def test_every_low_code_point_beside_cuts(monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_MISSES", 1)
    tok = token_counts.loaded(PATH)
    texts = [f"a{chr(c)} b{chr(c)}{chr(c)}\n {chr(c)}'s1{chr(c)}.x" for c in range(0x3100)]
    assert token_counts.count_texts(tok, pa.array(texts), {}).tolist() == token_counts.encoded_lengths(tok, texts)


def test_repeated_words_are_encoded_once():
    spy, kept = Spy(token_counts.loaded(PATH)), {}
    texts = [" ".join(["governed", "media,", f"set{i % 7}"] * 200) for i in range(50)]
    for _ in range(2):
        got = token_counts.count_texts(spy, pa.array(texts), kept)
        assert got.tolist() == [len(spy.tok.encode(t, add_special_tokens=False)) for t in texts]
    assert len(spy.seen) == len(set(spy.seen)) < 20


def test_texts_whose_words_never_repeat_go_whole():
    spy, texts = Spy(token_counts.loaded(PATH)), [" ".join(f"{chr(97 + i)}{chr(97 + j)}q" for j in range(26)) for i in range(26)]
    got = token_counts.count_texts(spy, pa.array(["pad", *texts])[1:], {})
    assert got.tolist() == [len(spy.tok.encode(t, add_special_tokens=False)) for t in texts]
    assert spy.seen == texts


def test_kept_counts_are_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_PIECES", 3)
    monkeypatch.setattr(token_counts, "MOST_MISSES", 1)
    tok, kept, texts = token_counts.loaded(PATH), {}, odd_texts(200)
    assert token_counts.count_texts(tok, pa.array(texts), kept).tolist() == token_counts.encoded_lengths(tok, texts)
    assert len(kept) == 3


def test_query_counts_special_strings_and_long_texts(spark):
    tok = token_counts.loaded(PATH)
    texts = [None, "", "a <|endoftext|> b", "don't <|endoftext|>", "x" * 70_000, "wort étre \n 12 " * 9000, *odd_texts(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, PATH, new_path(spark, "cache")).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}
