import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import bpe
from inkwell.llm.lexicon import Lexicon, compile_lexicon
from inkwell.llm.tokens import load_tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "aAbzéÉÑñßΣσς中文’'s1 2\t\n\x0b\x1c\x1f\x85\xa0 ́​İI.,!<|>endoftxtsar"
TEXTS = [
    None, "", "  \n ", "it's ÉTÉ été 12,345 <|endoftext|>tail <|startoftext|> ΣΑΣ İx", "x\x1cy z\x1f w",
    "word " * 3000, "a" * 5000, "́mark first", "word " * 3000, "  a　b c",
]


def plain(text):
    return load_tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_lexicon_is_minimal_and_exact():
    words = [a + b + c for a in ("", "x", "yy") for b in ("walk", "talk", "é") for c in ("", "ing", "ed", "s")]
    entries = {w.encode(): [i, i + 1][: 1 + i % 2] for i, w in enumerate(words)}
    lex = Lexicon(compile_lexicon(entries))
    probe = [*entries, b"wal", b"walkin", b"zzz", b"", b"walkss"]
    want = [np.array(entries[w], "<u4").tobytes() if w in entries else None for w in probe]
    assert lex.lookup(probe) == want
    trie = {w[:i] for w in entries for i in range(len(w) + 1)}
    assert lex.states < len(trie) / 3  # suffixes are shared
    empty = Lexicon(compile_lexicon({}))
    assert empty.lookup([b"a", b""]) == [None, None]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40) | st.text(max_size=20), max_size=5))
def test_encoder_equals_the_library(texts):
    lex = compile_lexicon({w.encode(): plain(w) for t in texts[:2] for w in bpe.words_of(t)})
    enc = bpe.Encoder(PATH, lex)
    for t, raw in zip(texts, enc.encode(texts), strict=True):
        assert ids(raw) == plain(t)
        assert enc.decode(raw) == load_tokenizer(PATH).decode(plain(t), skip_special_tokens=False)


def test_round_trip_digests(spark):
    df = spark.createDataFrame([(i % 6, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    lex = bpe.build_lexicon(df, PATH, max_words=40)
    assert 0 < len(__import__('inkwell.llm.lexicon').llm.lexicon.Lexicon(lex.value).offsets) <= 41
    got = sorted(map(tuple, bpe.round_trip(df, PATH, lex, batch_bytes=64).collect()))
    dec = load_tokenizer(PATH).decode
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((i % 6, len(plain(t)), sha(np.array(plain(t), "<u4").tobytes()), sha(dec(plain(t), skip_special_tokens=False).encode())) for i, t in enumerate(TEXTS))
    assert got == want
    e = bpe.encode(df, PATH, lex)
    back = sorted((r.doc_id, r.text) for r in bpe.decode(e, PATH).collect())
    assert back == sorted((i % 6, dec(plain(t), skip_special_tokens=False)) for i, t in enumerate(TEXTS))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(df, PATH, bpe.build_lexicon(df, PATH)).count() == 0


def test_batch_merges_equal_the_library():
    enc = bpe.Encoder(PATH)
    assert enc.batch is not None
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghijklmnoprstuéñß'!1"), rng.integers(1, 60))) for _ in range(5000)]
    for w, raw in zip(words, enc.merge(words), strict=True):
        assert ids(raw) == plain(w)
