import public_tokenizers
import pytest

from inkwell.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "it's 12 <|endoftext|> ok  \n\n x", "wörd ñ 中文 " * 50, "no-spaces" * 400,
    "The quick brown fox " * 2000, "tabs\tand   runs  of   space \n" * 300, "The quick brown fox " * 2000,
]


def plain(text):
    return len(tokens.load_tokenizer(PATH).encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("part", [1, 7, 64, 1 << 16])
def test_parts_keep_the_count(part):
    for t in TEXTS[1:]:
        parts = tokens.safe_parts(t, part)
        assert "".join(parts) == t
        assert sum(map(plain, parts)) == plain(t)


def test_counts_match_the_library(spark):
    rows = [(i % 7, t, "clash") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = tokens.over_limit(tokens.count_tokens(df, PATH, batch_bytes=1000, part_chars=50)).collect()
    want = [(i, len((t or "").encode()), plain(t), plain(t) > 1024) for i, t, _ in rows]
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.count_tokens(df, PATH).count() == 0
