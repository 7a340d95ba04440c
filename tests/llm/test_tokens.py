import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm.tokens import VOCABULARY, Encoder, RankQueue, encode, token_counts

pytestmark = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="the vocabulary file is not here")


@pytest.fixture(scope="module")
def own():
    return Encoder(VOCABULARY)


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(Path(VOCABULARY).with_suffix(".json")))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_against_the_public_library(own, public):
    @settings(max_examples=300, deadline=None)
    @given(st.text(st.characters(exclude_categories=("Cs", "Cn", "Co")), max_size=60) | st.text("ab' \n.", max_size=200))
    def check(text):
        assert own.encode(text) == public(text)

    check()


@pytest.mark.parametrize(
    "text",
    ["<|endoftext|>", "a<|endoftext|>b", " ", "\r\n\t ", "x" * 30_000, "ab" * 20_000, "é" * 9000, "=" * 9000, "你好" * 5000, "👩‍👩‍👧‍👦🇦🇶 ﷺ ﬁ", "don't we'll I'd"],
)
def test_special_and_long_texts(own, public, text):
    assert own.encode(text) == public(text)


def test_random_long_pre_token(own, public):
    text = "".join(random.Random(1).choices("abcdeéß", k=40_000))
    assert own.encode(text) == public(text)


def test_rank_queue_takes_the_lowest_first():
    pick = random.Random(2)
    queue, entries = RankQueue(60_000), []
    for i in range(3000):
        entries.append((pick.choice([0, 63, 64, 4095, 4096, 59_999, pick.randrange(60_000)]), i))
        queue.push(*entries[-1])
    got = []
    while (lowest := queue.pop()) is not None:
        got += [(lowest[0], p) for p in lowest[1]]
    assert got == sorted(entries)


def test_tables(spark, own):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello world", "x"), (3, "Hello world", "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, ids STRING")
    got = sorted(((r.doc_id, list(r.ids)) for r in encode(df).collect()), key=str)
    assert got == sorted([(1, []), (2, []), (3, own.encode("Hello world")), (3, own.encode("Hello world")), (None, own.encode("a"))], key=str)
    assert encode(df.limit(0)).count() == 0
    assert sorted(r.n_tokens for r in token_counts(df).collect()) == [0, 0, 1, 2, 2]
