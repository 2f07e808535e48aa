import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakeloom.llm.token_counts import PrefixCounts, RunningCount, WordPrefixes, token_prefixes
from lakeloom.llm.tokens import WordMemory

from .helpers import by_id

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", "  ", "\n\n a", "The unbelievable HOUSES, running!!! away.*** now",
    "it's don't ''s !'s <|endoftext|> a<|startoftext|>b <|endof", "ÀÉÎ ŉ İstanbul ΣΑΣ ς café café x́̂",
    "日本語テキスト です。", "a\tb\r\nc d e", "ab12 3.14 x_y foo-bar (x) \"q\" ªº ß ẞ ﬁ", "\x00\x1c\x1d\x85 😀😀 👨‍👩‍👧",
    "Straße. ÖÄÜ!! réeuxment ungeheuerlichkeiten", "aaaaaaaaaaaaaaaaaaaaaaaaaa bababababababa", "x" * 500,
]


@pytest.fixture(scope="module")
def parts():
    library, inside = Tokenizer.from_file(PATH), WordPrefixes(PATH)
    return library, WordMemory(PATH), inside, RunningCount(library, inside)


@pytest.mark.parametrize("text", TEXTS)
def test_every_prefix_like_the_library(parts, text):
    library, memory, inside, running = parts
    table = PrefixCounts(text, memory, inside, lambda: running)
    want = [len(library.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
    assert [table.at(p) for p in range(len(text) + 1)] == want
    assert table.total == want[-1]
    for limit in {0, 1, 3, want[-1] // 2, want[-1]}:
        assert table.fit(limit) == max(p for p, c in enumerate(want) if c <= limit)


MORE = [
    "https://example.org/a_b?q=1&r='re'real''ll'lo've'v", "we'll've'd'm 'twas 'rest 'l 'v", "1234567890½²٣", "Ελληνικάκείμενα123",
    "한국어텍스트", "한글", "ậḅ̂̄", "a　b c\td",
    "!!<|endoftext|>'s<|endoftext|><|endoftext", "x<|startoftext|>́y", "KÅΩक़", "👩🏽‍🚀👍🏿", "İİıİ",
]


@pytest.mark.parametrize("text", MORE)
def test_every_prefix_of_other_scripts(parts, text):
    library, _, _, running = parts
    want = [len(library.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
    assert running.every_prefix(text) == want


def test_every_prefix_of_random_text(parts):
    library, _, _, running = parts
    rng = random.Random(3)
    signs = "aerstlvdm'''' 1é中文字ñ́̂한αΣ!<|.😀\tÅ"
    for _ in range(400):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(30)))
        want = [len(library.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
        assert running.every_prefix(text) == want, text


@pytest.mark.parametrize("signs", ["漢字仮名交文章", "ά", "7", "a1"])
def test_long_unbroken_text_takes_time_in_proportion(parts, signs):
    library, memory, inside, running = parts
    rng = random.Random(1)
    text = "".join(rng.choice(signs) for _ in range(100_000))
    began = time.perf_counter()
    fit = PrefixCounts(text, memory, inside, lambda: running).fit(2048)
    assert time.perf_counter() - began < 10
    count = [len(library.encode(text[:p], add_special_tokens=False).ids) for p in (fit, fit + 1)]
    assert count[0] <= 2048 < count[1]


def test_repeated_rows_and_clashing_columns(docs):
    rows = docs((1, "漢字 x"), (1, "漢字 x"), (2, "y")).selectExpr("*", "1 as n_tokens", "2 as ends", "3 as fit_chars")
    got = sorted((r["doc_id"], r["n_tokens"]) for r in token_prefixes(rows, PATH).collect())
    assert [i for i, _ in got] == [1, 1, 2] and got[0] == got[1]


def test_query_rows(docs, parts):
    library = parts[0]
    rows = [*enumerate(TEXTS), (100, None), (101, "word " * 3000), (None, "x")]
    got = by_id(token_prefixes(docs(*rows), PATH, limit=2048, keep_table=True))
    assert len(got) == len(rows)
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["n_bytes"] == len((text or "").encode())
        assert got[i]["over_limit"] == (len(ids) > 2048)
    assert got[101]["fit_chars"] == 2048 * 5
    assert token_prefixes(docs(*rows).limit(0), PATH).collect() == []
