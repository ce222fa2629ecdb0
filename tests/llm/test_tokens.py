"""Token counts and word streams against plain Python."""

import os
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.llm.tokens import count_tokens, document_sizes
from tidegauge.llm.words import Vocabulary, hash_words, undisguised

TOKEN = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]+")
TEXT = st.text(alphabet=st.sampled_from("ab_1 \t\r\n.,;é日\x0b (){}"), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(TEXT, st.none()), max_size=8), st.integers(0, 3), st.booleans())
def test_counts(texts, skip, large):
    arr = pa.array(texts, pa.large_string() if large else pa.string())[skip:]
    assert list(count_tokens(arr)) == [len(TOKEN.findall(t or "")) for t in texts[skip:]]


def test_long_texts():
    texts = ["a b " * 3_000_000, "", "x", "é," * 100_000]
    assert list(count_tokens(pa.array(texts))) == [len(TOKEN.findall(t)) for t in texts]


def test_document_sizes(spark):
    df = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7), (2, None, 7), (None, "x", 7), (3, "", 7)], "doc_id bigint, text string, tokens int")
    assert sorted(map(tuple, document_sizes(df).collect())) == [(1, 2), (2, 0), (3, 0)]


def test_vocabulary(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabulary files here")
    df = spark.createDataFrame([(1, "Hello world, hello"), (2, None), (3, ""), (4, "x = 10\n")], "doc_id bigint, text string")
    got = dict(map(tuple, document_sizes(df, ranks_path=path).collect()))
    assert got[1] == 4 and got[2] == got[3] == 0 and got[4] == 4


def _hashes(*texts, leet=False):
    raw = "".join(texts).encode()
    ends = np.cumsum([0] + [len(t.encode()) for t in texts])
    return hash_words(np.frombuffer(raw, np.uint8), ends, leet)


def test_words():
    words, counts = _hashes("Hello fooBar", "", "HELLO, foo_bar x 12", "helloooo")
    assert list(counts) == [3, 0, 3, 1]
    assert list(words[:3]) == list(words[3:6]) and words[0] == words[6]
    assert _hashes("id10t", leet=True)[0][0] == _hashes("idiot")[0][0]
    assert list(_hashes("ab", "ab")[1]) == [1, 1]
    assert len(_hashes("")[0]) == 0 and len(_hashes("12 ,;")[0]) == 0


def test_disguises():
    v = Vocabulary(["nobody", "miss", "you", "widget", "no", "stupid", "the"])
    u = lambda t: undisguised(t, v, True, True)
    assert u("n**ody m*ss y*u a*b") == "nobody miss you a*b"
    assert u("s t u p i d w i d g e t") == "stupid widget"
    assert u("hot&nbsp;st​ripe x") == "hot stripe x"
    assert u("аbcе") == "abce" and u("no%20you") == "no you" and u("\\u0061\\x62") == "ab"
