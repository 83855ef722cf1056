import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantgap.llm import token_counts as t
from tests.llm.helpers import docs, prose, rows

SMALL = {"a": -1.0, "b": -1.5, "ab": -1.2, "abc": -4.0, "bc": -2.0, t.LEAD: -1.0, t.LEAD + "a": -1.1, "é": -3.0}


def best(token, vocabulary):
    """Best score and number of pieces, from every way to divide the token."""
    if not token:
        return 0.0, 0
    ways = []
    for cut in range(len(token)):
        score, number = best(token[:cut], vocabulary)
        if token[cut:] in vocabulary:
            ways.append((score + vocabulary[token[cut:]], number + 1))
        elif cut == len(token) - 1:
            size = len(token[cut:].encode())
            ways.append((score + t.BYTE_SCORE * size, number + size))
        if cut == len(token) - 1:
            size = len(token[cut:].encode())
            ways.append((score + t.BYTE_SCORE * size, number + size))
    return max(ways, key=lambda w: (round(w[0], 9), -w[1]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcé" + t.LEAD, min_size=1, max_size=9), max_size=12))
def test_counts_equal_all_divisions(tokens):
    assert t.count_pieces(tokens, SMALL, 3) == {w: best(w, SMALL)[1] for w in set(tokens)}


def test_pre_tokens_lose_nothing():
    text = " Héllo, wörld 42nd  a_b\n\t— ok"
    assert "".join(t.pre_tokens(text)) == t.LEAD + t.LEAD.join(text.split())
    assert t.pre_tokens("") == t.pre_tokens(" \n") == []


def test_rows_and_small_cache(spark, monkeypatch):
    texts = [None, "", "ab abc", "ab abc", prose(1, 20_000), "éé"]
    want = [sum(best(w, SMALL)[1] if len(w) < 12 else 0 for w in t.pre_tokens(x or "")) for x in texts]
    got = rows(t.count_tokens(docs(spark, texts, [1, 2, 3, 3, 4, None]), vocabulary=SMALL), "n_pre_tokens", "n_tokens")
    assert [n for _, n in got] == want and got[0] == got[1] == (0, 0)
    assert t.count_tokens(docs(spark, texts).limit(0), vocabulary=SMALL).count() == 0


@pytest.mark.skipif(not os.path.exists(t.VOCABULARY), reason="needs the public vocabulary")
def test_agrees_with_a_unigram_tokenizer():
    from tokenizers import Tokenizer, models

    vocabulary = t.read_vocabulary()
    model = Tokenizer(models.Unigram([("<unk>", -100.0), *vocabulary.items()], unk_id=0))
    words = [w for w in t.pre_tokens("The quick brown fox doesn't jump over 1234 lazy dogs; internationalisation.") if all(ch in vocabulary for ch in w)]
    assert t.count_pieces(words, vocabulary, 16) == {w: len(model.encode(w).ids) for w in set(words)}
