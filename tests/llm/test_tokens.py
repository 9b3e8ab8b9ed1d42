"""What a tokenizer's worker remembers: ids stay right when it is put aside, and what is met again isn't learned anew."""

import gc

import numpy as np
import pytest

from panelweave.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize(("name", "style"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_units_met_again_are_not_learned_anew(name, style, monkeypatch):
    monkeypatch.setattr(tokens, "PARTS", 5)
    tok, learned = tokens.MemoTokenizer(public_tokenizers.path(name), style, memo=8), []
    learn = tok.learn
    tok.learn = lambda new: (learned.extend(new), learn(new))
    often = "the often met words, again"
    texts = [f"{often} {a}x{a} {a}y, {a}z" for a in "abcdefghijkl"] + ["", often]
    for text in texts:
        want = tok.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tok.encode([text])[0], tok.code).tolist() == want
    assert len(learned) == len(set(learned))  # nothing twice of what comes in every text
    assert len(tok.known) + len(tok.known_before) < len(learned)  # and not all is kept


@pytest.mark.parametrize(("name", "style"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_a_word_is_learned_once_whatever_signs_follow(name, style):
    tok, learned = tokens.MemoTokenizer(public_tokenizers.path(name), style), []
    learn = tok.learn
    tok.learn = lambda new: (learned.extend(new), learn(new))
    texts = [f"The garden{x} élevé{x} for" for x in (",", ".", "!!", "###", "&&&", ";", ":", "?")]
    for text, raw in zip(texts, tok.encode(texts)):
        assert np.frombuffer(raw, tok.code).tolist() == tok.tokenizer.encode(text, add_special_tokens=False).ids
    assert sum("garden" in x for x in learned) == sum("élevé" in x for x in learned) == 1


@pytest.mark.parametrize(("name", "style"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_units_of_odd_texts_give_the_library_s_ids(name, style):
    rng, tok = np.random.default_rng(7), tokens.MemoTokenizer(public_tokenizers.path(name), style)
    often = [*"aZst'.,#<|=>`^~09", " ", "\n", "é", "×", "÷", "ª", "²", "Σ", "İ", "ß", "…", "\u0338", "\u0301", "語", "🙂", "don't"]
    seldom = ["\u0085", "\xa0", "\t", "\0", "  ", "<|endoftext|>"]
    for _ in range(40):
        texts = ["".join((often * 5 + seldom)[k] for k in rng.integers(0, 5 * len(often) + len(seldom), n)) for n in rng.integers(0, 40, 50)]
        for text, raw in zip(texts, tok.encode(texts)):
            assert np.frombuffer(raw, tok.code).tolist() == tok.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert tok.encode([]) == []
    assert tok.encode(["", ""]) == [b"", b""]


def test_collection_is_resumed():
    assert gc.isenabled()
    with pytest.raises(ZeroDivisionError), tokens.uncollected():
        assert not gc.isenabled()
        1 / 0
    assert gc.isenabled()
