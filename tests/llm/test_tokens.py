import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chainlog.llm import tokens
from chainlog.llm.queries import TOKENIZERS

VOCABULARIES = [(f"{TOKENIZERS}/byte_bpe_50k.json", "u4"), (f"{TOKENIZERS}/word_bpe_49k.json", "u2")]
ODD = [None, "", " ", "\n", "a b", " a", "a ", "a\n", "\na", "a  b", "a\n\nb", "a \n b", "a\tb c", "x<|endoftext|>y z", "a\0b c", "naïve ÉTÉ straße İstanbul ΣΑΣ. ΑΣ", "1,000.50 €,", "***", "*** x ***\n***", "y$$$ x€, don't' 's x's' 'tis\n's", "a_b_ _c [d] (e) {f}~ 5% ²! e\u0301! a", "\u2003a", "a\u3000b"]


@pytest.mark.parametrize(("path", "dtype"), VOCABULARIES)
def test_texts_encoded_together_give_the_librarys_ids(path, dtype, monkeypatch):
    monkeypatch.setattr(tokens, "TEXT_BYTES", 40)
    monkeypatch.setattr(tokens, "MAX_PIECES", 20)
    tool = tokens.Pieces(path, dtype)
    for texts in (pa.array(ODD), pa.array(ODD).slice(3), pa.array(ODD, pa.large_string()), pa.array([], pa.string()), pa.array([None], pa.string())):
        assert list(tool.encode_all(texts)) == [tool.plain(t or "") for t in texts.to_pylist()]
    letters = pa.array([f"{chr(c)} a{chr(c)}b {chr(c)}. a{chr(c)}*" for c in range(1, 0x250)])
    assert list(tool.encode_all(letters)) == [tool.plain(t) for t in letters.to_pylist()]

    @given(st.lists(st.none() | st.text(alphabet=st.sampled_from("ab.,'$_ \nÉßΣ\u0301İZ9-"), max_size=50), max_size=8))
    @settings(max_examples=300, deadline=None)
    def same(texts):
        want = [tool.plain(t or "") for t in texts]
        assert list(tool.encode_all(pa.array(texts, pa.string()))) == want == [tool.encode(t or "") for t in texts]

    same()


@pytest.mark.parametrize(("path", "dtype"), VOCABULARIES)
def test_the_library_is_asked_once_for_each_word_whatever_marks_follow(path, dtype, monkeypatch):
    tool, asked = tokens.Pieces(path, dtype), []
    monkeypatch.setattr(tool, "plain", lambda text, f=tool.plain: asked.append(text) or f(text))
    monkeypatch.setattr(tool, "merged", lambda word, f=tool.merged: asked.append(word) or f(word))
    words = [a + b for a in ("ver", "cht", "ion", "the") for b in ("an", "ed", "is", "ou")]
    for mark in ("", ".", ",", "***", "$$", "?!"):
        tool.encode("so " + " ".join(w + mark for w in words))
    assert len(asked) <= len(words) + 1 + 5


def test_words_in_use_stay_known_when_others_are_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_PIECES", 20)
    tool, asked = tokens.Pieces(*VOCABULARIES[0]), []
    monkeypatch.setattr(tool, "merged", lambda word, f=tool.merged: asked.append(word) or f(word))
    for i in range(26 * 4):
        tool.encode(f"x the {chr(97 + i % 26)}{chr(97 + i // 26)}q")
        assert len(tool) + len(tool.old) <= 20
    assert asked.count(" the") == 1
