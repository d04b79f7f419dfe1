"""Clean-up of texts."""

from strandline.llm.text import folded, plain, repair, sentences


def test_text():
    assert repair("La policÃ­a cerrÃ³") == "La policía cerró" and folded("Ünï 12 x") == "uni 00 x" and plain("<p>a&nbsp;b http://x/y</p>") == "a b"
    assert plain(f"a <a title='{'x' * 500}'>b</a> 1 < 2 > 1") == "a b 1 < 2 > 1"
    assert sentences("One. Two!\nThree") == ["One.", "Two!", "Three"]
