import re

from loomery.llm import pii


def test_names_without_the_words_beside_them():
    """given names of the longer list are found, and words beside a name are no part of it."""
    field = pii.train(count=2000, epochs=6)
    given = {w for w, k in field.encoder.lexicon.items() if k == 1}
    assert {"teresa", "henrik", "tobias"} <= given
    for text, whole, name in (("now Marta Dalwick", "now Marta Dalwick", "Marta Dalwick"), ("Reach Felix Cassen", "Reach Felix Cassen", "Felix Cassen"), ("Teresa already", "Teresa already", "Teresa"), ("Anna de Vries", "Anna de Vries", "Anna de Vries")):
        a, b = re.search(whole, text).span()
        got = pii._trimmed(text, a, b, given, {"reach": 1})
        assert text[slice(*got)] == name
