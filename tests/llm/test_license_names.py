"""Notices get the name and version that they state; clean sentences that share their words are no notices."""

import pytest

from vigil.llm import licenses
from vigil.llm.words import alnum, word_hashes

WORDS, INDEX = licenses.build_index(licenses.TEMPLATES)


def names(text):
    import numpy as np

    h, _, _ = word_hashes([text], alnum)
    found = licenses.scan(h, WORDS, INDEX, np.array(sorted(INDEX), np.uint64), licenses.MIN_COVER, licenses.marks_of(licenses.TEMPLATES))
    return [licenses.TEMPLATES[k][0] for k, *_ in found]


@pytest.mark.parametrize("text", [
    "The album was released under the name of the band in May.", "It was released under the old title by a label.", "Released under the BSD License.",
    "This work is licensed under the GNU General Public License, version 2.", "Licensed under CC BY 3.0.", "All files licensed under CC terms here.",
    "Licensed under CC BY-ND 4.0.", "Licensed under the Apache License, Version 1.1.", licenses.TEMPLATES[5][1].replace("version 3", "version 4"),
    licenses.TEMPLATES[7][1].replace("version 3", "version 2.1"), licenses.TEMPLATES[5][1].replace("GNU General", "GNU Affero General"),
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."])
def test_other_sentences_and_versions_are_not_named(text):
    assert names(f"Some words first. {text} And more words after it.") == []


@pytest.mark.parametrize("number", range(len(licenses.TEMPLATES)))
def test_every_template_has_its_own_name(number):
    name, text, _ = licenses.TEMPLATES[number]
    assert names(f"Some words first. {text} And more words after it.") == [name]


def test_edited_notices_keep_their_names():
    whole = {t[0]: t[1] for t in licenses.TEMPLATES[17:]}
    assert names("Licensed under the MIT License.") == ["MIT"]
    assert names(whole["BSD-3-Clause"].replace("the copyright holder nor", "Acme Widgets Inc. nor").replace("1. ", "* ")) == ["BSD-3-Clause"]
    assert names(whole["BSD-2-Clause"].replace("HOLDERS AND CONTRIBUTORS", "OWNERS")) == ["BSD-2-Clause"]
    assert names(whole["MIT"].replace("AUTHORS OR COPYRIGHT HOLDERS", "X CONSORTIUM")) == ["MIT"]
