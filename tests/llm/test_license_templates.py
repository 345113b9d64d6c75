import pytest

from textquarry.llm.license_templates import TEMPLATES, Matcher, find_licenses, parse, report, word_list


def spans(markup, text):
    return [s[:2] for s in Matcher((("x", markup),)).spans(word_list(text.encode()))]


@pytest.mark.parametrize(
    "markup, text, found",
    [
        ("a b c", "A, b; c!", [(0, 3)]),
        ("a b c", "a b d c", []),
        ("a [[b [[c]]]] d", "a d a b d a b c d a c d", [(0, 2), (2, 5), (5, 9)]),
        ("a {{b|c d|}} e", "a e a b e a c d e a c e", [(0, 2), (2, 5), (5, 9)]),
        ("a {{*2}} b", "a b a x b a x y b a x y z b", [(0, 2), (2, 5), (5, 9)]),
        ("a {{*2}} b", "a b b b b", [(0, 4)]),
        ("a b [[c]]", "a b c a b", [(0, 3), (3, 5)]),
        ("a b", "a a b", [(1, 3)]),
        ("[[a]] b", "a b", [(0, 2), (1, 2)]),
    ],
)
def test_markup(markup, text, found):
    assert spans(markup, text) == found


@pytest.mark.parametrize("markup", ["a [[b", "a ]] b", "a {{b", "a } b"])
def test_unbalanced_markup_is_refused(markup):
    with pytest.raises(ValueError):
        parse(markup)


@pytest.mark.parametrize("markup", ["{{*2}} a", "[[a]]", ""])
def test_templates_begin_with_a_word(markup):
    with pytest.raises(ValueError):
        Matcher((("x", markup),))


def test_words_lower_case_ascii_only():
    assert word_list("Ab-ÄÖ\x00x\x7fy KK 日本　z".encode()) == [w.encode() for w in ("ab", "ÄÖ", "x", "y", "kK", "日本　z")]


def test_one_changed_word_of_the_mandatory_wording_is_no_license(make):
    text = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n" \
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n" \
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the" \
        " documentation and/or other materials provided with the distribution.\n3. Neither the name of Some Body nor the names of its contributors may be" \
        " used to endorse or promote products derived from this software without specific prior written permission."  # fmt: skip
    docs = make([(1, text), (2, text.replace("1. ", "").replace("Some Body", "X")), (3, text.replace("retain", "keep")), (4, "x " * 100_000 + text), (5, text + "\n" + text)])
    assert {r.doc_id: r.labels for r in report(docs).collect()} == {1: "bsd-3-clause", 2: "bsd-3-clause", 3: "", 4: "bsd-3-clause", 5: "bsd-3-clause"}
    places = {r.doc_id: [s.start for s in r.spans] for r in find_licenses(docs).collect()}
    assert places[4] == [100_000] and len(places[5]) == 2


def test_notices(make):
    texts = ["Released under the MIT License.", "the MIT license", "licensed under CC BY-NC 4.0", "licensed under CC BY-ND 4.0", "GNU General Public License", "mit", None, ""]
    found = {r.doc_id: (r.labels, r.score, r.n_base) for r in report(make(list(enumerate(texts)))).collect()}
    assert found == {0: ("mit", 1.0, 1), 1: ("mit", 0.5, 1), 2: ("cc-by-nc-4.0", 1.0, 0), 3: ("", 0.0, 0), 4: ("gpl", 0.5, 1), 5: ("", 0.0, 0), 6: ("", 0.0, 0), 7: ("", 0.0, 0)}


def test_given_templates_parse():
    assert all(parse(markup) for _, markup in TEMPLATES)
