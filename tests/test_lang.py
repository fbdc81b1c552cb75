import pytest

from textloom.functions.analysis import osa, terms
from textloom.functions.stem import english, russian
from textloom.plans import lang
from textloom.plans.lang import CONTENT, FUZZY, NAME, PHRASE, PREFIX, WORD, Clause, highlight_words, literal_terms, narrowed, parse, split


def test_split_keeps_quotes_together():
    assert split('a "b c" «d e» f') == ["a", '"b c"', '"d e"', "f"]
    assert split('x "open to the end') == ["x", '"open to the end']
    assert split("   ") == []


def test_groups_and_alternatives():
    p = parse("a OR b c || d e")
    assert [[c.text for c in g] for g in p.groups] == [["a", "b"], ["c", "d"], ["e"]]
    assert [[c.text for c in g] for g in parse("OR a b").groups] == [["a"], ["b"]]
    # OR waits across a negated clause for the next positive one
    p = parse("a OR -b c")
    assert [[c.text for c in g] for g in p.groups] == [["a", "c"]] and [c.text for c in p.negatives] == ["b"]


@pytest.mark.parametrize("query", ["-x", "!x", "NOT x", "NOT -x"])
def test_negation(query):
    p = parse(query)
    assert not p.groups and [c.text for c in p.negatives] == ["x"]


def test_signs_without_words_are_words():
    assert parse("!!!").groups == [[Clause(WORD, "!!!")]]
    assert parse("+a").groups == [[Clause(WORD, "a")]]
    assert parse("AND").groups == [[Clause(WORD, "AND")]]


def test_scopes_types_and_kinds():
    assert parse("имя:отчёт").groups == [[Clause(WORD, "отчёт", NAME)]]
    assert parse("name:text:x").groups == [[Clause(WORD, "text:x", NAME)]]
    assert parse("ext:.Docx, тип:pdf,,xls").exts == ["docx", "pdf", "xls"]
    assert parse("-ext:pdf a").exts == []
    assert parse('"a b"~2').groups == [[Clause(PHRASE, 'a b"~2')]]
    assert parse('""').groups == []
    assert parse("w~").groups == [[Clause(FUZZY, "w", distance=1)]]
    assert parse("w~9").groups == [[Clause(FUZZY, "w", distance=2)]]
    assert parse("w~0").groups == [[Clause(FUZZY, "w", distance=1)]]
    assert parse("w~x w~999").groups == [[Clause(WORD, "w~x")], [Clause(WORD, "w~999")]]
    assert parse("w* *").groups == [[Clause(PREFIX, "w")], [Clause(WORD, "*")]]


def test_mode_replaces_only_the_open_scope():
    p = narrowed(parse("a name:b -c"), "content")
    assert [g[0].scope for g in p.groups] == [CONTENT, NAME] and p.negatives[0].scope == CONTENT
    assert narrowed(parse("a"), "all").groups[0][0].scope == lang.ANY


def test_highlights():
    words, prefixes = highlight_words(parse("отчёты срок* name:x -y"), lambda t, s: terms(t, s))
    assert prefixes == ["срок"] and "отчет" in words and "отчеты" in words and "x" not in words
    assert literal_terms(parse('A name:b "C d" -e')) == ["a", "c d"]


def test_analysis():
    assert terms("INV-774411 v2", True) == ["inv", "774411", "v2"]
    assert terms("Пётр арендаторами") == ["петр", "арендатор"]
    assert terms("happy happiness", True) == ["happy", "happi"]  # a stem as long as its word is not used
    assert terms("x" * 60) == [] and terms("") == []
    assert terms("मकान") == ["मकान"]


@pytest.mark.parametrize(
    "word,stem",
    [("consignment", "consign"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("skies", "sky"), ("generously", "generous"), ("caresses", "caress"), ("ties", "tie"), ("agreed", "agre"), ("knightly", "knight")],
)
def test_english(word, stem):
    assert english(word) == stem


@pytest.mark.parametrize("word,stem", [("договорами", "договор"), ("важнейший", "важн"), ("вавиловка", "вавиловк"), ("падение", "паден"), ("новость", "новост"), ("красивейшая", "красив"), ("читавшийся", "чита")])
def test_russian(word, stem):
    assert russian(word) == stem


def test_edits():
    assert osa("abcd", "abdc", 2) == 1 and osa("ca", "abc", 3) == 3 and osa("kitten", "sitting", 3) == 3 and osa("a", "abcdef", 2) == 3 and osa("", "", 1) == 0
