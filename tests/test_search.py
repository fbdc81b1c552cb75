import pytest

from textloom.operators import index, search, snippets
from textloom.operators.search import Options

FILES = [
    ("d:/договоры/contract.docx", "D:\\Договоры\\contract.docx", "contract", "docx", "D:\\Договоры", "Договор аренды; Иванов", 100, 1000),
    ("d:/договоры/contract.pdf", "D:\\Договоры\\contract.pdf", "contract", "pdf", "D:\\Договоры", None, 200, 2000),
    ("d:/отчёты/sales.xlsx", "D:\\Отчёты\\sales.xlsx", "sales", "xlsx", "D:\\Отчёты", "Продажи", 300, 3000),
    ("d:/отчёты/sales.xls", "D:\\Отчёты\\sales.xls", "sales", "xls", "D:\\Отчёты", None, 400, None),
    ("d:/презентации/strategy.pptx", "D:\\Презентации\\strategy.pptx", "strategy", "pptx", "D:\\Презентации", None, 500, 5000),
    ("d:/презентации/ноль", "D:\\Презентации\\ноль", "ноль", None, "D:\\Презентации", None, 0, 6000),
]
CONTENTS = [
    ("d:/договоры/contract.docx", "Договор аренды № 42. Арендатор платит в срок действия договора. Пётр Кракозябровая. Казань.", ["a"]),
    ("d:/договоры/contract.pdf", "Договор аренды. Арендаторы и срок действия. Кракозябровая.", ["Стр. 1"]),
    ("d:/отчёты/sales.xlsx", "Тюльпаны голландские INV-774411\fQuarterly revenue Ромашка", ["Лист «Продажи»", "Лист «Sheet2»"]),
    ("d:/отчёты/sales.xls", "Тюльпаны Ромашка действия срок", None),
    ("d:/презентации/strategy.pptx", "Стратегия\fЛандыш ключевые метрики\fХабибуллин", ["Слайд 1", "Слайд 2", "Слайд 3"]),
]


@pytest.fixture(scope="module")
def tables(spark):
    files = spark.createDataFrame([(k, p, n, p.split("\\")[-1].lower(), e, f, m, "ok", s, t, 1) for k, p, n, e, f, m, s, t in FILES], "key string, path string, name string, name_lc string, ext string, folder string, meta string, status string, size long, mtime_ms long, ver long")
    contents = spark.createDataFrame(CONTENTS, "key string, content string, unit_labels array<string>")
    return files.unionByName(files), contents.unionByName(contents.limit(2))  # repeated rows


@pytest.fixture(scope="module")
def ix(spark, tables, tmp_path_factory):
    return index.build(spark, *tables, f"file://{tmp_path_factory.mktemp('index')}/ix", stem=True)


def names(ix, query, **o):
    return sorted(r["key"].rpartition("/")[2] for r in search.matches(ix, Options(query, **o))[0].select("key").collect())


@pytest.mark.parametrize(
    "query,expected",
    [
        ("Кракозябровая", ["contract.docx", "contract.pdf"]),
        ("арендатором", ["contract.docx", "contract.pdf"]),
        ("Пётр", ["contract.docx"]),
        ("Петр", ["contract.docx"]),
        ('"срок действия"', ["contract.docx", "contract.pdf"]),
        ('"действия срок"', ["sales.xls"]),
        ("кракоз*", ["contract.docx", "contract.pdf"]),
        ("Кракозябровя~", ["contract.docx", "contract.pdf"]),
        ("Кракозябровая -Казань", ["contract.pdf"]),
        ("Тюльпаны OR Ландыш", ["sales.xls", "sales.xlsx", "strategy.pptx"]),
        ("Тюльпаны Ландыш", []),
        ("name:contract", ["contract.docx", "contract.pdf"]),
        ("name:trat", ["strategy.pptx"]),
        ("path:договоры", ["contract.docx", "contract.pdf"]),
        ("INV-774411", ["sales.xlsx"]),
        ("ext:xls,xlsx Ромашка", ["sales.xls", "sales.xlsx"]),
        ("meta:Иванов", ["contract.docx"]),
        ("!!!", []),
        ("ничего_такого", []),
    ],
)
def test_queries(ix, query, expected):
    assert names(ix, query) == expected


@pytest.mark.parametrize("query", ["", "   ", "!", '""'])
def test_nothing_asked_is_everything(ix, query):
    assert len(names(ix, query)) == 6


def test_modes_and_filters(ix):
    assert names(ix, "sales", mode="name") == ["sales.xls", "sales.xlsx"] and names(ix, "sales", mode="content") == []
    assert names(ix, "", dirs=["D:\\Отчёты\\"]) == ["sales.xls", "sales.xlsx"]
    assert names(ix, "", min_size=200, max_size=300) == ["contract.pdf", "sales.xlsx"]
    assert names(ix, "", after_ms=3000) == ["sales.xlsx", "strategy.pptx", "ноль"]
    assert names(ix, "ext:pdf", exts=["docx"]) == ["contract.docx", "contract.pdf"]


def test_name_outranks_content(spark, ix):
    page = search.search(ix, Options("договор OR contract")).collect()
    assert page[0]["key"].endswith(".docx") and page[0]["score"] > page[-1]["score"]


def test_pages_are_disjoint_and_complete(ix):
    seen = [r["key"] for o in range(0, 6, 2) for r in search.search(ix, Options("", limit=2, offset=o)).collect()]
    assert len(seen) == len(set(seen)) == 6
    newest = [r["modified_ms"] for r in search.search(ix, Options("")).collect()]
    assert newest[:5] == [6000, 5000, 3000, 2000, 1000]
    assert [r["size"] for r in search.search(ix, Options("", sort="smallest")).collect()] == [0, 100, 200, 300, 400, 500]


def test_properties(ix):
    one = set(names(ix, "Тюльпаны"))
    assert one <= set(names(ix, "Тюльпаны OR Казань")) and not names(ix, "Тюльпаны -Тюльпаны")
    assert one <= set(names(ix, "тюль*"))


def test_facets_stats_and_paths(ix):
    hits = {r["grp"]: r["hits"] for r in search.facets(ix, Options("Кракозябровая"), [["docx", "doc"], ["xlsx", "xls"], ["pdf"], ["zzz"]]).collect()}
    assert hits == {0: 1, 1: 0, 2: 1, 3: 0}
    assert search.by_value(ix, "ext").collect()[0]["value"] == "" and search.count(ix, Options("Тюльпаны")).first()[0] == 2
    assert search.contains_path(ix, "d:/презентации/ноль") and not search.contains_path(ix, "d:/нет")
    assert search.below(ix, "d:/отчёты").count() == 2


def test_batch_of_queries(spark, ix):
    got = search.many(ix, spark.createDataFrame([(1, "срок действия"), (2, "Ландыш"), (3, ""), (4, None)], "qid int, text string"), k=2)
    assert {(r["qid"], r["key"].rpartition("/")[2]) for r in got.collect() if r["qid"] == 2} == {(2, "strategy.pptx")}
    assert {r["qid"] for r in got.collect()} == {1, 2}


def test_snippets(ix):
    hit = snippets.hits(ix, Options("Ландыш")).first()
    assert hit["location"] == "Слайд 2" and hit["more_before"] and hit["more_after"]
    assert [p["text"] for p in hit["parts"] if p["hit"]] == ["Ландыш"] and "Стратегия" not in "".join(p["text"] for p in hit["parts"])
    assert snippets.hits(ix, Options("name:contract")).first()["parts"] == []


def test_fragment_and_marks():
    parts, unit, before, after = snippets.fragment("a " * 300 + "срок  действия\n\n" + "b " * 300, ["срок", "действ"], [], {}, True)
    assert "".join(t for t, _ in parts).count("срок действия") == 1 and len("".join(t for t, _ in parts)) <= 240 and unit == 0 and before and after
    assert snippets.fragment("nothing", ["x"], [], {}, True) is None and snippets.fragment(None, ["x"], [], {}, True) is None
    assert snippets.viewer_marks("aXbxx", ["x", "xx"]) == [(1, 2), (3, 5)]
    assert snippets.collapse([("  a ", False), (" ", True), ("b\f ", False)]) == [("a ", False), ("b", False)]


def test_old_format_is_refused(spark, tables, tmp_path):
    path = f"file://{tmp_path}/ix"
    index.build(spark, *tables, path, stem=False)
    (tmp_path / "ix/commits/000000002.json").write_text('{"format": 0, "commit": 2}')
    with pytest.raises(ValueError):
        index.Index(spark, path)


def test_empty_tables(spark, tables, tmp_path):
    ix = index.build(spark, tables[0].limit(0), tables[1].limit(0), f"file://{tmp_path}/ix")
    assert names(ix, "x") == [] and names(ix, "") == [] and names(ix, '"a b"') == []
