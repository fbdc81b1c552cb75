import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import confusables, encoding, layout, queries, sentences

RU = "Дирекция утвердила смету, отчёт и план-график. Срочно верните журнал регистрации!"
WAYS = [("utf-8", "cp1252"), ("utf-8", "cp1251"), ("utf-8", "cp866"), ("utf-8", "koi8-r"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "latin-1"), ("utf-8", "mac-cyrillic")]


def misread(text, wrote, read):
    raw = text.encode(wrote)
    return encoding._decode(raw, read)


@pytest.mark.parametrize("wrote,read", WAYS)
def test_round_trip(wrote, read):
    bad = misread(RU, wrote, read)
    assert encoding.examine(bad) == (True, RU)


def test_twice_misread_and_in_part():
    assert encoding.examine(misread(misread("Übersicht für Größe", "utf-8", "cp1252"), "utf-8", "cp1252")) == (True, "Übersicht für Größe")
    part = "The list of " + misread("résumé", "utf-8", "cp1251") + " was kept."
    assert encoding.examine(part) == (True, "The list of résumé was kept.")


@pytest.mark.parametrize("text", [RU, "ПРИКАЗ 1212 ОТМЕНЁН", "Größe und façade’s naïve cœur, Señora São", "Area 20 m², ½ of Brand™ № 5 €", "Møller-type from Åse", "параметр Ω и β", "Чтo дeлaть?", "план\xad-график", "What?! Why??", "", "   ", "n.º 12", "«Нет. Завтра.»"])
def test_correct_text_is_no_case(text):
    assert encoding.examine(text) == (False, text)


@pytest.mark.parametrize("text", ["r�sum�", "???? ?????? ????????? 12", "Gesch?ftsstelle pr?fte"])
def test_lost_letters_are_a_case(text):
    assert encoding.examine(text) == (True, text)


def test_screen_agrees_with_expression():
    random.seed(1)
    alphabet = "абвАБВabcABCéÉ╨?—¬ \n%1Ђµ&;=\\u"
    for _ in range(3000):
        s = "".join(random.choice(alphabet) for _ in range(random.randint(0, 9)))
        if any(encoding.SUSPECT.search(t) for t in encoding._TOKEN.findall(s)):
            assert encoding.suspicious(s), s


def rows(spark, values):
    return spark.createDataFrame([(str(i), v, "x") for i, v in enumerate(values)], "key string, text string, garbled string")


def test_encoding_in_spark(spark):
    df = rows(spark, [misread(RU, "utf-8", "cp1251"), None, "", RU, RU, "x" * 200_000])
    got = encoding.repair(df, "text").collect()
    assert [r["encoding"]["garbled"] for r in got] == [True, False, False, False, False, False] and got[0]["garbled"] == "x"
    assert encoding.garbled(df, "text").count() == 1 and encoding.garbled(df.limit(0), "text").count() == 0


# ---- look-alikes


@pytest.mark.parametrize(
    "text,form",
    [
        ("дoгoвop", "договор"), ("cоntract", "contract"), ("Ｅｘｃｅｌ ２０２４", "Excel 2024"), ("𝐝𝐨𝐜𝐱", "docx"), ("oﬃce", "office"), ("ёлка", "ёлка"), ("до​го\xadвор", "договор"), ("a\xa0b c", "a b c"),
        ("й".encode().decode(), "й"), ("й", "й"), ("Νοtes", "Notes"), ("heгиял", "негиял"), ("μinutes", "minutes"), ("маrlаmоrfа", "marlamorfa"),
    ],
)
def test_canonical(text, form):
    assert confusables.canonical(text) == form and confusables.disguised(text) == (text != form)


@pytest.mark.parametrize("text", ["№ 5, 20 m², ½, ™, €", "IT-отдел и 3D-модель", "параметр Ω", "iСклад ждёт", "café naïve", "Привет world", "", None, "line\nbreak\ttab\f"])
def test_no_disguise(text):
    assert not confusables.disguised(text) and confusables.canonical(text) == text


def test_prototypes_of_the_published_table():
    """Letters of scripts far from Latin, letters outside modern alphabets, characters alike beyond letters."""
    for word in ("Ꭺpple", "ꓮpple"):
        assert confusables.canonical(word) == "Apple" and confusables.disguised(word) and confusables.skeleton(word) == confusables.skeleton("Apple")
    assert confusables.canonical("ɑpple") == "apple" and confusables.canonical("օrange") == "orange" and confusables.disguised("аррӏе")
    for whole in ("кӏант", "kapı", "ꓮꓯꓰ", "ᎠᏂ", "Հայաստան", "Привет", "ɑ"):
        assert not confusables.disguised(whole), whole
    same = [confusables.skeleton(x) for x in ("l", "I", "1", "|")]
    assert len(set(same)) == 1 and confusables.skeleton("0") == confusables.skeleton("O") and confusables.skeleton("rn") == confusables.skeleton("m") != confusables.skeleton("n")
    assert confusables.canonical("соrrео") == "correo" and confusables.canonical("archiνe") == "archive"


def test_tables_travel(tmp_path):
    import pickle

    look = pickle.loads(pickle.dumps(confusables.look()))
    assert look.canonical("Чтo") == "Что" and len(look.table) > 6000
    with pytest.raises(Exception):
        confusables.confusables(str(tmp_path / "none.jar"))


def test_long_values_damaged_in_two_ways():
    """The common path repairs its tokens; those of the second encoding are searched by themselves."""
    first = "Дирекция утвердила подробную смету строительства четырёхэтажного административного корпуса предприятия".split()
    second = "Срочно верните журнал регистрации документов".split()
    bad = [misread(w, "cp866", "cp1251") for w in first] + ["日本", "слова"] + [misread(w, "cp1251", "koi8-r") for w in second]
    found, restored = encoding.examine(" ".join(bad))
    assert found and restored.split()[: len(first) + 2] == first + ["日本", "слова"]
    assert {"Срочно", "журнал", "регистрации", "документов"} <= set(restored.split())


@pytest.mark.parametrize("times", [1, 3, 60])
def test_two_faults_in_one_value_at_every_length(times):
    first, second = "Договор аренды нежилого помещения", "Дирекция утвердила подробную смету"
    bad = " ".join([misread(first, "utf-8", "latin-1"), misread(second, "cp1251", "latin-1")] * times)
    assert encoding.examine(bad) == (True, " ".join([first, second] * times))
    few = misread("Договор смета", "utf-8", "latin-1") + " " + misread(second, "cp1251", "latin-1")
    assert encoding.examine(few) == (True, "Договор смета " + second)


@pytest.mark.parametrize(
    "text,wrote,read",
    [
        ("文字コードの変換に失敗しました。内容を確認してください", "shift_jis", "latin-1"), ("文字コードの変換に失敗しました。内容を確認してください", "shift_jis", "cp1251"),
        ("合同编号和付款条件见附件，请尽快确认。", "gbk", "cp1252"), ("Zażółć gęślą jaźń. Umowa dzierżawy", "utf-8", "cp1250"), ("Καλημέρα κόσμε, η σύμβαση", "utf-8", "cp1252"),
    ],
)
def test_further_sets(text, wrote, read):
    assert encoding.examine(misread(text, wrote, read)) == (True, text)


@pytest.mark.parametrize("text", ["План Женплоюрб аШочижутешо", "Письмо иФлстигиту", "Прика зФаруно Сабацел", "Справка уЩнордан"])
def test_slips_of_letters_are_no_case(text):
    """A capital that came to stand one place on: what a path makes of it is no word."""
    assert encoding.examine(text) == (False, text)


def test_no_implausible_restoration():
    """A value no path makes plausible is a case that keeps its form; correct text of neighbours is none."""
    bad = misread("Zażółć gęślą jaźń. Umowa dzierżawy została podpisana", "cp1250", "latin-1")
    found, restored = encoding.examine(bad)
    assert found and not re.search("[а-яА-Я]", restored)
    for text in ("Zażółć gęślą jaźń", "Šimon Žižek čeština", "«Євгеній Онєгін» та їжак"):
        assert encoding.examine(text) == (False, text)


def test_enye_read_as_cyrillic_at_every_length():
    text = "El niсo vive en la casa de su abuela y los aсos pasan con calma por el pueblo. "
    for n in (1, 2, 3, 40):
        assert encoding.examine(text * n) == (True, (text * n).replace("с", "ñ"))
    other = "The plan was read by every member of the committee before they met, and each niсo was counted among the others. "
    assert not encoding.examine(other * 3)[0]


def test_skeletons_group(spark):
    assert confusables.skeleton("Кото") == confusables.skeleton("Koто") == confusables.skeleton("Ｋото​") and confusables.skeleton(None) is None
    df = spark.createDataFrame([("план",)] * 5 + [("плaн",)] * 3 + [("другое",), (None,), ("",)], "v string")
    got = confusables.look_alike_groups(df, "v").where("forms > 1").collect()
    assert {(r["value"], r["records"]) for r in got} == {("план", 5), ("плaн", 3)} and len({r["group_id"] for r in got}) == 1
    assert confusables.look_alike_groups(df.limit(0), "v").count() == 0 and confusables.unify(df, "v").where("canonical = 'план'").count() == 8


def test_groups_of_contents_and_of_names(spark, tmp_path):
    """Both places have groups; equal skeletons in two places are no group."""
    long = "смета и отчёт " * 400
    spark.createDataFrame([("c1", long), ("c2", long.replace("о", "o")), ("c3", long), ("c4", "план"), ("c5", None)], "key string, content string").write.parquet(f"{tmp_path}/contents.parquet")
    spark.createDataFrame([("n1", "плaн", "плaн"), ("n2", "отчёт", "отчёт"), ("n3", "oтчёт", "Oтчёт")], "key string, name_lc string, name string").write.parquet(f"{tmp_path}/files.parquet")
    got = queries.p5_groups(spark, str(tmp_path)).collect()
    assert {(r["place"], r["value"], r["records"], r["forms"]) for r in got} == {("content", long, 2, 2), ("content", long.replace("о", "o"), 1, 2), ("name_lc", "отчёт", 1, 2), ("name_lc", "oтчёт", 1, 2)}
    assert len({r["group_id"] for r in got}) == 2


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_canonical_is_stable_and_keeps_the_skeleton(s):
    c = confusables.canonical(s)
    assert confusables.canonical(c) == c or confusables._suspicious(c)
    assert confusables.skeleton(confusables.skeleton(s)) is not None


# ---- layout


def page_text():
    body = "   The warehouse team keeps the delivery\nschedule there. The cost of the stock-\ntaking is low.\n"
    return "\f".join(f"Report Nelmar Tuqua\n\n{body}\n            — {n} —" for n in (4, 5, 6))


def test_headers_and_numbers_go():
    lines, gone, broken = layout.analyse(page_text())
    assert {lines[i].strip() for i in gone} == {"Report Nelmar Tuqua", "— 4 —", "— 5 —", "— 6 —"}
    assert [(a, b) for a, b, _, _ in broken.values()] == [("stock", "taking")] * 3


STORY = "The keeper of the tower wrote that wind had turned to west before the evening bell rang and many boats were still beyond the bar while nobody in the village believed a word of what he said at first because storms of that kind had never come".split()


def story_page(p, n=5):
    r = random.Random(p)
    return [" ".join(r.choice(STORY) for _ in range(9)).lower() for _ in range(n)]


@pytest.mark.parametrize("heads,feet", [(["Harbour Authority of the Northern Coast"], []), (["Harbour Authority of the Northern Coast", "Yearly returns of the outer lights", "kept under seal"], ["for the board only"]), ([], ["this is the foot of every page."])])
def test_unknown_and_manifold_headers_go(heads, feet):
    """What every page repeats at its edge is furniture, however many lines and whatever its words; numbers beside it as well."""
    pages = [[*heads, *story_page(p), *feet, f"- {p + 1} -"] for p in range(4)]
    lines, gone, _ = layout.analyse("\f".join("\n".join(p) for p in pages))
    assert sorted(lines[i] for i in gone) == sorted([*heads * 4, *feet * 4, *(f"- {p + 1} -" for p in range(4))])


def test_chain_holds_its_order():
    pages = [["Harbour Authority", *story_page(p, 6), "Harbour Authority"] for p in range(4)]
    for at, state in layout.labels(pages, {}).items():
        assert state == ("head" if at[1] == 0 else "foot" if at[1] == 7 else "body")
    assert layout.labels([["one", "", "two-", "three"]], {}, {(0, 2)}) == {(0, 0): "body", (0, 2): "break", (0, 3): "body"}
    assert all(a != layout.FOOT or b == layout.FOOT for a, b in layout.TRANSITIONS) and (layout.BODY, layout.HEAD) not in layout.TRANSITIONS


def test_header_words_are_learned(spark):
    docs = ["\f".join("\n".join([f"Zorbak {name}", *story_page(p + 10 * i)]) for p in range(3)) for i, name in enumerate(["Luma", "Keso", "Tiri", "Vano"])]
    counts = layout.word_counts(spark.createDataFrame([(d,) for d in docs], "text string"), "text")
    words = layout.header_words(counts)
    assert words["^zorbak"] > 0 and all(w[0] in "^$" for w in words) and layout.header_words(counts.limit(0)) == {}
    two = "\f".join(["\n".join(story_page(50)), "\n".join(["Zo:bak Pelu", *story_page(51)])])  # seen once, a character misread
    assert layout.analyse(two, layout.known_words(words))[1] and not layout.analyse(two)[1]


@pytest.mark.parametrize("text", ["Сроки и порядок\n\nКомиссия согласовала смету.", "Total\n118\n76 503\n692", "One line only", "Сроки и порядок\fКомиссия вернула смету.\fАрхив вернул смету.", None, "", " \n\f\n "])
def test_body_stays(text):
    assert not layout.analyse(text)[1]


def found(spark, texts):
    df = spark.createDataFrame([("p", str(i), t) for i, t in enumerate(texts)], "place string, key string, text string")
    counts = layout.word_counts(df, "text")
    return {(r["key"], r["line_no"], r["kind"], r["right"]) for r in layout.findings(df, counts, layout.misread_words(counts)).collect()}


def test_findings(spark):
    clean = ["The register was kept in the ledger. Верните счёт-фактуру и журнал регистрации. " * 15] * 3
    noisy = "the rcgister was\nkept in the led-\nger. Верните счёт-\nфактуру и журиал реги¬\n\nстрации. The reg1ster"
    got = found(spark, [*clean, noisy, noisy, None, "", " "])
    assert {g for g in got if g[0] == "3" and (g[2] != "misread" or g[3])} == {("3", 0, "misread", "register"), ("3", 1, "join", None), ("3", 3, "misread", "журнал"), ("3", 3, "join", None), ("3", 5, "misread", "register")}
    assert {g[0] for g in got} == {"3", "4"}
    assert found(spark, []) == set()


def test_paragraphs():
    text = "Head\n   First line of\nthe stock-\ntaking.\n\n   Second rcgister.\n- 1 -"
    assert layout.paragraphs(text, {0, 6}, {2}, {5: [("rcgister", "register")]}) == "First line of the stocktaking.\nSecond register."


# ---- sentences


def cut(text, **o):
    b, e = sentences.segment([text], **o)[0]
    return [text[x:y] for x, y in zip(b, e)]


@pytest.mark.parametrize(
    "text,parts",
    [
        ('A 5" pipe was laid. The crew left. They came back. It rained.', ['A 5" pipe was laid.', "The crew left.", "They came back.", "It rained."]),
        ('He said "No. Not today." and left. Then a 7" nail broke.\n\nIt went on. It ended.', ['He said "No. Not today." and left.', 'Then a 7" nail broke.', "It went on.", "It ended."]),
        ('"We open a quotation and never close it. It ends with the paragraph.\n\nNothing is quoted. Not here.', ['"We open a quotation and never close it. It ends with the paragraph.', "Nothing is quoted.", "Not here."]),
        ("„Das Lager wartet.“Die Prüfstelle auch.", ["„Das Lager wartet.“", "Die Prüfstelle auch."]),
        ("Gen. Smith met Lt. Jones. They left.", ["Gen. Smith met Lt. Jones.", "They left."]),
        ("La Réf. 12 est close. Le 3 janv. 2020 aussi.", ["La Réf. 12 est close.", "Le 3 janv. 2020 aussi."]),
    ],
)
def test_quotes_and_abbreviations(text, parts):
    assert cut(text) == parts


def test_long_documents_in_pieces(spark):
    """Pieces of documents give what the whole gives, with the wrapping width of the whole."""
    r = random.Random(4)
    para = "The register was kept in the ledger of the\nwarehouse team. „Nein. Morgen.“ war die Antwort\nvon S. Dubare. 1. Sort it;\nПриказ отменён! Что делать"
    docs = [(i, ("\n\n" if i % 2 else "\f").join(" ".join(r.sample(para.split(" "), 12)) + "\n" + para for _ in range(n))) for i, n in enumerate((1, 7, 60))] + [(3, None), (4, ""), (1, para)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole = sorted(map(tuple, sentences.units(df).collect()))
    assert whole and sorted(map(tuple, sentences.units(df, long=500, piece=300).collect())) == whole
    assert all(sentences.pieces(t, 300)[0][0] == 0 and "".join(x for _, x in sentences.pieces(t, 300)) == t for _, t in docs if t)


@pytest.mark.parametrize(
    "parts",
    [
        ["В г. Данрире, ул. Кинварка, д. 24, склад вернул бланки, папки и т. д.", "Срочно верните смету!"],
        ["«Архив не успевает! Что делать?» — спросил Р. К. Тесасив.", "В. З. Пинпаре ответил: «Нет. Завтра.» — и ушёл."],
        ["Mr. Calbekri and Dr. Labani met at 9.35 a.m. on 8 Sept. 2019.", "(For storage, see Fig. 16 and the notes.)", "So the tenant fell back to plan B.", "The file a_v3.2.odt was replaced, see p. 9..."],
        ["“No. Not today.” was the whole answer from K. Marjundo.", "“Ask St. Helmete clinic, Dept. No. 5921.”", "The finance unit... corrected it after all."],
        ["Am 28. März löschte das Lager den Plan, z. B. bei Xosoma.", "„Wir sind zu spät! Was nun?“, fragte C. Faburva.", "Die Ablage bestellte Hefte usw.", "Gemäß Nr. 8 ff."],
        ["La S.A.R.L. Quaxo et Cie. a reçu la liste.", "Livraison à Rojava, av. du Lac, bât. 27, apt. 4332.", "« Non. Demain. » fut la réponse de G. Lixosil.", "¿Qué hacemos?"],
        ["Γιατί το αρχείο έλεγξε τα πρακτικά;", "Ο κ. Βελοχω ενέκρινε τη σύμβαση, δηλ. 18,7 %."],
        ["قال نوسابا: «لا. غدا.» ثم غادر.", "بلغ الوزن 17.63 كغ. تقريبا.", "لماذا أعاد د. باليبا الكشف؟"],
        ["नागिगि ने कहा, “नहीं। कल।” और चला गया।", "डॉ. पालीली ने 3.5 रु. लौटाए।"],
        ["ገሀየ “አይሆንም። ነገ።” አለ።", "ዶ/ር ገተየ ሪፖርቱን ላከ።"],
        ["iСклад и архив ждут.", "eForm 4.0.26 is live."],
    ],
)
def test_units_with_spaces(parts):
    assert cut(" ".join(parts)) == parts


@pytest.mark.parametrize(
    "parts",
    [
        ["“来不及了！怎么办？”棣枫煦昨天问道。", "煦璟霖说：“清单放在档案室。”", "费用为6,941.86元，偏差3.5%。", "编号No. 2491的供货合同……还是供应商更新了。", "琅柏棠回答：“不行。明天吧。”然后离开。", "（详见附件3。）", "仓库共有5份（含3.5版！），已转交。"],
        ["「間に合わない！どうする？」とイイが聞いた。", "No. 5458の一覧は……やはり借主が更新した。", "なぜ承認したのか？"],
        ["the shift.", "Case 5 closed.", "“We are late! What now?” asked D. Marst."],
    ],
)
def test_units_without_spaces(parts):
    assert cut("".join(parts)) == parts


def test_lines_lists_and_headings():
    text = "Раздел 6132. Оплата\nСклад вернул смету и акт приёмки со всеми\nзамечаниями по всем пунктам от Нины Д.\nМороз вчера.\n\n1. Сверить опись;\n2) Закрыть вопрос\n- Проверить\n\fКонец"
    assert cut(text) == ["Раздел 6132. Оплата", "Склад вернул смету и акт приёмки со всеми\nзамечаниями по всем пунктам от Нины Д.\nМороз вчера.", "1. Сверить опись;", "2) Закрыть вопрос", "- Проверить", "Конец"]


def test_wrapped_lines_are_no_items():
    text = "«Архив не успевает! Что делать?»\n— спросил Р. К. Тесасив без замечаний в\nпятницу. The file was replaced, see p.\n21. As of today all is well, and more\nlines follow."
    assert cut(text) == ["«Архив не успевает! Что делать?»\n— спросил Р. К. Тесасив без замечаний в\nпятницу.", "The file was replaced, see p.\n21.", "As of today all is well, and more\nlines follow."]


def test_thai():
    assert cut("ผู้เช่าแก้ไข 9 ฉบับ คุณลาตอบว่า “ไม่ได้ พรุ่งนี้” แล้วกลับไป") == ["ผู้เช่าแก้ไข 9 ฉบับ", "คุณลาตอบว่า “ไม่ได้ พรุ่งนี้” แล้วกลับไป"]


PIECES = ["Срочно верните смету! ", "“We are late! What?” asked A. B. Cole. ", "т. д. ", "\n\n", "\n", "1. Item\n", "来不及了！“好。”", "ผู้เช่า ", "(See p. 3.) ", "...", "«Нет. ", "» — и ушёл. ", "x", " ", "?!"]


@given(st.lists(st.sampled_from(PIECES), max_size=40), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_chunks_compose(pieces, chunk):
    """Any cut into chunks gives what one run gives, and units cover all that is not white space, in order."""
    text = "".join(pieces)
    whole = cut(text)
    assert cut(text, chunk=chunk) == whole
    assert re.sub(r"\s", "", "".join(whole)) == re.sub(r"\s", "", text)


def test_units_in_spark(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "x"), (2, None, "x"), (3, " \n ", "x"), (4, "No end", "x"), (5, "Go on. " * 30_000, "x")], "doc_id long, text string, sent_start string")
    got = sentences.units(df)
    assert {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()} == {1: 2, 4: 1, 5: 30_000}
    assert got.where("doc_id = 1").orderBy("sent_start").collect()[1][1:] == (5, 9) and sentences.units(df.limit(0)).count() == 0


def test_queries_are_registered():
    assert {f"p{n}_found" for n in (1, 2, 3, 5, 8)} <= set(queries.QUERIES)
    assert F is not None
