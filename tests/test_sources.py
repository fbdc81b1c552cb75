import datetime as dt
import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.functions import values
from textloom.sources import extract as X
from textloom.sources import tree
from textloom.streaming import watch

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts["parts"].items():
            z.writestr(name, text)
    return out.getvalue()


def rels(*items):
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{REL}/{k}" Target="{t}"/>' for i, k, t in items) + "</Relationships>"


DOCX = package(parts={
    "[Content_Types].xml": "<Types/>", "_rels/.rels": rels(("r1", "officeDocument", "word/document.xml")), "word/_rels/document.xml.rels": rels(("h", "header", "header1.xml")),
    "word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Сорт &lt;Б&gt;, 7 мешков</w:t><w:tab/><w:t>склад</w:t></w:r><w:del><w:delText>вычеркнуто</w:delText></w:del></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>вес</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>цена</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>',
    "word/header1.xml": '<w:hdr xmlns:w="w"><w:p><w:r><w:t>Мельница на Сосьве</w:t></w:r></w:p></w:hdr>', "docProps/core.xml": '<cp xmlns:dc="d"><dc:title>Накладная</dc:title><dc:creator>Верещагина</dc:creator></cp>',
})
XLSX = package(parts={
    "[Content_Types].xml": "<Types/>", "_rels/.rels": rels(("r1", "officeDocument", "xl/workbook.xml")),
    "xl/_rels/workbook.xml.rels": rels(("s1", "worksheet", "worksheets/sheet1.xml"), ("s2", "worksheet", "worksheets/sheet2.xml"), ("ss", "sharedStrings", "sharedStrings.xml"), ("st", "styles", "styles.xml")),
    "xl/workbook.xml": f'<workbook xmlns:r="{REL}"><sheets><sheet name="Пусто" r:id="s2"/><sheet name="Урожай" r:id="s1"/></sheets></workbook>',
    "xl/sharedStrings.xml": "<sst><si><t>Рожь</t></si><si><r><t>Овёс яро</t></r><r><t>вой</t></r><rPh><t>чтение</t></rPh></si></sst>",
    "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c><c s="1"><v>44927</v></c></row><row><c><v>3.75</v></c><c t="e"><v>#N/A</v></c><c t="b"><v>1</v></c></row></sheetData></worksheet>',
    "xl/worksheets/sheet2.xml": "<worksheet><sheetData/></worksheet>",
})
PPTX = package(parts={
    "[Content_Types].xml": "<Types/>", "_rels/.rels": rels(("r1", "officeDocument", "ppt/presentation.xml")),
    "ppt/_rels/presentation.xml.rels": rels(("a", "slide", "slides/slide1.xml"), ("b", "slide", "slides/slide2.xml")),
    "ppt/presentation.xml": f'<p:presentation xmlns:p="p" xmlns:r="{REL}"><p:sldIdLst><p:sldId r:id="b"/><p:sldId r:id="a"/></p:sldIdLst></p:presentation>',
    "ppt/slides/slide1.xml": '<s xmlns:a="a"><a:p><a:r><a:t>Итоги жатвы</a:t></a:r><a:fld><a:t>7</a:t></a:fld></a:p></s>', "ppt/slides/slide2.xml": '<s xmlns:a="a"><a:p><a:r><a:t>План сева</a:t></a:r></a:p></s>',
})
ODS = package(parts={"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": '<o xmlns:t="t" xmlns:x="x"><body><t:table t:name="Амбар"><t:table-row><t:table-cell><x:p>мука</x:p></t:table-cell><t:table-cell><x:p>крупа</x:p></t:table-cell></t:table-row></t:table></body></o>'})
ODT = package(parts={"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": '<o xmlns:x="x"><body><x:h>Погода</x:h><x:p>Дождь<x:s/>и <x:span>ветер</x:span> с утра</x:p></body></o>'})


def test_packages():
    d = X.extract(DOCX, "docx")
    assert d.text == "Сорт <Б>, 7 мешков\tсклад\nвес\tцена\nМельница на Сосьве" and "Верещагина" in d.meta and d.status == "ok"
    s = X.extract(XLSX, "doc")  # by content, not by extension
    assert s.units == ["Лист «Урожай»"] and s.text.startswith("Рожь\tОвёс яровой\t01.01.2023 2023-01-01") and "3.75" in s.text and "N/A" not in s.text
    p = X.extract(PPTX, "pptx")
    assert p.units == ["Слайд 1", "Слайд 2"] and p.text.replace("\n", "") == "План сева\fИтоги жатвы"
    assert X.extract(ODS, "ods").units == ["Лист «Амбар»"] and X.extract(ODS, "ods").text == "мука\tкрупа"
    assert X.extract(ODT, "odt").text == "Погода\nДождь и ветер с утра"


def test_plain_markup_and_rtf():
    html = "<html><head><style>x{}</style></head><body><!-- c --><h1>Пар &amp; жар &deg;C</h1><p>баня&nbsp;&#1096;&unknown;</p><script>var x</script></body></html>"
    assert X.extract(html.encode(), "xls").text == "Пар & жар °C\nбаня ш&unknown;"
    assert X.extract("Мельник смолол всю рожь".encode("cp1251"), "txt").text == "Мельник смолол всю рожь"
    assert X.extract("Вечером над рекой туман".encode("cp866"), "txt").text == "Вечером над рекой туман"
    assert X.extract("Сосна".encode("utf-16"), "txt").text == "Сосна" and X.extract("Ель и кедр".encode("utf-16-le"), "txt").text == "Ель и кедр"
    assert X.extract(rb"{\rtf1\ansi\ansicpg1251{\fonttbl x}Barn \u1057?\u1084?\par{\*\gen y}\'f0\'ee\'e6\'fc}", "rtf").text == "Barn См\nрожь"
    assert X.extract(b"a\r\nb\rc", "txt").text == "a\nb\nc"


@pytest.mark.parametrize("data,ext,status", [(b"", "txt", "empty"), (None, "txt", "error"), (b"\0\1\2" * 50, "qqq", "skipped"), (b"MZ", "exe", "skipped"), (b"PK\x03\x04broken", "docx", "error"), (DOCX[:200], "docx", "error"), (b"%PDF-1.4", "pdf", "error"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 100, "doc", "error"), (b"   ", "txt", "empty"), (b"{\\rtf1", "rtf", "empty")])
def test_broken_files_fail_alone(data, ext, status):
    assert X.extract(data, ext).status.split(":")[0] == status


def test_limit_and_registry():
    got = X.extract("зерно ".encode() * 70_000, "txt", max_text=9_001)
    assert got.truncated and len(got.text.encode()) <= 9_001 and got.text.startswith("зерно зерно")
    X.register("zzz", lambda data, doc: doc.skipped("own"))
    assert X.extract(b"x", "zzz").status == "skipped: own"
    assert X.extract(b"x", "txt", size=1 << 40).status.startswith("skipped")


def test_extract_in_spark(spark):
    df = spark.createDataFrame([("a", bytearray(DOCX), "docx", 1), ("b", bytearray(b"x"), "txt", 2), ("c", None, None, 3)], "path string, content binary, ext string, status int").withColumnRenamed("status", "n")
    got = {r["path"]: r for r in X.extracted(df).collect()}
    assert got["a"]["status"] == "ok" and got["b"]["text"] == "x" and got["c"]["status"].startswith("error") and got["c"]["n"] == 3


def test_tree(spark, tmp_path):
    for name in ("a.txt", "_under.txt", ".dot", "пробел файл.txt", "sub/deep/deeper/x.txt", ".git/no", "sub/~$lock", "empty"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("" if name == "empty" else "x")
    os.symlink(tmp_path / "sub", tmp_path / "link")
    got = {os.path.relpath(r["path"], tmp_path): r for r in tree.listing(spark, [str(tmp_path), str(tmp_path / "sub")]).collect()}
    assert set(got) == {"a.txt", "_under.txt", ".dot", "пробел файл.txt", "sub/deep/deeper/x.txt", "empty"} and got["empty"]["size"] == 0 and got["a.txt"]["readable"]
    many = spark.read.format("tree").option("roots", json.dumps([str(tmp_path)])).option("entries", 2).load()
    assert sorted(r["path"] for r in many.collect()) == sorted(str(tmp_path / p) for p in got) and many.rdd.getNumPartitions() > 4
    with pytest.raises(NotADirectoryError):
        tree.normal_root(str(tmp_path / "none"))


def test_values(spark):
    assert values.parse_size("1,5M") == 1572864 and values.parse_size("10 KB") == 10240 and values.parse_size("7") == 7 and values.parse_size("x") is None
    assert values.format_size(1536) == "1,5 КБ" and values.format_size(5) == "5 Б"
    assert values.parse_date_ms("01.01.2023", zone=dt.timezone.utc) == 1672531200000 and values.parse_date_ms("2023-01-01", True, dt.timezone.utc) == 1672617599000 and values.parse_date_ms("?") is None
    assert values.serial_text(44927.0) == "01.01.2023 2023-01-01" and values.serial_text(0.5) == "12:00" and values.serial_text(9e9) is None
    assert values.is_date_format(14) and values.is_date_format(170, "dd/mm") and not values.is_date_format(170, '"day"0.0') and not values.is_date_format(2)
    assert values.number_text(3.0) == "3" and values.number_text(311.75) == "311.75"
    assert sorted(["slide10.xml", "slide2.xml"], key=values.natural_key) == ["slide2.xml", "slide10.xml"]
    rows = spark.createDataFrame([("10K",), ("1,5M",), ("3 gb",), ("x",), (None,)], "s string")
    assert [r[0] for r in rows.select(values.size_bytes(F.col("s"))).collect()] == [10240, 1572864, 3 << 30, None, None]


def test_every_name_gets_its_place(spark):
    """Whatever it starts with, over several key ranges, with numbers no type holds, and without a task for all names."""
    names = [f"{w}{n}.txt" for w in ("план", "отчёт", "a", "", "б ") for n in (1, 2, 10, 33, 7)] + ["", "без числа", "a.b.c", "x" + "9" * 45, "x5"]
    df = spark.createDataFrame([(n,) for n in names * 2 + [None]], "name_lc string")
    got = values.natural_positions(df, "name_lc")
    parts = {n: values.natural_key(n) for n in names}
    order = sorted(parts, key=lambda n: (parts[n][0].encode(), parts[n][1] if parts[n][1] < 10**38 else 0, n.encode()))
    assert {r["name_lc"]: r["pos"] for r in got.collect()} == {n: i for i, n in enumerate(order, 1)}
    assert values.natural_positions(df.limit(0), "name_lc").count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", ["natural_sort"])
def test_places_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from textloom import catalog

    c = duckdb.connect()
    c.sql(f"create view files as select * from '{SF}/files.parquet'")
    got = {tuple(r) for r in catalog.QUERIES[name](spark, SF).select("name_lc", "pos").collect()}
    assert got == set(c.sql(catalog.SQL[name]).select("name_lc", "pos").fetchall()) and got


def event(second, path="A", op="modify", tree_=False):
    return (dt.datetime(2025, 1, 1) + dt.timedelta(seconds=second), path, op, tree_)


def test_debounce_and_throttle(spark):
    feed = spark.createDataFrame([event(0), event(0), event(1, op=None, tree_=True), event(10), event(20), event(100), event(5, path=None)], "ts timestamp, path string, op string, introduces_path boolean")
    runs = sorted(watch.debounced(feed).collect(), key=lambda r: r["first_ms"])
    assert [r["events"] for r in runs] == [2, 1, 1, 1] and runs[0]["tree"] and runs[0]["due_ms"] - runs[0]["first_ms"] == 2500
    base = runs[0]["first_ms"]
    assert sorted(r["at_ms"] - base for r in watch.throttled(feed).collect()) == [2500, 32500, 101500]
    assert watch.debounced(feed.limit(0)).count() == 0


def test_stream_debounce(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"path": p, "op": o, "introduces_path": True}) for p, o in (("X", "create"), ("x", "modify"), ("y", "modify"))))
    feed = spark.readStream.schema("path string, op string, introduces_path boolean").json(str(src))
    q = watch.due_stream(feed, 300).writeStream.format("memory").queryName("due").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(100):
            got = {r["key"]: (r["tree"], r["events"]) for r in spark.table("due").collect()}
            if len(got) == 2:
                break
            q.awaitTermination(0.3)
    finally:
        q.stop()
    assert got == {"x": (True, 2), "y": (False, 1)}


def test_full_checks():
    assert watch.full_check_due(21600) and not watch.full_check_due(21599) and watch.full_check_due(600, network=True)
    assert watch.full_check_due(1, overflow=True, quiet_ms=1500) and not watch.full_check_due(1, overflow=True, quiet_ms=1499)


def pdf(*streams, flate=False):
    import zlib

    out = [b"%PDF-1.4", b"1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj", b"2 0 obj <</Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + i) for i in range(len(streams))) + b"] /Resources <</Font <</F1 3 0 R>>>>>> endobj"]
    out.append(b"3 0 obj <</Type /Font /ToUnicode 4 0 R>> endobj")
    out.append(b"4 0 obj <<>> stream\n1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfrange <41> <5A> <0410> endbfrange\nendstream endobj")
    for i, s in enumerate(streams):
        body = zlib.compress(s) if flate else s
        out.append(b"%d 0 obj <</Type /Page /Contents %d 0 R>> endobj" % (10 + i, 50 + i))
        out.append(b"%d 0 obj <<%s>> stream\n" % (50 + i, b"/Filter /FlateDecode" if flate else b"") + body + b"\nendstream endobj")
    return b"\n".join(out)


@pytest.mark.parametrize("flate", [False, True])
def test_pdf(flate):
    got = X.extract(pdf(b"BT /F1 12 Tf (ABC) Tj 0 -14 Td [(D) -300 (E)] TJ ET", b"BT /F1 9 Tf <4142> Tj ET", flate=flate), "pdf")
    assert got.units == ["Стр. 1", "Стр. 2"] and got.text.replace("\n", "|").replace("\f", "#").replace("|#", "#") == "АБВ|Г Д#АБ"
    assert X.extract(pdf(b"q Q"), "pdf").status == "scan"


def test_pdf_opens_with_the_empty_password():
    from textloom.sources.extract import pdf as P

    import hashlib

    owner, first_id, rights = bytes(range(32)), b"0123456789abcdef", -44
    n = 16
    key = hashlib.md5(P._FILL + owner + (rights & 0xFFFFFFFF).to_bytes(4, "little") + first_id).digest()
    for _ in range(50):
        key = hashlib.md5(key[:n]).digest()
    proof = hashlib.md5(P._FILL + first_id).digest()
    for i in range(20):
        proof = P.rc4(bytes(b ^ i for b in key), proof)
    user = proof + bytes(16)
    hidden = lambda num, data: P.rc4(hashlib.md5(key + num.to_bytes(3, "little") + bytes(2)).digest(), data)
    text = b"BT (Barley and oats) Tj ET"

    def file(user):
        return b"\n".join([
            b"%PDF-1.4", b"1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj", b"2 0 obj <</Type /Pages /Kids [3 0 R]>> endobj", b"3 0 obj <</Type /Page /Contents 4 0 R>> endobj",
            b"4 0 obj <<>> stream\n" + hidden(4, text) + b"\nendstream endobj",
            b"5 0 obj <</Filter /Standard /V 2 /R 3 /Length 128 /P %d /O <%s> /U <%s>>> endobj" % (rights, owner.hex().encode(), user.hex().encode()), b"trailer <</Root 1 0 R /Encrypt 5 0 R /ID [<%s> <00>]>>" % first_id.hex().encode(),
        ])

    assert P.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    assert X.extract(file(user), "pdf").text == "Barley and oats" and X.extract(file(bytes(32)), "pdf").status == "encrypted"


def test_thin_pages_go_to_the_recogniser():
    from textloom.sources.extract import pdf as P

    data = pdf(b"BT /F1 12 Tf (ABCDEFGHIJKLMNOPQRSTUVWXYZ) Tj ET", b"q Q")
    assert X.extract(data, "pdf").status == "ok" and X.extract(pdf(b"q Q"), "pdf").status == "scan"
    P.PAGES.append(lambda file, n: "страница прочитана глазами" if n == 2 else "нет")
    try:
        got = X.extract(data, "pdf")
        assert got.status == "ocr" and got.text.endswith("страница прочитана глазами") and got.text.startswith("АБВ")
        assert X.extract(pdf(b"BT /F1 12 Tf (ABCDEF) Tj ET"), "pdf").status == "ok"  # fewer letters than there were
    finally:
        P.PAGES.clear()


def test_binary_workbook():
    import struct

    from textloom.sources.extract import binary_sheets as B

    def rec(kind, data=b""):
        size, n = b"", len(data)
        while True:
            size += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                break
        return (bytes([kind]) if kind < 128 else bytes([kind & 127 | 128, kind >> 7])) + size + data

    wide = lambda s: struct.pack("<I", len(s)) + s.encode("utf-16-le")
    cell = lambda col, style=0: struct.pack("<I", col) + style.to_bytes(3, "little") + b"\0"
    book = rec(B.PROPERTIES, bytes(12)) + rec(B.SHEET, struct.pack("<II", 0, 1) + wide("r1") + wide("Амбар"))
    strings = rec(B.STRING_ITEM, b"\0" + wide("Рожь")) + rec(B.STRING_ITEM, b"\0" + wide("мешки " * 30))
    styles = rec(B.FORMAT, struct.pack("<H", 170) + wide("dd/mm")) + rec(B.BEGIN_FORMATS) + rec(B.CELL_FORMAT, struct.pack("<HH", 0, 0) + bytes(12)) + rec(B.CELL_FORMAT, struct.pack("<HH", 0, 170) + bytes(12)) + rec(B.END_FORMATS)
    sheet = rec(B.ROW, bytes(16)) + rec(B.SHARED, cell(0) + struct.pack("<I", 0)) + rec(B.RK, cell(1) + struct.pack("<I", 312 << 2 | 3)) + rec(B.REAL, cell(2, 1) + struct.pack("<d", 44927.0))
    sheet += rec(B.ROW, bytes(16)) + rec(B.SHARED, cell(0) + struct.pack("<I", 1)) + rec(B.FORMULA_TEXT, cell(1) + wide("итог")) + rec(B.FORMULA_NUMBER, cell(2) + struct.pack("<d", 2.5)) + rec(3, cell(3) + b"\7")
    data = package(parts={
        "[Content_Types].xml": "<Types/>", "_rels/.rels": rels(("r", "officeDocument", "xl/workbook.bin")), "xl/workbook.bin": book, "xl/sharedStrings.bin": strings, "xl/styles.bin": styles, "xl/worksheets/sheet1.bin": sheet,
        "xl/_rels/workbook.bin.rels": rels(("r1", "worksheet", "worksheets/sheet1.bin"), ("r2", "sharedStrings", "sharedStrings.bin"), ("r3", "styles", "styles.bin")),
    })
    got = X.extract(data, "xlsb")
    assert got.units == ["Лист «Амбар»"] and got.text.split("\n") == ["Рожь\t3.12\t01.01.2023 2023-01-01", "мешки " * 30 + "\tитог\t2.5"] and "Амбар" in got.meta
    assert B.short_number(0x3FF00000) == 1.0 and list(B.records(b"\x80")) == [(128, b"")]


def test_typed_paths_and_views():
    assert tree.on_network("\\\\srv\\docs") and tree.on_network("//srv/docs") and tree.on_network("\\\\?\\UNC\\srv\\docs")
    assert not any(map(tree.on_network, ("C:\\docs", "\\\\?\\C:\\docs", "\\\\.\\pipe", "/docs", "\\\\")))
    assert tree.typed(' "smb://srv/docs/" ', True) == "\\\\srv\\docs" and tree.typed("'/tmp'", False) == "/tmp"
    for bad, windows in (("", True), ("\\\\srv", True), ("//srv/docs", False)):
        with pytest.raises(ValueError):
            tree.typed(bad, windows)
    assert X.read_for_view(b"a\r\nb\rc") == ("a\nb\nc", False) and X.read_for_view(b"\0\1\2" * 50) is None and X.read_for_view(b"x" * (X.MAX_VIEW + 1))[1]
    assert values.format_time(1672531200000, dt.timezone.utc) == "01.01.2023 00:00" and values.format_time(None) == "" and values.shorten("abcdef", 4) == "…def" and values.thousands(1234567) == "1\xa0234\xa0567"


def compound(**streams):
    import struct

    names = list(streams)
    sectors, start = [], {}
    for n in names:
        data = streams[n].ljust(4096, b"\0")
        start[n] = (len(sectors), len(data))
        sectors += [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
    fat = []
    for n in names:
        first, size = start[n]
        k = -(-size // 512)
        fat += [first + j + 1 for j in range(k - 1)] + [0xFFFFFFFE]
    entry = lambda name, kind, at, size: name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<H", 2 * len(name) + 2) + bytes([kind]) + b"\0" * 49 + struct.pack("<IQ", at, size)
    directory = entry("Root Entry", 5, 0xFFFFFFFE, 0) + b"".join(entry(n.replace("_", " "), 2, *start[n]) for n in names)
    at = len(sectors)
    k = -(-len(directory) // 512)
    sectors += [directory[i : i + 512].ljust(512, b"\0") for i in range(0, len(directory), 512)]
    fat += [at + j + 1 for j in range(k - 1)] + [0xFFFFFFFE, 0xFFFFFFFD]
    table = struct.pack("<128I", *(fat + [0xFFFFFFFF] * 128)[:128])
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIII", 1, at, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    head += struct.pack("<109I", len(sectors), *[0xFFFFFFFF] * 108)
    return head + b"".join(sectors) + table


def test_binary_office_formats():
    import struct

    atom = lambda kind, data, box=False: struct.pack("<HHI", 15 if box else 0, kind, len(data)) + data
    master, body = atom(1016, atom(4000, "Макет".encode("utf-16-le")), True), atom(1006, atom(4000, "Сроки\rуборки".encode("utf-16-le")) + atom(4008, b"Harvest") + atom(4008, b"*") + atom(4008, b"Harvest"), True) + atom(4041, atom(4008, b"handout"), True) + atom(1010, atom(4008, b"caption"), True)
    got = X.extract(compound(PowerPoint_Document=master + body), "ppt")
    assert got.text == "Сроки\nуборки\nHarvest\nHarvest" and got.status == "ok"
    rec = lambda kind, data: struct.pack("<HH", kind, len(data)) + data
    sst = rec(0xFC, struct.pack("<II", 2, 2) + struct.pack("<HB", 8, 1) + "Гречиха1".encode("utf-16-le") + struct.pack("<HB", 3, 0) + b"abc")
    head = rec(0x809, b"\0" * 16) + rec(0xE0, struct.pack("<HH", 0, 0)) + rec(0xE0, struct.pack("<HH", 0, 14)) + sst
    bound = lambda at: rec(0x85, struct.pack("<IH", at, 0) + bytes([4, 1]) + "Лист".encode("utf-16-le"))
    at = len(head) + len(bound(0))
    sheet = rec(0x809, b"\0" * 16) + rec(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + rec(0x203, struct.pack("<HHHd", 0, 1, 1, 44927.0)) + rec(0x27E, struct.pack("<HHHI", 1, 0, 0, 7 << 2 | 2))
    got = X.extract(compound(Workbook=head + bound(at) + sheet), "xls")
    assert got.units == ["Лист «Лист»"] and got.text == "Гречиха1\t01.01.2023 2023-01-01\n7"
    text = "Опись амбара\rряд\x13 PAGE \x141\x15\rСверху\rСверху\r"
    raw, n = text.encode("utf-16-le"), text.index("Сверху")
    fib = bytearray(0x400)
    struct.pack_into("<HH", fib, 0, 0xA5EC, 0xC1)
    struct.pack_into("<i", fib, 76, n)
    clx = b"\x02" + struct.pack("<I", 16) + struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, 0x400, 0)
    struct.pack_into("<II", fib, 0x1A2, 0, len(clx))
    got = X.extract(compound(WordDocument=bytes(fib) + raw, **{"0Table": clx}), "doc")
    assert got.text == "Опись амбара\nряд1\nСверху"
    struct.pack_into("<H", fib, 10, 0x100)
    assert X.extract(compound(WordDocument=bytes(fib) + raw, **{"0Table": clx}), "doc").status == "encrypted"
    assert X.extract(compound(EncryptedPackage=b"x"), "docx").status == "encrypted"


def test_pages(spark):
    from textloom.sources.extract import pages

    assert pages.script_line("дoгoвop ne подписан") == "договор не подписан" and pages.script_line("plain line") == "plain line"
    assert pages.script_token("ne", True) == "не" and pages.script_token("Ha", True) == "На" and pages.script_token("mail@аосе.com", True) == "mail@aoce.com" and pages.script_token("the", False) == "the"
    box = lambda x, y, t, w=100.0: pages.Box(x, y, w, 10.0, 0.0, t)
    two = [box(150, 0, "title", 300.0)] + [box(50, 20 + 15 * i, f"l{i}") for i in range(4)] + [box(250, 20 + 15 * i, f"r{i}") for i in range(4)]
    assert pages.reading_order(two) == ["title", "l0", "l1", "l2", "l3", "r0", "r1", "r2", "r3"]
    assert pages.reading_order([box(200, 1, "b"), box(50, 0, "a"), box(50, 30, "c")]) == ["a b", "c"] and pages.reading_order([]) == []
    df = spark.createDataFrame([("k", 1, 50.0, 0.0, 99.0, 10.0, 0.0, "Акт"), ("k", 1, 50.0, 20.0, 99.0, 10.0, 0.0, "пpиёмки"), ("k", 2, 0.0, 0.0, 1.0, 1.0, 0.0, None)], "key string, page int, x double, y double, width double, height double, angle double, text string")
    assert [tuple(r) for r in pages.page_texts(df).collect()] == [("k", 1, "Акт\nприёмки")]


def test_command_line(spark, tmp_path, capsys):
    from textloom.__main__ import main

    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "Накладная.docx").write_bytes(DOCX)
    (tmp_path / "docs" / "notes.txt").write_text("Список ведомостей по амбарам")
    main(["index", str(tmp_path / "docs"), "--index", str(tmp_path / "ix")])
    main(["search", "амбара", "--index", str(tmp_path / "ix"), "--json"])
    out = capsys.readouterr().out
    assert '"total": 1' in out and "notes.txt" in out
    main(["search", "Верещагина", "--index", str(tmp_path / "ix"), "--paths"])
    assert "Накладная.docx" in capsys.readouterr().out
    main(["extract", str(tmp_path / "docs" / "notes.txt")])
    assert "ok" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["search", "--index", str(tmp_path / "ix")])


def test_change_feed(spark, tmp_path):
    from textloom.sources.feed import ChangeSource, _Changes

    root, state = tmp_path / "docs", tmp_path / "state"
    root.mkdir()
    (root / "a.txt").write_text("1")
    (root / "b.txt").write_text("1")
    spark.dataSource.register(ChangeSource)
    feed = spark.readStream.format("changes").option("roots", json.dumps([str(root)])).option("state", str(state)).load()
    seen = []

    def take(df, n):
        seen.extend((os.path.basename(r["path"]), r["op"]) for r in df.collect())

    q = feed.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        for step in (lambda: None, lambda: ((root / "a.txt").write_text("changed"), os.remove(root / "b.txt"), (root / "c.txt").write_text(""))):
            before = len(seen)
            step()
            for _ in range(60):
                if len(seen) > before:
                    break
                q.awaitTermination(0.2)
    finally:
        q.stop()
    assert sorted(seen) == [("a.txt", "create"), ("a.txt", "modify"), ("b.txt", "create"), ("b.txt", "remove"), ("c.txt", "create")]
    # a replayed batch has the rows it had
    reader = _Changes({"roots": json.dumps([str(root)]), "state": str(state)})
    once, end = reader.read({"listing": 7})
    once = list(once)
    (root / "d.txt").write_text("later")
    assert list(reader.read({"listing": 7})[0]) == once == list(reader.readBetweenOffsets({"listing": 7}, end))
    assert {r[2] for r in once} == {"create"}
