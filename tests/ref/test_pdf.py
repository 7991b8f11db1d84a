"""The PDF reader on files made here."""

import zlib

import pytest

from docweft.sources import pdf, scan


def stream(head: bytes, data: bytes, packed: bool) -> bytes:
    raw = zlib.compress(data) if packed else data
    return b"<< %s %s /Length %d >>\nstream\n%s\nendstream" % (head, b"/Filter /FlateDecode" if packed else b"", len(raw), raw)


def make(pages: list[bytes], packed: bool = True, unicode_map: bytes | None = None, packed_objects: bool = False) -> bytes:
    first = 5
    kids = b" ".join(b"%d 0 R" % (first + 2 * i) for i in range(len(pages)))
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /X %s >>" % (b"/ToUnicode 4 0 R" if unicode_map else b"")
    plain = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>" % (kids, len(pages)), 3: font}
    for i in range(len(pages)):
        plain[first + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (first + 2 * i + 1)
    streams = {first + 2 * i + 1: stream(b"", p, packed) for i, p in enumerate(pages)}
    if unicode_map:
        streams[4] = stream(b"", unicode_map, packed)
    if packed_objects:
        index, body = b"", b""
        for n, b in plain.items():
            index += b"%d %d " % (n, len(body))
            body += b + b" "
        streams[90] = stream(b"/Type /ObjStm /N %d /First %d" % (len(plain), len(index)), index + body, packed)
        plain = {}
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in [*plain.items(), *streams.items()]) + b"trailer\n<< /Root 1 0 R >>\n%%EOF"


SIMPLE = b"BT /F1 12 Tf 72 700 Td (Jane \\(Sam\\) Example) Tj 0 -14 Td [(Staff) -300 (Engi) 20 (neer)] TJ T* (caf\\351) ' ET"


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("objects", [True, False])
def test_lines_and_pages(packed, objects):
    data = make([SIMPLE, b"BT /F1 9 Tf 1 0 0 1 72 700 Tm (second) Tj 1 0 0 1 120 700 Tm (page) Tj 1 0 0 1 72 680 Tm (end) Tj ET"], packed, packed_objects=objects)
    assert pdf.text_layer(data) == "Jane (Sam) Example\nStaff Engineer\ncafé\n\nsecond page\nend"
    assert pdf.image_pages(data) == (0, 2)


def test_unicode_maps():
    cmap = b"2 beginbfchar <0001> <5F20> <0002> <00660069> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<4E09> <004F>] endbfrange"
    data = make([b"BT /F1 12 Tf <00010020> Tj 0 -20 Td <0010001100120002> Tj ET"], unicode_map=cmap)
    assert pdf.text_layer(data) == "张三\nABCfi"


def test_damaged_and_encrypted_files():
    whole = make([SIMPLE])
    assert pdf.text_layer(whole.replace(b"trailer", b"trailer /Encrypt")) == ""
    assert pdf.text_layer(b"%PDF-1.4\n") == ""
    with pytest.raises(ValueError):
        pdf.text_layer(b"GIF89a")
    for cut in range(0, len(whole), 37):
        pdf.text_layer(b"%PDF-1.4\n" + whole[cut:])  # never more than missing text


def test_import(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(make([SIMPLE]))
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    (tmp_path / "c.txt").write_text("plain text " * 30)
    rows = {r.name: r for r in scan.documents(spark, f"file://{tmp_path}").collect()}
    assert rows["a.pdf"].text.startswith("Jane (Sam) Example") and rows["a.pdf"].status == "warning"
    assert "This PDF may be image-based or low quality. Review the preview before drafting." in rows["a.pdf"].warnings
    assert rows["b.pdf"].status == "error" and rows["c.txt"].status == "ready"
