"""PDF files written here are read back with their places."""

import zlib

import pytest

from marlstone.plans.fixtures import simple_pdf
from marlstone.sources import pdf


def file_of(objects, tail=b""):
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in objects.items()) + b"trailer << /Root 1 0 R >>\n" + tail


def stream(data, more=b"", packed=True):
    data = zlib.compress(data) if packed else data
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode" if packed else b"", more, data)


HEAD = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R >> >> >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", 5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}


@pytest.mark.parametrize("packed", [True, False])
def test_places_operators_and_strings(packed):
    content = rb"""q 1 0 0 1 10 20 cm BT /F1 12 Tf 14 TL 72 700 Td (Title \(1\)) Tj ET Q
    BT /F1 10 Tf 1 0 0 1 72 600 Tm [(Hel) -20 (lo) -600 (there)] TJ 0 -12 TD (second\040line) Tj T* <4142> Tj (x) ' ET
    0 0 m 10 10 l S BT /F1 10 Tf 72 100 Td (\344 far below) Tj ET"""
    rows = pdf.read_bytes(file_of(HEAD | {4: stream(content, packed=packed)}))
    assert [(r[0], r[1], r[2], r[4], r[5]) for r in rows] == [(1, 1, 12.0, "Title (1)", None), (1, 2, 10.0, "Hello there\nsecond line\nAB\nx", None), (1, 3, 10.0, "ä far below", None)]
    assert rows[0][3] == [82.0, 720.0, 82.0 + 6 * 9, 732.0] and rows[1][3][:2] == [72.0, 564.0]


def test_object_streams_and_maps_of_letters():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0416> <0002> <00660069> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    objects = {k: v for k, v in HEAD.items() if k not in (3, 5)} | {4: stream(b"BT /F1 10 Tf 10 10 Td <000100020010001100120030> Tj ET"), 6: stream(cmap)}
    inner = {3: HEAD[3], 5: b"<< /Type /Font /ToUnicode 6 0 R >>"}
    bodies = b" ".join(inner.values())
    head = b" ".join(b"%d %d" % (n, bodies.index(v)) for n, v in inner.items()) + b" "
    objects[7] = stream(head + bodies, b"/Type /ObjStm /N 2 /First %d" % len(head))
    assert [r[4] for r in pdf.read_bytes(file_of(objects))] == ["Жfiabc\x000"]


def test_order_of_pages():
    objects = {1: HEAD[1], 2: b"<< /Kids [6 0 R 3 0 R] >>", 3: HEAD[3], 4: stream(b"BT /F1 9 Tf (last) Tj ET"), 6: b"<< /Kids [7 0 R 6 0 R] >>", 7: b"<< /Type /Page /Contents [8 0 R 9 0 R] >>", 8: stream(b"BT /F1 9 Tf (one) Tj"), 9: stream(b"( two) Tj ET")}
    assert [(r[0], r[4]) for r in pdf.read_bytes(file_of(objects))] == [(1, "one two"), (2, "last")]


@pytest.mark.parametrize("data", [None, b"", b"no pdf", b"%PDF-1.4\n", file_of(HEAD | {4: b"<< /Filter /FlateDecode /Length 3 >>\nstream\nabc\nendstream"}), file_of(HEAD, b"/Encrypt 9 0 R"), file_of(HEAD)[:40]])
def test_broken_files_say_why(data):
    rows = pdf.read_bytes(data)
    assert len(rows) == 1 and rows[0][5]


def test_files_below_a_path(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.pdf").write_bytes(simple_pdf("First (line)\nsecond \\ line\n" * 60))
    (tmp_path / "b.PDF").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"no")
    rows = pdf.read(spark, str(tmp_path)).collect()
    assert sum(r.error is not None for r in rows) == 1
    pages = sorted((r.page, r.block, r.text) for r in rows if r.error is None)
    assert max(p[0] for p in pages) == 3 and "\n".join(p[2] for p in pages) == "\n".join(["First (line)", "second \\ line"] * 60)
