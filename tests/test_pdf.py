"""The text layer of small files made here."""

import zlib

from leafquarry.sources import pdf


def file(*streams, flate=True, more=b""):
    out = b"%PDF-1.5\n1 0 obj\n<< /Type /Pages /Count 1 >>\nendobj\n2 0 obj\n<< /Type /Page >>\nendobj\n" + more
    for n, x in enumerate(streams, 3):
        data = zlib.compress(x) if flate else x
        out += b"%d 0 obj\n<< /Length %d%s >>\nstream\n" % (n, len(data), b" /Filter /FlateDecode" if flate else b"") + data + b"\nendstream\nendobj\n"
    return out + b"%%EOF"


CONTENT = rb"BT /F1 12 Tf 72 700 Td (Circular N\272 5) Tj 0 -14 Td [(Ar) -20 (t\355culo) -250 (31 \(a\))] TJ T* <4c4952> Tj ET q 1 0 0 1 0 0 cm Q"


def test_text_layer():
    want = (1, "Circular Nº 5\nArtículo 31 (a)\nLIR", None)
    assert pdf.read(file(CONTENT)) == pdf.read(file(CONTENT, flate=False)) == want
    assert pdf.read(file(CONTENT, b"BT (second) ' ET"))[1].endswith("LIR\nsecond")


def test_what_cannot_be_read():
    assert pdf.read(None) == pdf.read(b"") == pdf.read(b"<html>") == (0, "", "not a PDF file")
    assert pdf.read(file(CONTENT, more=b"9 0 obj << /Encrypt 1 >> endobj\n"))[1:] == ("", "encrypted")
    assert pdf.read(file(b"0 0 m"))[1:] == ("", "no text layer")
    pages, text, error = pdf.read(file(CONTENT)[:-60].replace(b"\x78\x9c", b"\x00\x00", 1))
    assert (pages, text) == (1, "") and error == "1 streams could not be read"


def test_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.PDF").write_bytes(file(CONTENT))
    (tmp_path / "y.pdf").write_bytes(b"no")
    (tmp_path / "z.txt").write_text("no")
    got = sorted((r.path.rsplit("/", 1)[-1], r.pages, r.error) for r in pdf.folder_texts(spark, str(tmp_path)).collect())
    assert got == [("x.PDF", 1, None), ("y.pdf", 0, "not a PDF file")]
    assert pdf.folder_texts(spark, str(tmp_path)).where("1 = 0").count() == 0


CMAP = b"""begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0024> <0041> <0025> <00F1> endbfchar 2 beginbfrange <0030> <0032> <0061> <0040> <0041> [<0066> <00660069>] endbfrange"""


def tree(fonts, contents, objects=b"", packed=False):
    """Two pages in the tree's order, which isn't the file's; the second takes its parent's fonts."""
    plain = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [4 0 R 3 0 R] /Count 2 /Resources << /Font << " + fonts + b" >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents [11 0 R] >>",
        4: b"<< /Type /Page /Parent 2 0 R /Contents 10 0 R /Resources << /Font << " + fonts + b" >> >> >>",
    }
    out = b"%PDF-1.5\n"
    if packed:
        bodies, places, at = [], [], 0
        for k, v in plain.items():
            places += [k, at]
            bodies.append(v + b" ")
            at += len(v) + 1
        head = " ".join(map(str, places)).encode() + b" "
        data = zlib.compress(head + b"".join(bodies))
        out += b"20 0 obj << /Type /ObjStm /N %d /First %d /Filter /FlateDecode >> stream\n" % (len(plain), len(head)) + data + b"\nendstream endobj\n"
    else:
        out += b"".join(b"%d 0 obj %s endobj\n" % (k, v) for k, v in plain.items())
    for k, c in zip((10, 11), contents, strict=True):
        data = zlib.compress(c)
        out += b"%d 0 obj << /Filter /FlateDecode /Length %d >> stream\n" % (k, len(data)) + data + b"\nendstream endobj\n"
    return out + objects + b"%%EOF"


def test_fonts_with_maps():
    mapped = b"7 0 obj << /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 8 0 R >> endobj 8 0 obj << >> stream\n" + CMAP + b"\nendstream endobj\n"
    contents = (b"BT /F1 9 Tf <00240025> Tj [<0030> -300 <00310032>] TJ <00400041> Tj ET", b"BT /F1 9 Tf (\\000\\044) Tj ET")
    for packed in (False, True):
        assert pdf.read(tree(b"/F1 7 0 R", contents, mapped, packed)) == (2, "Aña bcffi\nA", None)


def test_fonts_without_maps_are_told():
    bare = b"7 0 obj << /Type /Font /Subtype /Type0 /Encoding /Identity-H >> endobj\n6 0 obj << /Type /Font /Subtype /Type1 /Encoding << /Differences [1 /a /eacute 65 /fi /period] >> >> endobj\n"
    got = pdf.read(tree(b"/F1 7 0 R /F2 6 0 R", (b"BT /F1 9 Tf <00240025> Tj T* /F2 9 Tf (\\001\\002AB C) Tj ET", b"BT /F2 9 Tf (x) Tj ET"), bare))
    assert got == (2, "aéfi. C\nx", "no map for the codes of /F1")
