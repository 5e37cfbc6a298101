"""PDF bytes written by hand, golden outlines, links, forms, passwords and tables."""

import hashlib
import struct
import zlib

import pytest

from foliograph.sources import files, pdf_tables
from foliograph.sources.pdf import Document, Name, PdfError, PasswordError, Ref, Stream, Text, inflate, parse, scan, unpredict
from foliograph.sources.pdf_crypt import PADDING, Aes, hash_2b, rc4
from foliograph.sources.pdf_merge import Source, merge, selected
from foliograph.sources.pdf_write import compacted, digests, printed, real_text, written


def plain(n, title="p", outline=(), links=()):
    """n pages of A4; outline: (title, page, kids); links: (from, to)."""
    objects = [{"Type": Name("Catalog"), "Pages": Ref(2)}, None]
    pages = []
    for k in range(n):
        objects.append(Stream({}, f"{title} {k + 1}/{n}".encode()))
        objects.append({"Type": Name("Page"), "Parent": Ref(2), "Contents": Ref(len(objects))})
        pages.append(len(objects))
    objects[1] = {"Type": Name("Pages"), "Kids": [Ref(p) for p in pages], "Count": n, "MediaBox": [0, 0, 595, 842], "Rotate": 0}
    for a, b in links:
        objects.append({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [0, 0, 9, 9], "Dest": [Ref(pages[b - 1]), Name("Fit")] if isinstance(b, int) else b})
        objects[pages[a - 1] - 1].setdefault("Annots", []).append(Ref(len(objects)))

    def level(items, parent):
        nums = []
        for _ in items:
            objects.append(None)
            nums.append(len(objects))
        for k, (text, page, kids) in enumerate(items):
            d = {"Title": Text(text.encode()), "Parent": Ref(parent), "Dest": [Ref(pages[page - 1]), Name("Fit")] if isinstance(page, int) else page}
            d |= {"Next": Ref(nums[k + 1])} if k + 1 < len(nums) else {}
            if kids:
                d |= {"First": Ref(level(kids, nums[k])[0]), "Count": len(kids)}
            objects[nums[k] - 1] = d
        return nums

    if outline:
        objects.append({"Type": Name("Outlines")})
        top = len(objects)
        objects[top - 1]["First"] = Ref(level(outline, top)[0])
        objects[0]["Outlines"] = Ref(top)
    return objects


OUTLINE = (("Cap1", 1, ()), ("Cap2", 3, (("Sec2.1", 4, ()),)), ("Cap3", 5, ()))
LINKS = ((1, 3), (2, 5), (3, 5), (4, 1))


def shown(data):
    """(outline rows, links, page mode) of a file."""
    doc = parse(data)
    number = {p.num: k for k, p in enumerate(doc.pages(), 1)}
    rows, links = [], []

    def level(ref, depth):
        while isinstance(ref, Ref):
            d = doc.mapping(ref)
            rows.append((bytes(d["Title"]).decode(), depth, number[d["Dest"][0].num]))
            level(d.get("First"), depth + 1)
            ref = d.get("Next")

    level(doc.mapping(doc.root.get("Outlines")).get("First"), 0)
    for k, p in enumerate(doc.pages(), 1):
        for a in map(doc.mapping, doc.resolve(p.attrs.get("Annots")) or []):
            links.append((k, number[a["Dest"][0].num] if "Dest" in a else "inert"))
    return rows, links, doc.root.get("PageMode")


def source(objects, spec="", title=""):
    doc = parse(written(objects, 1))
    return Source(doc, selected(doc.pages(), spec), title)


def test_scanner():
    value, _, _ = scan(b"<< /A 1 % note\n/B [1 0 R -.5 (a\\(b\\)(c)\\101\\\n) <4 1 4> true null] /A 3 /N#20x 1.2.3 /S + /U what >>")
    assert value == {"A": 3, "B": [Ref(1), -0.5, b"a(b)(c)A", b"A@", True, None], "N x": 0.0, "S": 0, "U": None}
    assert isinstance(scan(b"99999999999999999999")[0], float)
    assert scan(b"[" * 5000 + b"]" * 5000)[0] is not None


@pytest.mark.parametrize("value", [None, True, -3, 0.5, Name("a b#/"), Text(b"(x)\\\n"), Text(b"\xfe\xff\x00"), [1, [Ref(2)]], {"K": {"L": []}}])
def test_printing_and_scanning_back(value):
    assert scan(printed(value))[0] == value


def test_real_text():
    assert [real_text(x) for x in (0.00048828125, 1e20, -0.0, float("nan"), 2.5, 1e-7)] == ["0.00048828125", "100000000000000000000", "0", "0", "2.5", "0.0000001"]


def test_filters():
    data = bytes(range(200)) * 20
    packed = zlib.compress(data)
    assert inflate(packed) == inflate(packed[:-2] + b"xx") == inflate(packed[2:-4]) == data
    assert data.startswith(inflate(packed[: len(packed) // 2]))
    rows = b"\x00\x01\x02\x03" + b"\x01\x01\x01\x01" + b"\x02\x01\x01\x01" + b"\x03\x02\x02\x02" + b"\x04\x01\x00\x00"
    assert unpredict(rows + b"\x00\x01", 15, 1, 8, 3) == bytes([1, 2, 3, 1, 2, 3, 2, 3, 4, 3, 5, 6, 4, 5, 6])
    assert unpredict(bytes([250, 10, 1, 1]), 2, 1, 8, 2) == bytes([250, 4, 1, 2])


def stream_file():
    """Three pages in an object stream, with a cross-reference stream and a predictor."""
    inner = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R 4 0 R 5 0 R 3 0 R null]/Count 3/MediaBox[0 0 9 9]>>", 3: b"<</Type/Page/Parent 2 0 R>>", 4: b"<</Type/Page/Parent 2 0 R/Rotate 90>>", 5: b"<</Type/Page/Parent 2 0 R>>"}
    heads, body = [], b""
    for n, b in inner.items():
        heads.append(f"{n} {len(body)}")
        body += b + b" "
    head = (" ".join(heads) + " ").encode()
    packed = zlib.compress(head + body)
    out = b"junk\n%PDF-1.5\n"
    at = len(out) - 5
    out += b"6 0 obj\n<</Type/ObjStm/N 5/First %d/Length %d/Filter/FlateDecode>>stream\r\n" % (len(head), len(packed)) + packed + b"\nendstream\nendobj\n"
    where = len(out) - 5
    rows = [struct.pack(">BHB", 2, 6, k) for k in range(5)] + [struct.pack(">BHB", 1, at, 0), struct.pack(">BHB", 1, where, 0)]
    coded, last = b"", bytes(4)
    for r in rows:
        coded += b"\x02" + bytes((a - b) & 255 for a, b in zip(r, last, strict=True))
        last = r
    table = zlib.compress(coded)
    return out + b"7 0 obj\n<</Type/XRef/Size 8/W[1 2 1]/Index[1 7]/Root 1 0 R/Length %d/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 4>>>>stream\n" % len(table) + table + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % where


def test_streams_of_objects_and_recovery():
    data = stream_file()
    doc = parse(data)
    assert [(p.num, p.attrs["MediaBox"], p.attrs.get("Rotate")) for p in doc.pages()] == [(3, [0, 0, 9, 9], None), (4, [0, 0, 9, 9], 90), (5, [0, 0, 9, 9], None)]
    assert not doc.rebuilt
    broken = parse(data.replace(b"startxref", b"startxxxx"))
    assert broken.rebuilt and len(broken.pages()) == 3
    moved = written(plain(2), 1).replace(b"3 0 obj", b"   3 0 obj", 1)
    assert len(parse(moved).pages()) == 2
    with pytest.raises(PdfError):
        parse(b"%PDF-1.4 nothing here")
    with pytest.raises(PdfError):
        parse(b"no header")


def test_newest_section_wins_and_lengths_are_checked():
    base = written(plain(1), 1)
    at = len(base)
    update = base + b"3 0 obj\n<</Length -5>>stream\nnew text\nendstream\nendobj\n"
    x = len(update)
    update += b"xref\n3 1\n%010d 00000 n \ntrailer\n<</Size 5/Root 1 0 R/Prev %d>>\nstartxref\n%d\n%%%%EOF" % (at, base.rindex(b"xref\n0"), x)
    doc = parse(update)
    assert doc.get(3).raw == b"new text" and not doc.rebuilt
    freed = update[:x] + b"xref\n3 1\n%010d 00001 f \ntrailer\n<</Size 5/Root 1 0 R/Prev %d>>\nstartxref\n%d\n%%%%EOF" % (0, base.rindex(b"xref\n0"), x)
    assert parse(freed).get(3).raw == b"p 1/1"


def test_merge_keeps_pages_and_shares_equal_objects():
    a, b = source(plain(3, "a")), source(plain(2, "b"))
    data, stats = merge([a, b, source(plain(3, "a"))])
    doc = parse(data)
    assert stats["pages"] == 8 and len(doc.pages()) == 8 and not doc.rebuilt
    assert [doc.resolve(p.attrs["Contents"]).raw for p in doc.pages()][3:5] == [b"b 1/2", b"b 2/2"]
    assert stats["merged"] == 3 and stats["bytes_saved"] == 15  # the texts of a, once more
    same, stats = merge([Source(a.doc, a.doc.pages() + a.doc.pages()[:1])])
    assert len(parse(same).pages()) == 4
    with pytest.raises(PdfError):
        selected(a.doc.pages(), "5")


FILE_A = plain(1, "a")
WHOLE = [("Cap1", 1, 1), ("Cap2", 1, 3), ("Sec2.1", 2, 4), ("Cap3", 1, 5)]
PART = [("Cap2", 1, 1), ("Sec2.1", 2, 2), ("Cap3", 1, 3)]


@pytest.mark.parametrize("named", [False, True])
def test_outlines_and_links(named):
    links, outline = LINKS, OUTLINE
    objects = plain(5, "l", outline, links)
    if named:  # the same targets by name: in the catalog, in a tree, and through an action
        pages = [n for n, o in enumerate(objects, 1) if isinstance(o, dict) and o.get("Type") == "Page"]
        goal = lambda k: [Ref(pages[k - 1]), Name("Fit")]
        objects[0]["Dests"] = {"three": goal(3), "one": {"D": goal(1)}}
        objects[0]["Names"] = {"Dests": {"Kids": [{"Names": [Text(b"five"), goal(5), Text(b"three"), goal(1)]}]}}
        names = {3: Name("three"), 5: Text(b"five"), 1: Text(b"one")}
        objects = plain(5, "l", outline, [(a, names[b]) for a, b in links])
        objects[0] |= {"Dests": {"three": goal(3), "one": {"D": goal(1)}}, "Names": {"Dests": {"Kids": [{"Names": [Text(b"five"), goal(5), Text(b"three"), goal(1)]}]}}}
    mode = Name("UseOutlines")
    assert shown(merge([source(objects, title="links"), source(FILE_A, title="a")])[0]) == ([("links", 0, 1), *WHOLE, ("a", 0, 6)], list(LINKS), mode)
    assert shown(merge([source(objects, "3-5", "links"), source(FILE_A, title="a")])[0]) == ([("links", 0, 1), *PART, ("a", 0, 4)], [(1, 3), (2, "inert")], mode)
    assert shown(merge([source(objects, title="links")])[0])[0] == [(t, d - 1, p) for t, d, p in WHOLE]
    assert shown(merge([source(objects), source(FILE_A)], "none")[0]) == ([], list(LINKS), None)


def test_forms_merge():
    def form(field):
        objects = plain(1)
        objects.append({"Type": Name("Annot"), "Subtype": Name("Widget"), "Rect": [0, 0, 1, 1], "FT": Name("Tx"), "T": Text(field), "V": Text(b"v")})
        objects[3]["Annots"] = [Ref(len(objects))]
        objects[0]["AcroForm"] = {"Fields": [Ref(len(objects))], "SigFlags": 3, "DR": {"Font": {"F1": {"Type": Name("Font")}}}}
        return source(objects)

    data, stats = merge([form(b"name"), form(b"name"), form(b"name_2")])
    doc = parse(data)
    acro = doc.mapping(doc.root["AcroForm"])
    assert sorted(bytes(doc.mapping(f)["T"]) for f in acro["Fields"]) == [b"name", b"name_2", b"name_2_2"]
    assert acro["SigFlags"] == 1 and stats["renamed"] == 2 and stats["fields"] == 3


def test_digests_of_cycles_and_leaves():
    same = digests({1: {"X": Ref(2)}, 2: {"X": Ref(1)}, 3: {"X": Ref(4)}, 4: {"X": Ref(3)}, 5: [1, 2], 6: [1, 2], 7: [Ref(1)], 8: [Ref(1)], 9: {"Type": Name("Annot")}, 10: {"Type": Name("Annot")}, 11: {"A": Name("x")}, 12: {"A": Text(b"x")}})
    assert len({same[k] for k in (1, 2, 3, 4)}) == 4
    assert same[5] == same[6] and same[7] == same[8] and same[9] != same[10] and same[11] != same[12]
    objects, root, stats = compacted([{"K": [Ref(2), Ref(3)]}, Stream({}, b"abc"), Stream({"Length": 9}, b"abc"), [Ref(2)]], 1)
    assert stats == {"merged": 1, "bytes_saved": 3, "kept": 2} and objects[root - 1] == {"K": [Ref(2), Ref(2)]}


def sealed(revision, method, user=b"", owner=b"own"):
    """A one-page file encrypted by hand."""
    first = b"0123456789abcdef"
    if revision >= 5:
        made = hash_2b if revision >= 6 else lambda p, s, e: hashlib.sha256(p + s + e).digest()
        key = bytes(range(32))
        u = made(user, b"12345678", b"") + b"12345678abcdefgh"
        ue = Aes(made(user, b"abcdefgh", b"")).chain_encrypt(bytes(16), key)
        o = made(owner, b"87654321", u) + b"87654321hgfedcba"
        oe = Aes(made(owner, b"hgfedcba", u)).chain_encrypt(bytes(16), key)
        head = {"V": 5, "UE": Text(ue), "OE": Text(oe)}
    else:
        n = 5 if revision == 2 else 16
        digest = hashlib.md5((owner + PADDING)[:32]).digest()
        for _ in range(50 if revision > 2 else 0):
            digest = hashlib.md5(digest).digest()
        o = (user + PADDING)[:32]
        for k in range(20 if revision > 2 else 1):
            o = rc4(bytes(b ^ k for b in digest[:n]), o)
        key = hashlib.md5((user + PADDING)[:32] + o + struct.pack("<i", -4) + first).digest()
        for _ in range(50 if revision > 2 else 0):
            key = hashlib.md5(key[:n]).digest()
        key = key[:n]
        u = rc4(key, PADDING)
        if revision > 2:
            u = hashlib.md5(PADDING + first).digest()
            for k in range(20):
                u = rc4(bytes(b ^ k for b in key), u)
            u += bytes(16)
        head = {"V": {2: 1, 3: 2, 4: 4}[revision]}
    head |= {"Filter": Name("Standard"), "R": revision, "O": Text(o), "U": Text(u), "P": -4, "Length": 128}
    if revision >= 4:
        head |= {"CF": {"StdCF": {"CFM": Name(method)}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}

    def lock(num, data):
        if revision < 5:
            own = hashlib.md5(key + struct.pack("<I", num)[:3] + b"\0\0" + (b"sAlT" if method == "AESV2" else b"")).digest()[: min(len(key) + 5, 16)]
        else:
            own = key
        if method == "V2":
            return rc4(own, data)
        pad = 16 - len(data) % 16
        return bytes(16) + Aes(own).chain_encrypt(bytes(16), data + bytes([pad]) * pad)

    objects = plain(1, "secret")
    objects[2] = Stream({"Note": Text(lock(3, b"a note"))}, lock(3, objects[2].raw))
    data = written([*objects, head], 1)
    return data.replace(b"trailer\n<<", b"trailer\n<< /Encrypt %d 0 R /ID [<%s> <%s>]" % (len(objects) + 1, first.hex().encode(), first.hex().encode()))


CASES = [(r, m, u, g) for r, m in [(2, "V2"), (3, "V2"), (4, "V2"), (4, "AESV2"), (5, "AESV3")] for u, g in [(b"", ""), (b"pw", "pw"), (b"pw", "own")]]


@pytest.mark.parametrize(("revision", "method", "user", "given"), [*CASES, (6, "AESV3", b"pw", "own")])
def test_passwords(revision, method, user, given):
    doc = parse(sealed(revision, method, user), (given,))
    assert doc.get(3).raw == b"secret 1/1" and doc.get(3).head["Note"] == b"a note"
    assert doc.opener.restricted == ((-4 & 0xF3C) != 0xF3C)
    if user and revision < 6:
        with pytest.raises(PasswordError):
            parse(sealed(revision, method, user), ("wrong",))


def test_tables(spark):
    rows = [("a", written(plain(3), 1)), ("b", b"broken"), ("c", sealed(4, "AESV2", b"x")), ("d", written(plain(3), 1)), ("e", None)]
    files_ = spark.createDataFrame(rows, "doc_id string, content binary")
    got = {r["doc_id"]: r for r in pdf_tables.documents(files_).collect()}
    assert [got[k]["status"] for k in "abcde"] == ["OK", "Fail", "Skip", "OK", "Fail"]
    assert {r["doc_id"]: r["pages"] for r in pdf_tables.documents(files_, ("x",)).collect()}["c"] == 1
    with pytest.raises(Exception, match="no PDF header|no password fits"):
        pdf_tables.strict(pdf_tables.documents(files_)).collect()
    objs = pdf_tables.objects(files_)
    assert objs.where("type_name = 'Page'").count() == 6 and pdf_tables.edges(objs).count() > 0
    shared = pdf_tables.shared_objects(objs)
    assert shared.where("key <> keeper").count() == 3  # the three texts; pages stay apart
    groups = files_.selectExpr("'g' AS `group`", "1 AS src_ord", "doc_id AS title", "'1-2' AS spec", "coalesce(content, cast('' as binary)) AS content")
    assert pdf_tables.merge_groups(groups).first()["status"] == "Fail"
    best = pdf_tables.merge_groups(groups, skip_errors=True).first()
    assert best["status"] == "OK" and best["files"] == 2 and len(parse(bytes(best["content"])).pages()) == 4


def test_stream_of_files(spark, tmp_path):
    from foliograph.streaming.folder import watched_documents

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(written(plain(2), 1))
    (tmp_path / "in" / "b.pdf").write_bytes(b"broken")
    q = watched_documents(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["status"], r["pages"]) for r in spark.table("watched").collect()} == {("OK", 2), ("Fail", 0)}


def test_expand(tmp_path):
    for name in ("foto10.pdf", "foto2.pdf", "x.txt", ".hid/h.pdf", "sub/deep/z.pdf", "sub/y.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    pdf = lambda n: n.endswith(".pdf")
    rel = lambda found: [str(p)[len(str(tmp_path)) + 1 :] for p in found]
    assert rel(files.expand([str(tmp_path)], pdf)[0]) == ["foto2.pdf", "foto10.pdf"]
    assert rel(files.expand([str(tmp_path / "**/*.pdf")], pdf)[0]) == ["foto2.pdf", "foto10.pdf", "sub/y.pdf", "sub/deep/z.pdf"]
    assert rel(files.expand([str(tmp_path / "x.txt"), str(tmp_path / "x.txt")], pdf)[0]) == ["x.txt"]
    assert "foto2.pdf" in files.expand([str(tmp_path / "foot2.pdf")])[1][0]
    assert files.split_spec("a@b.pdf@1-3") == ("a@b.pdf", "1-3") and files.split_spec("a@b") == ("a@b", "")
    files.write_atomic(str(tmp_path / "o.pdf"), b"x")
    with pytest.raises(FileExistsError):
        files.check_output(str(tmp_path / "o.pdf"), [])
    with pytest.raises(ValueError):
        files.check_output(str(tmp_path / "o.pdf"), [str(tmp_path / "o.pdf")], force=True)


def test_objects_that_need_themselves():
    doc = Document(b"")
    assert doc.resolve(Ref(9)) is None
    objects = plain(1)
    objects[2] = Ref(3)
    assert len(parse(written(objects, 1)).pages()) == 1


def test_page_tree_nodes():
    objects = plain(2)
    pages = [n for n, o in enumerate(objects, 1) if isinstance(o, dict) and o.get("Type") == "Page"]
    objects[pages[0] - 1]["Type"] = Name("Pages")  # no kids but contents: a page
    objects.append({"Type": Name("Foo"), "Kids": [Ref(pages[0])]})
    objects[1]["Kids"] = [Ref(pages[0]), Ref(pages[1]), Ref(len(objects)), None, 7]
    assert [p.num for p in parse(written(objects, 1)).pages()] == [*pages, len(objects)]
    objects[1]["Kids"] = [{"Type": Name("Pages")}]
    with pytest.raises(PdfError, match="no kids"):
        parse(written(objects, 1)).pages()
    objects[1]["Kids"] = []
    with pytest.raises(PdfError, match="no pages"):
        parse(written(objects, 1)).pages()


def test_paths(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert files.shown("-") == "(standard input)" and files.shown("a/b.pdf") == "a/b.pdf"
    assert files.shown(str(tmp_path.parent / "x.pdf")) == str(tmp_path.parent / "x.pdf") and files.shown(f"{tmp_path}x/y") == f"{tmp_path}x/y"
    assert [files.with_extension(p, ".png") for p in ("photo.webp", "a.b/c", "a.b/c.d.e", ".rc", "x.")] == ["photo.png", "a.b/c.png", "a.b/c.d.png", ".png", "x.png"]
