import datetime as dt
import os
import random
import struct
import zipfile
import zlib
from xml.etree import ElementTree as ET

import numpy as np
import pytest

from gridloom.errors import SheetError
from gridloom.functions import semantics as S
from gridloom.functions.sketches import HyperLogLog, TDigest
from gridloom.functions.sketches.xxh64 import xxh64_intdigest
from gridloom.sources import sidecar
from gridloom.sources.workbook import Workbook, cells
from gridloom.sources.writer import WorkbookWriter

VECTOR = os.path.join(os.path.dirname(os.path.abspath(__file__)), "vectors", "sheet-350.hex")


def make(path, rows=500, **options):
    out = WorkbookWriter(str(path), every=options.pop("every", 100), stats=["id", "amount"], sketches=["amount", "city"], **options)
    out.start_sheet("data", ["id", "amount", "city", "flag"])
    out.write_rows((i, i * 1.25 if i % 10 else "n/a", f"city-{i % 25}", i % 2 == 0) for i in range(1, rows + 1))
    return out.finish()


def test_index_bytes_are_as_they_were(tmp_path):
    """The index of a fixed sheet against bytes that were kept, so that files written earlier stay readable."""
    make(tmp_path / "a.xlsx", 350)
    data = zipfile.ZipFile(tmp_path / "a.xlsx").read(sidecar.PART)
    kept = bytes.fromhex(open(VECTOR).read())
    assert sidecar.encode(sidecar.decode(kept)) == kept
    (own,), (old,) = sidecar.decode(data).sheets, sidecar.decode(kept).sheets
    # What the compressor gives may differ by its version; rows, places in the XML, checksums and statistics don't.
    assert (own.path, own.total_rows, own.crc, own.crcs) == (old.path, old.total_rows, old.crc, old.crcs)
    assert [(p[0], p[2]) for p in own.points] == [(p[0], p[2]) for p in old.points]
    assert own.zones == old.zones and own.digest(2).quantile(0.5) == old.digest(2).quantile(0.5) and own.hll(3).count() == old.hll(3).count() == 25


@pytest.mark.parametrize("quote", ['"', "'"])
def test_shared_strings_in_either_quotes(spark, tmp_path, quote):
    from gridloom.sources.xlsx import register

    cell = lambda ref, kind, v: f"<c r={quote}{ref}{quote} t={quote}{kind}{quote}><v>{v}</v></c>"
    make(tmp_path / "a.xlsx", 3)
    with zipfile.ZipFile(tmp_path / "a.xlsx") as old, zipfile.ZipFile(tmp_path / "b.xlsx", "w") as new:
        for name in old.namelist():
            if name.startswith("xl/worksheets/"):
                new.writestr(name, f"<worksheet><sheetData><row>{cell('A1', 's', 0)}</row><row>{cell('A2', 's', 1)}</row></sheetData></worksheet>")
            elif name != sidecar.PART:
                new.writestr(name, old.read(name))
        new.writestr("xl/sharedStrings.xml", "<sst><si><t>head</t></si><si><t>1 &amp; 2</t></si></sst>")
    register(spark)
    assert [tuple(r) for r in spark.read.format("sheet").load(str(tmp_path / "b.xlsx")).collect()] == [(2, "1 & 2")]


def test_appends_add_and_overwrites_replace(spark, tmp_path):
    from gridloom.sources.xlsx import register

    register(spark)
    folder = str(tmp_path / "books")
    write = lambda lo, mode: spark.range(lo, lo + 100).coalesce(1).write.format("sheet").mode(mode).save(folder)
    read = lambda: sorted(int(r.id) for r in spark.read.format("sheet").load(folder).collect())
    write(0, "append")
    write(100, "append")
    assert read() == list(range(200))
    write(500, "overwrite")
    assert read() == list(range(500, 600))


def test_index_is_refused_or_ignored(tmp_path):
    make(tmp_path / "a.xlsx")
    good = zipfile.ZipFile(tmp_path / "a.xlsx").read(sidecar.PART)
    for n in range(0, len(good), 7):
        with pytest.raises(SheetError):
            sidecar.decode(good[:n])

    def signed(body, head=b"KXSI\x02\x00"):
        return head + struct.pack("<HII", *struct.unpack_from("<HI", good, 6), zlib.crc32(body)) + body

    assert sidecar.decode(signed(good[16:] + b"NEWS\x02\x00\x00\x00hi")).sheets[0].total_rows == 501
    for bad in (signed(good[16:], b"KXSI\x03\x00"), signed(good[16:], b"KXSI\x02\x01"), signed(good[16:], b"XXXX\x02\x00"), signed(good[16:-3]), good[:-1] + bytes([good[-1] ^ 1])):
        with pytest.raises(SheetError):
            sidecar.decode(bad)
    huge = bytearray(good[16:])
    struct.pack_into("<I", huge, 2 + 24 + 8, 0xFFFFFFFF)
    with pytest.raises(SheetError):
        sidecar.decode(signed(bytes(huge)))


def test_any_zip_reader_reads_it(tmp_path):
    assert make(tmp_path / "a.xlsx")["rows"] == 500
    z = zipfile.ZipFile(tmp_path / "a.xlsx")
    assert z.testzip() is None
    root = ET.fromstring(z.read("xl/worksheets/sheet1.xml"))
    assert len(root[0]) == 501
    for name in z.namelist():
        if name.endswith((".xml", ".rels")):
            ET.fromstring(z.read(name))


def test_points_are_resumable_and_stats_hold(tmp_path):
    make(tmp_path / "a.xlsx")
    book = Workbook(str(tmp_path / "a.xlsx"))
    own = book.index.sheets[0]
    assert [p[0] for p in own.points] == [102, 202, 302, 402, 502]
    entry = own.path
    whole = list(book.raw_rows(entry))
    for first, last, begin, end in own.blocks():
        part = list(book.raw_rows(entry, begin, end, first))
        assert part == whole[first - 1 : last]
    zone = own.zones[1].blocks[0]
    assert (zone.min, zone.max, zone.count, zone.other) == (1, 100, 100, 1)
    assert own.zones[1].ascending and not own.zones[1].descending
    assert own.hll(3).count() == 25 and own.digest(2).count == 450
    assert own.digest(2).quantile(1) == 499 * 1.25


def test_verify_names_the_block(tmp_path):
    path = tmp_path / "a.xlsx"
    make(path)
    assert Workbook(str(path)).verify() == [{"sheet": "data", "blocks_checked": 6, "corrupt_blocks": [], "sheet_crc_ok": True, "inflate_ok": True}]
    book = Workbook(str(path))
    at = book.index.sheets[0].points[1][1] + 60 + 30 + len("xl/worksheets/sheet1.xml")
    data = bytearray(path.read_bytes())
    data[at] ^= 0x5A
    path.write_bytes(data)
    (found,) = Workbook(str(path)).verify()
    assert found["corrupt_blocks"] == [2] and not found["sheet_crc_ok"]


def test_a_stale_index_is_no_index(tmp_path):
    make(tmp_path / "a.xlsx")
    with zipfile.ZipFile(tmp_path / "a.xlsx") as old, zipfile.ZipFile(tmp_path / "b.xlsx", "w", zipfile.ZIP_DEFLATED) as new:
        for name in old.namelist():
            data = old.read(name)
            new.writestr(name, data.replace(b"city-3<", b"city-9<") if "sheet1" in name else data)
    assert Workbook(str(tmp_path / "b.xlsx")).index is None


def test_source_prunes_and_gives_the_same_rows(spark, tmp_path):
    from gridloom.sources.xlsx import SheetReader, SheetSource, register

    register(spark)
    make(tmp_path / "a.xlsx", 2000)
    df = spark.read.format("sheet").option("numbers", "id,amount").option("shards", 4).load(str(tmp_path / "a.xlsx"))
    assert df.count() == 2000 and df.rdd.getNumPartitions() >= 4
    got = sorted((r["_row"], r["city"]) for r in df.where("id__num BETWEEN 310 AND 420 AND amount__num > 500").collect())
    assert got == [(i + 1, f"city-{i % 25}") for i in range(310, 421) if i % 10 and i * 1.25 > 500]
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThanOrEqual

    source = SheetSource({"path": str(tmp_path / "a.xlsx"), "numbers": "id"})
    reader = SheetReader(source, None)
    list(reader.pushFilters([GreaterThanOrEqual(("id__num",), 310.0), LessThanOrEqual(("id__num",), 420.0)]))
    parts = reader.partitions()
    assert sum(p.last - p.first + 1 for p in parts) == 200
    raw = spark.read.format("sheet").option("raw", True).option("header", True).load(str(tmp_path / "a.xlsx"))
    assert [c.t for c in raw.where("_row = 3").first().cells] == ["n", "n", "inlineStr", "b"]
    assert raw.where("_row = 1").count() == 1


def test_sink_and_stream(spark, tmp_path):
    from gridloom.sources.xlsx import register
    from gridloom.streaming.folder import register as stream_register

    register(spark)
    stream_register(spark)
    folder = str(tmp_path / "out")
    spark.range(300).selectExpr("id", "concat('n', id) AS name").repartition(3).write.format("sheet").option("stats", "id").option("every", 50).mode("append").save(folder)
    names = sorted(os.listdir(folder))
    assert [n[-10:] for n in names] == [f"{i:05d}.xlsx" for i in range(3)] and len({n[:-10] for n in names}) == 1
    assert sum(spark.read.format("sheet").load(f"{folder}/{n}").count() for n in names) == 300
    query = spark.readStream.format("sheet_folder").load(folder).writeStream.format("memory").queryName("arrived").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.table("arrived").count() == 300


@pytest.mark.parametrize("compact", [False, True])
def test_cells_survive(tmp_path, compact):
    odd = ["", None, "007", "+4", "1.50", "<a & 'b'>", " pad ", "line\nfeed", "é😀", True, 3, 2.5, "x" * 40000, "1234567890123456", dt.datetime(2026, 5, 6, 12)]
    out = WorkbookWriter(str(tmp_path / "a.xlsx"), compact=compact)
    out.start_sheet("a/b", [f"c{i}" for i in range(len(odd))])
    out.write_row(odd)
    out.finish()
    book = Workbook(str(tmp_path / "a.xlsx"))
    assert book.sheets[0][0] == "a_b"
    row = cells(list(book.raw_rows(book.sheets[0][1]))[1][1])
    assert [v for _, v, _ in row] == ["", "", "007", "+4", "1.50", "<a & 'b'>", " pad ", "line\nfeed", "é😀", "1", "3", "2.5", "x" * 40000, "1234567890123456", "46148.5"]
    assert row[9][0] == "b" and row[-1][2] in book.date_styles()


def test_group_aligned_blocks_and_errors(tmp_path):
    out = WorkbookWriter(str(tmp_path / "a.xlsx"), every=100_000, stats=[1], group_column=1)
    out.start_sheet("s", ["grp", "x"])
    out.write_rows(((i - 1) // 137, i) for i in range(1, 1001))
    out.finish()
    blocks = Workbook(str(tmp_path / "a.xlsx")).index.sheets[0].zones[1].blocks
    assert len(blocks) == 8 and all(b.min == b.max for b in blocks)
    for bad in (lambda: WorkbookWriter(str(tmp_path / "b"), every=0), lambda: WorkbookWriter(str(tmp_path / "b"), level=0), lambda: WorkbookWriter(str(tmp_path / "b")).write_row([1]), lambda: WorkbookWriter(str(tmp_path / "b")).finish(), lambda: WorkbookWriter(str(tmp_path / "b")).start_sheet("", ["a"]), lambda: Workbook(__file__)):
        with pytest.raises(SheetError):
            bad()


def test_looks(tmp_path):
    out = WorkbookWriter(str(tmp_path / "a.xlsx"), formats={"when": "isodate", 2: "money", "x": "0.0%"}, bold_header=True, freeze=(1, 0), widths={"x": 30}, autofilter=True)
    out.start_sheet("s", ["when", "x", "y"])
    out.write_row([46148, 0.5, 3])
    out.finish()
    book = Workbook(str(tmp_path / "a.xlsx"))
    xml = book.zip.read("xl/worksheets/sheet1.xml").decode()
    assert "state='frozen'" in xml and "ref='A1:C2'" in xml and "width='30'" in xml
    row = cells(list(book.raw_rows(book.sheets[0][1]))[1][1])
    assert row[0][2] in book.date_styles() and row[1][2] not in book.date_styles() and row[2][2] == 0
    for bad in (lambda: WorkbookWriter(str(tmp_path / "b"), freeze=(-1, 0)), lambda: WorkbookWriter(str(tmp_path / "b"), formats={1: 99}).start_sheet("s", ["a"]), lambda: WorkbookWriter(str(tmp_path / "b"), formats={1: "nosuch"}).start_sheet("s", ["a"])):
        with pytest.raises(SheetError):
            bad()


def test_sheets_split_and_chain(spark, tmp_path, monkeypatch):
    from gridloom.operators import chain
    from gridloom.sources import writer, xlsx

    monkeypatch.setattr(writer, "FULL_SHEET", 100)
    out = WorkbookWriter(str(tmp_path / "a.xlsx"), every=30, stats=["id"])
    out.start_sheet("s", ["id", "name"])
    out.write_rows((i, f"n{i}") for i in range(1, 251))
    assert out.finish()["sheets"] == 3
    book = Workbook(str(tmp_path / "a.xlsx"))
    assert [s.total_rows for s in book.index.sheets] == [100, 100, 53]
    assert chain.offsets([100, 100, 53]) == [0, 99, 198]
    source = xlsx.SheetSource({"path": str(tmp_path / "a.xlsx"), "sheetIndex": "1"})
    reader = xlsx.SheetReader(source, None)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["id"] for r in rows] == [str(i) for i in range(100, 199)] and rows[0]["_row"] == 2
    reader.members = [e for _, e in book.sheets]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["_row"], r["id"]) for r in rows] == [(i + 1, str(i)) for i in range(1, 251)]


def test_gaps_are_bridged(tmp_path):
    from pyspark.sql.datasource import EqualTo

    from gridloom.sources.xlsx import SheetReader, SheetSource

    out = WorkbookWriter(str(tmp_path / "a.xlsx"), every=100, stats=["flag"])
    out.start_sheet("s", ["id", "flag"])
    out.write_rows((i, 500 if i <= 100 or i > 1900 else 1) for i in range(1, 2001))
    out.finish()
    for extra, want in (({}, 2), ({"rttMicros": "30000"}, 1)):
        reader = SheetReader(SheetSource({"path": str(tmp_path / "a.xlsx"), "numbers": "flag", "shards": "1", **extra}), None)
        list(reader.pushFilters([EqualTo(("flag__num",), 500.0)]))
        assert len(reader.partitions()) == want


def test_tokeniser_shapes():
    shapes = ["r='B2'><v>5</v>", "/", "r='B2' t='str'><f>1</f><v>last</v>", "t='e' r='E2'><v>#N/A</v>", "r='F2' t='inlineStr'><is><r><t>a&amp;</t></r>\n<r><t>&#98;</t></r>\n</is>", "t='s' r='G2'><v>1</v>"]
    xml = ("<row r='2'>" + "".join("<c/>" if x == "/" else f"<c {x}</c>" for x in shapes)).encode()
    assert [v for _, v, _ in cells(xml, ["zero", "one"])] == ["", "last", "", "", "#N/A", "a&b", "one"]
    with pytest.raises(SheetError):
        cells(xml, ["zero"])
    with pytest.raises(SheetError):
        cells(b'<row><c r="XFE1"><v>1</v></c>')


@pytest.mark.parametrize(("make_", "tail", "mid"), [(lambda r: r.random(5000), 0.002, 0.005), (lambda r: np.exp(r.normal(size=5000)), 0.002, 0.005), (lambda r: r.integers(0, 21, 5000).astype(float), 0.05, 0.05)])
def test_digest_rank_error(make_, tail, mid):
    x = make_(np.random.default_rng(1234))
    whole, parts = TDigest().add_many(x), [TDigest().add_many(p) for p in np.array_split(x, 7)]
    merged = TDigest()
    for p in parts:
        merged.merge(TDigest.deserialize(p.serialize()))
    for digest in (whole, merged):
        assert digest.count == 5000 and digest.quantile(0) == x.min() and digest.quantile(1) == x.max()
        for q in (0.5, 0.25, 0.75, 0.01, 0.99, 0.001, 0.999):
            value = digest.quantile(q)
            low, high = (x < value).mean(), (x <= value).mean()
            assert low - (tail if q in (0.001, 0.999) else mid) * 2 <= q <= high + (tail if q in (0.001, 0.999) else mid) * 2
    assert TDigest().quantile(0.5) is None and TDigest().add_many([7.0]).quantile(0.3) == 7.0
    for bad in (lambda: TDigest().add_many([float("nan")]), lambda: TDigest().quantile(2), lambda: TDigest.deserialize(b"\x01\x00"), lambda: TDigest.deserialize(whole.serialize()[:-1]), lambda: TDigest(0)):
        with pytest.raises(SheetError):
            bad()


@pytest.mark.parametrize("n", [0, 1, 100, 5000, 40000])
def test_hll_counts_and_merges(n):
    texts = [f"v{i}" for i in range(n)]
    whole = HyperLogLog().add_many(texts)
    assert abs(whole.count() - n) <= max(1, 0.07 * n)
    halves = HyperLogLog().add_many(texts[: n // 2]).merge(HyperLogLog.deserialize(HyperLogLog().add_many(texts[n // 3 :]).serialize()))
    assert halves.serialize() == whole.serialize()


def test_hll_places_are_exact():
    hashes = np.array([0, 1, 1 << 52, (1 << 53) - 1, 1 << 63, 0xFFFFFFFFFFFFFFFF, 12345678901234567890], dtype=np.uint64)
    for p in (4, 11, 18):
        index, rank = HyperLogLog.places(hashes, p)
        for h, i, r in zip(hashes.tolist(), index.tolist(), rank.tolist(), strict=True):
            rest = h << p & (1 << 64) - 1
            assert i == h >> (64 - p)
            assert r == (65 - p if rest == 0 else 65 - rest.bit_length())


def test_plain_xxh64_is_the_library_s():
    xxhash = pytest.importorskip("xxhash")
    rng = random.Random(2)
    for n in [*range(70), 1000]:
        data = rng.randbytes(n)
        assert xxh64_intdigest(data) == xxhash.xxh64_intdigest(data)


def test_scalars():
    assert [S.column_letters(i) for i in (0, 25, 26, 701, 702, 16383)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert all(S.column_index(S.column_letters(i)) == i for i in range(0, 16384, 37))
    assert S.xml_decode(S.xml_escape("a<b>&\"c'\x01d")) == "a<b>&\"c'd"
    assert S.xml_decode("&#x41;&#66;&bad;&amp;lt;") == "AB&bad;&lt;"
    dates = {"yyyy-mm-dd": True, "0.00": False, '"day" 0': False, "[h]:mm": True, "[Red]0": False, "General": False, "h:mm AM/PM": True, "\\d0": False, "#,##0": False}
    assert {k: S.is_date_format(k) for k in dates} == dates
    assert S.clean_sheet_name("a:b*c?" + "x" * 40) == ("a_b_c_" + "x" * 40)[:31] and S.clean_sheet_name("") == "Sheet"


def test_folder_is_read_as_one_table(spark, tmp_path):
    from gridloom.sources.xlsx import register, verified

    register(spark)
    folder = str(tmp_path / "books")
    spark.range(1000).selectExpr("id", "id * 2 AS twice").repartitionByRange(3, "id").sortWithinPartitions("id").write.format("sheet").option("every", 50).option("stats", "id").mode("append").save(folder)
    df = spark.read.format("sheet").option("numbers", "id").load(folder)
    assert sorted((r._row, r.id, r.twice) for r in df.collect()) == [(i + 2, str(i), str(2 * i)) for i in range(1000)]
    assert sorted(r.id for r in df.where("id__num BETWEEN 640 AND 690").collect()) == [str(i) for i in range(640, 691)]
    assert [r._row for r in df.where("_row = 900").collect()] == [900]
    seen = verified(spark, folder).collect()
    assert len(seen) == 3 and sum(r.rows for r in seen) == 1000 and all(r.sheet_crc_ok and not r.corrupt_blocks for r in seen)
    bad = sorted((tmp_path / "books").glob("part-*-00001.xlsx"))[0]
    data = bytearray(bad.read_bytes())
    data[400] ^= 0xFF
    bad.write_bytes(bytes(data))
    assert [r.sheet_crc_ok for r in sorted(verified(spark, folder).collect(), key=lambda r: r.path)] == [True, False, True]
    make(tmp_path / "books" / "z.xlsx")
    with pytest.raises(Exception, match="another header"):
        spark.read.format("sheet").load(folder).count()
