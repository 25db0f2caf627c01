"""Word and Excel files from before 2007: built here, read back, and broken."""

from __future__ import annotations

import random
import struct

import pytest

from lorespark.sources import compound, loaders

FREE, END = 0xFFFFFFFF, 0xFFFFFFFE


def compound_file(parts: dict[str, bytes], cutoff: int = 4096) -> bytes:
    """A compound file: small streams in the mini stream, large ones in sectors of their own."""
    sectors: list[bytes] = []
    table: list[int] = []

    def put(data: bytes) -> int:
        if not data:
            return END
        first = len(sectors)
        many = -(-len(data) // 512)
        for k in range(many):
            sectors.append(data[512 * k : 512 * (k + 1)].ljust(512, b"\0"))
            table.append(first + k + 1 if k + 1 < many else END)
        return first

    mini, mini_table, entries = b"", [], []
    for name, data in parts.items():
        if len(data) < cutoff:
            start, many = len(mini_table), -(-len(data) // 64)
            mini += data.ljust(64 * many, b"\0")
            mini_table += [start + k + 1 if k + 1 < many else END for k in range(many)]
        else:
            start = put(data)
        entries.append((name, 2, start, len(data)))
    entries.insert(0, ("Root Entry", 5, put(mini), len(mini)))
    directory = b""
    for name, kind, start, size in entries:
        raw = name.encode("utf-16-le")
        directory += raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw) + 2, kind, 1) + struct.pack("<3I", FREE, FREE, FREE) + bytes(36) + struct.pack("<IQ", start, size)
    first_dir = put(directory)
    first_mini = put(struct.pack(f"<{len(mini_table)}I", *mini_table).ljust(512 * -(-len(mini_table) // 128), b"\xff"))
    fat, n_fat = len(sectors), -(-(len(sectors) + 1) // 127)
    table += [0xFFFFFFFD] * n_fat
    data = struct.pack(f"<{len(table)}I", *table).ljust(512 * n_fat, b"\xff")
    sectors += [data[512 * k : 512 * (k + 1)] for k in range(n_fat)]
    head = compound.SIGNATURE + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6)
    head += struct.pack("<IIIIIIIIII", 0, n_fat, first_dir, 0, cutoff, first_mini, -(-len(mini_table) // 128), END, 0, *[fat])
    head += struct.pack(f"<{108}I", *[fat + k for k in range(1, n_fat)], *[FREE] * (108 - n_fat + 1))
    return head + b"".join(sectors)


def word(pieces: list[tuple[str, bool]], flags: int = 0x200) -> bytes:
    body, plan, starts, at = b"", b"", [0], 0x400
    for text, wide in pieces:
        raw = text.encode("utf-16-le" if wide else "cp1252")
        plan += struct.pack("<HIH", 0, at if wide else 0x40000000 | at * 2, 0)
        body, at = body + raw, at + len(raw)
        starts.append(starts[-1] + len(text))
    clx = b"\x01" + struct.pack("<H", 3) + b"abc" + b"\x02" + struct.pack("<I", 4 * len(starts) + len(plan)) + struct.pack(f"<{len(starts)}I", *starts) + plan
    head = bytearray(0x400)
    head[:2] = b"\xec\xa5"
    struct.pack_into("<H", head, 10, flags)
    struct.pack_into("<I", head, 0x4C, starts[-1])
    struct.pack_into("<II", head, 0x1A2, 5, len(clx))
    return compound_file({"WordDocument": bytes(head) + body, "1Table": b"\0" * 5 + clx, "Data": b""})


def record(kind: int, data: bytes) -> bytes:
    return struct.pack("<HH", kind, len(data)) + data


def text(value: str, wide: bool = False) -> bytes:
    return struct.pack("<HB", len(value), int(wide)) + value.encode("utf-16-le" if wide else "latin-1")


def workbook(more: bytes = b"") -> bytes:
    cell = lambda r, c: struct.pack("<HHH", r, c, 0)
    rich = struct.pack("<HBHI", 4, 1 | 4 | 8, 1, 3) + "中文ab".encode("utf-16-le") + bytes(4) + b"ext"
    split = struct.pack("<HB", 6, 0) + b"abc"  # goes on in the next record, with wide letters there
    strings = record(0xFC, struct.pack("<II", 3, 3) + text("first") + rich + split) + record(0x3C, b"\x01" + "déf".encode("utf-16-le"))
    out = record(0x809, bytes(16)) + more + strings + record(0x0A, b"") + record(0x809, bytes(16))
    out += record(0xFD, cell(0, 1) + struct.pack("<I", 1)) + record(0xFD, cell(0, 0) + struct.pack("<I", 0)) + record(0x203, cell(1, 0) + struct.pack("<d", 2.5))
    out += record(0x27E, cell(1, 1) + struct.pack("<I", 7 << 2 | 2)) + record(0x27E, cell(1, 2) + struct.pack("<I", (12345 << 2 | 3))) + record(0xBD, struct.pack("<HH", 2, 0) + struct.pack("<HIHI", 0, (1 << 32) - (3 << 2) | 2, 0, 0x3FF00000) + struct.pack("<H", 1))
    out += record(0x06, cell(3, 0) + b"\0" + bytes(5) + b"\xff\xff" + bytes(8)) + record(0x207, text("made")) + record(0x06, cell(3, 1) + struct.pack("<d", 4.0) + bytes(8)) + record(0x0A, b"")
    return out + record(0x809, bytes(16)) + record(0xFD, cell(0, 0) + struct.pack("<I", 2)) + record(0x204, cell(9, 0) + text("plain")) + record(0x0A, b"")


def test_word():
    pieces = [("First café – one.\r", False), ("中文 second\x0bline.\r\r", True), ("see \x13 HYPERLINK \"x\" \x14link\x15 and \x13 PAGE \x15.\rcell\x07two\x07\r", False)]
    assert compound.load_doc(word(pieces)) == ["First café – one.\n\n中文 second\nline.\n\nsee link and .\n\ncell\ttwo\t"]
    long = "Long words here. " * 2000
    assert compound.load_doc(word([(long, True), (long, False)])) == [long * 2]  # in sectors of its own
    with pytest.raises(compound.BadFile, match="encrypted"):
        compound.load_doc(word(pieces, 0x300))
    with pytest.raises(compound.BadFile, match="Word"):
        compound.load_doc(compound_file({"Other": b"x" * 9}))


def test_excel():
    rows = ["first\t中文ab", "2.5\t7\t123.45", "-3\t1", "made\t4", "abcdéf", "plain"]
    for pad in (b"", record(0x99, bytes(6000))):  # in the mini stream, and beyond it
        assert compound.load_xls(compound_file({"Workbook": workbook(pad)})) == ["\n".join(rows)]
    with pytest.raises(compound.BadFile, match="encrypted"):
        compound.load_xls(compound_file({"Workbook": workbook(record(0x2F, b"x" * 6))}))
    with pytest.raises(compound.BadFile, match="workbook"):
        compound.load_xls(compound_file({"Book": b"x"}))


def test_broken_chains():
    whole = word([("Some text. " * 900, False)])
    for content in (b"", b"x" * 600, whole[:700], whole[:5000], compound.SIGNATURE + bytes(600)):
        with pytest.raises((compound.BadFile, struct.error)):
            compound.load_doc(content)
    with pytest.raises(compound.BadFile, match="chain"):
        compound._chain([1, 2, 0], 0)
    rng = random.Random(2)
    for _ in range(200):
        bad = bytearray(whole)
        for _ in range(rng.randint(1, 6)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        try:
            assert isinstance(compound.load_doc(bytes(bad))[0], str)
        except (ValueError, struct.error, IndexError):
            pass


def test_as_rows(spark, tmp_path):
    (tmp_path / "a.doc").write_bytes(word([("Old one.\r", False)]))
    (tmp_path / "b.XLS").write_bytes(compound_file({"Workbook": workbook()}))
    (tmp_path / "c.doc").write_bytes(word([("Old one.\r", False)])[:900])
    rows = {r.file: r for r in loaders.load(loaders.scan(spark, str(tmp_path))).collect()}
    assert rows["a.doc"].text == "Old one." and rows["b.XLS"].text.startswith("first\t中文ab\n") and rows["c.doc"].error.startswith("BadFile")
