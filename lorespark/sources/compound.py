"""Text of Word and Excel files from before 2007: a file system of sectors in one file, and the records inside."""

from __future__ import annotations

import re
import struct

SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
LAST = 0xFFFFFFFA  # numbers from here on name no sector


class BadFile(ValueError):
    """The file cannot be read."""


def _chain(table: list[int], start: int) -> list[int]:
    """The sectors that follow each other from ``start`` on."""
    found, seen = [], set()
    while start < LAST:
        if start >= len(table) or start in seen:
            raise BadFile("a chain of sectors is broken")
        seen.add(start)
        found.append(start)
        start = table[start]
    return found


def streams(content: bytes) -> dict[str, bytes]:
    """The named streams of a compound file."""
    if content[:8] != SIGNATURE or len(content) < 512:
        raise BadFile("no compound file")
    shift, mini_shift = struct.unpack_from("<HH", content, 30)
    first_dir, _, cutoff, first_mini, n_mini, first_more, _ = struct.unpack_from("<7I", content, 48)
    if not (7 <= shift <= 16 and 4 <= mini_shift <= shift):
        raise BadFile("sizes of sectors make no sense")
    size = 1 << shift

    def sector(n: int) -> bytes:
        data = content[(n + 1) << shift : (n + 2) << shift]
        if not data:
            raise BadFile("a sector lies beyond the file")
        return data.ljust(size, b"\0")

    numbers = lambda data: list(struct.unpack(f"<{len(data) // 4}I", data))
    places, seen = list(struct.unpack_from("<109I", content, 76)), set()
    while first_more < LAST and first_more not in seen:
        seen.add(first_more)
        *more, first_more = numbers(sector(first_more))
        places += more
    table = [x for p in places if p < LAST for x in numbers(sector(p))]
    joined = lambda start: b"".join(map(sector, _chain(table, start)))
    entries, found = joined(first_dir), {}
    mini_table = numbers(joined(first_mini)) if n_mini and first_mini < LAST else []
    mini = b""
    for at in range(0, len(entries), 128):
        kind, length = entries[at + 66], struct.unpack_from("<H", entries, at + 64)[0]
        start, many = struct.unpack_from("<II", entries, at + 116)
        if kind == 5:
            mini = joined(start) if start < LAST else b""
        elif kind == 2:
            name = entries[at : at + max(0, length - 2)].decode("utf-16-le", "replace")
            if many < cutoff:
                data = b"".join(mini[s << mini_shift : (s + 1) << mini_shift] for s in _chain(mini_table, start)) if many else b""
            else:
                data = joined(start)
            if len(data) < many:
                raise BadFile(f"the stream {name} is cut off")
            found.setdefault(name, data[:many])
    return found


def load_doc(content: bytes) -> list[str]:
    """Paragraphs of a Word document, parted by empty lines; its pieces in order, instructions of fields left out."""
    parts = streams(content)
    main = parts.get("WordDocument", b"")
    if len(main) < 0x1AA or main[:2] != b"\xec\xa5":
        raise BadFile("no Word document")
    (flags,) = struct.unpack_from("<H", main, 10)
    if flags & 0x100:
        raise BadFile("the file is encrypted")
    table = parts.get("1Table" if flags & 0x200 else "0Table", b"")
    (letters,), (at, size) = struct.unpack_from("<I", main, 0x4C), struct.unpack_from("<II", main, 0x1A2)
    pieces, end = table[at : at + size], 0
    while end < len(pieces) and pieces[end] == 1:  # settings come first
        end += 3 + struct.unpack_from("<H", pieces, end + 1)[0]
    if end + 5 > len(pieces) or pieces[end] != 2:
        raise BadFile("no table of pieces")
    (size,) = struct.unpack_from("<I", pieces, end + 1)
    plan = pieces[end + 5 : end + 5 + size]
    n = (len(plan) - 4) // 12
    starts, text = struct.unpack_from(f"<{n + 1}I", plan), []
    for i in range(n):
        (where,) = struct.unpack_from("<I", plan, 4 * (n + 1) + 8 * i + 2)
        many = starts[i + 1] - starts[i]
        if where & 0x40000000:
            where = (where & 0x3FFFFFFF) // 2
            text.append(main[where : where + many].decode("cp1252", "replace"))
        else:
            text.append(main[where : where + 2 * many].decode("utf-16-le", "replace"))
    said = "".join(text)[:letters]
    said = re.sub(r"\x13[^\x13\x14\x15]*\x14([^\x13\x14\x15]*)\x15", r"\1", said)
    said = re.sub(r"\x13[^\x15]*\x15", "", said).replace("\x0b", "\n").replace("\x07", "\t")
    paragraphs = [re.sub(r"[\x00-\x08\x0c\x0e-\x1f]", "", p) for p in re.split(r"[\r\x0c]", said)]
    return ["\n\n".join(p for p in paragraphs if p.strip())]


class _Strings:
    """Reads the strings of a record that goes on in others; where it does, a string says anew how wide its letters are."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.part < len(self.parts):
            got = self.parts[self.part][self.at : self.at + n]
            out, n, self.at = out + got, n - len(got), self.at + len(got)
            if n:
                self.part, self.at = self.part + 1, 0
        if n:
            raise BadFile("strings are cut off")
        return out

    def string(self) -> str:
        (many,), flags = struct.unpack("<H", self.take(2)), self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        more = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = []
        while many:
            left = len(self.parts[self.part]) - self.at if self.part < len(self.parts) else 0
            if not left:
                self.part, self.at = self.part + 1, 0
                flags = self.take(1)[0]
                continue
            width = 1 + (flags & 1)
            now = min(many, left // width)
            out.append(self.take(now * width).decode("utf-16-le" if width == 2 else "latin-1", "replace"))
            many -= now
        self.take(4 * runs + more)
        return "".join(out)


def _shown(number: float) -> str:
    return str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(number)


def _packed(rk: int) -> float:
    number = float(rk >> 2 if rk < 1 << 31 else (rk - (1 << 32)) >> 2) if rk & 2 else struct.unpack("<d", struct.pack("<Q", (rk & ~3) << 32))[0]
    return number / 100 if rk & 1 else number


def load_xls(content: bytes) -> list[str]:
    """Rows of all sheets, one line each, cells parted by tabs."""
    book = streams(content).get("Workbook")
    if book is None:
        raise BadFile("no workbook of Excel 97 or later")
    records, at = [], 0
    while at + 4 <= len(book):
        kind, size = struct.unpack_from("<HH", book, at)
        if at + 4 + size > len(book):
            raise BadFile("a record is cut off")
        records.append((kind, book[at + 4 : at + 4 + size]))
        at += 4 + size
    shared: list[str] = []
    cells: dict[tuple[int, int, int], str] = {}
    sheet, waiting = -1, None
    for i, (kind, data) in enumerate(records):
        place = (sheet, *struct.unpack_from("<HH", data)) if len(data) >= 4 else None
        if kind == 0x2F:
            raise BadFile("the file is encrypted")
        if kind == 0x809:  # the beginning of a part: the first is the workbook's own
            sheet += 1
        elif kind == 0xFC:
            parts = [data[8:]]
            for more, rest in records[i + 1 :]:
                if more != 0x3C:
                    break
                parts.append(rest)
            reader = _Strings(parts)
            shared = [reader.string() for _ in range(struct.unpack_from("<I", data, 4)[0])]
        elif kind == 0xFD:
            cells[place] = shared[struct.unpack_from("<I", data, 6)[0]]
        elif kind == 0x204:
            cells[place] = _Strings([data[6:]]).string()
        elif kind == 0x203:
            cells[place] = _shown(struct.unpack_from("<d", data, 6)[0])
        elif kind == 0x27E:
            cells[place] = _shown(_packed(struct.unpack_from("<I", data, 6)[0]))
        elif kind == 0xBD:
            for k in range((len(data) - 6) // 6):
                cells[sheet, place[1], place[2] + k] = _shown(_packed(struct.unpack_from("<I", data, 6 + 6 * k)[0]))
        elif kind == 0x205:
            cells[place] = str(data[6]) if not data[7] else ""
        elif kind == 0x06:
            if data[12:14] != b"\xff\xff":
                cells[place] = _shown(struct.unpack_from("<d", data, 6)[0])
            elif data[6] == 0:
                waiting = place  # its string follows
            elif data[6] == 1:
                cells[place] = str(data[8])
        elif kind == 0x207 and waiting is not None:
            cells[waiting], waiting = _Strings([data]).string(), None
    rows: dict[tuple[int, int], list[str]] = {}
    for (of, row, _), value in sorted(cells.items()):
        rows.setdefault((of, row), []).append(value)
    return ["\n".join("\t".join(r) for r in rows.values())]
