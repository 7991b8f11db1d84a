"""The embedded text of PDF files, in plain Python.

Objects are found by their "n g obj" marks, so files with a broken cross-reference table are read too;
object streams and Flate streams are inflated. Pages are taken in the order of the page
tree. Strings are decoded by their font's ToUnicode map where it has one, else as Latin-1
or UTF-16. A new line begins where the text position moves down, a blank where it moves on
by more than a fifth of an em. Encrypted files and those without text give ''.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
_TOKEN = re.compile(
    rb"""%[^\r\n]*|(?P<string>\()|<<|>>|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<open>\[)|(?P<close>\])|/(?P<name>[^\s()<>\[\]{}/%]*)|(?P<number>[-+]?(?:\d+\.?\d*|\.\d+))|(?P<word>[^\s()<>\[\]{}/%]+)""",
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string whose opening bracket is before ``at``, and the place after it."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(data, at + 1)
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
                continue
            nxt = data[at + 1 : at + 2]
            out += b"" if nxt in (b"\n", b"\r") else _ESCAPES.get(nxt, nxt)
            at += 2
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if depth == 0:
            break
        out += c
    return bytes(out), at


def _tokens(data: bytes) -> Iterator[tuple[str, object]]:
    """(kind, value): string, name, number, word, open, close, and mark for << and >>."""
    at = 0
    while m := _TOKEN.search(data, at):
        at = m.end()
        kind = m.lastgroup
        if kind == "string":
            value, at = _string(data, at)
            yield "string", value
        elif kind == "hex":
            digits = re.sub(rb"\s", b"", m["hex"])
            yield "string", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif kind == "number":
            yield "number", float(m[0])
        elif kind:
            yield kind, m[kind].decode("latin-1")
        elif not m[0].startswith(b"%"):
            yield "mark", m[0].decode()


def _reference(body: bytes, key: str) -> list[int]:
    """The object numbers that an entry of a dictionary refers to, one or an array of them."""
    m = re.search(rb"/" + key.encode() + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []


class Pdf:
    def __init__(self, data: bytes):
        self.bodies: dict[int, bytes] = {}
        self.streams: dict[int, bytes] = {}
        marks = list(_OBJECT.finditer(data))
        for n, m in enumerate(marks):
            body = data[m.end() : marks[n + 1].start() if n + 1 < len(marks) else len(data)]
            found = re.search(rb"\bstream\r?\n", body)
            if found:
                head, rest = body[: found.start()], body[found.end() :]
                size = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
                end = int(size[1]) if size and rest[int(size[1]) : int(size[1]) + 12].strip().startswith(b"endstream") else rest.rfind(b"endstream")
                self.streams[int(m[1])] = self._inflated(head, rest[: end if end >= 0 else None])
                body = head
            self.bodies[int(m[1])] = body
        for number in list(self.streams):
            if re.search(rb"/Type\s*/ObjStm\b", self.bodies[number]):
                self._unpack(number)
        self.encrypted = b"/Encrypt" in data

    @staticmethod
    def _inflated(head: bytes, raw: bytes) -> bytes:
        if b"FlateDecode" not in head and not re.search(rb"/Filter\s*\[?\s*/Fl\b", head):
            return raw if b"/Filter" not in head else b""
        try:
            return zlib.decompressobj().decompress(raw)
        except zlib.error:
            return b""

    def _unpack(self, number: int) -> None:
        first = re.search(rb"/First\s+(\d+)", self.bodies[number])
        data = self.streams[number]
        if not first:
            return
        numbers = [int(x) for x in data[: int(first[1])].split() if x.isdigit()]
        places = [*numbers[1::2], len(data)]
        for own, a, b in zip(numbers[::2], places[:-1], places[1:], strict=False):
            self.bodies.setdefault(own, data[int(first[1]) + a : int(first[1]) + b])

    def pages(self) -> list[int]:
        """Page objects in the order of the tree; in that of their numbers where there is none."""
        every = [n for n, b in sorted(self.bodies.items()) if re.search(rb"/Type\s*/Page\b", b)]
        roots = [n for n, b in self.bodies.items() if re.search(rb"/Type\s*/Pages\b", b) and not re.search(rb"/Parent\b", b)]
        out, todo, seen = [], roots[::-1], set()
        while todo:
            n = todo.pop()
            if n in seen:
                continue
            seen.add(n)
            kids = _reference(self.bodies.get(n, b""), "Kids")
            out += [n] if n in every else []
            todo += kids[::-1]
        return out or every

    def fonts(self, page: int) -> dict[str, dict[bytes, str]]:
        """Maps from codes to text by the name of a font on a page; inherited resources count."""
        body, scope = self.bodies[page], []
        while body and len(scope) < 20:
            scope += [body, *[self.bodies.get(n, b"") for n in _reference(body, "Resources")]]
            up = _reference(body, "Parent")
            body = self.bodies.get(up[0], b"") if up else b""
        scope += [self.bodies.get(n, b"") for b in list(scope) for n in _reference(b, "Font")]
        out: dict[str, dict[bytes, str]] = {}
        for b in scope:
            for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", b):
                for to in _reference(self.bodies.get(int(n), b""), "ToUnicode"):
                    out.setdefault(name.decode("latin-1"), _cmap(self.streams.get(to, b"")))
        return out

    def text(self) -> str:
        if self.encrypted:
            return ""
        return "\n\n".join(t for t in (self._page(n) for n in self.pages()) if t)

    def _page(self, page: int) -> str:
        data = b"\n".join(self.streams.get(n, b"") for n in _reference(self.bodies[page], "Contents"))
        fonts, font, held, lines, args, inside = self.fonts(page), {}, "", [], [], False
        size, y = 1.0, 0.0

        def show(raw: bytes) -> None:
            nonlocal held
            held += _decoded(raw, font)

        def line() -> None:
            nonlocal held
            if held.strip():
                lines.append(" ".join(held.split()))
            held = ""

        for kind, value in _tokens(data):
            if kind != "word":
                args.append((kind, value))
                continue
            numbers = [v for k, v in args if k == "number"]
            texts = [v for k, v in args if k == "string"]
            if value == "Tf" and args and args[0][0] == "name":
                font, size = fonts.get(args[0][1], {}), numbers[-1] if numbers else size
            elif value in ("Td", "TD") and len(numbers) >= 2:
                if numbers[-1]:
                    line()
                else:
                    held += " "
            elif value == "Tm" and len(numbers) >= 6:
                if abs(numbers[5] - y) > 0.3 * abs(numbers[3] * size or 1):
                    line()
                elif held and not held.endswith(" "):
                    held += " "
                y = numbers[5]
            elif value in ("T*", "BT"):
                line()
            elif value in ("Tj", "'", '"') and texts:
                if value != "Tj":
                    line()
                show(texts[-1])
            elif value == "TJ":
                for k, v in args:
                    if k == "string":
                        show(v)
                    elif k == "number" and v < -200 and held and not held.endswith(" "):
                        held += " "
            args = []
        line()
        return "\n".join(lines)


def _decoded(raw: bytes, font: dict[bytes, str]) -> str:
    if not font:
        return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("latin-1")
    width = max(map(len, font))
    return "".join(font.get(raw[i : i + width], "") for i in range(0, len(raw), width))


def _cmap(data: bytes) -> dict[bytes, str]:
    """A ToUnicode map: single codes and ranges."""
    out: dict[bytes, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        codes = [v for k, v in _tokens(block) if k == "string"]
        out.update({a: b.decode("utf-16-be", "replace") for a, b in zip(codes[::2], codes[1::2], strict=False)})
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        values, row, listed = list(_tokens(block)), [], None
        for kind, value in values:
            if kind == "open":
                listed = []
            elif kind == "string" and listed is not None:
                listed.append(value)
            elif kind == "string":
                row.append(value)
            if (kind == "close" and listed is not None) or len(row) == 3:
                low, high, width = int.from_bytes(row[0]), int.from_bytes(row[1]), len(row[0])
                for i in range(min(high - low + 1, 1 << 16)):
                    if listed is not None:
                        text = listed[i] if i < len(listed) else b""
                    else:
                        text = row[2][:-2] + (int.from_bytes(row[2][-2:]) + i & 0xFFFF).to_bytes(2)
                    out[(low + i).to_bytes(width)] = text.decode("utf-16-be", "replace")
                row, listed = [], None
    return out


def text_layer(data: bytes) -> str:
    """The text of a file; raises ValueError for data that is no PDF."""
    if b"%PDF-" not in data[:1024]:
        raise ValueError("no PDF file")
    return Pdf(data).text()


def image_pages(data: bytes) -> tuple[int, int]:
    """(pages that show images, pages), as far as their resources are told on the page or above it."""
    pdf = Pdf(data)
    pages = pdf.pages()
    shows = sum(any(b"/XObject" in b for b in [pdf.bodies[n], *[pdf.bodies.get(r, b"") for r in _reference(pdf.bodies[n], "Resources")]]) for n in pages)
    return shows, len(pages)


def pdf_bytes(lines: list[str]) -> bytes:
    """A minimal file of one page that shows the lines; for characters of Latin-1."""
    shown = b" T* ".join(b"(" + re.sub(rb"([\\()])", rb"\\\1", line.encode("latin-1", "replace")) + b") Tj" for line in lines)
    packed = zlib.compress(b"BT /F1 10 Tf 12 TL 50 780 Td " + shown + b" ET")
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 5 0 R >> >> /Contents 4 0 R >>",
        b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(packed), packed),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
    ]
    out, places = b"%PDF-1.4\n", []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%s" % (len(objects) + 1, table) + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(out))
