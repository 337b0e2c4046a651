"""Zipped XML packages: parts, relationships, elements without namespaces."""

from __future__ import annotations

import functools
import html.entities
import io
import posixpath
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib

_ENTITY = re.compile(rb"&([A-Za-z][A-Za-z0-9]*);")
_KNOWN = {"amp", "lt", "gt", "quot", "apos"}


class PackageError(ValueError):
    pass


def _entity(m: re.Match[bytes]) -> bytes:
    name = m.group(1).decode()
    point = html.entities.name2codepoint.get(name)
    return m.group() if name in _KNOWN or point is None else b"&#%d;" % point


@functools.lru_cache(4096)
def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def plain(element: ET.Element) -> ET.Element:
    """The element and all below it without namespaces, attributes too."""
    for e in element.iter():
        if isinstance(e.tag, str):
            e.tag = local(e.tag)
        if (own := e.attrib) and any("}" in k for k in own):
            e.attrib = {local(k): v for k, v in own.items()}
    return element


def _directory(data: bytes) -> dict[str, tuple[int, ...]] | None:
    """name -> (method, CRC, packed size, size, offset) of a plain package; None where it is anything but plain, for ``zipfile`` to read."""
    if data[-22:-18] != b"PK\5\6" or data[-2:] != b"\0\0":
        return None
    disk, first, here, n, size, at = struct.unpack("<4H2L", data[-18:-2])
    if disk or first or here != n or at + size != len(data) - 22:
        return None
    out: dict[str, tuple[int, ...]] = {}
    for _ in range(n):
        if data[at : at + 4] != b"PK\1\2" or len(data) < at + 46:
            return None
        flags, method, _, crc, packed, full, name, extra, note, disk, _, _, start = struct.unpack("<2H4L5H2L", data[at + 8 : at + 46])
        raw = data[at + 46 : at + 46 + name]
        if flags & ~6 or method not in (0, 8) or extra or note or disk or not raw.isascii() or b"\0" in raw or b"\\" in raw:
            return None
        text = raw.decode()
        # the file's own header says the same
        if text in out or data[start : start + 4] != b"PK\3\4" or data[start + 26 : start + 30 + name] != struct.pack("<2H", name, 0) + raw:
            return None
        out[text] = (method, crc, packed, full, start + 30 + name)
        at += 46 + name
    return out


def parsed(name: str, data: bytes) -> ET.Element:
    try:
        return plain(ET.fromstring(_ENTITY.sub(_entity, data) if b"&" in data else data))
    except ET.ParseError as e:
        raise PackageError(f"{name}: {e}") from e


class Package:
    def __init__(self, data: bytes) -> None:
        self.data, self.zip, self.parts = data, None, _directory(data)
        if self.parts is None:
            self._open()
        self.names = list(self.parts) if self.zip is None else self.zip.namelist()

    def _open(self) -> zipfile.ZipFile:
        if self.zip is None:
            try:
                self.zip = zipfile.ZipFile(io.BytesIO(self.data))
            except (zipfile.BadZipFile, ValueError, OSError) as e:
                raise PackageError(f"not a ZIP package: {e}") from e
        return self.zip

    def read(self, name: str) -> bytes | None:
        if self.zip is None:
            if name not in self.parts:
                return None
            method, crc, packed, full, at = self.parts[name]
            raw = self.data[at : at + packed]
            try:
                found = zlib.decompressobj(-15).decompress(raw, full + 1) if method else raw
            except zlib.error:
                found = b""
            if len(found) == full and zlib.crc32(found) == crc:
                return found
        try:  # damaged, or not plain
            return self._open().read(name)
        except KeyError:
            return None

    def xml(self, name: str) -> ET.Element | None:
        """The part's root element; None where the package has no such part."""
        data = self.read(name)
        return None if data is None else parsed(name, data)

    def optional(self, name: str) -> ET.Element | None:
        """Like ``xml``, but a part that can't be read counts as missing."""
        try:
            return self.xml(name)
        except (PackageError, zipfile.BadZipFile, OSError):
            return None

    def relations(self, part: str) -> dict[str, tuple[str, str, str]]:
        """id -> (type, target, mode) of the part's relationships."""
        folder, name = posixpath.split(part)
        root = self.optional(f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
        out: dict[str, tuple[str, str, str]] = {}
        for r in root if root is not None else ():
            out.setdefault(r.get("Id", ""), (r.get("Type", ""), r.get("Target", ""), r.get("TargetMode", "")))
        return out


def resolve(base: str, target: str) -> str:
    """A relationship's target as the name of a part."""
    if target.startswith("/"):
        return target.lstrip("/")
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), target))
