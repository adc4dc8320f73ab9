"""Archives of stores: opened by their form, unpacked beside a hash of what they hold, names that carry that hash."""

from __future__ import annotations

import hashlib
import os
import posixpath
import re
import shutil
import tarfile
import uuid
import zipfile
from collections.abc import Iterator
from typing import IO

DIGITS = 12
_STAMP = re.compile(rf"-[0-9a-f]{{{DIGITS}}}(?=(\.[A-Za-z][\w.]*)?$)")


def form(path: str) -> str:
    """directory, zip or tar, by what the file begins with, whatever its name."""
    if os.path.isdir(path):
        return "directory"
    with open(path, "rb") as f:
        head = f.read(4)
    if head[:4] == b"PK\x03\x04" or head[:4] == b"PK\x05\x06":
        return "zip"
    if tarfile.is_tarfile(path):
        return "tar"
    raise ValueError(f"{path} is no directory and no archive")


def _inside(name: str) -> str:
    full = posixpath.normpath(name)
    if full.startswith(("/", "..")) or "\\" in name or re.match(r"^[A-Za-z]:", name):
        raise ValueError(f"entry {name!r} leaves the archive")
    return full


def _entries(path: str, kind: str) -> Iterator[tuple[str, IO[bytes]]]:
    """(name, stream) of the files of an archive in the order of their names; links are refused."""
    if kind == "zip":
        with zipfile.ZipFile(path) as z:
            for i in sorted((i for i in z.infolist() if not i.is_dir()), key=lambda i: _inside(i.filename)):
                if (i.external_attr >> 16) & 0o170000 == 0o120000:
                    raise ValueError(f"entry {i.filename!r} is a link")
                yield _inside(i.filename), z.open(i)
    elif kind == "tar":
        with tarfile.open(path) as t:
            members = [m for m in t.getmembers() if not m.isdir()]
            for m in sorted(members, key=lambda m: _inside(m.name)):
                if not m.isfile():
                    raise ValueError(f"entry {m.name!r} is no plain file")
                yield _inside(m.name), t.extractfile(m)
    else:
        found = [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs]
        for full in sorted(found, key=lambda f: os.path.relpath(f, path).replace(os.sep, "/")):
            yield os.path.relpath(full, path).replace(os.sep, "/"), open(full, "rb")


def _copied(source: IO[bytes], out: IO[bytes] | None, h) -> None:
    while block := source.read(1 << 20):
        h.update(block)
        if out is not None:
            out.write(block)


def unpack(path: str, into: str | None = None) -> str:
    """The SHA-256 over the sorted names and contents of a store or archive, which is unpacked under `into`, if given, in
    the same pass. Entries that would leave the folder, and links, are refused before anything is written for them."""
    h = hashlib.sha256()
    for name, stream in _entries(path, form(path)):
        with stream:
            h.update(name.encode() + b"\0")
            if into is None:
                _copied(stream, None, h)
            else:
                target = os.path.join(into, *name.split("/"))
                os.makedirs(os.path.dirname(target) or into, exist_ok=True)
                with open(target, "wb") as out:
                    _copied(stream, out, h)
        h.update(b"\0")
    return h.hexdigest()


def stamp_of(path: str) -> str | None:
    """The hash that a file's name carries, or none."""
    m = _STAMP.search(os.path.basename(path.rstrip("/")))
    return m[0][1:] if m else None


def stamped(path: str, digest: str) -> str:
    """path with the first digits of a hash before its endings; an older hash in the name is replaced, never added to."""
    folder, base = os.path.split(path.rstrip("/"))
    plain = _STAMP.sub("", base)
    stem, dot, ending = plain.partition(".")
    return os.path.join(folder, f"{stem}-{digest[:DIGITS]}{dot}{ending}")


def open_store(path: str, work: str) -> tuple[str, bool | None]:
    """(folder of the store, whether its hash is the one in its name; None if the name has none). Archives are unpacked into
    a new folder under `work`, which the caller removes; a folder stays where it is."""
    want = stamp_of(path)
    if form(path) == "directory":
        return path, None if want is None else unpack(path).startswith(want)
    into = os.path.join(work, f"store-{uuid.uuid4().hex}")
    os.makedirs(into)
    try:
        digest = unpack(path, into)
    except BaseException:
        shutil.rmtree(into, ignore_errors=True)
        raise
    entries = os.listdir(into)
    root = os.path.join(into, entries[0]) if len(entries) == 1 and os.path.isdir(os.path.join(into, entries[0])) else into
    return root, None if want is None else digest.startswith(want)


def replace_folder(new: str, target: str) -> None:
    """Put a finished folder in the place of another by two renames; the old one goes last, and comes back on failure."""
    old = f"{target}.old-{uuid.uuid4().hex}"
    had = os.path.exists(target)
    if had:
        os.rename(target, old)
    try:
        os.rename(new, target)
    except BaseException:
        if had:
            os.rename(old, target)
        raise
    if had:
        shutil.rmtree(old)


def pack(folder: str, path: str) -> str:
    """Write a folder as a zip with sorted names, beside its place first; the hash of what it holds."""
    held = f"{path}.new-{uuid.uuid4().hex}"
    with zipfile.ZipFile(held, "w", zipfile.ZIP_STORED) as z:
        for name, stream in _entries(folder, "directory"):
            with stream, z.open(zipfile.ZipInfo(name), "w") as out:
                shutil.copyfileobj(stream, out)
    os.replace(held, path)
    return unpack(path)
