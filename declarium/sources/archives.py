"""Archives of mirrored sources, read within fixed limits."""

from __future__ import annotations

import io
import posixpath
import tarfile
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.versions import looks_like_release
from ..session import ship

MEMBER, OUTPUT, ARCHIVE, DEPTH = 32 << 20, 256 << 20, 1 << 30, 2


def wanted(name: str) -> bool:
    base = posixpath.basename(name).upper()
    return base.startswith(("LICENSE", "LICENCE", "COPYING", "COPYRIGHT", "NOTICE", "README.OPENSOURCE", "VERSION"))


def safe(name: str) -> bool:
    """Inside the archive, and not below ``DEPTH`` folders."""
    parts = posixpath.normpath(name).split("/")
    return not name.startswith(("/", "\\")) and ".." not in parts and ":" not in parts[0] and len(parts) <= DEPTH + 1


def members(data: bytes) -> list[tuple[str, bytes]]:
    """Wanted members within the limits; whatever can't be read gives none."""
    out, total = [], 0
    if len(data) > ARCHIVE:
        return out
    try:
        if zipfile.is_zipfile(io.BytesIO(data)):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i in z.infolist():
                    if not i.is_dir() and safe(i.filename) and wanted(i.filename) and i.file_size <= MEMBER and total + i.file_size <= OUTPUT:
                        with z.open(i) as f:
                            out.append((i.filename, f.read(MEMBER)))
                        total += i.file_size
            return out
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
            for m in t:
                if m.isfile() and safe(m.name) and wanted(m.name) and m.size <= MEMBER and total + m.size <= OUTPUT:
                    out.append((m.name, t.extractfile(m).read(MEMBER)))
                    total += m.size
    except (tarfile.TarError, zipfile.BadZipFile, OSError, EOFError, ValueError):
        pass
    return out


def contents(files: DataFrame) -> DataFrame:
    """repo, path, member, content of the archives among ``files``; a pointer to
    large-file storage instead of an archive has none."""
    ship(files.sparkSession)
    read = F.udf(lambda data: [(n, c) for n, c in members(bytes(data or b""))], "array<struct<member:string,content:binary>>")
    rows = files.where(F.col("path").rlike(r"(?i)\.(tar\.(gz|xz|bz2)|tgz|zip)$") & ~F.col("content").cast("string").startswith("version https://git-lfs"))
    return rows.select("repo", "path", F.explode(read("content")).alias("m")).select("repo", "path", "m.member", "m.content")


def release_refs(refs: DataFrame) -> DataFrame:
    """(repo, label, ref) of release lines; a repository whose listing failed keeps
    one row with null label, which isn't the same as having none."""
    named = refs.withColumn("label", F.regexp_replace("ref", "^(refs/)?(remotes/|heads/)?(origin/)?", ""))
    return named.where(F.col("failed") | (looks_like_release(F.col("label")) & ~F.col("ref").endswith("HEAD"))).select("repo", F.when(~F.col("failed"), F.col("label")).alias("label"), "ref", "failed").distinct()
