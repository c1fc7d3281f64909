"""The plain files of a folder."""

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession

# What Spark writes beside data, and what its readers pass over.
_CHECKSUM = re.compile(r"^\..*\.crc$")
_PASSED_OVER = re.compile(r"^_(?!metadata|common_metadata)[^=]*$|^\.|\._COPYING_$")
_SAME_IN_URI = re.compile(r"^[A-Za-z0-9._-]+$")
_COMPRESSED = re.compile(r"\.(gz|deflate|bz2|zst|lz4|snappy|xz)$", re.IGNORECASE)


@dataclass(frozen=True)
class PlainFile:
    name: str
    path: str
    length: int

    @property
    def compressed(self) -> bool:
        return bool(_COMPRESSED.search(self.name))


@dataclass(frozen=True)
class Listing:
    """Files by name, and the path that stands for all of them, if there is one."""

    files: tuple[PlainFile, ...]
    whole: str | None = None

    def sources(self) -> list[str]:
        """What to read: one folder is listed once, where thousands of files are listed one by one."""
        paths = [self.whole] if self.whole else [file.path for file in self.files]
        return [literal(path) for path in paths]

    def only(self, numbers: Sequence[int]) -> "Listing":
        if len(numbers) == len(self.files):
            return self
        return Listing(tuple(self.files[number] for number in numbers))


def plain_files(spark: SparkSession, path: str) -> Listing:
    """The plain files of one folder, sorted by name, or the one file the path names.

    Looks one level deep. Spark passes over hidden files without a word; here they are an error.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files, alone = {}, True
    entries = system.listStatusIterator(place)
    while entries.hasNext():
        entry = entries.next()
        name = entry.getPath().getName()
        if not entry.isFile():
            alone = False
        elif name != "_SUCCESS" and not _CHECKSUM.search(name):
            if _PASSED_OVER.search(name):
                raise ValueError(f"Spark would not read the file because of its name: {name}")
            files[name] = PlainFile(name, entry.getPath().toString(), entry.getLen())
    return Listing(tuple(files[name] for name in sorted(files)), path if alone else None)


def name_in_uri(spark: SparkSession, file: PlainFile) -> str:
    """The name as Spark tells it of a row: escaped as in a URI."""
    if _SAME_IN_URI.search(file.name):
        return file.name
    uri = spark._jvm.org.apache.hadoop.fs.Path(file.path).toUri()
    return uri.getRawPath().rpartition("/")[2]


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a file that is not blank, with all lines that its quotes go over."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    settings = spark._jsc.hadoopConfiguration()
    stream = place.getFileSystem(settings).open(place)
    try:
        codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(settings).getCodec(
            place
        )
        plain = stream if codec is None else codec.createInputStream(stream)
        java = spark._jvm.java
        lines = java.io.BufferedReader(java.io.InputStreamReader(plain, "UTF-8"))
        line = lines.readLine()
        while line is not None and not line.strip():
            line = lines.readLine()
        while line is not None and line.count('"') % 2:
            more = lines.readLine()
            if more is None:
                break
            line += "\n" + more
        return line
    finally:
        stream.close()


def literal(path: str) -> str:
    """The path as a pattern that matches nothing but itself."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)
