"""S1/S2/ST1 as a Spark data source: ``spark.read.format("docx")`` and ``readStream``.

One row a Word file: path, modified, length, text, error. Files are listed once on the
driver and dealt to partitions of about ``partitionBytes``; the driver holds them packed, a
dozen bytes or two a file (a listing of a store that is not local comes whole before that).
A file that cannot be read gives a row with its error and no text, in batch and stream alike,
so one bad file stops nothing. Options: ``path`` (a folder, any address pyarrow's file systems
know), ``partitionBytes``, ``partitionFiles``.

The stream's offset is the last (modified, path) it has read. A file must not get a
modification time before that of files read earlier (files written in place or copied do;
files moved in with an old time need the batch source). Word files in a store that only
Spark's own readers reach are read by ``sources.files`` (``binaryFile``).
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice
from stat import S_ISREG

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, modified timestamp, length long, text string, error string"
PARTITION_BYTES, PARTITION_FILES = 32 << 20, 2000


#: Names packed at once while a folder is listed.
NAMES = 2000


def _packed(names: list[str]) -> bytes:
    return zlib.compress(os.fsencode("\0".join(names)))


def _unpacked(data: bytes) -> list[str]:
    return os.fsdecode(zlib.decompress(data)).split("\0")


class Files(InputPartition):
    """(modified ns, path, length) of the files of one partition, packed: the driver holds
    the partitions of a whole folder."""

    def __init__(self, files: list[tuple]):
        modified, paths, lengths = zip(*files) if files else ((), (), ())
        self.paths = _packed(paths) if files else b""
        self.numbers = zlib.compress(array("q", modified).tobytes() + array("q", lengths).tobytes())

    @property
    def files(self) -> Iterator[tuple]:
        if not self.paths:
            return iter(())
        numbers = array("q", zlib.decompress(self.numbers))
        half = len(numbers) // 2
        return zip(numbers[:half], _unpacked(self.paths), numbers[half:])


def _open(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _listed(path: str) -> Iterator[tuple]:
    """(modified ns, path, length) of the Word files directly in a folder, one by one."""
    from pyarrow import fs

    system, root = _open(path)
    if not isinstance(system, fs.LocalFileSystem):
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        while found:
            f = found.pop()
            if f.is_file and f.base_name.endswith(".docx"):
                yield f.mtime_ns, f.path, f.size
        return
    if not os.path.lexists(root):
        return
    # all names before the first file is looked at: files that come meanwhile are for the next listing
    with os.scandir(root) as entries:
        names = (e.name for e in entries if e.name.endswith(".docx"))
        held = [_packed(some) for some in iter(lambda: list(islice(names, NAMES)), [])]
    for some in held:
        for name in _unpacked(some):
            file = os.path.join(root, name)
            try:
                st = os.stat(file)
            except FileNotFoundError:      # gone meanwhile, or a link to nowhere
                continue
            if S_ISREG(st.st_mode):
                yield st.st_mtime_ns, file, st.st_size


def _dealt(files: Iterable[tuple], size: int, count: int) -> list[Files]:
    out, held, used = [], [], 0
    for f in files:
        if held and (used + f[2] > size or len(held) == count):
            out.append(Files(held))
            held, used = [], 0
        held.append(f)
        used += f[2]
    return out + [Files(held)] if held else out


class _Reading:
    def __init__(self, options):
        if not options.get("path"):
            raise ValueError("docx: load(path) needs a folder")
        self.path = options["path"]
        self.size = int(options.get("partitionBytes", PARTITION_BYTES))
        self.count = int(options.get("partitionFiles", PARTITION_FILES))

    def read(self, partition: Files) -> Iterator[tuple]:
        from datetime import datetime, timezone

        from ragloom.sources.files import docx_to_text

        system, _ = _open(self.path)
        for mtime, path, length in partition.files:
            text = error = None
            try:
                with system.open_input_stream(path) as f:
                    text = docx_to_text(f.read())
            except Exception as e:  # noqa: BLE001 - a row with its error, never swallowed
                error = f"{type(e).__name__}: {e}"
            yield path, datetime.fromtimestamp(mtime // 1000 / 1e6, timezone.utc), length, text, error


class DocxReader(_Reading, DataSourceReader):
    def partitions(self):
        return _dealt(_listed(self.path), self.size, self.count) or [Files([])]


class DocxStreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max((f[:2] for f in _listed(self.path)), default=None)
        return {"modified": last[0], "path": last[1]} if last else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        low, high = ((o["modified"], o["path"]) for o in (start, end))
        files = (f for f in _listed(self.path) if low < f[:2] <= high)
        return _dealt(files, self.size, self.count) or [Files([])]

    def commit(self, end: dict) -> None:
        """Nothing is kept between batches but the offset."""


class DocxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocxReader:
        return DocxReader(self.options)

    def streamReader(self, schema) -> DocxStreamReader:
        return DocxStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocxSource)


def documents(files: DataFrame) -> DataFrame:
    """The readable files as documents(doc_id, source, path, text)."""
    from ..functions import text as TX

    return files.where(F.col("error").isNull()).select(
        F.xxhash64("path").alias("doc_id"), TX.basename(F.col("path")).alias("source"), "path", "text")


# ---- writing


def text_to_docx(text: str) -> bytes:
    """A minimal .docx: blank lines part paragraphs, line ends and tabs are kept, characters
    that XML forbids are left out."""
    import io
    import re
    import zipfile
    from xml.sax.saxutils import escape

    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", text)

    def run(s: str) -> str:
        s = escape(s, {"\r": "&#13;"})
        for mark, tag in (("\n", "<w:br/>"), ("\t", "<w:tab/>")):
            s = s.replace(mark, f'</w:t>{tag}<w:t xml:space="preserve">')
        return f'<w:p><w:r><w:t xml:space="preserve">{s}</w:t></w:r></w:p>'

    body = "".join(map(run, text.split("\n\n")))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", '<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://'
                   f'schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def write_file(data: bytes, folder: str, name: str) -> None:
    """One file in a folder of shared storage, under a hidden name until it is whole."""
    import uuid

    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    part = f"{root}/.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, f"{root}/{name}")


def write_docx(df: DataFrame, folder: str, name: str = "name", text: str = "text") -> int:
    """One ``<name>.docx`` a row in a folder of shared storage; returns how many."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for n, t in zip(*(c.to_pylist() for c in b.columns)):
                write_file(text_to_docx(t or ""), folder, f"{n}.docx")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    got = df.select(F.col(name).cast("string"), F.col(text)).mapInArrow(run, "n long").agg(F.sum("n")).first()
    return got[0] or 0
