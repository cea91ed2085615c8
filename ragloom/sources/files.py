"""S1 file_discovery and S2 document_load.

Files are read by Spark's ``binaryFile`` source (one row per file, listed and
read by the executors). Word documents are turned into text by a small
per-file helper (stdlib ``zipfile`` + ``xml``) inside an Arrow UDF: the text
of every ``w:t`` run of a paragraph, paragraphs joined by a blank line.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..operators.partitioning import spread

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def discover_files(spark: SparkSession, folder: str, extensions=(".docx",)) -> DataFrame:
    """Files directly in ``folder`` (no recursion) for each extension;
    one ``binaryFile`` read per extension, then ``unionByName``."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    hidden = [st.getPath().getName() for st in fs.listStatus(root) if st.isFile()
              and st.getPath().getName().startswith(("_", "."))
              and st.getPath().getName().endswith(tuple(extensions))]
    if hidden:   # Spark's sources pass over such names without a word
        raise ValueError(f"files Spark would not read, rename them: {sorted(hidden)[:5]}")
    out = None
    for ext in extensions:
        df = (spark.read.format("binaryFile").option("pathGlobFilter", f"*{ext}")
              .option("recursiveFileLookup", "false").load(folder))
        out = df if out is None else out.unionByName(df)
    return out


def docx_to_text(data: bytes | None) -> str | None:
    """Paragraph texts of a .docx (``w:t`` runs, tabs and breaks kept), joined by a blank
    line: headers, the document, footers. A paragraph inside another (a text box) is a
    paragraph of its own, after the one around it."""
    if data is None:
        return None
    paras: list[str] = []

    def own(p):
        parts, todo, inner = [], list(reversed(p)), []
        while todo:
            node = todo.pop()
            if node.tag == f"{_W}p":
                inner.append(node)
                continue
            if node.tag == f"{_W}t" and node.text:
                parts.append(node.text)
            elif node.tag == f"{_W}tab":
                parts.append("\t")
            elif node.tag in (f"{_W}br", f"{_W}cr"):
                parts.append("\n")
            todo.extend(reversed(node))
        paras.append("".join(parts))
        for x in inner:
            own(x)

    def walk(node):
        for x in node:
            if x.tag == f"{_W}p":
                own(x)
            else:
                walk(x)

    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
        names = sorted(z.namelist())
        parts = [*(n for n in names if n.startswith("word/header")), "word/document.xml",
                 *(n for n in names if n.startswith("word/footer"))]
        for part in parts:
            walk(ElementTree.fromstring(z.read(part)))
    return "\n\n".join(paras)


@F.pandas_udf(T.StringType())
def _docx_udf(content: pd.Series) -> pd.Series:
    return content.map(docx_to_text)


def _safe_docx(data):
    try:
        return {"text": docx_to_text(data), "error": None}
    except Exception as e:  # noqa: BLE001 - reported per file, never swallowed
        return {"text": None, "error": f"{type(e).__name__}: {e}"}


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()),
                            T.StructField("error", T.StringType())]))
def _docx_checked_udf(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_safe_docx(c) for c in content], columns=["text", "error"])


def load_documents(spark: SparkSession, folder: str, extensions=(".docx",),
                   quarantine: str | None = None) -> DataFrame:
    """documents(doc_id, source, path, text) with ``doc_id = xxhash64(path)``
    and ``source`` = the file's basename (T2).

    H9: by default a file that cannot be read fails the job. With
    ``quarantine`` (a path), unreadable files are written there with their
    error and left out of the result."""
    # parsing is per-file Python work: spread the listed files over the cores
    files = spread(discover_files(spark, folder, extensions))
    ids = [F.xxhash64("path").alias("doc_id"), TX.basename(F.col("path")).alias("source"),
           F.col("path")]
    if quarantine is None:
        return files.select(*ids, _docx_udf(F.col("content")).alias("text"))
    # parsed once (checkpointed), then split into good rows and quarantined files
    parsed = files.select(*ids, _docx_checked_udf(F.col("content")).alias("r")) \
        .checkpoint(eager=True)
    parsed.where(F.col("r.error").isNotNull()).select(
        "doc_id", "source", "path", F.col("r.error").alias("error")) \
        .write.mode("append").parquet(quarantine)
    return parsed.where(F.col("r.error").isNull()).select(
        "doc_id", "source", "path", F.col("r.text").alias("text"))


def load_text_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Plain-text variant: one document per file (``wholetext``)."""
    df = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True) \
        .withColumn("path", F.input_file_name())
    return df.select(F.xxhash64("path").alias("doc_id"), TX.basename(F.col("path")).alias("source"),
                     "path", F.col("value").alias("text"))
