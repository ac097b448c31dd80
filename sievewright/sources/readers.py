"""Document sources: files by extension through a registry of converters, and corpora.

Files are read as binary by the executors, so any store that Spark reads will do.  A file that can't
be converted is a row with ``error`` set; nothing is raised for a row.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions.text import is_blank
from sievewright.operators.chunking import DEFAULT_OVERLAP, DEFAULT_SIZE, chunk

#: Text extensions and common media types.
TEXT_EXTENSIONS = (".txt", ".md", ".markdown")
MEDIA_TYPES = {
    ".txt": "text/plain", ".md": "text/markdown", ".markdown": "text/markdown", ".csv": "text/csv", ".html": "text/html", ".htm": "text/html", ".json": "application/json", ".xml": "text/xml", ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", ".doc": "application/msword", ".xls": "application/vnd.ms-excel", ".ppt": "application/vnd.ms-powerpoint", ".rtf": "application/rtf", ".epub": "application/epub+zip",
}
_CONVERTED = "struct<text:string,error:string>"


class ConversionError(RuntimeError):
    """A document that can't be converted."""


class UnsupportedDocumentError(ConversionError):
    """A document that no converter takes."""


@dataclass(frozen=True)
class Converter:
    """One way from bytes to text.  ``extensions`` None takes every file.

    ``convert`` makes a column struct<text, error> from the columns path and content.
    """

    name: str
    convert: Callable[[Column, Column], Column]
    extensions: tuple[str, ...] | None = None
    normalized_format: str = "text"

    def supports(self, extension: Column) -> Column:
        return F.lit(True) if self.extensions is None else extension.isin(*self.extensions)


def _plain(path: Column, content: Column) -> Column:
    """Strict UTF-8 with line ends folded to a line feed."""
    text = F.regexp_replace(F.try_validate_utf8(content.cast("string")), "\r\n?", "\n")
    return F.struct(text.alias("text"), F.when(text.isNull(), "UnicodeDecodeError: the file is not UTF-8").alias("error"))


def text_converter() -> Converter:
    return Converter("text", _plain, TEXT_EXTENSIONS)


def rich_converter(build: Callable[[], Callable[[str, bytes], object]] | None = None, name: str = "markitdown") -> Converter:
    """Any other format through a client made once in each worker.

    The client takes a path and bytes and returns text, or an object with text_content or markdown.
    Without one, the optional package is imported where it is needed; a missing package is an error
    row, as is any exception.
    """
    make = build or _markitdown
    kept: dict = {}

    @F.arrow_udf(_CONVERTED)
    def run(path: pa.Array, content: pa.Array) -> pa.Array:
        texts, errors = [], []
        for p, c in zip(path.to_pylist(), content, strict=True):
            try:
                if "client" not in kept:
                    kept["client"] = make()
                texts.append(rich_text(kept["client"](p, c.as_py())))
                errors.append(None)
            except Exception as e:
                texts.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["text", "error"])

    return Converter(name, run, None, "markdown")


def rich_text(result: object) -> str:
    """text_content or, failing that, markdown of a client's result."""
    if isinstance(result, str):
        return result
    for name in ("text_content", "markdown"):
        got = getattr(result, name, None)
        if got is not None:
            return str(got)
    raise ConversionError("the client returned no text")


def _markitdown() -> Callable[[str, bytes], object]:
    import io

    from markitdown import MarkItDown

    client = MarkItDown()
    return lambda path, content: client.convert_stream(io.BytesIO(content), file_extension=os.path.splitext(path)[1])


@dataclass
class Registry:
    """Converters in order; the first that supports an extension takes the file."""

    converters: list[Converter] = field(default_factory=list)

    def register(self, converter: Converter) -> Registry:
        self.converters.append(converter)
        return self

    def apply(self, files: DataFrame) -> DataFrame:
        """Documents of files (path, content)."""
        extension = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
        out = files.withColumn("extension", extension)
        parts = []
        taken = F.lit(False)
        for c in self.converters:
            own = ~taken & c.supports(F.col("extension"))
            got = c.convert(F.col("path"), F.col("content"))
            parts.append(out.where(own).withColumn("sw_got", got).withColumn("converter", F.lit(c.name)).withColumn("normalized_format", F.lit(c.normalized_format)))
            taken = taken | c.supports(F.col("extension"))
        none = F.struct(F.lit(None).cast("string").alias("text"), F.concat(F.lit("UnsupportedDocumentError: no converter for "), F.col("path")).alias("error"))
        parts.append(out.where(~taken).withColumn("sw_got", none).withColumn("converter", F.lit(None).cast("string")).withColumn("normalized_format", F.lit(None).cast("string")))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return documents_of(every)


def default_registry(client: Callable[[], Callable[[str, bytes], object]] | None = None) -> Registry:
    return Registry([text_converter(), rich_converter(client)])


def media_type(extension: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, kind in MEDIA_TYPES.items():
        out = F.when(extension == name, kind).otherwise(out)
    return out


def documents_of(converted: DataFrame) -> DataFrame:
    """Converted rows as documents: id, metadata, one body segment; blank texts are errors."""
    text, error = F.col("sw_got.text"), F.col("sw_got.error")
    blank = error.isNull() & is_blank(text)
    body = F.array(F.struct(text.alias("text"), F.lit(0).alias("start_char"), F.length(text).alias("end_char"), F.create_map(F.lit("kind"), F.lit("body")).alias("metadata")))
    return converted.select(
        F.xxhash64("path").alias("doc_id"), F.col("path").alias("source"), F.when(~blank, text).alias("text"), media_type(F.col("extension")).alias("mime_type"), "converter", "extension", "normalized_format",
        F.when(~blank & error.isNull(), body).alias("segments"), F.coalesce(error, F.when(blank, "ConversionError: the document has no text")).alias("error"),
    )


def read_documents(spark: SparkSession, paths: str | Sequence[str], registry: Registry | None = None) -> DataFrame:
    """Documents of files and folders (recursively); dot files and .json files in folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([paths] if isinstance(paths, str) else list(paths))
    name = F.element_at(F.split("path", "/"), -1)
    files = files.where(~name.startswith(".") & ~F.lower(name).endswith(".json")).select("path", "content")
    return (registry or default_registry()).apply(files)


def check_path(path: str) -> str:
    """A local path of one file: expanded, and an error if it is missing or no file."""
    full = os.path.abspath(os.path.expanduser(path))
    if not os.path.exists(full):
        raise FileNotFoundError(full)
    if not os.path.isfile(full):
        raise IsADirectoryError(full)
    return full


def ingest(spark: SparkSession, paths: str | Sequence[str], registry: Registry | None = None, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP) -> DataFrame:
    """Chunks of all documents that could be converted."""
    documents = read_documents(spark, paths, registry)
    return chunk(documents.where("error is null").select("doc_id", "source", "text", "mime_type"), size, overlap)


MANIFEST = "manifest_expected_results.json"
_MANIFEST_SCHEMA = "files array<struct<filename:string,expected_document_decision:string,expected_safe_to_forward:boolean>>, description string, recommended_assertions array<string>"


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """filename, expected_verdict, expected_safe_to_forward of a corpus folder's manifest."""
    raw = spark.read.schema(_MANIFEST_SCHEMA).option("multiLine", "true").json(f"{folder.rstrip('/')}/{MANIFEST}")
    return raw.select(F.explode("files").alias("f")).select(F.col("f.filename").alias("filename"), F.lower("f.expected_document_decision").alias("expected_verdict"), F.col("f.expected_safe_to_forward").alias("expected_safe_to_forward"))


def discover(spark: SparkSession, folder: str, registry: Registry | None = None) -> DataFrame:
    """A corpus: the manifest's files, missing ones as error rows, or all files of the folder.

    ``filename`` is the path under the folder, so files of one name in two folders are two documents.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    above = system.makeQualified(path).toString().rstrip("/") + "/"
    under = F.when(F.col("source").startswith(above), F.substring("source", len(above) + 1, 1 << 30)).otherwise(F.element_at(F.split("source", "/"), -1))
    documents = read_documents(spark, folder, registry).withColumn("filename", under)
    if not system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, MANIFEST)):
        return documents.withColumns({"expected_verdict": F.lit(None).cast("string"), "expected_safe_to_forward": F.lit(None).cast("boolean")})
    listed = read_manifest(spark, folder)
    out = listed.join(documents, "filename", "left")
    return out.withColumn("error", F.when(F.col("source").isNull(), F.concat(F.lit("FileNotFoundError: "), F.col("filename"))).otherwise(F.col("error"))).withColumn("doc_id", F.coalesce("doc_id", F.xxhash64("filename")))


def from_table(table: DataFrame, key: str, text: str = "text", source: str | None = None) -> DataFrame:
    """A table of texts as documents (doc_id, source, text)."""
    name = F.col(source).cast("string") if source else F.col(key).cast("string")
    return table.select(F.col(key).cast("long").alias("doc_id"), name.alias("source"), F.col(text).alias("text"))


def supported(extensions: Iterable[str], registry: Registry) -> dict[str, str | None]:
    """The converter's name for each extension, as the registry would choose."""
    return {e: next((c.name for c in registry.converters if c.extensions is None or e.lower() in c.extensions), None) for e in extensions}
