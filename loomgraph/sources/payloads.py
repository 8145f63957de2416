"""Ingestion payloads: content kinds, text of media, and one column for text or error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Content kinds by MIME type and by file extension (fixed values).
MIME_KINDS = {"text/plain": "text", "text/markdown": "markdown", "application/json": "json", "application/pdf": "pdf"}
EXTENSION_KINDS = {
    "txt": "text", "md": "markdown", "markdown": "markdown", "json": "json", "pdf": "pdf",
    "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "bmp": "image", "webp": "image", "svg": "image",
    "wav": "audio", "mp3": "audio", "mpeg": "audio", "m4a": "audio", "ogg": "audio", "flac": "audio",
}
IMAGE_FIELDS = ("ocr_text", "caption", "alt_text", "description")
AUDIO_FIELDS = ("transcript", "caption", "description")


def bare_mime(mime: Column) -> Column:
    return F.lower(F.trim(F.split_part(mime, F.lit(";"), F.lit(1))))


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def content_kind(mime: Column, filename: Column) -> Column:
    """By MIME type (parameters and case aside), else by file extension, else `unsupported`."""
    m = bare_mime(F.coalesce(mime, F.lit("")))
    extension = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"[^/]\.([^./]+)$", 1))
    by_name = F.coalesce(_lookup(EXTENSION_KINDS, extension), F.lit("unsupported"))
    return F.when(m.startswith("image/"), "image").when(m.startswith("audio/"), "audio").otherwise(F.coalesce(_lookup(MIME_KINDS, m), by_name))


def media_text(metadata: Column, fields: tuple[str, ...]) -> Column:
    """Distinct non-blank values of the fields, trimmed, one per line; null if there are none."""
    values = F.filter(F.array(*[F.trim(metadata[f]) for f in fields]), lambda v: v.isNotNull() & (v != ""))
    return F.when(F.size(values) > 0, F.array_join(F.array_distinct(values), "\n"))


def json_requests(bodies: DataFrame) -> DataFrame:
    """(content_type, body) -> text requests, or a file payload.json where the type is exactly application/json."""
    is_file = F.col("content_type") == "application/json"
    return bodies.withColumns({"kind": F.when(is_file, "file").otherwise("text"), "filename": F.when(is_file, "payload.json"), "mime_type": F.when(is_file, "application/json")})


def with_modality(requests: DataFrame, modality: str) -> DataFrame:
    """Keeps requests of the media type and stamps modality, over any value there."""
    fits = bare_mime(F.col("mime_type")).startswith(f"{modality}/")
    others = F.map_filter("metadata", lambda k, _: k != "modality")
    return requests.where(fits).withColumn("metadata", F.map_concat(others, F.create_map(F.lit("modality"), F.lit(modality))))


def extracted(requests: DataFrame, pdf_text: Column | None = None) -> DataFrame:
    """requests(kind, content binary, filename, mime_type, metadata) plus text and error.

    PDF text comes from the column given by the caller (a pandas UDF over content); none is built in.
    """
    kind = F.when(F.col("kind") == "text", "text").otherwise(content_kind(F.col("mime_type"), F.col("filename")))
    decoded = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    pdf = pdf_text if pdf_text is not None else F.lit(None).cast("string")
    text = F.when(F.col("content_kind").isin("text", "markdown", "json"), decoded).when(F.col("content_kind") == "pdf", F.nullif(F.trim(pdf), F.lit("")))
    text = text.when(F.col("content_kind") == "image", media_text(F.col("metadata"), IMAGE_FIELDS)).when(F.col("content_kind") == "audio", media_text(F.col("metadata"), AUDIO_FIELDS))
    error = F.when(F.col("content_kind") == "unsupported", "unsupported_content").when(F.col("text").isNull(), F.concat(F.lit("no_text_in_"), F.col("content_kind")))
    stamped = F.when(F.col("kind") == "file", F.map_concat(F.map_filter("metadata", lambda k, _: ~k.isin("filename", "mime_type")), F.create_map(F.lit("filename"), F.coalesce("filename", F.lit("")), F.lit("mime_type"), F.coalesce("mime_type", F.lit(""))))).otherwise(F.col("metadata"))
    return requests.withColumn("content_kind", kind).withColumn("text", text).withColumn("error", error).withColumn("metadata", stamped)
