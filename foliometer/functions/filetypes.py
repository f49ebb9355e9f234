"""Content sniffing of uploads and attachments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .filenames import file_extension
from .text import blank, col, let, strip


def _starts(data: Column, signature: str) -> Column:
    return F.hex(F.substring(data, 1, len(signature) // 2)) == signature


def _signature_matches(family: str, data: Column) -> Column:
    if family == "pdf":
        head = F.decode(F.substring(data, 1, C.SNIFF_BYTES), "ISO-8859-1")
        return F.contains(head, F.lit(C.PDF_MARK))
    if family == "office":
        return _starts(data, C.ZIP_SIGNATURE) | _starts(data, C.OLE2_SIGNATURE)
    return _starts(data, {"jpeg": C.JPEG_SIGNATURE, "png": C.PNG_SIGNATURE}[family])


def sniff(filename: Column | str, head: Column | str, allowed=None) -> Column:
    """struct(media_type, error) from extension and leading bytes.

    ``error`` is ``unsupported`` or ``corrupted``; exactly one field is set.
    """
    accepted = {e: (m, f) for e, m, f in C.FILE_TYPES if not allowed or e in set(allowed)}
    types = F.create_map(
        *[
            part
            for extension, (media_type, family) in accepted.items()
            for part in (
                F.lit(extension),
                F.struct(F.lit(media_type).alias("media_type"), F.lit(family).alias("family")),
            )
        ]
    )
    content = F.coalesce(col(head), F.lit(b""))

    def verdict(kind: Column) -> Column:
        genuine = F.lit(False)
        for family in ("pdf", "office", "jpeg", "png"):
            match = (kind["family"] == family) & _signature_matches(family, content)
            genuine = genuine | match
        error = F.when(kind.isNull(), "unsupported").when(~genuine, "corrupted")
        media_type = F.when(genuine, kind["media_type"])
        return F.struct(media_type.alias("media_type"), error.alias("error"))

    return let(types[file_extension(filename)], verdict)


def check_attachment(content_type: Column | str, data: Column | str) -> Column:
    """NULL for a valid screenshot, else the first failed rule."""
    declared = F.lower(strip(F.split(F.coalesce(col(content_type), F.lit("")), ";")[0]))
    data = F.coalesce(col(data), F.lit(b""))
    webp = _starts(data, C.RIFF_SIGNATURE) & (F.hex(F.substring(data, 9, 4)) == C.WEBP_MARK)

    def verdict(kind: Column) -> Column:
        genuine = (
            F.when(kind == "image/jpeg", _starts(data, C.JPEG_SIGNATURE))
            .when(kind == "image/png", _starts(data, C.PNG_SIGNATURE))
            .otherwise(webp)
        )
        return (
            F.when(~kind.isin("image/jpeg", "image/png", "image/webp"), "unsupported_type")
            .when(F.octet_length(data) == 0, "empty")
            .when(F.octet_length(data) > C.ATTACHMENT_MAX_BYTES, "too_large")
            .when(~genuine, "not_an_image")
        )

    return let(declared, verdict)


def attachment_name(filename: Column | str) -> Column:
    """Stored name of an attachment."""
    name = F.when(blank(filename), "screenshot").otherwise(col(filename))
    return F.substring(name, 1, C.ATTACHMENT_NAME_LENGTH)
