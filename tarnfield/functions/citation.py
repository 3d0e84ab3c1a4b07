"""Citations: from spans, to URIs and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("line", "page", "region", "caption", "time", "code")


def from_span(kind: Column) -> Column:
    """Citation kind of a span kind; bytes and unknown ones cite line 1."""
    return F.when(kind.isin("page", "region", "time", "code"), kind).otherwise("line")


def first_citation(spans: Column, path: Column) -> Column:
    """URI of the first of a chunk's spans (structs of kind, start, end, and, as they have them, page, box, speaker); line 1 where there is none or it has no lines."""
    first = F.get(spans, F.lit(0))
    kind = from_span(F.coalesce(first["kind"], F.lit("byte")))
    cites_lines = first["kind"].isin("line", "code")
    start = F.when(kind == "page", F.coalesce(first["page"], first["start"])).when((kind == "line") & ~F.coalesce(cites_lines, F.lit(False)), F.lit(1)).otherwise(first["start"])
    end = F.when((kind == "line") & ~F.coalesce(cites_lines, F.lit(False)), F.lit(1)).otherwise(first["end"])
    return uri(path, kind, start, end, first["box"], first["speaker"])


def clock(ms: Column) -> Column:
    """hh:mm:ss.mmm"""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, ms % 1000)


def uri(path: Column, kind: Column, start: Column, end: Column, box: Column | None = None, speaker: Column | None = None) -> Column:
    """``path#fragment``; start and end are lines, milliseconds, or the page for pages. ``box`` is an x,y,w,h array."""
    lines = F.concat(F.lit("#L"), start.cast("string"), F.when(end != start, F.concat(F.lit("-L"), end.cast("string"))).otherwise(""))
    speaker = speaker if speaker is not None else F.lit(None).cast("string")
    region = F.concat(F.lit("#xywh="), F.array_join(box.cast("array<string>"), ",")) if box is not None else F.lit("#xywh=")
    times = F.concat(F.lit("#t="), clock(start), F.lit(","), clock(end), F.coalesce(F.concat(F.lit("&speaker="), speaker), F.lit("")))
    return F.concat(path, F.when(kind == "page", F.concat(F.lit("#p="), start.cast("string"))).when(kind == "region", region).when(kind == "caption", "#caption").when(kind == "time", times).otherwise(lines))


def _ms(text: Column) -> Column:
    part = lambda k: F.regexp_extract(text, r"^(\d+):(\d+):(\d+)\.(\d+)$", k).try_cast("long")
    return part(1) * 3600000 + part(2) * 60000 + part(3) * 1000 + part(4)


def parse(text: Column) -> Column:
    """A struct of path, kind, start, end, speaker, error. The last ``#`` splits; code comes back as lines."""
    path, frag = F.regexp_extract(text, r"^(.*)#[^#]*$", 1), F.regexp_extract(text, r"#([^#]*)$", 1)
    line = r"^L(\d+)(?:-L(\d+))?$"
    kind = F.when(frag.rlike(line), "line").when(frag.rlike(r"^p=\d+$"), "page").when(frag.rlike(r"^xywh=\d+,\d+,\d+,\d+$"), "region").when(frag == "caption", "caption").when(frag.rlike(r"^t=[\d:.]+,[\d:.]+(?:&speaker=.*)?$"), "time")
    first = F.regexp_extract(frag, line, 1).try_cast("long")
    last = F.coalesce(F.regexp_extract(frag, line, 2).try_cast("long"), first)
    page = F.regexp_extract(frag, r"^p=(\d+)$", 1).try_cast("long")
    begin, end = _ms(F.regexp_extract(frag, r"^t=([\d:.]+),", 1)), _ms(F.regexp_extract(frag, r"^t=[\d:.]+,([\d:.]+)", 1))
    speaker = F.nullif(F.regexp_extract(frag, r"&speaker=(.*)$", 1), F.lit(""))
    bad = kind.isNull() | (path == "") | ((kind == "line") & ((first < 1) | (last < first)))
    return F.struct(
        F.when(~bad, path).alias("path"),
        F.when(~bad, kind).alias("kind"),
        F.when(~bad, F.coalesce(first, page, begin)).alias("start"),
        F.when(~bad, F.coalesce(last, page, end)).alias("end"),
        F.when(~bad, speaker).alias("speaker"),
        F.when(bad, "bad citation").alias("error"),
    )
