"""Chunkers: line windows and paragraphs in SQL, sequential ones as kernels over documents.

Every document is chunked within its own row: no chunker shuffles, and rows that share a
doc_id stay apart.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions import text as T
from tarnfield.sources.code import code_units

CHUNK = "doc_id string, ordinal int, chunk_id string, heading_path array<string>, text string, start int, end int, token_estimate long"


def estimate(text: str) -> int:
    return -(-len(text.encode()) // 3)


# windows in SQL --------------------------------------------------------------------------------
def _starts(n: Column, window: int, overlap: int) -> Column:
    """0-based starts of windows over n lines; the last one ends at n."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(window - overlap))


def line_windows(docs: DataFrame, window: int = 200, overlap: int = 0) -> DataFrame:
    """doc_id, ordinal, start, end (1-based lines, inclusive), text of whole files in windows of lines."""
    lines = docs.select("doc_id", F.split("text", "\n").alias("lines"))
    cut = lines.select("doc_id", "lines", F.posexplode(_starts(F.size("lines"), window, overlap)).alias("ordinal", "s"))
    end = F.least(F.col("s") + window, F.size("lines"))
    return cut.select("doc_id", "ordinal", (F.col("s") + 1).alias("start"), end.alias("end"), F.array_join(F.slice("lines", F.col("s") + 1, F.lit(window)), "\n").alias("text"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, text of runs of lines that aren't blank."""
    n = F.size("lines")
    full = lambda k: F.regexp_replace(F.get("lines", k), T.SPACE_CLASS, "") != ""
    at = F.sequence(F.lit(0), n - 1)
    firsts = F.filter(at, lambda k: full(k) & ((k == 0) | ~F.coalesce(full(k - 1), F.lit(False))))
    lasts = F.filter(at, lambda k: full(k) & ((k == n - 1) | ~F.coalesce(full(k + 1), F.lit(False))))
    lines = docs.select("doc_id", F.split("text", "\n").alias("lines")).where("lines is not null")
    runs = lines.select("doc_id", "lines", F.explode(F.arrays_zip(firsts.alias("a"), lasts.alias("b"))).alias("r"))
    return runs.select("doc_id", (F.col("r.a") + 1).alias("start"), (F.col("r.b") + 1).alias("end"), F.array_join(F.slice("lines", F.col("r.a") + 1, F.col("r.b") - F.col("r.a") + 1), "\n").alias("text"))


def paragraph_windows(docs: DataFrame, most: int = 80, overlap: int = 20) -> DataFrame:
    """Paragraphs; those of more than ``most`` lines in overlapping windows."""
    cut = paragraphs(docs).withColumn("lines", F.split("text", "\n")).withColumn("s", F.explode(F.when(F.size("lines") > most, _starts(F.size("lines"), most, overlap)).otherwise(F.array(F.lit(0)))))
    first = F.col("start") + F.col("s")
    return cut.select("doc_id", first.alias("start"), F.least(first + most - 1, F.col("end")).alias("end"), F.array_join(F.slice("lines", F.col("s") + 1, F.lit(most)), "\n").alias("text"))


# sequential kernels ----------------------------------------------------------------------------
def split_oversize(text: str, budget: int) -> list[str]:
    """Parts of at most ``budget`` * 3 bytes that join to the text: whole lines where they fit, else cuts between characters."""
    most, parts, held, used = max(budget * 3, 4), [], [], 0
    for line in text.splitlines(keepends=True):
        size = len(line.encode())
        if used + size > most and held:
            parts.append("".join(held))
            held, used = [], 0
        if size <= most:
            held.append(line)
            used += size
            continue
        for c in line:
            n = len(c.encode())
            if used + n > most:
                parts.append("".join(held))
                held, used = [], 0
            held.append(c)
            used += n
    return [*parts, "".join(held)] if held else parts


def heading_chunks(blocks: list[dict], target: int = 500, overlap: int = 80, most: int | None = None) -> list[dict]:
    """Chunks of parsed blocks (kind, text, heading_path, start, end).

    A heading starts a chunk and belongs to it; code, tables, images and audio
    stand alone; other text gathers until ``target`` tokens, and the next chunk then
    begins with the last blocks' text, up to min(overlap, target / 2) tokens of it.
    With ``most``, chunks whose text is over that many tokens are split without loss; the
    parts keep the chunk's spans and are told apart by ``seg``. A chunk of an image or a
    recording alone is estimated at no tokens.
    """
    out, held, seed = [], [], min(overlap, target // 2)

    def close(keep: bool = False) -> None:
        nonlocal held
        if any(not b.get("seed") for b in held):
            out.append({"text": "\n\n".join(b["text"] for b in held), "heading_path": held[-1]["heading_path"], "start": held[0]["start"], "end": held[-1]["end"], "spans": [(b["start"], b["end"]) for b in held]})
            tail = [b for b in held if b["kind"] != "heading"] if keep else []
            kept, used = [], 0
            for b in reversed(tail):
                if used + estimate(b["text"]) > seed:
                    break
                kept.insert(0, b | {"seed": True})
                used += estimate(b["text"])
            held = kept
        else:
            held = []

    for b in blocks:
        if b["kind"] == "heading":
            close()
            path = [*b["heading_path"], b["text"]] if b["text"] else b["heading_path"]
            held = [b | {"heading_path": path}]
        elif b["kind"] in ("code", "table", "image", "audio"):
            close()
            held = []
            out.append({k: b[k] for k in ("text", "heading_path", "start", "end")} | {"spans": [(b["start"], b["end"])], "silent": b["kind"] in ("image", "audio")})
        else:
            held.append(b)
            if sum(estimate(x["text"]) for x in held) >= target:
                close(keep=True)
    close()
    cut = []
    for n, c in enumerate(out):
        parts = split_oversize(c["text"], most) if most and estimate(c["text"]) > most else [c["text"]]
        cut += [c | {"text": t, "base": n, "seg": i if len(parts) > 1 else None} for i, t in enumerate(parts)]
    return [c | {"ordinal": k, "token_estimate": 0 if c.get("silent") else estimate(c["text"])} for k, c in enumerate(cut)]


def chunk_ids(doc_id: str, chunks: list[dict], version: str = "md-heading-v2") -> list[str]:
    """Ids from the document, the chunker and a chunk's place; the parts of a split chunk share one with ``#seg`` and their number."""
    base = [hashlib.sha256("\x1f".join([doc_id, version, str(c.get("base", k))]).encode()).hexdigest()[:32] for k, c in enumerate(chunks)]
    return [b if c.get("seg") is None else f"{b}#seg{c['seg']}" for b, c in zip(base, chunks, strict=True)]


def page_chunks(text: str, target: int = 500, overlap: int = 80, most: int = 1000) -> list[dict]:
    """Chunks of a page: cut at blank lines or sentence ends, overlapping by up to half the target; start and end are code points."""
    pieces, at = [], 0
    for m in re.finditer(r"\n\n+|(?<=[.?!])\s+", text):
        pieces.append((at, m.end()))
        at = m.end()
    pieces.append((at, len(text)))
    pieces, out, k = [p for p in pieces if text[p[0] : p[1]].strip()], [], 0
    while k < len(pieces):
        end = k + 1
        while end < len(pieces) and estimate(text[pieces[k][0] : pieces[end][1]]) <= target:
            end += 1
        start, stop = pieces[k][0], pieces[end - 1][1]
        at = start
        for part in split_oversize(text[start:stop], most):
            out.append({"text": part, "start": at, "end": at + len(part)})
            at += len(part)
        back = end
        while end < len(pieces) and back > k + 1 and estimate(text[pieces[back - 1][0] : stop]) <= min(overlap, target // 2):
            back -= 1
        k = max(back, k + 1)
    return [c | {"ordinal": i, "token_estimate": estimate(c["text"])} for i, c in enumerate(out)]


def code_chunks(units: list[dict], most: int = 200) -> list[dict]:
    """One chunk for each unit (symbol, text, start, end lines); longer ones are cut at the last blank line of a window's final fifth."""
    out = []
    for u in units:
        lines, parts, at = u["text"].split("\n"), [], 0
        while len(lines) - at > most:
            low = at + most - most // 5
            cut = next((k for k in range(at + most - 1, low - 1, -1) if not lines[k].strip()), at + most - 1) + 1
            parts.append((at, cut))
            at = cut
        parts.append((at, len(lines)))
        for i, (a, b) in enumerate(parts, 1):
            name = u["symbol"] + (f" [part {i}/{len(parts)}]" if len(parts) > 1 else "")
            out.append({"symbol": name, "text": "\n".join(lines[a:b]), "start": u["start"] + a, "end": u["start"] + b - 1})
    return out


def manifest_chunks(text: str) -> list[dict]:
    """Resources of a manifest of several documents: kind[/namespace]/name; none if any document isn't valid."""
    import yaml

    out, line = [], 1
    for part in re.split(r"(?m)^---[ \t]*$\n?", text):
        n = part.count("\n") + 1
        try:
            got = yaml.safe_load(part)
        except yaml.YAMLError:
            return []
        if isinstance(got, dict) and got.get("apiVersion") and got.get("kind"):
            meta = got.get("metadata") or {}
            name = "/".join(str(x) for x in (got["kind"], meta.get("namespace"), meta.get("name")) if x)
            out.append({"symbol": name, "text": part.strip("\n"), "start": line, "end": line + n - 1})
        line += n
    return out


def chunk_documents(docs: DataFrame, kernel: Callable[..., list[dict]], *more: str) -> DataFrame:
    """Runs a kernel over whole texts: doc_id, ordinal, symbol, text, start, end, token_estimate. The kernel gets the text and the columns ``more``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [b[c] for c in more]
            rows = [(d, k, c.get("symbol"), c["text"], c["start"], c["end"], estimate(c["text"])) for d, t, *x in zip(b["doc_id"], b["text"], *own, strict=True) for k, c in enumerate(kernel(t or "", *x))]
            yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "symbol", "text", "start", "end", "token_estimate"])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", *more).mapInPandas(run, "doc_id string, ordinal int, symbol string, text string, start int, end int, token_estimate long")


def page_documents(pages: DataFrame, target: int = 500, overlap: int = 80, most: int = 1000) -> DataFrame:
    """doc_id, page, ordinal, text, start, end, token_estimate of pages (doc_id, page, text); no chunk crosses a page, and start and end are code points of the page."""
    rows = pages.withColumn("_key", F.to_json(F.struct(F.col("doc_id").cast("string").alias("d"), F.col("page").cast("int").alias("p"))))
    got = chunk_documents(rows.select(F.col("_key").alias("doc_id"), "text"), lambda t: page_chunks(t, target, overlap, most))
    key = F.from_json("doc_id", "d string, p int")
    return got.withColumn("k", key).select(F.col("k.d").alias("doc_id"), F.col("k.p").alias("page"), "ordinal", "text", "start", "end", "token_estimate")


def markdown_chunks(docs: DataFrame, target: int = 500, overlap: int = 80, most: int | None = 1000) -> DataFrame:
    """Heading-aware chunks of Markdown texts."""
    from tarnfield.sources.markdown import parse_blocks

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["text"], strict=True):
                chunks = heading_chunks(parse_blocks(t or ""), target, overlap, most)
                rows += [(d, c["ordinal"], i, c["heading_path"], c["text"], c["start"], c["end"], c["token_estimate"]) for c, i in zip(chunks, chunk_ids(d or "", chunks), strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "chunk_id", "heading_path", "text", "start", "end", "token_estimate"])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, CHUNK)


#: Languages whose files are cut into units, into windows as a whole, and by paragraphs whatever they hold; fixed values.
UNIT_LANGUAGES = ("rust", "python", "typescript", "javascript", "go", "java", "kotlin", "c", "cpp")
WHOLE_LANGUAGES = ("toml", "json", "xml", "go-mod", "groovy", "dockerfile")


def route(docs: DataFrame) -> DataFrame:
    """Chunks by language (column code_lang; workspace_path, if there, names modules).

    Source files by units, YAML by resources, manifests and Docker files by windows of
    lines; what yields none of these goes by paragraphs as ``none-v1``. Shell scripts and
    files of other languages go by paragraphs under that chunker's own name.
    """
    path = F.col("workspace_path") if "workspace_path" in docs.columns else F.lit("")
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "code_lang", F.coalesce(path, F.lit("")).alias("path"))
    units = chunk_documents(docs.where(F.col("code_lang").isin(*UNIT_LANGUAGES)), lambda t, lang, p: code_chunks(code_units(t, lang, p)), "code_lang", "path").withColumn("chunker", F.lit("code-ast-v1"))
    k8s = chunk_documents(docs.where("code_lang = 'yaml'"), manifest_chunks).withColumn("chunker", F.lit("manifest-resource-v1"))
    no_symbol, tokens = F.lit(None).cast("string").alias("symbol"), T.chunk_token_estimate(F.col("text")).alias("token_estimate")
    whole = line_windows(docs.where(F.col("code_lang").isin(*WHOLE_LANGUAGES)), 200, 0).select("doc_id", "ordinal", no_symbol, "text", "start", "end", tokens, F.lit("file-v1").alias("chunker"))
    own = units.unionByName(k8s).unionByName(whole)
    routed = F.coalesce(F.col("code_lang").isin(*UNIT_LANGUAGES, *WHOLE_LANGUAGES, "yaml"), F.lit(False))
    rest = paragraph_windows(docs.where(routed).join(own.select("doc_id").distinct(), "doc_id", "left_anti")).withColumn("chunker", F.lit("none-v1"))
    plain = paragraph_windows(docs.where(~routed)).withColumn("chunker", F.lit("code-text-paragraph-v1"))
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end")) - 1
    return own.unionByName(rest.unionByName(plain).select("doc_id", ordinal.alias("ordinal"), no_symbol, "text", "start", "end", tokens, "chunker"))
