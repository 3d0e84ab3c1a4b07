"""Markdown: frontmatter, metadata, a line-based block parser, and documents and blocks as DataFrames."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
import tomllib
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FENCE, HEADING = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*(\S*)"), re.compile(r"^ {0,3}(#{1,6})(?:\s+(.*?))?\s*#*\s*$")
ITEM, IMAGE = re.compile(r"^(\s*)([-*+]|\d{1,9}[.)])\s+(.*)$"), re.compile(r"^!\[([^\]]*)\]\(([^)\s]*)[^)]*\)$")
RULE, DIVIDER = re.compile(r"^ {0,3}([-*_])(?:\s*\1){2,}\s*$"), re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")


def split_frontmatter(text: str) -> tuple[dict, str, int]:
    """(fields, body, lines before the body). YAML between ``---``, TOML between ``+++``; without a closing line there is none."""
    text = text.removeprefix("﻿")
    lines = text.split("\n")
    mark = lines[0].rstrip()
    if mark not in ("---", "+++"):
        return {}, text, 0
    end = next((k for k, x in enumerate(lines[1:], 1) if x.rstrip() == mark), None)
    if end is None:
        return {}, text, 0
    raw = "\n".join(lines[1:end])
    try:
        if mark == "+++":
            fields = tomllib.loads(raw)
        else:
            import yaml

            fields = yaml.safe_load(raw)
    except Exception:  # noqa: BLE001  malformed fields are a warning, not an error
        fields = {"_warning": "malformed frontmatter"}
    return fields if isinstance(fields, dict) else {}, "\n".join(lines[end + 1 :]), end + 1


KNOWN = ("title", "tags", "aliases", "lang", "created", "updated", "source_type", "trust_level")


def metadata(fields: dict, detected_lang: str | None = None, hint: str | None = None) -> dict:
    """Typed metadata; keys that aren't known go to ``user``, odd values give warnings."""
    warnings = [fields["_warning"]] if "_warning" in fields else []

    def many(v: object) -> list[str]:
        return [str(x) for x in v] if isinstance(v, list) else [s.strip() for s in v.split(",") if s.strip()] if isinstance(v, str) else []

    def time(key: str) -> str | None:
        v = fields.get(key)
        if v is None:
            return None
        try:
            at = v if isinstance(v, dt.datetime) else dt.datetime.combine(v, dt.time()) if isinstance(v, dt.date) else dt.datetime.fromisoformat(str(v))
        except ValueError:
            warnings.append(f"bad {key}")
            return None
        return (at.replace(tzinfo=dt.UTC) if at.tzinfo is None else at.astimezone(dt.UTC)).isoformat()

    source = str(fields.get("source_type", "markdown"))
    trust = str(fields.get("trust_level", "primary"))
    if trust not in ("primary", "secondary", "generated"):
        warnings.append("bad trust_level")
        trust = "primary"
    return {
        "title": str(fields["title"]) if fields.get("title") else None, "tags": many(fields.get("tags")), "aliases": many(fields.get("aliases")), "lang": str(fields.get("lang") or detected_lang or hint or "und"),
        "created_at": time("created"), "updated_at": time("updated"), "source_type": source, "trust_level": trust, "user": {k: str(v) for k, v in fields.items() if k not in KNOWN and k != "_warning"}, "warnings": warnings,
    }


def detect_language(text: str) -> str | None:
    """en, ko, ja or zh by the scripts of the first 4096 bytes; None without letters."""
    head = text.encode()[:4096].decode(errors="ignore")
    count = lambda p: len(re.findall(p, head))
    hangul, kana, han, latin = count("[가-힣]"), count("[぀-ヿ]"), count("[一-鿿]"), count("[A-Za-z]")
    if not hangul + kana + han + latin:
        return None
    if hangul * 3 >= latin and hangul >= kana + han:
        return "ko"
    if kana and (kana + han) * 3 >= latin:
        return "ja"
    return "zh" if han * 3 >= latin and han else "en"


def parse_blocks(text: str) -> list[dict]:
    """Blocks in order: kind, text, level, lang, heading_path (ancestors only for a heading), start, end (1-based lines)."""
    _, body, skipped = split_frontmatter(text)
    lines, out, path, k = body.split("\n"), [], [], 0

    def add(kind: str, content: str, first: int, last: int, **more: object) -> None:
        out.append({"kind": kind, "text": content, "heading_path": [t for _, t in path], "start": first + skipped + 1, "end": last + skipped + 1} | more)

    while k < len(lines):
        line = lines[k]
        if not line.strip() or RULE.match(line):
            k += 1
        elif m := FENCE.match(line):
            end = next((j for j in range(k + 1, len(lines)) if re.match(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[j])), len(lines))
            add("code", "\n".join(lines[k + 1 : end]), k, min(end, len(lines) - 1), lang=m[2] or None)
            k = end + 1
        elif m := HEADING.match(line):
            level, name = len(m[1]), unicodedata.normalize("NFC", (m[2] or "").strip())
            path = [p for p in path if p[0] < level]
            add("heading", name, k, k, level=level)
            if name:
                path = [*path, (level, name)]
            k += 1
        elif "|" in line and k + 1 < len(lines) and "-" in lines[k + 1] and DIVIDER.match(lines[k + 1]):
            end = k + 2
            while end < len(lines) and "|" in lines[end]:
                end += 1
            add("table", "\n".join(lines[k:end]), k, end - 1)
            k = end
        elif line.lstrip().startswith(">"):
            end = k
            while end < len(lines) and lines[end].lstrip().startswith(">"):
                end += 1
            inner = parse_blocks("\n".join(re.sub(r"^\s*>\s?", "", x) for x in lines[k:end]))
            add("quote", "\n".join(b["text"] for b in inner if b["kind"] in ("paragraph", "quote", "heading")), k, end - 1)
            k = end
        elif ITEM.match(line):
            end, items = k, []
            while end < len(lines) and (m := ITEM.match(lines[end]) or (lines[end].strip() and re.match(r"^\s+", lines[end]))):
                got = ITEM.match(lines[end])
                if got and not got[1]:
                    items.append(got[3])
                elif got:
                    items[-1:] = [(items[-1] + "\n" if items else "") + "  " + ("1. " if got[2][0].isdigit() else "- ") + got[3]]
                elif items:
                    items[-1] += " " + lines[end].strip()
                end += 1
            add("list", "\n".join(items), k, max(end - 1, k), ordered=bool(re.match(r"\s*\d", line)))
            k = max(end, k + 1)
        else:
            end = k
            while end < len(lines) and lines[end].strip() and not (end > k and (FENCE.match(lines[end]) or HEADING.match(lines[end]) or ITEM.match(lines[end]) or lines[end].lstrip().startswith(">"))):
                end += 1
            content = "\n".join(x.strip() for x in lines[k:end])
            if m := IMAGE.match(content):
                add("image", m[1] or m[2], k, end - 1, target=m[2])
            elif not content.startswith("<"):
                add("paragraph", re.sub(r"!\[[^\]]*\]\([^)]*\)", "", content), k, end - 1)
            k = end
    return out


def to_markdown(blocks: list[dict]) -> str:
    """Blocks as text again, joined by blank lines."""
    out = []
    for b in blocks:
        if b["kind"] == "heading":
            out.append("#" * b["level"] + " " + b["text"])
        elif b["kind"] == "code":
            out.append(f"```{b.get('lang') or ''}\n{b['text']}\n```")
        elif b["kind"] == "list":
            # lines of nested lists carry their own marks and don't count
            lines, no = [], 0
            for x in b["text"].split("\n"):
                no += not x.startswith("  ")
                lines.append(x if x.startswith("  ") else f"{no}. {x}" if b.get("ordered") else f"- {x}")
            out.append("\n".join(lines))
        elif b["kind"] == "quote":
            out.append("\n".join("> " + x for x in b["text"].split("\n")))
        elif b["kind"] == "image":
            out.append(f"![{b['text']}]({b.get('target', '')})")
        else:
            out.append(b["text"])
    return "\n\n".join(out)


# DataFrames ------------------------------------------------------------------------------------
EVENT = "struct<at:string,agent:string,kind:string,note:string>"
DOCUMENT = (
    "doc_id string, workspace_path string, asset_id string, title string, lang string, tags array<string>, aliases array<string>, created_at string, updated_at string, "
    f"source_type string, trust_level string, user map<string,string>, provenance array<{EVENT}>, parser_version string, schema_version int, doc_version int"
)
BLOCK = "doc_id string, block_id string, position int, kind string, heading_path array<string>, ordinal int, start int, end int, text string, level int, lang string, target string"
PARSER_VERSION = "md-frontmatter-v1"


def identity(*parts: object) -> str:
    """A stable id of 32 digits of its parts."""
    return hashlib.sha256(json.dumps(parts, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:32]


def _nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)


def derive_title(given: str | None, blocks: list[dict], path: str) -> str:
    """Given title, first heading of level 1, of level 2, 80 characters of the first paragraph, the file's stem, ``untitled``; in NFC."""
    first = lambda *test: next((b["text"] for b in blocks if all(b.get(k) == v for k, v in test)), "")
    stem = re.sub(r"(?<=.)\.[^.]*$", "", path.rsplit("/", 1)[-1])
    tried = (given or "", first(("kind", "heading"), ("level", 1)), first(("kind", "heading"), ("level", 2)), first(("kind", "paragraph"))[:80], stem, "untitled")
    return _nfc(next(t.strip() for t in tried if t.strip()))


def canonical(text: str, path: str, asset_id: str, discovered_at: str | None = None, lang_hint: str | None = None, parser_version: str = PARSER_VERSION) -> tuple[dict, list[dict]]:
    """One Markdown file as a document row and its block rows.

    Ordinals count the blocks of one kind under one heading path, from 0. The language is
    the frontmatter's, else detected, else hinted, else ``und``.
    """
    path = _nfc(path)
    doc_id = identity("doc", path, asset_id, parser_version)
    fields, body, _ = split_frontmatter(text)
    meta, blocks, seen, rows = metadata(fields, detect_language(body), lang_hint), parse_blocks(text), {}, []
    for position, b in enumerate(blocks):
        key = (*b["heading_path"], b["kind"])
        ordinal = seen[key] = seen.get(key, -1) + 1
        block_id = identity("block", doc_id, b["kind"], b["heading_path"], ordinal, b["start"], b["end"])
        rows.append({"doc_id": doc_id, "block_id": block_id, "position": position, "ordinal": ordinal} | {k: b.get(k) for k in ("kind", "heading_path", "start", "end", "text", "level", "lang", "target", "ordered")})
    event = lambda agent, kind, note=None: {"at": discovered_at, "agent": agent, "kind": kind, "note": note}
    events = [event("source", "discovered"), event("parser", "parsed", f"parser_version={parser_version}"), event("normalizer", "normalized"), *(event("parser", "warning", w) for w in meta["warnings"])]
    doc = {"doc_id": doc_id, "workspace_path": path, "asset_id": asset_id, "title": derive_title(meta["title"], blocks, path), "provenance": events, "parser_version": parser_version, "schema_version": 1, "doc_version": 1}
    return doc | {k: meta[k] for k in ("lang", "tags", "aliases", "created_at", "updated_at", "source_type", "trust_level", "user")}, rows


def _rows(files: DataFrame, pick: Callable[[tuple[dict, list[dict]]], list[dict]], schema: str) -> DataFrame:
    names = [f.name for f in files.sparkSession.createDataFrame([], schema).schema]
    at = F.col("discovered_at").cast("string") if "discovered_at" in files.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [r for t, p, a, d in zip(b["text"], b["workspace_path"], b["asset_id"], b["discovered_at"], strict=True) for r in pick(canonical(t or "", p, a, d))]
            out = pd.DataFrame({n: pd.Series([r[n] for r in got], dtype=object) for n in names})
            for n in names:
                if n in ("position", "ordinal", "start", "end", "level", "schema_version", "doc_version"):
                    out[n] = out[n].astype("Int64")
            yield out

    return files.select("text", "workspace_path", "asset_id", at.alias("discovered_at")).mapInPandas(run, schema)


def documents_of(files: DataFrame) -> DataFrame:
    """Document rows of Markdown files (text, workspace_path, asset_id, maybe discovered_at)."""
    return _rows(files, lambda c: [c[0]], DOCUMENT)


def blocks_of(files: DataFrame) -> DataFrame:
    """Block rows of Markdown files, each file within its own task: nothing is shuffled."""
    return _rows(files, lambda c: c[1], BLOCK)


def rendered(files: DataFrame) -> DataFrame:
    """doc_id, text: files as their blocks say them again."""
    return _rows(files, lambda c: [{"doc_id": c[0]["doc_id"], "text": to_markdown(c[1])}], "doc_id string, text string")
