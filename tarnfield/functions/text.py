"""Text expressions: folding, tokens, globs, estimates, snippets, quality. All are built-in Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and their plain forms; fixed values.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyy"
TOKEN = r"([\p{L}\p{N}]+)"
MIN_TOKEN = 2
#: Unicode's white space, as a set of characters and for splitting in Python and in Spark.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_CLASS = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
SPACE = re.compile(f"[{SPACES}]+")


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def tokens(text: Column) -> Column:
    """Index tokens of a text; null has none."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def query_words(text: Column) -> Column:
    """Words of a query between white space that are long enough to search."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: F.length(w) >= MIN_TOKEN)


def query_tokens(text: Column) -> Column:
    """Distinct index tokens of a query's words."""
    return F.array_distinct(F.flatten(F.transform(query_words(text), tokens)))


def glob_regex(glob: str, crosses_separator: bool = False) -> str:
    """A path glob as an anchored regular expression.

    ``*`` and ``?`` stop at ``/`` unless ``crosses_separator``; ``**`` never stops.
    """
    out, k = [], 0
    any_one, any_run = (".", ".*") if crosses_separator else ("[^/]", "[^/]*")
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**", k):
            # "**/" may also stand for nothing
            slash = glob.startswith("**/", k)
            out.append("(?:.*/)?" if slash and not crosses_separator else ".*")
            k += 3 if slash and not crosses_separator else 2
            continue
        if c == "*":
            out.append(any_run)
        elif c == "?":
            out.append(any_one)
        elif c == "[" and (end := glob.find("]", k + 2)) > 0:
            body = glob[k + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            k = end
        elif c == "{" and not crosses_separator and (end := glob.find("}", k)) > 0:
            out.append("(?:" + "|".join(re.escape(x) for x in glob[k + 1 : end].split(",")) + ")")
            k = end
        else:
            out.append(re.escape(c))
        k += 1
    return "^" + "".join(out) + "$"


def chunk_token_estimate(text: Column) -> Column:
    """A third of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / F.lit(3)).cast("long")


def prompt_token_estimate(text: Column) -> Column:
    """A quarter of the code points, rounded up."""
    return F.ceil(F.length(text) / F.lit(4)).cast("long")


def bigrams(token: Column) -> Column:
    """Two-character windows of a token of three characters or more."""
    return F.when(F.length(token) >= 3, F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda k: F.substring(token, k, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def korean_tokens(morphemes: Column) -> Column:
    """Morphemes, and the two-character windows of those all in Hangul."""
    return F.flatten(F.transform(morphemes, lambda m: F.concat(F.array(m), F.when(m.rlike("^[가-힣]+$"), bigrams(m)).otherwise(F.array().cast("array<string>")))))


def snippet(text: Column, terms: Column, chars: int = 220) -> Column:
    """A window of clamp(chars / 4, 1, 64) words from the first word that has a term on, at most ``chars`` characters."""
    words = F.split(text, r"\s+")
    n = max(1, min(chars // 4, 64))
    first = F.array_position(F.transform(words, lambda w: F.arrays_overlap(tokens(w), terms)), True)
    start = F.greatest(F.least(F.when(first > 0, first).otherwise(1), F.size(words) - n + 1), F.lit(1)).cast("int")
    body = F.array_join(F.slice(words, start, F.lit(n)), " ")
    return F.substring(F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(start + n <= F.size(words), "…").otherwise("")), 1, chars)


#: Characters that speak for a sound extraction; fixed values.
SOUND = (
    r"\x{09}\x{0A}\x{0D}\x{20}-\x{7E}\x{A0}-\x{24F}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}"
    r"\x{2010}\x{2013}\x{2014}\x{2015}\x{2018}\x{2019}\x{201C}\x{201D}\x{201E}\x{2026}\x{2027}\x{2032}\x{2033}"
)
#: What an extractor writes for characters it has no table for; a fixed value.
MOJIBAKE = "?Identity-H Unimplemented?"


def text_quality(text: Column) -> Column:
    """Share of sound characters once the marks of missing tables are gone: 0 for no text or marks alone, at most 0.3 where marks are more than half of the bytes."""
    left = F.replace(text, F.lit(MOJIBAKE), F.lit(""))
    marked, n = F.contains(text, F.lit(MOJIBAKE)), F.length(left)
    share = F.when(n > 0, F.length(F.regexp_replace(left, f"[^{SOUND}]", "")) / n).otherwise(0.0)
    mostly = (F.octet_length(text) - F.octet_length(left)) > F.octet_length(left)
    blank = F.regexp_replace(left, SPACE_CLASS, "") == ""
    return F.when(text.isNull() | (marked & blank), 0.0).when(marked & mostly, F.least(share, F.lit(0.3))).otherwise(share)


def needs_ocr(text: Column, min_chars: int = 20, threshold: float = 0.5, always: bool = False) -> Column:
    """Whether a page's text is too short or too unsound to stand without recognition of its image."""
    return F.lit(always) | (F.length(F.coalesce(text, F.lit(""))) < min_chars) | (text_quality(text) < threshold)


#: Marks of generated files, lower-cased; fixed values.
GENERATED = ("@generated", "code generated by", "do not edit", "do not modify", "automatically generated", "auto-generated", "autogenerated")


def is_generated(text: Column) -> Column:
    """Whether the first ten lines of the first 512 bytes hold a mark of a generated file; bytes that end within a character hold none."""
    head = F.substring(text.cast("binary"), 1, 512).cast("string")
    lines = F.lower(F.array_join(F.slice(F.split(head, "\n"), 1, 10), "\n"))
    return F.coalesce(F.is_valid_utf8(head) & lines.rlike("|".join(re.escape(g) for g in GENERATED)), F.lit(False))


def line_count(text: Column) -> Column:
    """Lines; a line feed at the end starts no further one."""
    return F.size(F.split(text, "\n")) - F.when((text == "") | F.endswith(text, F.lit("\n")), 1).otherwise(0)


def is_oversize(text: Column, max_bytes: int = 262144, max_lines: int = 5000) -> Column:
    return (F.octet_length(text) > max_bytes) | (line_count(text) > max_lines)


def title(front: Column, h1: Column, h2: Column, paragraph: Column, path: Column) -> Column:
    """The first that isn't blank: given title, first heading of level 1, of level 2, 80 characters of the first paragraph, the file's stem, ``untitled``."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    tried = [front, h1, h2, F.substring(paragraph, 1, 80), stem]
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in tried], F.lit("untitled"))


def symbol_path(path: Column, symbol: Column) -> Column:
    """Dotted module path of a Python file with a symbol after it; source roots are left out, and scripts keep their path."""
    script = path.rlike(r"\.(?:[mc]?ts|tsx|[mc]?js|jsx)$")
    stem = F.regexp_replace(F.regexp_replace(path, r"\.pyi?$", ""), r"^crates/[^/]*/src/|^(?!crates/)(?:src|lib)/", "")
    module = F.replace(F.regexp_replace(stem, r"(?:^|/)__init__$", ""), F.lit("/"), F.lit("."))
    prefix = F.when(script, F.regexp_replace(path, r"\.[^./]*$", "")).otherwise(module)
    return F.concat_ws(".", F.nullif(prefix, F.lit("")), symbol)


def identity(*parts: Column) -> Column:
    """A stable 32-digit id of its parts."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def extension(path: Column) -> Column:
    """What follows the last dot of a file's name; a dot at its start begins none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


#: Extension to kind; fixed values.
MEDIA = {
    "md": "markdown", "mdx": "markdown", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image", "gif": "image", "tiff": "image", "tif": "image",
    "m4a": "audio", "mp3": "audio", "wav": "audio", "flac": "audio", "ogg": "audio",
}
#: File name, then extension, to language; fixed values.
CODE_NAMES = {
    "Dockerfile": "dockerfile", "Makefile": "make", "GNUmakefile": "make", "Cargo.toml": "toml", "pyproject.toml": "toml", "package.json": "json", "tsconfig.json": "json", "go.mod": "go-mod", "pom.xml": "xml", "build.gradle": "groovy",
}
CODE = {
    "rs": "rust", "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "sh": "shell", "bash": "shell", "zsh": "shell", "mk": "make",
    "yaml": "yaml", "yml": "yaml", "toml": "toml", "json": "json", "xml": "xml", "dockerfile": "dockerfile", "gradle": "groovy",
}


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    """The table's value, null without one."""
    out = F.when(F.lit(False), F.lit(""))
    for value in dict.fromkeys(table.values()):
        out = out.when(key.isin(*[k for k, v in table.items() if v == value]), value)
    return out


def code_language(path: Column) -> Column:
    """Language by file name, then by a name that begins with ``Dockerfile.``, then by extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.coalesce(_looked_up(name, CODE_NAMES), F.when(name.rlike(r"^Dockerfile\.."), "dockerfile"), _looked_up(extension(path), CODE))


def media_kind(path: Column) -> Column:
    """Kind of a path: code comes first, unknown extensions are ``other``."""
    return F.when(code_language(path).isNotNull(), "code").otherwise(F.coalesce(_looked_up(extension(path), MEDIA), F.lit("other")))


def exif_time(text: Column) -> Column:
    """A camera's ``YYYY:MM:DD hh:mm:ss`` as an ISO time; null if it isn't one."""
    return F.date_format(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")), "yyyy-MM-dd'T'HH:mm:ss")


def gps_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Decimal degrees; south and west are negative."""
    return (degrees + minutes / 60 + seconds / 3600) * F.when(F.upper(ref).isin("S", "W"), -1).otherwise(1)


def ctc_greedy(steps: Column, alphabet: Column) -> Column:
    """Text and mean confidence of class scores by step: the best class of each, repeats as one, class 0 (blank) and classes without a letter left out."""
    best = F.transform(steps, lambda row: F.struct((F.array_position(row, F.array_max(row)) - 1).cast("int").alias("c"), F.array_max(row).alias("v")))
    kept = F.filter(best, lambda b, i: (b["c"] != 0) & ((i == 0) | (F.get(best, i - 1)["c"] != b["c"])) & (b["c"] <= F.size(alphabet)))
    text = F.array_join(F.transform(kept, lambda b: F.get(alphabet, b["c"] - 1)), "")
    mean = F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, b: s + b["v"]) / F.size(kept)).otherwise(0.0)
    return F.struct(text.alias("text"), mean.alias("confidence"))
