"""File sources: recursive scans with ignore rules, typing and hashes; golden queries from YAML."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfield.functions import text as T
from tarnfield.scratch import store_of

#: Always left out; fixed values.
BUILTIN = ("**/node_modules/**", "**/target/**", "**/__pycache__/**", "**/.venv/**", "**/venv/**", "**/env/**")
#: Noise of a desktop, left out as ``other``; fixed values.
EXCLUDED = (".DS_Store", "**/.DS_Store", "._*", "**/._*")
ASSET = "source_uri string, workspace_path string, byte_len long, checksum string, content binary"


def matches(path: Column, globs: tuple[str, ...] | list[str]) -> Column:
    """Whether any glob fits the path; an empty list fits nothing."""
    return path.rlike("|".join(T.glob_regex(g) for g in globs)) if globs else F.lit(False)


def ignore_regex(line: str) -> str | None:
    """The pattern of a line of an ignore file, for paths of files; None for blank lines and comments.

    A slash before the end ties a pattern to the root, else it fits at any depth; a slash
    at the end asks for a folder; what is below a matching folder is ignored, too.
    """
    line = line.rstrip()
    if not line or line.startswith("#"):
        return None
    line = line.removeprefix("!").removeprefix("\\")
    folder, body = line.endswith("/"), line.strip("/")
    if not body:
        return None
    tied = "/" in line.rstrip("/")
    core = T.glob_regex(body)[1:-1]
    return f"^{'' if tied else '(?:.*/)?'}{core}{'/.*' if folder else '(?:/.*)?'}$"


def ignored(path: Column, lines: list[str] | tuple[str, ...]) -> Column:
    """Whether the last fitting line of an ignore file ignores the path; null if no line fits."""
    out = F.when(F.lit(False), F.lit(True))
    for line in reversed(list(lines)):
        if (pattern := ignore_regex(line)) is not None:
            out = out.when(path.rlike(pattern), not line.startswith("!"))
    return out


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of one small file such as an ignore file, or none if it isn't there."""
    at, store = store_of(spark, path)
    if not store.exists(at):
        return []
    stream = store.open(at)  # Spark's readers see no file whose name begins with a dot
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()


def skip_category(path: Column, gitignore: list[str] = (), ownignore: list[str] = (), other: list[str] = (), include: list[str] = ()) -> Column:
    """Why a path is left out, in order: builtin, gitignore, ownignore, other, not_included; null if it isn't.

    A line of the own ignore file that begins with ``!`` takes back what the lists before it ignore.
    """
    own = ignored(path, ownignore)
    built = matches(path, BUILTIN)
    out = F.when(own.isNotNull() & ~own, F.lit(None).cast("string")).when(built, "builtin").when(F.coalesce(ignored(path, gitignore), F.lit(False)), "gitignore").when(own, "ownignore").when(matches(path, EXCLUDED) | matches(path, other), "other")
    return out.when(~matches(path, include), "not_included") if include else out


def _literal(path: str) -> str:
    """A path in which no character is read as a glob."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def scan(spark: SparkSession, root: str, source_id: str = "default", trust: str = "primary", own_ignore: str = ".searchignore", **rules: list[str]) -> DataFrame:
    """Assets below ``root``: path, size, hash, media kind, code language, why it is skipped (null: it isn't).

    The root's .gitignore and own ignore file are read beside the rules given. Paths are
    judged on a listing first, and the bytes of files that they leave out are never read;
    such rows have no hash and no content. Files whose names begin with a dot or an
    underscore are not listed at all.
    """
    at, store = store_of(spark, root)
    base = at.makeQualified(store.getUri(), store.getWorkingDirectory()).toString().rstrip("/") + "/"
    rules = {**rules, "gitignore": [*rules.get("gitignore", ()), *read_lines(spark, f"{base}.gitignore")], "ownignore": [*rules.get("ownignore", ()), *read_lines(spark, f"{base}{own_ignore}")]}
    # a listing may write one slash after the scheme or three
    inside = F.regexp_replace(F.col("path"), "^" + re.escape(base.split(":", 1)[0]) + ":/+", "/")
    plain = re.sub(r"^[^:/]+:/+", "/", base)
    workspace = F.substring(inside, len(plain) + 1, 1 << 20)
    reader = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    listed = reader().load(_literal(root)).select("path", "length", "modificationTime").withColumn("workspace_path", workspace).withColumn("skip", skip_category(F.col("workspace_path"), **rules))
    code = T.code_language(F.col("workspace_path"))
    shape = [F.col("path").alias("source_uri"), "workspace_path", F.col("length").alias("byte_len"), F.col("modificationTime").alias("discovered_at")]
    tail = [T.media_kind(F.col("workspace_path")).alias("media"), code.alias("code_lang"), "skip", F.lit(source_id).alias("source_id"), F.lit(trust).alias("trust_level")]
    gone = listed.where("skip is not null").select(*shape, F.lit(None).cast("string").alias("checksum"), F.lit(None).cast("binary").alias("content"), *tail)
    # the driver holds the list of files in any case: it plans the reads
    kept = [_literal(r["path"]) for r in listed.where("skip is null").select("path").collect()]
    if not kept:
        return gone
    text = F.col("content").cast("string")
    read = spark.read.format("binaryFile").load(kept).withColumn("workspace_path", workspace)
    late = F.when(code.isNotNull() & T.is_generated(text), "generated").when(code.isNotNull() & T.is_oversize(text), "oversize")
    found = read.withColumn("skip", late).select(*shape, F.sha2("content", 256).alias("checksum"), "content", *tail)
    return found.unionByName(gone)


def detect_repo(path: str) -> dict | None:
    """name, branch and commit of the repository that holds a local path; a branch of ``detached`` without one, None outside any."""
    at = Path(path).resolve()
    for folder in [at, *at.parents] if at.is_dir() else at.parents:
        git = folder / ".git"
        if git.is_file():
            return {"name": folder.name, "branch": None, "commit": None}
        if git.is_dir():
            try:
                head = (git / "HEAD").read_text().strip()
            except OSError:
                return {"name": folder.name, "branch": None, "commit": None}
            if not head.startswith("ref: "):
                return {"name": folder.name, "branch": "detached", "commit": head or None}
            ref = head.removeprefix("ref: ")
            commit = None
            if (git / ref).is_file():
                commit = (git / ref).read_text().strip()
            elif (git / "packed-refs").is_file():
                commit = next((line.split()[0] for line in (git / "packed-refs").read_text().splitlines() if line.endswith(f" {ref}")), None)
            return {"name": folder.name, "branch": ref.removeprefix("refs/heads/"), "commit": commit}
    return None


def scan_all(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """Scans of several sources; of equal paths the last source's row stays."""
    out = None
    for k, s in enumerate(sources):
        one = scan(spark, **s).withColumn("_order", F.lit(k))
        out = one if out is None else out.unionByName(one)
    last = out.groupBy("workspace_path").agg(F.max("_order").alias("_order"))
    return out.join(last, ["workspace_path", "_order"], "left_semi").drop("_order")


def one_file(spark: SparkSession, name: str, content: bytes, title: str | None = None, source_uri: str | None = None) -> DataFrame:
    """A single file as an asset below ``_external``; given a title, a Markdown text such as standard input gets frontmatter with it and where it came from."""
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else "md"
    if title is not None:
        if re.match(rb"\s*---\r?(?:\n|\Z)", content):
            raise ValueError("the text has frontmatter of its own")
        quoted = lambda v: json.dumps(v, ensure_ascii=False)
        lines = ["---", f"title: {quoted(title)}", *([f"source_uri: {quoted(source_uri)}"] if source_uri else []), "---", "", ""]
        content = "\n".join(lines).encode() + content
    digest = hashlib.sha256(content).hexdigest()
    return spark.createDataFrame([(source_uri or f"external:{name}", f"_external/{digest[:12]}.{ext}", len(content), digest, bytearray(content))], ASSET)


def skip_summary(scanned: DataFrame, examples: int = 5) -> DataFrame:
    """Number of skipped paths by category with the first few of them; ranks cut the paths before they meet."""
    skipped = scanned.where("skip is not null").select("skip", "workspace_path")
    first = skipped.withColumn("_n", F.row_number().over(Window.partitionBy("skip").orderBy("workspace_path"))).where(F.col("_n") <= examples)
    few = first.groupBy("skip").agg(F.array_sort(F.collect_list("workspace_path")).alias("examples"))
    return skipped.groupBy("skip").agg(F.count(F.lit(1)).alias("n")).join(few, "skip")


GOLDEN = "id string, query string, lang string, expected_doc_ids array<string>, expected_chunk_ids array<string>, must_contain array<string>, forbidden array<string>, difficulty string, `group` string"


def load_golden(spark: SparkSession, yaml_text: str) -> DataFrame:
    """Golden queries of a YAML list."""
    import yaml

    rows = [tuple(q.get(k) or ([] if k in ("expected_doc_ids", "expected_chunk_ids", "must_contain", "forbidden") else None) for k in ("id", "query", "lang", "expected_doc_ids", "expected_chunk_ids", "must_contain", "forbidden", "difficulty", "group")) for q in yaml.safe_load(yaml_text) or []]
    return spark.createDataFrame(rows, GOLDEN)


def golden_faults(golden: DataFrame, docs: DataFrame) -> DataFrame:
    """fault, key: repeated ids, groups with differing expectations, expected documents that don't exist."""
    twice = golden.groupBy("id").count().where("count > 1").select(F.lit("duplicate_id").alias("fault"), F.col("id").alias("key"))
    mixed = golden.where("`group` is not null").groupBy("group").agg(F.count_distinct(F.array_sort("expected_doc_ids")).alias("n")).where("n > 1").select(F.lit("group_mismatch").alias("fault"), F.col("group").alias("key"))
    gone = golden.select(F.explode("expected_doc_ids").alias("key")).distinct().join(docs.select(F.col("doc_id").cast("string").alias("key")), "key", "left_anti").select(F.lit("unknown_doc").alias("fault"), "key")
    return twice.unionByName(mixed).unionByName(gone)
