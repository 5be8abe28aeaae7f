"""Folders of markdown notes as frames: scan, frontmatter, links, tags, sections, link resolution."""

from __future__ import annotations

import fnmatch
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import content_hash, slug, strip, word_count
from ..operators.graph import durable

#: Folders that are never read, besides what the caller excludes.
SKIPPED = (".git", ".quillspark", ".obsidian", ".trash", "node_modules", ".venv")
#: Folders down to this depth are searched for names that begin with ``_`` or ``.``, which Spark's listing passes over.
HIDDEN_DEPTH = 6
FENCE = r"(?s)\A---\s*\n(.*?)\n---[^\n]*\n?"
_CODE_BLOCK = r"(?ms)^(```|~~~).*?^\1[^\n]*$"
_INLINE_CODE = r"`[^`\n]*`"
_WIKI = r"(!?)\[\[([^\]|#\n]*)(#[^\]|\n]*)?(\|[^\]\n]*)?\]\]"
_INLINE = r"(?<!!)\[([^\]\n]*)\]\(([^)\s]+)\)"
_TAG = r"(?U)(?:^|(?<=\s))#([\p{L}_][\w/-]*)"


def _hidden(spark: SparkSession, root: str) -> list[str]:
    """Folders and notes under ``root`` whose names begin with ``_`` or ``.``: Spark lists them only as roots of their own."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for depth in range(HIDDEN_DEPTH):
        for status in fs.globStatus(hadoop(f"{root.rstrip('/')}/{'*/' * depth}{{_,.}}*")) or []:
            path = status.getPath().toUri().getPath()
            inside = path.removeprefix(root.rstrip("/").split("://")[-1]).split("/")
            if not set(inside) & set(SKIPPED) and (status.isDirectory() or path.lower().endswith(".md")):
                found.append(status.getPath().toString())
    return found


def scan(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path (from ``root``), content, mtime of each markdown file under ``root``; ``content`` is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]").load([root, *_hidden(spark, root)])
    base = root.rstrip("/").split("://")[-1]
    rel = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), r"^.*?\Q" + base + r"\E/", "")
    notes = files.select(rel.alias("path"), "content", F.col("modificationTime").alias("mtime"))
    for glob in (*SKIPPED, *exclude):
        regex = fnmatch.translate(glob).removesuffix(r"\z").removesuffix(r"\Z")
        inner = f"(^|/){regex}/" if "/" not in glob else f"^{regex}(/|$)"
        notes = notes.where(~F.col("path").rlike(inner) & ~F.col("path").rlike(f"^{regex}$"))
    return notes


def read_notes(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), generated: tuple[str, ...] = (), marker: str = "quillspark") -> DataFrame:
    """One row for each markdown file under ``root``: id, path, raw, body, title, tags, aliases, frontmatter (JSON by key),
    word_count, mtime, hash, generated. Bad bytes are replaced, not refused."""
    files = scan(spark, root, exclude).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("raw"), "mtime")
    return parse_notes(files, generated, marker)


def parse_notes(files: DataFrame, generated: tuple[str, ...] = (), marker: str = "quillspark") -> DataFrame:
    """Notes from path, raw, mtime."""
    block = rf"(?s)<!-- {marker}:start -->.*?<!-- {marker}:end -->"
    fm = files.withColumn("frontmatter", frontmatter(F.regexp_extract("raw", FENCE, 1)))
    body = fm.withColumn("body", strip(F.regexp_replace(F.regexp_replace("raw", FENCE, ""), block, "")))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.md$", "")
    h1 = F.regexp_extract("body", r"(?m)^#\s+(.+?)\s*$", 1)
    value = lambda k: F.get_json_object(F.element_at("frontmatter", k), "$")
    under = [F.col("path").startswith(f"{d.strip('/')}/") for d in generated]
    flag = F.lit(False)
    for u in under:
        flag = flag | u
    fm_tags = F.concat(_list(F.element_at("frontmatter", "tags"), True), _list(F.element_at("frontmatter", "tag"), True))
    return body.select(
        F.regexp_replace("path", r"(?i)\.md$", "").alias("id"),
        "path",
        F.coalesce(F.nullif(strip(value("title")), F.lit("")), F.nullif(h1, F.lit("")), stem).alias("title"),
        tags(F.col("body"), fm_tags).alias("tags"),
        F.concat(_list(F.element_at("frontmatter", "aliases"), False), _list(F.element_at("frontmatter", "alias"), False)).alias("aliases"),
        "frontmatter",
        "raw",
        "body",
        word_count(F.col("body")).alias("word_count"),
        "mtime",
        content_hash(F.col("body")).alias("hash"),
        flag.alias("generated"),
    )


def _list(value: Column, split: bool) -> Column:
    """A JSON list, or a string (split at commas and blanks if asked), as strings."""
    text = F.coalesce(F.get_json_object(value, "$"), F.lit(""))
    parts = F.split(text, r"[,\s]+") if split else F.array(text)
    listed = F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.when(value.startswith("["), listed).otherwise(parts), lambda x: x.isNotNull() & (x != ""))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def frontmatter(blocks: pd.Series) -> pd.Series:
    """YAML (a small subset where no YAML library is there) to key -> JSON of the value; anything but a mapping is empty."""
    return blocks.map(lambda b: {str(k): json.dumps(v, default=str) for k, v in _mapping(b or "").items()})


def _mapping(block: str) -> dict:
    try:
        import yaml

        found = yaml.safe_load(block)
        return found if isinstance(found, dict) else {}
    except Exception:
        return _plain_yaml(block)


def _plain_yaml(block: str) -> dict:
    """``key: value``, ``key: [a, b]`` and ``- item`` lines under a key."""
    out: dict = {}
    key = None
    unquote = lambda s: s.strip().strip("'\"")
    for line in block.splitlines():
        if line.lstrip().startswith("- ") and key is not None:
            if not isinstance(out[key], list):
                out[key] = []
            out[key].append(unquote(line.lstrip()[2:]))
        elif ":" in line and not line.startswith((" ", "#")):
            key, _, value = line.partition(":")
            key, value = key.strip(), value.strip()
            inside = value[1:-1] if value.startswith("[") and value.endswith("]") else None
            out[key] = [unquote(x) for x in inside.split(",") if x.strip()] if inside is not None else unquote(value)
    return out


def without_code(body: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(body, _CODE_BLOCK, " "), _INLINE_CODE, " ")


def tags(body: Column, given: Column) -> Column:
    """Tags of the frontmatter, then inline ones (headings and code apart): lower case, first place kept."""
    text = F.regexp_replace(without_code(body), r"(?m)^#{1,6}\s.*$", " ")
    inline = F.regexp_extract_all(text, F.lit(_TAG), F.lit(1))
    return F.array_distinct(F.transform(F.concat(F.transform(given, lambda t: F.regexp_replace(t, "^#+", "")), inline), F.lower))


def links(body: Column) -> Column:
    """array<struct<target, anchor, text, kind>>: wiki links and embeds, then markdown links to notes."""
    text = without_code(body)
    wiki = F.transform(
        F.regexp_extract_all(text, F.lit(_WIKI), F.lit(0)),
        lambda m: F.struct(
            F.btrim(F.regexp_extract(m, _WIKI, 2)).alias("target"),
            F.btrim(F.regexp_replace(F.regexp_extract(m, _WIKI, 3), "^#", "")).alias("anchor"),
            F.btrim(F.regexp_replace(F.regexp_extract(m, _WIKI, 4), r"^\|", "")).alias("text"),
            F.when(m.startswith("!"), "embed").otherwise("wiki").alias("kind"),
        ),
    )
    unquoted = lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
    inline = F.transform(
        F.regexp_extract_all(text, F.lit(_INLINE), F.lit(0)),
        lambda m: F.struct(
            unquoted(F.substring_index(F.regexp_extract(m, _INLINE, 2), "#", 1)).alias("target"),
            F.when(F.contains(m, F.lit("#")), F.regexp_extract(m, r"#([^)\s]*)\)$", 1)).otherwise("").alias("anchor"),
            F.regexp_extract(m, _INLINE, 1).alias("text"),
            F.lit("markdown").alias("kind"),
        ),
    )
    note = lambda x: ~F.lower(x["target"]).rlike(r"^[a-z][a-z0-9+.-]*:") & (F.lower(x["target"]).endswith(".md") | ~F.contains(F.element_at(F.split(x["target"], "/"), -1), F.lit(".")))
    return F.filter(F.concat(wiki, F.filter(inline, note)), lambda x: (x["target"] != "") | (x["anchor"] != ""))


def sections(notes: DataFrame) -> DataFrame:
    """note_id, pos, level, heading, anchor, body: split at headings outside fences; empty ones go, the preamble has level 0."""
    # a heading inside a fence must not split: its mark is hidden while the text is cut
    hidden = F.array_join(
        F.transform(
            F.split("body", r"(?m)(?=^(?:```|~~~))"),
            lambda part, i: F.when(i % 2 == F.when(F.col("body").rlike(r"\A(```|~~~)"), 0).otherwise(1), F.regexp_replace(part, r"(?m)^#", "\u0001")).otherwise(part),
        ),
        "",
    )
    cut = notes.select(F.col("id").alias("note_id"), F.posexplode(F.split(hidden, r"(?m)(?=^#{1,6}\s)")).alias("pos", "part"))
    part = F.replace(F.col("part"), F.lit("\u0001"), F.lit("#"))
    head = r"\A(#{1,6})\s+([^\n]*?)\s*(?:\n|\z)"
    out = cut.where(strip(F.col("part")) != "").select(
        "note_id", "pos", F.length(F.regexp_extract("part", head, 1)).alias("level"), F.regexp_extract("part", head, 2).alias("heading"), strip(F.regexp_replace(part, head, "")).alias("body")
    )
    return out.withColumn("anchor", F.when(F.col("heading") == "", "").otherwise(slug(F.col("heading"))))


def resolve_links(notes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """src, dst (null: broken), target, anchor, kind. A target means, in this order: a path from the source's folder, an id,
    a file stem (if several: the longest common folder path with the source, then the first id), a title or an alias.
    ``known`` (id, title, aliases): the notes that may be meant, if they are others than those whose links are resolved.
    Links and names are kept, as they are read three times each."""
    found = notes.select(F.col("id").alias("src"), F.explode(links(F.col("body"))).alias("l")).select("src", "l.target", "l.anchor", "l.kind")
    found = found.withColumn("key", F.lower(F.regexp_replace(F.regexp_replace("target", r"(?i)\.md$", ""), "^/+", ""))).withColumn("n", F.monotonically_increasing_id())
    folder = F.slice(F.split("src", "/"), F.lit(1), F.size(F.split("src", "/")) - 1)
    walked = F.aggregate(
        F.concat(folder, F.split("key", "/")),
        F.array().cast("array<string>"),
        lambda path, x: F.when(x == "..", F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))).when(x.isin("", "."), path).otherwise(F.concat(path, F.array(x))),
    )
    found = durable(found.withColumn("relative", F.when(F.contains("key", F.lit("/")) | (F.col("kind") == "markdown"), F.lower(F.array_join(walked, "/")))))
    real = durable(notes.select("id", "title", "aliases")) if known is None else known
    stem = F.lower(F.element_at(F.split("id", "/"), -1))
    names = real.select("id", F.lower("id").alias("name"), F.lit(1).alias("rank"))
    names = names.unionByName(real.select("id", stem.alias("name"), F.lit(2).alias("rank")))
    names = names.unionByName(real.select("id", F.explode(F.transform(F.concat(F.array("title"), "aliases"), F.lower)).alias("name"), F.lit(3).alias("rank"))).distinct()
    by_path = found.where("relative IS NOT NULL").select("n", "src", F.col("relative").alias("name"), F.lit(0).alias("step"))
    tried = by_path.unionByName(found.select("n", "src", F.when(F.col("key") == "", F.lower("src")).otherwise(F.col("key")).alias("name"), F.lit(1).alias("step")))
    hits = tried.join(names, "name").where("step = 1 OR rank = 1")
    common = F.aggregate(
        F.arrays_zip(F.split("src", "/").alias("a"), F.split("id", "/").alias("b")),
        F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")),
        lambda s, x: F.struct((s["k"] + F.when(s["on"] & (x["a"] == x["b"]), 1).otherwise(0)).alias("k"), (s["on"] & F.coalesce(x["a"] == x["b"], F.lit(False))).alias("on")),
    )["k"]
    best = hits.withColumn("rn", F.row_number().over(Window.partitionBy("n").orderBy("step", "rank", F.desc(common), "id"))).where("rn = 1").select("n", F.col("id").alias("dst"))
    return found.join(best, "n", "left").select("src", "dst", "target", "anchor", "kind")

