"""JSON-lines records, framework and settings files, and snapshot writes."""

from __future__ import annotations

import tomllib
import uuid
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Settings:
    """Settings with defaults; a file's unknown keys are ignored."""

    output_dir: str = "_notes"
    research_dir: str = "_research"
    exclude: tuple[str, ...] = ()
    related_k: int = 6
    related_floor: float = 0.12
    link_style: str = "wiki"
    max_workers: int = 4

    @classmethod
    def parse(cls, text: str, table: str = "quillspark") -> Settings:
        found = tomllib.loads(text)
        found = found.get(table, found)
        known = {f.name for f in fields(cls)}
        given = {k: tuple(v) if isinstance(v, list) else v.strip("/") if k.endswith("_dir") else v for k, v in found.items() if k in known}
        return cls(**given)


@dataclass
class Framework:
    """A typed contract of scales, relations, kinds of evidence and checks."""

    id: str
    version: int = 1
    scales: list[dict] = field(default_factory=list)
    relations: list[dict] = field(default_factory=list)
    evidence: list[dict] = field(default_factory=list)
    checks: list[dict] = field(default_factory=list)
    context_fields: list[str] = field(default_factory=list)
    context_match: list[str] = field(default_factory=list)

    @property
    def ref(self) -> str:
        return f"{self.id}@{self.version}"

    @classmethod
    def parse(cls, text: str) -> Framework:
        found = tomllib.loads(text)
        fw = cls(**{f.name: found[f.name] for f in fields(cls) if f.name in found})
        fw.validate()
        return fw

    def validate(self) -> None:
        """Raise ValueError with everything that is wrong."""
        wrong = []
        if not self.scales:
            wrong.append("no scales")
        for name in ("scales", "relations", "evidence", "checks"):
            ids = [x.get("id") for x in getattr(self, name)]
            wrong += [f"{name}: {i!r} is there twice" for i in {i for i in ids if ids.count(i) > 1}]
            wrong += [f"{name}: an entry has no id" for i in ids if not i]
        wrong += [f"relation {r['id']}: kind {r.get('kind')!r}" for r in self.relations if r.get("kind") not in ("causal", "associative", "compositional", "descriptive")]
        wrong += [f"relation {r['id']}: sign {r.get('sign')!r}" for r in self.relations if r.get("sign", 0) not in (-1, 0, 1)]
        wrong += [f"evidence {e['id']}: weight {e.get('weight')!r}" for e in self.evidence if not 0 <= e.get("weight", 0) <= 1]
        wrong += [f"context_match: {c!r} is not a context field" for c in self.context_match if c not in self.context_fields]
        if wrong:
            raise ValueError("; ".join(sorted(wrong)))

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        """scales (idx, id, name), relations (id, kind, sign), evidence (id, weight, supports_causal)."""
        return {
            "scales": spark.createDataFrame([(i, s["id"], s.get("name", s["id"])) for i, s in enumerate(self.scales)], "idx int, id string, name string"),
            "relations": spark.createDataFrame([(r["id"], r["kind"], int(r.get("sign", 0))) for r in self.relations], "id string, kind string, sign int"),
            "evidence": spark.createDataFrame([(e["id"], float(e.get("weight", 0)), bool(e.get("supports_causal"))) for e in self.evidence], "id string, weight double, supports_causal boolean"),
        }


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """Records with their file; with ``key``, the one of the last file wins."""
    rows = spark.read.schema(schema).json(path).withColumn("__file", F.col("_metadata.file_path"))
    if key is None:
        return rows.drop("__file")
    own = [c for c in rows.columns if c != "__file"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*own), "__file").alias("r")).select("r.*")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Replace the Parquet table at ``path``, also where ``df`` reads it: write beside it, put the old one aside, rename,
    then delete the old one. At every moment one of them is whole, at ``path`` or beside it with the suffix ``.old``;
    ``read_snapshot`` finds it."""
    spark = df.sparkSession
    path = path.rstrip("/")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    staged, aside, to = hadoop(f"{path}.{uuid.uuid4().hex}"), hadoop(f"{path}.old"), hadoop(path)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.parquet(staged.toString())
    if fs.exists(to):
        fs.delete(aside, True)
        if not fs.rename(to, aside):
            raise OSError(f"cannot put {path} aside")
    if not fs.rename(staged, to):
        raise OSError(f"cannot rename {staged} to {path}")
    fs.delete(aside, True)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def has_snapshot(spark: SparkSession, path: str) -> bool:
    return _there(spark, path.rstrip("/")) or _there(spark, f"{path.rstrip('/')}.old")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``write_snapshot`` keeps at ``path``, also after a write that broke off."""
    path = path.rstrip("/")
    return spark.read.parquet(path if _there(spark, path) else f"{path}.old")


def changed_pages(pages: DataFrame, existing: DataFrame) -> DataFrame:
    """Pages (path, text) that differ from what is there: what a writer has to touch."""
    digest = lambda df: df.select("path", F.sha2("text", 256).alias("digest"))
    return pages.withColumn("digest", F.sha2("text", 256)).join(digest(existing), ["path", "digest"], "left_anti").drop("digest")
