"""File sets: listing with globs, download metadata, integrity checks, model folders. All paths are local or on a mirror that Spark reads.

Network access (asking a hub for files, users or redirects) is not part of this library; a local mirror's folder takes its place."""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import Config, loads, merge

COMMIT, SHA256 = "^[0-9a-f]{40}$", "^[0-9a-f]{64}$"


class RepoError(Exception):
    """`kind` is one of: parse, authorization, unexpected, download, http, not_found, network, resource_not_found, config_missing, file_integrity,
    invalid_metadata, file_missing, offline_no_files, offline_no_repo."""

    def __init__(self, kind: str, what: str = ""):
        super().__init__(f"{kind}: {what}" if what else kind)
        self.kind = kind


# Configuration files


def read_config(path: str | Path) -> Config:
    """JSON from a file; null where the file is not there."""
    p = Path(path)
    return loads(p.read_bytes()) if p.exists() else Config()


def read_config_in(folder: str | Path, name: str) -> Config:
    return read_config(Path(folder) / name)


#: Defaults by model type, for folders without a tokenizer configuration.
FALLBACKS = {
    "gpt2": {"tokenizer_class": "GPT2Tokenizer", "bos_token": "<|endoftext|>", "eos_token": "<|endoftext|>", "unk_token": "<|endoftext|>", "model_max_length": 1024, "add_prefix_space": False},
    "t5": {"tokenizer_class": "T5Tokenizer", "eos_token": "</s>", "unk_token": "<unk>", "pad_token": "<pad>", "extra_ids": 100, "model_max_length": 512},
}


def fallback_config(model_type: str) -> Config:
    """Null for types without defaults; names other than letters, digits, _ and - are an error."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", model_type):
        raise RepoError("unexpected", f"bad model type {model_type!r}")
    return Config(FALLBACKS.get(model_type))


def tokenizer_config(given: Config, model_config: Config) -> Config:
    """As given if it names a class; else with the type's defaults, which win; else with <ModelType>Tokenizer as class."""
    if given.is_null:
        return fallback_config(model_config.modelType.string("")) if model_config.modelType.string() else Config()
    if not given.tokenizerClass.is_null:
        return given
    kind = model_config.modelType.string()
    if kind is None:
        return given
    defaults = fallback_config(kind)
    if not defaults.is_null:
        return Config(merge(given.value, defaults.value))
    return Config(merge(given.value, {"tokenizer_class": f"{kind[:1].upper()}{kind[1:]}Tokenizer"}))


def read_model_folder(folder: str | Path) -> dict[str, Config]:
    """config (may be null), tokenizer_data (required) and tokenizer_config (with the chat template: .jinja before .json)."""
    folder = Path(folder)
    config, data = read_config_in(folder, "config.json"), read_config_in(folder, "tokenizer.json")
    if data.is_null:
        raise RepoError("config_missing", "tokenizer.json")
    own = read_config_in(folder, "tokenizer_config.json")
    template = None
    if (folder / "chat_template.jinja").exists():
        template = (folder / "chat_template.jinja").read_text()
    elif (folder / "chat_template.json").exists():
        template = read_config_in(folder, "chat_template.json").chatTemplate.native()
    if template is not None:
        own = Config({**(own.value or {}), "chat_template": template})
    return {"config": config, "tokenizer_data": data, "tokenizer_config": tokenizer_config(own, config)}


def read_model_folders(spark: SparkSession, folders: str) -> DataFrame:
    """(path, name, content) of all JSON and template files in many folders, read by Spark."""
    files = spark.read.text(folders, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).where(name.rlike(r"\.(json|jinja)$")).select("path", "name", "content")


# Reading and listing


def spread(rows: DataFrame) -> DataFrame:
    """A table of few files, dealt to all cores before costly work on its rows: no more than one task reads a file's row group. A table with a file
    for each core stays as it is, so a large one is not shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob in which * and ? also match slashes, and case counts."""
    return fnmatch.translate(glob).replace(r"\Z", "$").replace("\\z", "$")


def matches(name: Column, globs: list[str]) -> Column:
    """Whether any glob fits; without globs, all names do."""
    found = F.lit(not globs)
    for g in globs:
        found = found | name.rlike("^" + re.sub(r"^\(\?s:(.*)\)(\$|\\Z|\\z)$", r"(?s:\1)$", glob_pattern(g)))
    return found


def list_files(spark: SparkSession, folder: str, globs: list[str] | None = None) -> DataFrame:
    """(name, size, modified) of files below a folder. Contents are not read."""
    base = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    name = F.substring_index(F.col("path"), base.removeprefix("file://") + "/", -1)
    return files.select(name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where(matches(F.col("name"), globs or [])).distinct()


def local_path(base: str, kind: Column, repo: Column) -> Column:
    return F.concat_ws("/", F.lit(base), kind, repo)


def resolve_url(endpoint: str, kind: Column, repo: Column, revision: Column, name: Column) -> Column:
    """The address of a file; the kind is left out for models, slashes in a revision are encoded."""
    prefix = F.when(kind == "models", F.lit("")).otherwise(F.concat(kind, F.lit("/")))
    return F.concat(F.lit(endpoint + "/"), prefix, repo, F.lit("/resolve/"), F.replace(revision, F.lit("/"), F.lit("%2F")), F.lit("/"), name)


def clean_etag(etag: Column) -> Column:
    """Without W/ and quotes."""
    return F.regexp_replace(F.regexp_replace(etag, "^W/", ""), '"', "")


def link_url(header: Column, rel: str) -> Column:
    """The address that a Link header gives for a relation, else null."""
    found = F.regexp_extract(header, rf'<([^>]*)>[^,]*;\s*rel="?{re.escape(rel)}"?', 1)
    return F.when(found != "", found)


# Metadata and integrity


def is_commit(c: Column) -> Column:
    return c.rlike(COMMIT)


def is_sha256(c: Column) -> Column:
    return c.rlike(SHA256)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(name, commit, etag, seconds) of .metadata files of three lines, names below the folder; those that cannot be read are left out."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.metadata")
    line = lambda i: F.get(F.split("value", "\n"), F.lit(i))
    whole = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    name = F.substring_index(whole, path.rstrip("/").removeprefix("file://") + "/", -1)
    rows = files.select(F.regexp_replace(name, r"\.metadata$", "").alias("name"), line(0).alias("commit"), line(1).alias("etag"), line(2).try_cast("double").alias("seconds"))
    return rows.where("commit IS NOT NULL AND etag IS NOT NULL AND seconds IS NOT NULL")


def write_metadata(path: str | Path, commit: str, etag: str, seconds: float) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(f"{commit}\n{etag}\n{seconds}\n")


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def hash_file(path: str | Path, chunk: int = 1 << 20) -> str:
    """SHA-256 of a file of any size, in bounded memory."""
    import hashlib

    h = hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(chunk):
            h.update(data)
    return h.hexdigest()


def placed(uri: str):
    """The file system and path of a URI or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def _opened(uri: str):
    """A stream of a file by URI or local path."""
    system, path = placed(uri)
    return system.open_input_stream(path, compression=None)


@F.pandas_udf(T.StringType())
def hash_of(path: pd.Series) -> pd.Series:
    """SHA-256 of the files at paths or URIs, of any size, a megabyte at a time."""
    import hashlib

    def one(uri: str) -> str:
        h = hashlib.sha256()
        with _opened(uri) as f:
            while data := f.read(1 << 20):
                h.update(data)
        return h.hexdigest()

    return path.map(one, na_action="ignore")


def materialize(decided: DataFrame, source: str, target: str) -> DataFrame:
    """Copies the files that `snapshot` decided to download from a mirror's folder to another, both shared, and writes their metadata below
    .metadata there. (name, decision, bytes) of all files, as they are done; a file appears whole or not at all, so a task may run twice."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import shutil
        import time
        import uuid

        for f in frames:
            for r in f.itertuples():
                to = Path(target) / r.name
                if Path(target).resolve() not in to.resolve().parents:
                    raise RepoError("unexpected", f"{r.name!r} leaves the folder")
                size = 0
                if r.decision == "download":
                    to.parent.mkdir(parents=True, exist_ok=True)
                    part = to.with_name(f"{to.name}.{uuid.uuid4().hex}.part")
                    with _opened(f"{source.rstrip('/')}/{r.name}") as a, open(part, "wb") as b:
                        shutil.copyfileobj(a, b, 1 << 20)
                        size = b.tell()
                    os.replace(part, to)
                write_metadata(Path(target) / ".metadata" / f"{r.name}.metadata", r.commit, r.etag, time.time())
                yield pd.DataFrame({"name": [r.name], "decision": [r.decision], "bytes": [size]})

    columns = decided.select(F.col("name"), F.col("commit"), F.col("etag"), F.col("decision"))
    return columns.mapInPandas(run, "name string, decision string, bytes long")


def download_decision(local_commit: Column, commit: Column, local_etag: Column, etag: Column, local_hash: Column) -> Column:
    """keep_commit, keep_etag, keep_hash or download."""
    return (
        F.when(local_commit.isNotNull() & (local_commit == commit) & is_commit(commit), "keep_commit")
        .when(local_etag.isNotNull() & (local_etag == etag), "keep_etag")
        .when(is_sha256(etag) & (local_hash == etag), "keep_hash")
        .otherwise("download")
    )


def snapshot(local: DataFrame, remote: DataFrame, globs: list[str] | None = None) -> DataFrame:
    """What to do with each file of a mirror: remote (name, commit, etag) joined to local (name, commit, etag, sha256)."""
    mine = local.select("name", F.col("commit").alias("__commit"), F.col("etag").alias("__etag"), F.col("sha256").alias("__sha256"))
    rows = remote.where(matches(F.col("name"), globs or [])).join(mine, "name", "left")
    return rows.withColumn("decision", download_decision(F.col("__commit"), F.col("commit"), F.col("__etag"), F.col("etag"), F.col("__sha256"))).drop("__commit", "__etag", "__sha256")


def offline_violations(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Of files (name, sha256): those without metadata, or whose hash is not the one their metadata name."""
    rows = files.join(metadata, "name", "left")
    problem = F.when(F.col("commit").isNull(), "metadata_missing").when(is_sha256(F.col("etag")) & (F.col("etag") != F.col("sha256")), "hash_mismatch")
    return rows.withColumn("problem", problem).where("problem IS NOT NULL").select("name", "problem")


def validate_offline(spark: SparkSession, folder: str, metadata: str) -> None:
    """Raises if the folder or its files are missing, or any file fails its check."""
    if not Path(folder.removeprefix("file://")).is_dir():
        raise RepoError("offline_no_repo", folder)
    base = folder.rstrip("/").removeprefix("file://") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    names = raw.select("path", F.substring_index("path", base, -1).alias("name")).where(~F.col("name").endswith(".metadata"))
    files = names.select("name", hash_of(F.col("path")).alias("sha256"))
    if files.isEmpty():
        raise RepoError("offline_no_files", folder)
    bad = offline_violations(files, read_metadata(spark, metadata)).head()
    if bad is not None:
        raise RepoError("file_integrity" if bad["problem"] == "hash_mismatch" else "invalid_metadata", bad["name"])


def dump(config: Config, path: str | Path) -> None:
    Path(path).write_text(json.dumps(config.native(), ensure_ascii=False))


def merge_maps(left: DataFrame, right: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Both tables' keys; where both have one, the right side's value."""
    a, b = left.select(key, F.col(value).alias("__l")), right.select(key, F.col(value).alias("__r"))
    return a.join(b, key, "full").select(key, F.coalesce("__r", "__l").alias(value))
