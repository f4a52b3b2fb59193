"""Reading markup texts, vocabularies, binary uploads and settings; writing results."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.functions.text import first_line_label
from quill.sources import results as store


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """name, text of whole files, line ends as LF."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("name"), F.col("value").alias("text"))
    return unix_lines(rows)


def unix_lines(docs: DataFrame, text_column: str = "text") -> DataFrame:
    return docs.withColumn(text_column, F.regexp_replace(text_column, "\r\n?", "\n"))


def read_vocabulary(spark: SparkSession, path: str, fallback: list[str]) -> DataFrame:
    """name: the tags of all groups of a JSON rule file {"tags": {group: [tag]}}, in lower case; the fallback where the file is missing or gives none."""
    own = spark.createDataFrame([(n.lower(),) for n in fallback], "name string")
    if not _exists(spark, path):
        return own.distinct()
    schema = "tags map<string,array<string>>"
    found = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("r")).select(F.explode("r.tags").alias("group", "names")).select(F.explode("names").alias("tag")).select(F.lower("tag").alias("name")).distinct()
    return own.distinct() if found.isEmpty() else found


def optional_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, stripped; null where it is missing."""
    row = spark.read.text(path, wholetext=True).select(F.trim("value")).first() if _exists(spark, path) else None
    return row and row[0]


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    fs, target = _hadoop(spark, path)
    return bool(fs.exists(target))


#: How files of these kinds begin, in hexadecimal digits.
SIGNATURES = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "pdf": "255044462D"}


def read_uploads(spark: SparkSession, path: str, pattern: str = "*", most_bytes: int = 50 << 20, kinds: tuple[str, ...] = ("png", "jpeg")) -> DataFrame:
    """token (32 random hexadecimal digits), name, kind, length, content of binary files up to a size whose first bytes are those of one of the kinds."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).filter(F.col("length") <= most_bytes)
    begins = F.hex(F.substring("content", 1, 8))
    kind = F.coalesce(*[F.when(begins.startswith(SIGNATURES[k]), k) for k in kinds])
    token = F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))
    return files.select(token.alias("token"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), kind.alias("kind"), "length", "content").filter("kind is not null")


def labelled_tabs(texts: DataFrame) -> DataFrame:
    """Markdown pages by name with the label of their first line and the rest of the text."""
    is_heading = F.col("text").startswith("# ")
    body = F.when(is_heading, F.regexp_replace("text", r"\A[^\n]*\n?", "")).otherwise(F.col("text"))
    return texts.select("name", first_line_label(F.col("text")).alias("label"), body.alias("body")).orderBy("name")


def legal_page(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Texts without HTML comments and without one leading top heading."""
    plain = F.regexp_replace(text_column, "(?s)<!--.*?-->", "")
    return docs.withColumn(text_column, F.regexp_replace(plain, r"(?U)\A\s*# [^\n]*\n?", ""))


def setting(name: str, section: Mapping, default, env: Mapping[str, str] = os.environ):
    """The environment's value, then the file's, then the default. An empty value, a number that is none and a truth value that is neither true nor false fall through."""
    raw = env.get(name.upper(), "").strip()
    if raw and isinstance(default, bool):
        known = {**dict.fromkeys(("1", "true", "yes", "on"), True), **dict.fromkeys(("0", "false", "no", "off"), False)}
        if raw.lower() in known:
            return known[raw.lower()]
    elif raw:
        try:
            return type(default)(raw)
        except ValueError:
            pass
    return section.get(name, default)


def save_results(results: DataFrame, path: str, key: str = "token") -> None:
    """Result documents as JSON, one for each key: the last by `version` takes the place of an older one with its key. Only these documents are written, as a new version of the store."""
    last = results.groupBy(F.col(key).alias("token")).agg(F.max_by(F.to_json(F.struct(*[c for c in results.columns if c not in (key, "version")])), "version").alias("result"))
    store.save(last, path)


def delete_results(spark: SparkSession, path: str, keys: list[str]) -> None:
    """Removes the documents of some keys."""
    store.save(spark.createDataFrame([(k, None) for k in keys], "token string, result string"), path)


def load_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What save_results wrote; keys of hexadecimal digits only."""
    rows = store.view(spark, path).filter(F.col("token").rlike(r"\A[0-9a-f]+\z"))
    return rows.select("token", F.from_json("result", schema).alias("r")).select("token", "r.*")
