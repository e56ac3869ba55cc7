"""Sources: text files, lists and trees of files, archives with markers, tables, finding imports.

All give (fid, fnm, text); fid is a hash of the name, so it needs no numbering pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.match import MatchFrame


def _files(df: DataFrame) -> DataFrame:
    return df.select(F.xxhash64("fnm").alias("fid"), "fnm", F.col("value").alias("text"))


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """Each file whole, one row a file."""
    return _files(spark.read.text(list(paths), wholetext=True).withColumn("fnm", F.regexp_replace(F.input_file_name(), "^file:/+", "/")))


def read_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """All files below a folder whose names fit the glob."""
    return _files(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True).withColumn("fnm", F.regexp_replace(F.input_file_name(), "^file:/+", "/")))


def parse_file_list(text: str) -> list[tuple[str, list[str]]]:
    """(file, its -I, -D and -U options) of each line that isn't a # comment."""
    out = []
    for line in text.splitlines():
        words = line.split("#", 1)[0].split()
        names = [w for w in words if not w.startswith("-")]
        if names:
            out.append((names[-1], [w for w in words if w[:2] in ("-I", "-D", "-U")]))
    return out


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """The files that a list names, with their options as a column."""
    rows = parse_file_list("\n".join(r.value for r in spark.read.text(path).toLocalIterator()))
    options = spark.createDataFrame(rows, "fnm string, options array<string>")
    return read_files(spark, *[r[0] for r in rows]).join(options, "fnm", "left").select("fid", "fnm", "text", "options")


def read_table(df: DataFrame, key: str, text: str, name: str | None = None) -> DataFrame:
    """A table whose rows are the files."""
    return df.select(F.col(key).cast("long").alias("fid"), (F.col(name) if name else F.concat(F.lit(f"{key}="), F.col(key))).cast("string").alias("fnm"), F.col(text).cast("string").alias("text"))


def split_archive(files: DataFrame, marker: str = "@>") -> DataFrame:
    """Concatenated files: each line ``@>name`` begins another one, whose lines count from 1."""
    lines = files.select("fid", "fnm", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    w = Window.partitionBy("fid").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("name", F.when(F.col("line").startswith(marker), F.substring("line", len(marker) + 1, 1 << 30)))
    named = named.withColumn("inner", F.coalesce(F.last("name", ignorenulls=True).over(w), F.col("fnm"))).withColumn("part", F.count("name").over(w)).where("name is null")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    return named.groupBy("fid", "part", F.col("inner").alias("fnm")).agg(text.alias("text")).select(F.xxhash64("fid", "part", "fnm").alias("fid"), "fnm", "text")


def without_headers(files: DataFrame) -> DataFrame:
    return files.where(~F.col("fnm").endswith(".h"))


def dummy_tokens(spark: SparkSession, n: int) -> DataFrame:
    """A stream of n empty tokens, for programs without input."""
    return spark.range(n).select(F.lit(0).cast("long").alias("fid"), F.lit("").alias("fnm"), F.col("id").alias("seq"), F.lit(1).alias("lnr"), F.lit("").alias("txt"))


def list_files(files: DataFrame, part: str = "") -> DataFrame:
    return files.where(F.col("fnm").contains(part)).select("fid", "fnm")


def grep(lines: DataFrame, ere: str) -> DataFrame:
    from ..functions.ere import to_java

    return lines.where(F.col("line").rlike(to_java(ere)))


def browse(lines: DataFrame, fnm: str, first: int, last: int) -> DataFrame:
    return lines.where((F.col("fnm") == fnm) & F.col("lnr").between(first, last)).orderBy("lnr")


def import_findings(tokens: DataFrame, findings: DataFrame, name: str = "json") -> MatchFrame:
    """Findings (type, message, file, line, optional place = "mode start length") as matches.

    With a place, the match is that many tokens from the start on the line; else it is the whole line.
    """
    f = findings if "place" in findings.columns else findings.withColumn("place", F.lit(None).cast("string"))
    at = F.split("place", " +")
    f = f.select("type", "message", F.col("file").alias("fnm"), F.col("line").cast("int").alias("lnr"), F.try_element_at(at, F.lit(2)).cast("int").alias("_p"), F.try_element_at(at, F.lit(3)).cast("int").alias("_n"))
    w = Window.partitionBy("fid", "lnr").orderBy("seq")
    t = tokens.withColumn("_k", F.row_number().over(w) - 1)
    hit = f.join(t.select("fid", "fnm", "lnr", "seq", "_k"), ["fnm", "lnr"]).where(F.col("_p").isNull() | F.col("_k").between(F.col("_p"), F.col("_p") + F.col("_n") - 1))
    out = hit.groupBy("fid", "lnr", "type", "message", "_p").agg(F.min("seq").alias("from_seq"), F.max("seq").alias("upto_seq"))
    return MatchFrame(out.select(F.coalesce("type", F.lit(name)).alias("set"), "fid", "from_seq", "upto_seq", F.col("lnr").alias("from_lnr"), F.col("lnr").alias("upto_lnr"), F.col("message").alias("msg")))


def read_findings(spark: SparkSession, path: str, field: str = "place") -> DataFrame:
    """Findings of a JSON file; ``field`` is what the file calls the place of a finding on its line."""
    return spark.read.schema(f"type string, message string, file string, line int, `{field}` string").option("multiLine", True).json(path).withColumnRenamed(field, "place")
