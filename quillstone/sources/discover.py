"""Files of an archive: walking roots, choosing by globs, and routing by format."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import OMISSION_ROWS

#: Suffixes of the formats, and the first bytes that outweigh them.
SUFFIXES = {".md": "markdown", ".markdown": "markdown", ".txt": "text", ".pdf": "pdf", ".xlsx": "excel", ".png": "image", ".jpeg": "image", ".jpg": "image", ".gif": "image", ".webp": "image"}
PDF, ZIP = "25504446", "504B0304"
IMAGES = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif87": "474946383761", "gif89": "474946383961"}


#: Levels of folders that the driver lists to leave out hopeless ones.
LEVELS = 2


def glob_regex(glob: str) -> str:
    """A regular expression for a whole path: `**/` any folders, `**` anything, `*` and `?` within a name."""
    wild = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(wild.get(t) or re.escape(t) for t in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob)) + "$"


def accepted(relative_path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Included by any glob (all, if there is none) and excluded by none."""
    matches = lambda globs: relative_path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))
    out = matches(include) if include else F.lit(True)
    return out & ~matches(exclude) if exclude else out


def hopeless(folder: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> bool:
    """Whether no file below a folder (a relative path) can be chosen: it is excluded with all below, or no glob can reach into it."""
    if any(g == "**" or (g.endswith("/**") and re.match(glob_regex(g.removesuffix("/**")), folder)) for g in exclude):
        return True
    return bool(include) and not any(_reaches(glob.split("/"), folder.split("/")) for glob in include)


def _reaches(glob: list[str], folder: list[str]) -> bool:
    """Whether a glob, by its parts, can match a file below the folder."""
    for k, name in enumerate(folder):
        if k < len(glob) and "**" in glob[k]:
            return True
        if k >= len(glob) - 1 or not re.match(glob_regex(glob[k]), name):
            return False
    return True


def listed(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = (), levels: int = LEVELS) -> tuple[list[str], list[str]]:
    """(paths, looked at): what of a root is worth reading, and the folders that were listed to find out.

    Paths are files of the upper levels and folders below these, each of which is listed in
    parallel by Spark's reader. A hopeless folder is never listed; works on any file system that Spark reads.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    paths, seen, level = [], [], [""]
    for depth in range(levels + 1):
        deeper = []
        for folder in level:
            seen.append(folder)
            for status in fs.listStatus(path(f"{root}/{folder}" if folder else root)):
                name = status.getPath().getName()
                relative = f"{folder}/{name}" if folder else name
                if status.isFile():
                    paths.append(status.getPath().toString())
                elif not hopeless(relative, include, exclude):
                    deeper.append((relative, status.getPath().toString()))
        if depth == levels:
            return paths + [whole for _, whole in deeper], seen
        level = [relative for relative, _ in deeper]
    return paths, seen


def author(relative_path: Column) -> Column:
    """The first folder below the root; empty for a file right in it."""
    parts = F.split(relative_path, "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise("")


def first_of_each(files: DataFrame, path: str = "abs_path", root_place: str = "root_place") -> DataFrame:
    """Each file once, under the first root that holds it; paths that differ by case are different files."""
    by = Window.partitionBy(path).orderBy(root_place)
    return files.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def check_roots(roots: Sequence[str]) -> tuple[list[str], list[tuple]]:
    """The usable roots, and an omission for each other. A root with a scheme is left to Spark's reader."""
    good, bad = [], []
    for root in roots:
        if "://" in root or (os.path.isdir(root) and os.access(root, os.R_OK | os.X_OK)):
            good.append(root)
        else:
            reason = "does not exist" if not os.path.exists(root) else "is not a folder" if not os.path.isdir(root) else "can't be read"
            bad.append(("root_unavailable", root, f"the root {reason}", None))
    return good, bad


def discover(spark: SparkSession, roots: Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(files, omissions). Files have root_id, relative_path, author, abs_path, length and content.

    Folders that the globs rule out aren't listed, and the globs hold before any content is read:
    `binaryFile` reads a file only when its row survives.
    """
    good, bad = check_roots(roots)
    parts = []
    for place, root in enumerate(good):
        base = root.rstrip("/")
        paths, _ = listed(spark, base, include, exclude)
        if not paths:
            continue
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([re.sub(r"([\\[\]{}*?])", r"\\\1", p) for p in paths])
        plain = F.regexp_replace("path", r"^[a-z]+:/*(?=/)", "") if "://" not in base else F.col("path")
        rows = found.select(plain.alias("abs_path"), "length", "content", F.lit(base).alias("root_id"), F.lit(place).alias("root_place"))
        rows = rows.withColumn("relative_path", F.expr(f"substring(abs_path, {len(base) + 2})"))
        parts.append(rows.where(accepted(F.col("relative_path"), include, exclude)))
    omissions = spark.createDataFrame(bad, OMISSION_ROWS)
    if not parts:
        empty = "abs_path string, length long, content binary, root_id string, relative_path string, author string"
        return spark.createDataFrame([], empty), omissions
    files = parts[0]
    for part in parts[1:]:
        files = files.unionByName(part)
    if len(parts) > 1:
        files = first_of_each(files)
    return files.drop("root_place").withColumn("author", author(F.col("relative_path"))), omissions


def route(path: Column, content: Column) -> Column:
    """pdf, excel, image, markdown or text, by the first bytes and then the suffix; null if neither is known."""
    head = F.hex(F.substring(content, 1, 12))
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    by_suffix = F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))[suffix]
    image = F.lit(False)
    for magic in IMAGES.values():
        image = image | F.startswith(head, F.lit(magic))
    image = image | (F.startswith(head, F.lit("52494646")) & F.endswith(head, F.lit("57454250")))
    return F.when(F.startswith(head, F.lit(PDF)), "pdf").when(F.startswith(head, F.lit(ZIP)), "excel").when(image, "image").otherwise(by_suffix)


def routed(files: DataFrame) -> DataFrame:
    return files.withColumn("route", route(F.col("path"), F.col("content")))


def unsupported(files: DataFrame) -> DataFrame:
    return files.where("route IS NULL").select(F.lit("unsupported").alias("category"), "path", F.lit("no format is known for this file").alias("reason"), F.lit(None).cast("string").alias("missing_capability"))


def omission_counts(omissions: DataFrame) -> DataFrame:
    return omissions.groupBy("category").agg(F.count("*").alias("n"))
