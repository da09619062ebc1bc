"""Label sets, images and class tables from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, split_of, stem
from .label_tree import read_label_tree

#: Fixed sets of image extensions that tools of the field accept.
EXTENSIONS = {
    "basic": (".jpg", ".jpeg", ".png"),
    "all": (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff"),
    "web": (".jpg", ".jpeg", ".png", ".bmp", ".webp"),
}


def label_lines(files: DataFrame) -> DataFrame:
    """(split, stem, line_no, line): a row for each line of each file."""
    lines = files.select("split", "stem", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "line"))
    return lines.where(F.col("line") != "")


def split_label_files(spark: SparkSession, root: str) -> DataFrame:
    """(split, stem, content) of the layout root/{train,val,test}/labels/*.txt."""
    return read_label_tree(spark, root, "split")


def flat_label_files(spark: SparkSession, root: str) -> DataFrame:
    """(split, stem, content) of the label files beside the images of one folder; split is null."""
    return read_label_tree(spark, root, "flat")


def images(spark: SparkSession, path: str, *, extensions: tuple[str, ...] = EXTENSIONS["basic"], recursive: bool = True, without: str | None = None) -> DataFrame:
    """(path, split, stem, file_name, length) of image files, contents unread; names that hold `without` go."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length")
    found = found.where(extension(F.col("path")).isin(list(extensions)))
    found = found.select("path", split_of(F.col("path")).alias("split"), stem(F.col("path")).alias("stem"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")
    return found if without is None else found.where(~F.col("stem").contains(without))


def pooled(**splits: DataFrame) -> DataFrame:
    """The rows of several splits in one table, with the column split from their names."""
    out = None
    for name, rows in splits.items():
        part = rows.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no splits")
    return out


def has_split_layout(inventory: DataFrame) -> bool:
    """Whether any image lies in {train,val,test}/images."""
    return not inventory.where(F.col("path").rlike(r"/(train|val|test)/images/[^/]+$")).isEmpty()


def labelled_images(inventory: DataFrame, files: DataFrame) -> DataFrame:
    """Images with label_exists and content, by split and stem."""
    f = files.select("split", "stem", "content", F.lit(True).alias("label_exists"))
    return inventory.join(f, ["split", "stem"], "left").na.fill({"label_exists": False})


def class_table(spark: SparkSession, names: list[str] | dict[int, str]) -> DataFrame:
    """(class_id, name) from a list or an id-to-name dict."""
    pairs = sorted(names.items()) if isinstance(names, dict) else list(enumerate(names))
    return spark.createDataFrame([(int(i), n) for i, n in pairs], "class_id int, name string")


def read_class_names(text: str) -> list[str] | dict[int, str]:
    """The names of a small YAML document: `names: [a, b]`, a list below names, or id: name pairs below it."""
    import re

    body = text.split("names:", 1)[1] if "names:" in text else ""
    inline = re.match(r"\s*\[(.*?)\]", body, re.S)
    if inline:
        return [x.strip().strip("'\"") for x in inline[1].split(",") if x.strip()]
    pairs: dict[int, str] = {}
    items: list[str] = []
    for line in body.splitlines()[1:]:
        if m := re.match(r"\s*-\s*(.+)$", line):
            items.append(m[1].strip().strip("'\""))
        elif m := re.match(r"\s+(\d+)\s*:\s*(.+)$", line):
            pairs[int(m[1])] = m[2].strip().strip("'\"")
        elif line.strip() and not line.startswith((" ", "\t")):
            break
    return pairs or items
