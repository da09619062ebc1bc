"""Answer and label text as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a negative answer, the mark of a timeout, four numbers in
#: parentheses with an optional letter before each, and what is no part of a class name.
NEGATIONS = r"\bno\b|\bnot\b|\bcannot\b|\bdon't\b|\bdoesn't\b"
TIMEOUT = "TIMEOUT"
NUMBER = r"\s*[a-zA-Z]?\s*(\d+\.?\d*)\s*"
BOX = r"\(" + ",".join([NUMBER] * 4) + r"\)"
TAG, ASIDE, TAIL, GAP = r"<[^>]+>", r"\([^)]*\)", r"[\s:,>]+$", r"[ -]"


def trimmed(c: Column) -> Column:
    """c without ASCII white space at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def yes_or_no(response: Column) -> Column:
    """no if the first sentence has a negation, else yes, also for an empty answer."""
    first = F.lower(F.split(trimmed(response), r"[.!?\n]")[0])
    return F.when(first.rlike(NEGATIONS), F.lit("no")).otherwise(F.lit("yes"))


def predicted(response: Column) -> Column:
    return F.when(trimmed(response) == TIMEOUT, F.lit("timeout")).otherwise(yes_or_no(response))


def strict_answer(response: Column) -> Column:
    """The answer lowered, trimmed and without dots behind; null unless that is yes or no."""
    bare = F.regexp_replace(F.lower(trimmed(response)), r"\.+$", "")
    return F.when(bare.isin("yes", "no"), bare)


def class_words(between: Column) -> Column:
    """What may name a class in the text between two boxes: no tags, parentheses or marks behind; lowered, with underscores."""
    bare = F.regexp_replace(F.regexp_replace(between, TAG, ""), ASIDE, "")
    bare = trimmed(F.regexp_replace(bare, TAIL, ""))
    return F.when(bare != "", F.regexp_replace(F.lower(bare), GAP, "_"))


def matched_class(raw: Column, classes: list[str]) -> Column:
    """The class equal to raw, else the longest one that contains it or is contained; null if none."""
    by_length = F.lit(sorted(classes, key=len, reverse=True))
    near = F.filter(by_length, lambda c: raw.contains(c) | c.contains(raw))
    return F.when(raw.isin(classes), raw).otherwise(F.when(F.size(near) > 0, near[0]))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def split_of(path: Column) -> Column:
    """train, val or test from a path of the layout .../split/images/name."""
    return F.regexp_extract(path, r"(?:^|/)(train|val|test)/(?:images|labels)/[^/]*$", 1)


def unique_name(path: Column) -> Column:
    """A flat name of a path: folders joined by two underscores, without extension."""
    return F.regexp_replace(F.regexp_replace(path, r"[/\\]", "__"), r"\.[^.]*$", "")


def lighting(prompt: Column, key: Column, presets: dict[str, str], default: str, mark: str = "[LIGHTING]") -> Column:
    """prompt with its mark replaced by the preset of key, or of the default if there is none."""
    table = F.create_map(*[F.lit(x) for pair in presets.items() for x in pair])
    return F.replace(prompt, F.lit(mark), F.coalesce(table[key], F.lit(presets[default])))


def question(prompt: Column, name: Column, template: str = "Is there any %s in this image?") -> Column:
    return F.coalesce(prompt, F.format_string(template, name))


def shortened(response: Column, n: int = 300) -> Column:
    return F.substring(trimmed(response), 1, n)


def duration(seconds: Column) -> Column:
    """Whole seconds as text in the two units from the largest that is not 0."""
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%dh%02dm", h, m)).when(m > 0, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", r))


def label_line(class_id: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id, cx, cy, w, h)


def hash_order(seed: int, *key: Column) -> Column:
    """A reproducible random order: md5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]).cast("binary"))


def harmonic(p: Column, r: Column) -> Column:
    """F1 of precision and recall, 0 if both are 0."""
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
