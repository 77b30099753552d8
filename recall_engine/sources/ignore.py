"""Ignore files: their patterns as Column expressions over relative paths."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Folders that are never scanned.
IGNORED = [".git", "node_modules", "dist", "build", "out"]


@dataclass(frozen=True)
class Rule:
    """A pattern as a regex over a whole relative path; ``keep`` takes a path
    back in; ``folders`` says that it is meant for folders alone."""

    regex: str
    keep: bool = False
    folders: bool = False


def rule_of(line: str) -> Rule | None:
    """The rule of a line of an ignore file; None for blank lines and comments.

    A pattern with a slash at its start or within is anchored at the root, others
    hold at any depth; ``*`` and ``?`` stay within a name, ``**`` doesn't."""
    text = re.sub(r"(?<!\\)[ \t]+$", "", line.rstrip("\r\n"))
    if not text or text.startswith("#"):
        return None
    keep = text.startswith("!")
    text = text[1:] if keep else text
    folders = text.endswith("/")
    text = text.rstrip("/")
    anchored = "/" in text
    text = text.removeprefix("/")
    if not text:
        return None
    out, at = [] if anchored else ["(?:.*/)?"], 0
    while at < len(text):
        if text.startswith("**/", at) and (at == 0 or text[at - 1] == "/"):
            out.append("(?:.*/)?")
            at += 3
        elif text.startswith("**", at):
            out.append(".*")
            at += 2
        elif text[at] == "*":
            out.append("[^/]*")
            at += 1
        elif text[at] == "?":
            out.append("[^/]")
            at += 1
        elif text[at] == "[" and (end := text.find("]", at + 2)) > 0:
            inner = text[at + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            at = end + 1
        else:
            if text[at] == "\\" and at + 1 < len(text):
                at += 1
            out.append(re.escape(text[at]))
            at += 1
    return Rule("^" + "".join(out) + "$", keep, folders)


def rules_of(text: str) -> list[Rule]:
    return [rule for line in text.split("\n") if (rule := rule_of(line))]


def file_system(spark: SparkSession, path: str):
    """(file system, path) for calls on single files; local ones without the
    checksum files that editors don't keep up to date."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return (files.getRaw() if files.getScheme() == "file" else files), place


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of one small file of any file system; None if there is none."""
    files, place = file_system(spark, path)
    if not files.exists(place) or files.getFileStatus(place).isDirectory():
        return None
    # Spark's own sources leave out files whose names begin with a dot
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def load_rules(spark: SparkSession, root: str, own: str | None = None) -> list[Rule]:
    """The built-in folders, ``own`` (the name of the folder that the index lies
    in, so that it isn't indexed itself), the root's .gitignore, and the .memoryignore of the
    root or else of the nearest folder above it that has one."""
    rules = [rule_of(f"{name}/") for name in [*IGNORED, *([own] if own else [])]]
    rules += rules_of(read_text(spark, f"{root.rstrip('/')}/.gitignore") or "")
    above = root.rstrip("/")
    while above and not above.endswith((":", ":/")):
        found = read_text(spark, f"{above}/.memoryignore")
        if found is not None:
            return rules + rules_of(found)
        above = above.rpartition("/")[0]
    return rules


def ignored(path: Column, rules: list[Rule], folder: bool = False) -> Column:
    """Whether a path (relative, with slashes; a folder's with ``folder``) or a
    folder that holds it is ignored.  Of the rules that match, the last one decides; nothing within an
    ignored folder comes back."""
    parts = F.split(path, "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("path"), (F.lit(folder) | (k < F.size(parts))).alias("folder")))

    def verdict(head: Column) -> Column:
        out = F.lit(False)
        for rule in rules:
            hit = head["path"].rlike(rule.regex)
            out = F.when(hit & head["folder"] if rule.folders else hit, F.lit(not rule.keep)).otherwise(out)
        return out

    return F.exists(heads, verdict)
