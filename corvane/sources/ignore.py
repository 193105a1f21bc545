"""Ignore rules of a source tree: pattern files compiled to ordered rules, as one column expression.

A rule belongs to the folder of its file and holds below it. Of the rules that match a
path the last counts, deeper folders' after outer ones'; `!` takes back. A path below
an ignored folder is ignored, whatever is said of it: folders are pruned from above.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

NAME = ".gitignore"


class Rule(NamedTuple):
    """pattern: a Java regular expression of whole paths; drops: ignored, or taken back; folders: matches folders only."""

    pattern: str
    drops: bool
    folders: bool


def _glob(text: str) -> str:
    """A glob without leading or trailing slash as a regular expression; a star stops at slashes, two between slashes do not."""
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if text.startswith("**/", i) and (i == 0 or text[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif text[i:] == "**" and (i == 0 or text[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif c == "*":
            out += "[^/]*"
            while text.startswith("*", i):
                i += 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (m := re.compile(r"\[(!|\^)?(\]?[^\]]*)\]").match(text, i)):
            inner = re.sub(r"([\\\[&])", r"\\\1", m[2]) if "\\" not in m[2] else m[2].replace("[", r"\[").replace("&", r"\&")
            out, i = out + f"(?!/)[{'^' if m[1] else ''}{inner}]", m.end()
        else:
            if c == "\\" and i + 1 < len(text):
                i += 1
                c = text[i]
            out, i = out + re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", c), i + 1
    return out


def compiled(text: str, folder: str = "") -> list[Rule]:
    """The rules of one file's text, in order; folder is where the file lies, '' for the top."""
    base = re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", folder + "/") if folder else ""
    out = []
    for line in text.split("\n"):
        line = line.rstrip("\r")
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
        if not line or line.startswith("#"):
            continue
        drops = not line.startswith("!")
        glob = line if drops else line[1:]
        folders = glob.endswith("/")
        glob = glob.rstrip("/") if folders else glob
        anchored = "/" in glob
        glob = glob.removeprefix("/")
        if glob:
            out.append(Rule(f"{base}{'' if anchored else '(?:.*/)?'}{_glob(glob)}", drops, folders))
    return out


def ignored(path: Column, rules: list[Rule]) -> Column:
    """Whether a file's path (below the top) is ignored. rules: the outer folders' first."""
    if not rules:
        return F.lit(False)

    def last(p: Column, folder: bool) -> Column:
        out = F.lit(False)
        for r in rules:  # the last one is asked first
            if folder or not r.folders:
                out = F.when(p.rlike(rf"\A(?:{r.pattern})\z"), F.lit(r.drops)).otherwise(out)
        return out

    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return ((F.size(parts) > 1) & F.exists(above, lambda p: last(p, True))) | last(path, False)


def rules_of(spark: SparkSession, root: str, name: str = NAME) -> list[Rule]:
    """The rules of all pattern files below root, outer folders' first. Their names are hidden from Spark's readers, so they are listed; a tree has few."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base, files, found = fs.makeQualified(top).toString().rstrip("/") + "/", [], fs.listFiles(top, True)
    while found.hasNext():
        path = found.next().getPath()
        if path.getName() == name:
            stream = fs.open(path)
            try:
                files.append((path.toString().removeprefix(base).rpartition("/")[0], jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
    ordered = sorted(files, key=lambda x: (x[0].count("/") + (x[0] != ""), x[0]))
    return reduce(lambda out, f: out + compiled(f[1], f[0]), ordered, [])
