"""Path filters: patterns become anchored regular expressions on the driver, so that filters run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tidy(pattern: str) -> str:
    pattern = pattern.replace("\\", "/")
    while pattern.startswith("./"):
        pattern = pattern[2:]
    return pattern.strip("/")


def _segment(glob: str) -> str:
    """One segment's glob: * and ? stay within the segment, [..] is a set of characters and [!..] its complement."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif close > 0:
            body = glob[i + 1: close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&").replace("^", "\\^")
            out += "[" + ("^/" + body[1:] if body[0] == "!" else body) + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return out


def pattern_regex(pattern: str) -> str:
    """A plain pattern stands for the path and all below it; in a glob, ``**`` is any number of segments and each segment matches one."""
    pattern = _tidy(pattern)
    if not any(c in pattern for c in "*?["):
        return rf"\A{re.escape(pattern)}(?:/.*)?\z" if pattern else r"\A\z"
    parts = pattern.split("/")
    out = ""
    for i, part in enumerate(parts):
        if part == "**":
            out += r"(?:/[^/]+)*" if i else r"(?:[^/]+/)*" if len(parts) > 1 else r"(?:[^/]+(?:/[^/]+)*)?"
        else:
            out += ("" if i == 0 or (i == 1 and parts[0] == "**") else "/") + _segment(part)
    return rf"\A{out}\z"


def path_matches(path: Column, pattern: str) -> Column:
    tidy = F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), r"^(?:\./)+", ""), r"^/+|/+$", "")
    return tidy.rlike(pattern_regex(pattern))


def kept(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Whether any pattern to include matches (or there is none) and none to exclude does."""
    wanted, unwanted = F.lit(not include), F.lit(False)
    for p in include:
        wanted = wanted | path_matches(path, p)
    for p in exclude:
        unwanted = unwanted | path_matches(path, p)
    return wanted & ~unwanted
