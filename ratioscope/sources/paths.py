"""Files of a path template: ``{field}`` names a path part, strftime codes match digits, ``*`` and ``?`` are globs."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..config.manifest import PLACEHOLDER

_DIGITS = {"Y": 4, "m": 2, "d": 2, "H": 2, "M": 2, "S": 2, "j": 3, "y": 2}
_TOKEN = re.compile(r"\{([A-Za-z_]\w*)\}|%([A-Za-z%])|(\*\*|\*|\?)|([^{%*?]+|.)")
_REVISION = re.compile(r"^(?P<data>[^_]+)_(?P<place>[^_]+)_(?P<date>\d{8}(?:\d{2,6})?)(?:_R(?P<rev>\w+?))?(?:_[^.]*)?\.[^.]+$", re.I)


def template_regex(template: str) -> str:
    """Pattern of a relative path; each field is a group, which later mentions must repeat."""
    out, seen = "", set()
    for m in _TOKEN.finditer(template):
        field, code, glob, rest = m.groups()
        if field:
            out += f"(?P={field})" if field in seen else f"(?P<{field}>[^/]+?)"
            seen.add(field)
        elif code:
            out += "%" if code == "%" else rf"\d{{{_DIGITS[code]}}}" if code in _DIGITS else r"[^/]+?"
        elif glob:
            out += {"*": "[^/]*", "?": "[^/]", "**": ".*"}[glob]
        else:
            out += re.escape(rest)
    return out + "$"


def template_glob(template: str) -> str:
    """A glob that every path of the template matches."""
    return re.sub(r"\*{2,}", "*", PLACEHOLDER.sub("*", re.sub(r"%[A-Za-z]", "*", template)))


def path_field(path: Column, templates: tuple[str, ...], field: str, fixed: dict[str, str] | None = None) -> Column:
    """A template field's value in a path, by the first template that has it and fits; ``fixed`` fields are what they are said to be."""
    if fixed and field in fixed:
        return F.lit(fixed[field])
    hit = F.lit(None).cast("string")
    for t in reversed(templates):
        if "{" + field + "}" in t:
            order = list(dict.fromkeys(PLACEHOLDER.findall(t)))
            plain = re.sub(r"\(\?P=(\w+)\)", lambda m, o=order: rf"\{o.index(m[1]) + 1}", template_regex(t))
            hit = F.coalesce(F.nullif(F.regexp_extract(path, re.sub(r"\(\?P<\w+>", "(", plain), order.index(field) + 1), F.lit("")), hit)
    return hit


def crawl(spark: SparkSession, base: str, templates: tuple[str, ...], fixed: dict[str, str] | None = None) -> list[tuple[str, dict[str, str]]]:
    """(path, fields) of all files of all templates, each once, in path order; the first template that fits names the fields.

    Listing goes through Hadoop's file systems, so any store that Spark reads can be crawled.  ``fixed`` fields must match.
    """
    fixed = fixed or {}
    jvm = spark._jvm
    found: dict[str, dict[str, str]] = {}
    for t in templates:
        for k, v in fixed.items():
            t = t.replace("{" + k + "}", v)
        glob = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{template_glob(t)}")
        pattern = re.compile("(?:^|/)" + template_regex(t))
        for s in glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or []:
            p = s.getPath().toString()
            m = pattern.search(p)
            if s.isFile() and m:
                found.setdefault(p, {**m.groupdict(), **fixed})
    return sorted(found.items())


def latest_revisions(paths: list[str]) -> list[str]:
    """Of ``dataID_locationID_date[_R#].ext`` files the highest revision of each; other names are all kept.

    Numbered revisions rank over lettered (preliminary) ones, those over none.
    """
    best: dict[tuple, tuple] = {}
    keep = []
    for p in paths:
        m = _REVISION.match(p.rsplit("/", 1)[-1])
        if not m:
            keep.append(p)
            continue
        rev = m["rev"]
        rank = (0, 0, "") if rev is None else (2, int(rev), "") if rev.isdigit() else (1, 0, rev.upper())
        key = (m["data"].lower(), m["place"].lower(), m["date"])
        if key not in best or (rank, p) > best[key]:
            best[key] = (rank, p)
    return sorted(keep + [p for _, p in best.values()])
