"""Path and source-file predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Endings of files that tools generate.
GENERATED_SUFFIXES = (
    ".pb.kt", "_pb.kt", "_grpc.kt", "_grpc_pb.kt", "grpc.kt", ".generated.kt", ".gen.kt", "_mock.kt", "_mocks.kt", "outerclass.java", "grpc.java", ".g.java",
)
HEAD_BYTES, HEAD_LINES = 8192, 60


def language(path: Column) -> Column:
    return F.when(path.endswith(".java"), "java").when(path.endswith(".swift"), "swift").otherwise("kotlin")


def relative(path: Column, root: str) -> Column:
    return F.regexp_replace(path, "^" + re.escape(root.rstrip("/")) + "/", "")


def source_set(path: Column) -> Column:
    """The segment after the last src; null without one."""
    found = F.regexp_extract(path, r"^(?:.*/)?src/([^/]+)/", 1)
    return F.nullif(found, F.lit(""))


def module(path: Column, root: str) -> Column:
    """The segments between the root and the last src; null at the root."""
    return F.nullif(F.regexp_extract(relative(path, root), r"^(.+)/src/", 1), F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def generated_path(path: Column) -> Column:
    ends = [F.lower(path).endswith(s) for s in GENERATED_SUFFIXES]
    out = ends[0]
    for e in ends[1:]:
        out = out | e
    return out


def generated_header(text: Column) -> Column:
    """Whether a comment line at the head of the text carries a generator's banner."""
    lines = F.slice(F.split(F.left(text, F.lit(HEAD_BYTES)), "\n"), 1, HEAD_LINES)

    def banner(line):
        low = F.lower(line)
        edit = low.contains("do not edit")
        kept = edit | low.contains("do not modify") | low.contains("do not change")
        made = low.contains("auto-generated") | low.contains("autogenerated") | low.contains("generated by")
        said = (low.contains("code generated") & edit) | (made & kept) | low.contains("this file was generated") | low.contains("this file is generated")
        return line.rlike(r"^\s*(//|/\*|\*)") & said

    return F.coalesce(F.exists(lines, banner), F.lit(False))


def generated(path: Column, text: Column) -> Column:
    return generated_path(path) | generated_header(text)


def entry_point(name: Column, kind: Column) -> Column:
    return (kind == "class") & name.rlike("(Activity|Fragment|Application)$")


#: Kinds by the short names that filters take.
KIND_ALIASES = {"fun": "function", "val": "property", "var": "property", "iface": "interface"}


def kind(name: Column) -> Column:
    low = F.lower(name)
    out = low
    for short, full in KIND_ALIASES.items():
        out = F.when(low == short, full).otherwise(out)
    return out


def stdlib_package(path: Column) -> Column:
    """Whether an import belongs to a platform library, by its first segment."""
    return F.substring_index(path, ".", 1).isin("java", "javax", "kotlin", "kotlinx", "android", "androidx", "dalvik", "sun") | path.startswith("com.sun.")


def glob_pattern(glob: str) -> str:
    """A regular expression for an ignore glob: ** crosses folders, * and ? don't."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return f"^{out}$"


def ignored(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_pattern(g))
    return out
