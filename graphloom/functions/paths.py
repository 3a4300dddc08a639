"""Paths, languages and globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions of each language group. An upper-case .C is C++.
EXTENSIONS = {
    "rust": "rs",
    "c": "c h",
    "cpp": "cc cpp cxx c++ hpp hh hxx h++ ipp tpp ixx cppm",
    "javascript": "js mjs cjs jsx",
    "typescript": "ts mts cts tsx",
    "python": "py pyi",
    "java": "java",
    "kotlin": "kt kts",
    "vue": "vue",
    "svelte": "svelte",
    "go": "go",
    "toml": "toml",
}
# Languages that may refer to each other's symbols.
FAMILIES = (("c", "cpp"), ("javascript", "typescript", "vue", "svelte"), ("java", "kotlin"))
# Directories that are never walked, and files whose content is never read.
IGNORED_DIRECTORIES = "node_modules vendor .git .svn .hg .cache dist .gradle .dart_tool build .cxx .idea .vscode Pods .symlinks target".split()
IGNORED_CONTENT_NAMES = "Cargo.lock package-lock.json pnpm-lock.yaml yarn.lock bun.lockb poetry.lock composer.lock go.sum .DS_Store Thumbs.db LICENSE".split()
IGNORED_CONTENT_EXTENSIONS = """png jpg jpeg gif webp ico svg woff woff2 ttf otf pdf zip tar gz map sqlite db bin exe dll so dylib
key pem crt cer lock md""".split()
MINIFIED_ENDINGS = ".min.js .min.css .min.ts .min.bundles.js .chunk.js .d.ts.map".split()


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; empty for names without one or that only begin with one."""
    return F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]*$", "$1")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def module_root(path: Column) -> Column:
    """First segment of the directory; empty for a file at the top."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit(""))


def language_of(path: Column) -> Column:
    """Language group by extension, null if none is known."""
    known = F.create_map(*[F.lit(x) for group, some in EXTENSIONS.items() for e in some.split() for x in (e, group)])
    return F.when(extension(path) == "C", F.lit("cpp")).otherwise(F.try_element_at(known, F.lower(extension(path))))


def family_of(language: Column) -> Column:
    """Equal for languages that may refer to each other."""
    known = F.create_map(*[F.lit(x) for group in FAMILIES for member in group for x in (member, group[0])])
    return F.coalesce(F.try_element_at(known, language), language)


def glob_regex(glob: str, *, crosses: bool) -> str:
    """An anchored pattern for a glob. crosses: whether * and ? match a slash (the graph's rule) or not (the scope's)."""
    any_one = "." if crosses else "[^/]"
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append(f"{any_one}*")
            i += 1
        elif glob[i] == "?":
            out.append(any_one)
            i += 1
        elif glob[i] == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out.append("(?:" + "|".join(glob_regex(x, crosses=crosses)[1:-1] for x in glob[i + 1 : end].split(",")) + ")")
            i = end + 1
        else:
            out.append(re.escape(glob[i]))
            i += 1
    return "^" + "".join(out) + "$"


def in_scope(path: Column, include: list[str] | None = None, exclude: list[str] | None = None, languages: list[str] | None = None) -> Column:
    """Scope selection: language, any include glob, no exclude glob. Here * does not cross a slash."""
    ok = F.lit(True)
    if languages:
        ok &= F.coalesce(language_of(path).isin(languages), F.lit(False))
    if include:
        ok &= path.rlike("|".join(glob_regex(g, crosses=False) for g in include))
    if exclude:
        ok &= ~path.rlike("|".join(glob_regex(g, crosses=False) for g in exclude))
    return ok


def walkable(path: Column) -> Column:
    """Whether a walk from the root would reach the file: no hidden part and no ignored directory."""
    ignored = "|".join(re.escape(d) for d in IGNORED_DIRECTORIES)
    return ~path.rlike(r"(^|/)\.[^/]") & ~path.rlike(f"(^|/)(?:{ignored})/")


def has_content(path: Column) -> Column:
    """Whether a context bundle shows the file's content."""
    endings = "|".join(re.escape(e) for e in MINIFIED_ENDINGS)
    return ~basename(path).isin(IGNORED_CONTENT_NAMES) & ~F.lower(extension(path)).isin(IGNORED_CONTENT_EXTENSIONS) & ~path.rlike(f"(?:{endings})$")
