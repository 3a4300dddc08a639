"""Project settings, validated on the driver, and C build contexts as a table."""

from __future__ import annotations

import json
import shlex
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import EXTENSIONS, glob_regex


@dataclass
class SyncSettings:
    max_file_kb: int = 512
    languages: list[str] = field(default_factory=list)


@dataclass
class GraphSettings:
    min_confidence: float = 0.3
    include_external: bool = False
    max_nodes: int = 4000
    depth: int = 2
    kinds: list[str] = field(default_factory=lambda: ["imports", "calls", "contains", "implements"])


@dataclass
class ScopeSettings:
    categories: dict[str, list[str]] = field(default_factory=dict)


@dataclass
class Project:
    """Settings that this engine uses are checked; those of exact tools, models and stores are kept as they are."""

    schema_version: int = 1
    sync: SyncSettings = field(default_factory=SyncSettings)
    graph: GraphSettings = field(default_factory=GraphSettings)
    scope: ScopeSettings = field(default_factory=ScopeSettings)
    storage: dict = field(default_factory=dict)
    precise: dict = field(default_factory=dict)
    c_family: dict = field(default_factory=dict)
    embeddings: dict = field(default_factory=dict)
    search: dict = field(default_factory=dict)


#: Short names of languages.
ALIASES = {"js": "javascript", "ts": "typescript", "py": "python", "kt": "kotlin"}


def _read(kind, values: dict, where: str = ""):
    """An instance of a settings class; unknown names and wrong types are refused."""
    made = kind()
    known = {f.name for f in fields(kind)}
    for name, value in values.items():
        if name not in known:
            raise ValueError(f"unknown setting {where}{name}")
        default = getattr(made, name)
        if is_dataclass(default) and isinstance(value, dict):
            value = _read(type(default), value, f"{where}{name}.")
        number = isinstance(default, float) and isinstance(value, int)
        if isinstance(value, bool) != isinstance(default, bool) or not (number or isinstance(value, type(default))):
            raise ValueError(f"setting {where}{name} has the wrong type")
        setattr(made, name, value)
    return made


def read_project(text: str) -> Project:
    """Settings of a project's TOML file, checked as a whole."""
    p = _read(Project, tomllib.loads(text))
    if not 0 <= p.graph.min_confidence <= 1:
        raise ValueError("graph.min_confidence lies outside of 0 to 1")
    if p.sync.max_file_kb < 1:
        raise ValueError("sync.max_file_kb is less than 1")
    p.sync.languages = [ALIASES.get(x, x) for x in p.sync.languages]
    if unknown := set(p.sync.languages) - set(EXTENSIONS):
        raise ValueError(f"sync.languages has unknown ones: {sorted(unknown)}")
    for name, globs in p.scope.categories.items():
        if not name.strip() or not globs or not all(isinstance(g, str) for g in globs):
            raise ValueError("categories need names and globs")
    return p


def in_categories(path: Column, project: Project, names: list[str]) -> Column:
    """Whether any glob of the named categories fits a path."""
    globs = [g for n in names for g in project.scope.categories[n]]
    return path.rlike("|".join(glob_regex(g, crosses=False) for g in globs)) if globs else F.lit(False)


def build_context(spark: SparkSession, compile_commands: str) -> DataFrame:
    """file, language, include_paths of each entry of a compilation database."""
    rows = []
    for entry in json.loads(compile_commands):
        args = entry.get("arguments") or shlex.split(entry.get("command", ""))
        includes, i = [], 0
        while i < len(args):
            for flag in ("-I", "-isystem", "-iquote"):
                if args[i] == flag and i + 1 < len(args):
                    includes.append(args[i + 1])
                    break
                if args[i].startswith(flag) and len(args[i]) > len(flag):
                    includes.append(args[i][len(flag) :])
                    break
            i += 1
        cpp = any(a in ("-xc++", "c++") or a.startswith("-std=c++") or a.startswith("-std=gnu++") for a in args) or entry["file"].endswith((".cc", ".cpp", ".cxx", ".C"))
        rows.append((entry["file"], "cpp" if cpp else "c", includes))
    return spark.createDataFrame(rows, "file string, language string, include_paths array<string>")
