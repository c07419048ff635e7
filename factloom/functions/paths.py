"""Paths, project files and repository addresses as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import pattern_of_dotted

BUILD_OUTPUT = ("bin", "obj")


def folders(path: Column) -> Column:
    """The folders of a path with `/`, outermost first, without the file."""
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def below_build_output(path: Column) -> Column:
    """Whether a folder of the path is one of build output."""
    return F.exists(folders(path), lambda x: F.lower(x).isin(*BUILD_OUTPUT))


def labelled_folder(path: Column) -> Column:
    """The outermost folder of the path that names a pattern, as struct<unit, pattern>; null if none does, or a hidden or output one comes first."""
    parts = folders(path)
    named = F.transform(parts, lambda x, i: F.struct(F.array_join(F.slice(parts, F.lit(1), i + 1), "/").alias("unit"), pattern_of_dotted(x).alias("pattern"), (F.startswith(x, F.lit(".")) | F.lower(x).isin(*BUILD_OUTPUT)).alias("skipped")))
    first = F.get(F.filter(named, lambda x: x["pattern"].isNotNull() | x["skipped"]), F.lit(0))
    return F.when(~first["skipped"], F.struct(first["unit"].alias("unit"), first["pattern"].alias("pattern")))


def _projects(paths: Column) -> Column:
    return F.filter(F.transform(paths, lambda x: F.replace(x, F.lit("\\"), F.lit("/"))), lambda x: F.endswith(F.lower(x), F.lit(".csproj")))


def sln_projects(text: Column) -> Column:
    """Project files that a solution names; other entries are folders."""
    return _projects(F.regexp_extract_all(text, F.lit(r'(?m)^Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]+)"'), F.lit(1)))


def slnx_projects(text: Column) -> Column:
    """Project files that an XML solution names, at any depth."""
    return _projects(F.regexp_extract_all(text, F.lit(r'<Project\b[^>]*?\bPath="([^"]*)"'), F.lit(1)))


def repository(address: Column, host: str = "github.com") -> Column:
    """struct<owner, name, branch, clone_url> of a repository's address; null if it is none."""
    bare = F.regexp_replace(F.trim(address), "^https?://", "")
    parts = F.filter(F.split(bare, "/"), lambda x: x != "")
    at = lambda k: F.get(parts, F.lit(k))
    name = F.regexp_replace(at(2), r"\.git$", "")
    rest = F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0)))
    plain = F.forall(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.regexp(x, F.lit(r"^[\p{L}\p{N}._-]+$")))
    ends = (F.size(rest) == 0) | ((at(3) == "tree") & (F.size(rest) >= 2))
    known = F.lower(at(0)).isin(host, f"www.{host}") & name.isNotNull() & (name != "") & plain & ends
    branch = F.when(F.size(rest) >= 2, F.array_join(F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 1, F.lit(0))), "/"))
    return F.when(known, F.struct(at(1).alias("owner"), name.alias("name"), branch.alias("branch"), F.concat(F.lit(f"https://{host}/"), at(1), F.lit("/"), name, F.lit(".git")).alias("clone_url")))
