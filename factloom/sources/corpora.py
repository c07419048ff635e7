"""Labelled corpora: example files, labelled folders, ground truth, manifests, finished reports."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import pattern_of
from ..vocab import PATTERNS
from .files import BUILD_OUTPUT, Checkout, Repository, repository, resolve

_BY_LETTERS = {re.sub(r"[^a-z]", "", p.lower()): p for p in PATTERNS}


def normalise(name: str) -> str | None:
    """The pattern that a name spells, whatever its case, separators and digits."""
    return _BY_LETTERS.get("".join(c for c in name if c.isalpha()).lower())


def normalise_dotted(name: str) -> str | None:
    return next((p for p in map(normalise, name.split(".")) if p), None)


@dataclass
class Unit:
    name: str
    files: list[str]
    expected: set[str]


@dataclass
class Units:
    units: list[Unit] = field(default_factory=list)
    skipped: int = 0
    commit: str | None = None
    query_timeout: float | None = None


def from_examples(folder: str) -> Units:
    """One unit for each file named after a pattern; others count as skipped."""
    out = Units()
    for f in resolve(folder):
        pattern = normalise_dotted(Path(f).stem)
        if pattern is None:
            out.skipped += 1
        else:
            out.units.append(Unit(Path(f).stem, [f], {pattern}))
    return out


def from_folders(folder: str) -> Units:
    """The shallowest folders named after patterns are units; folders of sources outside them count as skipped."""
    out = Units()

    def walk(at: Path) -> None:
        for child in sorted((p for p in at.iterdir() if p.is_dir()), key=lambda p: p.name.lower()):
            if child.name.startswith(".") or child.name.lower() in BUILD_OUTPUT:
                continue
            pattern = normalise_dotted(child.name)
            if pattern is not None:
                files = resolve(str(child))
                if files:
                    out.units.append(Unit(str(child.relative_to(folder)), files, {pattern}))
                continue
            if any(child.glob("*.cs")):
                out.skipped += 1
            walk(child)

    walk(Path(folder))
    return out


def from_ground_truth(path: str, root: str) -> Units:
    """Units of a label file; an unknown pattern, a missing path or a missing list fails the load, an empty list labels nothing."""
    out = Units()
    for entry in relaxed_json(Path(path).read_text(encoding="utf-8-sig"))["units"]:
        if not isinstance(entry.get("patterns"), list):
            raise ValueError(f"{path}: unit {entry.get('path')!r} has no list of patterns")
        expected = set()
        for name in entry["patterns"]:
            pattern = normalise(name)
            if pattern is None:
                raise ValueError(f"{path}: {name!r} is no known pattern")
            expected.add(pattern)
        where = os.path.join(root, entry["path"])
        if not os.path.exists(where):
            raise FileNotFoundError(f"{path}: no such unit: {entry['path']}")
        out.units.append(Unit(entry["path"], resolve(where), expected))
    return out


#: The example files that come with the package, one for each pattern.
EXAMPLES = str(Path(__file__).parent.parent / "examples")
#: Fixed value: names of public corpora, and where they are.
KNOWN = {"refactoring-guru": "https://github.com/RefactoringGuru/design-patterns-csharp"}


@dataclass
class Resolved:
    """Where a corpus lies: its name, its folder, the commit of a clone, and the clone to close."""

    name: str
    root: str
    commit: str | None = None
    checkout: Checkout | None = None

    def close(self) -> None:
        if self.checkout is not None:
            self.checkout.close()


def resolve_corpus(source: str | None, base: str = ".", clone: Callable[[Repository], Checkout] = Checkout) -> Resolved:
    """A corpus by `examples` (or nothing), a known name, a repository's address, or a folder (found from base)."""
    if source is None or source.lower() == "examples":
        return Resolved("examples", EXAMPLES)
    address = KNOWN.get(source.lower(), source)
    named = repository(address)
    if named is not None:
        made = clone(named)
        return Resolved(named.slug, made.path, made.commit(), made)
    folder = Path(base, source)
    if not folder.is_dir():
        raise FileNotFoundError(f"{source!r} is no folder, repository address or known corpus name")
    return Resolved(source, str(folder.resolve()))


def units_of(root: str, ground_truth: str | None = None) -> Units:
    """The units of a corpus: those of its labels, else of folders named after patterns, else of such files."""
    if ground_truth:
        return from_ground_truth(ground_truth, root)
    found = from_folders(root)
    return found if found.units else from_examples(root)


@dataclass
class Corpus:
    name: str
    source: str
    ground_truth: str | None = None
    query_timeout: float | None = None


def relaxed_json(text: str):
    """JSON that may have comments and trailing commas."""
    kept = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    kept = re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[\]}])', lambda m: m[1] or "", kept, flags=re.S)
    return json.loads(kept)


def manifest(path: str) -> list[Corpus]:
    """Corpora of a manifest; label files are found beside it."""
    base = Path(path).parent
    out = []
    for c in relaxed_json(Path(path).read_text(encoding="utf-8-sig"))["corpora"]:
        truth = c.get("groundTruth")
        out.append(Corpus(c["name"], c["source"], str(base / truth) if truth else None, c.get("queryTimeout")))
    return out


def load_report(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def units_of_report(report: dict) -> list[dict]:
    """The unit outcomes of a report, or of all its corpora."""
    if report.get("corpora"):
        return [u for c in report["corpora"] for u in c.get("units") or []]
    return report.get("units") or []


def load_cache(path: str) -> dict[str, dict]:
    """Verdicts by key; a missing or damaged file is an empty cache."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
        return {k: v for k, v in found.items() if isinstance(v, dict) and v.get("outcome")}
    except (OSError, ValueError, AttributeError):
        return {}


def save_cache(path: str, entries: dict[str, dict]) -> bool:
    """Whether the cache could be written; a run doesn't fail for it."""
    try:
        Path(path).write_text(json.dumps(dict(sorted(entries.items())), indent=2), encoding="utf-8")
        return True
    except OSError:
        return False


# The same files as columns, for tables that have one in each row


def strict_json(text: Column) -> Column:
    """JSON without comments and trailing commas outside strings."""
    string = r'("(?:[^"\\]|\\.)*")'
    bare = F.regexp_replace(text, F.lit(string + r"|//[^\n]*|/\*(?s:.*?)\*/"), F.lit("$1"))
    return F.regexp_replace(bare, F.lit(string + r"|,(?=\s*[\]}])"), F.lit("$1"))


def labels(files: DataFrame) -> DataFrame:
    """(corpus, unit, pattern) of label files (corpus, text); pattern is null for a unit that labels nothing.

    An unknown pattern or a missing list is an error.
    """
    parsed = F.from_json(strict_json(F.col("text")), "units array<struct<path:string,patterns:array<string>>>")
    units = files.select("corpus", F.explode(parsed["units"]).alias("u"))
    units = units.select("corpus", F.col("u.path").alias("unit"), F.coalesce("u.patterns", F.raise_error(F.concat(F.lit("no list of patterns: "), F.coalesce("u.path", F.lit("?")))).cast("array<string>")).alias("spelled"))
    named = units.select("corpus", "unit", F.explode_outer("spelled").alias("name"))
    known = F.coalesce(pattern_of(F.col("name")), F.raise_error(F.concat(F.lit("no known pattern: "), F.col("name"))).cast("string"))
    return named.select("corpus", "unit", F.when(F.col("name").isNotNull(), known).alias("pattern"))


def report_units(files: DataFrame, *keep: str) -> DataFrame:
    """`keep` and (unit, labeled, structural, detected) of reports (text), or of all their corpora."""
    units = "array<struct<unit:string,labeled:array<string>,structural:array<string>,detected:array<string>>>"
    read = F.from_json("text", f"units {units}, corpora array<struct<units:{units}>>")
    every = F.coalesce(F.flatten(F.transform(read["corpora"], lambda c: F.coalesce(c["units"], F.array().cast(units)))), read["units"])
    return files.select(*keep, F.explode(every).alias("u")).select(*keep, "u.*")


def cache_entries(files: DataFrame, *keep: str) -> DataFrame:
    """`keep` and (key, outcome, rationale, model) of cache files (text); what is damaged or has no outcome is left out."""
    entries = F.from_json("text", "map<string,struct<outcome:string,rationale:string,model:string>>", {"mode": "PERMISSIVE"})
    return files.select(*keep, F.explode(entries).alias("key", "v")).where("v.outcome is not null").select(*keep, "key", "v.*")
