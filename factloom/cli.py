"""Command line: scan sources, ask a query, evaluate corpora, analyse a report."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def _positive(kind):
    def check(text: str):
        try:
            value = kind(text)
        except ValueError:
            value = 0
        if value <= 0:
            raise argparse.ArgumentTypeError(f"needs a positive number, got {text!r}")
        return value

    return check


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan", help="find collaborations in source files, projects, solutions, folders or repositories")
    s.add_argument("inputs", nargs="*", help="none: the examples of the package")
    for name in ("report", "sarif", "findings", "turtle", "query"):
        s.add_argument(f"--{name}")
    s.add_argument("--namespace", action="append", default=[], help="a namespace whose terms name the graph's nodes and predicates in --query")
    _review(s)
    e = sub.add_parser("evaluate", help="score scans against labels")
    e.add_argument("corpus", nargs="?", help="a folder, a repository's address, a known name, or examples (the default)")
    for name in ("corpora", "ground-truth", "baseline", "report", "analyze"):
        e.add_argument(f"--{name}")
    e.add_argument("--query-timeout", type=_positive(float))
    _review(e)
    return p


def _review(p: argparse.ArgumentParser) -> None:
    p.add_argument("--verify", action="store_true")
    p.add_argument("--verify-model")
    p.add_argument("--verify-cache")
    p.add_argument("--keep-rejected", action="store_true")
    p.add_argument("--verify-max-tokens", type=_positive(int))
    p.add_argument("--verify-parallelism", type=_positive(int))


def parse(argv: list[str]) -> argparse.Namespace:
    """Arguments, with the exclusions checked; any review option turns review on."""
    p = parser()
    a = p.parse_args(argv)
    a.verify = bool(a.verify or a.verify_model or a.verify_cache or a.keep_rejected or a.verify_max_tokens or a.verify_parallelism)
    if a.command == "scan" and a.query and (a.report or a.sarif or a.findings or a.verify):
        p.error("--query answers one question, so it cannot be combined with reports or review")
    if a.command == "evaluate":
        if a.analyze and (a.corpus or a.corpora or a.ground_truth or a.verify):
            p.error("--analyze reads a finished report, so it cannot be combined with a corpus or review")
        if a.corpora and (a.corpus or a.ground_truth):
            p.error("--corpora takes corpora and labels from the manifest")
        if a.ground_truth and not a.corpus:
            p.error("--ground-truth labels a corpus, so name one")
    return a


def _how(a):
    """The review that the options ask for, or None."""
    if not a.verify:
        return None
    from .operators.models import PROVIDERS
    from .operators.review import PARALLEL, Review, create_model

    if not a.verify_model:
        raise ValueError(f"a review needs --verify-model; known prefixes: {', '.join(sorted(PROVIDERS))}")
    return Review(create_model(a.verify_model, a.verify_max_tokens), a.verify_cache, a.keep_rejected, a.verify_parallelism or PARALLEL)


def main(argv: list[str] | None = None) -> int:
    a = parse(sys.argv[1:] if argv is None else argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("factloom").getOrCreate()
    try:
        return scan_command(spark, a) if a.command == "scan" else evaluate_command(spark, a)
    except (ValueError, OSError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 1


def scan_command(spark, a) -> int:
    from . import api
    from .sinks import findings, reports, sarif, turtle
    from .sources.corpora import EXAMPLES
    from .sources.files import Checkout, repository, resolve_all
    from .sparql import query

    how = _how(a)
    clones = [Checkout(r) for i in a.inputs if (r := repository(i))]
    try:
        named = [i for i in a.inputs if not repository(i)] + [c.path for c in clones]
        files = resolve_all(named or [EXAMPLES])
        if a.query:
            from .csharp.extract import extract, facts_of
            from .facts import Facts
            from .sources.files import read_files

            facts = Facts(facts_of(extract(read_files(spark, {"scan": files}))))
            print(reports.query_text(query(facts, Path(a.query).read_text(encoding="utf-8"), tuple(a.namespace))))
        else:
            facts, rows, report = api.scan_files(spark, files, how, named[0] if len(named) == 1 else "")
            print(reports.console(report))
            if a.report:
                Path(a.report).write_text(json.dumps(report, indent=2), encoding="utf-8")
            if a.sarif:
                found = [r.result for r in sarif.results(rows).orderBy("pattern", "match_id").toLocalIterator()]
                Path(a.sarif).write_text(sarif.envelope(found, reports.TOOL, reports.VERSION), encoding="utf-8")
            if a.findings:
                counts = spark.createDataFrame([("scan", len(files))], "unit string, file_count int")
                blocks = findings.turtle(findings.scan_triples(rows, f"{reports.TOOL} {reports.VERSION}", counts))
                Path(a.findings).write_text("\n".join(r.turtle for r in blocks.orderBy("s").toLocalIterator()), encoding="utf-8")
        if a.turtle:
            head = "".join(f"@prefix {k}: <{v}> .\n" for k, v in turtle.PREFIXES.items())
            Path(a.turtle).write_text(head + "\n".join(r.turtle for r in turtle.subjects(facts.table).orderBy("s").toLocalIterator()), encoding="utf-8")
    finally:
        for c in clones:
            c.close()
    return 0


def evaluate_command(spark, a) -> int:
    from . import api
    from .engine import QUERY_SECONDS
    from .operators.evaluation import passes_gate
    from .sinks import reports
    from .sources import corpora

    if a.analyze:
        rows = api.analyse(spark, corpora.units_of_report(corpora.load_report(a.analyze)))
        print(reports.table(["metric", "before", "after", "delta", "lower", "upper"], [[r[k] for k in ("metric", "before", "after", "delta", "lower", "upper")] for r in rows], {3, 4, 5}))
        return 0
    how, limit, opened = _how(a), a.query_timeout or QUERY_SECONDS, []

    def units(source: str | None, truth: str | None, base: str = ".") -> tuple[str, corpora.Units]:
        opened.append(found := corpora.resolve_corpus(source, base))
        made = corpora.units_of(found.root, truth)
        made.commit = found.commit
        return found.name, made

    try:
        loaded = {}
        if a.corpora:
            for c in corpora.manifest(a.corpora):
                loaded[c.name] = units(c.source, c.ground_truth, str(Path(a.corpora).parent))[1]
                loaded[c.name].query_timeout = a.query_timeout or c.query_timeout
        else:
            name, made = units(a.corpus, a.ground_truth)
            loaded[name] = made
        report = api.evaluate(spark, loaded, limit, how)
    finally:
        for found in opened:
            found.close()
    base = corpora.load_report(a.baseline) if a.baseline else None
    print(reports.evaluation_text(report, base))
    if a.report:
        Path(a.report).write_text(json.dumps(report, indent=2), encoding="utf-8")
    if base is not None and not passes_gate(report["micro"].get("f1"), base["micro"].get("f1")):
        print("micro F1 fell below the baseline", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
