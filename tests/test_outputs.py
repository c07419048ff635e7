"""Sources, sinks, review, command line and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from factloom import cli
from factloom.facts import Facts
from factloom.operators import results, review
from factloom.operators.detectors import matches
from factloom.plans import motifs
from factloom.sinks import findings, reports, sarif, turtle
from factloom.sources import corpora, files

SINGLETON = "namespace Demo { public sealed class Registry { private static readonly Registry _one = new(); private Registry() { } public static Registry One => _one; } }"


@pytest.fixture(scope="module")
def proxy(spark):
    table = spark.createDataFrame([("u", *t) for t in motifs.triples("proxy_pos")], "unit string, s string, p string, o string")
    places = spark.createDataFrame([("u", "Svc", "/x/s.cs", 1, 1), ("u", "Px", "/x/p.cs", 3, 9)], "unit string, fragment string, file string, start_line int, end_line int")
    return results.reported(matches(Facts(table), "Proxy"), places)


def test_resolver(tmp_path):
    for name in ("src/A.cs", "src/bin/B.cs", "src/sub/obj/C.cs", "src/sub/D.cs", "other/E.cs"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("class X { }")
    (tmp_path / "src/P.csproj").write_text("")
    (tmp_path / "all.sln").write_text('Project("{1}") = "P", "src\\P.csproj", "{2}"\nEndProject\nProject("{1}") = "F", "folder", "{3}"\n')
    (tmp_path / "all.slnx").write_text('<Solution><Project Path="src/P.csproj"/></Solution>')
    names = lambda p: [x.rsplit("/", 1)[-1] for x in files.resolve(str(tmp_path / p))]
    assert names("src") == names("src/P.csproj") == names("all.sln") == names("all.slnx") == ["A.cs", "D.cs"] and names("other/E.cs") == ["E.cs"]
    assert len(files.resolve_all([str(tmp_path / "src"), str(tmp_path / "src/A.cs")])) == 2
    with pytest.raises(FileNotFoundError):
        files.resolve(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        (tmp_path / "x.txt").write_text("")
        files.resolve(str(tmp_path / "x.txt"))


def test_repository_addresses():
    r = files.repository("https://www.github.com/some-one/thing.git")
    assert (r.clone_url, r.slug) == ("https://github.com/some-one/thing.git", "some-one/thing")
    assert files.repository("github.com/a/b/tree/feature/x/").branch == "feature/x" and files.repository("https://example.com/a/b") is None and files.repository("src/dir") is None


def test_trees_are_read_by_spark(spark, tmp_path):
    for name in ("one/A.cs", "one/bin/B.cs", "two/deep/C.cs"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("﻿class X { }", encoding="utf-8")
    got = {(r.unit, r.file.rsplit("/", 1)[-1], r.text) for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert got == {("one", "A.cs", "class X { }"), ("two", "C.cs", "class X { }")}


def test_labelled_corpora(tmp_path):
    for name in ("Composite/A.cs", "Composite/Facade/B.cs", "misc/C.cs", "misc/FactoryMethod/D.cs", ".git/Proxy/E.cs"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("class X { }")
    found = corpora.from_folders(str(tmp_path))
    assert [(u.name, len(u.files), u.expected) for u in found.units] == [("Composite", 2, {"Composite"}), ("misc/FactoryMethod", 1, {"Factory Method"})] and found.skipped == 1
    truth = tmp_path / "labels.json"
    truth.write_text('{"units": [{"path": "misc", "patterns": []}, {"path": "Composite", "patterns": ["composite", "Proxy"]}]}')
    assert [u.expected for u in corpora.from_ground_truth(str(truth), str(tmp_path)).units] == [set(), {"Composite", "Proxy"}]
    for bad in ('{"units": [{"path": "misc", "patterns": ["Nope"]}]}', '{"units": [{"path": "gone", "patterns": []}]}', '{"units": [{"path": "misc"}]}'):
        truth.write_text(bad)
        with pytest.raises((ValueError, FileNotFoundError)):
            corpora.from_ground_truth(str(truth), str(tmp_path))
    (tmp_path / "m.json").write_text('{ // all\n "corpora": [ {"name": "a", "source": "x", "groundTruth": "l.json", "queryTimeout": 90,}, ] }')
    (c,) = corpora.manifest(str(tmp_path / "m.json"))
    assert (c.ground_truth, c.query_timeout) == (str(tmp_path / "l.json"), 90)


def test_verdict_cache_files(tmp_path):
    path = str(tmp_path / "cache.json")
    assert corpora.load_cache(path) == {} and corpora.save_cache(path, {"k": {"outcome": "confirmed"}}) and corpora.load_cache(path) == {"k": {"outcome": "confirmed"}}
    (tmp_path / "cache.json").write_text("{broken")
    assert corpora.load_cache(path) == {} and not corpora.save_cache(str(tmp_path / "no/such/x.json"), {})


def test_turtle_round_trip(spark):
    table = spark.createDataFrame([("u", *t) for n in ("observer_pos", "singleton_pos") for t in motifs.triples(n)], "unit string, s string, p string, o string").distinct()
    head = "".join(f"@prefix {k}: <{v}> .\n" for k, v in turtle.PREFIXES.items())
    text = head + "\n".join(r.turtle for r in turtle.subjects(table).collect())
    assert turtle.triples(text) == {(r.s, r.p, r.o) for r in table.collect()}


def test_sarif(proxy):
    (r,) = sarif.results(proxy).collect()
    one = json.loads(r.result)
    assert one["ruleId"] == "Proxy" and one["level"] == "note" and one["message"]["text"] == "Proxy: subject = Svc, realSubject = Real, proxy = Px"
    assert one["locations"][0]["physicalLocation"]["region"] == {"startLine": 1, "endLine": 1} and len(one["relatedLocations"]) == 1 and len(one["properties"]["fdpRoles"]) == 3
    log = json.loads(sarif.envelope([r.result], "t", "1"))
    assert log["version"] == "2.1.0" and len(log["runs"][0]["tool"]["driver"]["rules"]) == 23


def test_findings(proxy, spark):
    got = {(r.s, r.p, r.o) for r in findings.occurrence_triples(proxy).collect()}
    assert ("occurrence-Proxy-1-proxy", "filledBy", "Px") in got and ("Px", "startLine", "3") in got and ("Px", "declaredIn", "file:///x/p.cs") in got and not any(s == "Real" and p == "startLine" for s, p, _ in got)
    blocks = findings.turtle(findings.scan_triples(proxy, "t 1", spark.createDataFrame([("u", 2)], "unit string, file_count int")))
    assert any("hasOccurrence" in r.turtle for r in blocks.collect())


def test_json_report(proxy):
    report = reports.scan_report(reports.match_json(proxy), 2)
    found = next(p for p in report["patterns"] if p["pattern"] == "Proxy")
    assert found["matches"][0]["roles"][1] == {"role": "realSubject", "label": "Real", "iri": found["matches"][0]["roles"][1]["iri"], "fragment": "Real"}
    assert "iri" not in next(p for p in report["patterns"] if p["pattern"] == "Interpreter")
    assert "Proxy: subject = Svc, realSubject = Real, proxy = Px\n1 match(es) in 2 file(s)." == reports.console(report)


def test_tables_of_figures():
    assert reports.table(["a", "b"], [["x", 0.5], ["yy", None]], {1}) == "a   b\nx   +0.500\nyy  -"


def test_excerpts(spark):
    text = "class A\n{\n  void M()\n  {\n    if (x) { y(); }\n  }\n}\nint z;"
    lines = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(text.split("\n"))], "file string, line int, text string")
    spans = spark.createDataFrame([("f", 1, 1), ("f", 3, 3), ("f", 8, 8), ("f", 2, 4), ("g", 1, 1)], "file string, start_line int, end_line int")
    got = {(r.start_line, r.end_line): r.excerpt.count("\n") + 1 for r in review.excerpts(lines, spans).collect()}
    assert got == {(1, 1): 7, (3, 3): 4, (8, 8): 1, (2, 4): 3}


def candidates(spark, rows):
    return spark.createDataFrame(rows, "unit string, pattern string, match_id long, fragments array<string>, system string, prompt string, source string")


def test_review_asks_once_and_drops_rejected(spark):
    rows = candidates(spark, [("u", "Proxy", 1, ["A", "B"], "s", "p1", "same"), ("u", "Proxy", 2, ["B", "A"], "s", "p1", "same"), ("u", "Proxy", 3, ["C"], "s", "no", "x"), ("u", "Proxy", 4, ["D"], "s", "p", None)])
    none = spark.createDataFrame([], "key string, outcome string, rationale string, model string")
    model = review.ScriptedModel(lambda p: '{"verdict": "%s", "rationale": "r"}' % ("rejected" if p == "no" else "confirmed"))
    kept, tally, fresh = review.review(rows, none, model)
    assert sorted(r.match_id for r in kept.collect()) == [1, 2, 4]
    t = tally.first()
    assert (t.reviewed, t.confirmed, t.rejected, t.dropped, t.unreviewed, t.tokens_in, t.tokens_out) == (3, 2, 1, 1, 1, 200, 40)
    again, tally, new = review.review(rows, fresh, review.ScriptedModel("never asked"))
    t = tally.first()
    assert (t.cache_hits, t.tokens_in, new.count()) == (3, 0, 0)
    assert review.review(rows, none, model, keep_rejected=True)[0].count() == 4


def test_failed_questions_keep_matches(spark):
    class Failing:
        name = "failing"

        def complete(self, system, prompt):
            raise RuntimeError("no line")

    none = spark.createDataFrame([], "key string, outcome string, rationale string, model string")
    kept, tally, fresh = review.review(candidates(spark, [("u", "P", 1, ["A"], "s", "p", "x")]), none, Failing())
    assert kept.count() == 1 and tally.first().failure == "no line" and fresh.count() == 0


def test_models_by_prefix():
    with pytest.raises(ValueError):
        review.create_model("nothing-1")
    assert "rubric text" in review.system_prompt("Proxy", " rubric \n text ") and "Proxy" in review.system_prompt("Proxy", None)


def test_command_line_rules():
    assert cli.parse(["scan", "x", "--keep-rejected"]).verify and not cli.parse(["scan", "x"]).verify
    assert cli.parse(["scan"]).inputs == [] and cli.parse(["evaluate"]).corpus is None
    for bad in (["scan", "x", "--query", "q", "--report", "r"], ["scan", "x", "--verify-max-tokens", "0"], ["evaluate", "--analyze", "a", "c"], ["evaluate", "--corpora", "m", "c"], ["evaluate", "--ground-truth", "g"]):
        with pytest.raises(SystemExit):
            cli.parse(bad)


def test_scan_and_evaluate_end_to_end(spark, tmp_path):
    from factloom import api

    (tmp_path / "Singleton").mkdir()
    (tmp_path / "Singleton/R.cs").write_text(SINGLETON)
    _, _, report = api.scan_files(spark, files.resolve(str(tmp_path)))
    (match,) = next(p for p in report["patterns"] if p["pattern"] == "Singleton")["matches"]
    assert match["roles"][0]["label"] == "Registry" and match["roles"][0]["startLine"] == 1
    scored = api.evaluate(spark, {"c": corpora.from_folders(str(tmp_path))}, timeout=300)
    assert scored["micro"] == {"precision": 1.0, "recall": 1.0, "f1": 1.0} and scored["unitCount"] == 1
    assert corpora.units_of_report(scored)[0]["detected"] == ["Singleton"]
    assert {r["metric"]: r["delta"] for r in api.analyse(spark, scored["units"])} == {"precision": 0.0, "recall": 0.0, "f1": 0.0}


def test_stream_rescans_changed_units(spark, tmp_path):
    from factloom.streaming.rescan import latest, rescans

    schema = "unit string, file string, file_order int, text string"
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for number, text in enumerate((SINGLETON, SINGLETON.replace("private Registry()", "public Registry()"))):
        spark.createDataFrame([("u", "R.cs", 0, text)], schema).write.mode("append").parquet(source)
        q = rescans(spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "cp"), ["Singleton"])
        q.awaitTermination(240)
        assert latest(spark.read.parquet(target)).count() == 1 - number


def test_ordinals_and_first_places(spark):
    seen = spark.createDataFrame([("u", "A", "b.cs", 1, 5, 6), ("u", "A", "a.cs", 0, 9, 9)], "unit string, fragment string, file string, file_order int, start_line int, end_line int")
    assert results.first_locations(seen).first().file == "a.cs"
    rows = spark.createDataFrame([("u", "P", [("r", "B")]), ("u", "P", [("r", "A")])], "unit string, pattern string, roles array<struct<role:string,fragment:string>>")
    assert [(r.roles[0].fragment, r.match_id) for r in results.ordinals(rows).orderBy("match_id").collect()] == [("A", 1), ("B", 2)]
    assert F is not None
