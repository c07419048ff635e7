"""The review from the command line's options to the report, models, and where corpora come from."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from factloom import api, cli
from factloom.csharp.extract import extract
from factloom.facts import Facts
from factloom.operators import models, review
from factloom.operators.detectors import matches
from factloom.operators.rubrics import RUBRICS
from factloom.sinks import reports
from factloom.sources import corpora, files
from factloom.vocab import PATTERNS

SINGLETON = "namespace Demo { public sealed class Registry { private static readonly Registry _one = new(); private Registry() { } public static Registry One => _one; } }"


@pytest.fixture()
def labelled(tmp_path):
    for name, text in (("Singleton/R.cs", SINGLETON), ("Proxy/P.cs", SINGLETON.replace("Registry", "Other"))):
        (tmp_path / "c" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / name).write_text(text)
    script = tmp_path / "replies.json"
    script.write_text(json.dumps({"Singleton": '{"verdict": "rejected", "rationale": "no"}', "*": "?"}))
    return tmp_path, f"script:{script}"


def run(argv, spark):
    a = cli.parse(argv)
    return (cli.scan_command if a.command == "scan" else cli.evaluate_command)(spark, a)


def test_review_of_a_scan(spark, labelled, capsys):
    base, model = labelled
    report, cache = base / "r.json", base / "cache.json"
    assert run(["scan", str(base / "c/Singleton"), "--report", str(report), "--verify-model", model, "--verify-cache", str(cache), "--keep-rejected"], spark) == 0
    first = json.loads(report.read_text())
    (match,) = next(p for p in first["patterns"] if p["pattern"] == "Singleton")["matches"]
    assert match["verdict"]["outcome"] == "rejected" and match["verdict"]["model"] == model
    assert (first["review"]["reviewed"], first["review"]["dropped"], first["review"]["tokens_in"]) == (1, 0, 100)
    assert [v["outcome"] for v in json.loads(cache.read_text()).values()] == ["rejected"]
    assert "[rejected: no]" in capsys.readouterr().out
    # the cache answers the second time, and the match goes
    assert run(["scan", str(base / "c/Singleton"), "--report", str(report), "--verify-model", model, "--verify-cache", str(cache)], spark) == 0
    again = json.loads(report.read_text())
    assert not next(p for p in again["patterns"] if p["pattern"] == "Singleton")["matches"]
    assert (again["review"]["cache_hits"], again["review"]["tokens_in"], again["review"]["dropped"]) == (1, 0, 1)


def test_review_of_an_evaluation(spark, labelled, capsys):
    base, model = labelled
    report = base / "e.json"
    assert run(["evaluate", str(base / "c"), "--report", str(report), "--verify-model", model], spark) == 0
    got = json.loads(report.read_text())
    assert {u["unit"]: (u["structural"], u["detected"]) for u in got["units"]} == {"Singleton": (["Singleton"], []), "Proxy": (["Singleton"], [])}
    assert got["review"]["rejected"] == 2 and got["review"]["models"] == model
    assert "Review by" in capsys.readouterr().out
    (changes,) = [r for r in api.analyse(spark, got["units"]) if r["metric"] == "recall"]
    assert (changes["before"], changes["after"], changes["delta"]) == (0.5, 0.0, -0.5)


def test_a_review_needs_a_model(spark):
    with pytest.raises(ValueError, match="known prefixes"):
        run(["scan", "x", "--verify"], spark)
    with pytest.raises(ValueError, match="known prefixes"):
        run(["scan", "x", "--verify-model", "unknown-1"], spark)


def test_every_pattern_has_a_rubric():
    assert set(RUBRICS) == set(PATTERNS) and len({review.system_prompt(p, r) for p, r in RUBRICS.items()}) == len(PATTERNS)


@pytest.fixture()
def service():
    answers, asked = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            code, body, headers = answers.pop(0)
            self.send_response(code)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    yield f"http://127.0.0.1:{server.server_port}/chat#small", answers, asked
    server.shutdown()


def test_http_model(service):
    name, answers, asked = service
    model = models.create_model(name, 77)
    answers += [(429, {}, {"Retry-After": "0"}), (400, {}, {}), (200, {"text": "hi", "tokens_in": 5, "tokens_out": 2}, {})]
    assert model.complete("s", "p") == ("hi", 5, 2)
    assert ["schema" in a for a in asked] == [True, True, False] and asked[0]["max_tokens"] == 77 and asked[0]["model"] == "small"
    for code, body, text in ((200, {"stop": "max_tokens"}, "max_tokens"), (200, {"stop": "refusal"}, "refusal"), (500, {}, "500")):
        answers.append((code, body, {}))
        with pytest.raises(RuntimeError, match=text):
            model.complete("s", "p")
    answers += [(429, {}, {"Retry-After": "0"})] * models.TRIES
    with pytest.raises(RuntimeError, match="429"):
        model.complete("s", "p")
    answers.append((200, {"text": "x" * models.MOST_BYTES}, {}))
    with pytest.raises(RuntimeError, match="bytes"):
        model.complete("s", "p")


class Stub:
    def __init__(self, repo, path):
        self.path, self.repo, self.closed = path, repo, False

    def commit(self):
        return "abc123"

    def close(self):
        self.closed = True


def test_corpora_resolve(tmp_path):
    (tmp_path / "Proxy").mkdir()
    (tmp_path / "Proxy/A.cs").write_text(SINGLETON)
    cloned = []

    def clone(repo):
        cloned.append(Stub(repo, str(tmp_path)))
        return cloned[-1]

    for none in (None, "examples", "Examples"):
        assert corpora.resolve_corpus(none).root == corpora.EXAMPLES
    got = corpora.resolve_corpus("https://github.com/some/thing/tree/v1/2", clone=clone)
    assert (got.name, got.commit, got.root) == ("some/thing@v1/2", "abc123", str(tmp_path)) and cloned[0].repo.branch == "v1/2"
    got.close()
    assert cloned[0].closed and corpora.resolve_corpus("refactoring-guru", clone=clone).checkout.repo.owner == "RefactoringGuru"
    assert corpora.resolve_corpus("Proxy", str(tmp_path)).root == str(tmp_path / "Proxy")
    with pytest.raises(FileNotFoundError, match="known corpus"):
        corpora.resolve_corpus("nothing", str(tmp_path))


def test_manifest_of_addresses(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "clone/Singleton").mkdir(parents=True)
    (tmp_path / "clone/Singleton/R.cs").write_text(SINGLETON)
    (tmp_path / "own/Proxy").mkdir(parents=True)
    (tmp_path / "own/Proxy/P.cs").write_text("class A { }")
    (tmp_path / "m.json").write_text('{"corpora": [{"name": "far", "source": "https://github.com/a/b", "queryTimeout": 90}, {"name": "near", "source": "own",},]}')
    seen, scan = [], api.scan_sources
    monkeypatch.setattr(corpora.resolve_corpus, "__defaults__", (".", lambda repo: Stub(repo, str(tmp_path / "clone"))))
    monkeypatch.setattr(api, "scan_sources", lambda spark, sources, timeout: (seen.append(timeout), scan(spark, sources, timeout))[1])
    base = tmp_path / "base.json"
    base.write_text(json.dumps({"micro": {"f1": 0.9}, "macro": {}, "perPattern": [{"pattern": "Singleton", "f1": 0.5}]}))
    out = tmp_path / "out.json"
    assert run(["evaluate", "--corpora", str(tmp_path / "m.json"), "--baseline", str(base), "--report", str(out)], spark) == 1
    assert sorted(seen) == [50.0, 90.0]
    report = json.loads(out.read_text())
    assert {c["corpus"]: c.get("commit") for c in report["corpora"]} == {"far": "abc123", "near": None}
    text = capsys.readouterr().out
    assert "+0.500" in text and "far at commit abc123" in text


def test_bundled_examples_are_found(spark):
    report = api.evaluate(spark, {"examples": corpora.units_of(corpora.EXAMPLES)}, 600)
    assert report["unitCount"] == len(PATTERNS) and [u for u in report["units"] if u["detected"] != u["labeled"]] == []


def test_files_are_read_by_executors(spark, tmp_path):
    odd = tmp_path / "a [1]{x}.cs"
    odd.write_bytes("﻿class Ä { }".encode() + b"\xff")
    got = files.read_files(spark, {"u": [str(odd)], "v": [str(odd)]}).collect()
    assert {(r.unit, r.file, r.text) for r in got} == {(u, str(odd), "class Ä { }�") for u in "uv"}
    assert files.read_files(spark, {}).count() == 0


def test_a_large_unit_is_read_in_parts(spark):
    root = corpora.EXAMPLES
    table = files.read_files(spark, {"all": files.resolve(root), "one": [f"{root}/Proxy.cs"]})
    whole, parts = extract(table), extract(table, part_chars=3000)
    assert sorted(map(tuple, whole.distinct().collect()), key=str) == sorted(map(tuple, parts.distinct().collect()), key=str)
    sizes = parts.where("kind = 'fact'").rdd.glom().map(len).collect()
    assert sum(n > 0 for n in sizes) > 1


def test_spread_facts_give_the_same_matches(spark):
    from factloom.csharp.extract import facts_of

    table = facts_of(extract(files.read_files(spark, {"all": files.resolve(corpora.EXAMPLES)}))).persist()
    together, spread = Facts(table, spread=False), Facts(table, spread=True)
    for pattern in ("Proxy", "Composite", "Visitor"):
        rows = []
        for facts in (together, spread):
            facts.settle()
            rows.append(sorted(map(str, matches(facts, pattern).collect())))
        assert rows[0] and rows[0] == rows[1]
    held = {len({r.s for r in part}) > 0 for part in spread.table.rdd.glom().collect()}
    assert held == {True}
    together.settle()


def test_evaluation_text_without_baseline():
    report = {"perPattern": [], "micro": {}, "macro": {}, "detectionSeconds": 12.0, "slowest": [{"pattern": "Proxy", "seconds": 3.2}, {"pattern": "State", "seconds": 0.2}]}
    assert "slow: Proxy 3.2 s" in reports.evaluation_text(report) and "State" not in reports.evaluation_text(report)
