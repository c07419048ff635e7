"""Registered queries of sources, extraction and the review's parts, on inputs made of the data's keys."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab
from .csharp.extract import extract, facts_of, locations_of
from .engine import complete
from .facts import Facts
from .functions import paths
from .operators import evaluation, review
from .operators.rubrics import RUBRICS
from .queries import read, registered
from .sinks import reports
from .sources import corpora, files

# Paths, projects and addresses

_FOLDERS = ("src", "Bin", "obj", "lib", "SRC")
_NAMES = ("Factory-Method", "misc", ".git", "Demo.Singleton.Conceptual", "bin", "12_Observer", "Proxies")


def _pick(values: tuple[str, ...], key: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.expr(key) % len(values) + 1).cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _paths(spark, sf_dir) -> DataFrame:
    """A path for each part: two folders, and a file of one name for every three parts, in two spellings."""
    file = F.concat(F.when(F.col("p_partkey") % 2 == 0, "F").otherwise("f"), F.floor(F.col("p_partkey") / 3).cast("string"), F.lit(".cs"))
    return read(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", _pick(_FOLDERS, "p_partkey div 3"), _pick(_NAMES, "p_partkey div 15"), file).alias("path"))


_PATHS_SQL = f"(select p_partkey, ({_sql_list(_FOLDERS)})[(p_partkey // 3) % {len(_FOLDERS)} + 1] || '/' || ({_sql_list(_NAMES)})[(p_partkey // 15) % {len(_NAMES)} + 1] || '/' || case when p_partkey % 2 = 0 then 'F' else 'f' end || (p_partkey // 3) || '.cs' as path from part)"

registered("source_build_output", f"select p_partkey, path from {_PATHS_SQL} where not (lower(split_part(path, '/', 1)) in ('bin', 'obj') or lower(split_part(path, '/', 2)) in ('bin', 'obj'))")(
    lambda s, d: _paths(s, d).where(~paths.below_build_output(F.col("path")))
)
registered("source_distinct_paths", f"select lower(path) as key, min_by(path, p_partkey) as path, count(*)::bigint as n from {_PATHS_SQL} group by lower(path)")(
    lambda s, d: _paths(s, d).groupBy(F.lower("path").alias("key")).agg(F.min_by("path", "p_partkey").alias("path"), F.count(F.lit(1)).alias("n"))
)
_LABELS_SQL = "(values ('Factory-Method', 'Factory Method'), ('Demo.Singleton.Conceptual', 'Singleton'), ('12_Observer', 'Observer')) l(folder, pattern)"
registered("labelled_folders", f"select path, split_part(path, '/', 1) || '/' || folder as unit, pattern from (select distinct path from {_PATHS_SQL}) join {_LABELS_SQL} on split_part(path, '/', 2) = folder where lower(split_part(path, '/', 1)) not in ('bin', 'obj')")(
    lambda s, d: _paths(s, d).select("path", paths.labelled_folder(F.col("path")).alias("l")).where("l is not null").select("path", "l.unit", "l.pattern").distinct()
)


def _solutions(spark, sf_dir) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    line = lambda path: F.concat(F.lit('Project("{A}") = "P", "'), path, F.lit('", "{B}"\nEndProject\n'))
    sln = F.concat(F.lit("\n# text\n"), line(F.concat(F.lit("src\\P"), key, F.lit(".csproj"))), line(F.lit("folder")), line(F.concat(F.lit("T"), key, F.lit(".CSPROJ"))))
    slnx = F.concat(F.lit('<Solution><Folder Name="/x/"><Project Path="a\\'), key, F.lit('.csproj" /></Folder><Project Type="c" Path="b.vbproj"/></Solution>'))
    return read(spark, sf_dir, "supplier").select("s_suppkey", sln.alias("sln"), slnx.alias("slnx"))


registered("solution_projects", "select s_suppkey, unnest(['src/P' || s_suppkey || '.csproj', 'T' || s_suppkey || '.CSPROJ', 'a/' || s_suppkey || '.csproj']) as project from supplier")(
    lambda s, d: _solutions(s, d).select("s_suppkey", F.explode(F.concat(paths.sln_projects(F.col("sln")), paths.slnx_projects(F.col("slnx")))).alias("project"))
)

_FORMS = ("https://github.com/o-{}/r.x{}", "github.com/o{}/r{}.git", "http://www.GitHub.com/o{}/r{}/tree/rel/{}/", "https://example.com/o{}/r{}", "https://github.com/o{}", "https://github.com/o{}/r{}/issues", "src/o{}/r{}")


def _addresses(spark, sf_dir) -> DataFrame:
    filled = F.replace(_pick(_FORMS, "c_custkey"), F.lit("{}"), F.col("c_custkey").cast("string"))
    return read(spark, sf_dir, "customer").select("c_custkey", filled.alias("address"))


registered(
    "repository_addresses",
    """select c_custkey, owner, name, branch, 'https://github.com/' || owner || '/' || name || '.git' as clone_url from (
        select c_custkey, case when c_custkey % 7 = 0 then 'o-' || c_custkey else 'o' || c_custkey end as owner, case when c_custkey % 7 = 0 then 'r.x' || c_custkey else 'r' || c_custkey end as name,
               case when c_custkey % 7 = 2 then 'rel/' || c_custkey end as branch from customer where c_custkey % 7 < 3)""",
)(lambda s, d: _addresses(s, d).select("c_custkey", paths.repository(F.col("address")).alias("r")).where("r is not null").select("c_custkey", "r.owner", "r.name", "r.branch", "r.clone_url"))

# Label files, manifests, reports and caches: JSON made of the data, read by the loaders' rules


def _truth(spark, sf_dir) -> DataFrame:
    """One label file for each nation's suppliers, with comments and trailing commas; some units have no patterns."""
    spelled = F.when(F.col("s_suppkey") % 3 == 0, '["factory_method", "PROXY",]').when(F.col("s_suppkey") % 3 == 1, "[]").otherwise('["State"]')
    unit = F.concat(F.lit('{"path": "u'), F.col("s_suppkey").cast("string"), F.lit('", "patterns": '), spelled, F.lit("}, // one\n"))
    return read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("corpus")).agg(F.concat(F.lit('{"units": ['), F.array_join(F.array_sort(F.collect_list(unit)), ""), F.lit("] /* end */ }")).alias("text"))


registered("ground_truth_labels", "select s_nationkey as corpus, 'u' || s_suppkey as unit, p as pattern from supplier left join (values (0, 'Factory Method'), (0, 'Proxy'), (2, 'State')) v(k, p) on v.k = s_suppkey % 3")(
    lambda s, d: corpora.labels(_truth(s, d))
)


def _reports(spark, sf_dir) -> DataFrame:
    """One report for each source of labelled documents, of its units' outcomes; those of odd length are reports of corpora."""
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").where("source is not null")
    one = lambda c: F.when(c, F.array(F.lit("Proxy"))).otherwise(F.array().cast("array<string>"))
    outcome = F.struct(F.col("doc_id").cast("string").alias("unit"), one(F.col("quality") == 1).alias("labeled"), one(F.col("n_chars") % 2 == 0).alias("structural"), one(F.col("toxic") == 0).alias("detected"))
    # a report is one file of at most a hundred units
    units = docs.groupBy("source", F.floor(F.col("doc_id") / 100).alias("part")).agg(F.collect_list(outcome).alias("units"))
    own = F.to_json(F.struct("units"))
    return units.select("source", "part", F.when(F.col("part") % 2 == 0, own).otherwise(F.concat(F.lit('{"corpora": ['), own, F.lit("]}"))).alias("text"))


registered(
    "report_units",
    "select source, d.doc_id::varchar as unit, (quality = 1)::int as labeled, (n_chars % 2 = 0)::int as structural, (toxic = 0)::int as detected from documents d join labels l on l.doc_id = d.doc_id where source is not null",
)(lambda s, d: corpora.report_units(_reports(s, d), "source").select("source", "unit", *[F.size(c).alias(c) for c in ("labeled", "structural", "detected")]))


def _caches(spark, sf_dir) -> DataFrame:
    """A cache file for each supplier: a map of two verdicts, or something damaged."""
    key = F.col("s_suppkey").cast("string")
    good = F.concat(F.lit('{"k'), key, F.lit('": {"outcome": "confirmed", "rationale": "r", "model": "m"}, "x'), key, F.lit('": {"rationale": "no outcome"}}'))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, F.substr(good, F.lit(1), F.lit(9))).when(F.col("s_suppkey") % 4 == 1, F.lit("")).otherwise(good).alias("text"))


registered("cache_entries", "select s_suppkey, 'k' || s_suppkey as key, 'confirmed' as outcome, 'r' as rationale, 'm' as model from supplier where s_suppkey % 4 > 1")(
    lambda s, d: corpora.cache_entries(_caches(s, d), "s_suppkey")
)

# Extraction

#: Two files of a unit; %k is a key. Each fact of _FACTS follows from the language's rules, see the survey of fact kinds.
_FILE_A = """using System;
namespace Yard%k;
public abstract class Tool {
    protected readonly string _name = "t%k";
    public abstract double Use(int times);
    public string Name => _name;
}
"""
_FILE_B = """using System.Collections.Generic;
namespace Yard%k;
public interface IRun { void Run(); int Speed { get; } }
public sealed class Saw : Tool, ICloneable {
    private Tool _spare; private static Saw _one;
    Saw() { }
    public override double Use(int times) { var r = _spare.Use(times); return r; }
    public Saw Lend(Tool other) { _spare = other; return this; }
    public object Clone() => MemberwiseClone();
    public static Saw One() { return new Saw(); }
    public List<Tool> Rest { get; set; }
    public string Label() { return Name; }
}
public class Runner : IRun {
    public void Run() { }
    public int Speed => 3;
    public class Inner<T> { public T Value; public const int Most = %k; }
}
"""
#: subject predicate object ...; ~ stands for the namespace.
_EXPECTED = """
~.Tool type Class hasModifier Public hasModifier Abstract hasField ~.Tool__name_0 hasMethod ~.Tool_Use_1 hasProperty ~.Tool_Name_2
~.Tool__name_0 type Field hasModifier Protected hasModifier ReadOnly returnsType string
~.Tool_Use_1 type Method hasModifier Public hasModifier Abstract returnsType double hasParameterType int
~.Tool_Name_2 type Property hasModifier Public returnsType string
~.IRun type Interface hasModifier Public hasMethod ~.IRun_Run_0 hasProperty ~.IRun_Speed_1
~.IRun_Run_0 type Method returnsType void hasModifier Abstract
~.IRun_Speed_1 type Property returnsType int hasModifier Abstract
~.Saw type Class extends ~.Tool extends System.ICloneable hasModifier Public hasModifier Sealed hasField ~.Saw__spare_0 hasField ~.Saw__one_1 hasConstructor ~.Saw_Ctor_2
~.Saw hasMethod ~.Saw_Use_3 hasMethod ~.Saw_Lend_4 hasMethod ~.Saw_Clone_5 hasMethod ~.Saw_One_6 hasProperty ~.Saw_Rest_7 hasMethod ~.Saw_Label_8
~.Saw__spare_0 type Field hasModifier Private returnsType ~.Tool
~.Saw__one_1 type Field hasModifier Private hasModifier Static returnsType ~.Saw
~.Saw_Ctor_2 type Constructor hasModifier Private
~.Saw_Use_3 type Method hasModifier Public hasModifier Override returnsType double hasParameterType int delegatesTo ~.Saw__spare_0 invokes ~.Tool calls ~.Tool_Use_1
~.Saw_Lend_4 type Method hasModifier Public returnsType ~.Saw hasParameterType ~.Tool assignsField ~.Saw__spare_0 returnsSelf ~.Saw
~.Saw_Clone_5 type Method hasModifier Public hasModifier Override returnsType object instantiates ~.Saw
~.Saw_One_6 type Method hasModifier Public hasModifier Static returnsType ~.Saw instantiates ~.Saw
~.Saw_Rest_7 type Property hasModifier Public returnsType System.Collections.Generic.List_Tool_ hasTypeArgument ~.Tool
~.Saw_Label_8 type Method hasModifier Public returnsType string calls ~.Tool_Name_2
~.Runner type Class extends ~.IRun hasModifier Public hasMethod ~.Runner_Run_0 hasProperty ~.Runner_Speed_1
~.Runner_Run_0 type Method hasModifier Public hasModifier Override returnsType void
~.Runner_Speed_1 type Property hasModifier Public hasModifier Override returnsType int
~.Runner.Inner_T_ type Class hasModifier Public hasField ~.Runner.Inner_T__Value_0 hasField ~.Runner.Inner_T__Most_1
~.Runner.Inner_T__Value_0 type Field hasModifier Public returnsType T
~.Runner.Inner_T__Most_1 type Field hasModifier Public hasModifier Const returnsType int
"""
#: Node, file and lines of some nodes: a type's is its name, a member's its declaration.
_PLACES = (("~.Tool", "a", 3, 3), ("~.Tool_Name_2", "a", 6, 6), ("~.IRun", "b", 3, 3), ("~.Saw", "b", 4, 4), ("~.Saw_Use_3", "b", 7, 7), ("~.Runner.Inner_T_", "b", 17, 17))


def _sources(spark, sf_dir, unit: Column) -> DataFrame:
    """Two files for each part, whose unit is a column of p_partkey."""
    key = F.col("p_partkey").cast("string")
    made = F.array(*[F.struct(F.concat(F.lit(f"{n}"), key, F.lit(".cs")).alias("file"), F.lit(i).alias("file_order"), F.replace(F.lit(t), F.lit("%k"), key).alias("text")) for i, (n, t) in enumerate((("a", _FILE_A), ("b", _FILE_B)))])
    return read(spark, sf_dir, "part").select(unit.cast("string").alias("unit"), F.explode(made).alias("f")).select("unit", "f.*")


def _expected_sql(unit: str) -> str:
    facts = [(w[0], w[i], w[i + 1]) for w in (x.split() for x in _EXPECTED.strip().split("\n")) for i in range(1, len(w), 2)]
    rows = ", ".join(f"('{s}', '{p}', '{o}')" for s, p, o in facts)
    return f"select {unit} as unit, replace(s, '~', 'Yard' || p_partkey) as s, p, replace(o, '~', 'Yard' || p_partkey) as o from part, (values {rows}) v(s, p, o)"


registered("extract_facts", _expected_sql("(p_partkey % 40)::varchar"))(lambda s, d: facts_of(extract(_sources(s, d, F.col("p_partkey") % 40))).distinct())
# all files in one unit, read in parts of some hundred files
registered("extract_one_large_unit", _expected_sql("'all'"))(lambda s, d: facts_of(extract(_sources(s, d, F.lit("all")), part_chars=200_000)).distinct())
registered(
    "extract_locations",
    "select 'all' as unit, replace(n, '~', 'Yard' || p_partkey) as fragment, f || p_partkey || '.cs' as file, a as start_line, b as end_line from part, (values " + ", ".join(f"('{n}', '{f}', {a}, {b})" for n, f, a, b in _PLACES) + ") v(n, f, a, b)",
)(lambda s, d: locations_of(extract(_sources(s, d, F.lit("all")), part_chars=200_000)).where(F.regexp_replace("fragment", r"^Yard\d+", "~").isin(*[p[0] for p in _PLACES])))



def _examples(spark, sf_dir) -> DataFrame:
    """What is found in the example files of the package, each a unit: read, extracted and asked all queries, end to end."""
    listed = {Path(f).stem: [f] for f in files.resolve(corpora.EXAMPLES)}
    return complete(Facts(facts_of(extract(files.read_files(spark, listed))))).select("unit", "pattern").distinct()


_STEMS = ", ".join("('" + "".join(w[0].upper() + w[1:] for w in p.split(" ")) + f"', '{p}')" for p in vocab.PATTERNS)
registered("examples_detect", f"select * from (values {_STEMS}) v(unit, pattern)")(_examples)

# Parts of the review


def _described(spark, sf_dir) -> DataFrame:
    """A candidate for each supplier, of two roles, of which one in two is located."""
    key = F.col("s_suppkey").cast("string")
    role = lambda n, file, line: F.struct(F.lit(n).alias("role"), F.concat(F.lit(n.upper()), key).alias("label"), F.concat(F.lit("N."), F.lit(n.upper()), key).alias("fragment"), F.lit(None).cast("string").alias("iri"), file.cast("string").alias("file"), line.cast("int").alias("start_line"), line.cast("int").alias("end_line"))
    file = F.concat(F.lit("/root.d/f"), (F.col("s_suppkey") % 5).cast("string"))
    roles = F.array(role("subject", file, F.col("s_suppkey") % 3 + 1), role("proxy", F.when(F.col("s_suppkey") % 2 == 0, file), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 3 + 1)))
    return read(spark, sf_dir, "supplier").select(key.alias("unit"), F.lit("Proxy").alias("pattern"), F.lit(1).cast("long").alias("match_id"), roles.alias("roles"))


_DESCRIBED = "'CANDIDATE Proxy' || chr(10) || '- subject: SUBJECT' || s_suppkey || ' (f' || s_suppkey % 5 || ':' || (s_suppkey % 3 + 1) || ')' || chr(10) || '- proxy: PROXY' || s_suppkey || case when s_suppkey % 2 = 0 then ' (f' || s_suppkey % 5 || ':' || (s_suppkey % 3 + 1) || ')' else '' end"
registered("review_description", f"select s_suppkey::varchar as unit, {_DESCRIBED} as description from supplier")(lambda s, d: review.described(_described(s, d), "/root.d").select("unit", "description"))


def _read_files(spark, sf_dir) -> DataFrame:
    """Five files of three lines, of which two are read."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat(F.lit("line "), i.cast("string"), F.lit(" of "), F.col("id").cast("string"))), "\n")
    return spark.range(5).where("id % 2 = 0").select(F.concat(F.lit("/root.d/f"), F.col("id").cast("string")).alias("file"), text.alias("text"))


# both roles of every second candidate stand at one place, which is told once; a candidate without readable file has no source
_SOURCE = "case when s_suppkey % 5 % 2 = 0 then 'line ' || (s_suppkey % 3 + 1) || ' of ' || s_suppkey % 5 end"
_SYSTEM = review.system_prompt("Proxy", RUBRICS["Proxy"]).replace("'", "''")
registered("review_candidates", f"select s_suppkey::varchar as unit, {_SOURCE} as source, '{_SYSTEM}' as system, {_DESCRIBED} || chr(10) || chr(10) || 'SOURCE' || chr(10) || coalesce({_SOURCE}, '') as prompt from supplier")(
    lambda s, d: review.candidates(_described(s, d), _read_files(s, d), "/root.d").select("unit", "source", "system", "prompt")
)
_RUBRIC_ROWS = ", ".join("('" + p + "', '" + review.system_prompt(p, RUBRICS[p]).replace("'", "''") + "')" for p in vocab.PATTERNS)
registered("review_prompts", f"select p_partkey, pattern, system from (select p_partkey, ({_sql_list(vocab.PATTERNS)})[(p_partkey % {len(vocab.PATTERNS)} + 1)::int] as pattern from part) join (values {_RUBRIC_ROWS}) r(pattern, system) using (pattern)")(
    lambda s, d: review.prompts(read(s, d, "part").select("p_partkey", _pick(vocab.PATTERNS, "p_partkey").alias("pattern"), F.lit("").alias("description"), F.lit("").alias("source"))).select("p_partkey", "pattern", "system")
)


def _reviews(spark, sf_dir) -> DataFrame:
    """A review's counters for each order, by priority."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("corpus"), F.col("o_orderkey").cast("string").alias("unit"), F.concat(F.lit("m"), (F.col("o_custkey") % 3).cast("string")).alias("model"), (F.col("o_orderkey") % 7).alias("reviewed"), (F.col("o_orderkey") % 2).alias("dropped"), F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("failed "), F.col("o_orderkey").cast("string"))).alias("failure"))


registered(
    "combined_reviews",
    "select o_orderpriority as corpus, sum(o_orderkey % 7)::bigint as reviewed, sum(o_orderkey % 2)::bigint as dropped, string_agg(distinct 'm' || o_custkey % 3, ', ' order by 'm' || o_custkey % 3) as models, 'failed ' || min(case when o_orderkey % 11 = 0 then o_orderkey::varchar end) as failure from orders group by 1",
)(lambda s, d: evaluation.combined_reviews(_reviews(s, d), ["corpus"]))


def _durations(spark, sf_dir) -> DataFrame:
    """Seconds of a unit's queries, from the shares of orders' lines."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("unit"), F.concat(F.lit("q"), F.col("l_linenumber").cast("string")).alias("pattern")).agg(F.round(F.sum("l_quantity") / 10, 6).alias("seconds"))


registered(
    "slow_units",
    """with d as (select l_orderkey::varchar as unit, 'q' || l_linenumber as pattern, round(sum(l_quantity) / 10, 6) as seconds from lineitem group by 1, 2)
    select unit, pattern, seconds, place from (select *, row_number() over (partition by unit order by seconds desc, pattern) as place from d
        where seconds >= 1 and unit in (select unit from d group by unit having round(sum(seconds), 6) >= 10)) where place <= 3""",
)(lambda s, d: evaluation.slow_units(_durations(s, d)).withColumn("place", F.col("place").cast("long")))

registered(
    "json_matches",
    """select s_suppkey::varchar as unit, 'Proxy' as pattern, 1::bigint as match_id,
        '{"roles":[{"role":"subject","label":"SUBJECT' || s_suppkey || '","file":"/root.d/f' || s_suppkey % 5 || '","startLine":' || (s_suppkey % 3 + 1) || ',"endLine":' || (s_suppkey % 3 + 1) || ',"fragment":"N.SUBJECT' || s_suppkey
        || '"},{"role":"proxy","label":"PROXY' || s_suppkey || '"' || case when s_suppkey % 2 = 0 then ',"file":"/root.d/f' || s_suppkey % 5 || '","startLine":' || (s_suppkey % 3 + 1) || ',"endLine":' || (s_suppkey % 3 + 1) else '' end
        || ',"fragment":"N.PROXY' || s_suppkey || '"}]}' as match from supplier""",
)(lambda s, d: reports.match_json(_described(s, d)))
