"""The registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab
from .engine import complete
from .facts import Facts
from .functions import names
from .operators import evaluation, results, review
from .operators.algebra import closure, having, join, minus, optional, pair, union, without
from .operators.detectors import DETECTORS, matches
from .plans import motifs, sql
from .sparql import query as sparql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_FACTS: dict[tuple, Facts] = {}


def facts_for(spark: SparkSession, sf_dir: str) -> Facts:
    """The motif facts of a data folder; kept partitioned by unit for all queries of a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FACTS:
        _FACTS[key] = Facts(motifs.facts_of(spark, sf_dir))
    _FACTS[key].settle()
    return _FACTS[key]


def registered(name: str, oracle: str | None = None):
    def wrap(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return wrap


def over_facts(name: str, select: str | None):
    """Register a query over the motif facts; select is its SQL over `facts` and the views."""

    def wrap(f: Callable[[Facts], DataFrame]):
        registered(name, sql.over_motifs(select) if select else None)(lambda spark, sf_dir: f(facts_for(spark, sf_dir)))
        return f

    return wrap


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Algebra

over_facts("bgp_join", "select meth.unit, t, meth.m, r, x from meth join ret on ret.unit = meth.unit and ret.m = meth.m join md on md.unit = meth.unit and md.n = meth.m")(
    lambda f: join(f.meth("t", "m"), f.ret("m", "r"), f.rel("hasModifier", "m", "x")).select("unit", "t", "m", "r", "x")
)
over_facts("const_object", "select unit, c as t from ext where b = 'System.ICloneable'")(lambda f: f.having("extends", "t", "System.ICloneable"))
over_facts("union_branches", "select unit, t, m from fld union all select unit, t, m from prop where t <> 'Reg'")(lambda f: union(f.fld("t", "m"), f.prop("t", "m").where("t <> 'Reg'")))
over_facts("alt_path", "select unit, t, m from slot")(lambda f: f.slot("t", "m"))
over_facts("seq_path", "select meth.unit, t, r from meth join ret on ret.unit = meth.unit and ret.m = meth.m")(lambda f: join(f.meth("t", "m"), f.ret("m", "r")).select("unit", "t", "r"))
over_facts("neq_filter", "select a.unit, a.t, a.m as m1, b.m as m2 from meth a join meth b on b.unit = a.unit and b.t = a.t and a.m <> b.m")(
    lambda f: join(f.meth("t", "m1"), f.meth("t", "m2")).where("m1 <> m2").select("unit", "t", "m1", "m2")
)
over_facts("pair_lt", "select a.unit, a.t, a.m as m1, b.m as m2 from meth a join meth b on b.unit = a.unit and b.t = a.t and a.m < b.m")(
    lambda f: pair(f.meth("t", "m"), "m", "m1", "m2").select("unit", "t", "m1", "m2")
)
over_facts("in_filter", "select distinct unit, n from md where x in ('Static', 'Private', 'ReadOnly')")(lambda f: f.mod("n", "Static", "Private", "ReadOnly"))
over_facts("not_exists", "select unit, t, m from meth a where not exists (select 1 from md where md.unit = a.unit and md.n = a.m)")(
    lambda f: without(f.meth("t", "m"), f.rel("hasModifier", "m", "x"))
)
over_facts(
    "nested_not_exists",
    "select distinct unit, r from ret a where not exists (select 1 from holds h where h.unit = a.unit and h.r = a.r and not exists (select 1 from ext e where e.unit = h.unit and e.c = h.t and e.b = h.r))",
)(lambda f: without(f.ret("m", "r").select("unit", "r").distinct(), without(join(f.fld("t", "x"), f.ret("x", "r")), f.ext("t", "r")).select("unit", "r")))
over_facts("exists_or", "select unit, m, r as t from inst i where r = 'Cp' or exists (select 1 from ext e where e.unit = i.unit and e.c = i.r)")(
    lambda f: union(f.inst("m", "t").where("t = 'Cp'"), having(f.inst("m", "t"), f.ext("t", "b"))).distinct()
)
over_facts("subselect_distinct", "select distinct a.unit, a.t, e.c from (select distinct unit, t from md join meth on md.unit = meth.unit and md.n = meth.m where x = 'Abstract') a(unit, t) join ext e on e.unit = a.unit and e.b = a.t".replace("select distinct unit, t from md join", "select distinct md.unit, t from md join"))(
    lambda f: join(f.method_with("t", "m", "Abstract").select("unit", "t").distinct(), f.ext("c", "t")).select("unit", "t", "c")
)
over_facts("select_distinct", "select distinct unit, r from ret")(lambda f: f.ret("m", "r").select("unit", "r").distinct())
over_facts("ask", "select unit, bool_or(p = 'extends' and o = 'Obs') as answer from facts group by unit")(
    lambda f: sparql(f, "PREFIX src: <urn:factloom:source#> ASK { ?c src:extends <urn:factloom:scan#Obs> }").table
)
over_facts("construct", "select distinct meth.unit, t as s, 'urn:other#gives' as p, r as o from meth join ret on ret.unit = meth.unit and ret.m = meth.m")(
    lambda f: sparql(f, "PREFIX s: <urn:factloom:source#> CONSTRUCT { ?t <urn:other#gives> ?r } WHERE { ?t s:hasMethod ?m . ?m s:returnsType ?r }").table
)
over_facts("describe", "select unit, s, p, o from facts where s in (select c from ext where b = 'Obs') and exists (select 1 from ext where ext.unit = facts.unit and c = s and b = 'Obs')")(
    lambda f: sparql(f, "DESCRIBE ?c WHERE { ?c <urn:factloom:source#extends> <urn:factloom:scan#Obs> }").table
)
over_facts("optional", "select meth.unit, t, meth.m, x from meth left join md on md.unit = meth.unit and md.n = meth.m")(lambda f: optional(f.meth("t", "m"), f.rel("hasModifier", "m", "x")))
over_facts("minus", "select unit, t, m from meth a where not exists (select 1 from inst i where i.unit = a.unit and i.m = a.m)")(lambda f: minus(f.meth("t", "m"), f.inst("m", "x")))
over_facts("group_having", "select unit, t, count(*)::bigint as n from meth group by unit, t having count(*) >= 2")(lambda f: f.meth("t", "m").groupBy("unit", "t").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"))
over_facts("order_limit_offset", "select unit, t, m from meth order by unit, t, m limit 20 offset 5")(lambda f: f.meth("t", "m").orderBy("unit", "t", "m").offset(5).limit(20))
over_facts("plus_path_motifs", "select unit, c, b from reach")(lambda f: f.reach("c", "b"))

_FK = "fk(a, b) as (select 'c:' || c_custkey, 'n:' || c_nationkey from customer union select 'n:' || n_nationkey, 'r:' || n_regionkey from nation)"
_RING = "fk(a, b) as (select 's:' || s_suppkey, 's:' || ((s_suppkey * 7 + 3) % (select count(*) from supplier)) from supplier)"
_REACH = "with recursive {}, reach as (select a, b from fk union select r.a, f.b from reach r join fk f on f.a = r.b) select a, b from reach"


@registered("plus_path_acyclic", _REACH.format(_FK))
def _acyclic(spark, sf_dir):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    customers = read(spark, sf_dir, "customer").select(key("c:", "c_custkey").alias("a"), key("n:", "c_nationkey").alias("b"))
    nations = read(spark, sf_dir, "nation").select(key("n:", "n_nationkey").alias("a"), key("r:", "n_regionkey").alias("b"))
    return closure(customers.union(nations).withColumn("unit", F.lit("fk")), "a", "b").select("a", "b")


@registered("plus_path_cyclic", _REACH.format(_RING))
def _cyclic(spark, sf_dir):
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey")
    n = suppliers.agg(F.count(F.lit(1)).alias("n"))
    ring = suppliers.crossJoin(F.broadcast(n)).select(F.lit("ring").alias("unit"), F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("a"), F.concat(F.lit("s:"), ((F.col("s_suppkey") * 7 + 3) % F.col("n")).cast("string")).alias("b"))
    return closure(ring, "a", "b").select("a", "b")


# The language front end, on forms that the algebra queries don't cover

_SPARQL = {
    "sparql_union_filter": (
        "SELECT ?t ?m WHERE { { ?t s:hasField ?m } UNION { ?t s:hasProperty ?m FILTER(STR(?t) != 'Reg') } FILTER(STRLEN(STR(?m)) > 1) }",
        "select unit, t, m from (select unit, t, m from fld union all select unit, t, m from prop where t <> 'Reg') where length(m) > 1",
    ),
    "sparql_path_star": (
        "SELECT DISTINCT ?b WHERE { <urn:factloom:scan#Low> s:extends* ?b }",
        "select distinct unit, 'Low' as b from facts where s = 'Low' or o = 'Low' union select unit, b from reach where c = 'Low'",
    ),
    "sparql_inverse_alt": (
        "SELECT ?x ?t WHERE { ?x ^s:hasMethod|^s:hasField ?t }",
        "select unit, m as x, t from meth union all select unit, m as x, t from fld",
    ),
    "sparql_not_exists_nested": (
        "SELECT DISTINCT ?r WHERE { ?m s:returnsType ?r FILTER NOT EXISTS { ?t s:hasField ?f . ?f s:returnsType ?r FILTER NOT EXISTS { ?t s:extends ?r } } }",
        "select distinct unit, r from ret a where not exists (select 1 from holds h where h.unit = a.unit and h.r = a.r and not exists (select 1 from ext e where e.unit = h.unit and e.c = h.t and e.b = h.r))",
    ),
    "sparql_exists_or": (
        "SELECT ?m ?t WHERE { ?m s:instantiates ?t FILTER(?t = <urn:factloom:scan#Cp> || EXISTS { ?t s:extends ?b }) }",
        "select unit, m, r as t from inst i where r = 'Cp' or exists (select 1 from ext e where e.unit = i.unit and e.c = i.r)",
    ),
    "sparql_optional_bound": (
        "SELECT ?t ?m WHERE { ?t s:hasMethod ?m OPTIONAL { ?m s:hasModifier ?x } FILTER(!BOUND(?x)) }",
        "select unit, t, m from meth a where not exists (select 1 from md where md.unit = a.unit and md.n = a.m)",
    ),
    "sparql_group_having": (
        "SELECT ?t (COUNT(?m) AS ?n) (GROUP_CONCAT(?m; SEPARATOR=',') AS ?ms) WHERE { ?t s:hasMethod ?m } GROUP BY ?t HAVING(COUNT(?m) >= 2)",
        "select unit, t, count(*)::bigint as n, string_agg(m, ',' order by m) as ms from meth group by unit, t having count(*) >= 2",
    ),
    "sparql_limit_each": (
        "SELECT ?t ?m WHERE { ?t s:hasMethod ?m } ORDER BY DESC(?t) ?m LIMIT 2 OFFSET 1",
        "select unit, t, m from (select *, row_number() over (partition by unit order by t desc, m) as k from meth) where k between 2 and 3",
    ),
    "sparql_values_bind": (
        "SELECT ?t ?u WHERE { VALUES ?x { s:Static s:Private } ?t s:hasModifier ?x BIND(UCASE(CONCAT(STR(?t), '-', STR(?x))) AS ?u) }",
        "select unit, n as t, upper(n || '-' || x) as u from md where x in ('Static', 'Private')",
    ),
    "sparql_minus": (
        "SELECT ?t ?m WHERE { ?t s:hasMethod ?m MINUS { ?m s:instantiates ?x } }",
        "select unit, t, m from meth a where not exists (select 1 from inst i where i.unit = a.unit and i.m = a.m)",
    ),
    "sparql_subselect": (
        "SELECT ?t ?c WHERE { { SELECT DISTINCT ?t WHERE { ?t s:hasMethod ?m . ?m s:hasModifier s:Abstract } } ?c s:extends ?t }",
        "select a.unit, a.t, e.c from (select distinct md.unit, t from md join meth on md.unit = meth.unit and md.n = meth.m where x = 'Abstract') a join ext e on e.unit = a.unit and e.b = a.t",
    ),
    "sparql_other_namespace": ("SELECT ?c WHERE { ?c <urn:anything#extends> ?b }", "select unit, c from ext where false"),
    "sparql_path_optional": ("SELECT DISTINCT ?b WHERE { <urn:factloom:scan#Low> s:extends? ?b }", "select distinct unit, 'Low' as b from facts where s = 'Low' or o = 'Low' union select unit, b from ext where c = 'Low'"),
    "sparql_path_negated": ("SELECT ?s ?o WHERE { ?s !(s:type|s:hasModifier|s:returnsType) ?o }", "select unit, s, o from facts where p not in ('type', 'hasModifier', 'returnsType')"),
    "sparql_path_negated_one": ("SELECT ?s ?o WHERE { ?s !s:hasMethod ?o }", "select unit, s, o from facts where p <> 'hasMethod'"),
    "sparql_text_functions": (
        "SELECT ?t ?a ?b ?c ?d ?e WHERE { ?t s:hasMethod ?m BIND(LCASE(STR(?t)) AS ?a) BIND(SUBSTR(STR(?t), 2) AS ?b) BIND(SUBSTR(STR(?t), 1, 2) AS ?c) BIND(STRBEFORE(STR(?t), 'b') AS ?d) BIND(STRAFTER(STR(?t), 'b') AS ?e) }",
        "select unit, t, lower(t) as a, substr(t, 2) as b, substr(t, 1, 2) as c, case when instr(t, 'b') > 0 then substr(t, 1, instr(t, 'b') - 1) else '' end as d, case when instr(t, 'b') > 0 then substr(t, instr(t, 'b') + 1) else '' end as e from meth",
    ),
    "sparql_regex_replace": ("SELECT ?t ?r WHERE { ?t s:hasMethod ?m FILTER(REGEX(STR(?t), '^[a-o]', 'i')) BIND(REPLACE(STR(?t), '[aeiou]', '*') AS ?r) }", "select unit, t, regexp_replace(t, '[aeiou]', '*', 'g') as r from meth where regexp_matches(lower(t), '^[a-o]')"),
    "sparql_text_tests": ("SELECT ?t ?m WHERE { ?t s:hasMethod ?m FILTER(STRSTARTS(STR(?t), 'C') || STRENDS(STR(?t), 's') || CONTAINS(STR(?m), 'a')) }", "select unit, t, m from meth where starts_with(t, 'C') or ends_with(t, 's') or contains(m, 'a')"),
    "sparql_if_coalesce": (
        "SELECT ?t ?m ?k ?c WHERE { ?t s:hasMethod ?m OPTIONAL { ?m s:hasModifier ?x } BIND(COALESCE(STR(?x), 'none') AS ?c) BIND(IF(BOUND(?x), 'some', 'none') AS ?k) }",
        "select meth.unit, t, meth.m, case when x is null then 'none' else 'some' end as k, coalesce(x, 'none') as c from meth left join md on md.unit = meth.unit and md.n = meth.m",
    ),
    "sparql_numbers": (
        "SELECT ?t ?a ?c ?f ?r WHERE { ?t s:hasField ?m BIND(ABS(1 - STRLEN(STR(?t))) AS ?a) BIND(CEIL(STRLEN(STR(?t)) / 2) AS ?c) BIND(FLOOR(STRLEN(STR(?t)) / 2) AS ?f) BIND(ROUND(STRLEN(STR(?t)) / 4) AS ?r) }",
        "select unit, t, abs(1 - length(t))::double as a, ceil(length(t) / 2)::bigint as c, floor(length(t) / 2)::bigint as f, round(length(t) / 4)::double as r from fld",
    ),
    "sparql_term_tests": ("SELECT ?c ?b WHERE { ?c s:extends ?b FILTER(ISIRI(?c) && ISURI(?b) && !ISLITERAL(?c) && !ISBLANK(?b) && !SAMETERM(?c, ?b)) }", "select unit, c, b from ext where c <> b"),
}
for _name, (_text, _sql) in _SPARQL.items():
    over_facts(_name, _sql)(lambda f, text=_text: sparql(f, "PREFIX s: <urn:factloom:source#> " + text).table)


# Detectors

for _pattern in vocab.PATTERNS:
    over_facts(f"detect_{vocab.snake(_pattern)}", sql.SELECTS[_pattern])(lambda f, p=_pattern: DETECTORS[p](f))


@registered("detect_all", sql.all_matches())
def _detect_all(spark, sf_dir):
    return evaluation.detected_sets(complete(facts_for(spark, sf_dir)))


# Reported matches, on the queries whose SQL is short

_ROLE_ROWS = ", ".join(f"('{p}', '{r}', {i}, {repr(vocab.FDP + iri) if iri else 'null'})" for p in vocab.PATTERNS for i, (r, iri) in enumerate(vocab.ROLES[p].items()))


def _bound_sql(pattern: str) -> str:
    roles = list(vocab.ROLES[pattern])
    key = " || '|' || ".join(f"'{r}=' || \"{r}\"" for r in roles)
    return " union all ".join(f"select unit, '{pattern}' as pattern, {key} as match, '{r}' as role, {i} as role_order, \"{r}\" as fragment from ({sql.SELECTS[pattern]}) q{i}" for i, r in enumerate(roles))


over_facts("match_labels", f"select unit, pattern, match, role, role_order, fragment, list_last(string_split(fragment, '.')) as label from ({_bound_sql('Command')})")(lambda f: results.bindings(matches(f, "Command")))
over_facts(
    "role_iris",
    f"select b.unit, b.pattern, b.match, b.role, b.role_order, b.fragment, list_last(string_split(b.fragment, '.')) as label, d.iri from ({_bound_sql('Factory Method')}) b join (values {_ROLE_ROWS}) d(pattern, role, k, iri) on d.pattern = b.pattern and d.role = b.role",
)(lambda f: results.with_iris(results.bindings(matches(f, "Factory Method"))).select("unit", "pattern", "match", "role", "role_order", "fragment", "label", "iri"))
over_facts(
    "occurrence_ordinals",
    f"select unit, 'Decorator' as pattern, \"component\" || '/' || \"concreteComponent\" || '/' || \"decorator\" as roles, row_number() over (partition by unit order by \"component\", \"concreteComponent\", \"decorator\") as match_id from ({sql.SELECTS['Decorator']})",
)(lambda f: results.ordinals(matches(f, "Decorator")).select("unit", "pattern", F.array_join(F.transform("roles", lambda r: r["fragment"]), "/").alias("roles"), "match_id"))


def _locations(f: Facts) -> DataFrame:
    """A place for each type of the motif facts, in two files; the earlier file wins."""
    types = f.table.where("p = 'hasMethod'").select("unit", F.col("s").alias("fragment"), "o")
    return results.first_locations(types.select("unit", "fragment", F.concat("o", F.lit(".cs")).alias("file"), F.length("o").alias("file_order"), F.length("fragment").alias("start_line"), (F.length("fragment") + 4).alias("end_line")))


over_facts(
    "match_locations",
    f"select b.unit, b.pattern, b.match, b.role, b.role_order, b.fragment, list_last(string_split(b.fragment, '.')) as label, l.file, l.start_line::int as start_line, l.end_line::int as end_line from ({_bound_sql('Composite')}) b "
    "left join (select unit, t, m || '.cs' as file, length(t) as start_line, length(t) + 4 as end_line from (select *, row_number() over (partition by unit, t order by length(m), m || '.cs') as k from meth) where k = 1) l on l.unit = b.unit and l.t = b.fragment",
)(lambda f: results.with_locations(results.bindings(matches(f, "Composite")), _locations(f)))

over_facts(
    "findings_triples",
    f"""select distinct unit, s, p, o, kind from (
        select unit, pattern, match, role, fragment, 'occurrence-Proxy-' || id as occ from (select *, dense_rank() over (partition by unit order by match) as id from ({_bound_sql('Proxy')})) ) b,
        lateral (values ('scan', 'hasOccurrence', occ, 'iri'), (occ, 'type', 'PatternOccurrence', 'iri'), (occ, 'patternName', pattern, 'string'), (occ, 'pattern', '{vocab.FDP}Proxy', 'iri'),
            (occ, 'hasRole', occ || '-' || role, 'iri'), (occ || '-' || role, 'type', 'RoleBinding', 'iri'), (occ || '-' || role, 'role', role, 'string'), (occ || '-' || role, 'filledBy', fragment, 'iri'), (fragment, 'label', list_last(string_split(fragment, '.')), 'string'),
            (occ || '-' || role, 'playsRole', '{vocab.FDP}' || case role when 'subject' then 'ProxyServiceInterface' when 'realSubject' then 'ProxyService' else 'ProxyProxy' end, 'iri')) t(s, p, o, kind)""",
)(lambda f: _findings(f))


def _findings(f: Facts) -> DataFrame:
    from .sinks import findings

    return findings.occurrence_triples(results.reported(matches(f, "Proxy")))


@registered("sarif_results")
def _sarif(spark, sf_dir):
    from .sinks import sarif

    f = facts_for(spark, sf_dir)
    return sarif.results(results.reported(matches(f, "Proxy"), _locations(f)))


_TERMS_SQL = ", ".join(f"'{x}'" for x in (*vocab.TYPE_KINDS, *vocab.MEMBER_KINDS, *vocab.MODIFIERS))


@registered(
    "turtle_dump",
    sql.over_motifs(f"""select unit, s, '<{vocab.SCAN}' || s || '> ' || string_agg(line, ' ;' || chr(10) || '    ' order by line) || ' .' as turtle from (
        select distinct unit, s, case when p = 'type' then 'a ' else 'src:' || p || ' ' end || case when p in ('type', 'hasModifier') and o in ({_TERMS_SQL}) then 'src:' || o else '<{vocab.SCAN}' || o || '>' end as line from facts) group by unit, s"""),
)
def _turtle(spark, sf_dir):
    from .sinks import turtle

    return turtle.subjects(facts_for(spark, sf_dir).table)


@registered("top3_slowest", "select l_shipmode as unit, l_name as pattern, seconds, place from (select l_returnflag as l_shipmode, l_linestatus || l_linenumber as l_name, round(sum(l_quantity), 6) as seconds, row_number() over (partition by l_returnflag order by round(sum(l_quantity), 6) desc, l_linestatus || l_linenumber) as place from lineitem group by 1, 2) where place <= 3")
def _top3(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("unit"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("pattern")).agg(F.round(F.sum("l_quantity"), 6).alias("seconds"))
    return results.slowest(rows, ["unit"], "pattern", "seconds").select("unit", "pattern", "seconds", F.col("place").cast("long").alias("place"))


# Evaluation, over labelled documents: what is labelled good is expected, a rule on length detects, what is labelled toxic is dropped by review

_NAMES_SQL = "[" + ", ".join(f"'{p}'" for p in vocab.PATTERNS) + "]"
_EVAL = f"""with d as (select d.doc_id, source as corpus, n_chars, quality, toxic, ({_NAMES_SQL})[(d.doc_id % {len(vocab.PATTERNS)} + 1)::int] as pattern from documents d join labels l on l.doc_id = d.doc_id),
e as (select distinct corpus, doc_id, pattern from d where quality = 1), s as (select corpus, doc_id, pattern, n_chars % 5 + 1 as match_rows, toxic from d where n_chars % 3 <> 0),
b as (select coalesce(e.corpus, s.corpus) as corpus, coalesce(e.pattern, s.pattern) as pattern, coalesce(e.doc_id, s.doc_id) as unit, (e.doc_id is not null)::int as e, (s.doc_id is not null)::int as s, (s.doc_id is not null and s.toxic = 0)::int as r, match_rows
      from e full join s on e.corpus = s.corpus and e.doc_id = s.doc_id and e.pattern = s.pattern),
counts as (select c.corpus, p.pattern, coalesce(sum(b.e * b.s), 0)::bigint as tp, coalesce(sum((1 - b.e) * b.s), 0)::bigint as fp, coalesce(sum(b.e * (1 - b.s)), 0)::bigint as fn, coalesce(sum(match_rows), 0)::bigint as match_rows
      from (select distinct corpus from d) c cross join (select unnest({_NAMES_SQL}) as pattern) p left join b on b.corpus = c.corpus and b.pattern = p.pattern group by 1, 2),
u as (select corpus, unit, sum(e * s)::bigint as tp_before, sum((1 - e) * s)::bigint as fp_before, sum(e * (1 - s))::bigint as fn_before, sum(e * r)::bigint as tp_after, sum((1 - e) * r)::bigint as fp_after, sum(e * (1 - r))::bigint as fn_after from b group by 1, 2)
"""
_RATES = "round(tp / nullif(tp + fp, 0), 9) as precision, round(tp / nullif(tp + fn, 0), 9) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) as f1"


def _labelled(spark, sf_dir) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    table = F.array(*[F.lit(p) for p in vocab.PATTERNS])
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(labels, "doc_id")
    return rows.select(F.col("source").alias("corpus"), F.col("doc_id").alias("unit"), "n_chars", "quality", "toxic", F.element_at(table, (F.col("doc_id") % len(vocab.PATTERNS) + 1).cast("int")).alias("pattern"))


def _expected(d: DataFrame) -> DataFrame:
    return d.where("quality = 1").select("corpus", "unit", "pattern")


def _structural(d: DataFrame) -> DataFrame:
    return d.where("n_chars % 3 <> 0").select("corpus", "unit", "pattern", (F.col("n_chars") % 5 + 1).alias("match_rows"), "toxic")


def _counts(spark, sf_dir) -> DataFrame:
    d = _labelled(spark, sf_dir)
    return evaluation.confusion(_expected(d), _structural(d), d.select("corpus"))


def _outcomes(spark, sf_dir) -> DataFrame:
    d = _labelled(spark, sf_dir)
    found = F.array_compact
    one = lambda c: found(F.array(F.when(c, F.col("pattern"))))
    rows = d.select("corpus", "unit", one(F.col("quality") == 1).alias("labeled"), one(F.col("n_chars") % 3 != 0).alias("structural"), one((F.col("n_chars") % 3 != 0) & (F.col("toxic") == 0)).alias("detected"))
    return evaluation.unit_counts(rows).where("size(labeled) + size(structural) > 0")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


_R = ("precision", "recall", "f1")
registered("confusion", _EVAL + "select * from counts")(_counts)
registered("precision_recall_f1", _EVAL + f"select *, {_RATES} from counts")(lambda s, d: _rounded(evaluation.rated(_counts(s, d)), *_R))
registered("macro_avg", _EVAL + "select corpus, round(avg(tp / nullif(tp + fp, 0)), 9) as precision, round(avg(tp / nullif(tp + fn, 0)), 9) as recall, round(avg(2 * tp / nullif(2 * tp + fp + fn, 0)), 9) as f1 from counts group by corpus")(
    lambda s, d: _rounded(evaluation.macro(_counts(s, d), ["corpus"]), *_R)
)
registered("micro_avg", _EVAL + f"select corpus, tp, fp, fn, {_RATES} from (select corpus, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from counts group by corpus)")(
    lambda s, d: _rounded(evaluation.micro(_counts(s, d), ["corpus"]), *_R)
)
registered("pooled_rollup", _EVAL + "select corpus, pattern, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, sum(match_rows)::bigint as match_rows from counts group by grouping sets ((corpus, pattern), (pattern))")(
    lambda s, d: evaluation.pooled(_counts(s, d))
)
registered(
    "baseline_compare",
    _EVAL + f"""select c.pattern, c.f1 as current_f1, b.f1 as baseline_f1, round(c.f1 - b.f1, 9) as delta, coalesce(c.f1 < b.f1 - 1e-9, false) as fell
    from (select pattern, round(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 9) as f1 from counts where corpus <> 'src0' group by pattern) c
    left join (select pattern, round(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 9) as f1 from counts where corpus = 'src0' group by pattern) b on b.pattern = c.pattern""",
)(lambda s, d: _rounded(evaluation.compare(*[_rounded(evaluation.micro(_counts(s, d).where(w), ["pattern"]), "f1") for w in ("corpus <> 'src0'", "corpus = 'src0'")]), "delta"))
registered("unit_set_ops", _EVAL + "select * from u")(lambda s, d: _outcomes(s, d).drop("labeled", "structural", "detected"))


def _jack_sql() -> str:
    rate = {"precision": "{p}tp_{s} / nullif({p}tp_{s} + {p}fp_{s}, 0)", "recall": "{p}tp_{s} / nullif({p}tp_{s} + {p}fn_{s}, 0)", "f1": "2 * {p}tp_{s} / nullif(2 * {p}tp_{s} + {p}fp_{s} + {p}fn_{s}, 0)"}
    columns = [f"{k}_{s}" for k in ("tp", "fp", "fn") for s in ("before", "after")]
    rest = ", ".join(f"sum({c}) over (partition by corpus) - {c} as {c}" for c in columns)
    sums = ", ".join(f"sum({c}) as {c}" for c in columns)
    parts = []
    for name, x in rate.items():
        b, a = x.format(p="", s="before"), x.format(p="", s="after")
        parts.append(
            f"select t.corpus, '{name}' as metric, round(bv, 9) as before, round(av, 9) as after, round(av - bv, 9) as delta, round(av - bv - 1.959964 * case when n >= 2 then sqrt((n - 1) * v) end, 9) as lower, round(av - bv + 1.959964 * case when n >= 2 then sqrt((n - 1) * v) end, 9) as upper "
            f"from (select corpus, {b} as bv, {a} as av from (select corpus, {sums} from u group by corpus)) t join (select corpus, count(x) as n, var_pop(x) as v from (select corpus, {a} - ({b}) as x from (select corpus, {rest} from u)) group by corpus) k on k.corpus = t.corpus"
        )
    return _EVAL + " union all ".join(parts)


registered("jackknife_ci", _jack_sql())(lambda s, d: _rounded(evaluation.jackknife(_outcomes(s, d), ["corpus"]), "before", "after", "delta", "lower", "upper"))
registered("before_after", _EVAL + "select corpus, sum(tp_before)::bigint as tp_before, sum(tp_after)::bigint as tp_after, round(2 * sum(tp_before) / nullif(2 * sum(tp_before) + sum(fp_before) + sum(fn_before), 0), 9) as f1_before, round(2 * sum(tp_after) / nullif(2 * sum(tp_after) + sum(fp_after) + sum(fn_after), 0), 9) as f1_after from u group by corpus")(
    lambda s, d: _rounded(evaluation.before_after(_outcomes(s, d), ["corpus"]).select("corpus", "tp_before", "tp_after", "f1_before", "f1_after"), "f1_before", "f1_after")
)


@registered("motif_scores", sql.over_motifs("select 1").replace("with recursive", f"with recursive {motifs.units_sql()},", 1).rsplit("select * from (select 1) q", 1)[0] + f"""
    select corpus, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from (
        select coalesce(e.corpus, f.corpus) as corpus, (e.unit is not null and f.unit is not null)::int as tp, (e.unit is null)::int as fp, (f.unit is null)::int as fn
        from (select corpus, unit, expected from units where expected is not null) e
        full join (select distinct u.corpus, m.unit, m.pattern from ({" union all ".join(f"select unit, '{p}' as pattern from ({s}) q{i}" for i, (p, s) in enumerate(sql.SELECTS.items()))}) m join units u on u.unit = m.unit) f
        on f.unit = e.unit and f.pattern = e.expected) group by corpus""")
def _motif_scores(spark, sf_dir):
    units = motifs.units_of(spark, sf_dir)
    found = evaluation.detected_sets(complete(facts_for(spark, sf_dir))).join(units.select("corpus", "unit"), "unit")
    expected = units.where("expected is not null").select("corpus", "unit", F.col("expected").alias("pattern"))
    counts = evaluation.confusion(expected, found, units.select("corpus"))
    return counts.groupBy("corpus").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


_KEYS_SQL = "(values " + ", ".join(f"('{p.replace(' ', '').lower()}', '{p}')" for p in vocab.PATTERNS) + ") k(letters, pattern)"
_SPELLED = "(values " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(vocab.PATTERNS)) + ") v(i, p)"


def _spelled(spark, sf_dir) -> DataFrame:
    table = F.array(*[F.lit(p) for p in vocab.PATTERNS])
    name = F.element_at(table, (F.col("p_partkey") % len(vocab.PATTERNS) + 1).cast("int"))
    style = F.col("p_partkey") % 4
    spelled = F.when(style == 0, F.upper(F.replace(name, F.lit(" "), F.lit("_")))).when(style == 1, F.replace(name, F.lit(" "), F.lit("-"))).when(style == 2, F.concat(F.lit("12 "), name)).otherwise(F.concat(name, F.lit("x")))
    return read(spark, sf_dir, "part").select("p_partkey", spelled.alias("spelled"))


_SPELL_SQL = f"select p_partkey, case p_partkey % 4 when 0 then upper(replace(p, ' ', '_')) when 1 then replace(p, ' ', '-') when 2 then '12 ' || p else p || 'x' end as spelled from part join {_SPELLED} on v.i = p_partkey % {len(vocab.PATTERNS)}"
registered("normalize_names", f"select p_partkey, spelled, k.pattern from ({_SPELL_SQL}) left join {_KEYS_SQL} on k.letters = lower(regexp_replace(spelled, '[^a-zA-Z]', '', 'g'))")(
    lambda s, d: _spelled(s, d).select("p_partkey", "spelled", names.pattern_of(F.col("spelled")).alias("pattern"))
)
registered("dotted_names", f"select p_partkey, 'Some.' || spelled || '.Conceptual' as dotted, k.pattern from ({_SPELL_SQL}) left join {_KEYS_SQL} on k.letters = lower(regexp_replace(spelled, '[^a-zA-Z]', '', 'g'))")(
    lambda s, d: _spelled(s, d).select("p_partkey", F.concat(F.lit("Some."), "spelled", F.lit(".Conceptual")).alias("dotted")).withColumn("pattern", names.pattern_of_dotted(F.col("dotted")))
)


# Review

def _key(prefix: Column) -> Column:
    return review.cache_key(F.lit("model"), F.lit("system"), prefix, F.split("text", " "), F.col("text"))


_KEY_SQL = "sha256('model' || 'system' || source || array_to_string(list_sort(string_split(text, ' ')), ',') || text)"
registered("cache_key_sha256", f"select doc_id, {_KEY_SQL} as key from documents where text is not null and source is not null")(
    lambda s, d: read(s, d, "documents").where("text is not null and source is not null").select("doc_id", _key(F.col("source")).alias("key"))
)
_VERDICTS = "select conv_id, turn, text, case (conv_id + turn) % 5 when 0 then 'note {\"verdict\": \"confirmed\", \"rationale\": \"r' || conv_id || '\"} end' when 1 then '{\"verdict\": \"Rejected\", \"rationale\": \"no\"}' when 2 then '{\"verdict\": \"maybe\"}' when 3 then 'no json' else '{\"verdict\": \"uncertain\"}' end as reply from conversations"


def _replies(spark, sf_dir) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % 5
    text = F.when(k == 0, F.concat(F.lit('note {"verdict": "confirmed", "rationale": "r'), F.col("conv_id").cast("string"), F.lit('"} end'))).when(k == 1, '{"verdict": "Rejected", "rationale": "no"}').when(k == 2, '{"verdict": "maybe"}').when(k == 3, "no json").otherwise('{"verdict": "uncertain"}')
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", text.alias("reply"))


_PARSED_SQL = f"select conv_id, turn, case (conv_id + turn) % 5 when 0 then 'confirmed' when 1 then 'rejected' else 'uncertain' end as outcome, case (conv_id + turn) % 5 when 0 then 'r' || conv_id when 1 then 'no' else '' end as rationale from ({_VERDICTS})"
registered("verdict_parse", _PARSED_SQL)(lambda s, d: _replies(s, d).select("conv_id", "turn", review.parsed(F.col("reply")).alias("v")).select("conv_id", "turn", "v.outcome", "v.rationale"))
registered("drop_rejected", f"select conv_id, turn, outcome from ({_PARSED_SQL}) where outcome <> 'rejected'")(
    lambda s, d: _replies(s, d).select("conv_id", "turn", review.parsed(F.col("reply"))["outcome"].alias("outcome")).where(~F.coalesce(F.col("outcome") == "rejected", F.lit(False)))
)


def _reviewed(spark, sf_dir):
    """Candidates made of labelled documents; a cache that knows those of even id; a model that rejects long ones."""
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").where("text is not null")
    rows = docs.select(F.col("doc_id").cast("string").alias("unit"), F.lit("Proxy").alias("pattern"), F.lit(1).cast("long").alias("match_id"), F.array(F.col("doc_id").cast("string")).alias("fragments"), F.lit("system").alias("system"), F.concat(F.lit("n="), F.col("n_chars").cast("string")).alias("prompt"), F.when(F.col("doc_id") % 7 != 0, F.col("doc_id").cast("string")).alias("source"))
    key = review.cache_key(F.lit("scripted"), F.col("system"), F.col("pattern"), F.col("fragments"), F.col("source"))
    cache = rows.where("source is not null and cast(unit as bigint) % 2 = 0").select(key.alias("key"), F.lit("confirmed").alias("outcome"), F.lit("known").alias("rationale"), F.lit("scripted").alias("model"))
    model = review.ScriptedModel(lambda p: '{"verdict": "%s", "rationale": "by length"}' % ("rejected" if int(p[2:]) % 4 == 0 else "confirmed" if int(p[2:]) % 4 < 3 else "x"))
    return review.review(rows, cache, model)


_REVIEW_SQL = "with c as (select distinct d.doc_id, n_chars, case when d.doc_id % 7 = 0 then null when d.doc_id % 2 = 0 then 'confirmed' when n_chars % 4 = 0 then 'rejected' when n_chars % 4 < 3 then 'confirmed' else 'uncertain' end as outcome, d.doc_id % 7 <> 0 and d.doc_id % 2 = 0 as hit from documents d join labels l on l.doc_id = d.doc_id where text is not null) "
registered("cache_hit_miss", _REVIEW_SQL + "select doc_id::varchar as unit, hit, outcome from c where outcome is distinct from 'rejected'")(lambda s, d: _reviewed(s, d)[0].select("unit", F.coalesce("hit", F.lit(False)).alias("hit"), "outcome"))
registered(
    "review_tally",
    _REVIEW_SQL + "select count(outcome)::bigint as reviewed, count_if(outcome = 'confirmed')::bigint as confirmed, count_if(outcome = 'uncertain')::bigint as uncertain, count_if(outcome = 'rejected')::bigint as rejected, count_if(outcome = 'rejected')::bigint as dropped, count_if(outcome is null)::bigint as unreviewed, count_if(hit)::bigint as cache_hits, (100 * count_if(outcome is not null and not hit))::bigint as tokens_in, (20 * count_if(outcome is not null and not hit))::bigint as tokens_out from c",
)(lambda s, d: _reviewed(s, d)[1].drop("failure"))


@registered("excerpt_lines", "select doc_id::varchar as file, n as start_line, n as end_line, l[n] as excerpt from (select doc_id, string_split(text, chr(10)) as l, (doc_id % 5 + 1)::int as n from documents where text is not null) where n <= len(l)")
def _excerpts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n")).alias("k", "text")).select("file", (F.col("k") + 1).alias("line"), "text")
    n = (F.col("doc_id") % 5 + 1).cast("int")
    return review.excerpts(lines, docs.select(F.col("doc_id").cast("string").alias("file"), n.alias("start_line"), n.alias("end_line")))


from . import queries_sources  # noqa: E402, F401
