"""Small fact sets, one for each pattern and for near misses, and tables made of them.

A motif is one unit's facts.  `facts_of` gives every row of `customer` a motif by
its key, so that a table of any size has known matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..vocab import PATTERNS


def _op(t: str, m: str, modifier: str, r: str) -> str:
    return f"{t} hasMethod {m}; {m} hasModifier {modifier}; {m} returnsType {r}; "


def _family(base: str, *subs: str, r: str = "void") -> str:
    """A base with an abstract operation op, and subtypes that override it by `o<sub>`."""
    return _op(base, f"op{base}", "Abstract", r) + "".join(f"{s} extends {base}; " + _op(s, f"o{s}", "Override", r) for s in subs)


def _field(t: str, x: str, kind: str) -> str:
    return f"{t} hasField {x}; {x} returnsType {kind}; "


def _class(*names: str) -> str:
    return "".join(f"{n} type Class; " for n in names)


_composite = _family("Graphic", "Compound", r="string") + "Compound hasField children; children hasTypeArgument Graphic; "
_proxy = _family("Svc", "Real", "Px", r="string") + "oPx delegatesTo w; Px hasField w; "
_observer = _class("Subj") + _family("Obs", "E") + "Subj hasField fs; fs hasTypeArgument Obs; Subj hasMethod n; n invokes Obs; Subj hasMethod at; at hasParameterType Obs; "
_facade = _class("F", "A", "B") + _field("F", "ra", "A") + _field("F", "rb", "B") + "F hasMethod m; m delegatesTo ra; m delegatesTo rb; "
_template = _class("Ab") + "Ab hasModifier Abstract; Ab hasMethod t; t type Method; Ab hasMethod s; s type Method; s hasModifier Abstract; s returnsType void; C extends Ab; " + _op("C", "so", "Override", "void")
_memento = _class("O") + "O hasMethod sv; sv returnsType M; sv instantiates S; S extends M; O hasMethod rs; rs hasParameterType M; rs assignsField st; K hasField h; h hasTypeArgument M; "
_adapter = _family("T", "Ad") + _field("Ad", "fa", "E") + _class("E") + "oAd delegatesTo fa; "
_singleton = _class("Reg") + "Reg hasConstructor k; Reg hasProperty inst; inst hasModifier Static; inst returnsType Reg; "
_strategy = _class("Ctx") + _family("Alg", "Fast", "Slow") + _field("Ctx", "alg", "Alg") + "Ctx hasMethod go; go delegatesTo alg; "
_state = _class("Ctx") + _family("St", "On", "Off") + _field("Ctx", "now", "St") + "On hasMethod flip; flip instantiates Off; "
_command = _class("Btn", "Rcv") + _family("Cmd", "Save") + _field("Save", "rc", "Rcv") + "oSave delegatesTo rc; " + _field("Btn", "cmd", "Cmd") + "Btn hasMethod push; push delegatesTo cmd; "
_decorator = _family("Cmp", "Base", "Dec") + _field("Dec", "inner", "Cmp") + "oDec delegatesTo inner; "
_chain = _family("H", "H1") + _field("H", "nxt", "H") + "H hasMethod pass; pass delegatesTo nxt; "
_factory = _family("Cr", "CrA", r="Prod") + "PrA extends Prod; oCrA instantiates PrA; "
_visitor = (
    "El hasMethod ac; ac hasModifier Abstract; ac hasParameterType V; V hasMethod va; va hasModifier Abstract; va hasParameterType EA; V hasMethod vb; vb hasModifier Abstract; vb hasParameterType EB; "
    "EA extends El; EB extends El; EA hasMethod aa; aa hasModifier Override; aa hasParameterType V; EB hasMethod ab; ab hasModifier Override; ab hasParameterType V; "
    "CV extends V; CV hasMethod wa; wa hasModifier Override; wa hasParameterType EA; "
)
_iterator = _class("Agg") + _family("It", "ItA") + _field("ItA", "src", "Agg") + "Agg hasMethod mk; mk instantiates ItA; "
_mediator = _class("CA", "CB") + _family("Med", "MedA") + _field("MedA", "a", "CA") + _field("MedA", "b", "CB") + _field("CA", "ma", "Med") + _field("CB", "mb", "Med") + "CA hasMethod pa; pa delegatesTo ma; CB hasMethod pb; "
_interpreter = _family("Ex", "Num", "Add") + _field("Add", "l", "Ex")
_flyweight = _class("Fly") + _field("Fly", "st", "string") + "Fly hasMethod use; Pool hasField cache; cache hasTypeArgument Fly; Pool hasMethod get; get returnsType Fly; get instantiates Fly; "
_bridge = _family("Impl", "ImplA") + _field("Abs", "im", "Impl") + "Abs hasMethod run; run delegatesTo im; "
_prototype = _op("Proto", "cl", "Abstract", "Proto") + "Cp extends Proto; Cp hasMethod cc; cc hasModifier Override; cc returnsType Proto; "
_builder = _class("House") + "Bld hasMethod s1; s1 hasModifier Abstract; BldA extends Bld; BldA hasMethod mk; mk instantiates House; BldA hasMethod gt; gt returnsType House; "
_abstract_factory = _op("Fac", "fa", "Abstract", "PA") + _op("Fac", "fb", "Abstract", "PB") + "FacX extends Fac; PAx extends PA; PBx extends PB; " + _op("FacX", "xa", "Override", "PA") + _op("FacX", "xb", "Override", "PB") + "xa instantiates PAx; "

#: Motifs by name; the first of each pattern is a match of it.
MOTIFS: dict[str, tuple[str | None, str]] = {
    "abstract_factory_pos": ("Abstract Factory", _abstract_factory + "xb instantiates PBx"),
    "adapter_pos": ("Adapter", _adapter),
    "bridge_pos": ("Bridge", _bridge + "Ref extends Abs"),
    "builder_pos": ("Builder", _builder + "Bld hasMethod s2; s2 hasModifier Abstract"),
    "chain_pos": ("Chain of Responsibility", _chain),
    "command_pos": ("Command", _command),
    "composite_pos": ("Composite", _composite + "Dot extends Graphic; " + _op("Dot", "oDot", "Override", "string")),
    "decorator_pos": ("Decorator", _decorator),
    "facade_pos": ("Facade", _facade),
    "factory_method_pos": ("Factory Method", _factory),
    "flyweight_pos": ("Flyweight", _flyweight + "st hasModifier ReadOnly"),
    "interpreter_pos": ("Interpreter", _interpreter + _field("Add", "r", "Ex")),
    "iterator_pos": ("Iterator", _iterator + "mk returnsType It"),
    "mediator_pos": ("Mediator", _mediator + "pb delegatesTo mb"),
    "memento_pos": ("Memento", _memento),
    "observer_pos": ("Observer", _observer),
    "prototype_pos": ("Prototype", _prototype + "cc instantiates Cp"),
    "proxy_pos": ("Proxy", _proxy + "w returnsType Real"),
    "singleton_pos": ("Singleton", _singleton + "k hasModifier Private"),
    "state_pos": ("State", _state),
    "strategy_pos": ("Strategy", _strategy),
    "template_pos": ("Template Method", _template + "t calls s"),
    "visitor_pos": ("Visitor", _visitor + "CV hasMethod wb; wb hasModifier Override; wb hasParameterType EB"),
    "abstract_factory_neg": (None, _abstract_factory),
    "adapter_nested_neg": (None, _adapter + "I hasField r; r returnsType T"),
    "adapter_nested_pos": ("Adapter", _adapter + "I hasField r; r returnsType T; I extends T"),
    "bridge_neg": (None, _bridge),
    "builder_neg": (None, _builder),
    "chain_static_neg": (None, _chain + "nxt hasModifier Static"),
    "chain_link_pos": ("Chain of Responsibility", _family("H", "L") + _field("L", "nxt", "H") + "oL delegatesTo nxt; H1 extends L; " + _op("H1", "oH1", "Override", "void")),
    "chain_link_neg": (None, _family("H", "L", "Plain") + _field("L", "nxt", "H") + "oL delegatesTo nxt; H1 extends L; " + _op("H1", "oH1", "Override", "void")),
    "command_neg": (None, _command + "Save hasMethod mk; mk instantiates Rcv"),
    "composite_neg": (None, _composite),
    "decorator_below_pos": ("Decorator", _family("Cmp", "Base") + _field("Dec", "inner", "Cmp") + "Dec extends Cmp; Mid extends Dec; Low extends Mid; " + _op("Low", "oLow", "Override", "void") + "oLow delegatesTo inner"),
    "decorator_neg": (None, _decorator + _field("Dec", "second", "Cmp")),
    "facade_neg": (None, _facade + "F extends X"),
    "factory_method_neg": (None, _factory + _op("Cr", "mk2", "Abstract", "Other") + "OtA extends Other"),
    "flyweight_neg": (None, _flyweight + "st hasModifier ReadOnly; use assignsField st"),
    "interpreter_neg": (None, _interpreter + "Add hasProperty r; r returnsType Ex"),
    "iterator_base_pos": ("Iterator", _iterator + "mk returnsType Seq; It extends Seq"),
    "memento_neg_direct": (None, _memento + "K hasMethod c; c instantiates M"),
    "memento_neg_subtype": (None, _memento + "K hasMethod c; c instantiates S"),
    "observer_neg": (None, _observer + "n instantiates E"),
    "observer_path_neg": (None, _observer + "Subj extends Mid; Mid extends Obs"),
    "prototype_cloneable_pos": ("Prototype", _class("Doc") + "Doc extends System.ICloneable; Doc hasMethod cl; cl returnsType object; cl instantiates Doc"),
    "proxy_neg": (None, _proxy + "w returnsType Svc"),
    "state_neg": (None, _state + _field("On", "other", "Off")),
    "strategy_armed_neg": (None, _strategy + _class("Dep") + _field("Fast", "dep", "Dep")),
    "template_neg": (None, _template),
    "cycle": (None, "A extends B; B extends C; C extends A; D extends A"),
}

NAMES = tuple(MOTIFS)
COUNT = len(NAMES)


def triples(motif: str) -> list[tuple[str, str, str]]:
    """The facts of a motif, in order, without repeats."""
    return list(dict.fromkeys(tuple(x.split()) for x in MOTIFS[motif][1].split(";") if x.strip()))


def rows() -> list[tuple[int, str, str, str]]:
    return [(i, *t) for i, name in enumerate(NAMES) for t in triples(name)]


def motif_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "mid int, s string, p string, o string")


def facts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts (unit, s, p, o): each customer is a unit with the motif of its key."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    # the motif table is a constant of this module
    made = customers.join(F.broadcast(motif_table(spark)), F.pmod("c_custkey", F.lit(COUNT)) == F.col("mid"))
    return made.select(F.col("c_custkey").cast("string").alias("unit"), "s", "p", "o")


def units_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus, unit, expected): the pattern that each customer's motif is labelled with, or null."""
    expected = spark.createDataFrame([(i, MOTIFS[n][0]) for i, n in enumerate(NAMES)], "mid int, expected string")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    made = customers.join(F.broadcast(expected), F.pmod("c_custkey", F.lit(COUNT)) == F.col("mid"))
    return made.select(F.col("c_mktsegment").alias("corpus"), F.col("c_custkey").cast("string").alias("unit"), "expected")


def facts_sql() -> str:
    """The same facts as common table expressions."""
    values = ", ".join(f"({i}, '{s}', '{p}', '{o}')" for i, s, p, o in rows())
    return f"motif(mid, s, p, o) as (values {values}), facts as materialized (select cast(c_custkey as varchar) as unit, m.s, m.p, m.o from customer join motif m on m.mid = c_custkey % {COUNT})"


def units_sql() -> str:
    values = ", ".join(f"({i}, " + (f"'{MOTIFS[n][0]}'" if MOTIFS[n][0] else "null") + ")" for i, n in enumerate(NAMES))
    return f"label(mid, expected) as (values {values}), units as (select c_mktsegment as corpus, cast(c_custkey as varchar) as unit, expected from customer join label on mid = c_custkey % {COUNT})"


assert {m[0] for m in MOTIFS.values() if m[0]} == set(PATTERNS) and COUNT <= 50
