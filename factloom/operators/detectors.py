"""The 23 collaboration queries: Facts -> distinct role tuples (unit and one column for each role).

Overriding members are recognised by what they return, not by name.  Variables
that only witness existence are projected away early, so rows don't multiply.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from ..vocab import ROLES
from .algebra import join, pair, union, without

DETECTORS: dict[str, Callable[[Facts], DataFrame]] = {}


def detector(pattern: str):
    """Register a query under a pattern; its result is projected to the pattern's roles, distinct."""

    def wrap(query):
        def run(facts: Facts) -> DataFrame:
            return query(facts).select("unit", *ROLES[pattern]).distinct()

        run.__doc__ = query.__doc__
        DETECTORS[pattern] = run
        return run

    return wrap


def _typed(members: DataFrame, f: Facts, owner: str, member: str, kind: str) -> DataFrame:
    """(owner, kind): owners with a member of the type."""
    return join(members, f.ret(member, kind)).select("unit", owner, kind).distinct()


@detector("Abstract Factory")
def abstract_factory(f: Facts) -> DataFrame:
    """One factory type declares operations for two products; a subtype's overrides create subtypes of both."""
    products = pair(f.abstract_op("factory", "p"), "p", "productA", "productB")
    makes = join(f.overrides("concreteFactory", "m", "p"), f.inst("m", "made"), f.ext("made", "p")).select("unit", "concreteFactory", "p").distinct()
    makes = join(makes, f.ext("concreteFactory", "factory"))
    return join(products, makes.withColumnRenamed("p", "productA"), makes.withColumnRenamed("p", "productB"))


@detector("Adapter")
def adapter(f: Facts) -> DataFrame:
    """A subtype answers the target's operation by delegating to its only field of a type outside the target's family."""
    held = join(f.fld("adapter", "field"), f.ret("field", "adaptee"), f.kind("adaptee", "Class", "Interface"))
    base = join(f.conform("target", "adapter", "r"), f.overrides("adapter", "o", "r"), f.dele("o", "field"), held).select("unit", "target", "adapter", "adaptee", "field").distinct()
    base = base.where("adaptee <> target")
    base = without(base, f.reach("adaptee", "target"))
    base = without(base, held.select("unit", "adapter", F.col("field").alias("other")), "other <> field")
    base = without(base, join(f.slot("adapter", "h"), f.targ("h", "target")))
    outsiders = without(join(f.fld("invoker", "x"), f.ret("x", "target")), f.ext("invoker", "target"))
    base = without(base, outsiders.select("unit", "target"))
    return without(base, join(f.meth("adaptee", "k"), f.inst("k", "adapter")))


@detector("Bridge")
def bridge(f: Facts) -> DataFrame:
    """An extended class delegates to a field of an abstraction from another family that has conforming subtypes."""
    held = join(f.fld("abstraction", "x"), f.ret("x", "implementor"), f.meth("abstraction", "m"), f.dele("m", "x")).select("unit", "abstraction", "implementor").distinct()
    held = without(held.where("abstraction <> implementor"), f.ext("abstraction", "implementor"))
    return join(held, f.conforming("implementor", "concreteImplementor"), f.ext("refinedAbstraction", "abstraction"))


@detector("Builder")
def builder(f: Facts) -> DataFrame:
    """A type of two abstract steps or more; a subtype has methods that create and that return one class."""
    steps = f.method_with("builder", "s", "Abstract").groupBy("unit", "builder").agg(F.countDistinct("s").alias("steps")).where("steps >= 2").select("unit", "builder")
    creates = join(f.meth("concreteBuilder", "k"), f.inst("k", "product"), f.kind("product", "Class")).select("unit", "concreteBuilder", "product").distinct()
    returns = _typed(f.meth("concreteBuilder", "m"), f, "concreteBuilder", "m", "product")
    return join(steps, f.ext("concreteBuilder", "builder"), creates, returns)


@detector("Chain of Responsibility")
def chain_of_responsibility(f: Facts) -> DataFrame:
    """Handlers hold and use a successor of their own abstraction, in the handler itself or in an extended link."""
    used = join(f.ret("s", "handler"), f.dele("_user", "s").select("unit", "s").distinct())
    conforming = join(f.abstract_op("handler", "r"), f.overriding("concreteHandler", "r")).select("unit", "handler", "concreteHandler").distinct()
    own = without(join(f.slot("handler", "s"), used), f.mod("s", "Static")).select("unit", "handler").distinct()
    first = join(conforming, own, f.ext("concreteHandler", "handler"))
    plain = without(join(f.ext("p", "handler"), f.method_with("p", "q", "Override")), f.fld("p", "x"))
    links = without(join(f.ext("link", "handler"), f.slot("link", "s"), used), f.mod("s", "Static")).select("unit", "handler", "link").distinct()
    links = without(links, plain.select("unit", "handler"))
    second = join(links, f.ext("concreteHandler", "link"), conforming).where("concreteHandler <> link")
    return union(first, second.select("unit", "handler", "concreteHandler"))


@detector("Command")
def command(f: Facts) -> DataFrame:
    """A conforming subtype delegates to a receiver class it holds; an outside class stores and triggers the abstraction."""
    acts = join(f.conform("command", "concreteCommand", "r"), f.overrides("concreteCommand", "o", "r"), f.dele("o", "x"), f.fld("concreteCommand", "x"), f.ret("x", "receiver"), f.kind("receiver", "Class"))
    acts = acts.select("unit", "command", "concreteCommand", "receiver").distinct().where("receiver <> command")
    acts = without(acts, f.ext("receiver", "command"))
    acts = without(acts, _typed(f.fld("receiver", "b"), f, "receiver", "b", "command"))
    acts = without(acts, join(f.meth("concreteCommand", "k"), f.inst("k", "receiver")))
    triggers = join(f.kind("invoker", "Class"), f.fld("invoker", "c"), f.ret("c", "command"), f.meth("invoker", "t"), f.dele("t", "c")).select("unit", "invoker", "command").distinct()
    triggers = without(triggers.where("invoker <> command"), f.ext("invoker", "command"))
    return join(acts, triggers)


def _open_op(f: Facts, t: str, r: str) -> DataFrame:
    """Types with an abstract or virtual method that returns r."""
    return join(f.method_with(t, "_m", "Abstract", "Virtual"), f.ret("_m", r)).select("unit", t, r).distinct()


@detector("Composite")
def composite(f: Facts) -> DataFrame:
    """Two subtypes override one operation; one of them holds a collection of the component, the other doesn't."""
    op = _open_op(f, "component", "r")
    collection = join(f.slot("t", "h"), f.targ("h", "component")).select("unit", "t", "component").distinct()
    children = join(op, f.ext("t", "component"), f.overriding("t", "r"))
    inner = join(children, collection).withColumnRenamed("t", "composite")
    leaves = without(children, collection).withColumnRenamed("t", "leaf")
    return join(inner, leaves).where("leaf <> composite")


@detector("Decorator")
def decorator(f: Facts) -> DataFrame:
    """A subtype wraps one component and it, or a type below it, delegates an override to what is wrapped."""
    op = _open_op(f, "component", "r")
    wraps = join(f.ext("decorator", "component"), f.slot("decorator", "w"), f.ret("w", "component"))
    own = wraps.select("unit", "decorator").distinct().withColumn("h", F.col("decorator"))
    below = union(own, f.reach("h", "decorator")).distinct()
    forwards = join(wraps, below, f.dele("o", "w"), f.overrides("h", "o", "r"), op).select("unit", "component", "decorator", "r").distinct()
    for members in (f.fld("decorator", "a"), f.prop("decorator", "a")):
        twice = join(members, f.ret("a", "component")).groupBy("unit", "decorator", "component").agg(F.countDistinct("a").alias("n")).where("n >= 2").drop("n")
        forwards = without(forwards, twice)
    plain = join(op, f.ext("concreteComponent", "component"), f.overriding("concreteComponent", "r"))
    plain = without(plain, _typed(f.fld("concreteComponent", "x"), f, "concreteComponent", "x", "component"))
    return join(forwards, plain).where("concreteComponent <> decorator")


@detector("Facade")
def facade(f: Facts) -> DataFrame:
    """A class without bases delegates to fields of two classes."""
    parts = join(f.kind("facade", "Class"), f.fld("facade", "x"), f.ret("x", "part"), f.kind("part", "Class"), f.meth("facade", "m"), f.dele("m", "x"))
    parts = without(parts.select("unit", "facade", "part").distinct().where("part <> facade"), f.ext("facade", "_b"))
    return pair(parts, "part", "subsystemA", "subsystemB")


@detector("Factory Method")
def factory_method(f: Facts) -> DataFrame:
    """A subtype overrides a creation operation and creates a product below the declared one."""
    declared = join(f.method_with("creator", "factoryMethod", "Abstract"), f.ret("factoryMethod", "product"))
    makes = join(f.ext("concreteCreator", "creator"), f.overrides("concreteCreator", "o", "product"), f.inst("o", "concreteProduct"), f.reach("concreteProduct", "product"))
    rows = join(declared, makes.select("unit", "creator", "concreteCreator", "product", "concreteProduct").distinct()).where("creator <> product")
    rows = without(rows, _typed(f.fld("concreteProduct", "x"), f, "concreteProduct", "x", "concreteCreator"))
    other = join(f.abstract_op("creator", "other"), f.ext("_a", "other").select("unit", "other").distinct())
    return without(rows, other, "other <> product")


@detector("Flyweight")
def flyweight(f: Facts) -> DataFrame:
    """A class whose state is set once is pooled and created by an outside factory."""
    state = join(f.kind("flyweight", "Class"), f.fld("flyweight", "i"))
    fixed = union(join(state, f.mod("i", "ReadOnly")), join(state, f.ctor("flyweight", "k"), f.asg("k", "i")).select("unit", "flyweight", "i")).distinct()
    fixed = without(fixed, join(f.meth("flyweight", "m"), f.asg("m", "i"))).select("unit", "flyweight").distinct()
    pools = join(f.fld("flyweightFactory", "p"), f.targ("p", "flyweight")).select("unit", "flyweightFactory", "flyweight").distinct()
    gives = join(f.meth("flyweightFactory", "g"), f.ret("g", "flyweight"), f.inst("g", "flyweight")).select("unit", "flyweightFactory", "flyweight").distinct()
    return without(join(fixed, pools, gives).where("flyweightFactory <> flyweight"), f.ext("flyweightFactory", "flyweight"))


@detector("Interpreter")
def interpreter(f: Facts) -> DataFrame:
    """A conforming subtype holds two expressions; another holds none."""
    families = f.conform("expression", "t", "r")

    def holders(members):
        return join(members, f.ret("x", "expression"))

    twice = union(*[holders(m).groupBy("unit", "t", "expression").agg(F.countDistinct("x").alias("n")).where("n >= 2").drop("n") for m in (f.fld("t", "x"), f.prop("t", "x"))]).distinct()
    inner = join(families, twice).withColumnRenamed("t", "nonterminalExpression")
    ends = join(f.ext("t", "expression"), f.overriding("t", "r"))
    ends = without(ends, union(holders(f.fld("t", "x")), holders(f.prop("t", "x")))).withColumnRenamed("t", "terminalExpression")
    return join(inner, ends).where("terminalExpression <> nonterminalExpression")


@detector("Iterator")
def iterator(f: Facts) -> DataFrame:
    """A conforming iterator holds the aggregate class that creates it and returns it as the iterator or a base of it."""
    holds = join(f.conforming("iterator", "concreteIterator"), f.fld("concreteIterator", "x"), f.ret("x", "aggregate"), f.kind("aggregate", "Class")).drop("x").distinct()
    holds = without(holds.where("aggregate <> iterator and aggregate <> concreteIterator"), f.ext("aggregate", "iterator"))
    creates = join(f.meth("aggregate", "c"), f.inst("c", "concreteIterator"))
    shown = union(f.ret("c", "iterator"), join(f.ret("c", "b"), f.ext("iterator", "b")).select("unit", "c", "iterator"))
    return join(holds, creates, shown)


@detector("Mediator")
def mediator(f: Facts) -> DataFrame:
    """A conforming mediator holds two classes that each delegate to a member of the mediator's type."""
    knows = join(f.ret("x", "mediator"), f.dele("p", "x"), f.meth("colleague", "p")).select("unit", "mediator", "colleague").distinct()
    knows = without(join(knows, f.kind("colleague", "Class")).where("colleague <> mediator"), f.ext("colleague", "mediator"))
    held = _typed(f.fld("concreteMediator", "x"), f, "concreteMediator", "x", "colleague")
    rows = join(f.conforming("mediator", "concreteMediator"), held, knows).select("unit", "mediator", "concreteMediator", "colleague").distinct()
    return pair(rows, "colleague", "colleagueA", "colleagueB")


@detector("Memento")
def memento(f: Facts) -> DataFrame:
    """A class saves itself into a memento and restores itself from one; a caretaker keeps mementos and makes none."""
    saves = join(f.kind("originator", "Class"), f.meth("originator", "s"), f.ret("s", "memento"), f.inst("s", "made"), f.same_or_ext("made", "memento"))
    saves = saves.where("originator <> memento and originator <> made").select("unit", "originator", "memento", "s").distinct()
    restores = join(f.meth("originator", "r"), f.par("r", "memento"), f.asg("r", "_x").select("unit", "r").distinct())
    rows = join(saves, restores).where("r <> s").select("unit", "originator", "memento").distinct()
    keeps = join(f.fld("caretaker", "h"), f.targ("h", "memento")).select("unit", "caretaker", "memento").distinct()
    makes = join(f.meth("caretaker", "c"), f.inst("c", "made"), f.same_or_ext("made", "memento"))
    return without(join(rows, keeps).where("caretaker <> originator"), makes)


@detector("Observer")
def observer(f: Facts) -> DataFrame:
    """A class collects, attaches and notifies observers of an abstraction it neither belongs to nor creates."""
    collects = join(f.kind("subject", "Class"), f.fld("subject", "x"), f.targ("x", "observer")).select("unit", "subject", "observer").distinct()
    notifies = join(f.meth("subject", "n"), f.inv("n", "observer")).select("unit", "subject", "observer").distinct()
    attaches = join(f.meth("subject", "a"), f.par("a", "observer")).select("unit", "subject", "observer").distinct()
    rows = without(join(collects, notifies, attaches).where("subject <> observer"), f.reach("subject", "observer"))
    rows = without(rows, join(f.meth("subject", "c"), f.inst("c", "made"), f.ext("made", "observer")))
    return join(rows, f.conforming("observer", "concreteObserver"))


@detector("Prototype")
def prototype(f: Facts) -> DataFrame:
    """A type copies itself: by an overridden operation of its base, by a method of its own type, or as ICloneable."""
    abstract = f.abstract_op("prototype", "r").where("r = prototype").select("unit", "prototype")
    makes = join(f.overrides("concretePrototype", "o", "prototype"), f.inst("o", "concretePrototype"))
    first = join(abstract, f.ext("concretePrototype", "prototype"), makes)
    copies = without(join(f.meth("concretePrototype", "c"), f.kind("concretePrototype", "Class"), f.inst("c", "concretePrototype")), f.mod("c", "Static"))
    owners = f.meth("prototype", "c")
    second = join(copies, f.ret("c", "concretePrototype"), owners)
    cloneable = f.ext("concretePrototype", "b").where("b = 'System.ICloneable'").drop("b")
    third = join(copies, f.ret("c", "r").where("r = 'object'").drop("r"), cloneable, owners)
    return union(*[x.select("unit", "prototype", "concretePrototype") for x in (first, second, third)])


@detector("Proxy")
def proxy(f: Facts) -> DataFrame:
    """A subtype delegates the shared operation to a field of another conforming subtype."""
    real = f.conform("subject", "realSubject", "r")
    wraps = join(f.ext("proxy", "subject"), f.fld("proxy", "w"), f.ret("w", "realSubject"), f.dele("o", "w"), f.overrides("proxy", "o", "r"))
    return join(real, wraps).where("proxy <> realSubject")


@detector("Singleton")
def singleton(f: Facts) -> DataFrame:
    """A class with a private constructor and a static member of its own type."""
    closed = join(f.kind("class", "Class"), f.ctor("class", "k"), f.mod("k", "Private")).select("unit", "class").distinct()
    return join(closed, f.operation("class", "a"), f.mod("a", "Static"), f.ret("a", "class"))


@detector("State")
def state(f: Facts) -> DataFrame:
    """A conforming state creates another state; a context class outside the family holds one."""
    moves = join(f.conforming("state", "concreteState"), f.meth("concreteState", "t"), f.inst("t", "nextState"), f.ext("nextState", "state"))
    moves = moves.drop("t").distinct().where("nextState <> concreteState")
    moves = without(moves, _typed(f.fld("concreteState", "c"), f, "concreteState", "c", "nextState"))
    holds = join(f.kind("context", "Class"), f.fld("context", "x"), f.ret("x", "state")).select("unit", "context", "state").distinct().where("context <> state")
    return join(moves, without(holds, f.ext("context", "state")))


@detector("Strategy")
def strategy(f: Facts) -> DataFrame:
    """A class without subtypes delegates to a held abstraction whose family holds no class and creates no sibling."""
    uses = join(f.kind("context", "Class"), f.fld("context", "x"), f.ret("x", "strategy"), f.meth("context", "m"), f.dele("m", "x")).select("unit", "context", "strategy").distinct()
    uses = without(uses.where("context <> strategy"), f.ext("context", "strategy"))
    uses = without(uses, f.ext("_a", "context"))
    armed = join(f.ext("z", "strategy"), f.fld("z", "r"), f.ret("r", "v"), f.kind("v", "Class")).select("unit", "strategy")
    moving = join(f.ext("z", "strategy"), f.meth("z", "t"), f.inst("t", "n"), f.ext("n", "strategy")).where("n <> z").select("unit", "strategy")
    uses = without(without(uses, armed.distinct()), moving.distinct())
    return join(uses, f.conforming("strategy", "concreteStrategy"))


@detector("Template Method")
def template_method(f: Facts) -> DataFrame:
    """An abstract class's own operation calls its abstract step, which a subtype overrides."""
    head = join(f.kind("abstractClass", "Class"), f.mod("abstractClass", "Abstract"))
    templates = without(without(f.operation("abstractClass", "t"), f.mod("t", "Abstract")), f.mod("t", "Static"))
    steps = join(f.operation("abstractClass", "s"), f.mod("s", "Abstract"), f.ret("s", "r"))
    rows = join(head, templates, f.calls("t", "s"), steps)
    rows = without(rows, join(f.kind("t", "Property"), f.calls("t", "s"), f.kind("s", "Method"))).select("unit", "abstractClass", "r").distinct()
    fills = join(f.ext("concreteClass", "abstractClass"), f.operation("concreteClass", "o"), f.mod("o", "Override"), f.ret("o", "r"))
    return join(rows, without(fills, join(f.inst("o", "x"), f.ext("x", "r"))))


@detector("Visitor")
def visitor(f: Facts) -> DataFrame:
    """A visitor declares a visit for each of two elements; both accept it, and a subtype visits both."""
    accepts = join(f.method_with("element", "ac", "Abstract"), f.par("ac", "visitor")).select("unit", "element", "visitor").distinct().where("visitor <> element")
    taken = join(f.method_with("e", "q", "Override"), f.par("q", "visitor")).select("unit", "e", "visitor").distinct()
    visits = join(f.method_with("visitor", "v", "Abstract"), f.par("v", "e"), f.ext("e", "element"), accepts, taken)
    done = join(f.ext("concreteVisitor", "visitor"), f.method_with("concreteVisitor", "w", "Override"), f.par("w", "e")).select("unit", "concreteVisitor", "visitor", "e").distinct()
    rows = join(visits, done)
    a = rows.select("unit", "visitor", "concreteVisitor", "element", F.col("v").alias("va"), F.col("e").alias("concreteElementA"))
    b = rows.select("unit", "visitor", "concreteVisitor", "element", F.col("v").alias("vb"), F.col("e").alias("concreteElementB"))
    return join(a, b).where("va <> vb and concreteElementA < concreteElementB")


def matches(facts: Facts, pattern: str) -> DataFrame:
    """Matches of one pattern as (unit, pattern, roles array<struct<role, fragment>>), roles in order."""
    rows = DETECTORS[pattern](facts)
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("fragment")) for r in ROLES[pattern]])
    return rows.select("unit", F.lit(pattern).alias("pattern"), roles.alias("roles"))


def detect(facts: Facts, patterns: list[str] | None = None) -> DataFrame:
    """Matches of all patterns, in one table."""
    names = sorted(DETECTORS) if patterns is None else patterns
    return union(*[matches(facts, p) for p in names])
