"""SQL forms of the collaboration queries, for checking results on another engine.

They read `facts` and the views below as common table expressions.
"""

from __future__ import annotations

from . import motifs

VIEWS = """
ext as materialized (select distinct unit, s as c, o as b from facts where p = 'extends'),
meth as materialized (select distinct unit, s as t, o as m from facts where p = 'hasMethod'),
prop as materialized (select distinct unit, s as t, o as m from facts where p = 'hasProperty'),
fld as materialized (select distinct unit, s as t, o as m from facts where p = 'hasField'),
ctor as materialized (select distinct unit, s as t, o as m from facts where p = 'hasConstructor'),
slot as materialized (select * from fld union select * from prop),
oper as materialized (select * from meth union select * from prop),
ret as materialized (select distinct unit, s as m, o as r from facts where p = 'returnsType'),
par as materialized (select distinct unit, s as m, o as r from facts where p = 'hasParameterType'),
targ as materialized (select distinct unit, s as m, o as r from facts where p = 'hasTypeArgument'),
inst as materialized (select distinct unit, s as m, o as r from facts where p = 'instantiates'),
inv as materialized (select distinct unit, s as m, o as r from facts where p = 'invokes'),
calls as materialized (select distinct unit, s as m, o as n from facts where p = 'calls'),
dele as materialized (select distinct unit, s as m, o as f from facts where p = 'delegatesTo'),
asg as materialized (select distinct unit, s as m, o as f from facts where p = 'assignsField'),
md as materialized (select distinct unit, s as n, o as x from facts where p = 'hasModifier'),
kind as materialized (select distinct unit, s as n, o as k from facts where p = 'type'),
reach as (select unit, c, b from ext union select r.unit, r.c, e.b from reach r join ext e on e.unit = r.unit and e.c = r.b),
absop as materialized (select meth.unit, t, meth.m, r from meth join md on md.unit = meth.unit and md.n = meth.m and x = 'Abstract' join ret on ret.unit = meth.unit and ret.m = meth.m),
openop as materialized (select distinct meth.unit, t, r from meth join md on md.unit = meth.unit and md.n = meth.m and x in ('Abstract', 'Virtual') join ret on ret.unit = meth.unit and ret.m = meth.m),
ovr as materialized (select meth.unit, t, meth.m, r from meth join md on md.unit = meth.unit and md.n = meth.m and x = 'Override' join ret on ret.unit = meth.unit and ret.m = meth.m),
conf as materialized (select distinct a.unit, a.t as b, e.c as i, a.r from absop a join ext e on e.unit = a.unit and e.b = a.t join ovr o on o.unit = a.unit and o.t = e.c and o.r = a.r),
holds as materialized (select fld.unit, t, fld.m, r from fld join ret on ret.unit = fld.unit and ret.m = fld.m)
"""

#: One select statement for each pattern; columns are unit and the roles.
SELECTS = {
    "Abstract Factory": """
        select distinct a.unit, a.t as "factory", e.c as "concreteFactory", a.r as "productA", b.r as "productB"
        from absop a join absop b on b.unit = a.unit and b.t = a.t and a.r < b.r
        join ext e on e.unit = a.unit and e.b = a.t
        where exists (select 1 from ovr o, inst i, ext q where o.unit = a.unit and o.t = e.c and o.r = a.r and i.unit = a.unit and i.m = o.m and q.unit = a.unit and q.c = i.r and q.b = a.r)
          and exists (select 1 from ovr o, inst i, ext q where o.unit = a.unit and o.t = e.c and o.r = b.r and i.unit = a.unit and i.m = o.m and q.unit = a.unit and q.c = i.r and q.b = b.r)""",
    "Adapter": """
        select distinct c.unit, c.b as "target", c.i as "adapter", h.r as "adaptee"
        from conf c join ovr o on o.unit = c.unit and o.t = c.i and o.r = c.r
        join dele d on d.unit = c.unit and d.m = o.m
        join holds h on h.unit = c.unit and h.t = c.i and h.m = d.f
        where exists (select 1 from kind k where k.unit = c.unit and k.n = h.r and k.k in ('Class', 'Interface'))
          and h.r <> c.b
          and not exists (select 1 from reach x where x.unit = c.unit and x.c = h.r and x.b = c.b)
          and not exists (select 1 from holds g, kind k where g.unit = c.unit and g.t = c.i and g.m <> h.m and k.unit = c.unit and k.n = g.r and k.k in ('Class', 'Interface'))
          and not exists (select 1 from slot s, targ t where s.unit = c.unit and s.t = c.i and t.unit = c.unit and t.m = s.m and t.r = c.b)
          and not exists (select 1 from holds v where v.unit = c.unit and v.r = c.b and not exists (select 1 from ext e where e.unit = v.unit and e.c = v.t and e.b = v.r))
          and not exists (select 1 from meth m, inst i where m.unit = c.unit and m.t = h.r and i.unit = c.unit and i.m = m.m and i.r = c.i)""",
    "Bridge": """
        select distinct h.unit, h.t as "abstraction", e.c as "refinedAbstraction", h.r as "implementor", c.i as "concreteImplementor"
        from holds h join meth m on m.unit = h.unit and m.t = h.t join dele d on d.unit = h.unit and d.m = m.m and d.f = h.m
        join conf c on c.unit = h.unit and c.b = h.r join ext e on e.unit = h.unit and e.b = h.t
        where h.t <> h.r and not exists (select 1 from ext x where x.unit = h.unit and x.c = h.t and x.b = h.r)""",
    "Builder": """
        select distinct e.unit, e.b as "builder", e.c as "concreteBuilder", i.r as "product"
        from ext e join meth k on k.unit = e.unit and k.t = e.c join inst i on i.unit = e.unit and i.m = k.m
        join kind c on c.unit = e.unit and c.n = i.r and c.k = 'Class'
        where exists (select 1 from meth s1, md d1, meth s2, md d2 where s1.unit = e.unit and s1.t = e.b and d1.unit = e.unit and d1.n = s1.m and d1.x = 'Abstract' and s2.unit = e.unit and s2.t = e.b and d2.unit = e.unit and d2.n = s2.m and d2.x = 'Abstract' and s1.m < s2.m)
          and exists (select 1 from meth g, ret r where g.unit = e.unit and g.t = e.c and r.unit = e.unit and r.m = g.m and r.r = i.r)""",
    "Chain of Responsibility": """
        with succ as (select distinct s.unit, s.t, r.r as h from slot s join ret r on r.unit = s.unit and r.m = s.m join dele d on d.unit = s.unit and d.f = s.m
            where not exists (select 1 from md x where x.unit = s.unit and x.n = s.m and x.x = 'Static')),
        plain as (select distinct p.unit, p.b from ext p join meth q on q.unit = p.unit and q.t = p.c join md x on x.unit = p.unit and x.n = q.m and x.x = 'Override'
            where not exists (select 1 from fld f where f.unit = p.unit and f.t = p.c)),
        pairs as (select distinct h.unit, h.t as h, o.t as c from absop h join ovr o on o.unit = h.unit and o.r = h.r)
        select p.unit, p.h as "handler", p.c as "concreteHandler" from pairs p join ext e on e.unit = p.unit and e.c = p.c and e.b = p.h join succ s on s.unit = p.unit and s.t = p.h and s.h = p.h
        union
        select p.unit, p.h, p.c from pairs p join ext l on l.unit = p.unit and l.b = p.h join succ s on s.unit = p.unit and s.t = l.c and s.h = p.h
        join ext e on e.unit = p.unit and e.c = p.c and e.b = l.c
        where p.c <> l.c and not exists (select 1 from plain x where x.unit = p.unit and x.b = p.h)""",
    "Command": """
        select distinct c.unit, i.t as "invoker", c.b as "command", c.i as "concreteCommand", v.r as "receiver"
        from conf c join ovr o on o.unit = c.unit and o.t = c.i and o.r = c.r
        join holds v on v.unit = c.unit and v.t = c.i join dele d on d.unit = c.unit and d.m = o.m and d.f = v.m
        join kind vk on vk.unit = c.unit and vk.n = v.r and vk.k = 'Class'
        join holds i on i.unit = c.unit and i.r = c.b join kind ik on ik.unit = c.unit and ik.n = i.t and ik.k = 'Class'
        join meth t on t.unit = c.unit and t.t = i.t join dele g on g.unit = c.unit and g.m = t.m and g.f = i.m
        where v.r <> c.b and i.t <> c.b
          and not exists (select 1 from ext e where e.unit = c.unit and e.c = v.r and e.b = c.b)
          and not exists (select 1 from holds b where b.unit = c.unit and b.t = v.r and b.r = c.b)
          and not exists (select 1 from meth k, inst n where k.unit = c.unit and k.t = c.i and n.unit = c.unit and n.m = k.m and n.r = v.r)
          and not exists (select 1 from ext e where e.unit = c.unit and e.c = i.t and e.b = c.b)""",
    "Composite": """
        select distinct p.unit, p.t as "component", x.c as "composite", l.c as "leaf"
        from openop p join ext x on x.unit = p.unit and x.b = p.t join ovr xo on xo.unit = p.unit and xo.t = x.c and xo.r = p.r
        join ext l on l.unit = p.unit and l.b = p.t join ovr lo on lo.unit = p.unit and lo.t = l.c and lo.r = p.r
        where l.c <> x.c
          and exists (select 1 from slot s, targ t where s.unit = p.unit and s.t = x.c and t.unit = p.unit and t.m = s.m and t.r = p.t)
          and not exists (select 1 from fld s, targ t where s.unit = p.unit and s.t = l.c and t.unit = p.unit and t.m = s.m and t.r = p.t)
          and not exists (select 1 from prop s, targ t where s.unit = p.unit and s.t = l.c and t.unit = p.unit and t.m = s.m and t.r = p.t)""",
    "Decorator": """
        select distinct p.unit, p.t as "component", cc.c as "concreteComponent", d.c as "decorator"
        from openop p join ext d on d.unit = p.unit and d.b = p.t
        join slot w on w.unit = p.unit and w.t = d.c join ret wr on wr.unit = p.unit and wr.m = w.m and wr.r = p.t
        join ovr o on o.unit = p.unit and o.r = p.r join dele g on g.unit = p.unit and g.m = o.m and g.f = w.m
        join ext cc on cc.unit = p.unit and cc.b = p.t join ovr co on co.unit = p.unit and co.t = cc.c and co.r = p.r
        where cc.c <> d.c
          and (o.t = d.c or exists (select 1 from reach h where h.unit = p.unit and h.c = o.t and h.b = d.c))
          and not exists (select 1 from holds a, holds b where a.unit = p.unit and a.t = d.c and a.r = p.t and b.unit = p.unit and b.t = d.c and b.r = p.t and a.m < b.m)
          and not exists (select 1 from prop a, ret ar, prop b, ret br where a.unit = p.unit and a.t = d.c and ar.unit = p.unit and ar.m = a.m and ar.r = p.t and b.unit = p.unit and b.t = d.c and br.unit = p.unit and br.m = b.m and br.r = p.t and a.m < b.m)
          and not exists (select 1 from holds x where x.unit = p.unit and x.t = cc.c and x.r = p.t)""",
    "Facade": """
        with part as (select distinct h.unit, h.t, h.r from holds h join kind a on a.unit = h.unit and a.n = h.t and a.k = 'Class' join kind b on b.unit = h.unit and b.n = h.r and b.k = 'Class'
            join meth m on m.unit = h.unit and m.t = h.t join dele d on d.unit = h.unit and d.m = m.m and d.f = h.m where h.t <> h.r)
        select a.unit, a.t as "facade", a.r as "subsystemA", b.r as "subsystemB" from part a join part b on b.unit = a.unit and b.t = a.t and a.r < b.r
        where not exists (select 1 from ext e where e.unit = a.unit and e.c = a.t)""",
    "Factory Method": """
        select distinct a.unit, a.t as "creator", a.m as "factoryMethod", a.r as "product", e.c as "concreteCreator", i.r as "concreteProduct"
        from absop a join ext e on e.unit = a.unit and e.b = a.t join ovr o on o.unit = a.unit and o.t = e.c and o.r = a.r
        join inst i on i.unit = a.unit and i.m = o.m join reach q on q.unit = a.unit and q.c = i.r and q.b = a.r
        where a.t <> a.r
          and not exists (select 1 from holds h where h.unit = a.unit and h.t = i.r and h.r = e.c)
          and not exists (select 1 from absop g, ext x where g.unit = a.unit and g.t = a.t and g.r <> a.r and x.unit = a.unit and x.b = g.r)""",
    "Flyweight": """
        select distinct f.unit, p.t as "flyweightFactory", f.t as "flyweight"
        from fld f join kind k on k.unit = f.unit and k.n = f.t and k.k = 'Class'
        join fld p on p.unit = f.unit join targ t on t.unit = f.unit and t.m = p.m and t.r = f.t
        join meth g on g.unit = f.unit and g.t = p.t join ret r on r.unit = f.unit and r.m = g.m and r.r = f.t join inst i on i.unit = f.unit and i.m = g.m and i.r = f.t
        where (exists (select 1 from md x where x.unit = f.unit and x.n = f.m and x.x = 'ReadOnly') or exists (select 1 from ctor c, asg a where c.unit = f.unit and c.t = f.t and a.unit = f.unit and a.m = c.m and a.f = f.m))
          and not exists (select 1 from meth m, asg a where m.unit = f.unit and m.t = f.t and a.unit = f.unit and a.m = m.m and a.f = f.m)
          and p.t <> f.t and not exists (select 1 from ext e where e.unit = f.unit and e.c = p.t and e.b = f.t)""",
    "Interpreter": """
        select distinct c.unit, c.b as "expression", e.c as "terminalExpression", c.i as "nonterminalExpression"
        from conf c join ext e on e.unit = c.unit and e.b = c.b join ovr o on o.unit = c.unit and o.t = e.c and o.r = c.r
        where e.c <> c.i
          and (exists (select 1 from holds a, holds b where a.unit = c.unit and a.t = c.i and a.r = c.b and b.unit = c.unit and b.t = c.i and b.r = c.b and a.m < b.m)
            or exists (select 1 from prop a, ret ar, prop b, ret br where a.unit = c.unit and a.t = c.i and ar.unit = c.unit and ar.m = a.m and ar.r = c.b and b.unit = c.unit and b.t = c.i and br.unit = c.unit and br.m = b.m and br.r = c.b and a.m < b.m))
          and not exists (select 1 from slot s, ret r where s.unit = c.unit and s.t = e.c and r.unit = c.unit and r.m = s.m and r.r = c.b)""",
    "Iterator": """
        select distinct c.unit, h.r as "aggregate", c.b as "iterator", c.i as "concreteIterator"
        from conf c join holds h on h.unit = c.unit and h.t = c.i join kind k on k.unit = c.unit and k.n = h.r and k.k = 'Class'
        join meth m on m.unit = c.unit and m.t = h.r join inst i on i.unit = c.unit and i.m = m.m and i.r = c.i
        where h.r not in (c.b, c.i) and not exists (select 1 from ext e where e.unit = c.unit and e.c = h.r and e.b = c.b)
          and exists (select 1 from ret r where r.unit = c.unit and r.m = m.m and (r.r = c.b or exists (select 1 from ext e where e.unit = r.unit and e.c = c.b and e.b = r.r)))""",
    "Mediator": """
        with knows as (select distinct m.unit, r.r as med, m.t as col from meth m join dele d on d.unit = m.unit and d.m = m.m join ret r on r.unit = m.unit and r.m = d.f
            join kind k on k.unit = m.unit and k.n = m.t and k.k = 'Class'
            where m.t <> r.r and not exists (select 1 from ext e where e.unit = m.unit and e.c = m.t and e.b = r.r))
        select distinct c.unit, c.b as "mediator", c.i as "concreteMediator", a.col as "colleagueA", b.col as "colleagueB"
        from conf c join knows a on a.unit = c.unit and a.med = c.b join knows b on b.unit = c.unit and b.med = c.b and a.col < b.col
        where exists (select 1 from holds h where h.unit = c.unit and h.t = c.i and h.r = a.col) and exists (select 1 from holds h where h.unit = c.unit and h.t = c.i and h.r = b.col)""",
    "Memento": """
        select distinct s.unit, s.t as "originator", r.r as "memento", h.t as "caretaker"
        from meth s join kind k on k.unit = s.unit and k.n = s.t and k.k = 'Class' join ret r on r.unit = s.unit and r.m = s.m
        join inst i on i.unit = s.unit and i.m = s.m join meth q on q.unit = s.unit and q.t = s.t and q.m <> s.m
        join par p on p.unit = s.unit and p.m = q.m and p.r = r.r join asg a on a.unit = s.unit and a.m = q.m
        join fld h on h.unit = s.unit join targ t on t.unit = s.unit and t.m = h.m and t.r = r.r
        where (i.r = r.r or exists (select 1 from ext e where e.unit = s.unit and e.c = i.r and e.b = r.r)) and s.t not in (r.r, i.r) and h.t <> s.t
          and not exists (select 1 from meth c, inst n where c.unit = s.unit and c.t = h.t and n.unit = s.unit and n.m = c.m and (n.r = r.r or exists (select 1 from ext e where e.unit = n.unit and e.c = n.r and e.b = r.r)))""",
    "Observer": """
        select distinct f.unit, f.t as "subject", t.r as "observer", c.i as "concreteObserver"
        from fld f join kind k on k.unit = f.unit and k.n = f.t and k.k = 'Class' join targ t on t.unit = f.unit and t.m = f.m
        join conf c on c.unit = f.unit and c.b = t.r
        where f.t <> t.r
          and exists (select 1 from meth m, inv i where m.unit = f.unit and m.t = f.t and i.unit = f.unit and i.m = m.m and i.r = t.r)
          and exists (select 1 from meth m, par i where m.unit = f.unit and m.t = f.t and i.unit = f.unit and i.m = m.m and i.r = t.r)
          and not exists (select 1 from reach x where x.unit = f.unit and x.c = f.t and x.b = t.r)
          and not exists (select 1 from meth m, inst i, ext e where m.unit = f.unit and m.t = f.t and i.unit = f.unit and i.m = m.m and e.unit = f.unit and e.c = i.r and e.b = t.r)""",
    "Prototype": """
        select a.unit, a.t as "prototype", e.c as "concretePrototype" from absop a join ext e on e.unit = a.unit and e.b = a.t
        join ovr o on o.unit = a.unit and o.t = e.c and o.r = a.t join inst i on i.unit = a.unit and i.m = o.m and i.r = e.c where a.r = a.t
        union
        select p.unit, p.t, m.t from meth p join meth m on m.unit = p.unit and m.m = p.m join kind k on k.unit = p.unit and k.n = m.t and k.k = 'Class'
        join inst i on i.unit = p.unit and i.m = m.m and i.r = m.t join ret r on r.unit = p.unit and r.m = m.m
        where not exists (select 1 from md x where x.unit = p.unit and x.n = m.m and x.x = 'Static')
          and (r.r = m.t or r.r = 'object' and exists (select 1 from ext e where e.unit = p.unit and e.c = m.t and e.b = 'System.ICloneable'))""",
    "Proxy": """
        select distinct c.unit, c.b as "subject", c.i as "realSubject", e.c as "proxy"
        from conf c join ext e on e.unit = c.unit and e.b = c.b join holds w on w.unit = c.unit and w.t = e.c and w.r = c.i
        join dele d on d.unit = c.unit and d.f = w.m join ovr o on o.unit = c.unit and o.t = e.c and o.m = d.m and o.r = c.r
        where e.c <> c.i""",
    "Singleton": """
        select distinct c.unit, c.t as "class" from ctor c join kind k on k.unit = c.unit and k.n = c.t and k.k = 'Class'
        join md x on x.unit = c.unit and x.n = c.m and x.x = 'Private'
        where exists (select 1 from oper a, md s, ret r where a.unit = c.unit and a.t = c.t and s.unit = c.unit and s.n = a.m and s.x = 'Static' and r.unit = c.unit and r.m = a.m and r.r = c.t)""",
    "State": """
        select distinct c.unit, h.t as "context", c.b as "state", c.i as "concreteState", i.r as "nextState"
        from conf c join meth t on t.unit = c.unit and t.t = c.i join inst i on i.unit = c.unit and i.m = t.m
        join ext e on e.unit = c.unit and e.c = i.r and e.b = c.b
        join holds h on h.unit = c.unit and h.r = c.b join kind k on k.unit = c.unit and k.n = h.t and k.k = 'Class'
        where i.r <> c.i and h.t <> c.b
          and not exists (select 1 from holds x where x.unit = c.unit and x.t = c.i and x.r = i.r)
          and not exists (select 1 from ext x where x.unit = c.unit and x.c = h.t and x.b = c.b)""",
    "Strategy": """
        select distinct h.unit, h.t as "context", h.r as "strategy", c.i as "concreteStrategy"
        from holds h join kind k on k.unit = h.unit and k.n = h.t and k.k = 'Class' join meth m on m.unit = h.unit and m.t = h.t
        join dele d on d.unit = h.unit and d.m = m.m and d.f = h.m join conf c on c.unit = h.unit and c.b = h.r
        where h.t <> h.r
          and not exists (select 1 from ext e where e.unit = h.unit and e.c = h.t and e.b = h.r)
          and not exists (select 1 from ext e where e.unit = h.unit and e.b = h.t)
          and not exists (select 1 from ext z, holds a, kind v where z.unit = h.unit and z.b = h.r and a.unit = h.unit and a.t = z.c and v.unit = h.unit and v.n = a.r and v.k = 'Class')
          and not exists (select 1 from ext z, meth t, inst i, ext n where z.unit = h.unit and z.b = h.r and t.unit = h.unit and t.t = z.c and i.unit = h.unit and i.m = t.m and n.unit = h.unit and n.c = i.r and n.b = h.r and i.r <> z.c)""",
    "Template Method": """
        select distinct a.unit, a.n as "abstractClass", e.c as "concreteClass"
        from kind a join md am on am.unit = a.unit and am.n = a.n and am.x = 'Abstract'
        join oper t on t.unit = a.unit and t.t = a.n join oper s on s.unit = a.unit and s.t = a.n join md sm on sm.unit = a.unit and sm.n = s.m and sm.x = 'Abstract'
        join ret r on r.unit = a.unit and r.m = s.m join calls c on c.unit = a.unit and c.m = t.m and c.n = s.m
        join ext e on e.unit = a.unit and e.b = a.n join oper o on o.unit = a.unit and o.t = e.c join md om on om.unit = a.unit and om.n = o.m and om.x = 'Override'
        join ret orr on orr.unit = a.unit and orr.m = o.m and orr.r = r.r
        where a.k = 'Class'
          and not exists (select 1 from md x where x.unit = a.unit and x.n = t.m and x.x in ('Abstract', 'Static'))
          and not exists (select 1 from inst i, ext x where i.unit = a.unit and i.m = o.m and x.unit = a.unit and x.c = i.r and x.b = r.r)
          and not exists (select 1 from kind x, kind y where x.unit = a.unit and x.n = t.m and x.k = 'Property' and y.unit = a.unit and y.n = s.m and y.k = 'Method')""",
    "Visitor": """
        with v as (select distinct e.unit, p.r as vis, e.t as el, va.m as vm, vp.r as ce
            from meth e join md em on em.unit = e.unit and em.n = e.m and em.x = 'Abstract' join par p on p.unit = e.unit and p.m = e.m and p.r <> e.t
            join meth va on va.unit = e.unit and va.t = p.r join md vx on vx.unit = e.unit and vx.n = va.m and vx.x = 'Abstract' join par vp on vp.unit = e.unit and vp.m = va.m
            join ext x on x.unit = e.unit and x.c = vp.r and x.b = e.t
            where exists (select 1 from meth q, md qm, par qp where q.unit = e.unit and q.t = vp.r and qm.unit = e.unit and qm.n = q.m and qm.x = 'Override' and qp.unit = e.unit and qp.m = q.m and qp.r = p.r))
        select distinct a.unit, a.vis as "visitor", c.c as "concreteVisitor", a.el as "element", a.ce as "concreteElementA", b.ce as "concreteElementB"
        from v a join v b on b.unit = a.unit and b.vis = a.vis and b.el = a.el and a.vm <> b.vm and a.ce < b.ce join ext c on c.unit = a.unit and c.b = a.vis
        where exists (select 1 from meth w, md x, par p where w.unit = a.unit and w.t = c.c and x.unit = a.unit and x.n = w.m and x.x = 'Override' and p.unit = a.unit and p.m = w.m and p.r = a.ce)
          and exists (select 1 from meth w, md x, par p where w.unit = a.unit and w.t = c.c and x.unit = a.unit and x.n = w.m and x.x = 'Override' and p.unit = a.unit and p.m = w.m and p.r = b.ce)""",
}


def over_motifs(select: str) -> str:
    """A statement over the facts of motifs and their views."""
    return f"with recursive {motifs.facts_sql()}, {VIEWS} select * from ({select}) q"


def all_matches(ident: str = "unit, pattern, count(*)::bigint as match_rows", tail: str = "group by unit, pattern") -> str:
    parts = " union all ".join(f"select unit, '{p}' as pattern from ({s}) q{i}" for i, (p, s) in enumerate(SELECTS.items()))
    return over_motifs(f"select {ident} from ({parts}) a {tail}")
