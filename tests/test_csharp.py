"""Source text to facts, on snippets of our own."""

import pytest

from factloom.csharp.binder import build
from factloom.csharp.tokens import tokenize


def facts(*texts):
    return set(build([(f"s{i}.cs", t) for i, t in enumerate(texts)])[0])


SHAPES = """
using System;
namespace Demo.Shapes;
public abstract class Shape { public abstract double Area(); protected readonly string _name = "x"; public string Name => _name; }
/* a comment with class Nothing { } */
public sealed class Group : Shape, ICloneable {
    private readonly List<Shape> _parts = new(); private int a, b;
    public Group() { a = 1; }
    public override double Area() { double sum = 0; foreach (var p in _parts) sum += p.Area(); return sum; }
    public Group Add(Shape s) { _parts.Add(s); this.b += 2; return this; }
    public object Clone() => MemberwiseClone();
    public static Group Make(string text) => new Group { };
    class Inner<T> where T : Shape { T Value { get; set; } Tuple<T, string>[] Pairs; }
}
record Point(int X, int Y); enum Color { Red } delegate void Done(int n);
public interface IRun { void Run(); int Speed { get; } void Stop() { } }
class Runner : IRun { public void Run() { } public int Speed => 3; public void Stop() { } }
"""


@pytest.fixture(scope="module")
def shapes():
    return facts(SHAPES)


N = "Demo.Shapes."


@pytest.mark.parametrize(
    "s,p,o",
    [
        ("Shape", "type", "Class"), ("Shape", "hasModifier", "Abstract"), ("Group", "extends", N + "Shape"), ("Group", "extends", "System.ICloneable"),
        ("Shape", "hasMethod", N + "Shape_Area_0"), ("Shape_Area_0", "hasModifier", "Abstract"), ("Shape_Area_0", "returnsType", "double"), ("Shape__name_1", "hasModifier", "ReadOnly"),
        ("Group__parts_0", "returnsType", "System.Collections.Generic.List_Shape_"), ("Group__parts_0", "hasTypeArgument", N + "Shape"), ("Group", "hasField", N + "Group_a_1"), ("Group", "hasField", N + "Group_b_2"),
        ("Group", "hasConstructor", N + "Group_Ctor_3"), ("Group_Ctor_3", "assignsField", N + "Group_a_1"), ("Group_Area_4", "hasModifier", "Override"), ("Group_Area_4", "invokes", N + "Shape"), ("Group_Area_4", "calls", N + "Shape_Area_0"),
        ("Group_Add_5", "hasParameterType", N + "Shape"), ("Group_Add_5", "delegatesTo", N + "Group__parts_0"), ("Group_Add_5", "assignsField", N + "Group_b_2"), ("Group_Add_5", "returnsSelf", N + "Group"),
        ("Group_Clone_6", "instantiates", N + "Group"), ("Group_Clone_6", "hasModifier", "Override"), ("Group_Make_7", "instantiates", N + "Group"), ("Group_Make_7", "hasModifier", "Static"),
        ("Group.Inner_T_", "type", "Class"), ("Group.Inner_T__Pairs_1", "hasTypeArgument", "string"), ("Group.Inner_T__Pairs_1", "hasTypeArgument", "System.Tuple_T_string_"), ("Point", "type", "Class"),
        ("IRun", "type", "Interface"), ("IRun_Run_0", "hasModifier", "Abstract"), ("IRun_Speed_1", "hasModifier", "Abstract"), ("Runner_Run_0", "hasModifier", "Override"), ("Runner_Speed_1", "hasModifier", "Override"),
    ],
)
def test_emitted(shapes, s, p, o):
    assert (N + s, p, o) in shapes


@pytest.mark.parametrize("s,p,o", [("IRun_Stop_2", "hasModifier", "Abstract"), ("Color", "type", "Class"), ("Done", "type", "Class"), ("Nothing", "type", "Class"), ("Group_Ctor_3", "hasModifier", "Private"), ("Group__parts_0", "instantiates", N + "Group")])
def test_not_emitted(shapes, s, p, o):
    assert (N + s, p, o) not in shapes


def test_constructor_without_access_is_private():
    assert ("A_Ctor_0", "hasModifier", "Private") in facts("class A { A() { new B(); } } class B { }") and ("A_Ctor_0", "instantiates", "B") not in facts("class A { A() { new B(); } } class B { }")


def test_partial_types_number_members_through_files():
    got = facts("partial class A { void X() { } }", "partial class A { void X() { } }")
    assert ("A", "hasMethod", "A_X_0") in got and ("A", "hasMethod", "A_X_1") in got


def test_bodies_see_later_files_and_lambdas():
    got = facts("class Hub { List<Sub> _subs; void Fire() { _subs.ForEach(s => s.Hit($\"{_subs.Count}\")); } }", "abstract class Sub { public abstract void Hit(string x); }")
    assert ("Hub_Fire_1", "invokes", "Sub") in got and ("Hub_Fire_1", "delegatesTo", "Hub__subs_0") in got


def test_unresolved_names_still_meet():
    got = facts("class A : Lib.Base<int> { Lib.Other x; Other y; }")
    assert ("A", "extends", "Base_int_") in got and ("A_x_0", "returnsType", "Other") in got and ("A_y_1", "returnsType", "Other") in got


def test_places():
    _, places = build([("f.cs", "\nclass A\n{\n    void M()\n    {\n    }\n    int a, b;\n}\n")])
    assert ("A", "f.cs", 2, 2) in places and ("A_M_0", "f.cs", 4, 6) in places and ("A_b_2", "f.cs", 7, 7) in places


@pytest.mark.parametrize("text", ["", "class", "class A {", "class A { void M( }", '$"{', "@@@ ### \x00", "namespace X { class A { int x = ; } }", "class A<T : B { }", '"""' * 5, "class A { void M() { x.y.z(((; } }"])
def test_broken_source_never_fails(text):
    tokenize(text)
    build([("f.cs", text)])


def test_extraction_runs_by_unit(spark):
    from factloom.csharp.extract import extract, facts_of, locations_of

    rows = [("u", "a.cs", 0, "class A : B { }"), ("u", "b.cs", 1, "namespace Q; class B { }"), ("v", "c.cs", 0, "class A : B { }"), ("w", "n.cs", 0, None), (None, "x.cs", 0, "class X { }")]
    made = extract(spark.createDataFrame(rows, "unit string, file string, file_order int, text string"))
    assert {(r.unit, r.s, r.o) for r in facts_of(made).where("p = 'extends'").collect()} == {("u", "A", "B"), ("v", "A", "B")}
    assert {(r.unit, r.fragment) for r in locations_of(made).collect()} == {("u", "A"), ("u", "Q.B"), ("v", "A")}
