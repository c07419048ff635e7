"""Units read in parts: the same facts as in one piece, each part with the files that it needs only."""

from pyspark.sql import functions as F

from factloom.csharp import extract as module
from factloom.csharp.extract import extract

SCHEMA = "unit string, file string, file_order int, text string"


def same(spark, rows, monkeypatch):
    """Facts and places of rows in parts and as one; and how many (file, part) were lent."""
    lent = []

    def spy(made):
        found = needed(made)
        lent.append(found.count())
        return found

    needed = module.needed
    monkeypatch.setattr(module, "needed", spy)
    table = spark.createDataFrame(rows, SCHEMA)
    whole, parts = (sorted(map(tuple, x.collect()), key=str) for x in (extract(table), extract(table, part_chars=150)))
    assert whole == parts and whole
    return lent[0], len(rows)


def test_parts_get_the_files_that_they_need(spark, monkeypatch):
    rows = []
    for k in range(20):
        rows.append(("u", f"a{k}.cs", 2 * k, f"namespace N{k}; public interface IA {{ B Make(); }} public partial class B : IA {{ public B Make() {{ return this; }} }}"))
        rows.append(("u", f"b{k}.cs", 2 * k + 1, f"namespace N{k}; public class C : B {{ B _b; void Go() {{ _b.Make(); new B(); Make(); }} }}"))
    lent, files = same(spark, rows, monkeypatch)
    # with all declarations sent to all parts there would be some 25 a file
    assert lent <= files


def test_names_through_usings_aliases_bases_members_and_parts(spark, monkeypatch):
    texts = [
        "namespace A.Deep; public class Base { public class Inner { public Far.Leaf Leaf; } public Inner Hold; }",
        "namespace A.Deep.Far; public class Leaf { public void Fall() { } }",
        "using A.Deep; namespace B; public class Mid : Base { public Inner Own; public void Go() { Hold.Leaf.Fall(); Own.Leaf.Fall(); } }",
        "using X = A.Deep.Far.Leaf; namespace C; public class User { X _x; void Run() { _x.Fall(); new B.Mid().Go(); global::B.Mid m = null; m.Go(); } }",
        "namespace D; public partial class P { public int One; public void F() { G(); } }",
        "namespace D; public partial class P { public int Two; public void G() { Two = 1; } }",
        "namespace D; public class P<T> { public T Three; } public class P_T_ { public int Four; }",
        "public class Bare { A.Deep.Base _b; void Run() { _b.Hold.Leaf.Fall(); } }",
    ]
    same(spark, [("u", f"{k}.cs", k, t) for k, t in enumerate(texts)], monkeypatch)


def test_a_namespace_named_like_a_type_and_repeated_files(spark, monkeypatch):
    texts = ["namespace A; public class B { public C _c; void Run() { _c.Go(); } }", "namespace A.B; public class C { public void Go() { } }", "namespace Z; public class Lone { public int Field; public void M() { } }"]
    lent, _ = same(spark, [("u", f"{k}.cs", k, t) for k, t in enumerate(texts + texts[2:])], monkeypatch)
    assert lent
    deep = ".".join(f"n{k}" for k in range(40))
    same(spark, [("u", "a.cs", 0, f"namespace {deep}; public class T {{ public void Go() {{ }} }}"), ("u", "b.cs", 1, f"public class V {{ {deep}.T _t; void Run() {{ _t.Go(); }} }}"), ("u", "c.cs", 2, None)], monkeypatch)
