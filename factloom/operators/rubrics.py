"""What a reviewer should look for, pattern by pattern."""

from __future__ import annotations

RUBRICS: dict[str, str] = {
    "Abstract Factory": "one type declares operations that each hand out a different abstract product, and its subtypes decide which matching set of concrete products is made; a single product, or a container that only looks things up, is not enough.",
    "Adapter": "a type offers the interface its clients expect and fulfils it by calling a class with another interface; there must be a real translation, not a wrapper of its own family and not an object that merely has a helper.",
    "Bridge": "two hierarchies vary independently: an abstraction with subtypes of its own keeps a reference to an implementor hierarchy and leaves the primitive work to it.",
    "Builder": "a product is assembled in several steps behind an interface of steps, and asked for at the end; fluent configuration of the object itself doesn't count.",
    "Chain of Responsibility": "handlers of one interface are linked, and each either deals with a request or passes it to the next; the choice to pass on must depend on the request.",
    "Command": "an action is an object with an operation to run it, bound to a receiver that does the work, and somebody who neither knows the receiver nor the action stores and triggers it.",
    "Composite": "containers and leaves share one interface, the container holds children of that interface, and its operation goes through them.",
    "Decorator": "a wrapper has the interface of what it wraps, forwards to it, and adds behaviour before or after; wrappers could be stacked.",
    "Facade": "a class gives a simple entry to several classes of a subsystem and coordinates them; clients gain by not knowing those.",
    "Factory Method": "a type leaves the creation of a product it works with to an overridable operation, and subtypes choose the concrete product.",
    "Flyweight": "many uses share few objects whose inner state never changes, and a factory pools them by key.",
    "Interpreter": "a grammar is a hierarchy of expressions, with terminals and nonterminals made of expressions, evaluated by one recursive operation over a context.",
    "Iterator": "an object walks a collection step by step without showing how the collection is stored, and the collection hands such walkers out.",
    "Mediator": "colleagues don't talk to each other but to a mediator, which knows them and decides who has to react.",
    "Memento": "an originator captures its state in an opaque object and can return to it, and a caretaker keeps such objects without looking inside.",
    "Observer": "a subject keeps a list of observers that join and leave at run time, and tells all of them when something happens.",
    "Prototype": "new objects are made by copying an existing one through an operation of the object itself.",
    "Proxy": "a stand-in with the interface of a real subject controls access to it: when it is made, who may call, or what is remembered.",
    "Singleton": "a class makes sure that it has one instance only and gives a global way to it.",
    "State": "an object's behaviour depends on a state object it holds, and states replace each other as things happen.",
    "Strategy": "a context works with an interchangeable algorithm behind an interface, which its user chooses; the algorithms don't know each other.",
    "Template Method": "a base class fixes the order of steps in one operation and leaves some steps to its subtypes.",
    "Visitor": "elements accept a visitor and call back the operation meant for their type, so that new operations need no change of the elements.",
}
