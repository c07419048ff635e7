"""The fixed vocabulary: predicates, kinds, modifiers, patterns, and roles with their ontology terms."""

from __future__ import annotations

#: Node kinds, modifiers and predicates of the fact table.
TYPE_KINDS = ("Class", "Interface", "Struct")
MEMBER_KINDS = ("Constructor", "Method", "Property", "Field")
MODIFIERS = ("Public", "Private", "Protected", "Internal", "Static", "Abstract", "Virtual", "Override", "Sealed", "ReadOnly", "Const")
PREDICATES = (
    "type", "extends", "hasConstructor", "hasMethod", "hasProperty", "hasField", "hasModifier", "returnsType", "hasParameterType",
    "hasTypeArgument", "instantiates", "invokes", "calls", "delegatesTo", "returnsSelf", "assignsField",
)

#: Namespaces of the text formats: vocabulary terms, nodes of a scan, findings, and the public pattern ontology.
SRC = "urn:factloom:source#"
SCAN = "urn:factloom:scan#"
DET = "urn:factloom:findings#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
DCTERMS = "http://purl.org/dc/terms/"
FDP = "https://dejanl.github.io/FDP/FDP.ttl#"

#: Roles of each pattern, in order, and the ontology's local name of each ("" where it has none).
ROLES: dict[str, dict[str, str]] = {
    "Abstract Factory": {"factory": "AbstractFactoryAbstractFactory", "concreteFactory": "AbstractFactoryConcreteFactory", "productA": "AbstractFactoryAbstractProduct", "productB": "AbstractFactoryAbstractProduct"},
    "Adapter": {"target": "AdapterClientInterface", "adapter": "AdapterAdapter", "adaptee": "AdapterService"},
    "Bridge": {"abstraction": "BridgeAbstraction", "refinedAbstraction": "BridgeRefinedAbstraction", "implementor": "BridgeImplementation", "concreteImplementor": "BridgeConcreteImplementation"},
    "Builder": {"builder": "BuilderBuilder", "concreteBuilder": "BuilderConcreteBuilder", "product": "BuilderProduct"},
    "Chain of Responsibility": {"handler": "ChainOfResponsibilityHandler", "concreteHandler": "ChainOfResponsibilityConcreteHandler"},
    "Command": {"invoker": "CommandInvoker", "command": "CommandCommand", "concreteCommand": "CommandConcreteCommand", "receiver": "CommandReceiver"},
    "Composite": {"component": "CompositeComponent", "composite": "CompositeContainer", "leaf": "CompositeLeaf"},
    "Decorator": {"component": "DecoratorComponent", "concreteComponent": "DecoratorConcreteComponent", "decorator": "DecoratorBaseDecorator"},
    "Facade": {"facade": "FacadeFacade", "subsystemA": "FacadeSubsystemClass", "subsystemB": "FacadeSubsystemClass"},
    "Factory Method": {"creator": "FactoryMethodCreator", "factoryMethod": "", "product": "FactoryMethodProduct", "concreteCreator": "FactoryMethodConcreteCreator", "concreteProduct": "FactoryMethodConcreteProduct"},
    "Flyweight": {"flyweightFactory": "FlyweightFlyweightFactory", "flyweight": "FlyweightFlyweight"},
    "Interpreter": {"expression": "", "terminalExpression": "", "nonterminalExpression": ""},
    "Iterator": {"aggregate": "IteratorIterableCollection", "iterator": "IteratorIterator", "concreteIterator": "IteratorConcreteIterator"},
    "Mediator": {"mediator": "MediatorMediator", "concreteMediator": "MediatorConcreteMediator", "colleagueA": "MediatorComponent", "colleagueB": "MediatorComponent"},
    "Memento": {"originator": "MementoOriginator", "memento": "MementoMemento", "caretaker": "MementoCaretaker"},
    "Observer": {"subject": "ObserverPublisher", "observer": "ObserverSubscriber", "concreteObserver": "ObserverConcreteSubscriber"},
    "Prototype": {"prototype": "PrototypePrototype", "concretePrototype": "PrototypeConcretePrototype"},
    "Proxy": {"subject": "ProxyServiceInterface", "realSubject": "ProxyService", "proxy": "ProxyProxy"},
    "Singleton": {"class": "SingletonSingleton"},
    "State": {"context": "StateContext", "state": "StateState", "concreteState": "StateConcreteState", "nextState": "StateConcreteState"},
    "Strategy": {"context": "StrategyContext", "strategy": "StrategyStrategy", "concreteStrategy": "StrategyConcreteStrategy"},
    "Template Method": {"abstractClass": "TemplateMethodAbstractClass", "concreteClass": "TemplateMethodConcreteClass"},
    "Visitor": {"visitor": "VisitorVisitor", "concreteVisitor": "VisitorConcreteVisitor", "element": "VisitorElement", "concreteElementA": "VisitorConcreteElement", "concreteElementB": "VisitorConcreteElement"},
}

PATTERNS = tuple(sorted(ROLES))


def pattern_key(pattern: str) -> str:
    """Letters and digits of a pattern's name: rule ids, query names, ontology names."""
    return "".join(c for c in pattern if c.isalnum())


def snake(pattern: str) -> str:
    return pattern.lower().replace(" ", "_")


def pattern_iri(pattern: str) -> str | None:
    """The ontology's name of a pattern; None where it models none of its roles."""
    if not any(ROLES[pattern].values()):
        return None
    return FDP + "".join(w[0].upper() + w[1:] for w in pattern.split(" "))
