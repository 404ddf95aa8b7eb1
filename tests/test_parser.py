import pytest

from tripleweave.errors import ParseError
from tripleweave.functions.terms import RDF_TYPE, plain
from tripleweave.plans.algebra import Const, Filter, Pattern, Var
from tripleweave.plans.parser import parse


def one(text, **options):
    (p,) = parse(f"SELECT * WHERE {{ {text} }}", **options).where.patterns
    return p


@pytest.mark.parametrize(
    "text, terms",
    [
        ("?s <p> <o>", (Var("s"), Const("<p>"), Const("<o>"))),
        ('<s> ?p "a b . c"', (Const("<s>"), Var("p"), Const('"a b . c"'))),
        ('?s <p> "x"@en-GB.', (Var("s"), Const("<p>"), Const('"x"@en-GB'))),
        ('?s <p> "x"^^<t> .', (Var("s"), Const("<p>"), Const('"x"^^<t>'))),
        ('?s <p> "say \\"hi\\""', (Var("s"), Const("<p>"), Const('"say \\"hi\\""'))),
        ("?s <p> 5", (Var("s"), Const("<p>"), Const("5"))),
        ("?s <p> 5.25 .", (Var("s"), Const("<p>"), Const("5.25"))),
        ("word <p> ?o", (Const("word"), Const("<p>"), Var("o"))),
        ("?s a <C>", (Var("s"), Const(RDF_TYPE), Const("<C>"))),
        ('?s <p> "caf\\u00E9"', (Var("s"), Const("<p>"), Const('"café"'))),
    ],
)
def test_terms(text, terms):
    assert one(text).terms == terms


def test_query_parts():
    q = parse("prefix e: <http://e/> PREFIX : <x#> sElEcT DISTINCT ?a ?b ?a wHeRe { ?a e:p ?b { ?b :q \"1\"^^e:int . } { ?a ?c ?b } } LIMIT 0 trailing words")
    assert (q.select, q.modifier, q.limit, q.distinct) == (["a", "b"], "distinct", 0, True)
    assert [str(p) for p in q.where.patterns] == ["?a <http://e/p> ?b", '?b <x#q> "1"^^<http://e/int>', "?a ?c ?b"]
    assert parse("SELECT * WHERE { ?b <p> ?a }").columns == ["a", "b"]
    assert parse("SELECT REDUCED ?a WHERE { ?a <p> ?a . }").distinct is False
    assert parse("SELECT COUNT ?a WHERE { ?a <p> ?a . # comment\n }").modifier == "count"


def test_shapes():
    assert Pattern(Var("x"), Const("<p>"), Var("x")).shape == "?s p ?o repeated"
    assert Pattern(Const("<a>"), Var("p"), Const("<b>")).shape == "s ?p o"


def test_extensions():
    q = parse('SELECT ?a WHERE { ?a <p> ?b FILTER(?b != "x") FILTER(regex(?b, "^y", "i")) OPTIONAL { ?a <q> ?c FILTER(?c >= 4) } }')
    assert q.where.filters == [Filter("b", "!=", ('"x"',)), Filter("b", "regex", ('"^y"', '"i"'))]
    assert q.where.optionals[0].filters == [Filter("c", ">=", (4.0,))]


@pytest.mark.parametrize(
    "text",
    [
        "SELECT ?x { ?x <p> ?y }",
        "SELECT WHERE { ?x <p> ?y }",
        "SELECT ?x * WHERE { ?x <p> ?y }",
        "PREFIX a: <x> PREFIX a: <y> SELECT ?x WHERE { ?x <p> ?y }",
        "SELECT ?x WHERE { ?x <p> ?y ; <q> ?z }",
        "SELECT ?x WHERE { ?x <p> ?y , ?z }",
        "SELECT ?x WHERE { ?x <p> ?y",
        "SELECT ?x WHERE { { ?x <p> ?y }",
        "SELECT ?x WHERE { ?x <p> }",
        'SELECT ?x WHERE { ?x <p> "open }',
        "SELECT ?x WHERE { ?x u:p ?y }",
        "SELECT ?x WHERE { ?x <p> ?y } LIMIT ?x",
        "SELECT ?x WHERE { ?x <p> ?y } ORDER BY ?x",
        "SELECT ?x WHERE { { ?x <p> ?y } UNION { ?x <q> ?y } }",
        "ASK WHERE { ?x <p> ?y }",
        "CONSTRUCT { ?x <p> ?y } WHERE { ?x <p> ?y }",
        "",
    ],
)
def test_rejected(text):
    with pytest.raises(ParseError):
        parse(text)


@pytest.mark.parametrize("text", ["OPTIONAL { ?x <p> ?y }", '?x <p> ?y FILTER(?y = "a")', "?x e:p ?y"])
def test_strict_rejects_extensions(text):
    query = f"PREFIX e: <e> SELECT ?x WHERE {{ ?x <q> ?y . {text} }}"
    parse(query)
    with pytest.raises(ParseError):
        parse(query, strict=True)


def test_strict_takes_a_as_a_word():
    assert one("?s a <C>", strict=True).p == Const("a")


def test_escapes():
    assert plain("x\\u00e9\\U0001F600\\\\u0041") == "xé😀\\\\u0041"
