import io
import json
import random
import threading
import urllib.error
import urllib.parse
import urllib.request

import pytest

from tests.toy import TOY, evaluate, group_text, solutions, text_of
from tripleweave import Engine, ParseError, QueryError, Store, cli, ntriples
from tripleweave.operators.access import AccessPaths
from tripleweave.operators.joins import intersection
from tripleweave.plans.algebra import Const, Pattern, Var
from tripleweave.plans.parser import parse
from tripleweave.plans.planner import plan
from tripleweave.server import server
from tripleweave.sinks import json_chunks
from tripleweave.sources import store as store_module
from tripleweave.sources.ntriples import write_ntriples
from tripleweave.streaming.ingest import start


def graph_frame(spark, graph):
    return spark.createDataFrame(graph, "s string, p string, o string")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return Store.build(spark, graph_frame(spark, TOY + TOY[:3]), str(tmp_path_factory.mktemp("toy")), encode=True)


def answers(engine, text):
    return sorted(map(tuple, engine.sparql(text).collect()))


CASES = [
    ("<a> <knows> <b> . ?x <type> <P>", 2), ("<b> <knows> <a> . ?x <type> <P>", 0), ("?x <type> <P>", 2), ("<b> ?p <c>", 2), ('<a> ?p "A"', 1), ("<a> <knows> ?o", 2),
    ("?x <knows> ?y", 4), ("<a> ?p ?o", 4), ("?s ?p <c>", 2), ('?s ?p "A"', 2), ("?s ?p ?o", 12), ("?x <knows> ?x", 1), ("?x <knows> ?y . ?y <knows> ?z . ?z <knows> ?x", 4),
    ("?a <knows> ?c . ?b <knows> ?c . ?a <knows> ?b . ?c <type> ?t", 3), ("?x <type> <Q> . ?y <type> <P>", 2), ("<a> ?p ?u . <b> ?p ?v", 4), ("?p <label> ?l . ?x ?p ?y", 4),
    ("?x <name> ?n . ?y <name> ?n", 5), ("?x <type> ?t . ?x <knows> ?y . ?x ?p ?y", 5), ("?x <nope> ?y", 0), ("?x ?x ?y", 0), ("?x <knows> <zzz>", 0),
]


@pytest.mark.parametrize("patterns, n", CASES)
def test_toy_graph(store, patterns, n):
    split = [tuple(p.split()) for p in patterns.split(" . ")]
    want = evaluate(TOY, split)
    assert len(want) == n
    names = sorted({t[1:] for p in split for t in p if t.startswith("?")})
    for encoded in (False, True):
        got = answers(Engine(store, encoded=encoded), f"SELECT * WHERE {{ {patterns} }}")
        assert got == sorted(tuple(r[f"?{v}"] for v in names) for r in want)


def test_modifiers(store):
    e = Engine(store)
    assert len(answers(e, "SELECT ?x WHERE { ?x <knows> ?y }")) == 4
    assert len(answers(e, "SELECT DISTINCT ?x WHERE { ?x <knows> ?y }")) == 3
    assert len(answers(e, "SELECT ?p WHERE { ?x <type> <P> . ?x ?p ?o }")) == 8
    assert answers(e, "SELECT DISTINCT ?p WHERE { ?x <type> <P> . ?x ?p ?o }") == [("<knows>",), ("<likes>",), ("<name>",), ("<type>",)]
    assert len(answers(e, "SELECT ?x WHERE { ?x <knows> ?y } LIMIT 3")) == 3
    assert len(answers(e, "SELECT DISTINCT ?x WHERE { ?x <knows> ?y } LIMIT 10")) == 3
    assert answers(e, "SELECT ?x WHERE { ?x <knows> ?y } LIMIT 0") == []
    assert e.sparql("SELECT * WHERE { ?z <knows> ?b }").columns == ["b", "z"]
    assert answers(e, "SELECT ?y ?x WHERE { ?x <likes> ?y }") == [("<c>", "<b>")]
    assert answers(e, "SELECT ?X ?x WHERE { ?x <likes> ?X }") == [("<c>", "<b>")]
    assert answers(e, "SELECT DISTINCT ?x WHERE { <a> <knows> <b> . ?x <likes> ?y . ?u <name> ?v }") == [("<b>",)]
    assert answers(e, "SELECT ?x WHERE { ?x <likes> ?y . ?u <name> ?v . ?w <type> <P> }") == [("<b>",)] * 6
    assert answers(e, "SELECT ?v WHERE { <b> <likes> ?y . ?u <name> ?v }") == [('"A"',), ('"A"',), ('"B"',)]
    with pytest.raises(QueryError):
        e.sparql("SELECT ?nope WHERE { ?x <knows> ?y }")


def test_filters_and_optionals(spark, tmp_path):
    graph = [("<a>", "<age>", '"5"'), ("<b>", "<age>", '"12"'), ("<c>", "<age>", '"old"'), ("<a>", "<likes>", "<b>"), ("<b>", "<likes>", "<c>"), ("<c>", "<mail>", '"c@x"')]
    e = Engine(Store.build(spark, graph_frame(spark, graph), str(tmp_path)))
    say = lambda body, v="?x": answers(e, f"SELECT {v} WHERE {{ {body} }}")
    assert say("?x <age> ?n FILTER(?n > 6)") == [("<b>",)]
    assert say('?x <age> ?n FILTER(?n = "5")') == [("<a>",)]
    assert say('?x <age> ?n FILTER(?n != "5") FILTER(?n < "2")') == [("<b>",)]
    assert say('?x <age> ?n FILTER(regex(?n, "^O", "i"))') == [("<c>",)]
    got = {r[0]: r[1] for r in e.sparql("SELECT ?x ?m WHERE { ?x <likes> ?y OPTIONAL { ?y <mail> ?m } }").collect()}
    assert got == {"<a>": None, "<b>": '"c@x"'}
    got = {r[0]: r[1] for r in e.sparql("SELECT ?x ?n WHERE { ?x <likes> ?y OPTIONAL { ?y <age> ?n FILTER(?n > 6) } }").collect()}
    assert got == {"<a>": '"12"', "<b>": None}
    # a variable that the first OPTIONAL leaves unbound joins with anything in the second
    got = {(r[0], r[1]) for r in e.sparql("SELECT ?x ?m WHERE { ?x <age> ?n OPTIONAL { ?x <mail> ?m } OPTIONAL { ?x <likes> ?m } }").collect()}
    assert got == {("<a>", "<b>"), ("<b>", "<c>"), ("<c>", '"c@x"')}
    assert say("?x <age> ?n OPTIONAL { ?x <mail> ?m } FILTER(bound(?m))") == [("<c>",)]


def test_random_graphs_against_nested_loops(spark, tmp_path):
    """Random patterns; the result is the same in any order of patterns, with and without planning, with terms and with ids."""
    r = random.Random(12)
    terms = ["<a>", "<b>", "<c>", "<d>", '"x"', '"y"']
    graph = sorted({(r.choice(terms[:4]), r.choice(terms[:3]), r.choice(terms)) for _ in range(60)})
    store = Store.build(spark, graph_frame(spark, graph), str(tmp_path), encode=True)
    for _ in range(14):
        patterns = [tuple(r.choice(["?u", "?v", "?w", "?x", r.choice(terms)]) if i != 1 else r.choice(["?q", "?u", *terms[:3], *terms[:3]]) for i in range(3)) for _ in range(r.randint(1, 3))]
        names = sorted({t[1:] for p in patterns for t in p if t.startswith("?")})
        if not names:
            continue
        want = sorted(tuple(b[f"?{v}"] for v in names) for b in evaluate(graph, patterns))
        for ordered, encoded, order in ((True, False, patterns), (False, False, patterns[::-1]), (True, True, patterns)):
            text = f"SELECT * WHERE {{ {text_of(order)} }}"
            assert answers(Engine(store, ordered=ordered, encoded=encoded), text) == want, text
        if len(want) < 2000:
            some = names[: max(1, len(names) // 2)]
            got = answers(Engine(store), f"SELECT DISTINCT {' '.join('?' + v for v in some)} WHERE {{ {text_of(patterns)} }}")
            assert got == sorted({tuple(b[f"?{v}"] for v in some) for b in evaluate(graph, patterns)})


def test_plans_prune_and_push_down(store):
    e = Engine(store)
    plan = e.sparql("SELECT ?x WHERE { ?x <type> <P> }")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "EqualTo(o,<P>)" in plan and "/ops" in plan
    steps = e.explain("SELECT * WHERE { ?x <knows> ?y . ?z <label> ?l . ?y <likes> ?w }").splitlines()
    assert "<label>" in steps[0] and len(steps) == 3
    assert "Cartesian" not in e.sparql("SELECT * WHERE { ?x <knows> ?y . ?z <likes> ?w . ?y <type> ?t . ?t <p> ?w }")._jdf.queryExecution().toString()


def test_order_avoids_large_intermediate_results():
    """A cycle over a small dimension: joining the small tables first would pair every s with every c."""

    class Fake:
        meta = store_module.Meta("predicate", False, 1_000_000, 5)

        def stats(self, predicates):
            sizes = {"<l_order>": (60_000, 60_000, 15_000), "<o_cust>": (15_000, 15_000, 1_500), "<c_nation>": (1_500, 1_500, 25), "<l_supp>": (60_000, 60_000, 100), "<s_nation>": (100, 100, 25)}
            return {p: sizes[p] for p in predicates if p in sizes}

    cycle = parse("SELECT * WHERE { ?s <s_nation> ?n . ?c <c_nation> ?n . ?o <o_cust> ?c . ?l <l_order> ?o . ?l <l_supp> ?s }").where.patterns
    steps = plan(Fake(), cycle).steps
    assert max(s.result for s in steps) <= 60_000 and steps[-1].shared in (("s", "n"), ("c", "n"), ("o", "c"), ("l", "o"), ("l", "s"))
    long = parse("SELECT * WHERE { " + " . ".join(f"?x{i} <o_cust> ?x{i + 1}" for i in range(12)) + " . ?y <c_nation> ?z }").where.patterns
    steps = plan(Fake(), long).steps
    assert len(steps) == 13 and sum(not s.shared for s in steps) == 2
    assert plan(Fake(), parse("SELECT ?x WHERE { ?x <none> ?y }").where.patterns).empty


def test_many_predicates_use_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "MAX_PARTITIONED", 2)
    built = Store.build(spark, graph_frame(spark, TOY), str(tmp_path))
    again = Store.open(spark, str(tmp_path))
    assert built.meta == again.meta and again.meta.layout == "bucket" and again.meta.n_triples == 12
    for patterns, n in CASES[:12]:
        assert len(answers(Engine(again), f"SELECT * WHERE {{ {patterns} }}")) == n


def test_partition_values_stay_strings(spark, tmp_path):
    built = Store.build(spark, graph_frame(spark, [("s", "01", "o"), ("s", "2", "o"), ("s", "<http://x/y?z=1&w>", "o")]), str(tmp_path))
    assert sorted(r.p for r in built.triples().collect()) == ["01", "2", "<http://x/y?z=1&w>"]


def test_access_paths(store):
    a = AccessPaths(store)
    of = lambda df: sorted(r[0] for r in df.collect())
    assert of(a.subjects_of("<name>")) == ["<a>", "<b>", "<c>"] and of(a.objects_of("<name>")) == ['"A"', '"B"']
    assert of(a.predicates_of_subject("<b>")) == ["<knows>", "<likes>", "<name>", "<type>"] and of(a.predicates_of_object("<c>")) == ["<knows>", "<likes>"]
    assert of(a.objects("<a>", "<knows>")) == ["<a>", "<b>"] and of(a.subjects('"A"', "<name>")) == ["<a>", "<c>"]
    assert of(a.predicates("<a>", '"A"')) == ["<name>"] and of(a.neighbours("<b>")) == ['"B"', "<P>", "<c>"] and of(a.referrers("<c>")) == ["<b>"]
    assert (a.n_subjects_of("<knows>"), a.n_objects_of("<name>"), a.n_objects_of("<none>"), a.degree(s="<a>"), a.degree(p="<type>", o="<P>")) == (3, 2, 0, 4, 2)
    assert a.characteristic_set("<a>").first().predicates == ["<knows>", "<name>", "<type>"]
    assert a.characteristic_set('"A"', of_objects=True).first().predicates == ["<name>"]
    ids = sorted(r.id for r in store.table("dict").collect())
    assert ids == list(range(1, len(ids) + 1)) and a.term_of(a.id_of('"B"')) == '"B"' and a.id_of("nope") is None and a.term_of(0) is None
    sets = [a.subjects_of("<name>"), a.subjects_of("<type>"), a.subjects_of("<likes>")]
    assert of(intersection(sets, "s")) == ["<b>"]


LINES = '<a>\t<p>\t"x . y"@en .\n<a> <p> <b>.\r\n\n# comment\n   \n<a> <p> <b> .\n<a> <p> <c>\nbad line .\n<a> <p> "caf\\u00E9 \\U0001F600" .\n<a> <p> "café 😀" .\n<a>   <q>    "two  spaces"^^<t>   .  \n<a> <q> "end." .\n'


def test_loader_and_round_trip(spark, tmp_path):
    (tmp_path / "x.nt").write_text(LINES, encoding="utf-8", newline="")
    loaded = ntriples(spark, str(tmp_path / "x.nt"))
    want = {("<a>", "<p>", '"x . y"@en'), ("<a>", "<p>", "<b>"), ("<a>", "<p>", '"café 😀"'), ("<a>", "<q>", '"two  spaces"^^<t>'), ("<a>", "<q>", '"end."')}
    assert {tuple(r) for r in loaded.triples.collect()} == want and loaded.triples.count() == 7
    assert sorted(r.line.strip() for r in loaded.malformed.collect()) == ["<a> <p> <c>", "bad line ."]
    built = Store.build(spark, loaded.triples, f"{tmp_path}/store")
    write_ntriples(built.triples(), f"{tmp_path}/out")
    assert {tuple(r) for r in ntriples(spark, f"{tmp_path}/out").triples.collect()} == want
    assert answers(Engine(built), 'SELECT ?x WHERE { ?x <p> "caf\\u00e9 😀" }') == [("<a>",)]


def test_stream_of_triples(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.nt").write_text(LINES, encoding="utf-8")
    for _ in range(2):
        start(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()
        (tmp_path / "in" / "y.nt").write_text("<a> <p> <b> .\n<z> <p> <b> .\nbad\n", encoding="utf-8")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 9
    built = Store.build(spark, spark.read.parquet(f"{tmp_path}/out"), f"{tmp_path}/store")
    assert built.meta.n_triples == 6


def test_command_line(spark, tmp_path):
    (tmp_path / "x.nt").write_text("".join(f"{s} {p} {o} .\n" for s, p, o in TOY) + "bad\n", encoding="utf-8")
    (tmp_path / "q").write_text("SELECT ?x WHERE { ?x <type> <Q> }\n\nSELECT ?x { }\nSELECT ?y WHERE { ?x <p> ?z }\n", encoding="utf-8")
    out = io.StringIO()
    cli.build(spark, f"{tmp_path}/db", str(tmp_path / "x.nt"), False, out)
    assert out.getvalue().startswith("12 triples, 5 predicates; 1 malformed lines\n")
    out = io.StringIO()
    assert cli.query(spark, f"{tmp_path}/db", str(tmp_path / "q"), out=out) == 2
    said = out.getvalue()
    assert "?x\n<c>\n1 result(s).\n" in said and said.count("error: ") == 2
    a = cli.arguments().parse_args(["query", "--database", "d", "-f", "q", "-t", "4"])
    assert (a.database, a.file, a.thread) == ("d", "q", 4)
    assert cli.arguments().parse_args(["server", "-d", "x"]).ip == "0.0.0.0"


def test_http(store):
    http = server(Engine(store), "127.0.0.1", 0)
    base = f"http://127.0.0.1:{http.server_port}"
    thread = threading.Thread(target=http.serve_forever)
    thread.start()
    ask = "SELECT ?x ?n WHERE { ?x <name> ?n . ?x <type> <Q> }"
    with urllib.request.urlopen(f"{base}/sparql?" + urllib.parse.urlencode({"query": ask})) as r:
        assert r.headers["Content-Type"] == "application/sparql-results+json" and r.headers["Access-Control-Allow-Origin"] == "*"
        assert json.load(r) == {"head": {"vars": ["?x", "?n"]}, "results": {"bindings": [["<c>", '"A"']]}}
    with urllib.request.urlopen(f"{base}/sparql", urllib.parse.urlencode({"query": ask, "format": "w3c"}).encode()) as r:
        assert json.load(r)["results"]["bindings"] == [{"x": {"type": "uri", "value": "c"}, "n": {"type": "literal", "value": "A"}}]
    request = urllib.request.Request(f"{base}/sparql", method="OPTIONS")
    with urllib.request.urlopen(request) as r:
        assert r.status == 204
    for path, status in (("/sparql?query=SELECT", 400), ("/sparql", 400), ("/nothing", 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(base + path)
        assert e.value.code == status
    with urllib.request.urlopen(f"{base}/disconnect") as r:
        assert r.status == 200
    thread.join(10)
    assert not thread.is_alive()
    http.server_close()


def test_json_of_terms(spark):
    df = spark.createDataFrame([('"a"@en', '"1"^^<t>'), ("_:b", None)], "x string, y string")
    got = json.loads("".join(json_chunks(df, w3c=True)))
    assert got["head"]["vars"] == ["x", "y"]
    assert got["results"]["bindings"] == [{"x": {"type": "literal", "value": "a", "xml:lang": "en"}, "y": {"type": "literal", "value": "1", "datatype": "t"}}, {"x": {"type": "bnode", "value": "b"}}]


def test_errors_say_where():
    with pytest.raises(ParseError, match="character 7"):
        Engine(None).parse("SELECT 5")
    assert Pattern(Var("a"), Const("<p>"), Var("a")).variables == ("a",)


def _random_group(r, depth):
    terms = ["?x", "?y", "?z", "?k"]
    patterns = [(r.choice(terms), r.choice(["<knows>", "<type>", "<likes>", "<name>", "<nope>"] if depth < 2 else ["<knows>", "<type>"]), r.choice([*terms, "<c>"])) for _ in range(1)]
    return patterns, [_random_group(r, depth - 1) for _ in range(r.randint(1, 2))] if depth else []


def test_optionals_match_a_nested_loop(store):
    r, key = random.Random(8), lambda row: tuple((v is None, v or "") for v in row)
    groups = [_random_group(r, 2) for _ in range(14)]
    groups.append(([("?a", "<likes>", "?c")], [([("?a", "<knows>", "?k")], [([("?k", "<nope>", "?c")], [])])]))
    for g in groups:
        text = f"SELECT * WHERE {{ {group_text(g)} }}"
        names = [c for c in Engine(store).sparql(text).columns]
        want = sorted((tuple(row.get(f"?{v}") for v in names) for row in solutions(TOY, g)), key=key)
        assert sorted(map(tuple, Engine(store).sparql(text).collect()), key=key) == want, text


def test_optionals_are_no_nested_loops(spark, store):
    text = "SELECT * WHERE { ?a <likes> ?c OPTIONAL { ?a <knows> ?k } OPTIONAL { ?k <name> ?n } }"
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan_text = Engine(store).sparql(text)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    parts = plan_text.split("== Physical Plan ==")[1]
    assert "SortMergeJoin" in parts and parts.count("NestedLoop") + parts.count("Cartesian") <= 2  # the unbound rows, which all partners match


def test_characteristic_sets_answer_variable_predicates(spark, store):
    """Where one end is needed nowhere, all triples aren't read, and the answers are the same."""
    for text in ("SELECT DISTINCT ?p WHERE { ?x <type> <P> . ?x ?p ?o }", "SELECT DISTINCT ?x ?p WHERE { ?x ?p ?o }", "SELECT DISTINCT ?p WHERE { ?s ?p <c> . ?s ?p ?o }", "SELECT DISTINCT ?o WHERE { ?s ?p ?o . ?o <type> ?t }", "SELECT DISTINCT ?p WHERE { <a> ?p ?o }", "SELECT DISTINCT ?x WHERE { ?x ?x ?o }"):
        body = text[text.index("{") + 1 : text.index("}")]
        names = text[: text.index("WHERE")].split()[2:]
        want = sorted({tuple(row[v] for v in names) for row in evaluate(TOY, [tuple(p.split()) for p in body.strip().split(" . ")])})
        assert answers(Engine(store), text) == want, text
    read = Engine(store).sparql("SELECT DISTINCT ?p WHERE { ?x <type> <P> . ?x ?p ?o }").inputFiles()
    assert {x.split("/")[-2 if "p=" not in x else -3] for x in read} == {"ops", "cs_s", "cs_s_sets"}


def test_characteristic_sets_bound_variable_predicates(spark, store, tmp_path, monkeypatch):
    """A scan with a variable predicate reads only folders that the sets of its ends leave, with the same answers."""
    cases = {
        "?x <likes> ?y . ?x ?p ?o": {"<knows>", "<likes>", "<name>", "<type>"},
        "<knows> ?p ?o": {"<label>"},
        '?s ?p "A"': {"<name>"},
        "<b> ?p <c>": {"<knows>", "<likes>"},
        "?x <type> <Q> . ?s ?p ?x . ?y <likes> ?x": {"<knows>", "<likes>"},
        "<nobody> ?p ?o": set(),
    }
    texts = {f"SELECT * WHERE {{ {body} }}": (body, left) for body, left in cases.items()}
    steps = {t: next(s for s in plan(store, parse(t).where.patterns).steps if not isinstance(s.pattern.p, Const)) for t in texts}
    assert {t: set(s.among) for t, s in steps.items()} == {t: left for t, (_, left) in texts.items()}
    monkeypatch.setattr(store_module, "MAX_PARTITIONED", 3)  # buckets, and too many predicates to name for some
    few = Store.build(spark, graph_frame(spark, TOY), str(tmp_path))
    assert few.predicates_beside(frozenset(["<likes>"])) is None and few.predicates_beside(frozenset(), "<knows>") == {"<label>"}
    for text, (body, _) in texts.items():
        want = evaluate(TOY, [tuple(p.split()) for p in body.split(" . ")])
        for engine in (Engine(store), Engine(few)):
            df = engine.sparql(text)
            assert sorted(map(tuple, df.collect())) == sorted(tuple(row[f"?{v}"] for v in df.columns) for row in want), text
    text = next(iter(texts))
    scans = [x for x in Engine(store).sparql(text)._jdf.queryExecution().toString().splitlines() if "FileScan" in x]
    assert len(scans) == 2 and all("PartitionFilters: [" in x and "PartitionFilters: []" not in x for x in scans)
